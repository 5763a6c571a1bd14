"""Scanning one document in many tasks.

``scan`` works inside a row, so a document is one task's work.  Here a text is
cut into overlapping pieces that are scanned wherever there is room, and the
overlap fold runs on islands of candidates, which no span crosses:

1. Pieces go to tasks by (document, piece).  A match counts in the one piece
   that owns it (``operators.preview.owned_by_chunk``), so matches shorter than
   the overlap are found once, as in the undivided text.
2. A candidate begins an island where it starts at or after every earlier end.
   The running maximum of ends is taken within each piece, and carried over from
   the pieces before by a running maximum of the pieces' own maxima, one row per
   piece.  The same carries an island's beginning across cuts.
   Both passes read the candidates, so they are written once before.
3. Candidates meet by (document, island) and are folded there.

So no task holds the candidates of a document, only those of one piece or one
island.  The text itself is one value of one row, of at most 2 GB, and is cut
by the task that reads it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.spans import explode_rows
from ..operators import detect as D
from ..operators.merge import merge_spans
from ..operators.preview import chunk_text, owned_by_chunk
from ..operators.rules import as_unicode
from ..session import materialize
from .scan import ScanConfig

#: Characters of a piece, and how many of them the next piece repeats.
PIECE, OVERLAP = 1 << 18, 1 << 13


def piece_candidates(df: DataFrame, keys: list[str], text_col: str = "text", config: ScanConfig | None = None,
                     piece: int = PIECE, overlap: int = OVERLAP) -> DataFrame:
    """``keys``, ``piece`` (its number) and ``c`` (one candidate, offsets in the
    whole text) of every match that its piece owns.  The cue rules' own
    conflicts are not resolved yet."""
    config = config or ScanConfig()
    pieces = explode_rows(df.select(*keys, F.length(text_col).alias("__n"), chunk_text(F.col(text_col), piece, overlap).alias("__pieces")),
                          F.col("__pieces"), [*keys, "__n"], "p")
    pieces = pieces.select(*keys, "__n", F.col("p.chunk_idx").alias("piece"), F.col("p.chunk_start").alias("__at"), F.col("p.chunk_text").alias("__text"))
    pieces = pieces.repartition(*keys, "piece")
    found = D.detect_regex(pieces, "__text", config.rules(), out_col="__found")
    if config.ruler:
        rules = (D.RULER_RULES[:2] if config.address_patterns else []) + (D.RULER_RULES[2:] if config.id_patterns else [])
        rules = [as_unicode(r) for r in rules] if config.unicode else rules
        found = D.detect_regex(found, "__text", rules, out_col="__cues", det=D.DET_RULER).withColumn("__found", F.concat("__found", "__cues"))
    rows = explode_rows(found, F.col("__found"), [*keys, "piece", "__at", "__n"], "c")
    rows = rows.where(owned_by_chunk(F.col("c.start"), F.col("c.end"), F.col("__at"), F.col("__n"), piece, overlap))
    moved = F.struct(*[(F.col(f"c.{f}") + F.col("__at")).alias(f) if f in ("start", "end") else F.col(f"c.{f}").alias(f)
                       for f in rows.schema["c"].dataType.fieldNames()])
    # a match of the next piece's share may begin in this one: deal by where it starts
    rows = rows.select(*keys, moved.alias("c"))
    out = rows.withColumn("piece", F.floor(F.col("c.start") / (piece - overlap)).cast("int"))
    if config.min_confidence is not None:
        out = out.where(F.col("c.confidence") >= config.min_confidence)
    return out


def with_islands(cands: DataFrame, keys: list[str]) -> DataFrame:
    """Candidates with the start of their island, by running maxima that never
    gather a document: within pieces, then over one row per piece."""
    span = [F.col("c.start"), F.col("c.end").desc(), F.col("c.det"), F.col("c.rule")]
    inside = Window.partitionBy(*keys, "piece").orderBy(*span)
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*keys).orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0)
    reach = cands.groupBy(*keys, "piece").agg(F.max("c.end").alias("__end"))
    reach = reach.select(*keys, "piece", F.coalesce(F.max("__end").over(earlier), zero).alias("__reach"))
    x = cands.join(reach, [*keys, "piece"])
    x = x.withColumn("__before", F.greatest("__reach", F.coalesce(F.max("c.end").over(before), zero)))
    begins = F.when(F.col("c.start") >= F.col("__before"), F.col("c.start"))
    x = x.withColumn("__begins", begins).withColumn("__island", F.max("__begins").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    last = x.groupBy(*keys, "piece").agg(F.max("__begins").alias("__last"))
    last = last.select(*keys, "piece", F.max("__last").over(earlier).alias("__carried"))
    return x.join(last, [*keys, "piece"]).select(*keys, "c", F.coalesce("__island", "__carried").alias("island"))


def scan_in_pieces(df: DataFrame, keys: list[str], text_col: str = "text", config: ScanConfig | None = None,
                   piece: int = PIECE, overlap: int = OVERLAP) -> DataFrame:
    """Span rows (``keys``, start, end, text, type, confidence), the spans that
    ``scan`` finds in the undivided texts.  ``keys`` name a document."""
    # the islands read the candidates three times: found once, under the shared folder
    found = materialize(piece_candidates(df, keys, text_col, config, piece, overlap), "pieces")
    cands = with_islands(found, keys)
    groups = cands.groupBy(*keys, "island").agg(F.collect_list("c").alias("__c"))
    ruler = F.filter("__c", lambda c: c["det"] == D.DET_RULER)
    others = F.filter("__c", lambda c: c["det"] != D.DET_RULER)
    resolved = F.when(F.size(ruler) > 1, D.longest_first(ruler)).otherwise(ruler)
    groups = groups.withColumn("__resolved", F.concat(others, resolved)).withColumn("spans", merge_spans(F.col("__resolved")))
    x = explode_rows(groups, F.col("spans"), keys, "s")
    return x.select(*keys, "s.start", "s.end", "s.text", "s.type", "s.confidence")
