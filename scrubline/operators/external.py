"""Findings supplied by an external detector (E10-E14) and span adapters.

The detector returns, per document, JSON text
``{"entities": [{"text", "type", "action", "confidence"}], "reasoning", "confidence"}``
without trustworthy offsets.  We decode it with ``from_json`` and locate
every value in its own document row:

(a) every exact occurrence of the trimmed value, overlapping allowed;
(b) only if (a) finds nothing: case-insensitive, whitespace-tolerant matches
    (non-overlapping);
(c) only if (a) and (b) find nothing, the value is longer than 10 characters
    and has at least two words: from the first word to the next occurrence of
    the last word, accepted if that slice contains the value's first and last
    10 characters;
otherwise the finding is reported as unlocated.

Document and response travel in the same row (the detector runs per
document), so locating needs no join; join them on the document key when they
live in separate tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.actions import PY_WHITESPACE
from ..functions.spans import MATCH_T, absent_mark, empty_array, explode_rows, let, marked_spans, prefix_sums
from .detect import DET_EXTERNAL

# Defaults for missing keys and the partial-match rule.
DEFAULT_TYPE = "OTHER"
DEFAULT_ACTION = "mask"
DEFAULT_CONFIDENCE = 0.8
DEFAULT_RESPONSE_CONFIDENCE = "medium"
PARTIAL_MIN_LENGTH = 10
PARTIAL_EDGE = 10

RESPONSE_SCHEMA = ("struct<entities:array<struct<text:string,type:string,action:string,confidence:string>>,"
                   "reasoning:string,confidence:string>")


def decode_response(js: Column) -> Column:
    """struct<success, entities array<struct<value,type,action,confidence>>, reasoning, confidence>.

    Text that is not JSON, an entity without ``text`` or a confidence that
    is not a number voids the whole response (no entities, success false,
    confidence low)."""
    parsed = F.from_json(js, RESPONSE_SCHEMA)
    ents = F.coalesce(parsed["entities"], F.array().cast(
        "array<struct<text:string,type:string,action:string,confidence:string>>"))
    bad_entity = F.exists(ents, lambda e: e["text"].isNull() | (
        e["confidence"].isNotNull() & e["confidence"].try_cast("double").isNull()))
    malformed = F.try_parse_json(js).isNull() | parsed.isNull()
    ok = ~malformed & ~bad_entity
    clean = F.transform(ents, lambda e: F.struct(
        e["text"].alias("value"), F.coalesce(e["type"], F.lit(DEFAULT_TYPE)).alias("type"),
        F.coalesce(e["action"], F.lit(DEFAULT_ACTION)).alias("action"),
        F.coalesce(e["confidence"].try_cast("double"), F.lit(DEFAULT_CONFIDENCE)).alias("confidence")))
    return F.struct(ok.alias("success"),
                    F.when(ok, clean).otherwise(F.array().cast(
                        "array<struct<value:string,type:string,action:string,confidence:double>>")).alias("entities"),
                    F.when(ok, F.coalesce(parsed["reasoning"], F.lit(""))).otherwise(
                        F.lit("external detector unavailable: parse error")).alias("reasoning"),
                    F.when(ok, F.coalesce(parsed["confidence"], F.lit(DEFAULT_RESPONSE_CONFIDENCE)))
                    .otherwise(F.lit("low")).alias("confidence"))


def _quote(v: Column) -> Column:
    """Java regex literal for ``v`` (\\Q...\\E, with embedded \\E escaped)."""
    return F.concat(F.lit("\\Q"), F.replace(v, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


def _trim(v: Column) -> Column:
    ws = PY_WHITESPACE
    return F.regexp_replace(v, f"^{ws}+|{ws}+$", "")


def exact_positions(text: Column, v: Column) -> Column:
    """(a): start of every occurrence, overlapping ones included, as
    array<MATCH_T>.  One zero-width lookahead split cuts the text at each
    occurrence after position 0; position 0 is tested separately.  An exact
    occurrence has the value as its text, so nothing is sliced from the
    document and the cost is linear in its length and occurrences.  Texts
    without the value's bytes are not cut (the pattern sees bytes that are no
    UTF-8 as U+FFFD, so those texts are)."""
    def found(pieces: Column, n: Column) -> Column:
        # cut positions = running sums of piece lengths, without the last piece
        cuts = prefix_sums(F.transform(F.slice(pieces, 1, F.size(pieces) - 1), lambda p: F.length(p)))
        starts = F.concat(F.when(F.startswith(text, v), F.array(F.lit(0))).otherwise(F.array().cast("array<int>")), cuts)
        return F.transform(starts, lambda s: F.struct(s.alias("start"), (s + n).alias("end"), v.alias("text")))
    pattern = F.concat(F.lit("(?="), _quote(v), F.lit(")"))
    return F.when(F.contains(text, v) | ~F.is_valid_utf8(text), let(F.split(text, pattern, -1), lambda pieces: found(
        pieces, F.length(v)))).otherwise(empty_array(MATCH_T))


def _fuzzy_pattern(v: Column) -> Column:
    """Case-insensitive, any whitespace run matches any whitespace run."""
    words = F.split(v, f"{PY_WHITESPACE}+", -1)
    body = F.array_join(F.transform(words, _quote), f"{PY_WHITESPACE}+")
    return F.concat(F.lit("(?iu)"), body)


def fuzzy_positions(text: Column, v: Column) -> Column:
    """(b): non-overlapping case-insensitive matches."""
    return let(_fuzzy_pattern(v), lambda pat: let(absent_mark(text), lambda mark: marked_spans(text, pat, mark)))


def partial_position(text: Column, v: Column) -> Column:
    """(c): first word .. next last word, checked against the value's edges."""
    edges = (F.substr(v, F.lit(1), F.lit(PARTIAL_EDGE)), F.substr(v, F.length(v) - PARTIAL_EDGE + 1, F.lit(PARTIAL_EDGE)))

    def between(words, start):
        last = F.element_at(words, -1)
        end = F.call_function("locate", last, text, start + 1) - 1 + F.length(last)
        return let(end, lambda e: let(F.substr(text, start + 1, e - start), lambda cut: F.when(
            (e >= start + F.length(last)) & (F.instr(cut, edges[0]) > 0) & (F.instr(cut, edges[1]) > 0),
            F.array(F.struct(start.alias("start"), e.alias("end"), cut.alias("text")))).otherwise(empty_array(MATCH_T))))
    return let(F.split(v, f"{PY_WHITESPACE}+", -1), lambda words: let(F.instr(text, F.element_at(words, 1)) - 1, lambda start: F.when(
        (F.length(v) > PARTIAL_MIN_LENGTH) & (F.size(words) > 1) & (start >= 0), between(words, start)).otherwise(empty_array(MATCH_T))))


def locate(text: Column, value: Column) -> Column:
    """E11-E13 for one value: array<struct<start,end,text,method>>.
    Each fallback is only evaluated when the previous one found nothing."""
    out_t = "array<struct<start:int,end:int,text:string,method:string>>"

    def tag(arr, m):
        return F.transform(arr, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"),
                                                   s["text"].alias("text"), F.lit(m).alias("method")))

    def found(v):
        return (F.when(F.length(v) == 0, F.array().cast(out_t))
                .otherwise(let(exact_positions(text, v), lambda a: F.when(F.size(a) > 0, tag(a, "exact")).otherwise(
                    let(fuzzy_positions(text, v), lambda b: F.when(F.size(b) > 0, tag(b, "fuzzy")).otherwise(
                        tag(partial_position(text, v), "partial")))))))
    return let(_trim(value), found)


def locate_findings(df: DataFrame, text_col: str = "text", response_col: str = "response") -> DataFrame:
    """Add ``ext`` (decoded response) and ``located``: per entity, its value,
    type, action, confidence and the spans where it was found."""
    df = df.withColumn("ext", decode_response(F.col(response_col)))
    text = F.col(text_col)
    return df.withColumn("located", F.transform(F.col("ext.entities"), lambda e: F.struct(
        e["value"].alias("value"), e["type"].alias("type"), e["action"].alias("action"),
        e["confidence"].alias("confidence"), locate(text, e["value"]).alias("spans"))))


def finding_candidates(located: Column) -> Column:
    """Located findings as merge candidates (detector rank: external).  Each
    keeps its finding's action, which goes before the policy's."""
    per = F.transform(located, lambda e, i: F.transform(e["spans"], lambda s: F.struct(
        s["start"].alias("start"), s["end"].alias("end"), s["text"].alias("text"), e["type"].alias("type"),
        e["confidence"].alias("confidence"), F.lit(DET_EXTERNAL).alias("det"), i.alias("rule"),
        e["action"].alias("own_action"))))
    return F.flatten(per)


def located_rows(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row per located occurrence."""
    ents = explode_rows(df, F.col("located"), keys, "e", with_pos=True)
    x = explode_rows(ents.select(*keys, "idx", "e"), F.col("e.spans"), keys + ["idx", "e"], "s")
    return x.select(*keys, F.col("idx").cast("long").alias("entity_idx"), F.col("s.start").cast("long").alias("start"),
                    F.col("s.end").cast("long").alias("end"), F.col("s.text").alias("text"),
                    F.col("e.type").alias("entity_type"), F.col("e.action").alias("action"),
                    F.col("e.confidence").alias("confidence"), F.col("s.method").alias("method"))


def unlocated_rows(df: DataFrame, keys: list[str]) -> DataFrame:
    """Findings whose value was not found."""
    ents = explode_rows(df, F.col("located"), keys, "e", with_pos=True)
    return ents.where(F.size("e.spans") == 0).select(
        *keys, F.col("idx").cast("long").alias("entity_idx"), F.col("e.value").alias("value"),
        F.col("e.type").alias("entity_type"))


# Span adapter.  Accepts span tables with or without ``confidence``
# (missing -> 0.99) and unions them by column name.
ADAPTER_DEFAULT_CONFIDENCE = 0.99


def union_spans(*dfs: DataFrame) -> DataFrame:
    cols = ["start", "end", "text", "type", "confidence"]
    out = None
    for d in dfs:
        if "confidence" not in d.columns:
            d = d.withColumn("confidence", F.lit(None).cast("double"))
        keep = [c for c in d.columns if c not in cols] + cols
        d = d.select(*keep).withColumn("start", F.col("start").cast("int")).withColumn("end", F.col("end").cast("int"))
        out = d if out is None else out.unionByName(d, allowMissingColumns=True)
    return out.withColumn("confidence", F.coalesce(F.col("confidence").cast("double"),
                                                   F.lit(ADAPTER_DEFAULT_CONFIDENCE)))
