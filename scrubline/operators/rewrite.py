"""Rewriting text from disjoint spans (A11) and block previews.

The output is assembled left to right from pieces -- the gap before each span
plus its replacement -- with one ``transform`` and ``array_join``, which is
linear in the text length: pieces are cut from blocks of the text, since a
``substr`` of the whole text walks from its beginning every time.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.actions import replacement
from ..functions.spans import let, slice_blocks, text_blocks
from .policy import action_for


def with_actions(spans: Column, pmap: Column, mode: str | None = None) -> Column:
    """Add ``action`` to every span, for rollups that need no replacement."""
    return F.transform(spans, lambda s: F.struct(
        *[s[f].alias(f) for f in ("start", "end", "text", "type", "confidence")],
        action_for(s["type"], pmap, mode, s["own_action"]).alias("action")))


def with_replacements(spans: Column, pmap: Column, salt: str, mode: str | None = None) -> Column:
    """Add ``action`` and ``repl`` (NULL = keep) to every span."""
    def add(s):
        a = action_for(s["type"], pmap, mode, s["own_action"])
        return F.struct(*[s[f].alias(f) for f in ("start", "end", "text", "type", "confidence", "det", "rule")],
                        a.alias("action"), replacement(s["type"], s["text"], a, salt).alias("repl"))
    return F.transform(spans, add)


def _spliced(text: Column, spans: Column, fill) -> Column:
    """Text with ``fill(span, blocks)`` in place of each span (in start order),
    gaps kept; the text itself where there are no spans."""
    def build(blocks):
        def piece(s, i):
            prev_end = F.when(i == 0, F.lit(0)).otherwise(F.element_at(spans, i)["end"])
            return F.concat(slice_blocks(blocks, prev_end, s["start"]), fill(s, blocks))
        tail = slice_blocks(blocks, F.element_at(spans, -1)["end"], F.length(text))
        return F.concat(F.array_join(F.transform(spans, piece), ""), tail)
    return F.when(F.coalesce(F.size(spans), F.lit(0)) <= 0, text).otherwise(let(text_blocks(text), build))


def rewrite(text: Column, spans: Column) -> Column:
    """Apply ``repl`` of disjoint, start-ordered spans; NULL keeps the slice."""
    return _spliced(text, spans, lambda s, blocks: F.coalesce(s["repl"], slice_blocks(blocks, s["start"], s["end"])))


BLOCK = "█"


def preview_blocks(text: Column, spans: Column) -> Column:
    """Every span becomes a run of block characters of its length.

    Spans are taken in start order (ties keep their given order); the text
    between the previous span's end and this start is kept, so overlapping
    spans repeat blocks, as in the original preview.
    """
    ordered = F.array_sort(F.transform(spans, lambda s, i: F.struct(s["start"].alias("start"),
                                                                    s["end"].alias("end"), i.alias("i"))),
                           lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"])
                           .otherwise(a["i"] - b["i"]))

    return _spliced(text, ordered, lambda s, blocks: F.repeat(F.lit(BLOCK), F.greatest(s["end"] - s["start"], F.lit(0))))


def wrap_fixed(text: Column, max_width: int = 80) -> Column:
    """If longer than ``max_width``, cut every ``max_width`` characters
    and join with newlines (existing newlines are ordinary characters)."""
    cut = F.array_join(F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % max_width), 0), "\n")
    return F.when(F.length(text) > max_width, cut).otherwise(text)
