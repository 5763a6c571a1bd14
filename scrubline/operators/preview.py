"""Previews and redaction geometry (W1-W4), per document row.

Box geometry follows the page layout of the text renderer: line ``i`` sits
at ``y = 0.95 - 0.03 i`` and column ``j`` at ``x = 0.05 + 0.008 j``; a
redacted character is a box ``(x, y - 0.01)`` of width 0.008 and height 0.024.
We emit one box per run of redacted characters on a line (span x line), which
covers the same area as the per-character boxes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.spans import TEXT_BLOCK, explode_rows, let, prefix_max, prefix_sums, slice_blocks, text_blocks
from .rewrite import preview_blocks, wrap_fixed  # noqa: F401  (re-exported)

# Layout constants of the text renderer.
LEFT_X = 0.05
TOP_Y = 0.95
LINE_HEIGHT = 0.03
CHAR_WIDTH = 0.008
BOX_DY = 0.01
BOX_HEIGHT_FACTOR = 0.8
SUPPORTED_FILE_TYPES = ("txt",)


def span_line_segments(text: Column, spans: Column) -> Column:
    """array<struct<span_idx, line, col, n>>: each span cut at newlines.

    The line of a span start is the number of newlines before it, its column
    the distance from the last newline; later pieces start at column 0.
    Newline characters themselves are not drawn.
    """
    def lines(part):
        return F.length(part) - F.length(F.replace(part, F.lit("\n"), F.lit("")))

    def build(blocks):
        def with_lines(before):
            def with_last(last):
                def per_span(s, i):
                    b = F.floor(s["start"] / TEXT_BLOCK).cast("int")
                    head = F.substr(F.coalesce(F.get(blocks, b), F.lit("")), F.lit(1), s["start"] - b * TEXT_BLOCK)
                    line0 = F.coalesce(F.get(before, b - 1), F.lit(0)) + lines(head)
                    # ``last``: the characters up to the last newline of all blocks before
                    col0 = F.when(lines(head) > 0, F.length(F.substring_index(head, "\n", -1))).otherwise(
                        s["start"] - F.coalesce(F.get(last, b - 1), F.lit(0)))
                    parts = F.split(slice_blocks(blocks, s["start"], s["end"]), "\n", -1)
                    return F.transform(parts, lambda part, k: F.struct(
                        i.alias("span_idx"), (line0 + k).alias("line"),
                        F.when(k == 0, col0).otherwise(F.lit(0)).alias("col"), F.length(part).alias("n")))
                return F.flatten(F.transform(spans, per_span))
            return let(prefix_max(F.transform(blocks, lambda p, k: F.when(
                lines(p) > 0, k * TEXT_BLOCK + F.length(p) - F.length(F.substring_index(p, "\n", -1))).otherwise(F.lit(0)))), with_last)
        return let(prefix_sums(F.transform(blocks, lines)), with_lines)
    segs = F.when(F.coalesce(F.size(spans), F.lit(0)) > 0, let(text_blocks(text), build))
    return F.filter(F.coalesce(segs, F.array().cast("array<struct<span_idx:int,line:int,col:int,n:int>>")), lambda g: g["n"] > 0)


def redaction_boxes(df: DataFrame, keys: list[str], text_col: str = "text", spans_col: str = "spans") -> DataFrame:
    """One row per span x line run with its box corners."""
    x = df.withColumn("__seg", span_line_segments(F.col(text_col), F.col(spans_col)))
    x = explode_rows(x, F.col("__seg"), keys, "g")
    line, col, n = F.col("g.line"), F.col("g.col"), F.col("g.n")
    y = F.lit(TOP_Y) - F.lit(LINE_HEIGHT) * line
    x0 = F.lit(LEFT_X) + F.lit(CHAR_WIDTH) * col
    return x.select(*keys, F.col("g.span_idx").cast("long").alias("span_idx"), line.cast("long").alias("line"),
                    col.cast("long").alias("col"), n.cast("long").alias("n_chars"),
                    F.round(x0, 6).alias("x0"), F.round(y - F.lit(BOX_DY), 6).alias("y0"),
                    F.round(x0 + F.lit(CHAR_WIDTH) * n, 6).alias("x1"),
                    F.round(y - F.lit(BOX_DY) + F.lit(LINE_HEIGHT * BOX_HEIGHT_FACTOR), 6).alias("y1"))


def redaction_result(file_type: Column, spans: Column) -> Column:
    """Success and redacted count, or a failure for unsupported types."""
    ok = F.lower(file_type).isin(*SUPPORTED_FILE_TYPES)
    msg = F.concat(F.lit("Unsupported file type: "), file_type, F.lit(". Currently only 'txt' is supported."))
    return F.struct(ok.alias("success"), F.when(ok, F.size(spans)).otherwise(F.lit(0)).cast("long").alias("redacted_count"),
                    F.when(ok, F.lit("")).otherwise(msg).alias("error_message"))


def chunk_text(text: Column, window: int = 2000, overlap: int = 200) -> Column:
    """Overlapping windows ``array<struct<chunk_idx, chunk_start, chunk_text>>``;
    offsets found in a chunk are rebased by ``chunk_start``."""
    step = window - overlap

    def windows(blocks: Column, n: Column) -> Column:
        starts = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(step))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda s, i: F.struct(
            i.alias("chunk_idx"), s.alias("chunk_start"), slice_blocks(blocks, s, F.least(s + window, n)).alias("chunk_text")))
    # the length is taken once: it walks the whole text, which each window would do again
    return let(F.length(text), lambda n: let(text_blocks(text), lambda blocks: windows(blocks, n)))


def owned_by_chunk(start: Column, end: Column, chunk_start: Column, text_len: Column, window: int = 2000,
                   overlap: int = 200) -> Column:
    """Whether a match (offsets within its window) counts there.

    Each start belongs to one window, the one that holds at least half an
    overlap around it, and a match that touches a cut end may be only a part
    and does not count.  What the window of its start cuts counts in the next
    one, unless it touches the beginning there.  So matches shorter than an
    overlap are found once and whole, as in the undivided text."""
    first, last = chunk_start == 0, chunk_start + window >= text_len
    needed = first | (chunk_start + overlap < text_len)  # else the window before reaches the end of the text
    cut_before = (start > 0) & (end >= overlap)  # the window before ends within it
    return (needed & (first | (start >= overlap // 2) | cut_before)
            & (last | ((start < window - overlap // 2) & (end < window))))


def cost_estimate(text: Column, prompt: Column | None = None) -> Column:
    """((len(text + prompt) // 4) + 500) / 1000 * 0.0001."""
    n = F.length(text) + (F.length(prompt) if prompt is not None else F.lit(0))
    tokens = F.floor(n / 4) + 500
    return (tokens / 1000.0) * 0.0001
