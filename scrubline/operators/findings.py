"""Findings, summaries and report rows derived from scanned rows.

Per-document outputs (findings, report rows, job log) are narrow
projections of the scanned rows.  Corpus-wide rollups use ``groupBy`` with
partial (map-side) aggregation, so each task ships one small row per key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.actions import mask_by_type
from ..functions.spans import explode_rows, filter_computed


def span_rows(df: DataFrame, keys: list[str], spans_col: str = "spans",
              fields: tuple[str, ...] = ("start", "end", "text", "type", "confidence")) -> DataFrame:
    """One row per span with its position ``idx`` (0-based) in the list."""
    x = explode_rows(df, F.col(spans_col), keys, "s", with_pos=True)
    extra = [F.col(f"s.{f}").alias(f) for f in fields]
    if "action" in x.schema["s"].dataType.fieldNames():
        extra += [F.col("s.action").alias("action"), F.col("s.repl").alias("replacement")]
    return x.select(*keys, "idx", *extra)


def findings_by_document(df: DataFrame, keys: list[str], spans_col: str = "spans") -> DataFrame:
    """Only documents with at least one span, spans in text order."""
    s = F.col(spans_col)
    listing = F.array_join(F.transform(s, lambda x: F.concat(x["type"], F.lit("@"), x["start"].cast("string"),
                                                             F.lit("-"), x["end"].cast("string"))), ";")
    return filter_computed(df, F.size(s) > 0, [*[F.col(k) for k in keys], F.size(s).cast("long").alias("n_spans"),
                                               listing.alias("spans")])


def scan_summary(df: DataFrame, spans_col: str = "spans") -> DataFrame:
    """G1: files visited and entities found."""
    return df.agg(F.count(F.lit(1)).alias("files"),
                  F.coalesce(F.sum(F.size(spans_col)), F.lit(0)).cast("long").alias("entities"))


def type_counts(df: DataFrame, spans_col: str = "spans") -> DataFrame:
    """Entities per type with detected and acted-upon (action <> none) counts."""
    x = explode_rows(df, F.col(spans_col), [], "s")
    has_action = "action" in x.schema["s"].dataType.fieldNames()
    redacted = (F.count_if(F.col("s.action") != "none") if has_action else F.count(F.lit(1)))
    return x.groupBy(F.col("s.type").alias("type")).agg(F.count(F.lit(1)).alias("detected"),
                                                         redacted.cast("long").alias("redacted"))


def review_queue(df: DataFrame, keys: list[str], threshold: float = 0.8, spans_col: str = "spans") -> DataFrame:
    """K4: detections below ``threshold`` for triage.  The raw value is not
    written; a type-aware mask of it is."""
    x = span_rows(df, keys, spans_col).where(F.col("confidence") < F.lit(threshold))
    return x.select(*keys, F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"),
                    "type", "confidence", mask_by_type(F.col("type"), F.col("text")).alias("preview"))


def html_escape(c: Column) -> Column:
    """Escape & < > " ' for HTML text."""
    out = F.replace(c, F.lit("&"), F.lit("&amp;"))
    for a, b in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def report_rows(df: DataFrame, title_col: str, spans_col: str = "spans", raw_values: bool = True) -> DataFrame:
    """K3: one HTML block per document with findings: the title, then one
    list item ``<code>TYPE</code> — text`` per span, values escaped, or masked
    by their type without ``raw_values``."""
    value = (lambda s: s["text"]) if raw_values else (lambda s: mask_by_type(s["type"], s["text"]))
    # The report's markup, here and in the header.
    items = F.array_join(F.transform(F.col(spans_col), lambda s: F.concat(
        F.lit("<li><code>"), html_escape(s["type"]), F.lit("</code> — "), html_escape(value(s)), F.lit("</li>"))), "")
    block = F.concat(F.lit('<div class="file"><h3>'), html_escape(F.col(title_col).cast("string")),
                     F.lit("</h3><ul>"), items, F.lit("</ul></div>"))
    return filter_computed(df, F.size(spans_col) > 0, [F.col(title_col).alias("title"), block.alias("html")])


def report_header(summary: DataFrame) -> DataFrame:
    """K3 header badges from a ``scan_summary`` row."""
    return summary.select(F.concat(F.lit('<p><span class="badge">'), F.col("files").cast("string"),
                                   F.lit(' files</span> <span class="badge">'), F.col("entities").cast("string"),
                                   F.lit(" entities</span></p>")).alias("html"))


def job_log(df: DataFrame, keys: list[str], text_col: str = "text", spans_col: str = "spans",
            seconds: Column | None = None, created_at: Column | None = None, file_type: Column | None = None,
            prompt: Column | None = None) -> DataFrame:
    """One row per document, failed where there is no text to process.
    Time, type and prompt are logged where the caller gives them."""
    s = F.coalesce(F.col(spans_col), F.array().cast(df.schema[spans_col].dataType))
    given = {"processing_time_seconds": seconds, "created_at": created_at, "file_type": file_type, "prompt": prompt}
    return df.select(*keys, F.length(text_col).cast("long").alias("n_chars"),
                     F.octet_length(text_col).cast("long").alias("n_bytes"),
                     F.size(s).cast("long").alias("entities_detected"),
                     F.size(F.filter(s, lambda x: x["action"] != "none")).cast("long").alias("entities_redacted"),
                     F.when(F.col(text_col).isNull(), F.lit("failed")).otherwise(F.lit("completed")).alias("status"),
                     *[c.alias(n) for n, c in given.items() if c is not None])
