"""Sinks (K1-K5).  Every writer is a distributed DataFrame write: many part
files, no single task assembling the whole output."""

from __future__ import annotations

import hashlib
import posixpath
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.findings import report_header, report_rows, review_queue, scan_summary
from ..functions.actions import mask_by_type
from .files import open_tree

#: File systems on which an object appears whole when its stream is closed.
WHOLE_OBJECTS = ("s3", "gcs", "abfs")
MANIFEST = "rel_path string, status string, n_bytes long, sha256 string, attempt long"


def _safe(rel: str | None) -> bool:
    """Whether a relative path stays below the root and names a file."""
    return bool(rel) and not rel.startswith("/") and rel == posixpath.normpath(rel) and rel.split("/")[0] not in ("..", ".") and "\0" not in rel


def _file_writer(out: str, job: str):
    """Tasks that write one file per row: under a name of the attempt first,
    then renamed, so a file is never seen half written and an attempt that runs
    again puts the same bytes in its place."""
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = open_tree(out)
        attempt = TaskContext.get().taskAttemptId()
        spare, made = f"{base}.{job}/{attempt}", set()

        def put(path: str, data: bytes) -> None:
            folder = path.rsplit("/", 1)[0]
            if folder not in made:
                system.create_dir(folder, recursive=True)
                made.add(folder)
            with system.open_output_stream(path) as f:
                f.write(data)
        for batch in batches:
            rows = []
            for n, (rel, text) in enumerate(zip(*(batch.column(i).to_pylist() for i in (0, 1)))):
                if text is None or not _safe(rel):
                    rows.append((rel, "skipped" if text is None else "refused", None, None, attempt))
                    continue
                data, path = text.encode(), f"{base}/{rel}"
                if system.type_name in WHOLE_OBJECTS:
                    put(path, data)
                else:
                    put(f"{spare}/{n}", data)
                    folder = path.rsplit("/", 1)[0]
                    if folder not in made:
                        system.create_dir(folder, recursive=True)
                        made.add(folder)
                    system.move(f"{spare}/{n}", path)
                rows.append((rel, "written", len(data), hashlib.sha256(data).hexdigest(), attempt))
            if rows:
                kinds = (pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)],
                                                 ["rel_path", "status", "n_bytes", "sha256", "attempt"])
    return write


def write_files(df: DataFrame, out: str, key_col: str = "rel_path", text_col: str = "sanitized") -> DataFrame:
    """K1: one file per input below ``out``, at the input's relative path, in
    UTF-8.  Returns the manifest, also written beside the tree as
    ``<out>.manifest`` by Spark's own commit, so it lists the attempts that
    succeeded and nothing else: ``written``, ``skipped`` (no text to write) or
    ``refused`` (a path that is empty or leads out of ``out``).

    Paths must be unique; repeated ones are an error before anything is
    written.  A task that fails or runs twice renames the same bytes over its
    own files.
    """
    x = df.select(F.col(key_col).cast("string").alias("rel_path"), F.col(text_col).cast("string").alias("text"))
    again = [r[0] for r in x.where("rel_path IS NOT NULL").groupBy("rel_path").count().where("count > 1").limit(3).collect()]
    if again:
        raise ValueError(f"several inputs have one relative path: {again}")
    job = f"writing-{uuid.uuid4().hex}"
    manifest = f"{out.rstrip('/')}.manifest"
    try:
        x.mapInArrow(_file_writer(out.rstrip("/"), job), MANIFEST).write.mode("overwrite").parquet(manifest)
    finally:
        system, base = open_tree(out.rstrip("/"))
        if system.get_file_info(f"{base}.{job}").type.name == "Directory":
            system.delete_dir(f"{base}.{job}")
    return df.sparkSession.read.schema(MANIFEST).parquet(manifest)


def write_mirror(df: DataFrame, out: str, key_col: str = "rel_path", text_col: str = "sanitized",
                 fmt: str = "parquet", partition_top_dir: bool = True) -> None:
    """K1: one output row per input document (documents without findings
    included), keyed by relative path; partitioned by top directory."""
    x = df.select(F.col(key_col).alias("rel_path"), F.col(text_col).alias("text"))
    w = x.write.mode("overwrite")
    if partition_top_dir:
        x = x.withColumn("top_dir", F.when(F.instr("rel_path", "/") > 0, F.substring_index("rel_path", "/", 1))
                         .otherwise(F.lit(".")))
        w = x.write.mode("overwrite").partitionBy("top_dir")
    w.format(fmt).save(out)


def findings_table(df: DataFrame, keys: list[str], raw_values: bool = False) -> DataFrame:
    """K2 rows: documents with at least one span, spans in text order.  Values
    are masked unless ``raw_values``."""
    val = (lambda s: s["text"]) if raw_values else (lambda s: mask_by_type(s["type"], s["text"]))
    spans = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"),
                                                    s["type"].alias("type"), s["confidence"].alias("confidence"),
                                                    val(s).alias("value")))
    from ..functions.spans import filter_computed
    return filter_computed(df, F.size("spans") > 0, [*[F.col(k) for k in keys], spans.alias("spans")])


def write_findings(df: DataFrame, out: str, keys: list[str], raw_values: bool = False) -> None:
    findings_table(df, keys, raw_values).write.mode("overwrite").json(out)


def write_report(df: DataFrame, out: str, title_col: str, raw_values: bool = False) -> None:
    """K3: HTML fragments, one block per document with findings, plus the
    header with the totals in ``out/header``.  Values are masked unless
    ``raw_values``, as in the other outputs."""
    report_header(scan_summary(df)).write.mode("overwrite").text(f"{out.rstrip('/')}/header")
    report_rows(df, title_col, raw_values=raw_values).select("html").write.mode("overwrite").text(f"{out.rstrip('/')}/files")


def write_review_queue(df: DataFrame, out: str, keys: list[str], threshold: float = 0.8) -> None:
    """K4: JSON lines of low-confidence detections."""
    review_queue(df, keys, threshold).write.mode("overwrite").json(out)


def append_job_log(log: DataFrame, out: str) -> None:
    """K5: append rows to the job log table."""
    log.write.mode("append").parquet(out)
