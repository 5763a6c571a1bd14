"""Structured Streaming use of the same transforms.

Scrubbing is per row, so a stream of documents is scrubbed by exactly the
batch plan.  Admission keeps state per user and month and decides in event
time; its decisions go to the usage log batch by batch.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState

from ..operators.policy import Policy
from ..operators.usage import judged
from ..plans.scan import ScanConfig, scrub
from ..plans.usage_log import UsageLog

DOC_SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])


def document_stream(spark: SparkSession, path: str, schema: T.StructType = DOC_SCHEMA,
                    max_files_per_trigger: int | None = None) -> DataFrame:
    r = spark.readStream.schema(schema)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.parquet(path)


def scrub_stream(docs: DataFrame, salt: str, policy: Policy | None = None,
                 config: ScanConfig | None = None) -> DataFrame:
    """Streaming DataFrame of ``(doc_id, sanitized, n_spans)``."""
    out = scrub(docs, salt=salt, policy=policy, config=config)
    return out.select("doc_id", "sanitized", F.size("spans").alias("n_spans"))


#: What a request's decision says, and what the usage log sums.
DECISION = ("job_id long, user_id long, month string, created_at timestamp, status string, file_size_bytes long, entities_detected long, "
            "processing_time_seconds double, count_before long, reason string, admitted boolean, charged boolean")
_HELD = ["created_at", "job_id", "status", "file_size_bytes", "entities_detected", "processing_time_seconds", "monthly_limit", "size_ok",
         "type_ok", "eligible"]
_STATE = "eligible long, held binary"


def _decide(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Decisions of one user's month, in event-time order: rows wait in the
    state until the watermark has passed them, so nothing before them can come."""
    seen, held = (state.get[0], pickle.loads(state.get[1])) if state.exists else (0, [])
    for frame in rows:
        held += list(frame[_HELD].itertuples(index=False, name=None))
    mark = pd.Timestamp(max(0, state.getCurrentWatermarkMs()), unit="ms")
    held.sort(key=lambda r: (r[0], r[1]))
    out = []
    ready = [r for r in held if r[0] <= mark]
    for at, job, status, size, found, seconds, limit, size_ok, type_ok, eligible in ready:
        before = min(limit, seen)
        reason = "monthly_limit" if before >= limit else "file_size" if not size_ok else "file_type" if not type_ok else "ok"
        out.append((job, key[0], key[1], at, status, size, found, seconds, before, reason, reason == "ok", reason == "ok" and eligible == 1))
        seen += int(eligible)
    held = held[len(ready):]
    state.update((seen, pickle.dumps(held)))
    if held:
        state.setTimeoutTimestamp(int(held[0][0].ceil("ms").value // 1_000_000))
    if out:
        frame = pd.DataFrame(out, columns=[f.split()[0] for f in DECISION.split(", ")])
        yield frame.astype({"user_id": "Int64", "file_size_bytes": "Int64", "entities_detected": "Int64"})


def admission_stream(jobs: DataFrame, users: DataFrame, watermark: str = "1 day") -> DataFrame:
    """G7 + G8 on a stream of jobs: the decisions of ``operators.usage.admission``.

    State is kept per (user, month): how many eligible requests came before, and
    the requests that the watermark has not passed.  A request is decided once
    no earlier one can arrive, so decisions do not depend on the order of
    arrival; one that comes after the watermark is dropped and not decided."""
    j = judged(jobs.withWatermark("created_at", watermark), users)
    j = j.select("user_id", "month", *_HELD)
    return j.groupBy("user_id", "month").applyInPandasWithState(_decide, DECISION, _STATE, "append", "EventTimeTimeout")


def usage_log_stream(admitted: DataFrame, log: UsageLog, checkpoint: str, name: str = "stream"):
    """Keep a usage log up to date from a stream of decisions (a stream writer,
    not started).  A micro-batch that runs again replaces what it added."""
    def add(rows: DataFrame, number: int) -> None:
        log.apply(f"{name}-{number}", rows)
    return admitted.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
