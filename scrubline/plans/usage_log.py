"""The daily usage log, kept up to date batch by batch.

Two tables below one folder, both partitioned by day:

``ledger``  what each batch adds per (day, user), one partition per (day, batch)
``daily``   the log itself: totals per (day, user), one partition per day

A batch first replaces its own partitions of the ledger, then the days that it
touches, or touched when it came before, are summed anew from the ledger and
replaced in the log.  Both writes overwrite whole partitions, so a batch that is
delivered twice, or again with other rows, leaves the log as if it had been
delivered once; a run that stops between the writes is mended by running the
batch again.  The work of a batch grows with the days it touches, not with the
log.  Batches of one log are applied one after the other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Sums of a day's usage, each from a column of the admitted requests.
MEASURES = {"documents_processed": "1", "total_file_size_bytes": "file_size_bytes", "total_entities_detected": "entities_detected",
            "total_entities_redacted": "entities_detected", "total_processing_time_seconds": "processing_time_seconds"}

LEDGER = ("user_id long, documents_processed long, total_file_size_bytes long, total_entities_detected long, "
          "total_entities_redacted long, total_processing_time_seconds double, void boolean, date string")


class UsageLog:
    """A usage log in ``root`` (a folder that driver and executors share)."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _read(self, table: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.root}/{table}")

    def _write(self, rows: DataFrame, table: str, *partitions: str) -> None:
        # one file per small partition, large ones split (adaptive execution)
        (rows.hint("rebalance", *partitions).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy(*partitions).parquet(f"{self.root}/{table}"))

    def _empty(self, days: list[str]) -> DataFrame:
        """A void row per day: it makes a partition that has lost all its rows be replaced too."""
        return self.spark.createDataFrame([(d,) for d in days], "date string").select(
            *[F.lit(None).cast(t).alias(n) for n, t in (f.split() for f in LEDGER.split(", ")) if n not in ("void", "date")],
            F.lit(True).alias("void"), "date")

    def _exists(self, table: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{table}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def apply(self, batch: str, admitted: DataFrame) -> list[str]:
        """Add a batch of admitted requests, or replace what it added before.
        Returns the days that changed."""
        used = admitted.where(F.col("admitted") & (F.col("status") == "completed"))
        sums = [F.sum(F.expr(column)).cast("double" if "seconds" in name else "long").alias(name) for name, column in MEASURES.items()]
        rows = used.groupBy("user_id", F.date_format("created_at", "yyyy-MM-dd").alias("date")).agg(*sums)
        rows = rows.select(*[n for n in (f.split()[0] for f in LEDGER.split(", ")) if n not in ("void", "date")], F.lit(False).alias("void"), "date")
        ledger = LEDGER + ", batch string"
        before = []
        if self._exists("ledger"):
            mine = self._read("ledger", ledger).where(F.col("batch") == batch)
            before = [r[0] for r in mine.select("date").distinct().collect()]
        self._write(rows.unionByName(self._empty(before)).withColumn("batch", F.lit(batch)), "ledger", "date", "batch")
        now = self._read("ledger", ledger)
        days = sorted({r[0] for r in now.where(F.col("batch") == batch).select("date").distinct().collect()} | set(before))
        if days:
            touched = now.where(F.col("date").isin(days) & ~F.col("void"))
            totals = touched.groupBy("user_id", "date").agg(*[F.sum(n).alias(n) for n in MEASURES]).withColumn("void", F.lit(False))
            self._write(totals.select(*[f.split()[0] for f in LEDGER.split(", ")]).unionByName(self._empty(days)), "daily", "date")
        return days

    def daily(self) -> DataFrame:
        """The log, one row per (user, day)."""
        if not self._exists("daily"):
            return self.spark.createDataFrame([], LEDGER).drop("void")
        rows = self._read("daily", LEDGER).where("NOT void").drop("void")
        return rows.withColumn("total_processing_time_seconds", F.round("total_processing_time_seconds", 6))

    def monthly(self) -> DataFrame:
        """Documents per (user, month)."""
        month: Column = F.substr("date", F.lit(1), F.lit(7)).alias("month")
        return self.daily().groupBy("user_id", month).agg(F.sum("documents_processed").alias("documents_processed"))
