"""Exact dedup against a persistent digest index.

The index is a Parquet table bucketed and sorted by the SHA-256 of the
normalised text, one row per distinct text ever seen.  A new batch is reduced
to one winner per digest, the winners are anti-joined with the index by a
sort-merge join that reads the index as it lies (no exchange on its side), and
those not found are appended.

Defined results: a null text is an empty one (all empty texts are copies of
each other); ties of length go to the smallest id, a null id last; rows with
the same id and text all name that id and are all kept; an empty batch adds
nothing.  Adding a batch twice changes no decision: its winners are found in
the index under their own ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import compact, group_rows, shared_path, write_table

#: White space that two equal texts may differ in: ``[\x20\x09-\x0D]``.
SPACES = (" ", "\t", "\n", "\x0b", "\x0c", "\r")


class DigestIndex:
    """The index table ``name`` at ``path``.  With a persistent metastore the
    table outlives the session; otherwise opening it again by name and path
    registers the files that are already there."""

    def __init__(self, spark: SparkSession, name: str, path: str, buckets: int = 64):
        self.spark, self.name, self.path, self.buckets = spark, name, path, buckets
        quoted = path.replace("'", "\\'")
        spark.sql(f"CREATE TABLE IF NOT EXISTS {name} (digest STRING, keep_id BIGINT) USING parquet "
                  f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{quoted}'")

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def append(self, winners: DataFrame) -> None:
        """Append rows (digest, keep_id) whose digest the index lacks: each
        bucket is dealt to one task, so a batch adds one sorted file to it."""
        bucket = F.pmod(F.hash("digest"), F.lit(self.buckets))
        fresh = winners.join(self.table().hint("merge"), "digest", "left_anti")
        (fresh.select("digest", "keep_id").repartition(self.buckets, bucket).sortWithinPartitions("digest")
         .write.format("parquet").mode("append").bucketBy(self.buckets, "digest").sortBy("digest")
         .option("path", self.path).saveAsTable(self.name))


def digest_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_code_points, text_sha256)`` per row; ``text_sha256`` is of
    the text without white space, in UTF-8."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    bare = text
    for c in SPACES:
        bare = F.replace(bare, F.lit(c), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.length(text).cast("long").alias("n_code_points"),
                       F.sha2(bare, 256).alias("text_sha256"))


def dedup_batch(docs: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Deduplicate a batch against the index and itself, and add it.

    One row per row of ``docs``: doc_id, keep_id (the row that stays: the one
    in the index if the text is there, else the batch's longest, then smallest
    id), group_size (rows of this batch with that text), kept, text_sha256.
    """
    rows = write_table(digest_rows(docs, id_col, text_col), "digests", docs)
    best = F.struct("n_code_points", (-F.col("doc_id")).alias("neg_id"))
    rows = group_rows(rows, ["text_sha256"], F.xxhash64("doc_id"),
                      [("__best", "max", best), ("group_size", "sum", F.lit(1).cast("long"))])
    rows = write_table(rows.withColumn("__own", -F.col("__best.neg_id")).drop("__best"), "digest-groups", docs)
    index.append(rows.groupBy(F.col("text_sha256").alias("digest")).agg(F.max("__own").alias("keep_id")))

    # Every digest is in the index now.  Rows of large groups are spread over
    # salts; the index rows they need are few, one per (digest, salt) present.
    salt = F.when(F.col("group_size") > 64, F.pmod(F.xxhash64("doc_id"), F.lit(64))).otherwise(F.lit(0)).cast("int")
    rows = rows.withColumn("__salt", salt)
    needed = rows.select(F.col("text_sha256").alias("digest"), "__salt").distinct()
    found = needed.join(index.table().hint("merge"), "digest").withColumnRenamed("digest", "text_sha256")
    kept = F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("doc_id").isNull() & F.col("keep_id").isNull())
    out = rows.join(found, ["text_sha256", "__salt"]).select(
        "doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256")
    return compact(out, docs)


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact copies among all documents, with a new index."""
    path = shared_path(spark, "digest-index")
    index = DigestIndex(spark, f"digest_index_{path.rsplit('-', 1)[1]}", path, buckets=16)
    return dedup_batch(spark.read.parquet(f"{sf_dir}/documents.parquet"), index)


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h
  FROM documents),
w AS (
  SELECT h, count(*) AS group_size, arg_min(doc_id, {'a': -n, 'b': doc_id}) AS keep_id FROM d GROUP BY h)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, h AS text_sha256 FROM d JOIN w USING (h)
"""
