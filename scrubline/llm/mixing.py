"""Mixing sources to target weights by systematic sampling.

Every document of a source has the same expected number of copies: the
source's target over its size.  Within a source the prefix sum of these
expectations, shifted by one random offset, crosses an integer boundary once
per copy taken.  Documents are ordered by size within their source, so that
the sample runs evenly over short and long ones and the words taken come near
the target.

Everything is DataFrame code.  Prefix sums are two-level: rows are dealt by
range of (source, size, hash, id), each range is ranked by itself, and offsets
come from the counts per (range, source), so a source with a third of all rows
is spread over many ranges.  Targets come from repeated aggregates over the
table of sources, as the rule states them.

Defined results: a null text has size 0 and takes no words; documents of a
null source are one source, the last; a source without words has target 0 and
its documents are not taken; repeated rows are sampled as separate documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import compact, table_bytes, write_table

WEIGHTS = (5, 2, 1)
MAX_COPIES = 3
#: Offsets are multiples of 2**-20, exact in a double next to any rank.
OFFSET_STEPS = 1 << 20


def ranked(df: DataFrame, by: list, within: list[str], name: str, source: DataFrame) -> DataFrame:
    """``df`` (written once) with ``__rank``: the 1-based place of a row in
    the order ``by`` among the rows equal in ``within`` (which ``by`` starts with)."""
    ranges = max(2, min(4096, table_bytes(source) >> 24))
    dealt = write_table(df.repartitionByRange(ranges, *by).withColumn("__part", F.spark_partition_id()), name, source)
    counts = dealt.groupBy("__part", *within).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*(within or [F.lit(0)])).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(F.col("__part").alias("__p"), *[F.col(c).alias(f"__w_{c}") for c in within],
                           F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    same = F.col("__part") == F.col("__p")
    for c in within:
        same &= F.col(c).eqNullSafe(F.col(f"__w_{c}"))
    own = F.row_number().over(Window.partitionBy("__part", *within).orderBy(*by))
    return (dealt.withColumn("__own", own).join(counts, same)
            .select(*df.columns, (F.col("__own") + F.col("__before")).alias("__rank")))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: float = MAX_COPIES) -> DataFrame:
    """``(source, source_size, target)`` for rows (source, size).

    Sources in code point order (null last) weigh ``weights``, repeating.  The
    sum of all sizes is shared by weight; a share above ``most`` times its
    source's size stops there and the excess is shared again by weight among
    the others, until none is above.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    # UTF-8 byte order is code point order
    per = ranked(per, [F.col("source").asc_nulls_last()], [], "sources", sizes)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                          (F.pmod(F.col("__rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    per = write_table(per.select("source", "source_size", weight.alias("weight")), "source-weights", sizes)
    limit = F.col("source_size") * F.lit(float(most))
    total = per.agg(F.sum("source_size")).first()[0] or 0
    rate, n_full = (0.0, -1)
    while True:  # one aggregate of three numbers per round; each round fills at least one source more
        full = limit <= F.col("weight") * F.lit(rate)
        held, open_weight, n = per.agg(F.sum(F.when(full, limit)), F.sum(F.when(~full, F.col("weight"))),
                                       F.count(F.when(full, 1))).first()
        if n == n_full or not open_weight:
            break
        n_full, rate = n, (total - (held or 0.0)) / open_weight
    return per.select("source", "source_size", F.least(limit, F.col("weight") * F.lit(rate)).alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: tuple[int, ...] = WEIGHTS, most: float = MAX_COPIES, seed: str = "mix") -> DataFrame:
    """One row per row of ``docs``: doc_id, __text_key (``xxhash64`` of the
    text, to find the row again), source, size, source_size, target, copies,
    taken (= copies * size)."""
    size = F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"))
    thin = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("__text_key"),
                       F.col(source_col).alias("source"), size.cast("long").alias("size"))
    thin = thin.withColumn("__tie", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    rows = ranked(thin, [F.col("source").asc_nulls_last(), F.col("size"), F.col("__tie"), F.col("doc_id"),
                         F.col("__text_key")], ["source"], "mix-sizes", docs)
    rows = write_table(rows, "mix-ranks", docs)
    targets = source_targets(rows, weights, most)
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.lit("|"), F.coalesce(F.col("source"), F.lit("")))), 1, 5),
                    16, 10).cast("double") / F.lit(float(OFFSET_STEPS))
    targets = targets.select(F.col("source").alias("__s"), "source_size", "target", offset.alias("__offset"))
    # The salt splits a large source over many join keys; there is one row per source and salt.
    salts = F.explode(F.sequence(F.lit(0), F.lit(15))).alias("__salt")
    targets = targets.select("*", salts)
    rows = rows.withColumn("__salt", F.pmod(F.col("__rank"), F.lit(16)).cast("int"))
    out = rows.join(targets, rows["source"].eqNullSafe(targets["__s"]) & (rows["__salt"] == targets["__salt"]))
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    to, frm = (F.floor(F.col("__offset") + each * (F.col("__rank") - F.lit(k))) for k in (0, 1))
    copies = F.least(to - frm, F.ceil(each)).cast("int")
    return compact(out, docs).select("doc_id", "__text_key", "source", "size", "source_size", "target", copies.alias("copies"),
                      (copies.cast("long") * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                    **options) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as it is taken, with the
    same columns.  Rows equal in id, text and source share their copies."""
    def key(i, t, s):
        # null-free join keys; xxhash64 skips nulls, so they are told apart by flags
        return [F.coalesce(i, F.lit(0)).alias("__id"), F.xxhash64(i.isNull(), t, s.isNull(), s).alias("__key")]

    plan = mix(docs, id_col, text_col, source_col, **options)
    plan = plan.select(*key(F.col("doc_id"), F.col("__text_key"), F.col("source")), "copies")
    plan = plan.groupBy("__id", "__key").agg(F.sum("copies").alias("__copies"), F.count(F.lit(1)).alias("__rows"))
    rows = docs.select(F.struct("*").alias("__row"),
                       *key(F.col(id_col), F.xxhash64(text_col), F.col(source_col)))
    both = rows.join(plan.where("__copies > 0"), ["__id", "__key"])
    nth = F.row_number().over(Window.partitionBy("__id", "__key").orderBy(F.lit(0)))
    share = (F.floor(F.col("__copies") * nth / F.col("__rows"))
             - F.floor(F.col("__copies") * (nth - 1) / F.col("__rows"))).cast("int")
    return (both.withColumn("__share", share).where("__share > 0")
            .select("__row", F.explode(F.sequence(F.lit(1), F.col("__share"))).alias("__copy")).select("__row.*"))


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents by source."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken", "copies")


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY size, md5(doc_id::VARCHAR), doc_id) AS rnk FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, ([5.0, 2.0, 1.0]::DOUBLE[])[1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight,
             source_size * 3.0::DOUBLE AS lim FROM s),
o AS (SELECT *, row_number() OVER by_fill AS k,
             (sum(source_size) OVER () - coalesce(sum(lim) OVER (by_fill ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / sum(weight) OVER (by_fill ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rate
      FROM w WINDOW by_fill AS (ORDER BY lim / weight, source NULLS LAST)),
f AS (SELECT coalesce((SELECT rate FROM o WHERE lim > weight * rate ORDER BY k LIMIT 1), 0.0) AS rate),
t AS (SELECT source, source_size, least(lim, weight * (SELECT rate FROM f)) AS target,
             ('0x' || substr(md5('mix|' || coalesce(source, '')), 1, 5))::BIGINT / 1048576.0::DOUBLE AS u FROM w),
e AS (SELECT r.doc_id, r.size, t.source_size, t.target, t.u, r.rnk,
             CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS each
      FROM r JOIN t ON r.source IS NOT DISTINCT FROM t.source),
c AS (SELECT *, least(floor(u + each * rnk) - floor(u + each * (rnk - 1)), ceil(each))::INTEGER AS copies FROM e)
SELECT doc_id, size, source_size, target, copies * size AS taken, copies FROM c
"""
