"""Vector code compression by member-resident Lloyd iterations.

Vectors of integers are cut into ``PARTS`` equal parts; every part position has
a codebook, and a vector's code is the entry number of each of its parts.

1. ``members`` cuts the kept vectors into parts and deals each part to the
   owner of (position, entry, salt): the entry is the nearest one of the first
   codebooks, and the salts keep the owners of an entry that holds most parts
   of a position small.
2. A round's update comes from the resident members: each owner sums its own,
   the sums of an entry's owners meet as one row per owner.
3. A round's assignment is a narrow pass over the resident members.  Those that
   keep their entry stay in the files they are in (written by the task that
   read them), only those that change it are shuffled to their new owners.
4. The last assignment gives codes and errors, one thin row per part, gathered
   by vector.

The codebooks are the only thing on the driver and in the tasks' closures: 16
positions of at most 64 entries, so 64 vectors' worth of integers.  Members are
written to the shared folder in every round.

Defined results: rows whose vector is null, or holds a null or a component that
is not finite, are left out, and so are vectors shorter than the longest one
that is kept; its length must be a multiple of 16 (if all are empty, so are
their parts, and every code is all zeros); the first entries are those of the 64 smallest distinct ids, a null id
after all others, and of several vectors of one id the smallest; with fewer ids
the codebooks are shorter; repeated rows are separate members and each has its
result row; null labels share one sum; an empty table gives no rows.  Squared
distances must fit 63 bits, or the job fails.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import group_rows, table_bytes, write_table

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Members of one owner, about, if an entry held every part of its position.
OWNER_MEMBERS = 1 << 16
#: Rows that one vectorised step compares with a codebook.
STEP = 2048

MEMBER = "position int, entry int, salt int, row long, part array<long>"


def integer_vectors(rows: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(row, vec_id, label, q) of the kept rows, with a number for each row."""
    x = rows.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"),
                    F.col(vector_col).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    kept = x.where(F.col("v").isNotNull() & F.coalesce(finite, F.lit(False)))
    return write_table(kept.select(F.monotonically_increasing_id().alias("row"), "vec_id", "label",
                                   F.transform("v", lambda c: F.floor(c * SCALE).cast("long")).alias("q")), "codes-vectors", rows)


def first_codebooks(vectors: DataFrame, length: int) -> np.ndarray:
    """Codebooks (position, entry, component) of the smallest ids."""
    ids = [r[0] for r in vectors.select("vec_id").distinct().orderBy(F.col("vec_id").asc_nulls_last()).limit(ENTRIES).collect()]
    some = [i for i in ids if i is not None]
    seeds = vectors.where(F.col("vec_id").isin(some) | (F.col("vec_id").isNull() if len(some) < len(ids) else F.lit(False)))
    seeds = {r[0]: r[1] for r in seeds.groupBy("vec_id").agg(F.min("q")).collect()}
    return np.array([seeds[i] for i in ids], np.int64).reshape(len(ids), PARTS, length // PARTS).transpose(1, 0, 2)


def nearest(parts: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each part (ties to the lower) and its squared distance."""
    entry, error = np.empty(len(parts), np.int64), np.empty(len(parts), np.int64)
    reach = max(int(np.abs(parts).max(initial=0)), int(np.abs(book).max(initial=0)))
    if 4 * parts.shape[1] * reach * reach >= 1 << 63:
        raise OverflowError("squared distances of these vectors do not fit 63 bits")
    for at in range(0, len(parts), STEP):
        d = ((parts[at:at + STEP, None, :] - book[None]) ** 2).sum(axis=2)
        entry[at:at + STEP] = d.argmin(axis=1)
        error[at:at + STEP] = d.min(axis=1)
    return entry, error


def _arrays(x: np.ndarray) -> pa.Array:
    """One list per row of a matrix."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.reshape(-1), pa.int64()))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), width)


def _cut(books: np.ndarray, salts: int):
    """Vectors to their parts, each with its owner."""
    width = books.shape[2]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, q = batch.column(0), _matrix(batch.column(1), PARTS * width)
            salt = pa.array(row.to_numpy() % salts, pa.int32())
            for p in range(PARTS):
                part = q[:, p * width:(p + 1) * width]
                entry, _ = nearest(part, books[p])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(q), p), pa.int32()), pa.array(entry, pa.int32()), salt, row, _arrays(part)],
                                                 ["position", "entry", "salt", "row", "part"])
    return cut


def _assigned(batch: pa.RecordBatch, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entry and error of each member of a batch."""
    part, position = _matrix(batch.column("part"), books.shape[2]), batch.column("position").to_numpy()
    entry, error = np.empty(len(part), np.int64), np.empty(len(part), np.int64)
    for p in np.unique(position):
        at = np.flatnonzero(position == p)
        entry[at], error[at] = nearest(part[at], books[p])
    return entry, error


def _reassign(books: np.ndarray):
    """Members with their new entry, and whether they leave their owner."""
    def reassign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            entry, _ = _assigned(batch, books)
            moved = entry != batch.column("entry").to_numpy()
            yield pa.RecordBatch.from_arrays([batch.column("position"), pa.array(entry, pa.int32()), *(batch.column(c) for c in ("salt", "row", "part")),
                                              pa.array(moved)], ["position", "entry", "salt", "row", "part", "moved"])
    return reassign


def _final(books: np.ndarray):
    """Row, position, entry and error of each member."""
    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            entry, error = _assigned(batch, books)
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("position"), pa.array(entry, pa.int32()), pa.array(error, pa.int64())],
                                             ["row", "position", "entry", "error"])
    return final


def updated(members: DataFrame, books: np.ndarray) -> np.ndarray:
    """Codebooks of the members' means; entries without members stay.  Owners
    sum their resident members (per position, entry and salt, no shuffle of
    members), then the owners' sums of an entry are added."""
    width = books.shape[2]
    sums = [F.sum(F.col("part")[i]).alias(f"s{i}") for i in range(width)]
    new = books.copy()
    for r in members.groupBy("position", "entry").agg(F.count(F.lit(1)).alias("n"), *sums).collect():  # at most 1024 rows
        new[r.position, r.entry] = [r[f"s{i}"] // r.n for i in range(width)]
    return new


def to_owners(members: DataFrame, vectors: DataFrame) -> DataFrame:
    """Members dealt to the partitions of their owners."""
    parts = max(vectors.sparkSession.sparkContext.defaultParallelism, table_bytes(vectors) >> 23)
    return members.repartition(parts, "position", "entry", "salt")


def compress(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label"
             ) -> tuple[DataFrame, np.ndarray, DataFrame]:
    """Codes of all kept vectors: (row, code, error), the final codebooks
    (position, entry, component), and the numbered vectors."""
    spark = rows.sparkSession
    vectors = integer_vectors(rows, id_col, vector_col, label_col)
    length, count = vectors.agg(F.max(F.size("q")), F.count(F.lit(1))).first()
    if not count:
        return spark.createDataFrame([], "row long, code string, error long"), np.zeros((PARTS, 0, 0), np.int64), vectors
    if length % PARTS:
        raise ValueError(f"the vectors' length must be a multiple of {PARTS}, not {length}")
    vectors = vectors.where(F.size("q") == length)
    books, salts = first_codebooks(vectors, length), -(-count // OWNER_MEMBERS)
    resident = write_table(to_owners(vectors.select("row", "q").mapInArrow(_cut(books, salts), MEMBER), vectors), "codes-members")
    for turn in range(ROUNDS):
        if turn:  # who stays is written where it was read, who moves goes to its new owner
            told = write_table(resident.mapInArrow(_reassign(books), MEMBER + ", moved boolean"), "codes-told", vectors)
            arrived = write_table(to_owners(told.where("moved").drop("moved"), vectors), "codes-arrived", vectors)
            resident = told.where("NOT moved").drop("moved").union(arrived)
        books = updated(resident, books)
    told = resident.mapInArrow(_final(books), "row long, position int, entry int, error long")
    pair = F.transform(F.array_sort(F.collect_list(F.struct("position", "entry"))), lambda x: F.lpad(F.lower(F.hex(x["entry"])), 2, "0"))
    codes = told.groupBy("row").agg(F.array_join(pair, "").alias("code"), F.sum("error").alias("error"))
    return codes, books, vectors


def codebooks_digest(books: np.ndarray) -> str:
    """SHA-256 of all components by part, entry and position within the part."""
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def coded_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per kept vector: vec_id, code, error, label_error and
    codebooks_sha256."""
    codes, books, vectors = compress(rows, id_col, vector_col, label_col)
    out = write_table(vectors.select("row", "vec_id", "label").join(codes, "row"), "codes-rows", rows)
    # a null label is a key of its own
    out = out.withColumn("__key", F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit("")))
    out = group_rows(out, ["__key"], F.col("row"), [("label_error", "sum", F.col("error"))])
    return out.select("vec_id", "code", "error", "label_error", F.lit(codebooks_digest(books)).alias("codebooks_sha256"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all embeddings."""
    return coded_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _assign_sql(turn: int) -> str:
    return f"""
near{turn} AS (
  SELECT row, p, arg_min(e, (dist, e)) AS e, min(dist) AS dist
  FROM (SELECT m.row, m.p, c.e, list_sum([(z[1] - z[2]) * (z[1] - z[2]) FOR z IN list_zip(m.part, c.entry)])::BIGINT AS dist
        FROM members m JOIN book{turn} c USING (p))
  GROUP BY row, p)"""


def _update_sql(turn: int) -> str:
    return f"""
sums{turn} AS (
  SELECT p, e, i, sum(part[i])::BIGINT AS s, count(*) AS n
  FROM members JOIN near{turn} USING (row, p), range(1, len(part) + 1) k(i) GROUP BY p, e, i),
means{turn} AS (SELECT p, e, list((s - ((s % n) + n) % n) // n ORDER BY i) AS entry FROM sums{turn} GROUP BY p, e),
book{turn + 1} AS (SELECT p, e, coalesce(m.entry, c.entry) AS entry FROM book{turn} c LEFT JOIN means{turn} m USING (p, e))"""


OP12_SQL = f"""
WITH kept AS (
  SELECT row_number() OVER (ORDER BY vec_id) AS row, vec_id, label, [floor({SCALE} * x::DOUBLE)::BIGINT FOR x IN embedding] AS q
  FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
members AS (SELECT row, p, q[p * (len(q) // {PARTS}) + 1:(p + 1) * (len(q) // {PARTS})] AS part FROM kept, range({PARTS}) r(p)),
book0 AS (SELECT p, row - 1 AS e, part AS entry FROM members WHERE row <= {ENTRIES}),
{_assign_sql(0)},{_update_sql(0)},{_assign_sql(1)},{_update_sql(1)},{_assign_sql(2)},
books AS (SELECT sha256(string_agg(array_to_string(entry, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book2),
codes AS (SELECT row, string_agg(lpad(lower(to_hex(e)), 2, '0'), '' ORDER BY p) AS code, sum(dist)::BIGINT AS error FROM near2 GROUP BY row)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM kept JOIN codes USING (row), books
"""
