"""Filter interaction audit over a sparse document-term matrix.

1. ``term_blocks`` tokenises the texts block by block (about ``BLOCK_BYTES`` of
   text each) into counts of (document, word) with the block's own word list.
2. ``dictionary`` gives every distinct word of the corpus one global code: the
   word lists, not the texts, are dealt to buckets by hash and numbered there.
   Block lists are in bucket order, so only codes come back.
3. ``csr_shards`` renumbers each block with the global codes: one CSR shard per
   block (``indptr``, ``indices``, ``counts``).
   A document's row sum is its number of words, its count of nonzeros the
   number of distinct words.
4. ``failures`` turns the shards into one bit mask per document (A and B from
   the matrix, C and D from the text's bytes, E from the smallest id among
   equal texts), and ``audit`` counts masks per part and reads every order of
   the filters off those counts: a document is removed by the first filter of
   the order that it fails, so its mask decides all 120 orders.

A block holds at least one text; a task holds one block.  Counting masks
reduces every part to at most 32 rows before it is expanded to orders, however
many documents a part has.

Defined results: a null text is empty (no words: fails A only, unless a smaller
id is empty too); a null part is the part of the empty string; a document with
a null id is never a later copy and has no labels; of rows with one id and
equal texts neither is a copy of the other, and each counts; several label rows
of an id count once (quality 1 or toxic 1 in any of them); an empty table gives
no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import _BYTE_VALUES, WORD_BYTES, Words, _mask, group_rows, lengths_to_list, range_hashes, table_bytes, text_chunks, write_table

#: Text of one block of the matrix.
BLOCK_BYTES = 1 << 19
MIN_WORDS = 50
#: Distinct words in percent of words, and capitals in percent of code points.
MIN_DISTINCT, MAX_CAPITALS = 65, 5
SYMBOLS = "#$%&*|"
FILTERS = "ABCDE"

_CAPITAL = _mask(lambda b: 0x41 <= b <= 0x5A)
_POINT = _mask(lambda b: b & 0xC0 != 0x80)
_SYMBOL = _mask(lambda b: chr(b) in SYMBOLS)


def _per_text(table: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many bytes of each text the table holds."""
    some = np.flatnonzero(offsets[1:] > offsets[:-1])
    out = np.zeros(len(offsets) - 1, np.int64)
    if len(some):
        out[some] = np.add.reduceat(table[data], offsets[:-1][some], dtype=np.int64)
    return out


def _tokenise(buckets: int):
    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        for rows, data, offsets in text_chunks(batches, size=BLOCK_BYTES):
            words = Words(data, offsets, WORD_BYTES, False)
            docs = rows.num_rows
            ends = np.zeros(len(words.starts) + 1, np.int64)
            np.cumsum(words.ends - words.starts, out=ends[1:])
            listed = pa.Array.from_buffers(pa.large_binary(), len(words.starts),
                                           [None, pa.py_buffer(ends), pa.py_buffer(data[WORD_BYTES[data]])]).dictionary_encode()
            # the block's own list of words, in the order of their buckets
            local, terms = listed.indices.to_numpy(), len(listed.dictionary)
            cut, text = _bytes(listed.dictionary)
            bucket = (range_hashes(_BYTE_VALUES[text], cut[:-1], cut[1:]) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            place = np.empty(terms, np.int64)
            place[order] = np.arange(terms)
            held, begin = np.unique(bucket[order], return_index=True)
            sorted_words = listed.dictionary.take(pa.array(order))
            own = np.repeat(np.arange(docs), np.diff(words.doc))
            cells, counts = np.unique(own * max(1, terms) + place[local], return_counts=True)
            digests = [hashlib.sha256(data[a:b]).digest() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            flags = (100 * _per_text(_CAPITAL, data, offsets) > MAX_CAPITALS * _per_text(_POINT, data, offsets)) * 4
            flags += (_per_text(_SYMBOL, data, offsets) > 0) * 8
            one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)  # noqa: E731  one row
            yield pa.RecordBatch.from_arrays(
                [pa.array([number], pa.int64()), one(rows.column(0)), one(rows.column(1)), one(pa.array(digests, pa.binary())),
                 one(pa.array(flags, pa.int32())), pa.array([max(1, terms)], pa.int64()),
                 pa.array([_small(np.diff(cells, prepend=0))], pa.binary()), pa.array([_small(counts)], pa.binary()),
                 one(_packed(held, begin, sorted_words))], [*BLOCK, "words"])
            number += 1
    return tokenise


def _small(numbers: np.ndarray) -> bytes:
    """Non-negative numbers, most of them small, as few bytes."""
    return pa.Codec("zstd").compress(numbers.astype(np.int64).tobytes(), asbytes=True) + len(numbers).to_bytes(8, "little")


def _numbers(small: bytes) -> np.ndarray:
    return np.frombuffer(pa.Codec("zstd").decompress(small[:-8], 8 * int.from_bytes(small[-8:], "little")), np.int64)


def _bytes(words: pa.LargeBinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of an array of words."""
    if not len(words):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    return np.frombuffer(words.buffers()[1], np.int64)[words.offset:words.offset + len(words) + 1], np.frombuffer(words.buffers()[2], np.uint8)


def _packed(held: np.ndarray, begin: np.ndarray, words: pa.Array) -> pa.Array:
    """(bucket, lengths, bytes) of the words of each bucket."""
    ends, text = _bytes(words)
    cut = np.append(begin, len(words)).astype(np.int64)
    lengths = np.diff(ends).astype(np.uint32)

    def binary(data, offsets):
        return pa.Array.from_buffers(pa.binary(), len(held), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)])
    return pa.StructArray.from_arrays([pa.array(held, pa.int32()), binary(lengths, cut * 4), binary(text, ends[cut])],
                                      ["bucket", "lengths", "bytes"])


#: Columns of a block: its documents, and the cells (document times ``terms``
#: plus word) that are not zero with their counts, packed.
BLOCK = ("shard", "ids", "parts", "digests", "flags", "terms", "cells", "counts")
#: Columns of a CSR shard.
CSR = ("shard", "ids", "parts", "digests", "flags", "indptr", "indices", "counts")


def term_blocks(docs: DataFrame, id_col: str, text_col: str, part_col: str) -> DataFrame:
    """Blocks of the matrix with their own word lists (one row per block)."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
                       F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    buckets = max(docs.sparkSession.sparkContext.defaultParallelism, table_bytes(docs) >> 24)
    return write_table(rows.mapInArrow(
        _tokenise(buckets), f"shard long, ids array<{kind}>, parts array<string>, digests array<binary>, flags array<int>, terms long, cells binary, "
                            "counts binary, words array<struct<bucket:int,lengths:binary,bytes:binary>>"), "audit-blocks", docs, 2 * BLOCK_BYTES)


def _code_words(buckets: int):
    """Codes of the words of whole buckets: a word's number among the distinct
    words of its bucket, dealt round the buckets.  Rows come sorted, so a task
    that runs again gives the same codes."""
    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, bucket = {}, None
        for batch in batches:
            out = []
            for now, lengths, text in zip(*(batch.column(c).to_pylist() for c in ("bucket", "lengths", "bytes"))):
                if now != bucket:
                    known, bucket = {}, now
                ends = np.cumsum(np.frombuffer(lengths, np.uint32), dtype=np.int64).tolist()
                out.append(np.array([known.setdefault(text[a:b], len(known)) for a, b in zip([0, *ends], ends)], np.int64) * buckets + now)
            if out:
                yield pa.RecordBatch.from_arrays([batch.column("shard"), batch.column("bucket"),
                                                  lengths_to_list(np.concatenate(out), np.array([len(x) for x in out]), pa.int64())],
                                                 ["shard", "bucket", "codes"])
    return code


def dictionary(blocks: DataFrame, source: DataFrame) -> DataFrame:
    """(shard, bucket, codes): the global codes of every block's words, bucket
    by bucket.  A task keeps the distinct words of one bucket."""
    buckets = max(blocks.sparkSession.sparkContext.defaultParallelism, table_bytes(source) >> 24)
    lists = blocks.select("shard", F.explode("words").alias("w")).select("w.bucket", "shard", "w.lengths", "w.bytes")
    return (lists.repartition(buckets, "bucket").sortWithinPartitions("bucket", "shard")
            .mapInArrow(_code_words(buckets), "shard long, bucket int, codes array<long>"))


def _renumber(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1)
            codes = row.column("codes").flatten().flatten()
            cells, terms = np.cumsum(_numbers(row.column("cells")[0].as_py())), row.column("terms")[0].as_py()
            docs = len(row.column("ids").flatten())
            matrix = {"indptr": pa.array(np.searchsorted(cells, np.arange(docs + 1) * terms), pa.int32()),
                      "indices": codes.take(pa.array(cells % terms)), "counts": pa.array(_numbers(row.column("counts")[0].as_py()), pa.int32())}
            yield pa.RecordBatch.from_arrays(
                [pa.ListArray.from_arrays(pa.array([0, len(matrix[c])], pa.int32()), matrix[c]) if c in matrix else row.column(c) for c in CSR],
                [*CSR])


def _coded_blocks(docs: DataFrame, id_col: str, text_col: str, part_col: str) -> DataFrame:
    """Blocks with the global codes of their words."""
    blocks = term_blocks(docs, id_col, text_col, part_col)
    codes = dictionary(blocks, docs).groupBy("shard").agg(F.array_sort(F.collect_list(F.struct("bucket", "codes"))).alias("codes"))
    # a block without any word has an empty list of codes
    return blocks.drop("words").join(codes, "shard", "left").withColumn(
        "codes", F.coalesce("codes.codes", F.array().cast("array<array<long>>")))


def csr_shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """The document-term matrix: one CSR shard per row, columns by global code."""
    rows = _coded_blocks(docs, id_col, text_col, part_col)
    kinds = {f.name: f.dataType for f in rows.schema} | {
        "indptr": T.ArrayType(T.IntegerType()), "indices": T.ArrayType(T.LongType()), "counts": T.ArrayType(T.IntegerType())}
    return rows.mapInArrow(_renumber, T.StructType([T.StructField(c, kinds[c]) for c in CSR]))


def _row_masks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            at = {c: batch.column(c).slice(i, 1).flatten() for c in CSR[1:]}
            indptr = at["indptr"].to_numpy()
            sums = np.zeros(len(at["counts"]) + 1, np.int64)
            np.cumsum(at["counts"].to_numpy(), out=sums[1:])
            words, distinct = sums[indptr[1:]] - sums[indptr[:-1]], np.diff(indptr)
            mask = at["flags"].to_numpy() + (words < MIN_WORDS) * 1 + (100 * distinct < MIN_DISTINCT * words) * 2
            yield pa.RecordBatch.from_arrays(
                [at["ids"], at["parts"], at["digests"], pa.array(words, pa.int64()), pa.array(distinct, pa.int64()), pa.array(mask, pa.int32())],
                ["doc_id", "part", "digest", "n_words", "n_distinct", "mask"])


def failures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """One row per document: doc_id, part, n_words, n_distinct and ``mask``, a
    bit per failed filter (A is bit 0)."""
    blocks = _coded_blocks(docs, id_col, text_col, part_col)
    kind = blocks.schema["ids"].dataType.elementType.simpleString()
    # shards are built and read in one pass of one worker
    rows = write_table(blocks.mapInArrow(lambda batches: _row_masks(_renumber(batches)), f"doc_id {kind}, part string, digest binary, n_words long, n_distinct long, mask int"),
                       "audit-masks", docs)
    first = group_rows(rows, ["digest"], F.xxhash64("doc_id"), [("first_id", "min", F.col("doc_id"))])
    later = F.coalesce(F.col("doc_id") > F.col("first_id"), F.lit(False))
    return first.select("doc_id", "part", "n_words", "n_distinct", (F.col("mask") + F.when(later, 16).otherwise(0)).alias("mask"))


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """One row per part, order of the filters and step of the order."""
    spark = docs.sparkSession
    marks = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("doc_id")).agg(
        F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"))
    counted = failures(docs, id_col, text_col, part_col).groupBy("doc_id", "part", "mask").agg(F.count(F.lit(1)).alias("n"))
    masks = counted.join(marks, "doc_id", "left").groupBy("part", "mask").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.coalesce("good", F.lit(0))).alias("good"),
        F.sum(F.col("n") * F.coalesce("toxic", F.lit(0))).alias("toxic"))
    parts = masks.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("masks"))  # at most 32
    bit = {c: 1 << i for i, c in enumerate(FILTERS)}
    steps = spark.createDataFrame(
        [(5 * o + s, "".join(order), s + 1, bit[order[s]], sum(bit[c] for c in order[:s]))
         for o, order in enumerate(permutations(FILTERS)) for s in range(5)], "at int, filter_order string, step int, own int, before int")

    def total(what: str, when: str) -> F.Column:
        return F.expr(f"aggregate(masks, 0L, (sum, m) -> sum + IF({when}, {what}, 0L))")
    here = "(m.mask & own) <> 0 AND (m.mask & before) = 0"
    # a mask's first filter is each of its filters in an equal share of the orders
    share = f"m.n * ({len(list(permutations(FILTERS)))} div bit_count(m.mask))"
    return (parts.withColumn("at", F.explode(F.sequence(F.lit(0), F.lit(5 * 120 - 1)))).join(F.broadcast(steps), "at").select(
        "part", "filter_order", "step",
        total("m.n", "(m.mask & (own | before)) = 0").alias("kept"), total("m.n", here).alias("removed"),
        total("m.n", "(m.mask & own) <> 0 AND (m.mask & before) <> 0").alias("redundant"), total("m.n", "m.mask = own").alias("unique_fails"),
        total("m.good", here).alias("good_lost"), total("m.toxic", here).alias("toxic_lost"),
        total(share, "(m.mask & own) <> 0").alias("shapley")))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five filters in all orders over all documents, per source."""
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


OP11_SQL = r"""
WITH texts AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
words AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM texts),
firsts AS (SELECT text, min(doc_id) AS first_id FROM texts GROUP BY text),
fails AS (
  SELECT d.doc_id, d.part, len(w) < 50 AS a, 100 * len(list_distinct(w)) < 65 * len(w) AS b,
         100 * length(regexp_replace(d.text, '[^A-Z]', '', 'g')) > 5 * length(d.text) AS c,
         regexp_matches(d.text, '[#$%&*|]') AS d, coalesce(d.doc_id > f.first_id, false) AS e
  FROM words d JOIN firsts f ON d.text = f.text),
marks AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
          FROM labels GROUP BY doc_id),
docs AS (SELECT part, [x[1] FOR x IN [['A', a::VARCHAR], ['B', b::VARCHAR], ['C', c::VARCHAR], ['D', d::VARCHAR], ['E', e::VARCHAR]]
                       IF x[2] = 'true'] AS failed, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
         FROM fails LEFT JOIN marks USING (doc_id)),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l),
orders AS (SELECT a.l || b.l || c.l || d.l || e.l AS filter_order
           FROM letters a JOIN letters b ON b.l <> a.l JOIN letters c ON c.l NOT IN (a.l, b.l)
           JOIN letters d ON d.l NOT IN (a.l, b.l, c.l) JOIN letters e ON e.l NOT IN (a.l, b.l, c.l, d.l)),
steps AS (SELECT filter_order, step::INT AS step, filter_order[step:step] AS own, filter_order[1:step - 1] AS before
          FROM orders, range(1, 6) s(step)),
sums AS (SELECT part, failed, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM docs GROUP BY part, failed),
told AS (
  SELECT part, filter_order, step, own, n, good, toxic, failed, list_contains(failed, own) AS fails,
         len([x FOR x IN failed IF contains(before, x)]) > 0 AS gone
  FROM sums, steps),
result AS (
  SELECT part, filter_order, step, own, sum(n) FILTER (NOT fails AND NOT gone) AS kept, sum(n) FILTER (fails AND NOT gone) AS removed,
         sum(n) FILTER (fails AND gone) AS redundant, sum(n) FILTER (failed = [own]) AS unique_fails,
         sum(good) FILTER (fails AND NOT gone) AS good_lost, sum(toxic) FILTER (fails AND NOT gone) AS toxic_lost
  FROM told GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed,
       coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
       coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
       (sum(coalesce(removed, 0)) OVER (PARTITION BY part, own))::BIGINT AS shapley
FROM result
"""
