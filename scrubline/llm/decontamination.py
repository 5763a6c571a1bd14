"""Benchmark decontamination with suffix arrays over the training text.

Each task turns stretches of its documents into word suffix arrays (shards):
positions sorted by the words that follow.  Every test suffix - the words of a
benchmark item from each of its words on - is looked up in every shard by
binary search; the range found holds all places where its window (the first
ten words, or a whole shorter item) occurs, and matches on one diagonal join
to longest verbatim matches.  Two things keep a shard small: words that no
item has end every match, so they get id 0 and no suffix starts there, and the
sort goes to three words for all suffixes, then to the whole window for those
suffixes whose first three words some test suffix has.

The benchmark is a stated query set against all documents: it goes out in
blocks of at most ``BLOCK_BYTES`` of text, one scan of the documents per
block (a block with more distinct words than a sort key can tell apart, 2**21,
is halved).  Documents are never shuffled when one block is enough.

Defined results: null or wordless texts have no words and no hits; repeated
rows each get their row; an item repeated word for word counts once per id; a
null item id counts as the id ``null``; without items nothing is contaminated.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import ALNUM_BYTES, Words, compact, lengths_to_list, range_hashes, text_chunks

WINDOW = 10
BLOCK_BYTES = 32 << 20
#: Text of one shard.
SHARD_BYTES = 1 << 19
_BITS = 21  # of a word id in a three-word sort key

SCAN_SCHEMA = ("doc_id long, text_key long, n_words long, hit_start array<int>, hit_end array<int>, "
               "item array<string>, doc_word array<int>, item_word array<int>, match_words array<int>")


class TooManyWords(ValueError):
    """A block whose words do not fit the ids of a sort key."""


def lookups(items: list[tuple[str, str | None]]) -> list["TestSuffixes"]:
    """Items as lookups: one block, or as many halves as their words need."""
    try:
        return [TestSuffixes([t for _, t in items], [n for n, _ in items])]
    except TooManyWords:
        if len(items) < 2:
            raise
        half = len(items) // 2
        return lookups(items[:half]) + lookups(items[half:])


class TestSuffixes:
    """The windows of one block of items, ready for lookups."""

    def __init__(self, texts: list[str | None], names: list[str], window: int = WINDOW):
        self.names = names
        col = pa.array(texts, pa.string())
        batch = pa.RecordBatch.from_arrays([col], ["text"])
        parts = [Words(d, o, ALNUM_BYTES, True) for _, d, o in text_chunks(iter([batch]))]
        hashes = np.concatenate([w.hashes for w in parts]) if parts else np.zeros(0, np.uint64)
        sizes = np.concatenate([np.diff(w.doc) for w in parts]) if parts else np.zeros(0, np.int64)
        first = np.concatenate([[0], np.cumsum(sizes)])
        self.vocabulary = np.unique(hashes)
        if len(self.vocabulary) >= 1 << _BITS:
            raise TooManyWords("one item has too many distinct words")
        self.flags = np.zeros(1 << 16, bool)
        self.flags[(self.vocabulary & np.uint64(0xFFFF)).astype(np.int64)] = True
        ids = np.searchsorted(self.vocabulary, hashes).astype(np.int64) + 1
        item = np.repeat(np.arange(len(sizes)), sizes)
        length = np.minimum(sizes, window)[item]  # of the window that starts at a word
        word = np.arange(len(ids)) - first[item]
        whole = word + length <= sizes[item]
        short = sizes[item] < window
        at = np.flatnonzero(whole & (~short | (word == 0)))
        self.item, self.word, self.length = item[at], word[at], length[at]
        padded = np.concatenate([ids, np.zeros(3, np.int64)])
        self.low = np.zeros(len(at), np.int64)
        for j in range(3):
            self.low = (self.low << _BITS) | np.where(self.length > j, padded[at + j], 0)
        self.high = self.low + (np.int64(1) << (_BITS * (3 - np.minimum(self.length, 3))))
        self.window_hash = range_hashes(ids.astype(np.uint64), at, at + self.length) if len(at) else np.zeros(0, np.uint64)
        self.shortest = int(self.length.min()) if len(at) else 0

    def word_ids(self, hashes: np.ndarray) -> np.ndarray:
        ids = np.zeros(len(hashes), np.int64)
        may = np.flatnonzero(self.flags[(hashes & np.uint64(0xFFFF)).astype(np.int64)])
        if len(may):
            at = np.searchsorted(self.vocabulary, hashes[may])
            at[at == len(self.vocabulary)] = 0
            ids[may] = np.where(self.vocabulary[at] == hashes[may], at + 1, 0)
        return ids


def find(words: Words, tests: TestSuffixes) -> tuple[np.ndarray, np.ndarray]:
    """All places of all windows in one shard: (index of a test window, start
    word), from the shard's suffix array by binary search."""
    none = np.zeros(0, np.int64)
    if not len(tests.item) or not len(words.starts):
        return none, none
    ids = tests.word_ids(words.hashes)
    n = len(ids)
    last = np.repeat(words.doc[1:], np.diff(words.doc))  # end of each word's text
    left = np.minimum(last - np.arange(n), 255)
    padded = np.concatenate([ids, np.zeros(2, np.int64)])
    follow = [ids, np.where(left > 1, padded[1:n + 1], 0), np.where(left > 2, padded[2:n + 2], 0)]
    open_ = ids > 0
    for j in range(1, min(3, tests.shortest)):
        open_ &= follow[j] > 0
    at = np.flatnonzero(open_)
    keys = (follow[0][at] << (2 * _BITS)) | (follow[1][at] << _BITS) | follow[2][at]
    order = np.argsort(keys, kind="stable")
    suffixes, keys = at[order], keys[order]
    low, high = np.searchsorted(keys, tests.low), np.searchsorted(keys, tests.high)

    found_t, found_p = [], []
    exact = np.flatnonzero((high > low) & (tests.length <= 3))
    for t in exact:
        found_p.append(suffixes[low[t]:high[t]])
        found_t.append(np.full(high[t] - low[t], t))
    longer = np.flatnonzero((high > low) & (tests.length > 3))
    for size in np.unique(tests.length[longer]):
        t = longer[tests.length[longer] == size]
        inside = np.zeros(len(suffixes) + 1, np.int64)
        np.add.at(inside, low[t], 1)
        np.add.at(inside, high[t], -1)
        p = suffixes[np.cumsum(inside)[:-1] > 0]
        p = p[left[p] >= size]
        h = range_hashes(ids.astype(np.uint64), p, p + size)
        order = np.argsort(h, kind="stable")
        p, h = p[order], h[order]
        lo, hi = np.searchsorted(h, tests.window_hash[t], "left"), np.searchsorted(h, tests.window_hash[t], "right")
        k = hi - lo
        if k.sum():
            run = np.repeat(lo - np.concatenate([[0], np.cumsum(k)[:-1]]), k) + np.arange(k.sum())
            found_p.append(p[run])
            found_t.append(np.repeat(t, k))
    if not found_t:
        return none, none
    return np.concatenate(found_t).astype(np.int64), np.concatenate(found_p).astype(np.int64)


def _matches(words: Words, tests: TestSuffixes, t: np.ndarray, p: np.ndarray):
    """Longest verbatim matches: (text, item, start word in the text, in the item, words)."""
    item, q, size = tests.item[t], tests.word[t], tests.length[t]
    text = np.searchsorted(words.doc, p, side="right") - 1
    order = np.lexsort((p, p - q, item, text))
    item, q, size, text, p = item[order], q[order], size[order], text[order], p[order]
    new = np.ones(len(p), bool)
    new[1:] = (text[1:] != text[:-1]) | (item[1:] != item[:-1]) | (p[1:] - q[1:] != p[:-1] - q[:-1]) | (p[1:] != p[:-1] + 1)
    first = np.flatnonzero(new)
    run = np.diff(np.append(first, len(p)))
    return text[first], item[first], p[first], q[first], run - 1 + size[first]


def _scanner(shared):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tests = shared.value
        for rows, data, offsets in text_chunks(batches, size=SHARD_BYTES):
            words = Words(data, offsets, ALNUM_BYTES, True)
            n_docs, n = rows.num_rows, len(words.starts)
            t, p = find(words, tests)
            text, item, start, word, size = _matches(words, tests, t, p)
            cover = np.zeros(n + 1, np.int64)
            np.add.at(cover, start, 1)
            np.add.at(cover, start + size, -1)
            hit = np.zeros(n + 2, bool)
            hit[1:-1] = np.cumsum(cover)[:n] > 0
            cut = words.doc[1:-1]
            edge = np.diff(hit.astype(np.int8))
            begin, end = edge[:n] == 1, edge[1:] == -1
            inner = cut[(cut > 0) & (cut < n)]  # a stretch of hits never spans two texts
            begin[inner] |= hit[1:-1][inner]
            end[inner - 1] |= hit[1:-1][inner - 1]
            begin, end = np.flatnonzero(begin), np.flatnonzero(end) + 1
            of = np.searchsorted(words.doc, begin, side="right") - 1
            base = words.doc[:-1]
            by_doc = lambda x: np.bincount(x, minlength=n_docs)[:n_docs]
            lists = [lengths_to_list((v - base[d]).astype(np.int32), by_doc(d), pa.int32())
                     for v, d in ((begin, of), (end, of))]
            names = pa.array(tests.names, pa.string()).take(pa.array(item))
            ends = np.concatenate([[0], np.cumsum(by_doc(text))])
            lists.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), names))
            lists += [lengths_to_list(v.astype(np.int32), by_doc(text), pa.int32()) for v in (start - base[text], word, size)]
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), rows.column(1), pa.array(np.diff(words.doc), pa.int64()), *lists],
                ["doc_id", "text_key", "n_words", "hit_start", "hit_end", "item", "doc_word", "item_word", "match_words"])
    return scan


def find_contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       item_col: str = "item_id", item_text_col: str = "text",
                       block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_hit, items (ids as
    sorted strings), matches (array of item_id, doc_word, item_word, n_words:
    longest verbatim matches of at least a window), contaminated, text_key
    (``xxhash64`` of id and text)."""
    spark = docs.sparkSession
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("item_id"),
                             F.col(item_text_col).alias("text")).distinct()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-int(total) // block_bytes))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(id_col, text_col).alias("text_key"),
                       F.col(text_col).cast("string").alias("text"))
    rows = compact(rows, docs)
    scans = []
    for b in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()  # a bounded block
        part.sort(key=lambda r: (r["item_id"], r["text"] or ""))
        for tests in lookups([(r["item_id"], r["text"]) for r in part]):
            scans.append(_structs(rows.mapInArrow(_scanner(spark.sparkContext.broadcast(tests)), SCAN_SCHEMA)))
    hits, blocks = scans[0], len(scans)
    if blocks > 1:  # blocks of one row meet again; equal rows stay as many as they are
        hits = reduce(DataFrame.unionByName, scans).groupBy("doc_id", "text_key").agg(
            F.max("n_words").alias("n_words"), F.flatten(F.collect_list("hits")).alias("hits"),
            F.flatten(F.collect_list("matches")).alias("matches"),
            (F.count(F.lit(1)) / blocks).cast("int").alias("__rows"))
        hits = hits.withColumn("__row", F.explode(F.sequence(F.lit(1), F.col("__rows")))).drop("__row", "__rows")
    covered = F.aggregate(
        F.array_sort("hits"), F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("to")),
        lambda a, x: F.struct((a["n"] + F.greatest(F.lit(0), x["e"] - F.greatest(x["s"], a["to"]))).cast("long").alias("n"),
                              F.greatest(a["to"], x["e"]).alias("to")), lambda a: a["n"])
    named = F.array_sort(F.array_distinct(F.col("matches.item_id")))
    out = hits.select("doc_id", "text_key", "n_words", covered.alias("n_hit"), named.alias("items"), "matches")
    return out.withColumn("contaminated", F.col("n_hit") > 0)


def _structs(scan: DataFrame) -> DataFrame:
    """Hit ranges and matches as structs."""
    hits = F.transform(F.arrays_zip("hit_start", "hit_end"),
                       lambda x: F.struct(x["hit_start"].alias("s"), x["hit_end"].alias("e")))
    matches = F.transform(F.arrays_zip("item", "doc_word", "item_word", "match_words"), lambda x: F.struct(
        x["item"].alias("item_id"), x["doc_word"].alias("doc_word"), x["item_word"].alias("item_word"), x["match_words"].alias("n_words")))
    return scan.select("doc_id", "text_key", "n_words", hits.alias("hits"), matches.alias("matches"))


def clean_documents(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` without any hit, same columns."""
    id_col, text_col = options.get("id_col", "doc_id"), options.get("text_col", "text")
    bad = (find_contamination(docs, benchmark, **options).where("contaminated")
           .select(F.coalesce("doc_id", F.lit(0)).alias("__id"), F.col("text_key").alias("__key")).distinct())
    rows = docs.select(F.struct("*").alias("__row"), F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("__id"),
                       F.xxhash64(id_col, text_col).alias("__key"))
    return rows.join(bad, ["__id", "__key"], "left_anti").select("__row.*")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against all benchmark items."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    longest = F.coalesce(F.array_max(F.col("matches.n_words")), F.lit(0))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated",
                        longest.alias("longest_match"))
