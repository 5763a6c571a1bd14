"""Substring dedup with repeated-phrase automata.

A window is ``window`` consecutive words of one text; every word covered by a
window whose word sequence also starts elsewhere is removed.

Texts of equal words count as one text with its number of copies.

1. *Seeds.*  Of the eight-word phrases inside each window the one with the
   least hash is kept, so equal windows keep equal phrases and about one
   phrase in fourteen is kept.  Only phrases kept twice can lie in a window
   that recurs; documents without one are done.
2. *Confirm.*  The windows around recurring phrases are counted by hash, and
   each that starts twice gets a home, its first place.  Windows next to each
   other in their home join to passages: runs of words in which every window
   recurs.
3. *Locate.*  The passages of a home are one shard: an Aho-Corasick automaton
   (pyahocorasick) over their aligned 18-word blocks.  Any 35 words of a
   passage hold a whole block, so every place where a stretch of a passage can
   occur is met; the match is then extended word by word against the
   passage's text.  Every document that shares a window with a home is streamed
   through that home's automaton (its stretch between the first and the last
   such window).  A home that many documents share is split by salt.

Defined results: a null text has no words; a text shorter than a window loses
nothing; repeated rows are separate texts, so their windows recur; white space
between the words that stay becomes one space.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import WORD_BYTES, Words, compact, join_hot, lengths_to_list, range_hashes, table_bytes, text_chunks, write_table

WINDOW = 35
SEED_WORDS = 8
#: Documents that one automaton's shard streams before the home is split.
SHARD_DOCUMENTS = 512


def _sliding(x: np.ndarray, span: int, op) -> np.ndarray:
    """``op`` over x[i:i + span] for each i where that fits (op is min or max)."""
    done = 1
    while done * 2 <= span:
        x = op(x[:-done], x[done:]) if len(x) > done else x[:0]
        done *= 2
    rest = span - done
    return op(x[:-rest], x[rest:]) if rest and len(x) > rest else (x[:0] if rest else x)


def seed_windows(words: Words, window: int, seed_words: int):
    """``(windows, seed hash of each window, all phrase hashes, their starts)``
    where windows are the start words of all windows of the texts."""
    at, _ = _starts(words, window)
    n = len(words.starts)
    if not len(at):
        return at, np.zeros(0, np.uint64), None
    # phrases across two texts get hashes too but lie in no window
    s = np.arange(n - seed_words + 1)
    phrase = range_hashes(words.hashes, s, s + seed_words)
    least = _sliding(phrase, window - seed_words + 1, np.minimum)
    return at, least[at], phrase


def _starts(words: Words, k: int):
    n = len(words.starts)
    ok = np.zeros(n + 1, np.int64)
    lo, hi = words.doc[:-1], words.doc[1:] - k + 1
    some = hi > lo
    np.add.at(ok, lo[some], 1)
    np.add.at(ok, hi[some], -1)
    return np.flatnonzero(np.cumsum(ok)[:n] > 0), None


def seeds_of(words: Words, window: int, seed_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Start word and hash of each phrase that is the least in some window."""
    at, least, phrase = seed_windows(words, window, seed_words)
    if not len(at):
        return at, least
    span = window - seed_words + 1
    by_window = np.zeros(len(phrase) + span - 1, np.uint64)  # shifted by span - 1
    by_window[at + span - 1] = least
    # a phrase is kept if it equals the largest least hash of the windows it lies in
    most = _sliding(by_window, span, np.maximum)[:len(phrase)]
    p = np.flatnonzero((most == phrase) & (most != 0))
    return p, phrase[p]


def _scan(window: int, seed_words: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in text_chunks(batches):
            words = Words(data, offsets, WORD_BYTES, False)
            p, h = seeds_of(words, window, seed_words)
            per = np.bincount(np.searchsorted(words.doc, p, side="right") - 1, minlength=rows.num_rows)[:rows.num_rows]
            raw = data.tobytes()
            sha = [hashlib.sha256(b" ".join(raw[a:b].split())).hexdigest() for a, b in zip(offsets[:-1], offsets[1:])]
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), rows.column(1), rows.column(3), pa.array(np.diff(words.doc), pa.int64()), pa.array(sha),
                 lengths_to_list(h.astype(np.int64), per, pa.int64())], ["doc_id", "text_key", "no_id", "n_words", "sha", "seeds"])
    return scan


def _recurring_windows(window: int, seed_words: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in text_chunks(batches):
            words = Words(data, offsets, WORD_BYTES, False)
            at, least, _ = seed_windows(words, window, seed_words)
            known = np.unique(rows.column(3).flatten().to_numpy(zero_copy_only=False).astype(np.uint64))
            if not len(at) or not len(known):
                continue
            where = np.minimum(np.searchsorted(known, least), len(known) - 1)
            at = at[known[where] == least]
            h = range_hashes(words.hashes, at, at + window)
            doc = np.searchsorted(words.doc, at, side="right") - 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(h.astype(np.int64)), *(rows.column(i).take(pa.array(doc)) for i in (0, 1, 4)),
                 pa.array((at - words.doc[doc]).astype(np.int32))], ["w", "doc_id", "text_key", "copies", "pos"])
    return scan


def _cut(window: int):
    """Rows for the shards: a home's passages (kind 0) and the stretches of
    documents to stream through homes (kind 1)."""
    names = ["home_id", "home_key", "salt", "kind", "doc_id", "text_key", "base", "texts"]
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.string())]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, _, _ in text_chunks(batches):
            out = []
            for r in rows.to_pylist():
                words = (r["text"] or "").encode().split()
                join = lambda a, b: b" ".join(words[a:b]).decode()
                if r["starts"]:
                    starts = sorted(set(r["starts"]))
                    runs, a = [], starts[0]
                    for x, y in zip(starts, [*starts[1:], None]):
                        if y != x + 1:
                            runs.append(join(a, x + window))
                            a = y
                    out += [(r["doc_id"], r["text_key"], s, 0, None, None, None, runs) for s in range(r["salts"])]
                for x in r["homes"] or ():
                    out.append((x["home_id"], x["home_key"], x["salt"], 1, r["doc_id"], r["text_key"], x["lo"],
                                [join(x["lo"], x["hi"] + window)]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)
    return cut


class PassageAutomaton:
    """Aho-Corasick automaton over the aligned blocks of some passages."""

    def __init__(self, passages: list[str], window: int = WINDOW):
        self.window, self.block = window, (window + 1) // 2
        self.passages = [p.split(" ") for p in passages]
        places: dict[str, list] = {}
        for i, words in enumerate(self.passages):
            for o in range(0, len(words) - self.block + 1, self.block):
                places.setdefault(f" {' '.join(words[o:o + self.block])} ", []).append((i, o))
        self.automaton = ahocorasick.Automaton()
        for block, where in places.items():
            self.automaton.add_word(block, (len(block), where))
        self.automaton.make_automaton()

    def locate(self, text: str) -> list[tuple[int, int]]:
        """Word ranges of ``text`` (words joined by single spaces) that equal at
        least ``window`` words of a passage, as long as they match."""
        words = text.split(" ")
        first = {}  # character before a word -> its number
        at = 0
        for i, w in enumerate(words):
            first[at] = i
            at += len(w) + 1
        seen: dict[tuple[int, int], int] = {}
        found = []
        for end, (size, where) in self.automaton.iter(f" {text} "):
            i = first[end - size + 1]
            for p, o in where:
                if seen.get((p, i - o), -1) >= i:
                    continue
                other = self.passages[p]
                a, b = i, o
                while a and b and words[a - 1] == other[b - 1]:
                    a, b = a - 1, b - 1
                stop, b = i + self.block, o + self.block
                while stop < len(words) and b < len(other) and words[stop] == other[b]:
                    stop, b = stop + 1, b + 1
                seen[p, i - o] = stop
                if stop - a >= self.window:
                    found.append((a, stop))
        return merge_ranges(found)


def merge_ranges(ranges) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _locate(window: int):
    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, automaton = None, None
        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                out = []
                for r in part.to_pylist():
                    key = (r["home_id"], r["home_key"], r["salt"])
                    if r["kind"] == 0:
                        shard, automaton = key, PassageAutomaton(r["texts"], window)
                    else:
                        if key != shard:
                            raise RuntimeError(f"the passages of shard {key} are missing")
                        found = automaton.locate(r["texts"][0])
                        out.append((r["doc_id"], r["text_key"], [a + r["base"] for a, _ in found], [b + r["base"] for _, b in found]))
                if out:
                    types = (pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)],
                                                     ["doc_id", "text_key", "starts", "ends"])
    return locate


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, _, _ in text_chunks(batches):
        out = []
        for r in rows.to_pylist():
            words = (r["text"] or "").encode().split()
            gone = merge_ranges((a, b) for s, e in zip(r["starts"], r["ends"]) for a, b in zip(s, e))
            kept, at = [], 0
            for a, b in gone:
                kept += words[at:a]
                at = b
            kept += words[at:]
            text = b" ".join(kept)
            out.append((r["doc_id"], r["text_key"], len(words) - len(kept), text.decode(), hashlib.sha256(text).hexdigest(),
                        [a for a, _ in gone], [b for _, b in gone]))
        types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)],
                                         ["doc_id", "text_key", "n_removed", "kept_text", "kept_sha", "starts", "ends"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
                   seed_words: int = SEED_WORDS) -> tuple[DataFrame, DataFrame]:
    """``(documents, changed)``: one row per row of ``docs`` (doc_id, text_key,
    n_words, n_removed, kept_sha256), and per changed text (doc_id and text_key
    of one document that has it) its kept_text and the removed word ranges
    (starts, ends)."""
    doc = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("doc_id"),
                      F.xxhash64(F.col(id_col).isNull(), id_col, text_col).alias("text_key"),
                      F.col(text_col).cast("string").alias("text"), F.col(id_col).isNull().alias("no_id"))
    key = ["doc_id", "text_key"]
    thin = write_table(doc.select(*key, "text", "no_id").mapInArrow(
        _scan(window, seed_words), "doc_id long, text_key long, no_id boolean, n_words long, sha string, seeds array<long>"), "substring-seeds", docs)
    # texts of equal words: one stands for all
    unique = write_table(thin.groupBy("sha").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct(*key, "seeds")).alias("own"))
                         .select("sha", "copies", "own.*"), "substring-texts", docs)
    seeds = unique.select(*key, "copies", F.explode("seeds").alias("seed"))
    twice = write_table(seeds.groupBy("seed").agg(F.sum("copies").alias("n")).where("n > 1"), "substring-recurring", docs)
    recurring = join_hot(seeds, twice, "seed", "n", F.col("text_key")).groupBy(*key).agg(
        F.collect_set("seed").alias("seeds"), F.max("copies").alias("copies"))
    some = write_table(doc.select(*key, "text").join(recurring, key).dropDuplicates(key).select(*key, "text", "seeds", "copies"),
                       "substring-documents", docs)

    windows = some.mapInArrow(_recurring_windows(window, seed_words), "w long, doc_id long, text_key long, copies long, pos int")
    homes = windows.groupBy("w").agg(F.sum("copies").alias("n"), F.count(F.lit(1)).alias("places"),
                                     F.min(F.struct(*key, "pos")).alias("home")).where("n > 1")
    homes = write_table(homes.select("w", "places", F.col("home.doc_id").alias("home_id"), F.col("home.text_key").alias("home_key"),
                                     F.col("home.pos").alias("home_pos")), "substring-windows", docs)
    # a window of one place is in its home only; the others look up theirs
    alone = homes.where("places = 1").select(F.col("home_id").alias("doc_id"), F.col("home_key").alias("text_key"), "home_id", "home_key",
                                             F.col("home_pos").alias("pos"))
    met = join_hot(windows.drop("copies"), homes.where("places > 1").drop("home_pos"), "w", "places", F.col("text_key"))
    pairs = write_table(met.select(*key, "home_id", "home_key", "pos").union(alone).groupBy(*key, "home_id", "home_key").agg(
        F.min("pos").alias("lo"), F.max("pos").alias("hi")), "substring-pairs", docs)
    many = pairs.groupBy("home_id", "home_key").agg(F.ceil(F.count(F.lit(1)) / SHARD_DOCUMENTS).cast("int").alias("salts"))
    salted = pairs.join(many, ["home_id", "home_key"]).withColumn(
        "salt", F.pmod(F.xxhash64(*key), F.col("salts")).cast("int"))
    refs = salted.groupBy(*key).agg(F.collect_list(F.struct("home_id", "home_key", "salt", "lo", "hi")).alias("homes"))
    own = homes.groupBy("home_id", "home_key").agg(F.collect_list("home_pos").alias("starts")).join(many, ["home_id", "home_key"])
    own = own.withColumnsRenamed({"home_id": "doc_id", "home_key": "text_key"})
    each = some.select(*key, "text")
    shards = each.join(refs.join(own, key, "left"), key).mapInArrow(
        _cut(window), "home_id long, home_key long, salt int, kind int, doc_id long, text_key long, base int, texts array<string>")
    shard = ["home_id", "home_key", "salt"]
    parts = max(2, table_bytes(some) >> 23)
    located = (shards.repartition(parts, *shard).sortWithinPartitions(*shard, "kind")
               .mapInArrow(_locate(window), "doc_id long, text_key long, starts array<int>, ends array<int>"))
    ranges = located.groupBy(*key).agg(F.collect_list("starts").alias("starts"), F.collect_list("ends").alias("ends"))
    changed = write_table(each.join(ranges, key).mapInArrow(
        _remove, "doc_id long, text_key long, n_removed long, kept_text string, kept_sha string, starts array<int>, ends array<int>"),
        "substring-removed", docs)
    fate = unique.select("sha", "copies", *key).join(changed.select(*key, "n_removed", "kept_sha"), key, "left").select(
        "sha", "copies", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("kept_sha", "sha").alias("kept_sha256"))
    out = join_hot(thin.drop("seeds"), fate, "sha", "copies", F.col("text_key")).select(
        F.when(~F.col("no_id"), F.col("doc_id")).alias("doc_id"), "text_key", "n_words", "n_removed", "kept_sha256")
    return out, changed


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated passages of 35 words or more among all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return compact(remove_repeats(docs)[0], docs).select("doc_id", "n_words", "n_removed", "kept_sha256")
