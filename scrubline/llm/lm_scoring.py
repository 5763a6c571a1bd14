"""Stupid-backoff language-model scores, computed relationally.

Documents are dealt to batches by hash.  Each batch asks for the counts of its
distinct n-grams; the requests meet, partitioned by n-gram hash, in the count
tables, which are built from them (a request says how often its batch holds
the n-gram); the answers go back to the batches, are joined to the n-grams of
each document and summed.  An n-gram as frequent as one likes is one request
per batch, so no key is hot, and both tables are packed columns per (batch,
hash partition) that a task holds one of.

The score of a word after its context of up to ``order - 1`` words is
``count(context word) / count(context)`` if the longer n-gram is known, else
0.4 times the score with one context word less; at last the word's count over
all words.  Counts are of all other documents: a document's own n-grams are
taken out, or each would confirm itself.  A word unknown elsewhere counts 1.

Defined results: words are runs outside ``[\x20\x09-\x0D]``, A-Z lower-cased;
a null text has none; a document without words has a null score; repeated rows
are separate documents that confirm each other.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import WORD_BYTES, Words, compact, table_bytes, text_chunks

ORDER = 3
BACKOFF = 0.4
#: Table bytes per batch; texts are about twice as large.
BATCH_BYTES = 6 << 20


def grams(words: Words, order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per n = 1 to ``order``: the last word and the hash of each n-gram within a text."""
    out = []
    for n in range(1, order + 1):
        at, h = words.windows(n)
        out.append(((at + n - 1).astype(np.int32), h))
    return out


_RAW_PLANES = 5  # of the bytes of a difference; those above are small numbers, coded by their frequency


def _pack(h: np.ndarray) -> bytes:
    """Sorted hashes as differences, byte plane by byte plane."""
    planes = np.ascontiguousarray(np.diff(h, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T)
    return planes[:_RAW_PLANES].tobytes() + zlib.compress(planes[_RAW_PLANES:].tobytes(), 1)


def _unpack(b: bytes, n: int) -> np.ndarray:
    low = np.frombuffer(b, np.uint8, _RAW_PLANES * n).reshape(_RAW_PLANES, n)
    high = np.frombuffer(zlib.decompress(memoryview(b)[_RAW_PLANES * n:]), np.uint8).reshape(8 - _RAW_PLANES, n)
    return np.cumsum(np.ascontiguousarray(np.concatenate([low, high]).T).view(np.uint64).reshape(-1), dtype=np.uint64)


def _pack_counts(n: np.ndarray) -> bytes:
    return zlib.compress(n.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def _unpack_counts(b: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(b), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<u8").reshape(-1).astype(np.int64)


def _hashed(table: pa.Table, order: int):
    """Per chunk of a batch's documents: rows, first word of each text (and the
    end), and the n-grams."""
    for rows, data, offsets in text_chunks(iter(table.to_batches())):
        words = Words(data, offsets, WORD_BYTES, True)
        yield rows, words.doc, grams(words, order)


def _gathered(table: pa.Table, order: int, each) -> np.ndarray:
    """The hashes of all n-grams of a batch in one array, filled as they come;
    ``each`` is handed the rows, first words and last words of every chunk.

    A word and what ends it take two bytes, which bounds the array; pages that
    are never filled are never in memory."""
    size = pc.sum(pc.binary_length(table.column("text"))).as_py() or 0
    every, used = np.empty(order * (size // 2 + table.num_rows), np.uint64), 0
    for rows, first, g in _hashed(table, order):
        for _, h in g:
            every[used:used + len(h)] = h
            used += len(h)
        each(rows, first, [last for last, _ in g])
    return every[:used]


def _distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of a sorted array and how often each occurs."""
    first = np.flatnonzero(_changes(h))
    return h[first], np.diff(np.append(first, len(h)))


def _changes(sorted_values: np.ndarray) -> np.ndarray:
    new = np.ones(len(sorted_values), bool)
    np.not_equal(sorted_values[1:], sorted_values[:-1], out=new[1:])
    return new


def _requests(order: int, parts: int):
    def ask(table: pa.Table) -> pa.Table:
        batch = table.column("batch")[0].as_py()
        every = _gathered(table, order, lambda *_: None)
        every.sort()
        # hash partitions are ranges of the hash, so each is a slice of the sorted hashes, counted by itself
        edges = np.searchsorted(every, (np.arange(1, parts, dtype=np.uint64) * np.uint64((1 << 64) // max(2, parts))))
        out = []
        for p, (a, b) in enumerate(zip([0, *edges], [*edges, len(every)])):
            if b > a:
                h, n = _distinct(every[a:b])
                out.append((p, batch, _pack(h), _pack_counts(n)))
        cols = list(zip(*out)) or [[], [], [], []]
        return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.binary(), pa.binary()))],
                        names=["part", "batch", "grams", "counts"])
    return ask


def _answer(table: pa.Table) -> pa.Table:
    """One hash partition: the count table from all batches' requests, and the
    total of each requested n-gram in the order of the request."""
    counts = [_unpack_counts(x) for x in table.column("counts").to_pylist()]
    asked = [_unpack(x, len(c)) for x, c in zip(table.column("grams").to_pylist(), counts)]
    every = np.concatenate(asked)
    order = np.argsort(every)
    every = every[order]
    first = np.flatnonzero(_changes(every))
    table_h, totals = every[first], np.add.reduceat(np.concatenate(counts)[order], first)
    del every, order, counts
    out = [_pack_counts(totals[np.searchsorted(table_h, x)]) for x in asked]  # sorted lookups
    return pa.table([table.column("batch").combine_chunks(), table.column("part").combine_chunks(), pa.array(out, pa.binary())],
                    names=["batch", "part", "totals"])


def _scores(order: int, total: int):
    def score(key, docs: pa.Table, answers: pa.Table) -> pa.Table:
        # the batch's n-grams again; each one's place among the distinct ones, which the answers follow
        chunks = []
        every = _gathered(docs, order, lambda *chunk: chunks.append(chunk))
        by_hash = np.argsort(every)
        new = _changes(every[by_hash])
        del every
        place = np.empty(len(by_hash), np.int32)
        place[by_hash] = np.cumsum(new, dtype=np.int32) - 1
        del by_hash
        answered = sorted(zip(*(answers.column(c).to_pylist() for c in ("part", "totals"))))
        totals = np.concatenate([*(_unpack_counts(t) for _, t in answered), np.zeros(0, np.int64)])
        if len(totals) != np.count_nonzero(new):
            raise RuntimeError("counts of a batch are missing")
        out, used = [], 0
        for part, first, g in chunks:
            n = np.diff(first)
            doc = np.repeat(np.arange(len(n)), n)
            others = []  # per order: at each word, the n-gram's count in other documents
            for last in g:
                at = place[used:used + len(last)]
                used += len(last)
                c = np.zeros(len(doc), np.int64)
                more = np.flatnonzero(totals[at] > 1)  # a single one is the document's own
                _, inverse, own = np.unique(doc[last[more]] << np.int64(40) | at[more].astype(np.int64), return_inverse=True, return_counts=True)
                c[last[more]] = totals[at[more]] - own[inverse]
                others.append(c)
            rest = np.maximum(1, total - n)[doc]
            log = np.log(np.maximum(1, others[0]) / rest)
            for k in range(1, order):
                context = np.zeros(len(log), np.int64)
                context[1:] = others[k - 1][:-1]  # the (k)-gram that ends one word earlier
                hit = others[k] > 0
                in_text = np.arange(len(doc)) - first[doc]
                low = np.log(BACKOFF) + log
                log = np.where(in_text < k, log, np.where(hit, np.log(np.maximum(1, others[k]) / np.maximum(1, context)), low))
            sums = np.bincount(doc, weights=log, minlength=len(n))[:len(n)] if len(doc) else np.zeros(len(n))
            known = np.bincount(doc, weights=others[-1] > 0, minlength=len(n))[:len(n)] if len(doc) else np.zeros(len(n))
            mean = [float(s / k) if k else None for s, k in zip(sums, n)]
            out.append(pa.table([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(known.astype(np.int64)),
                                 pa.array([float(s) if k else None for s, k in zip(sums, n)], pa.float64()), pa.array(mean, pa.float64())],
                                names=["doc_id", "n_words", "n_known", "log_score", "mean_log_score"]))
        return pa.concat_tables(out) if out else pa.table(
            [pa.array([], t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())],
            names=["doc_id", "n_words", "n_known", "log_score", "mean_log_score"])
    return score


def backoff_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_known (words whose whole
    ``order``-gram is in another document), log_score (natural logarithm, summed)
    and mean_log_score (per word)."""
    parts = max(1, -(-table_bytes(docs) // BATCH_BYTES))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"),
                       F.pmod(F.xxhash64(id_col, text_col), F.lit(parts)).cast("int").alias("batch"))
    total = rows.mapInArrow(_count_words, "n long").agg(F.sum("n")).first()[0] or 0
    asked = rows.groupBy("batch").applyInArrow(_requests(order, parts), "part int, batch int, grams binary, counts binary")
    answers = asked.groupBy("part").applyInArrow(_answer, "batch int, part int, totals binary")
    scored = rows.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(
        _scores(order, total), "doc_id long, n_words long, n_known long, log_score double, mean_log_score double")
    return compact(scored, docs)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n = 0
    for _, data, offsets in text_chunks(batches):
        n += len(Words(data, offsets, WORD_BYTES, False).starts)
    yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scored by the trigrams of all others."""
    return backoff_scores(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
