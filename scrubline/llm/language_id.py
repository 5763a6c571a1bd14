"""Language identification with bit-sliced Bloom filters of n-grams.

Learning counts letter trigrams (with word edges) per language over all
learning documents, keeps those with at least ``MIN_SHARE`` of their
language's n-grams (so at most ``1 / MIN_SHARE`` per language, which bounds
the filter) and sets their bits: one slot holds one bit per language, so one
lookup returns all languages at once.  Prediction ANDs the slots of each
n-gram of the whole text, counts bits per language, subtracts the false
positives that the language's fill lets expect and takes the largest.

Defined results: ``und`` with score 0 for a null text, one without letters, or
when nothing was learned; ties go to the language with more learned n-grams,
then to the first in code point order; repeated rows get equal rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import compact, mix, text_chunks, write_table

MIN_SHARE = 5e-5
PROBES = 3
SLOTS_PER_GRAM = 16
_EDGE_BITS = np.uint64(21)

# letter table: code point -> lower-case letter, 0 for what is no letter; filled as code points appear
_letter = np.zeros(0x110000, np.uint32)
_seen = np.zeros(0x110000, bool)


def _letters(points: np.ndarray) -> np.ndarray:
    fresh = points[~_seen[points]]
    if len(fresh):
        for c in np.unique(fresh):
            ch = chr(c)
            low = ch.lower()
            _letter[c] = (ord(low) if len(low) == 1 else c) if ch.isalpha() else 0
            _seen[c] = True
    return _letter[points]


def text_grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Trigram codes of several texts and the first of each text (and the end)."""
    raw = data.tobytes()
    try:
        points = np.frombuffer(raw.decode().encode("utf-32-le"), np.uint32)
        lead = np.zeros(len(data) + 1, np.int64)
        np.cumsum((data & 0xC0) != 0x80, out=lead[1:])
        first = lead[offsets]
    except UnicodeDecodeError:  # bytes that are not UTF-8: text by text, bad bytes replaced
        each = [raw[a:b].decode(errors="replace") for a, b in zip(offsets[:-1], offsets[1:])]
        points = np.frombuffer("".join(each).encode("utf-32-le"), np.uint32)
        first = np.concatenate([[0], np.cumsum([len(x) for x in each])]).astype(np.int64)
    letters = _letters(points).astype(np.uint64)
    n = len(letters)
    before, after = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    before[1:], after[:-1] = letters[:-1], letters[1:]
    inner = first[(first > 0) & (first < n)]
    before[inner] = 0
    after[inner - 1] = 0
    at = np.flatnonzero(letters)
    grams = (before[at] << (_EDGE_BITS + _EDGE_BITS)) | (letters[at] << _EDGE_BITS) | after[at]
    return grams, np.searchsorted(at, first)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lang, gram, n), summed over as much of the partition as fits in bounded state."""
    state: dict[str, list] = {}
    held = 0

    def merged(parts):
        g = np.concatenate([p[0] for p in parts])
        c = np.concatenate([p[1] for p in parts])
        u, inv = np.unique(g, return_inverse=True)
        return u, np.bincount(inv, weights=c, minlength=len(u)).astype(np.int64)

    def out():
        for lang, parts in state.items():
            g, c = merged(parts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g), pa.string()), pa.array(g.astype(np.int64)), pa.array(c)],
                                             ["lang", "gram", "n"])

    for rows, data, offsets in text_chunks(batches):
        grams, first = text_grams(data, offsets)
        langs = np.array(rows.column(1).to_pylist(), object)
        for lang in set(langs):
            mine = np.repeat(langs == lang, np.diff(first))
            g, c = np.unique(grams[mine], return_counts=True)
            state.setdefault(lang, []).append((g, c))
            held += len(g)
        if held > 1 << 20:
            state = {k: [merged(v)] for k, v in state.items()}
            held = sum(len(v[0][0]) for v in state.values())
            if held > 1 << 19:
                yield from out()
                state, held = {}, 0
    yield from out()


class LanguageFilters:
    """Bit-sliced Bloom filters: ``slots[i]`` holds one bit per language."""

    def __init__(self, langs: list[str], weights: list[int], grams: np.ndarray, lang_no: np.ndarray):
        order = sorted(range(len(langs)), key=lambda i: (-weights[i], langs[i].encode()))
        place = np.empty(len(langs), np.int64)
        place[order] = np.arange(len(langs))
        self.langs = [langs[i] for i in order]
        most = int(np.bincount(lang_no, minlength=1).max()) if len(grams) else 1
        self.size = 1 << max(10, int(np.ceil(np.log2(max(1, most) * SLOTS_PER_GRAM))))
        self.slots = np.zeros((self.size, max(1, -(-len(langs) // 8))), np.uint8)
        no = place[lang_no] if len(grams) else lang_no
        for pos in self.positions(grams):
            np.bitwise_or.at(self.slots, (pos, no >> 3), (1 << (no & 7)).astype(np.uint8))
        fill = np.array([np.mean((self.slots[:, i >> 3] >> (i & 7)) & 1) for i in range(len(langs))])
        self.false_rate = fill ** PROBES

    def positions(self, grams: np.ndarray) -> list[np.ndarray]:
        h = mix(grams.astype(np.uint64))
        step = (h >> np.uint64(32)) | np.uint64(1)
        return [((h + np.uint64(j) * step) & np.uint64(self.size - 1)).astype(np.int64) for j in range(PROBES)]

    def counts(self, grams: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Corrected number of n-grams per (text, language)."""
        masks = None
        for pos in self.positions(grams):
            masks = self.slots[pos] if masks is None else masks & self.slots[pos]
        total = np.diff(first).astype(float)
        out = np.zeros((len(first) - 1, len(self.langs)))
        for i in range(len(self.langs)):
            sums = np.zeros(len(grams) + 1, np.int64)
            np.cumsum((masks[:, i >> 3] >> (i & 7)) & 1, out=sums[1:])
            out[:, i] = sums[first[1:]] - sums[first[:-1]]
        return np.maximum(0, (out - total[:, None] * self.false_rate) / (1 - self.false_rate))


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", min_share: float = MIN_SHARE) -> LanguageFilters:
    """Filters from all documents with a language.  What reaches the driver is
    at most ``1 / min_share`` n-grams per language."""
    rows = docs.where(F.col(lang_col).isNotNull()).select(F.col(text_col).cast("string").alias("text"),
                                                          F.col(lang_col).cast("string").alias("lang"))
    counts = rows.mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counts = write_table(counts, "language-grams", docs)
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    kept = counts.join(totals, "lang").where(F.col("n") >= F.col("total") * min_share).select("lang", "gram", "total").toPandas()
    weights = kept.groupby("lang")["total"].first()
    langs = list(weights.index)
    no = kept["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy(np.int64) if langs else np.zeros(0, np.int64)
    return LanguageFilters(langs, [int(x) for x in weights], kept["gram"].to_numpy(np.uint64), no)


def _predictor(shared):
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = shared.value
        names = np.array([*filters.langs, "und"], object)
        for rows, data, offsets in text_chunks(batches):
            grams, first = text_grams(data, offsets)
            n = np.diff(first)
            best, score = np.full(len(n), len(filters.langs)), np.zeros(len(n))
            if filters.langs:
                counts = filters.counts(grams, first)
                some = n > 0
                best[some] = np.argmax(counts[some], axis=1)
                score[some] = np.clip(counts[some].max(axis=1) / n[some], 0, 1)
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(2), pa.array(names[best], pa.string()), pa.array(score)],
                                             ["doc_id", "held_out", "lang_pred", "score"])
    return predict


def predict(docs: DataFrame, filters: LanguageFilters) -> DataFrame:
    """doc_id, held_out, lang_pred, score for rows (doc_id, text, held_out)."""
    shared = docs.sparkSession.sparkContext.broadcast(filters)
    return (compact(docs.select("doc_id", "text", "held_out"), docs)
            .mapInArrow(_predictor(shared), "doc_id long, held_out boolean, lang_pred string, score double"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from those not held out."""
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 3
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", (fold == 1).alias("held_out"))
    return predict(docs, learn(docs.where(~F.col("held_out"))))
