"""Quality classifier: document evidence combined with site posteriors.

1. *Document evidence.*  A logistic regression over the shape of a text (case,
   symbols, repetition, lengths, in bins) and over the presence of words that
   set good and bad labelled documents apart.  It is fitted on the driver from
   at most ``MAX_LABELLED`` labelled documents, the least by hash of their id;
   a document is bad if its quality label is 0 or its toxic label is 1.
2. *Sites.*  The probabilities of all documents are summed per host and per
   path by grouped aggregation.  Each host's rate is shrunk toward the global
   one and each path's toward its host's, by prior strengths that the method of
   moments takes from the spread between hosts and between paths of one host:
   sparse sites stay near the prior of the level above.
3. *Decision.*  A document's odds are its own likelihood ratio times the odds
   of its path without the document itself.  It is rejected at a probability
   of one half.

For ``documents`` the host is the source and the path its part in one language.

Defined results: null hosts and paths are a site of their own; a null text is
an empty one; of several texts of one labelled id the smallest is learned
from; without labels of both kinds every document is kept at the base
rate 0; repeated rows are scored alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import ALNUM_BYTES, WORD_BYTES, Words, compact, join_hot, lengths_to_list, range_hashes, text_chunks, write_table

MAX_LABELLED = 8192
#: Size of the model: at most so many telling words, each in at least so many of
#: the labelled documents.  Words of the documents that are scored are not cut.
MAX_WORDS = 1024
MIN_SUPPORT = 6
BINS = 8
SHAPES = 14
#: Bytes of a word's beginning that are evidence besides the whole word.
PREFIX_BYTES = 6
REJECT_AT = 0.5

_UPPER = np.zeros(256, bool)
_UPPER[0x41:0x5B] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[0x30:0x3A] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#$%&*<>=@^_{}[]~/\\+")] = True


def _per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return (sums[offsets[1:]] - sums[offsets[:-1]]).astype(float)


def _distinct(doc: np.ndarray, h: np.ndarray, n: int):
    """Distinct (text, hash) pairs and the share of the most frequent hash per text."""
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    times = np.diff(np.append(first, len(h)))
    most = np.zeros(n)
    np.maximum.at(most, doc[first], times)
    return doc[first], h[first], most


def features(data: np.ndarray, offsets: np.ndarray):
    """``(shapes, text of each distinct word or word beginning, its hash)`` of several texts."""
    n = len(offsets) - 1
    size = np.maximum(1.0, np.diff(offsets))
    tokens = Words(data, offsets, WORD_BYTES, False)
    words = Words(data, offsets, ALNUM_BYTES, True)
    count = np.diff(words.doc)
    doc = np.repeat(np.arange(n), count)
    d, h, most = _distinct(doc, words.hashes, n)
    distinct = np.bincount(d, minlength=n)[:n]
    longer = np.flatnonzero(words.ends - words.starts > PREFIX_BYTES)
    begin = range_hashes(words.data.astype(np.uint64) + np.uint64(257), words.starts[longer], words.starts[longer] + PREFIX_BYTES)
    prefix_doc, prefix, _ = _distinct(doc[longer], begin, n)
    at, pair = words.windows(2)
    pair_doc = np.searchsorted(words.doc, at, side="right") - 1
    pd_, _, _ = _distinct(pair_doc, pair, n)
    pairs = np.maximum(1, np.bincount(pair_doc, minlength=n)[:n])
    triple = np.zeros(len(data), bool)
    triple[2:] = _SYMBOL[data[2:]] & (data[2:] == data[1:-1]) & (data[2:] == data[:-2])
    same = np.zeros(len(words.starts), bool)
    same[1:] = (words.hashes[1:] == words.hashes[:-1]) & (doc[1:] == doc[:-1])
    some = np.maximum(1, count)
    letters = np.maximum(1.0, _per_text(ALNUM_BYTES[words.data], offsets))
    shapes = np.stack([
        np.log1p(count), _per_text(_UPPER[data], offsets) / letters, _per_text(_DIGIT[data], offsets) / letters,
        _per_text(_SYMBOL[data], offsets) / size, _per_text(data == 0x21, offsets) / size, _per_text(data == 0x7C, offsets) / size,
        _per_text((data == 0x2E) | (data == 0x2C), offsets) / size, _per_text(data == 0x0A, offsets) / size,
        size / np.maximum(1, np.diff(tokens.doc)), distinct / some, most / some,
        np.bincount(pd_, minlength=n)[:n] / pairs, np.bincount(doc[same], minlength=n)[:n] / some,
        _per_text(triple, offsets) / size], axis=1)
    d, h = np.concatenate([d, prefix_doc]), np.concatenate([h, prefix])
    order = np.argsort(d, kind="stable")
    return shapes, d[order], h[order]


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, data, offsets in text_chunks(batches):
        shapes, d, h = features(data, offsets)
        yield pa.RecordBatch.from_arrays(
            [rows.column(1), lengths_to_list(shapes.reshape(-1), np.full(len(shapes), SHAPES), pa.float64()),
             lengths_to_list(h.astype(np.int64), np.bincount(d, minlength=len(shapes))[:len(shapes)], pa.int64())],
            ["bad", "shapes", "words"])


class DocumentModel:
    """Logistic regression over binned shapes and words."""

    def __init__(self, bad: np.ndarray, shapes: np.ndarray, flat: np.ndarray, lengths: np.ndarray):
        n, y = len(bad), bad.astype(float)
        self.rate = float(y.mean()) if n else 0.0
        self.fitted = 0 < y.sum() < n
        if not self.fitted:
            return
        # zero is a bin of its own; the others share what is above evenly
        self.edges = [np.concatenate([[1e-12], np.quantile(c[c > 0], np.arange(1, BINS - 1) / (BINS - 1)) if (c > 0).any()
                                      else np.full(BINS - 2, np.inf)]) for c in shapes.T]
        doc = np.repeat(np.arange(n, dtype=np.int32), lengths)
        u, inv = np.unique(flat, return_inverse=True)
        of_bad, of_all = np.bincount(inv, weights=y[doc], minlength=len(u)), np.bincount(inv, minlength=len(u))
        expect = of_all * self.rate
        chi = (of_bad - expect) ** 2 / np.maximum(expect * (1 - self.rate), 1e-9)
        chosen = np.flatnonzero((of_all >= MIN_SUPPORT) & (chi >= 12))
        chosen = chosen[np.argsort(-chi[chosen], kind="stable")[:MAX_WORDS]]
        self.words = np.sort(u[chosen])
        x = np.concatenate([self._bins(shapes), np.zeros((n, len(self.words)), np.float32)], axis=1)
        at = np.minimum(np.searchsorted(self.words, flat), max(0, len(self.words) - 1))
        if len(self.words):
            hit = self.words[at] == flat
            x[doc[hit], SHAPES * BINS + at[hit]] = 1
        self.weights, self.bias = self._fit(x, y.astype(np.float32))

    def _bins(self, shapes: np.ndarray) -> np.ndarray:
        x = np.zeros((len(shapes), SHAPES * BINS), np.float32)
        for j in range(SHAPES):
            x[np.arange(len(x)), j * BINS + np.searchsorted(self.edges[j], shapes[:, j], side="right")] = 1
        return x

    @staticmethod
    def _fit(x: np.ndarray, y: np.ndarray, steps: int = 400, rate: float = 0.05, decay: float = 2e-4):
        w, b = np.zeros(x.shape[1], np.float32), 0.0
        m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
        for t in range(1, steps + 1):  # Adam on the whole sample
            p = 1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30)))
            g = np.append(x.T @ (p - y) / len(y) + decay * w, (p - y).mean())
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            step = rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
            w, b = (w - step[:-1]).astype(np.float32), b - step[-1]
        return w, float(b)

    def logits(self, shapes: np.ndarray, doc: np.ndarray, h: np.ndarray) -> np.ndarray:
        out = (self._bins(shapes) @ self.weights[:SHAPES * BINS]).astype(np.float64) + self.bias
        if len(self.words) and len(h):
            at = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
            hit = self.words[at] == h
            out = out + np.bincount(doc[hit], weights=self.weights[SHAPES * BINS + at[hit]], minlength=len(out))[:len(out)]
        return np.clip(out, -12, 12)


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DocumentModel:
    """The document model from at most ``max_labelled`` labelled documents
    (doc_id, text; doc_id, quality, toxic)."""
    each = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.max(F.coalesce((F.col("quality") == 0) | (F.col("toxic") == 1), F.lit(False))).alias("bad"))
    sample = each.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)  # bounded, so it may be broadcast
    # of several texts of one id the smallest tells, so that every run fits the same model
    rows = docs.join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(F.min(F.col("text").cast("string")).alias("text"), F.max("bad").alias("bad"))
    rows = rows.select("text", "bad")
    got = rows.mapInArrow(_describe, "bad boolean, shapes array<double>, words array<long>").toArrow()
    lists = [pa.concat_arrays([c for c in got.column(n).chunks] or [pa.array([], pa.list_(t))])
             for n, t in (("shapes", pa.float64()), ("words", pa.int64()))]
    shapes = lists[0].flatten().to_numpy(zero_copy_only=False).reshape(-1, SHAPES)
    flat = lists[1].flatten().to_numpy(zero_copy_only=False).view(np.uint64)
    lengths = lists[1].value_lengths().to_numpy(zero_copy_only=False)
    return DocumentModel(np.array(got.column("bad").to_pylist(), bool), shapes, flat, lengths)


def _evidence(shared):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for rows, data, offsets in text_chunks(batches):
            if model.fitted:
                p = 1 / (1 + np.exp(-model.logits(*features(data, offsets))))
            else:
                p = np.full(rows.num_rows, 0.0)
            yield pa.RecordBatch.from_arrays([*(rows.column(i) for i in range(4)), pa.array(p)],
                                             ["doc_id", "text_key", "host", "path", "p_doc"])
    return score


def _strength(sites: DataFrame, mean, n, s) -> float:
    """Prior strength (as a number of documents) of rates ``s / n`` around
    ``mean``: their spread beyond what sampling explains, by moments."""
    r = sites.where(F.col(n) >= 2).agg(
        F.sum(F.col(n) * (F.col(s) / F.col(n) - mean) ** 2).alias("spread"),
        F.sum(mean * (1 - mean)).alias("chance"), F.sum(n).alias("n"), F.count(F.lit(1)).alias("k"),
        F.sum(F.col(n) * mean * (1 - mean)).alias("whole")).first()
    if not r["k"] or not r["whole"]:
        return 1e6
    between = (r["spread"] - r["chance"]) / r["n"]
    within = r["whole"] / r["n"]
    return min(1e6, max(1.0, within / between - 1)) if between > 0 else 1e6


def classify(docs: DataFrame, labels: DataFrame, host=None, path=None, id_col: str = "doc_id", text_col: str = "text",
             max_labelled: int = MAX_LABELLED) -> DataFrame:
    """One row per row of ``docs``: doc_id, text_key, host, path, p_doc
    (document evidence alone), p_site (its path without it), p_bad, kept."""
    spark = docs.sparkSession
    host = F.col("source") if host is None else host
    path = F.col("lang") if path is None else path
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(id_col, text_col).alias("text_key"),
                       host.cast("string").alias("host"), path.cast("string").alias("path"), F.col(text_col).cast("string").alias("text"))
    model = fit(rows.select("doc_id", "text"), labels, max_labelled)
    scored = write_table(compact(rows, docs).mapInArrow(
        _evidence(spark.sparkContext.broadcast(model)), "doc_id long, text_key long, host string, path string, p_doc double"), "quality-scores", docs)
    scored = scored.withColumn("__host", F.concat(F.col("host").isNull().cast("string"), F.coalesce("host", F.lit(""))))
    scored = scored.withColumn("__site", F.concat_ws("\x1f", "__host", F.col("path").isNull().cast("string"), F.coalesce("path", F.lit(""))))
    paths = write_table(scored.groupBy("__host", "__site").agg(F.count(F.lit(1)).alias("n"), F.sum("p_doc").alias("s")), "quality-paths", docs)
    hosts = paths.groupBy("__host").agg(F.sum("n").alias("host_n"), F.sum("s").alias("host_s"), F.count(F.lit(1)).alias("host_paths"))
    total = hosts.agg(F.sum("host_n"), F.sum("host_s")).first()
    mean = min(1 - 1e-6, max(1e-6, (total[1] or 0.0) / max(1, total[0] or 0)))
    k_host = _strength(hosts, F.lit(mean), "host_n", "host_s")
    hosts = hosts.withColumn("host_rate", (F.col("host_s") + k_host * mean) / (F.col("host_n") + k_host))
    sites = write_table(join_hot(paths, hosts, "__host", "host_paths", F.xxhash64("__site")).drop("__host"), "quality-sites", docs)
    k_path = _strength(sites, F.col("host_rate"), "n", "s")
    both = join_hot(scored, sites, "__site", "n", F.xxhash64("doc_id", "text_key"))
    # the document itself is left out of its host's and its path's sums
    host_rate = (F.col("host_s") - F.col("p_doc") + k_host * mean) / (F.col("host_n") - 1 + k_host)
    site = (F.col("s") - F.col("p_doc") + k_path * host_rate) / (F.col("n") - 1 + k_path)
    site = F.least(F.lit(0.95), F.greatest(F.lit(0.001), site))
    own = F.least(F.lit(1 - 1e-6), F.greatest(F.lit(1e-6), F.col("p_doc")))
    base = min(0.999, max(0.001, model.rate))
    odds = own / (1 - own) * ((1 - base) / base) * (site / (1 - site))
    p_bad = (odds / (1 + odds)) if model.fitted else F.lit(0.0)
    out = both.select("doc_id", "text_key", "host", "path", "p_doc", (site if model.fitted else F.lit(0.0)).alias("p_site"), p_bad.alias("p_bad"))
    return compact(out, docs).withColumn("kept", F.col("p_bad") < REJECT_AT)


def good_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that are kept, same columns."""
    bad = classify(docs, labels, id_col=id_col, text_col=text_col, **options).where("NOT kept")
    bad = bad.select(F.coalesce("doc_id", F.lit(0)).alias("__id"), F.col("text_key").alias("__key")).distinct()
    rows = docs.select(F.struct("*").alias("__row"), F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("__id"),
                       F.xxhash64(id_col, text_col).alias("__key"))
    return rows.join(bad, ["__id", "__key"], "left_anti").select("__row.*")


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, hosts and paths, with the labels given."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source", "lang")
    return classify(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).drop("text_key")
