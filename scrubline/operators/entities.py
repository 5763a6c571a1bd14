"""Named-entity detectors: a caller-supplied model (E1/E2) and dictionary
matching (E3).  Both produce the same candidate contract as the regex rules.

Model scoring is the one place Python runs per batch: ``mapInPandas`` feeds
Arrow batches to a scorer that is loaded once per task.  Label mapping and
confidence filtering happen back in the JVM.

Dictionary matching finds every word of a document and tests it against a Bloom
filter of the words that begin a term, where the document is, in Arrow batches;
n-grams are cut only where it answers, and joined to the terms.  Nothing of the
dictionary but the filter's bits and the terms' lengths reaches the driver.
"""

from __future__ import annotations

from functools import lru_cache
from typing import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.spans import CAND_T, empty_array, explode_rows, no_action
from ..session import balance
from .detect import DET_MODEL
from .merge import merge_spans

# Model label -> entity type (unlisted labels are dropped) and
# the fixed confidence of model spans.
LABEL_MAP = {"PERSON": "PERSON", "ORG": "ORG", "GPE": "LOC", "LOC": "LOC", "DATE": "DATE"}
MODEL_CONFIDENCE = 0.99

RAW_T = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()),
                                  T.StructField("label", T.StringType())]))

Scorer = Callable[[list], list]   # texts -> per text list of (start, end, label)


def model_entities(df: DataFrame, load_scorer: Callable[[], Scorer], text_col: str = "text",
                   out_col: str = "model_cands", min_confidence: float = 0.0,
                   label_map: dict | None = None) -> DataFrame:
    """E1 + E2.  ``load_scorer()`` runs once per task and returns a function
    mapping a list of texts to, per text, ``(start, end, label)`` tuples."""
    label_map = LABEL_MAP if label_map is None else label_map
    raw_col = "__raw_ents"
    schema = T.StructType(df.schema.fields + [T.StructField(raw_col, RAW_T)])

    def run(batches: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        scorer = load_scorer()
        for pdf in batches:
            texts = pdf[text_col].fillna("").tolist()
            ents = scorer(texts)
            pdf[raw_col] = [[{"start": int(s), "end": int(e), "label": str(lab)} for (s, e, lab) in row]
                            for row in ents]
            yield pdf

    out = df.mapInPandas(run, schema)
    lm = F.create_map(*[F.lit(x) for kv in sorted(label_map.items()) for x in kv])
    text = F.col(text_col)
    mapped = F.transform(F.filter(raw_col, lambda r: F.element_at(lm, r["label"]).isNotNull()), lambda r: F.struct(
        r["start"].alias("start"), r["end"].alias("end"),
        F.substr(text, r["start"] + 1, r["end"] - r["start"]).alias("text"),
        F.element_at(lm, r["label"]).alias("type"), F.lit(MODEL_CONFIDENCE).alias("confidence"),
        F.lit(DET_MODEL).alias("det"), F.lit(0).alias("rule"), no_action()))
    if MODEL_CONFIDENCE < min_confidence:
        mapped = empty_array(CAND_T)
    return out.withColumn(out_col, mapped).drop(raw_col)


# ---------------------------------------------------------------- dictionary
# A token: letters/digits, optionally joined by one of # ' . & - inside.
LETTER_RE, JOINERS = r"[\p{L}\p{N}]", "#'.&-"
TOKEN_RE = LETTER_RE + r"+(?:[#'.&\-]" + LETTER_RE + "+)*"
DICT_CONFIDENCE = 0.9
#: 64-bit words of the first-word filter per first word of the dictionary, and
#: the most it may have: 16 MB, however large the dictionary.
BLOOM_SLOTS_PER_WORD, BLOOM_MAX_SLOTS = 4, 1 << 21
#: Bits that a word sets in its slot; a word in no term passes with about 1e-5
#: until the most slots are reached, with about 1e-3 at three words a slot.
BLOOM_BITS = 4
#: Characters whose words are found at once; a longer text is taken alone.
TOKEN_CHARS = 1 << 18
#: Base of the word hash and its inverse modulo 2^64.
HASH_BASE = 0x9E3779B97F4A7C15
HASH_INVERSE = pow(HASH_BASE, -1, 1 << 64)

GRAM_T = "array<struct<start:int,end:int,text:string>>"


def normalise_term(c: Column) -> Column:
    return F.lower(F.regexp_replace(F.trim(c), r"[\t\n\x0B\f\r ]+", " "))


@lru_cache(maxsize=1)
def letter_table(spark: SparkSession) -> np.ndarray:
    """What a code point is in ``TOKEN_RE``, as Spark's own regex and ``lower``
    see it: the lower-case code point of a letter or digit, a joiner negated, 0."""
    char = F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32")
    some = (spark.range(0x110000).where("id NOT BETWEEN 55296 AND 57343").select("id", char.alias("c"))
            .where(F.col("c").rlike(LETTER_RE)).select("id", F.ascii(F.lower("c")).alias("lower")).toArrow())
    table = np.zeros(0x110000, np.int32)
    table[some["id"].to_numpy()] = some["lower"].to_numpy()
    table[ord("ς")] = table[ord("σ")]  # which of them a capital becomes depends on its place
    joiners = [ord(c) for c in JOINERS]
    table[joiners] = np.negative(joiners)
    return table


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, ...]:
    return tuple(np.multiply.accumulate(np.full(n, x, np.uint64)) for x in (HASH_BASE, HASH_INVERSE))


def find_tokens(texts: list[str], letters: np.ndarray) -> tuple[np.ndarray, ...]:
    """Matches of ``TOKEN_RE``: starts and ends in the texts joined by a newline,
    and a hash of each lower-cased word (differences of a running sum of
    ``code * HASH_BASE ** place``, moved to place 0)."""
    v = letters[np.frombuffer("\n".join(["", *texts, ""]).encode("utf-32-le"), "<u4")]
    inside = v > 0
    inside[1:-1] |= (v[1:-1] < 0) & inside[:-2] & inside[2:]
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    start, end = edges[::2], edges[1::2]
    power, back = _powers(1 << len(v).bit_length())
    sums = np.cumsum(v.astype(np.uint64) * power[:len(v)])
    h = (sums[end - 1] - sums[start - 1]) * back[start]
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return start - 1, end - 1, h ^ (h >> np.uint64(32))


def _text_chunks(texts: pa.Array) -> Iterator[list[str]]:
    """The texts in order, some ``TOKEN_CHARS`` bytes at a time; null is empty."""
    texts = texts.cast(pa.binary())
    ends = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(), dtype=np.int64)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + TOKEN_CHARS, side="right")))
        yield ["" if t is None else t.decode("utf-8", "replace") for t in texts.slice(at, to - at).to_pylist()]
        at = to


def _word_hash(letters):
    """Arrow function: the hash of a word, null if there is none."""
    def hashes(words: pa.Array) -> pa.Array:
        out, none = [np.empty(0, np.int64)], [np.empty(0, bool)]
        for some in _text_chunks(words):
            start, _, h = find_tokens(some, letters.value)
            own = np.searchsorted(np.cumsum([0, *(len(t) + 1 for t in some)]), start, side="right") - 1
            out.append(np.zeros(len(some), np.int64))
            none.append(np.ones(len(some), bool))
            out[-1][own], none[-1][own] = h.view(np.int64), False
        return pa.array(np.concatenate(out), mask=np.concatenate(none))
    hashes.__annotations__ = {"words": pa.Array, "return": pa.Array}
    return F.arrow_udf(hashes, "long")


def first_word_filter(begins: DataFrame, slots: int, letters) -> np.ndarray:
    """A blocked Bloom filter: each slot is aggregated where its words are, and
    what the driver gathers is slots, ``BLOOM_MAX_SLOTS`` at most."""
    h = begins.select(_word_hash(letters)("word").alias("h"))
    mask = None
    for k in range(BLOOM_BITS):
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned("h", 6 * k).bitwiseAND(63).cast("int"))
        mask = bit if mask is None else mask.bitwiseOR(bit)
    some = h.groupBy(F.shiftrightunsigned("h", 24).bitwiseAND(slots - 1).alias("slot")).agg(F.bit_or(mask).alias("bits")).where("slot IS NOT NULL").toArrow()
    table = np.zeros(slots, np.int64)
    table[some["slot"].to_numpy()] = some["bits"].to_numpy()
    return table.view(np.uint64)


def _grams(shared, letters, lengths: list[int]):
    """Arrow function: of a text, the n-grams of the dictionary's lengths at the
    words that the filter answers to."""
    def grams(texts: pa.Array) -> pa.Array:
        table, counts, parts = shared.value, [], []
        for some in _text_chunks(texts):
            begin = np.cumsum([0, *(len(t) + 1 for t in some)])
            start, end, h = find_tokens(some, letters.value)
            slot = table[(h >> np.uint64(24)) & np.uint64(len(table) - 1)]
            ok = np.ones(len(h), bool)
            for k in range(BLOOM_BITS):
                ok &= ((slot >> ((h >> np.uint64(6 * k)) & np.uint64(63))) & np.uint64(1)).astype(bool)
            at = np.flatnonzero(ok)
            own = np.searchsorted(begin, start[at], side="right") - 1
            last = (np.searchsorted(start, begin[1:]) - 1)[own][:, None] - (np.array(lengths) - 1)
            which, n = np.nonzero(at[:, None] <= last)
            own, a, b = own[which], start[at[which]], end[at[which] + np.array(lengths, int)[n] - 1]
            a, b = a - begin[own], b - begin[own]
            counts.append(np.bincount(own, minlength=len(some)))
            parts.append((a, b, [some[o][x:y] for o, x, y in zip(own.tolist(), a.tolist(), b.tolist())]))
        starts, ends = (np.concatenate([np.empty(0, int), *(p[i] for p in parts)]) for i in (0, 1))
        found = pa.StructArray.from_arrays([pa.array(starts, pa.int32()), pa.array(ends, pa.int32()),
                                            pa.array([t for p in parts for t in p[2]], pa.string())], ["start", "end", "text"])
        return pa.ListArray.from_arrays(pa.array(np.cumsum(np.concatenate([[0], *counts])), pa.int32()), found)
    grams.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(grams, GRAM_T)


def dictionary_entities(df: DataFrame, dictionary: DataFrame, text_col: str = "text",
                        out_col: str = "dict_cands", key_cols: list[str] | None = None) -> DataFrame:
    """Dictionary ``(term, type)`` matched against word n-grams,
    case-insensitively, longest match first (the merge fold keeps the longer
    of two overlapping matches).  A term of several types has the first of
    them in sorted order; terms may have any number of words.

    One path for any dictionary size.  A Bloom filter of the first words is
    tested on each document's words (in Arrow batches), so a document without
    any costs one pass over its characters, and a word that begins no term is
    never exploded.  Where it answers, n-grams of the dictionary's lengths are
    cut and joined to the terms by their normalised text; hits go back to their
    document by its keys and its text's hash.  A filter too full to tell (beyond
    ``BLOOM_MAX_SLOTS``) only lets more n-grams through.
    """
    keys, spark = key_cols or ["doc_id"], df.sparkSession
    terms = balance(dictionary).select(normalise_term(F.col("term")).alias("term"), F.col("type"))
    tokens = F.regexp_extract_all("term", F.lit(TOKEN_RE), 0)
    begins = terms.select("term", F.size(tokens).alias("n"), F.get(tokens, F.lit(0)).alias("word"))
    # No filter: it would be moved to where the dictionary is read, in as few tasks as it has files.
    begins = begins.select(*[F.when(F.startswith("term", "word"), F.col(c)).alias(c) for c in ("n", "word")])
    size = begins.agg(F.approx_count_distinct("word"), F.collect_set("n")).first()
    if not size[1]:
        return df.withColumn(out_col, empty_array(CAND_T))
    slots = min(BLOOM_MAX_SLOTS, 1 << (BLOOM_SLOTS_PER_WORD * size[0]).bit_length())
    letters = spark.sparkContext.broadcast(letter_table(spark))
    table = spark.sparkContext.broadcast(first_word_filter(begins.select("word"), slots, letters))

    same = [*keys, "__text_hash"]  # rows of one key may have other texts
    df = df.withColumn("__text_hash", F.xxhash64(text_col))
    found = df.select(*same, _grams(table, letters, sorted(size[1]))(text_col).alias("__grams"))
    # The keys travel in the grams: tests for null keys stay above, so both uses of df read alike and share its shuffles.
    grams = F.transform("__grams", lambda g: F.struct(*same, g["start"].alias("start"), g["end"].alias("end"), g["text"].alias("text")))
    rows = explode_rows(found, grams, [], "g").select("g.*").withColumn("term", normalise_term(F.col("text")))
    hits = rows.join(terms.groupBy("term").agg(F.min("type").alias("type")), "term").select(*same, F.struct(
        "start", "end", "text", "type", F.lit(DICT_CONFIDENCE).alias("confidence"), F.lit(DET_MODEL).alias("det"), F.lit(0).alias("rule"),
        no_action()).alias("__hit"))
    out = df.join(hits.groupBy(*same).agg(F.collect_list("__hit").alias("__hits")), same, "left")
    out = out.withColumn("__hits", F.coalesce("__hits", empty_array(CAND_T)))
    return out.withColumn(out_col, merge_spans(F.col("__hits"))).drop("__hits", "__text_hash")


def regex_scorer(patterns: list[tuple[str, str]]) -> Callable[[], Scorer]:
    """A stand-in scorer for tests and demos: every match of each (Python
    regex, label) pair.  Real deployments pass their model's loader."""
    def load() -> Scorer:
        import re
        rxs = [(re.compile(p), lab) for p, lab in patterns]
        return lambda texts: [[(m.start(), m.end(), lab) for rx, lab in rxs for m in rx.finditer(t)]
                              for t in texts]
    return load
