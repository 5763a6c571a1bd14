"""Overlap resolution (span merge) as a per-row array fold.

Candidates are sorted by (start asc, end desc, detector rank, rule rank) --
a total order equal to a stable sort of the detectors' output by
(start, -end).  The fold keeps a list of disjoint spans in start order; every
new span starts no earlier than all kept ones, so only the *last* kept span can
overlap it.  On overlap: structured beats unstructured; within the same class
the larger (confidence, length) wins and a tie keeps the earlier span.  The
fold is not "best per cluster": a replaced winner has already eliminated
others, exactly like the sequential rule.

Runs inside each document row: no shuffle.  The sorted candidates are cut into
islands that no span crosses and each island is folded by itself, so the cost
of a document with thousands of matches stays near linear.  The accumulator
carries the island's finished spans plus the current last span, so each step
compares one pair.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.spans import CAND_T, empty_array, islands
from .rules import STRUCTURED_TYPES

_STRUCT_LIST = sorted(STRUCTURED_TYPES)


def overlaps(a: Column, b: Column) -> Column:
    """M2: half-open intervals overlap."""
    return ~((a["end"] <= b["start"]) | (b["end"] <= a["start"]))


def is_structured(s: Column, structured: list[str] | None = None) -> Column:
    return s["type"].isin(structured or _STRUCT_LIST)


def _wins(s: Column, k: Column, structured: list[str] | None) -> Column:
    ss, ks = is_structured(s, structured), is_structured(k, structured)
    sl, kl = s["end"] - s["start"], k["end"] - k["start"]
    same = (s["confidence"] > k["confidence"]) | ((s["confidence"] == k["confidence"]) & (sl > kl))
    return F.when(ss != ks, ss).otherwise(same)


def sort_candidates(cands: Column) -> Column:
    """Order by (start asc, end desc, detector, rule) using Spark's natural
    struct ordering on a key struct (no interpreted comparator)."""
    keyed = F.transform(cands, lambda c: F.struct(c["start"].alias("a"),
                                                  (-c["end"]).alias("b"), c["det"].alias("c"),
                                                  c["rule"].alias("d"), c.alias("v")))
    return F.transform(F.array_sort(keyed), lambda k: k["v"])


def merge_spans(cands: Column, structured: list[str] | None = None) -> Column:
    """M1: array<CAND_T> (any order) -> disjoint kept spans in start order."""
    ordered = sort_candidates(cands)
    none = F.lit(None).cast(CAND_T)
    init = F.struct(empty_array(CAND_T).alias("kept"), none.alias("last"))

    def step(acc, s):
        last = acc["last"]
        return (F.when(last.isNull(), F.struct(acc["kept"].alias("kept"), s.alias("last")))
                .when(~overlaps(last, s), F.struct(F.concat(acc["kept"], F.array(last)).alias("kept"),
                                                   s.alias("last")))
                .when(_wins(s, last, structured), F.struct(acc["kept"].alias("kept"), s.alias("last")))
                .otherwise(acc))

    def finish(acc):
        return F.when(acc["last"].isNull(), acc["kept"]).otherwise(F.concat(acc["kept"], F.array(acc["last"])))

    merged = F.flatten(F.transform(islands(ordered), lambda island: F.aggregate(island, init, step, finish)))
    # A single candidate (the common case) needs no fold.
    return F.when(F.size(cands) <= 1, F.coalesce(cands, empty_array(CAND_T))).otherwise(merged)


def confidence_floor(spans: Column, min_confidence: float | Column | None) -> Column:
    """M4: optional floor, off by default (the reference declares but never
    applies it)."""
    if min_confidence is None:
        return spans
    m = min_confidence if isinstance(min_confidence, Column) else F.lit(float(min_confidence))
    return F.filter(spans, lambda s: s["confidence"] >= m)


def with_merged(df: DataFrame, cand_cols: list[str], out_col: str = "spans",
                min_confidence: float | None = None, structured: list[str] | None = None) -> DataFrame:
    cands = F.concat(*[F.coalesce(F.col(c), empty_array(CAND_T)) for c in cand_cols])
    df = df.withColumn("__cands", confidence_floor(cands, min_confidence))
    return df.withColumn(out_col, merge_spans(F.col("__cands"), structured)).drop("__cands")
