"""Helpers shared by the operators: tables written to the shared folder,
salted group lookups, file access from tasks, and vectorised word hashing over
Arrow string buffers."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

#: Rows of a key are dealt to this many salts before they are counted or joined.
SALTS = 64
#: Bytes of text that one vectorised step works on (longer single texts are one step).
CHUNK_BYTES = 1 << 18


# ---------------------------------------------------------------- tables

def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def table_bytes(df: DataFrame) -> int:
    """Size of a table: what the optimizer knows of a scan (file sizes), or
    for rows of unknown size the bytes of their strings.  Only used to choose
    partition counts, never a result."""
    n = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if n < 1 << 60:
        return n
    wide = [F.coalesce(F.octet_length(f.name), F.lit(0)) if f.dataType.typeName() in ("string", "binary") else F.lit(8)
            for f in df.schema]
    return int(df.agg(F.sum(sum(wide, F.lit(0)).cast("long"))).first()[0] or 0)


def compact(df: DataFrame, source: DataFrame) -> DataFrame:
    """Fewer, fuller partitions for rows that come from ``source``: four per
    core, or one per 64 MB of the source where that is more.  No shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.coalesce(max(4 * cores, table_bytes(source) >> 26))


def write_table(df: DataFrame, name: str, source: DataFrame | None = None, row_group: int = 128 << 20) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: lineage
    ends there, and a lost executor costs no upstream work.  ``source`` is the
    table whose size bounds the number of files, ``row_group`` the bytes that
    writers and readers hold at once (for tables of long rows)."""
    path = shared_path(df.sparkSession, name)
    (df if source is None else compact(df, source)).write.option("parquet.block.size", row_group).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def join_hot(rows: DataFrame, table: DataFrame, key: str, count: str, spread_by: Column) -> DataFrame:
    """``rows`` inner-joined with ``table`` (unique ``key``, ``count`` its rows
    in ``rows``), with hot keys dealt to ``SALTS`` join keys.  A key is hot
    with more than 1/4096 of all counts, so at most 4096 keys are broadcast."""
    limit = (table.agg(F.sum(count)).first()[0] or 0) / 4096
    hot = table.where(F.col(count) > limit).select(key, F.lit(True).alias("__hot"))
    salt = F.when(F.col("__hot"), F.pmod(spread_by, F.lit(SALTS))).otherwise(F.lit(0)).cast("int")
    left = rows.join(F.broadcast(hot), key, "left").withColumn("__salt", salt).drop("__hot")
    salts = F.when(F.col(count) > limit, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return left.join(table.withColumn("__salt", F.explode(salts)), [key, "__salt"]).drop("__salt")


def group_rows(rows: DataFrame, key: list[str], salt_by: Column, aggs: list[tuple[str, str, Column]]) -> DataFrame:
    """Give every row the totals of its group, without bringing a group
    together: ``rows`` plus one column per ``(name, merge, column)``, where
    ``merge`` names the function (``max``, ``min``, ``sum``) that both makes
    and merges partial results.

    Rows are first reduced per (key, salt), then per key; a row finds its
    group by (key, salt), so a key with a third of all rows is spread over
    ``SALTS`` join keys.  Keys must not be null.
    """
    salted = rows.withColumn("__salt", F.pmod(salt_by, F.lit(SALTS)).cast("int"))
    part = salted.groupBy(*key, "__salt").agg(*[getattr(F, m)(c).alias(n) for n, m, c in aggs])
    whole = part.groupBy(*key).agg(*[getattr(F, m)(n).alias(n) for n, m, _ in aggs])
    lookup = part.select(*key, "__salt").join(whole, key)
    return salted.join(lookup, [*key, "__salt"]).drop("__salt")


# ---------------------------------------------------------------- files

def open_fs(uri: str):
    """``(filesystem, path)`` of a URI, for use inside tasks."""
    from pyarrow import fs
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


# ---------------------------------------------------------------- words

def _mask(keep) -> np.ndarray:
    t = np.zeros(256, bool)
    t[[b for b in range(256) if keep(b)]] = True
    return t


#: Bytes of words ``[^\x20\x09-\x0D]+`` and of words
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``; in UTF-8 no byte of a longer code point
#: is below 0x80, so bytes decide.
WORD_BYTES = _mask(lambda b: not (b == 0x20 or 0x09 <= b <= 0x0D))
ALNUM_BYTES = _mask(lambda b: b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

_BASE = 0x9E3779B97F4A7C15 | 1
_MOD = 1 << 64


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finalizer (in place on a fresh array)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE_VALUES = mix((np.arange(1, 257, dtype=np.uint64)) * np.uint64(_BASE))
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64, at least n of each."""
    got = _powers.get(base)
    if got is None or len(got[0]) < n:
        size = max(n, CHUNK_BYTES + 4096)
        tables = []
        for b in (base, pow(base, -1, _MOD)):
            p = np.ones(size, np.uint64)
            p[1:] = np.uint64(b)
            tables.append(np.multiply.accumulate(p))
        got = _powers[base] = (tables[0], tables[1])
    return got


def range_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = _BASE) -> np.ndarray:
    """64-bit hashes of ``values[s:e]`` for each range, from prefix sums of
    ``value * base**i`` (equal ranges have equal hashes wherever they are)."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    power, inverse = _power_tables(base, len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * power[:len(values)], out=sums[1:])
    h = (sums[ends] - sums[starts]) * inverse[starts]
    return mix(h + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


class Words:
    """The words of several texts: byte ranges in ``data`` (after lower-casing
    if asked), 64-bit hashes, and ``doc`` with the first word of each text
    (one more entry at the end)."""

    __slots__ = ("data", "starts", "ends", "doc", "_hashes")

    def __init__(self, data: np.ndarray, offsets: np.ndarray, keep: np.ndarray, lower: bool):
        self.data = LOWER[data] if lower else data
        inside = np.zeros(len(data) + 2, bool)
        inside[1:-1] = keep[self.data]
        begin, end = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
        cut = offsets[(offsets > 0) & (offsets < len(data))]  # a word never spans two texts
        begin[cut] |= inside[1:-1][cut]
        end[cut - 1] |= inside[1:-1][cut - 1]
        self.starts = np.flatnonzero(begin)
        self.ends = np.flatnonzero(end) + 1
        self.doc = np.searchsorted(self.starts, offsets)
        self._hashes = None

    @property
    def hashes(self) -> np.ndarray:
        if self._hashes is None:
            self._hashes = range_hashes(_BYTE_VALUES[self.data], self.starts, self.ends)
        return self._hashes

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Start words and hashes of all runs of ``k`` words within one text."""
        n = len(self.starts)
        if n < k:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        ok = np.zeros(n + 1, np.int64)
        lo, hi = self.doc[:-1], self.doc[1:] - k + 1
        some = hi > lo
        np.add.at(ok, lo[some], 1)
        np.add.at(ok, hi[some], -1)
        at = np.flatnonzero(np.cumsum(ok)[:n] > 0)
        return at, range_hashes(self.hashes, at, at + k)


def text_chunks(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = CHUNK_BYTES
                ) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of Arrow batches of about ``size`` bytes of text (at least one
    row), each with its text bytes and their n + 1 offsets.  Null is empty."""
    for whole in batches:
        if not whole.num_rows:
            continue
        col = whole.column(whole.schema.get_field_index(column))
        if pa.types.is_large_string(col.type) or pa.types.is_string(col.type):
            pass
        else:
            col = col.cast(pa.string())
        wide = pa.types.is_large_string(col.type)
        _, offs, data = col.buffers()
        offs = np.frombuffer(offs, np.int64 if wide else np.int32)[col.offset:col.offset + len(col) + 1].astype(np.int64)
        data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        at = 0
        while at < len(col):
            to = max(at + 1, int(np.searchsorted(offs, offs[at] + size, side="right")) - 1)
            to = min(to, len(col))
            yield whole.slice(at, to - at), data[offs[at]:offs[to]], offs[at:to + 1] - offs[at]
            at = to


def lengths_to_list(values: np.ndarray, lengths: np.ndarray, type_: pa.DataType) -> pa.Array:
    """A list array from flat values and the length of each list."""
    offs = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offs[1:])
    return pa.ListArray.from_arrays(pa.array(offs, pa.int32()), pa.array(values, type_))
