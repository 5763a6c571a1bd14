"""Token ids as Simple-8b files.

Documents are dealt by range of their id and each task writes its texts' ids
in order, a file per ``FILE_IDS`` ids; an end id closes each document.  Files
of a failed attempt are named by no manifest row.

File (little-endian): magic, ids per block, counts of ids, blocks, words and
documents; word offset of every block (and the end); document ids, their
validity and the end of each document in ids; then the 64-bit words.

Simple-8b: the top four bits of a word select how many ids of how many bits
the other sixty hold (selectors 1 to 14).  Selector 15 is an escape: the next
word is one whole 64-bit value.  A block holds a fixed number of ids and starts
a new word, so blocks are found by their offset and decoded as arrays.

Words between ASCII white space are encoded once per worker and remembered:
the tokenizer drops white space and nothing it does reaches across it.

Defined results: a null text is an empty one (just the end id); documents with
a null id come first; rows of one id are ordered by the hash of their text.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import _BYTE_VALUES, LOWER, WORD_BYTES, Words, compact, open_fs, range_hashes, shared_path, table_bytes, text_chunks, write_table

END_ID = 2
BLOCK_IDS = 1024
#: Ids that one vectorised step encodes (whole blocks).
STEP_IDS = 512 * BLOCK_IDS
FILE_IDS = 4 << 20
#: Words that a worker remembers before it starts anew.
MEMORY_WORDS = 1 << 20
MAGIC = b"TOKS8B01"
_HEAD = struct.Struct("<8sIQQQQ")

#: Ids per word and bits per id, by selector.
COUNTS = np.array([0, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1, 1], np.int64)
BITS = np.array([0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60, 64], np.int64)
ESCAPE = 15
_SELECTOR = {int(n): s for s, n in enumerate(COUNTS[:15]) if s}
_SELECTORS = np.array([_SELECTOR.get(n, 0) for n in range(61)], np.int64)


# ---------------------------------------------------------------- Simple-8b

_SMALL_BITS = np.array([x.bit_length() for x in range(256)], np.uint8)


def _bit_lengths(values: np.ndarray) -> np.ndarray:
    out = _SMALL_BITS[(values & np.uint64(255)).astype(np.uint8)]
    rest, done = values >> np.uint64(8), 8
    while rest.any():  # as many rounds as the largest value has bytes
        out = np.where(rest > 0, _SMALL_BITS[(rest & np.uint64(255)).astype(np.uint8)] + np.uint8(done), out)
        rest, done = rest >> np.uint64(8), done + 8
    return out


def encode(values: np.ndarray, block: int = BLOCK_IDS) -> tuple[np.ndarray, np.ndarray]:
    """``(words, first word of each block and the end)``.  All blocks advance
    together, one word each per step."""
    n = len(values)
    blocks = -(-n // block)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(1, np.uint64)
    width = block + 60
    v = np.zeros((blocks, width), np.uint64)
    flat = np.zeros(blocks * block, np.uint64)
    flat[:n] = values
    v[:, :block] = flat.reshape(blocks, block)
    bits = _bit_lengths(v).reshape(-1)
    v = v.reshape(-1)
    ends = np.full(blocks, block)
    ends[-1] = n - (blocks - 1) * block
    base = np.arange(blocks) * width
    at, active = np.zeros(blocks, np.int64), np.arange(blocks)
    step_words, step_blocks = [], []
    while len(active):
        p = base[active] + at[active]
        take = np.ones(len(p), np.int64)
        most, fits = bits[p], np.arange(len(p))
        for k in range(2, 9):  # what does not fit k ids does not fit more
            most = np.maximum(most, bits[p[fits] + k - 1])
            ok = most <= BITS[_SELECTOR[k]]
            most, fits = most[ok], fits[ok]
            take[fits] = k
        eight = np.zeros(len(p), np.uint8)
        eight[fits] = most
        small = np.flatnonzero((take == 8) & (eight <= 6))
        if len(small):
            run = np.maximum.accumulate(bits[p[small, None] + np.arange(60)], axis=1)
            for k in (10, 12, 15, 20, 30, 60):
                take[small[run[:, k - 1] <= BITS[_SELECTOR[k]]]] = k
        selector = _SELECTORS[take]
        escape = bits[p] > 60
        selector[escape] = ESCAPE
        width_of = BITS[selector].astype(np.uint64)
        word = selector.astype(np.uint64) << np.uint64(60)
        for j in range(int(take.max())):
            on = np.flatnonzero((take > j) & ~escape)
            word[on] |= v[p[on] + j] << (width_of[on] * np.uint64(j))
        step_words.append(word)
        step_blocks.append(active)
        if escape.any():
            step_words.append(v[p[escape]])
            step_blocks.append(active[escape])
        at[active] += take
        active = active[at[active] < ends[active]]
    of = np.concatenate(step_blocks)
    order = np.argsort(of, kind="stable")
    offsets = np.zeros(blocks + 1, np.uint64)
    offsets[1:] = np.cumsum(np.bincount(of, minlength=blocks))
    return np.concatenate(step_words)[order], offsets


def decode(words: np.ndarray, offsets: np.ndarray, n: int, block: int = BLOCK_IDS) -> np.ndarray:
    """The ``n`` values of consecutive blocks; ``offsets`` as from :func:`encode`."""
    selector = (words >> np.uint64(60)).astype(np.int64)
    raw = np.zeros(len(words), bool)
    for i in np.flatnonzero(selector == ESCAPE):  # a value after an escape may look like one
        if not raw[i]:
            raw[i + 1] = True
    count = np.where(raw, 0, COUNTS[selector])
    done = np.zeros(len(words) + 1, np.int64)
    np.cumsum(count, out=done[1:])
    offsets = offsets.astype(np.int64)
    per = np.diff(offsets)
    of = np.repeat(np.arange(len(per)), per)
    start = done[:-1] - done[offsets[:-1]][of] + of * block
    end = np.minimum((of + 1) * block, n)
    out = np.zeros(n, np.uint64)
    for s in np.unique(selector[~raw]):
        i = np.flatnonzero((selector == s) & ~raw)
        if s == ESCAPE:
            out[start[i]] = words[i + 1]
            continue
        k, b = int(COUNTS[s]), int(BITS[s])
        mask = np.uint64((1 << b) - 1)
        for j in range(k):
            to = start[i] + j
            ok = to < end[i]
            out[to[ok]] = (words[i[ok]] >> np.uint64(b * j)) & mask
    return out


# ---------------------------------------------------------------- tokens

class WordEncoder:
    """Ids of texts, word by word, with the words seen so far remembered.

    A word of ASCII bytes is looked up in lower case (the tokenizer lower-cases).
    Words with other bytes are taken as they are, since the tokenizer composes
    before it lower-cases, and so are words with ``<|``, which may hold special
    tokens.  Other words are looked up without the ASCII punctuation that ends
    them after an ASCII letter (always a piece of its own).  New words are encoded many at a time, with a special token between."""

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer
        special = sorted((i, t.content) for i, t in tokenizer.get_added_tokens_decoder().items()
                         if t.special and t.content.startswith("<|") and not (t.lstrip or t.rstrip))
        self.between = special[0] if special else None
        byte = np.arange(256)
        self.letter = ((byte | 0x20) >= 0x61) & ((byte | 0x20) <= 0x7A)
        self.point = (byte > 0x20) & (byte < 0x7F) & ~self.letter & ~((byte >= 0x30) & (byte <= 0x39))
        self._forget()

    def _forget(self):
        self.known = np.zeros(0, np.uint64)  # sorted hashes
        self.first, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def _learn(self, hashes: np.ndarray, texts: list[str]) -> None:
        parts, sizes = [], []
        encode = lambda x: self.tokenizer.encode_batch_fast(x, add_special_tokens=False)
        for i in range(0, len(texts), 2000):
            some = texts[i:i + 2000]
            if self.between and not any("<|" in x for x in some):
                ids = np.array(encode([self.between[1].join(some)])[0].ids, np.uint32)
                cut = np.flatnonzero(ids == self.between[0])
                sizes.append(np.diff(np.concatenate([[-1], cut, [len(ids)]])) - 1)
                parts.append(ids[ids != self.between[0]])
            else:
                each = [e.ids for e in encode(some)]
                sizes.append(np.array([len(x) for x in each], np.int64))
                parts.append(np.array([y for x in each for y in x], np.uint32))
        sizes = np.concatenate(sizes)
        first = np.cumsum(sizes) - sizes + len(self.ids)
        self.ids = np.concatenate([self.ids, *parts])
        order = np.argsort(np.concatenate([self.known, hashes]), kind="stable")
        self.known = np.concatenate([self.known, hashes])[order]
        self.first, self.size = np.concatenate([self.first, first])[order], np.concatenate([self.size, sizes])[order]

    def _find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.known):
            return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
        at = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
        return at, self.known[at] == hashes

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts and the number of ids of each."""
        words = Words(data, offsets, WORD_BYTES, False)
        if not len(words.starts):
            return np.zeros(0, np.uint32), np.zeros(len(offsets) - 1, np.int64)
        starts, ends = words.starts, words.ends
        marker = np.zeros(len(data) + 1, np.int32)
        np.cumsum((data == 0x7C) & np.concatenate([[False], data[:-1] == 0x3C]), out=marker[1:])
        plain = marker[ends] == marker[starts]
        beyond = np.zeros(len(data) + 1, np.int32)
        np.cumsum(data >= 0x80, out=beyond[1:])
        folds = plain & (beyond[ends] == beyond[starts])
        core = np.maximum.accumulate(np.where(self.point[data], -1, np.arange(len(data))))[ends - 1] + 1  # after the last other byte
        cut = plain & (core < ends) & (core > starts) & self.letter[data[core - 1]]
        # pieces: every word, then the punctuation that was cut off
        at = np.concatenate([[0], np.cumsum(1 + cut)])
        p_start, p_end = np.empty(at[-1], np.int64), np.empty(at[-1], np.int64)
        p_start[at[:-1]], p_end[at[:-1]] = starts, np.where(cut, core, ends)
        marks = at[:-1][cut] + 1
        p_start[marks], p_end[marks] = core[cut], ends[cut]
        low = LOWER[data]
        h = range_hashes(_BYTE_VALUES[low], p_start, p_end)
        odd = at[:-1][~folds]
        if len(odd):  # their own hashes, of the bytes as they are
            h[odd] = range_hashes(_BYTE_VALUES[data], p_start[odd], p_end[odd]) ^ np.uint64(0x5555555555555555)
        code, unique = pd.factorize(h)
        order = np.argsort(unique)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        unique = unique[order]
        found, known = self._find(unique)
        if not known.all():
            if len(self.known) + np.count_nonzero(~known) > MEMORY_WORDS:
                self._forget()
                known[:] = False
            where = np.empty(len(unique), np.int64)
            where[place[code[::-1]]] = np.arange(len(code))[::-1]
            fresh = np.flatnonzero(~known)
            w = where[fresh]
            source = np.isin(w, odd)
            raw, lowered = data.tobytes(), low.tobytes()
            texts = [(raw if o else lowered)[a:b].decode(errors="replace")
                     for o, a, b in zip(source.tolist(), p_start[w].tolist(), p_end[w].tolist())]
            self._learn(unique[fresh], texts)
            found, _ = self._find(unique)
        no = found[place][code]
        first, size = self.first[no], self.size[no]
        total = np.concatenate([[0], np.cumsum(size)])
        ids = self.ids[np.repeat(first - total[:-1], size) + np.arange(total[-1])]
        return ids, np.diff(total[at[words.doc]])


_encoders: dict[int, WordEncoder] = {}


def _encoder(source: str) -> WordEncoder:
    key = hash(source)
    if key not in _encoders:
        from tokenizers import Tokenizer
        _encoders.clear()
        _encoders[key] = WordEncoder(Tokenizer.from_str(source))
    return _encoders[key]


# ---------------------------------------------------------------- files

def file_bytes(ids: np.ndarray, doc_ids: list, ends: np.ndarray) -> bytes:
    words, offsets = [], [np.zeros(1, np.uint64)]
    for at in range(0, len(ids), STEP_IDS):  # blocks are independent, so a part of them at a time
        w, o = encode(ids[at:at + STEP_IDS].astype(np.uint64))
        words.append(w)
        offsets.append(o[1:] + offsets[-1][-1])
    words, offsets = np.concatenate([*words, np.zeros(0, np.uint64)]), np.concatenate(offsets)
    valid = np.array([x is not None for x in doc_ids], np.uint8)
    docs = np.array([x or 0 for x in doc_ids], "<i8")
    head = _HEAD.pack(MAGIC, BLOCK_IDS, len(ids), len(offsets) - 1, len(words), len(docs))
    return b"".join([head, offsets.astype("<u8").tobytes(), docs.tobytes(), valid.tobytes(), ends.astype("<u8").tobytes(),
                     words.astype("<u8").tobytes()])


class TokenFile:
    """A file's index, with its blocks read on demand."""

    def __init__(self, uri: str):
        fs, path = open_fs(uri)
        self.file = fs.open_input_file(path)
        magic, self.block, self.n_ids, blocks, self.n_words, docs = _HEAD.unpack(self.file.read_at(_HEAD.size, 0))
        if magic != MAGIC:
            raise ValueError(f"not a token file: {uri}")
        index = self.file.read_at(8 * (blocks + 1) + 17 * docs, _HEAD.size)
        self.offsets = np.frombuffer(index, "<u8", blocks + 1)
        at = 8 * (blocks + 1)
        ids = np.frombuffer(index, "<i8", docs, at)
        valid = np.frombuffer(index, np.uint8, docs, at + 8 * docs)
        self.doc_ids = [int(x) if ok else None for x, ok in zip(ids, valid)]
        self.ends = np.frombuffer(index, "<u8", docs, at + 9 * docs).astype(np.int64)
        self.words_at = _HEAD.size + len(index)

    def read(self, start: int, stop: int) -> np.ndarray:
        """Ids ``start`` to ``stop``, from the blocks they lie in."""
        if stop <= start:
            return np.zeros(0, np.uint32)
        a, b = start // self.block, -(-stop // self.block)
        lo, hi = int(self.offsets[a]), int(self.offsets[b])
        words = np.frombuffer(self.file.read_at(8 * (hi - lo), self.words_at + 8 * lo), "<u8")
        n = min(self.n_ids, b * self.block) - a * self.block
        got = decode(words, self.offsets[a:b + 1] - np.uint64(lo), n, self.block)
        return got[start - a * self.block:stop - a * self.block].astype(np.uint32)


def _writer(folder: str, tokenizer):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer.value)
        fs, base = open_fs(folder)
        fs.create_dir(base, recursive=True)
        part, seq = TaskContext.get().partitionId(), 0
        held, docs, sizes, total = [], [], [], 0

        def flush():
            name = f"part-{part:06d}-{seq:06d}-{uuid.uuid4().hex}.s8b"
            with fs.open_output_stream(f"{base}/{name}", compression=None) as f:
                f.write(file_bytes(np.concatenate(held), docs, np.cumsum(np.concatenate(sizes))))
            return pa.RecordBatch.from_arrays(
                [pa.array([f"{folder}/{name}"]), pa.array([part], pa.int64()), pa.array([seq], pa.int64()),
                 pa.array([total], pa.int64()), pa.array([len(docs)], pa.int64())], ["file", "part", "seq", "n_ids", "n_docs"])

        for rows, data, offsets in text_chunks(batches, size=1 << 20):
            ids, n = encoder.encode(data, offsets)
            end = np.cumsum(n + 1)  # with the end id of each document
            out = np.full(len(ids) + len(n), END_ID, np.uint32)
            put = np.ones(len(out), bool)
            put[end - 1] = False
            out[put] = ids
            held.append(out)
            sizes.append(n + 1)
            docs += rows.column(0).to_pylist()
            total += len(out)
            if total >= FILE_IDS:
                yield flush()
                held, docs, sizes, total, seq = [], [], [], 0, seq + 1
        if docs:
            yield flush()
    return write


def write_tokens(docs: DataFrame, folder: str, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write all texts' ids below ``folder``; returns the manifest: file,
    n_ids, n_docs and start (ids in all files before it)."""
    spark = docs.sparkSession
    with open(tokenizer_file, encoding="utf-8") as f:
        source = spark.sparkContext.broadcast(f.read())
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    ranges = max(2, table_bytes(docs) >> 24)
    written = write_table(rows.repartitionByRange(ranges, *order).sortWithinPartitions(*order).mapInArrow(
        _writer(folder, source), "file string, part long, seq long, n_ids long, n_docs long"), "token-files")
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    return written.select("file", "n_ids", "n_docs", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("start"))


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for uri, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            f = TokenFile(uri)
            begins = np.concatenate([[0], f.ends[:-1]]).astype(np.int64)
            crc = [0] * len(begins)
            for at in range(0, f.n_ids, STEP_IDS):
                ids = f.read(at, min(f.n_ids, at + STEP_IDS)).astype("<u4")
                first, last = np.searchsorted(f.ends, [at, at + len(ids)], side="right")
                for i in range(first, min(last + 1, len(begins))):  # a document goes on where the last step left it
                    a, b = max(begins[i] - at, 0), min(f.ends[i] - at, len(ids))
                    crc[i] = zlib.crc32(ids[a:b].tobytes(), crc[i])
            yield pa.RecordBatch.from_arrays(
                [pa.array(f.doc_ids, pa.int64()), pa.array(begins + start, pa.int64()), pa.array(f.ends - begins, pa.int64()),
                 pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def read_tokens(manifest: DataFrame) -> DataFrame:
    """One row per document from the files: doc_id, start, n_tokens, ids_crc32."""
    files = manifest.select("file", "start")
    n = max(manifest.sparkSession.sparkContext.defaultParallelism, table_bytes(manifest) >> 10)  # several files a task
    return files.repartition(n, "file").mapInArrow(_reader, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_table(docs: DataFrame, tokenizer_file: str | None = None) -> DataFrame:
    """All texts through token files and back."""
    if tokenizer_file is None:
        import public_tokenizers
        tokenizer_file = public_tokenizers.path("word_bpe_49k.json")
    manifest = write_tokens(docs, shared_path(docs.sparkSession, "tokens"), tokenizer_file)
    return compact(read_tokens(manifest), docs)


def op10_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as token files, read back."""
    return token_table(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
