"""MinHash near-dedup with b-bit signatures.

1. Each text's set of five-word shingles (hashed) gives ``BANDS * ROWS``
   minima.  Rows of a band make its bucket key; the two low bits of every
   minimum are packed into three longs, the signature.  Texts with equal sets
   are one class, named by their smallest id.
2. Candidates come from buckets without listing their pairs: first every
   member with the bucket's smallest class (a star).  Candidates whose
   signature similarity, counted on bits and corrected for chance collisions,
   is far below the threshold are left out; the rest are confirmed on the full
   sets, and confirmed links are joined to components.
3. Buckets that still hold several components get waves: every member names
   its most similar members of other components, by a signature of 1024
   minima, and they are confirmed in turn.
   The last wave names all that are left, so no link between different
   components of a bucket is lost.  A bucket of one component needs no more
   links.  Large buckets of several components are split by the bands after
   theirs, and what is still large is dealt: members to blocks by hash, and
   each pair of blocks is a group of its own.

Members, pairs and links are tables throughout.  A task holds two blocks'
signatures (about ``SPLIT_BUCKET`` members each) with the pairs refused
between them, or one text's sets at a time.

A pair at the threshold of 0.85 misses all 24 bands of 4 rows with a
probability of 2e-8, and shares fewer than the two bands that a split needs
with 6e-7; one of at least 0.85 is estimated below ``ESTIMATE`` with about 1e-8.

Defined results: texts without words have an empty set, are linked with
nothing and are their own component; rows of one id are one node, so an id of
several texts links what each of them links; rows with a null id are linked with nothing, have a null
component and are kept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import WORD_BYTES, Words, compact, join_hot, lengths_to_list, mix, range_hashes, table_bytes, text_chunks, write_table

SHINGLE = 5
LINK_PERCENT = 85
BANDS, ROWS = 24, 4
ESTIMATE = 0.6
#: In waves signatures are longer: their estimate is below ``LONG_ESTIMATE``
#: for a link with a probability of about 1e-7.
LONG_MINIMA, LONG_ESTIMATE = 1024, 0.78
#: Candidates that a member names per wave, and waves before all are named.
NAMED, WAVES = 4, 2
#: Members of a bucket of several components before it is split by a second
#: band, and members of a block when a split bucket is dealt.
SPLIT_BUCKET = 8192
SHARD_TEXTS = 512

_rng = np.random.default_rng(20240229)
# multiply-shift hashes: an odd factor and an addend for each minimum
_FACTORS = _rng.integers(1, 1 << 63, LONG_MINIMA, np.uint64) * np.uint64(2) + np.uint64(1)
_ADDENDS = _rng.integers(0, 1 << 63, LONG_MINIMA, np.uint64)


def shingle_sets(words: Words, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, and the first of each text (and the end)."""
    at, h = words.windows(size)
    n = np.diff(words.doc)
    short = np.flatnonzero((n > 0) & (n < size))
    doc = np.searchsorted(words.doc, at, side="right") - 1
    if len(short):
        doc = np.concatenate([doc, short])
        h = np.concatenate([h, range_hashes(words.hashes, words.doc[short], words.doc[short + 1])])
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    doc, h = doc[new], h[new]
    return h, np.searchsorted(doc, np.arange(len(n) + 1))


def minima(sets: np.ndarray, first: np.ndarray, count: int = BANDS * ROWS) -> np.ndarray:
    """Minima of each non-empty set, one row per hash function."""
    out = np.empty((count, len(first)), np.uint64)
    for i in range(count):
        out[i] = np.minimum.reduceat((sets * _FACTORS[i] + _ADDENDS[i]) >> np.uint64(32), first)
    return out


def pack(low: np.ndarray) -> np.ndarray:
    """The two low bits of each minimum, 32 minima per 64-bit word: one row per set."""
    out = np.zeros((low.shape[1], len(low) // 32), np.uint64)
    for i in range(len(low)):
        out[:, i // 32] |= (low[i] & np.uint64(3)) << np.uint64(2 * (i % 32))
    return out


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, data, offsets in text_chunks(batches):
        words = Words(data, offsets, WORD_BYTES, True)
        sets, first = shingle_sets(words)
        size = np.diff(first)
        some = np.flatnonzero(size)
        digest = np.full(rows.num_rows, None, object)
        bands, packed = np.zeros((len(some), BANDS), np.int64), np.zeros((len(some), 3), np.int64)
        if len(some):
            low = minima(sets, first[:-1][some])
            for i in some:
                digest[i] = hashlib.blake2b(sets[first[i]:first[i + 1]].tobytes(), digest_size=16).hexdigest()
            for b in range(BANDS):
                key = np.full(len(some), b + 1, np.uint64)
                for r in range(ROWS):
                    key = mix(key ^ low[b * ROWS + r] + np.uint64(0x9E3779B97F4A7C15))
                bands[:, b] = key.view(np.int64)
            packed = pack(low).view(np.int64)
        per = (size > 0).astype(np.int64)
        yield pa.RecordBatch.from_arrays(
            [rows.column(0), pa.array(size, pa.int64()), pa.array(digest, pa.string()),
             lengths_to_list(bands.reshape(-1), per * BANDS, pa.int64()), lengths_to_list(packed.reshape(-1), per * 3, pa.int64())],
            ["doc_id", "n_shingles", "digest", "bands", "sig"])


def _long_sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, data, offsets in text_chunks(batches):
        sets, first = shingle_sets(Words(data, offsets, WORD_BYTES, True))
        some = np.flatnonzero(np.diff(first))
        if len(some):
            sigs = pack(minima(sets, first[:-1][some], LONG_MINIMA))
            yield pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(some)), pa.array([x.tobytes() for x in sigs], pa.binary())],
                                             ["node", "sig"])


SKETCH_SCHEMA = "doc_id long, n_shingles long, digest string, bands array<long>, sig array<long>"


def similarity(a: str, b: str):
    """Similarity of two signature columns from bit counts: the share of equal
    two-bit values, corrected for the quarter that is equal by chance."""
    differ = None
    for i in range(3):
        x = F.col(a)[i].bitwiseXOR(F.col(b)[i])
        n = F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(0x5555555555555555)))
        differ = n if differ is None else differ + n
    return (1 - differ / F.lit(float(BANDS * ROWS)) - 0.25) / 0.75


# ---------------------------------------------------------------- components

def components(links: DataFrame, source: DataFrame) -> DataFrame:
    """(node, component) of the nodes of ``links`` (a, b): alternating large
    and small stars until nothing changes; the component is the smallest node."""
    edges = write_table(links.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).where("u <> v").distinct(),
                        "near-edges", source)
    state = None
    while True:
        both = edges.select(F.col("v").alias("n"), F.col("u").alias("m")).union(edges.select(F.col("u").alias("n"), F.col("v").alias("m")))
        low = both.groupBy("n").agg(F.min("m").alias("low")).select("n", F.least("n", "low").alias("low"))
        large = both.join(low, "n").where("m > n").select(F.col("m").alias("v"), F.col("low").alias("u")).where("u <> v").distinct()
        low = large.groupBy("v").agg(F.min("u").alias("low"))
        small = large.join(low, "v").select(F.col("u").alias("x"), "low").union(low.select(F.col("v").alias("x"), "low"))
        edges = write_table(small.where("x <> low").select(F.col("x").alias("v"), F.col("low").alias("u")).distinct(),
                            "near-edges", source)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            return edges.select(F.col("v").alias("node"), F.col("u").alias("component"))
        state = now


# ---------------------------------------------------------------- confirming

def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    center, own, taking = None, [], False
    for rows, data, offsets in text_chunks(batches):
        sets, first = shingle_sets(Words(data, offsets, WORD_BYTES, True))
        out = []
        for i, (c, salt, kind, node) in enumerate(zip(*(rows.column(j).to_pylist() for j in range(4)))):
            mine = sets[first[i]:first[i + 1]]
            if kind == 0:
                if (c, salt) != center or taking:
                    center, own, taking = (c, salt), [], False
                own.append(mine.copy())
                continue
            taking = True
            if (c, salt) != center:
                raise RuntimeError(f"the text of node {c} is missing")
            for other in own:
                both = len(np.intersect1d(mine, other, assume_unique=True))
                if len(mine) and 100 * both >= LINK_PERCENT * (len(mine) + len(other) - both):
                    out.append((c, node))
                    break
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], ["a", "b"])


def confirm(pairs: DataFrame, texts: DataFrame, source: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are linked.  The text of ``a``
    meets those of its partners in one stretch of a sorted partition; a node
    with many partners is dealt over salts."""
    many = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / SHARD_TEXTS).cast("int").alias("salts"))
    salted = pairs.join(many, "a").withColumn("salt", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int"))
    refs = (salted.select(F.col("b").alias("node"), F.col("a").alias("center"), "salt", F.lit(1).alias("kind"))
            .union(many.select(F.col("a").alias("node"), F.col("a").alias("center"),
                               F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("kind"))))
    rows = texts.join(refs, "node").select("center", "salt", "kind", "node", "text")
    parts = max(2, table_bytes(texts) >> 23)
    linked = (rows.repartition(parts, "center", "salt").sortWithinPartitions("center", "salt", "kind")
              .mapInArrow(_confirm, "a long, b long"))
    return write_table(linked, "near-links", source)


# ---------------------------------------------------------------- waves

def estimates(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Corrected similarity of signatures (last axis: packed words)."""
    x = a ^ b
    differ = np.bitwise_count((x | (x >> np.uint64(1))) & np.uint64(0x5555555555555555)).sum(axis=-1)
    return ((1 - differ / (32 * a.shape[-1])) - 0.25) / 0.75


def _name_partners(named: int | None):
    """Per group (rows sorted by ``GROUP``, refused pairs and members of one pair
    of blocks): for each member its most similar members of other components in
    the other block that were not refused before; None names all.  Members that
    share several bands are named in the bucket of the first of them, or of the
    first two where that is split."""
    short = BANDS * ROWS // 32

    def group(g: pa.Table):
        dealt = g["blocks"][0].as_py() > 1
        across = g["i"][0].as_py() != g["j"][0].as_py()
        is_member = g["kind"].to_numpy() == 1
        pair = g.filter(pa.array(~is_member))
        g = g.filter(pa.array(is_member))
        node, at = np.unique(g["node"].to_numpy(), return_index=True)
        if len(node) < 2:
            return
        comp, block = g["component"].to_numpy()[at], g["block"].to_numpy()[at]
        sig = np.frombuffer(b"".join(g["sig"].to_pylist()), np.uint64).reshape(g.num_rows, -1)[at]
        bands = g["bands"].combine_chunks().flatten().to_numpy().reshape(-1, BANDS)[at]
        first, second = g["first"][0].as_py(), g["second"][0].as_py()
        head = np.ascontiguousarray(sig[:, :short])
        several = (bands == 0).all(axis=1)  # an id of several texts: no signature tells of all of them
        # refused pairs of the group, both ways, by member
        ends = np.stack([pair["node"].to_numpy(), pair["other"].to_numpy()]).astype(np.int64)
        place = np.minimum(np.searchsorted(node, ends), len(node) - 1)
        place = place[:, (node[place] == ends).all(axis=0)]
        src, dst = np.concatenate([place[0], place[1]]), np.concatenate([place[1], place[0]])
        order = np.argsort(src, kind="stable")
        dst, begin = dst[order], np.searchsorted(src[order], np.arange(len(node) + 1))
        for k in range(len(node)):
            ok = comp != comp[k]
            if across:
                ok &= block != block[k]
            ok[dst[begin[k]:begin[k + 1]]] = False
            may = np.flatnonzero(ok)
            may = may[(estimates(head[may], head[k]) >= ESTIMATE) | several[may] | several[k]]
            same = bands[may] == bands[k]
            here = bands[k][np.argmax(same, axis=1)] == first
            if second is not None:
                same[np.arange(len(may)), np.argmax(same, axis=1)] = False
                here &= same.any(axis=1) & (bands[k][np.argmax(same, axis=1)] == second)
            # an id of several texts has no bands of its own (zeros) and is named in every bucket
            may = may[here | several[may] | several[k]]
            est = np.where(several[may] | several[k], 1.0, estimates(sig[may], sig[k]))
            good, est = may[est >= LONG_ESTIMATE], est[est >= LONG_ESTIMATE]
            if named is not None and len(good) > named:
                best = np.lexsort((node[good], -est))[:named]
                good, est = good[best], est[best]
            for j, e in zip(good.tolist(), est.tolist()):
                a, b = min(k, j), max(k, j)
                # other blocks may hold more similar ones: told apart by the member that names
                yield (int(node[a]), int(node[b])) + ((int(node[k]), e) if dealt and named is not None else (None, None))

    def name(batches):
        held, key = [], None

        def flush():
            out = sorted(set(group(pa.Table.from_batches(held))), key=lambda x: x[:2])
            by = held[0]["key"][0].as_py()
            for i in range(0, len(out), 100_000):
                a, b, who, est = zip(*out[i:i + 100_000])
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array([by] * len(a), pa.int64()),
                                                  pa.array(who, pa.int64()), pa.array(est, pa.float64())], ["a", "b", "key", "who", "est"])
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch[x].to_numpy() for x in GROUP])
            cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            for lo, hi in zip(cuts, cuts[1:]):
                if held and tuple(keys[:, lo]) != key:
                    yield from flush()
                    held.clear()
                key = tuple(keys[:, lo])
                held.append(batch.slice(lo, hi - lo))
        if held:
            yield from flush()
    return name


GROUP = ["key", "i", "j"]
NAMED_SCHEMA = "a long, b long, key long, who long, est double"


def _block(node, blocks):
    return F.pmod(F.xxhash64(node, F.lit(BANDS)), blocks).cast("int")


def _parts(several: DataFrame, classes: DataFrame) -> DataFrame:
    """Members of the buckets that are searched (key, node, component, members,
    first, second): as they are, or split by each band after their own (key of
    both).  A pair's first two shared bands are one such split."""
    small = several.where(F.col("members") <= SPLIT_BUCKET).select(
        "key", "node", "component", "members", F.col("key").alias("first"), F.lit(None).cast("long").alias("second"))
    large = several.where(F.col("members") > SPLIT_BUCKET)
    if not large.limit(1).count():
        return small
    after = F.expr(f"slice(bands, cast(array_position(bands, key) + 1 as int), {BANDS})")
    split = (large.select(F.col("key"), "node", "component").join(classes.select("node", "bands"), "node")
             .where(F.array_contains("bands", F.col("key")))
             .select(F.col("key").alias("first"), F.explode(after).alias("second"), "node", "component").distinct()
             .withColumn("key", F.xxhash64("first", "second")))
    return small.union(_several(split).select("key", "node", "component", "members", "first", "second"))


def _dealt(parts: DataFrame, sigs: DataFrame, refused: DataFrame, bands: DataFrame) -> DataFrame:
    """The rows of all groups: members of a part with their signatures (kind 1),
    a block's in every pair of blocks it is in, and the refused pairs (kind 0) of
    the members of that pair of blocks.  A part of at most ``SPLIT_BUCKET``
    members is one block."""
    blocks = F.ceil(F.col("members") / SPLIT_BUCKET).cast("int")
    x = parts.join(sigs, "node").join(bands, "node", "left")
    x = x.withColumn("bands", F.coalesce("bands", F.array_repeat(F.lit(0).cast("long"), BANDS)))
    x = x.withColumn("blocks", blocks).withColumn("block", _block(F.col("node"), F.col("blocks")))
    x = x.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    members = x.select("key", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), F.lit(1).alias("kind"),
                       "blocks", "block", "node", F.lit(None).cast("long").alias("other"), "component", "first", "second", "sig", "bands")
    # a pair is looked for in one part only: that of its first shared band, or of its first two
    of = lambda c: bands.select(F.col("node").alias(c), F.col("bands").alias(f"bands_{c}"))
    pairs = refused.join(of("b"), "b").join(of("a"), "a").select("a", "b", F.array_intersect("bands_a", "bands_b").alias("same"))
    key = F.explode(F.array(F.get("same", F.lit(0)), F.xxhash64(F.get("same", F.lit(0)), F.get("same", F.lit(1)))))
    dealt = parts.where(F.col("members") > SPLIT_BUCKET).select("key", blocks.alias("blocks")).distinct()
    pairs = pairs.where(F.size("same") > 0).select("a", "b", key.alias("key")).join(dealt, "key", "left")
    pairs = pairs.withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    ba, bb = _block(F.col("a"), F.col("blocks")), _block(F.col("b"), F.col("blocks"))
    return members.unionByName(pairs.select(
        "key", F.least(ba, bb).alias("i"), F.greatest(ba, bb).alias("j"), F.lit(0).alias("kind"), "blocks", ba.alias("block"),
        F.col("a").alias("node"), F.col("b").alias("other")), allowMissingColumns=True)


def _several(members: DataFrame) -> DataFrame:
    """Members of buckets that hold several components (and their size)."""
    keys = members.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"),
                                      F.count(F.lit(1)).alias("members")).where("lo <> hi")
    return members.join(keys.select("key", "members"), "key")


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sketch = write_table(rows.mapInArrow(_sketch, SKETCH_SCHEMA), "near-sketches", docs)
    usable = sketch.where("doc_id IS NOT NULL AND n_shingles > 0")
    classes = write_table(usable.groupBy("digest").agg(F.min("doc_id").alias("node"), F.any_value("bands").alias("bands"),
                                                       F.any_value("sig").alias("sig")), "near-classes", docs)
    slots = classes.select("node", F.explode("bands").alias("key"))
    shared = slots.groupBy("key").agg(F.min("node").alias("center"), F.count(F.lit(1)).alias("members")).where("members > 1")
    shared = write_table(shared, "near-keys", docs)
    buckets = write_table(join_hot(slots, shared, "key", "members", F.col("node")).drop("members"), "near-buckets", docs)
    sigs = classes.select("node", "sig")
    texts = write_table(rows.withColumnRenamed("doc_id", "node").join(buckets.select("node").distinct(), "node"), "near-texts", docs)

    star = buckets.where("node <> center").select(F.col("center").alias("a"), F.col("node").alias("b")).distinct()
    star = (star.join(sigs.select(F.col("node").alias("a"), F.col("sig").alias("sa")), "a")
            .join(sigs.select(F.col("node").alias("b"), F.col("sig").alias("sb")), "b"))
    tested = write_table(star.where(similarity("sa", "sb") >= ESTIMATE).select("a", "b").distinct(), "near-pairs", docs)
    found = confirm(tested, texts, docs)
    refused = write_table(tested.join(found, ["a", "b"], "left_anti"), "near-refused", docs)
    # an id of several texts links their classes
    held = usable.groupBy("doc_id").agg(F.min("digest").alias("lo"), F.max("digest").alias("hi")).where("lo <> hi").select("doc_id")
    held = usable.join(held, "doc_id").select("doc_id", "digest").distinct().join(classes.select("digest", "node"), "digest")
    own = held.groupBy("doc_id").agg(F.min("node").alias("a"))
    links = found.union(write_table(held.join(own, "doc_id").where("node <> a").select("a", F.col("node").alias("b")).distinct(), "near-links", docs))
    for wave in range(WAVES + 1):
        comp = components(links, docs)
        member = buckets.select("key", "node").join(comp, "node", "left").select(
            "key", "node", F.coalesce("component", "node").alias("component"))
        several = write_table(_several(member), "near-several", docs)
        several = several.where("members > 2")  # the only pair of two members was tested with the stars
        parts = write_table(_parts(several, classes), "near-parts", docs)
        if wave == 0:  # components only grow, so later waves have no other members
            long_sigs = write_table(texts.join(several.select("node").distinct(), "node").select("node", "text")
                                    .mapInArrow(_long_sketch, "node long, sig binary").dropDuplicates(["node"]), "near-signatures", docs)
        # an id of several texts has no bands of its own and is named in every bucket
        own_bands = classes.groupBy("node").agg(F.any_value("bands").alias("bands"), F.count(F.lit(1)).alias("sets")).where("sets = 1").drop("sets")
        full = _dealt(parts, long_sigs, refused, own_bands)
        groups = F.ceil(F.col("members") / SPLIT_BUCKET)
        dealt = parts.where(F.col("members") > SPLIT_BUCKET).select("key", (groups * (groups + 1) / 2).alias("groups")).distinct()
        dealt = int(dealt.agg(F.sum("groups")).first()[0] or 0)
        n = max(2, table_bytes(buckets) >> 22) + dealt // 4
        named = (full.repartition(n, *GROUP).sortWithinPartitions(*GROUP, "kind")
                 .mapInArrow(_name_partners(NAMED if wave < WAVES else None), NAMED_SCHEMA))
        if dealt and wave < WAVES:  # of a dealt bucket's names each member keeps the best of all blocks
            named = write_table(named, "near-named", docs)
            rank = F.row_number().over(Window.partitionBy("key", "who").orderBy(F.col("est").desc(), "a", "b"))
            best = named.where("who IS NOT NULL").withColumn("rank", rank).where(F.col("rank") <= NAMED)
            named = named.where("who IS NULL").select("a", "b").union(best.select("a", "b"))
        more = write_table(named.select("a", "b").distinct(), "near-pairs", docs)  # new pairs only: linked ones are of one component, refused ones left out
        if not more.limit(1).count():
            break
        found = confirm(more, texts, docs)
        links = links.union(found)
        if wave < WAVES:
            refused = refused.union(write_table(more.join(found, ["a", "b"], "left_anti"), "near-refused", docs))
    else:
        comp = components(links, docs)

    named = classes.select("digest", "node").join(comp, "node", "left").select(
        "digest", F.coalesce("component", "node").alias("component_id"))
    # copies of one text: a row finds its class by digest and salt, see group_rows
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(64)).cast("int")
    own = usable.select("doc_id", "n_shingles", "digest", salt.alias("salt"))
    present = own.select("digest", "salt").distinct().join(named, "digest")
    found = own.join(present, ["digest", "salt"]).select("doc_id", "n_shingles", "component_id")
    rest = sketch.where("doc_id IS NULL OR n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    out = found.union(rest)
    return compact(out, docs).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def distinct_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are the first of their component, same columns."""
    gone = near_components(docs, id_col, text_col).where("NOT kept").select(F.col("doc_id").alias("__gone")).distinct()
    rows = docs.select(F.struct("*").alias("__row"), F.col(id_col).cast("long").alias("__gone"))
    return rows.join(gone, "__gone", "left_anti").select("__row.*")


def op9_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near copies among all documents."""
    return near_components(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
