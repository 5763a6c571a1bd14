"""N-gram Jaccard join by vertical partitioning.

Documents are sets of four-word shingles (64-bit hashes), linked when their
similarity reaches ``LINK_PERCENT``.  All stages but the last are exact filters
on bounds of the symmetric difference, which a linked pair keeps below
(100 - t) / (100 + t) of both sizes together:

1. ``sieve``: of one fragment of the hash range (``FIRST_FRAGMENT`` of it) the
   shingles found in one row only are counted.  A document with more of these
   than its set may miss has no partner; its text is not read again.
2. Texts of equal sets are one class.  Shingles of a single class are left out
   again, now over whole sets, and so are classes with too few others.
3. The shingles that are left have a global order, rare ones first, which is cut
   into ``FRAGMENTS`` fragments of about equal occurrences.  Each class keeps
   its shingles in that order with the cuts.
4. Linked classes share a shingle of their prefixes, so the rows of a prefix
   shingle are a bucket.  First each member is paired with the bucket's
   smallest class (a star).
5. ``overlaps`` counts each pair's common shingles in every fragment
   separately: the segments of a class and of its partners in one fragment meet
   in one task.  The partial counts are summed per pair, and a pair whose sum
   reaches its size is a link.
6. Buckets that still hold several components are compared member by member
   (large ones as pairs of blocks) by bounds alone: sizes, shingles of a single
   class, and the bits in which parity bitmaps differ.  What passes goes to
   ``overlaps`` again.  In the first waves a member names its ``NAMED`` most
   promising partners of other components, in the last one all, so no link
   between components is lost.

A task holds two blocks of bitmaps, or one class's segment with up to
``GROUP_PAIRS`` partners' in turn; pairs, links and sets are tables.

Defined results: null texts and texts without words have an empty set, are
linked with nothing and are their own component; rows of one id are one node,
so an id with several texts links what any of them links, and each row has the
size of its own set; rows with a null id are linked with nothing and have a
null component; repeated rows each have a result row; an empty table gives no
rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import (WORD_BYTES, Words, compact, group_rows, join_hot, lengths_to_list, mix, table_bytes, text_chunks, write_table)
from .near_dedup import components, shingle_sets

SHINGLE = 4
LINK_PERCENT = 85
#: The sieve's share of the hash range.
FIRST_FRAGMENT = 0.3
FRAGMENTS = 8
#: Partners of one class that one task meets, and members of a block.
GROUP_PAIRS, BLOCK = 512, 4096
#: 64-bit words of a parity bitmap.
BITMAP_WORDS = 32
NAMED, WAVES = 4, 2


def may_miss(n: Column) -> Column:
    """How many shingles a set of n may hold that no partner has."""
    return F.floor(n * (100 - LINK_PERCENT) / 100)


# ---------------------------------------------------------------- sieve

def _first_fragment(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    limit = np.uint64(int(FIRST_FRAGMENT * 2 ** 64))
    for rows, data, offsets in text_chunks(batches):
        sets, first = shingle_sets(Words(data, offsets, WORD_BYTES, True), SHINGLE)
        low = sets < limit
        size = np.zeros(len(sets) + 1, np.int64)
        np.cumsum(low, out=size[1:])
        yield pa.RecordBatch.from_arrays(
            [rows.column(0), pa.array(np.diff(first), pa.int64()), lengths_to_list(sets[low].view(np.int64), size[first[1:]] - size[first[:-1]], pa.int64())],
            ["doc_id", "n_shingles", "grams"])


def sieve(first: DataFrame, source: DataFrame) -> DataFrame:
    """The ids whose first fragment leaves them a partner (doc_id)."""
    usable = first.where("doc_id IS NOT NULL AND n_shingles > 0")
    slots = usable.select("doc_id", F.explode("grams").alias("gram"))
    alone = slots.groupBy("gram").agg(F.count(F.lit(1)).alias("rows"), F.min("doc_id").alias("doc_id")).where("rows = 1")
    alone = alone.groupBy("doc_id").agg(F.count(F.lit(1)).alias("alone"))
    ids = usable.groupBy("doc_id").agg(F.max("n_shingles").alias("n"), F.count(F.lit(1)).alias("rows"))
    # the shingles of an id with several rows are not told apart, so it stays
    alive = ids.join(alone, "doc_id", "left").where((F.col("rows") > 1) | (F.coalesce("alone", F.lit(0)) <= may_miss(F.col("n"))))
    return write_table(alive.select("doc_id"), "join-alive", source)


# ---------------------------------------------------------------- sets in the global order

def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, data, offsets in text_chunks(batches):
        sets, first = shingle_sets(Words(data, offsets, WORD_BYTES, True), SHINGLE)
        digests = [hashlib.blake2b(sets[a:b].tobytes(), digest_size=16).digest() if b > a else None for a, b in zip(first[:-1].tolist(), first[1:].tolist())]
        yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(digests, pa.binary()), lengths_to_list(sets.view(np.int64), np.diff(first), pa.int64())],
                                         ["doc_id", "digest", "grams"])


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        grams = batch.column("grams")
        bits = BITMAP_WORDS * 64
        at = (mix(grams.flatten().to_numpy().view(np.uint64)) % np.uint64(bits)).astype(np.int64)
        own = np.repeat(np.arange(len(grams)), grams.value_lengths().to_numpy())
        odd = (np.bincount(own * bits + at, minlength=len(grams) * bits) & 1).astype(bool).reshape(len(grams), bits)
        packed = np.packbits(odd, axis=1)
        yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array([x.tobytes() for x in packed], pa.binary())], ["node", "bitmap"])


def ordered_sets(classes: DataFrame, source: DataFrame) -> DataFrame:
    """(node, n, shared, grams, cuts) of the classes that may have a partner:
    their shingles of two classes or more in the global order (rare first, then
    by hash), the size n of the whole set, and the end of every fragment."""
    slots = classes.select("node", "n", F.explode("grams").alias("gram"))
    often = slots.groupBy("gram").agg(F.count(F.lit(1)).alias("classes")).where("classes > 1")
    # the place in the order as one number: classes, then the hash as a fraction
    place = F.col("classes") + (F.col("gram") / F.lit(2.0 ** 64) + 0.5) * 0.999
    kept = slots.join(often, "gram").select("node", "n", "gram", place.alias("place"))
    rows = kept.groupBy("node", "n").agg(F.array_sort(F.collect_list(F.struct("place", "gram"))).alias("grams"))
    rows = write_table(rows.where(F.col("n") - F.size("grams") <= may_miss(F.col("n"))), "join-order", source)
    ends = rows.select(F.explode("grams.place").alias("place")).agg(
        F.percentile_approx("place", [i / FRAGMENTS for i in range(1, FRAGMENTS)], 10_000)).first()[0]
    cuts = F.array(*[F.expr(f"size(filter(grams, g -> g.place <= {e!r}D))") for e in ends or []], F.size("grams"))
    return write_table(rows.select("node", "n", F.size("grams").alias("shared"), F.col("grams.gram").alias("grams"), cuts.alias("cuts")),
                       "join-sets", source)


# ---------------------------------------------------------------- counting

def _count_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by center, salt, fragment, kind: the center's segment, then its partners'."""
    group, own = None, None
    for batch in batches:
        out = []
        lists = batch.column("segment")
        flat, ends = lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
        for i, (*key, kind, node) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("center", "salt", "fragment", "kind", "node")))):
            segment = flat[ends[i]:ends[i + 1]]
            if kind == 0:
                group, own = key, np.sort(segment)
            elif key == group:  # else the center has nothing in this fragment
                at = np.minimum(np.searchsorted(own, segment), len(own) - 1)
                n = int((own[at] == segment).sum())
                if n:
                    out.append((key[0], node, n))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], ["a", "b", "part"])


def overlaps(pairs: DataFrame, sets: DataFrame, source: DataFrame) -> DataFrame:
    """The linked pairs among (a, b): partial overlaps per fragment, summed."""
    many = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / GROUP_PAIRS).cast("int").alias("salts"))
    refs = (pairs.join(many, "a").select(F.col("b").alias("node"), F.col("a").alias("center"),
                                         F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt"), F.lit(1).alias("kind"))
            .union(many.select(F.col("a").alias("node"), F.col("a").alias("center"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"),
                               F.lit(0).alias("kind"))))
    refs = write_table(refs, "join-refs", source)
    used = sets.join(refs.groupBy("node").agg(F.count(F.lit(1)).alias("refs")), "node").select("node", "grams", "cuts", "refs")
    begin = F.coalesce(F.get("cuts", F.col("fragment") - 1), F.lit(0))
    rows = join_hot(refs, used, "node", "refs", F.xxhash64("center", "salt")).select("*", F.posexplode("cuts").alias("fragment", "end"))
    rows = rows.select("center", "salt", "fragment", "kind", "node", F.slice("grams", begin + 1, F.col("end") - begin).alias("segment"))
    parts = max(2, table_bytes(sets) >> 22)
    partial = (rows.where(F.size("segment") > 0).repartition(parts, "center", "salt", "fragment").sortWithinPartitions("center", "salt", "fragment", "kind")
               .mapInArrow(_count_segments, "a long, b long, part long"))
    size = lambda c: sets.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"))
    both = partial.groupBy("a", "b").agg(F.sum("part").alias("common")).join(size("b"), "b").join(size("a"), "a")
    return write_table(both.where(100 * F.col("common") >= LINK_PERCENT * (F.col("n_a") + F.col("n_b") - F.col("common"))).select("a", "b"),
                       "join-links", source)


# ---------------------------------------------------------------- waves

def _name_partners(named: int | None):
    """Per group (a bucket's pair of blocks): for each member the partners of
    other components that the bounds allow, the ``named`` closest or all."""

    def group(g: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        node, comp, block, n, shared = (g[c].to_numpy() for c in ("node", "component", "block", "n", "shared"))
        bits = np.frombuffer(b"".join(g["bitmap"].to_pylist()), np.uint64).reshape(len(node), BITMAP_WORDS)
        across = g["i"][0].as_py() != g["j"][0].as_py()
        a, b = [], []
        for k in range(len(node)):
            may = (comp != comp[k]) & ((block != block[k]) if across else True)
            if named is None:
                may &= node > node[k]  # each pair from one side
            both = n + n[k]
            may = np.flatnonzero(may & ((100 + LINK_PERCENT) * np.minimum(shared, shared[k]) >= LINK_PERCENT * both))
            # of the difference, at least: shingles of no other class, and odd bits
            differ = (n[may] - shared[may]) + (n[k] - shared[k]) + np.bitwise_count(bits[may] ^ bits[k]).sum(axis=1).astype(np.int64)
            ok = (100 + LINK_PERCENT) * differ <= (100 - LINK_PERCENT) * both[may]
            may, differ = may[ok], differ[ok]
            if named is not None and len(may) > named:
                may = may[np.lexsort((node[may], differ))[:named]]
            a.append(np.full(len(may), node[k]))
            b.append(node[may])
        a, b = np.concatenate(a), np.concatenate(b)
        return np.minimum(a, b), np.maximum(a, b)

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key = [], None

        def flush():
            for pair in [group(pa.Table.from_batches(held))] if held else []:
                if len(pair[0]):
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in pair], ["a", "b"])
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch[x].to_numpy() for x in ("gram", "i", "j")])
            cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            for lo, hi in zip(cuts, cuts[1:]):
                if tuple(keys[:, lo]) != key:
                    yield from flush()
                    held, key = [], tuple(keys[:, lo])
                held.append(batch.slice(lo, hi - lo))
        yield from flush()
    return name


def wave(buckets: DataFrame, comp: DataFrame, sets: DataFrame, bitmaps: DataFrame, named: int | None) -> DataFrame:
    """Pairs (a, b) of different components that share a bucket and pass the bounds."""
    member = buckets.join(comp, "node", "left").select("gram", "node", F.coalesce("component", "node").alias("component"))
    keys = member.groupBy("gram").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("members"))
    several = member.join(keys.where("lo <> hi AND members > 2").select("gram", "members"), "gram")  # the star tested buckets of two
    blocks = F.ceil(F.col("members") / BLOCK).cast("int")
    x = several.join(sets.select("node", "n", "shared"), "node").join(bitmaps, "node")
    x = x.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    x = x.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    x = x.select("gram", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), "block", "node", "component", "n", "shared", "bitmap")
    parts = max(2, table_bytes(buckets) >> 20)
    return x.repartition(parts, "gram", "i", "j").sortWithinPartitions("gram", "i", "j").mapInArrow(_name_partners(named), "a long, b long").distinct()


def similar_sets(sets: DataFrame, extra: DataFrame, source: DataFrame) -> DataFrame:
    """(node, component) over all links between the classes of ``sets`` and the
    links ``extra`` (a, b); nodes without links may be missing."""
    # linked sets share one of their first shingles: as many as one may miss, and one
    first = F.expr(f"slice(grams, 1, cast(shared - ceil(n * {LINK_PERCENT} / 100) + 1 as int))")
    slots = sets.select("node", "n", "shared", F.explode(first).alias("gram"))
    shared = slots.groupBy("gram").agg(F.min(F.struct("node", "n", "shared")).alias("center"), F.count(F.lit(1)).alias("members")).where("members > 1")
    shared = write_table(shared, "join-keys", source)
    buckets = write_table(join_hot(slots, shared, "gram", "members", F.col("node")), "join-buckets", source)
    fits = (100 + LINK_PERCENT) * F.least("shared", "center.shared") >= LINK_PERCENT * (F.col("n") + F.col("center.n"))
    star = buckets.where(F.col("node") > F.col("center.node")).where(fits)
    star = write_table(star.select(F.col("center.node").alias("a"), F.col("node").alias("b")).distinct(), "join-pairs", source)
    links, tested = extra.union(overlaps(star, sets, source)), star
    bitmaps = write_table(sets.select("node", "grams").mapInArrow(_bitmaps, "node long, bitmap binary"), "join-bitmaps", source)
    members, comp, turn = buckets.select("gram", "node"), components(links, source), 0
    while turn <= WAVES:
        more = wave(members, comp, sets, bitmaps, NAMED if turn < WAVES else None).join(tested, ["a", "b"], "left_anti")
        more = write_table(more, "join-pairs", source)
        some = more.limit(1).count() > 0
        if some:
            links, tested = links.union(overlaps(more, sets, source)), tested.union(more)
            comp = components(links, source)
        # where nothing new is named, the last wave looks at all that is left
        turn = turn + 1 if some or turn == WAVES else WAVES
    return comp


def join_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    first = write_table(rows.mapInArrow(_first_fragment, "doc_id long, n_shingles long, grams array<long>"), "join-first", docs)
    alive = sieve(first, docs)
    kept = rows.join(alive, "doc_id").mapInArrow(_sets, "doc_id long, digest binary, grams array<long>").where("digest IS NOT NULL")
    kept = write_table(kept, "join-texts", docs)

    # classes of equal sets: the set of one holder each, numbered
    members = kept.groupBy("digest", "doc_id").agg(F.count(F.lit(1)).alias("rows"))
    classes = members.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("ids"))
    classes = kept.join(classes, ["digest", "doc_id"]).dropDuplicates(["digest"])
    classes = write_table(classes.select(F.monotonically_increasing_id().alias("node"), "digest", F.col("doc_id").alias("first_id"), "ids",
                                         F.size("grams").alias("n"), "grams"), "join-classes", docs)
    # an id with several texts links their classes
    several = members.groupBy("doc_id").agg(F.min("digest").alias("lo"), F.max("digest").alias("hi")).where("lo <> hi").select("doc_id")
    several = members.join(several, "doc_id").select("doc_id", "digest").join(classes.select("digest", "node"), "digest")
    own = several.groupBy("doc_id").agg(F.min("node").alias("a"))
    extra = write_table(several.join(own, "doc_id").where("node <> a").select("a", F.col("node").alias("b")).distinct(), "join-own", docs)

    comp = similar_sets(ordered_sets(classes, docs), extra, docs)
    found = classes.select("node", "digest", "first_id", "ids").join(comp, "node", "left").withColumn("component", F.coalesce("component", "node"))
    found = group_rows(found, ["component"], F.col("node"), [("component_id", "min", F.col("first_id"))])
    placed = join_hot(members.select("digest", "doc_id"), found.select("digest", "ids", "component_id"), "digest", "ids", F.xxhash64("doc_id"))
    placed = placed.groupBy("doc_id").agg(F.min("component_id").alias("component_id"))
    return compact(first.select("doc_id", "n_shingles").join(placed, "doc_id", "left"), docs).select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def op13_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links by four-word shingles among all documents."""
    return join_components(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
