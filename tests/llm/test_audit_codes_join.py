"""Edge cases and brute-force versions of the filter audit, vector codes and
n-gram join."""
import collections
import hashlib
import itertools
import math
import random
import re

import numpy as np
import pytest

from scrubline.llm import filter_audit, ngram_join, vector_codes

from test_operators import corpus, lower, text

WS = re.compile(r"[^\x20\x09-\x0D]+")


# ---------------------------------------------------------------- 11 filter audit

def audit_brute(docs, labels):
    """docs: (doc_id, text, part); labels: (doc_id, quality, toxic)."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    rows = []
    for i, t, part in docs:
        t = t or ""
        w = WS.findall(t)
        fails = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t),
                 "D": any(c in "#$%&*|" for c in t),
                 "E": i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in docs)}
        rows.append((i, part or "", {f for f, x in fails.items() if x}))
    out = {}
    for part in {r[1] for r in rows}:
        mine = [r for r in rows if r[1] == part]
        removed = {}
        for order in map("".join, itertools.permutations("ABCDE")):
            for s, f in enumerate(order):
                before = set(order[:s])
                here = [r for r in mine if f in r[2] and not r[2] & before]
                removed[order, f] = len(here)
                out[part, order, s + 1] = [
                    sum(not r[2] & (before | {f}) for r in mine), len(here), sum(f in r[2] and bool(r[2] & before) for r in mine),
                    sum(r[2] == {f} for r in mine), sum(r[0] in good for r in here), sum(r[0] in toxic for r in here)]
        for (p, order, s), v in out.items():
            if p == part:
                v.append(sum(n for (_, f), n in removed.items() if f == order[s - 1]))
    return out


AUDIT = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def audit_rows(df):
    return {(r.part, r.filter_order, r.step): [r[c] for c in AUDIT] for r in df.collect()}


def test_filter_audit_brute(spark):
    rng = random.Random(5)
    docs = [(i, t, [None, "", "a", "b"][n % 4]) for n, (i, t) in enumerate(corpus())]
    docs += [(200 + i, text(rng, 70, 5000) + rng.choice(["", " #1", " WHAT A SHOUT THIS IS " * 3]), "c") for i in range(30)]
    docs += [(300 + i, "same text", "c") for i in range(20)] + [(301, "same text", "c"), (None, "same text", "c")]
    docs += [(400, "É" * 30 + " AB", "d"), (401, "x y " * 60, "d"), (402, "word " * 400_000, "d")]  # one long text
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i, _, _ in docs] + [(300, 1, 0), (None, 1, 1), (999, 1, 1)]
    table = spark.createDataFrame([(*d, 7, "m", 1) for d in docs], "doc_id long, text string, source string, mask int, part string, n long")
    marks = spark.createDataFrame([(*x, "z") for x in labels], "doc_id long, quality int, toxic int, part string")
    got = audit_rows(filter_audit.audit(table.repartition(3), marks))
    assert got == audit_brute(docs, labels)
    none = filter_audit.audit(table.limit(0), marks)
    assert none.columns == ["part", "filter_order", "step", *AUDIT] and none.count() == 0


def test_filter_audit_matrix(spark):
    """The shards hold each document's exact word counts under one code per word."""
    docs = corpus()
    table = spark.createDataFrame([(i, t, "s") for i, t in docs], "doc_id long, text string, source string").repartition(4)
    want = collections.Counter((i, tuple(sorted(collections.Counter(WS.findall(t or "")).values()))) for i, t in docs)
    got, terms = collections.Counter(), collections.Counter()
    for r in filter_audit.csr_shards(table).collect():
        for d, i in enumerate(r.ids):
            cut = slice(r.indptr[d], r.indptr[d + 1])
            got[i, tuple(sorted(r.counts[cut]))] += 1
            for c, n in zip(r.indices[cut], r.counts[cut]):
                terms[c] += n
    assert got == want
    words = collections.Counter(w for _, t in docs for w in WS.findall(t or ""))
    assert sorted(terms.values()) == sorted(words.values())


# ---------------------------------------------------------------- 12 vector codes

def codes_brute(rows):
    """rows: (vec_id, vector, label)."""
    kept = [(i, [math.floor(256 * x) for x in v], lab) for i, v, lab in rows
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return collections.Counter()
    d = len(kept[0][1]) // 16
    ids = sorted({i for i, _, _ in kept}, key=lambda i: (i is None, i))[:64]
    seeds = [min(q for j, q, _ in kept if j == i) for i in ids]
    books = [[s[p * d:(p + 1) * d] for s in seeds] for p in range(16)]

    def near(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, e)), n) for n, e in enumerate(book))
    for _ in range(2):
        for p in range(16):
            got = collections.defaultdict(list)
            for _, q, _ in kept:
                got[near(q[p * d:(p + 1) * d], books[p])[1]].append(q[p * d:(p + 1) * d])
            for n, parts in got.items():
                books[p][n] = [sum(x) // len(parts) for x in zip(*parts)]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out = []
    for i, q, lab in kept:
        best = [near(q[p * d:(p + 1) * d], books[p]) for p in range(16)]
        out.append((i, "".join(f"{n:02x}" for _, n in best), sum(x for x, _ in best), lab))
    labels = collections.Counter()
    for _, _, e, lab in out:
        labels[lab] += e
    return collections.Counter((i, c, e, labels[lab], digest) for i, c, e, lab in out)


def codes(spark, rows):
    table = spark.createDataFrame([(*r, 5, "x") for r in rows], "vec_id long, embedding array<float>, label int, row int, entry string")
    out = vector_codes.coded_vectors(table.repartition(3))
    assert out.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    return collections.Counter(tuple(r) for r in out.collect())


def test_vector_codes_brute(spark):
    rng = np.random.default_rng(3)
    v = lambda: [float(np.float32(x)) for x in rng.normal(0, .2, 32)]
    rows = [(int(i), v(), [None, 1, 2, 3][i % 4]) for i in rng.permutation(300)]
    one = v()
    rows += [(1000 + i, one, 9) for i in range(100)] + [(1000, one, 9)] * 3  # a third alike, repeated rows
    rows += [(5, v(), 1), (5, v(), None), (None, v(), 2), (None, v(), None)]  # one id, several vectors; null ids
    rows += [(-1, None, 1), (-2, [float("nan")] * 32, 1), (-3, [None] + [0.0] * 31, 1), (-4, [float("inf")] + [0.0] * 31, None)]
    assert codes(spark, rows) == codes_brute(rows)
    assert codes(spark, rows[:20]) == codes_brute(rows[:20])  # fewer than 64 ids
    assert codes(spark, rows[-4:]) == collections.Counter()
    tied = [(i, [float(i % 2)] * 16, 1) for i in range(70)]  # equal entries: the lower index
    assert codes(spark, tied) == codes_brute(tied)


def test_vector_codes_lengths(spark):
    rows = [(i, [float(i + k) for k in range(16)], 1) for i in range(5)]
    assert codes(spark, [*rows, (-1, [], 1), (-2, [1.0] * 3, None)]) == codes_brute(rows)
    empty = hashlib.sha256(b"").hexdigest()
    assert codes(spark, [(1, [], 1), (2, [], None)]) == collections.Counter({(1, "00" * 16, 0, 0, empty): 1, (2, "00" * 16, 0, 0, empty): 1})
    with pytest.raises(ValueError, match="multiple of 16"):
        codes(spark, [(1, [0.0] * 30, 1)])


def test_vector_codes_move_members(spark):
    """A round's members are the same parts, each with the owner of its nearest entry."""
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(0, .2, 16)], 0) for i in range(500)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    vectors = vector_codes.integer_vectors(table, "vec_id", "embedding", "label")
    books = vector_codes.first_codebooks(vectors, 16)
    first = vectors.select("row", "q").mapInArrow(vector_codes._cut(books, 4), vector_codes.MEMBER)
    books = vector_codes.updated(first, books)
    told = first.mapInArrow(vector_codes._reassign(books), vector_codes.MEMBER + ", moved boolean")
    before = {(r.position, r.row): (r.entry, r.part) for r in first.collect()}
    moved = 0
    for r in told.collect():
        entry, part = before[r.position, r.row]
        assert part == r.part and r.moved == (entry != r.entry)
        moved += r.moved
    assert 0 < moved < 500 * 16


# ---------------------------------------------------------------- 13 n-gram join

def join_brute(docs):
    sets = []
    for i, t in docs:
        w = WS.findall(lower(t or ""))
        sets.append((i, {tuple(w[k:k + 4]) for k in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} - {()}))
    up = {i: i for i, _ in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i
    some = [(i, s) for i, s in sets if i is not None and s]
    for (i, a), (j, b) in itertools.combinations(some, 2):
        if 100 * len(a & b) >= 85 * len(a | b):
            x, y = sorted((root(i), root(j)))
            up[y] = x
    return collections.Counter((i, len(s), None if i is None else root(i)) for i, s in sets)


def join(rows, docs):
    return collections.Counter(tuple(r) for r in ngram_join.join_components(rows(docs).repartition(3)).collect())


def variants(rng, n, size, edits, start, vocabulary=3000):
    """Copies of one text with some words changed."""
    base = text(rng, size, vocabulary).split()
    out = []
    for i in range(n):
        w = list(base)
        for k in rng.sample(range(size), rng.randint(0, edits)):
            w[k] = f"x{rng.randrange(50)}"
        out.append((start + i, " ".join(w)))
    return out


def test_ngram_join_brute(spark, rows):
    rng = random.Random(11)
    docs = corpus() + variants(rng, 60, 200, 9, 1000) + variants(rng, 60, 60, 3, 2000) + variants(rng, 30, 12, 1, 3000, 40)
    # an id with several texts links what each of them links (and is not its class's smallest)
    docs += [(4002, docs[9][1]), (4005, docs[0][1]), (4005, docs[9][1]), (4009, docs[0][1])]
    docs += [(5000, "Ab cd"), (5001, "aB CD"), (5002, "Éa b"), (5003, "éa b")]
    assert join(rows, docs) == join_brute(docs)
    assert join(rows, []) == collections.Counter()
    assert join(rows, [(1, None), (1, None), (None, "a b c d")]) == join_brute([(1, None), (1, None), (None, "a b c d")])


def test_ngram_join_blocks_and_waves(spark, rows, monkeypatch):
    """Small blocks, few partners per task: nothing is lost in large buckets of several components."""
    monkeypatch.setattr(ngram_join, "BLOCK", 16)
    monkeypatch.setattr(ngram_join, "GROUP_PAIRS", 3)
    rng = random.Random(12)
    docs = []
    for g in range(4):  # one shared core, own endings: several components that share buckets
        core = text(random.Random(99), 150, 5000)
        for i, t in variants(rng, 40, 20, 2, 0, 5000):
            docs.append((1000 * g + i, core + " " + t))
    got = join(rows, docs)
    assert got == join_brute(docs) and len({c for _, _, c in got}) > 1


def test_ngram_join_partial_overlaps(spark):
    """Every fragment's partial counts add up to the whole overlap."""
    rng = random.Random(13)
    sets = {n: sorted(rng.sample(range(-400, 400), 300)) for n in range(8)}
    table = spark.createDataFrame([(n, 300, 300, s, [0, 40, 41, 100, 100, 250, 300]) for n, s in sets.items()],
                                  "node long, n int, shared int, grams array<long>, cuts array<int>")
    pairs = spark.createDataFrame([(a, b) for a in range(8) for b in range(a + 1, 8)], "a long, b long")
    assert ngram_join.overlaps(pairs, table, pairs).count() == 0
    same = spark.createDataFrame([(n, 300, 300, sets[n % 2], [0, 40, 41, 100, 100, 250, 300]) for n in range(8)],
                                 "node long, n int, shared int, grams array<long>, cuts array<int>")
    got = {(r.a, r.b) for r in ngram_join.overlaps(pairs, same, pairs).collect()}
    assert got == {(a, b) for a in range(8) for b in range(a + 1, 8) if (a - b) % 2 == 0}
