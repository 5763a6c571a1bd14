"""Edge cases and brute-force versions of the training-data operators."""
import collections
import hashlib
import math
import random
import re
import uuid
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from scrubline.llm import (decontamination, exact_dedup, language_id, lm_scoring, mixing, near_dedup, quality,
                           substring_dedup, token_output, warc)
from scrubline.llm._common import shared_path

WS = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def text(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}é" for _ in range(n))


def corpus(seed=1):
    """Documents with copies, near copies, shared passages, ties, nulls, empty,
    short, very long and repeated rows."""
    rng = random.Random(seed)
    base = [text(rng, n) for n in (120, 200, 60, 300, 90)]
    near = base[1].split()
    near[50] = "changed"
    passage = " ".join(base[3].split()[20:80])
    docs = [(1, base[0]), (2, base[0] + " \n"), (3, base[1]), (4, " ".join(near)), (5, None), (6, ""), (7, "  \t\n"),
            (8, "one two three"), (9, "ONE two\vthree"), (10, base[2] + " " + passage), (11, base[3]), (12, passage + " " + base[4]),
            (13, "same " * 100), (14, text(rng, 6000)), (15, base[2]), (16, "one two three")]
    docs += [(100 + i, base[4] + f" tail{i % 3}") for i in range(40)]
    return [*docs, (16, "one two three"), (None, base[0]), (None, None)]


def by_id(df, *cols):
    return collections.Counter(tuple(r[c] for c in cols) for r in df.collect())


# ---------------------------------------------------------------- 1 exact dedup

def new_index(spark, buckets=4):
    path = shared_path(spark, "index")
    return exact_dedup.DigestIndex(spark, f"idx_{uuid.uuid4().hex}", path, buckets)


def test_exact_dedup_rows_and_batches(spark, rows):
    docs = corpus()
    index = new_index(spark)
    got = exact_dedup.dedup_batch(rows(docs), index)
    groups = collections.defaultdict(list)
    for i, t in docs:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((i, len(t or "")))
    want = collections.Counter()
    for bare, g in groups.items():
        keep = min(g, key=lambda x: (-x[1], x[0] is None, x[0] or 0))[0]
        for i, _ in g:
            want[i, keep, len(g), i == keep, hashlib.sha256(bare.encode()).hexdigest()] += 1
    assert by_id(got, "doc_id", "keep_id", "group_size", "kept", "text_sha256") == want
    assert index.table().count() == len(groups)
    # a second batch: known texts go to the index's rows, new ones are added
    again = exact_dedup.dedup_batch(rows([(900, docs[0][1]), (901, "brand new")]), index)
    assert by_id(again, "doc_id", "keep_id", "kept") == {(900, 2, False): 1, (901, 901, True): 1}
    assert index.table().count() == len(groups) + 1
    plan = index.table().hint("merge").join(got.select("text_sha256").withColumnRenamed("text_sha256", "digest"), "digest", "left_anti")
    assert "Bucketed: true" in plan._jdf.queryExecution().toString()


def test_exact_dedup_empty(spark, rows):
    assert exact_dedup.dedup_batch(rows([]), new_index(spark)).count() == 0


# ---------------------------------------------------------------- 2 quality

def labelled(seed, n):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        kind = rng.choice(("good", "good", "good", "toxic", "shout", "repeat"))
        words = text(rng, rng.randrange(30, 120)).split()
        if kind == "toxic":
            words[::9] = ["vileword" if k % 2 else "nastyword" for k in range(len(words[::9]))]
        if kind == "shout":
            words = [w.upper() + "!!" for w in words]
        if kind == "repeat":
            words = [words[0]] * len(words)
        out.append((i, " ".join(words), kind))
    return out


def test_quality_held_out_and_edges(spark):
    data = labelled(3, 600)
    docs = spark.createDataFrame([(i, t, f"host{i % 5}" if i % 7 else None, "en", 0.5) for i, t, _ in data]
                                 + [(5000, None, None, None, 0.1), (5001, "", "lone", "en", 0.1), (5001, "", "lone", "en", 0.1)],
                                 "doc_id long, text string, source string, lang string, p_doc double")
    labels = spark.createDataFrame([(i, int(k not in ("shout", "repeat")), int(k == "toxic")) for i, _, k in data if i < 300]
                                   + [(None, 0, 1), (9999, 0, None)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality.classify(docs, labels).collect()}
    assert len(got) == 602
    held = [(got[i]["kept"], k == "good") for i, _, k in data if i >= 300]
    assert sum(a == b for a, b in held) / len(held) >= 0.97
    kept = quality.good_documents(docs, labels)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, r in got.items() if r["kept"]}


def test_quality_without_labels(spark, rows):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = quality.classify(rows(corpus()), labels)
    assert got.count() == len(corpus()) and got.where("NOT kept").count() == 0
    assert quality.classify(rows([]), labels).count() == 0


def test_quality_from_shapes_alone(spark):
    """Texts and models without telling words."""
    docs = spark.createDataFrame([(i, "Fine words here." if i % 2 else "SHOUT!!! " * 3, "h", None) for i in range(40)] + [(99, "", "h", None)],
                                 "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([(0, 0, 0), (1, 1, 0), (2, 0, 0), (3, 1, 0), (4, None, None)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r["kept"] for r in quality.classify(docs, labels).collect()}
    assert len(got) == 41 and all(got[i] == bool(i % 2) for i in range(40))


def test_site_shrinkage(spark):
    """A large bad host raises its documents' odds, a sparse one stays near the prior."""
    data = labelled(5, 400)
    def host(i, k):
        return "bad" if k != "good" and i % 2 else "fine" if i % 40 else "sparse"
    docs = spark.createDataFrame([(i, t, host(i, k), "en") for i, t, k in data], "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([(i, int(k not in ("shout", "repeat")), int(k == "toxic")) for i, _, k in data], "doc_id long, quality int, toxic int")
    site = {r["host"]: r["m"] for r in quality.classify(docs, labels).groupBy("host").agg({"p_site": "avg"}).withColumnRenamed("avg(p_site)", "m").collect()}
    assert site["bad"] > site["sparse"] > 0 and site["bad"] > site["fine"]


# ---------------------------------------------------------------- 3 language

def test_language_held_out_and_edges(spark):
    rng = random.Random(2)
    sounds = {"aa": ["ka", "lo", "mi", "tu"], "bb": ["sch", "ung", "ei", "ver"], "cc": ["ñó", "que", "ll", "ción"]}
    data = []
    for i in range(300):
        lang = rng.choice(list(sounds))
        data.append((i, " ".join("".join(rng.choices(sounds[lang], k=3)).title() for _ in range(20)), lang))
    docs = spark.createDataFrame(data + [(900, None, "aa"), (901, "12 34 !!", None), (902, "", "bb")], "doc_id long, text string, lang string")
    docs = docs.selectExpr("*", "doc_id % 3 = 1 AS held_out", "1 AS score")
    filters = language_id.learn(docs.where("NOT held_out"))
    got = {r["doc_id"]: r for r in language_id.predict(docs, filters).collect()}
    assert len(got) == 303
    assert all(got[i]["lang_pred"] == lang and 0 <= got[i]["score"] <= 1 for i, _, lang in data)
    assert {got[i]["lang_pred"] for i in (900, 901, 902)} == {"und"} and got[900]["score"] == 0
    nothing = language_id.learn(docs.where("false"))
    assert {r["lang_pred"] for r in language_id.predict(docs, nothing).collect()} == {"und"}


def test_language_filter_against_sets():
    """Bits are never missing, and corrected counts are near the true ones."""
    rng = np.random.default_rng(1)
    grams = rng.integers(1, 1 << 60, 5000, np.uint64)
    lang = rng.integers(0, 11, 5000)
    f = language_id.LanguageFilters([f"l{i:02}" for i in range(11)], [1] * 11, grams, lang)
    for i in range(11):
        mine = grams[lang == i]
        c = f.counts(mine, np.array([0, len(mine)]))[0]
        assert c[i] == pytest.approx(len(mine)) and max(np.delete(c, i)) < 0.02 * len(mine) + 5
    assert f.counts(rng.integers(1, 1 << 60, 4000, np.uint64), np.array([0, 4000])).max() < 40


# ---------------------------------------------------------------- 4 WARC

def test_warc_round_trip(spark):
    big = "<p>" + "é" * 600
    pages = [(1, "http://a/ b", big), (2, "http://b", big), (9, None, big), (3, "u", None), (4, "u", ""), (5, "u", "x" * 999),
             (6, "u", "x" * 999), (7, "u", "y\r\n\r\n" * 400), (None, "u", big), (7, "u", "y\r\n\r\n" * 400), (8, "u", "WARC/1.1\r\n" * 300)]
    df = spark.createDataFrame([(*p, 5) for p in pages], "page_id long, url string, html string, payload_bytes int")
    index = warc.write_archive(df, shared_path(spark, "warc"), segment_bytes=2000)
    got = warc.read_records(index)
    want = collections.Counter()
    for i, _, h in pages:
        b = (h or "").encode()
        top = max((j for j, _, g in pages if (g or "") == (h or "") and j is not None), default=None)
        rev = len(b) >= 1000 and i != top
        want[i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if rev else "response", top if rev else None] += 1
    assert by_id(got, "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to") == want
    assert {bytes(r["payload"]).decode() for r in got.collect() if r["page_id"] == 9} == {big}
    # selected records only
    some = warc.read_records(index.where("page_id IN (4, 8)")).collect()
    assert sorted(r["page_id"] for r in some) == [4, 8]
    assert warc.read_records(warc.write_archive(df.where("false"), shared_path(spark, "warc"))).count() == 0


# ---------------------------------------------------------------- 5 substring dedup

def brute_repeats(docs, k):
    words = [WS.findall(t or "") for _, t in docs]
    seen = collections.Counter(tuple(w[i:i + k]) for w in words for i in range(len(w) - k + 1))
    out = collections.Counter()
    for (d, _), w in zip(docs, words):
        gone = [False] * len(w)
        for i in range(len(w) - k + 1):
            if seen[tuple(w[i:i + k])] > 1:
                gone[i:i + k] = [True] * k
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out[d, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()] += 1
    return out


def test_substring_dedup_against_brute_force(spark, rows):
    docs = corpus()
    got, changed = substring_dedup.remove_repeats(rows(docs))
    assert by_id(got, "doc_id", "n_words", "n_removed", "kept_sha256") == brute_repeats(docs, 35)
    assert changed.where("n_removed > 0 AND size(starts) = 0").count() == 0


def test_substring_dedup_dense_repeats(spark, rows):
    """Few words, so windows overlap, repeat inside a text and share blocks."""
    rng = random.Random(8)
    docs = [(i, " ".join(rng.choice("ab") * rng.randrange(1, 3) for _ in range(rng.randrange(0, 90)))) for i in range(40)]
    docs += [(50, "a b " * 40), (51, "b a " * 40), (52, "a b " * 40 + "c")]
    got, _ = substring_dedup.remove_repeats(rows(docs), window=9, seed_words=4)
    assert by_id(got, "doc_id", "n_words", "n_removed", "kept_sha256") == brute_repeats(docs, 9)
    assert substring_dedup.remove_repeats(rows([]))[0].count() == 0


# ---------------------------------------------------------------- 6 LM scoring

def test_lm_scores_against_brute_force(spark, rows, monkeypatch):
    monkeypatch.setattr(lm_scoring, "BATCH_BYTES", 2000)  # several batches and hash partitions
    docs = [(i, t) for i, t in corpus() if i != 14]
    got = lm_scoring.backoff_scores(rows(docs)).collect()
    words = [WS.findall(lower(t or "")) for _, t in docs]
    grams = lambda w: collections.Counter(tuple(w[i:i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1))
    whole, total = sum((grams(w) for w in words), collections.Counter()), sum(map(len, words))
    want = collections.Counter()
    for (d, _), w in zip(docs, words):
        own, s = grams(w), 0.0
        for i in range(len(w)):
            c = lambda g: whole[g] - own[g]
            x = math.log(max(1, c((w[i],))) / max(1, total - len(w)))
            for k in (1, 2):
                if i >= k:
                    g = tuple(w[i - k:i + 1])
                    x = math.log(c(g) / c(g[:-1])) if c(g) else math.log(0.4) + x
            s += x
        want[d, len(w), round(s, 6) if w else None] += 1
    assert collections.Counter((r["doc_id"], r["n_words"], None if r["log_score"] is None else round(r["log_score"], 6)) for r in got) == want
    assert lm_scoring.backoff_scores(rows([])).count() == 0


# ---------------------------------------------------------------- 2 again

def test_quality_of_ids_with_several_texts(spark, rows):
    """The smallest text of a labelled id is learned from, wherever its rows are."""
    rng = random.Random(17)
    docs = [(i, text(rng, 40, 900) + (" vileword" * 3 if i % 2 else "")) for i in range(120)]
    again = [(i, "zz " + text(rng, 40, 900) + (" vileword" * 3 if i % 3 else "")) for i in range(0, 120, 2)]
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(80)], "doc_id long, quality int, toxic int")
    models = [quality.fit(rows(x).repartition(n), labels) for x, n in ((docs + again, 1), (again + docs, 5))]
    assert (np.sort(models[0].words) == np.sort(models[1].words)).all()
    shapes = [quality.classify(rows(x), labels).where("doc_id = 1").first()["p_doc"] for x in (docs + again, again + docs)]
    assert shapes[0] == pytest.approx(shapes[1], abs=1e-9)


# ---------------------------------------------------------------- 7 decontamination

@pytest.mark.parametrize("block", [1 << 20, 300])
def test_decontamination_against_brute_force(spark, rows, block):
    docs = corpus()
    long = docs[13][1].split()
    items = [(1, " ".join(long[100:130])), (2, "TWO three"), (3, None), (4, "..."), (5, "w1é-w2é"), (10, " ".join(long[5990:6000])),
             (11, "not there at all"), (2, "TWO three"), (12, "one"), (None, "same same same")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.find_contamination(rows(docs), bench, block_bytes=block)
    want = collections.Counter()
    for d, t in docs:
        w = ALNUM.findall(lower(t or ""))
        hit, found = [False] * len(w), set()
        for i, it in items:
            x = ALNUM.findall(lower(it or ""))
            n = min(10, len(x))
            for a in range(len(x) - n + 1) if x else ():
                for p in range(len(w) - n + 1):
                    if w[p:p + n] == x[a:a + n]:
                        hit[p:p + n] = [True] * n
                        found.add("null" if i is None else str(i))
        want[d, len(w), sum(hit), tuple(sorted(found)), any(hit)] += 1
    rows_ = got.collect()
    assert collections.Counter((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"]), r["contaminated"]) for r in rows_) == want
    longest = max((m["n_words"], m["item_id"]) for r in rows_ if r["doc_id"] == 14 for m in r["matches"])
    assert longest == (30, "1")
    clean = decontamination.clean_documents(rows(docs), bench)
    assert clean.count() == sum(n for k, n in want.items() if not k[4])
    assert decontamination.find_contamination(rows([]), bench).count() == 0
    assert decontamination.find_contamination(rows(docs), bench.where("false")).where("contaminated").count() == 0


def test_decontamination_names_of_many_odd_items(spark, rows, monkeypatch):
    """Ids of any characters keep their names beyond a thousand items, and blocks of too many words are halved."""
    items = [(f"z{i:05}", f"only{i} words{i} here{i}") for i in range(1200)] + [("x\x1fy", "alpha beta gamma"), ("a,b", "beta gamma delta")]
    bench = spark.createDataFrame(items, "item_id string, text string")
    docs = [(1, "say Alpha beta gamma delta"), (2, "only7 words7 here7, only1199 words1199 here1199"), (3, "only8 words7")]
    want = {1: ["a,b", "x\x1fy"], 2: ["z00007", "z01199"], 3: []}
    got = decontamination.find_contamination(rows(docs), bench)
    assert {r["doc_id"]: r["items"] for r in got.collect()} == want
    monkeypatch.setattr(decontamination, "_BITS", 8)  # 3605 distinct words
    halves = decontamination.lookups(items)
    assert [n for h in halves for n in h.names] == [n for n, _ in items] and all(len(h.vocabulary) < 256 for h in halves)
    with pytest.raises(decontamination.TooManyWords):
        decontamination.lookups([("a", " ".join(f"w{i}" for i in range(300)))])


# ---------------------------------------------------------------- 8 mixing

def test_mixing_targets_and_copies(spark):
    rng = random.Random(4)
    data = [(i, text(rng, rng.randrange(0, 60)), s) for i in range(600) for s in [rng.choice(["b", "a", "é", None, "z", "z", "z", "z"])]]
    data += [(1, data[1][1], data[1][2]), (None, None, "void"), (None, "", "void")]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string").selectExpr("*", "7 AS copies", "1 AS target")
    got = mixing.mix(docs).collect()
    assert len(got) == len(data)
    per = collections.defaultdict(lambda: [0, 0, 0.0])
    for r in got:
        assert r["taken"] <= 3 * r["size"] and r["taken"] == r["copies"] * r["size"]
        per[r["source"]][0] += r["size"]
        per[r["source"]][1] += r["taken"]
        per[r["source"]][2] = r["target"]
    names = sorted((x for x in per if x is not None)) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, full = sum(v[0] for v in per.values()), set()
    while True:
        rate = (total - sum(3 * per[s][0] for s in full)) / sum(weight[s] for s in names if s not in full)
        more = {s for s in names if s not in full and rate * weight[s] > 3 * per[s][0]}
        if not more:
            break
        full |= more
    for s in names:
        want = 3 * per[s][0] if s in full else rate * weight[s]
        assert per[s][2] == pytest.approx(want) and abs(per[s][1] - want) <= 130, s
    assert collections.Counter(map(tuple, mixing.mix(docs).collect())) == collections.Counter(map(tuple, got))
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    assert out.count() == sum(r["copies"] for r in got)
    assert mixing.mix(docs.where("false")).count() == 0


def test_mixing_is_native(spark, rows):
    plan = mixing.mix(rows(corpus()))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# ---------------------------------------------------------------- 9 near dedup

def brute_components(docs):
    sets = {}
    for d, t in docs:
        w = WS.findall(lower(t or ""))
        sets.setdefault(d, []).append(frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    ids = [d for d in sets if d is not None]
    up = {d: d for d in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            if any(x and y and 100 * len(x & y) >= 85 * len(x | y) for x in sets[a] for y in sets[b]):
                ra, rb = root(a), root(b)
                up[max(ra, rb)] = min(ra, rb)
    return sets, {d: root(d) for d in ids} | {None: None}


def test_near_dedup_against_brute_force(spark, rows):
    docs = corpus()
    rng = random.Random(11)
    for c in range(6):  # families of edits of edits, some links only by bridges
        words = text(rng, 150).split()
        for i in range(12):
            docs.append((1000 + 100 * c + i, " ".join(words)))
            words[rng.randrange(150)] = f"edit{c}_{i}"
            if i % 4 == 3:
                words[rng.randrange(150)] = f"more{c}_{i}"
    docs += [(1003, docs[-1][1]), (1003, docs[-5][1])]  # one id with texts of two families
    # ids that link two classes without being the smallest of both
    docs += [(2002, docs[9][1]), (2005, docs[0][1]), (2005, docs[9][1]), (2009, docs[0][1])]
    got = near_dedup.near_components(rows(docs))
    sets, comp = brute_components(docs)
    assert {(r["doc_id"], r["component_id"], r["kept"]) for r in got.collect()} == {(d, comp[d], d == comp[d]) for d, _ in docs}
    assert got.count() == len(docs)
    assert {(r["doc_id"], r["n_shingles"]) for r in got.collect()} == {(d, len(s)) for d, x in sets.items() for s in x}
    kept = near_dedup.distinct_documents(rows(docs))
    assert {r["doc_id"] for r in kept.collect()} == {d for d in comp if d == comp[d]}
    assert near_dedup.near_components(rows([])).count() == 0


def test_near_dedup_split_buckets(spark, rows, monkeypatch):
    """Buckets of several components split by a second band keep every link."""
    monkeypatch.setattr(near_dedup, "SPLIT_BUCKET", 3)
    rng = random.Random(12)
    common = text(rng, 400).split()
    docs = [(i, " ".join(common[:300 + 4 * (i % 20)] + [f"x{i // 2}_{k}" for k in range(25 + i % 7)])) for i in range(60)]
    got = near_dedup.near_components(rows(docs))
    _, comp = brute_components(docs)
    assert {(r["doc_id"], r["component_id"]) for r in got.collect()} == {(d, comp[d]) for d, _ in docs}


def test_near_dedup_deals_large_buckets(spark, monkeypatch):
    """No group holds a large bucket, every two members meet once, with their refusal."""
    monkeypatch.setattr(near_dedup, "SPLIT_BUCKET", 8)
    n = 64
    parts = spark.createDataFrame([(1, i, i, n, 1, None) for i in range(n)],
                                  "key long, node long, component long, members long, first long, second long")
    sigs = spark.createDataFrame([(i, b"s") for i in range(n)], "node long, sig binary")
    bands = spark.createDataFrame([(i, list(range(1, 25))) for i in range(n)], "node long, bands array<long>")
    pairs = [(0, i) for i in range(1, 30)] + [(3, 17), (40, 41)]
    rows = near_dedup._dealt(parts, sigs, spark.createDataFrame(pairs, "a long, b long"), bands).where("key = 1").collect()
    groups, refused = {}, {}
    for r in rows:
        if r["kind"] == 1:
            groups.setdefault((r["i"], r["j"]), {})[r["node"]] = r["block"]
        else:
            refused[r["node"], r["other"]] = r["i"], r["j"]
    assert max(len(g) for g in groups.values()) < n // 2
    met = [(a, b) for (i, j), g in groups.items() for a in g for b in g if a < b and (i == j or g[a] != g[b])]
    assert sorted(met) == [(a, b) for a in range(n) for b in range(a + 1, n)]
    assert refused.keys() == set(pairs) and all({a, b} <= groups[g].keys() for (a, b), g in refused.items())


def test_signature_similarity():
    rng = np.random.default_rng(3)
    for share in (0.5, 0.85, 0.95):
        est = []
        for _ in range(30):
            both = rng.integers(0, 1 << 63, int(600 * share), np.uint64)
            a, b = (np.sort(np.concatenate([both, rng.integers(0, 1 << 63, (600 - len(both)) // 2, np.uint64)])) for _ in "ab")
            sigs = [near_dedup.pack(near_dedup.minima(x, np.array([0]))) for x in (a, b)]
            est.append(near_dedup.estimates(sigs[0], sigs[1])[0])
        assert abs(np.mean(est) - share) < 0.03


# ---------------------------------------------------------------- 10 token output

@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 60000), st.integers(0, 2 ** 64 - 1)), max_size=400), st.integers(1, 130))
def test_simple8b_round_trip(values, block):
    v = np.array(values, np.uint64)
    words, offsets = token_output.encode(v, block)
    assert (token_output.decode(words, offsets, len(v), block) == v).all()


def test_token_files_round_trip(spark, rows, monkeypatch):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer
    path = public.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    odd = "A<|endoftext|>b. <|startoftext|> <|ENDOFTEXT|>. it's we'll. CAN'T! x.. İstanbul. ΣΑΣ. é. ́b ﬁ. 12. 3,4\x85q\xa0z. é."
    docs = [*corpus(), (200, odd), (201, odd.lower())]
    docs = [d for d in docs if d[0] is not None] + [(None, "null id")]
    folder = shared_path(spark, "tokens")
    manifest = token_output.write_tokens(rows(docs), folder, path)
    got = token_output.read_tokens(manifest).collect()
    assert len(got) == len(docs)
    start = 0
    for r in sorted(got, key=lambda r: r["start"]):
        t = next(t for i, t in docs if i == r["doc_id"])
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes())), r["doc_id"]
        start += len(ids)
    ids = [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    one = manifest.orderBy("start").first()
    f = token_output.TokenFile(one["file"])
    whole = f.read(0, f.n_ids)
    for a, b in ((0, 5), (f.n_ids // 2, f.n_ids), (3, 3), (1020, min(3000, f.n_ids))):
        assert (f.read(a, b) == whole[a:b]).all()
    assert token_output.token_table(rows([])).count() == 0


def test_word_memory_composes_before_it_lower_cases():
    """Capitals whose composed form exists in lower case only, alone and in words."""
    import public_tokenizers
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    texts = ["H\u0331 h\u0331 T\u0308 J\u030C W\u030A Y\u030A", "aH\u0331b, (Y\u030A) J\u030Cx. \u00C9t\u00C9! E\u0301 PLAIN Plain,",
             "t\u0308 T\u0308 w\u030A<|endoftext|>W\u030A =\u0338 <\u0338"]
    raw = [t.encode() for t in texts]
    encoder = token_output.WordEncoder(tokenizer)
    for _ in range(2):  # learned, then remembered
        ids, n = encoder.encode(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0] + [len(x) for x in raw]))
        got = [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])]
        assert got == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
