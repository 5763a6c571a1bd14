"""File-tree source, sinks, streaming, entity detectors."""
import os
import tempfile

import pytest

from pyspark.sql import functions as F

from scrubline import scan, scrub
from scrubline.operators import entities as N
from scrubline.sources import sinks
from scrubline.sources.files import documents_from_tree
from scrubline.streaming.stream import document_stream, scrub_stream


def test_tree_source_decodes(spark):
    root = tempfile.mkdtemp(prefix="scrubline-tree-")
    os.makedirs(os.path.join(root, "a", "b"))
    with open(os.path.join(root, "top.txt"), "wb") as fh:
        fh.write(b"mail bob@x.org\r\nline2\rline3")
    with open(os.path.join(root, "a", "b", "bad.bin"), "wb") as fh:
        fh.write(b"ok \xff\xfe card 4111 1111 1111 1111")
    d = {r.rel_path: r.text for r in documents_from_tree(spark, root).collect()}
    assert d["top.txt"] == "mail bob@x.org\nline2\nline3"
    assert d["a/b/bad.bin"] == "ok  card 4111 1111 1111 1111"


def test_sinks_roundtrip(spark, docs):
    out = tempfile.mkdtemp(prefix="scrubline-sink-")
    s = scrub(docs(["mail bob@x.org", "nothing"]), salt="s").withColumn("rel_path", F.concat(F.lit("d/"), F.col("doc_id").cast("string")))
    sinks.write_mirror(s, f"{out}/mirror")
    assert spark.read.parquet(f"{out}/mirror").count() == 2
    sinks.write_findings(s, f"{out}/findings", ["doc_id"])
    f = spark.read.json(f"{out}/findings").collect()
    assert len(f) == 1 and f[0].spans[0].value == "b***@x.org"
    sinks.write_report(s.withColumn("title", F.col("rel_path")), f"{out}/report", "title")
    assert "2 files" in spark.read.text(f"{out}/report/header").first().value
    sinks.write_review_queue(s, f"{out}/review", ["doc_id"], threshold=1.0)
    assert spark.read.json(f"{out}/review").count() == 1


def test_stream_equals_batch(spark, docs):
    src = tempfile.mkdtemp(prefix="scrubline-stream-")
    texts = ["mail bob@x.org", "ip 10.0.0.1 here", "plain"]
    docs(texts).write.mode("overwrite").parquet(f"{src}/in")
    q = (scrub_stream(document_stream(spark, f"{src}/in"), salt="s").writeStream.format("memory")
         .queryName("scrub_stream_test").outputMode("append")
         .option("checkpointLocation", f"{src}/ckpt").start())
    q.processAllAvailable()
    q.stop()
    got = {r.doc_id: r.sanitized for r in spark.sql("SELECT * FROM scrub_stream_test").collect()}
    batch = {r.doc_id: r.sanitized for r in scrub(docs(texts), salt="s").collect()}
    assert got == batch


def test_dictionary_terms_types_and_overlaps(spark, docs):
    d = docs(["Ann Lee met ACME Corp in New York; acme corp again", "nothing", "x ab y", None, "the st.john's st.  john's"])
    dic = spark.createDataFrame([("ACME Corp", "ORG"), ("new york", "LOC"), ("York", "LOC"), ("Ann", "PERSON"), ("ab", "MRN"),
                                 ("ab", "LOC"), ("st. john's", "LOC"), (None, "ORG"), (" ", "ORG")], "term string, type string")
    got = sorted((r.doc_id, s.start, s.end, s.type) for r in N.dictionary_entities(d, dic).collect() for s in r.dict_cands)
    assert got == [(0, 0, 3, "PERSON"), (0, 12, 21, "ORG"), (0, 25, 33, "LOC"), (0, 35, 44, "ORG"), (2, 2, 4, "LOC"), (4, 14, 25, "LOC")]


def test_dictionary_terms_of_any_length(spark, docs):
    long = " ".join(f"part{i}" for i in range(40))
    dic = spark.createDataFrame([(long, "ORG"), ("one two three", "LOC"), ("part1", "PERSON"), ("!!", "ORG")], "term string, type string")
    d = docs(["say One  two\nthree " + long.upper() + ".", "one two", "part0 part1 part2", ""])
    got = sorted((r.doc_id, s.text, s.type) for r in N.dictionary_entities(d, dic).collect() for s in r.dict_cands)
    assert got == [(0, "One  two\nthree", "LOC"), (0, long.upper(), "ORG"), (2, "part1", "PERSON")]
    assert N.dictionary_entities(d, dic.limit(0)).where("size(dict_cands) > 0").count() == 0


def test_dictionary_filter_of_many_words_and_too_full(spark, docs, monkeypatch):
    words = [f"w{i}" for i in range(6000)]
    dic = spark.createDataFrame([(w, "ORG") for w in words[::2]], "term string, type string")
    d = docs([" ".join(words)])
    want = [w for w in words[::2]]
    assert [s.text for s in N.dictionary_entities(d, dic).first().dict_cands] == want
    monkeypatch.setattr(N, "BLOOM_MAX_SLOTS", 16)  # every n-gram passes a filter this full, terms decide
    assert [s.text for s in N.dictionary_entities(d, dic).first().dict_cands] == want


def test_dictionary_words_are_those_of_the_rule(spark, docs):
    texts = ["a.b a..b a.-b 'x' St.John's-Wood", "ΟΔΟΣ οδοσ οδος K k ß ẞ İx", "naïve—café 𝔘nicode 漢字 x́y Ǆ ǅ", "", None,
             "a#", "#a", "1.2.3. ..", "x" * 5000 + " y", "ab\n", "½ Ⅷ ٣"]
    letters = N.letter_table(spark)
    tokens = F.regexp_extract_all("text", F.lit(N.TOKEN_RE), 0)
    rows = docs(texts).select("text", F.coalesce(tokens, F.array()).alias("words"), F.transform(tokens, F.lower).alias("lower")).collect()
    assert len({w for r in rows for w in r.words}) > 20
    begin = 0
    start, end, _ = N.find_tokens([t or "" for t in texts], letters)
    for r in rows:
        own = (start >= begin) & (start < begin + len(r.text or "") + 1)
        assert [(r.text or "")[a - begin:b - begin] for a, b in zip(start[own], end[own])] == r.words
        for word, lower in zip(r.words, r.lower or []):
            if "̇" not in lower:  # not a letter: no term begins with it
                assert N.find_tokens([word], letters)[2] == N.find_tokens([lower], letters)[2]
        begin += len(r.text or "") + 1
    hashes = {w: N.find_tokens([w], letters)[2][0] for w in ("ab", "ba", "a", "b", "a.b", "a-b", "b.a")}
    assert len(set(hashes.values())) == len(hashes)


def test_dictionary_chunks_of_texts(spark, monkeypatch):
    import pyarrow as pa
    texts = pa.array(["out", "abc", None, "", "defghi" * 5, "é", "j"]).slice(1)
    for n in (1, 4, 1000):
        monkeypatch.setattr(N, "TOKEN_CHARS", n)
        chunks = list(N._text_chunks(texts))
        assert [t for c in chunks for t in c] == ["abc", "", "", "defghi" * 5, "é", "j"]
    assert len(chunks) == 1


def test_dictionary_rows_of_one_key_and_plan(spark):
    d = spark.createDataFrame([(1, "Ann met bob"), (1, "bob, Ann"), (1, "bob, Ann"), (None, "Ann"), (2, None), (3, "zed")], "doc_id long, text string")
    dic = spark.createDataFrame([("ann", "PERSON"), ("Bob", "PERSON")], "term string, type string")
    out = N.dictionary_entities(d, dic)
    got = sorted((str(r.doc_id), str(r.text), [s.text for s in r.dict_cands]) for r in out.collect())
    assert got == [("1", "Ann met bob", ["Ann", "bob"]), ("1", "bob, Ann", ["bob", "Ann"]), ("1", "bob, Ann", ["bob", "Ann"]),
                   ("2", "None", []), ("3", "zed", []), ("None", "Ann", [])]
    assert out.columns == ["doc_id", "text", "dict_cands"]
    # the words of a text are found in Arrow batches, and joins and shuffles carry hits, not texts
    spans = out.select("doc_id", F.explode("dict_cands"))
    plan = spans._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 0


def test_model_hook_and_ruler_yield(spark, docs):
    d = docs(["Dr Jane Doe lives at 10 Main Street in 2024"])
    m = N.model_entities(d, N.regex_scorer([(r"Jane Doe", "PERSON"), (r"Main Street", "FAC"), (r"2024", "DATE")]))
    r = m.first()
    assert [(s.text, s.type) for s in r.model_cands] == [("Jane Doe", "PERSON"), ("2024", "DATE")]
    from scrubline import ScanConfig
    out = scan(m, config=ScanConfig(ruler=True), model_col="model_cands").first()
    assert ("Jane Doe", "PERSON") in [(s.text, s.type) for s in out.spans]


def test_run_scrub_job(spark, docs):
    from scrubline.plans.jobs import run_scrub_job
    out = tempfile.mkdtemp(prefix="scrubline-job-")
    d = docs(["mail bob@x.org", "nothing"]).withColumn("rel_path", F.concat(F.lit("f"), F.col("doc_id").cast("string")))
    summary = run_scrub_job(d, out, salt="s").first()
    assert summary.files == 2 and summary.entities == 1
    assert spark.read.parquet(f"{out}/jobs").count() == 2


def test_tree_source_finds_every_file(spark, tmp_path):
    root = tmp_path / "tree"
    for name in ("a.txt", ".env", "_conf.yml", ".cfg/c.txt", "_sub/d/e.log", "sp ace é.txt"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(f"mail x@{name[:1]}.org\r\nend".encode())
    (root / "gone.txt").symlink_to(root / "nowhere")
    want = {"a.txt", ".env", "_conf.yml", ".cfg/c.txt", "_sub/d/e.log", "sp ace é.txt"}
    for uri in (str(root), str(root) + "/", f"file://{root}"):
        got = {r.rel_path: r for r in documents_from_tree(spark, uri).collect()}
        assert {k for k, r in got.items() if r.readable} == want, uri
        assert all(r.text.endswith(".org\nend") for r in got.values() if r.readable)
    one = documents_from_tree(spark, str(root / ".env")).collect()
    assert [(r.rel_path, r.readable) for r in one] == [(".env", True)]
    assert documents_from_tree(spark, str(root), glob="*.txt").where("readable").count() == 3


def test_tree_source_keeps_names_apart(spark, tmp_path):
    root = tmp_path / "tree"
    names = ["a b.txt", "a%20b.txt", "a+b.txt", "x/a b.txt", "x/a%20b.txt", "x/.h/[1]{2}?*.txt", "_u/é.txt"]
    for n in names:
        (root / n).parent.mkdir(parents=True, exist_ok=True)
        (root / n).write_text(f"file {n}")
    os.symlink(root / "x", root / "loop")  # not followed
    for uri in (str(root), f"file://{root}", f"file:{root}/"):
        assert {r.rel_path: r.text for r in documents_from_tree(spark, uri).collect()} == {n: f"file {n}" for n in names}
    with pytest.raises(FileNotFoundError):
        documents_from_tree(spark, str(root / "none"))


def test_tree_through_spark_only_file_systems(spark, tmp_path):
    """The way for file systems that Arrow cannot open keeps names apart too."""
    from scrubline.sources.files import _read_by_spark
    for n in ("a b.txt", "a%20b.txt", "d/e.txt"):
        (tmp_path / n).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / n).write_text(n)
    got = {r.rel_path: bytes(r.content).decode() for r in _read_by_spark(spark, str(tmp_path), None).collect()}
    assert got == {n: n for n in ("a b.txt", "a%20b.txt", "d/e.txt")}


def test_write_files_and_manifest(spark, tmp_path):
    rows = [("a/b.txt", "one"), ("a/é c.txt", ""), ("none", None), ("../out", "x"), ("/abs", "x"), ("", "x"), (None, "x"), ("a/../b", "x")]
    df = spark.createDataFrame(rows, "rel_path string, sanitized string").repartition(3)
    out = f"{tmp_path}/tree"
    for _ in range(2):  # writing again replaces the same files
        told = {r.rel_path: (r.status, r.n_bytes) for r in sinks.write_files(df, out).collect()}
        assert told == {"a/b.txt": ("written", 3), "a/é c.txt": ("written", 0), "none": ("skipped", None), "../out": ("refused", None),
                        "/abs": ("refused", None), "": ("refused", None), None: ("refused", None), "a/../b": ("refused", None)}
        assert sorted(str(p.relative_to(tmp_path)) for p in tmp_path.rglob("*") if p.is_file() and "tree.manifest" not in str(p)) == [
            "tree/a/b.txt", "tree/a/é c.txt"]
    with pytest.raises(ValueError, match="one relative path"):
        sinks.write_files(df.union(df.limit(1)), out)


RETRY = """
import sys
sys.path.insert(0, sys.argv[1])
from pyspark import TaskContext
from pyspark.sql import SparkSession
from scrubline.sources import sinks
spark = SparkSession.builder.master("local[2,3]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
def fail_once(batches):
    for n, b in enumerate(batches):
        yield b
        if TaskContext.get().attemptNumber() == 0 and n == 2:
            raise RuntimeError("this attempt is lost")
spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10)
df = spark.range(200).selectExpr("concat('d', id % 7, '/', id) AS rel_path", "concat('text ', id) AS sanitized").coalesce(2)
told = sinks.write_files(df.mapInArrow(fail_once, df.schema), sys.argv[2])
print(told.where("status = 'written'").count(), told.select("attempt").distinct().count())
"""


def test_write_files_survives_a_lost_attempt(tmp_path):
    import subprocess
    import sys
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    got = subprocess.run([sys.executable, "-c", RETRY, repo, str(tmp_path / "out")], capture_output=True, text=True, timeout=300)
    assert got.stdout.split() == ["200", "2"], got.stderr[-2000:]
    files = {str(p.relative_to(tmp_path / "out")): p.read_text() for p in (tmp_path / "out").rglob("*") if p.is_file()}
    assert files == {f"d{i % 7}/{i}": f"text {i}" for i in range(200)}
    assert not [p for p in tmp_path.iterdir() if "writing" in p.name]


def test_customers_are_dealt_before_they_are_texts(spark, tmp_path, monkeypatch):
    """A customer table of one split is the work of many tasks, also where the
    optimizer takes its join for a large input."""
    from scrubline import session
    from scrubline.sources.corpus import corpus
    from scrubline.sources.tables import customers

    spark.range(3000).selectExpr("id AS c_custkey", "concat('Customer#', id) AS c_name", "id % 3 AS c_nationkey").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(i, f"N{i}") for i in range(3)], "n_nationkey long, n_name string").coalesce(1).write.parquet(f"{tmp_path}/nation.parquet")
    monkeypatch.setattr(session, "BALANCE_BYTES", 1)
    cores = spark.sparkContext.defaultParallelism
    records = corpus(spark, str(tmp_path), ("records",))
    sizes = records.groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) >= cores and max(r["count"] for r in sizes) < 2 * 3000 / cores
    assert records.select("doc_id").distinct().count() == 3000
    assert customers(spark, str(tmp_path), ["c_custkey"]).rdd.getNumPartitions() >= cores
