"""External findings (mocked responses) and usage accounting."""
import datetime as dt
import json

from pyspark.sql import Window
from pyspark.sql import functions as F

from scrubline.operators import external as X
from scrubline.operators import usage as G


def _locate(spark, text, response):
    df = spark.createDataFrame([(1, text, response)], "doc_id long, text string, response string")
    d = X.locate_findings(df)
    return d.select("ext.success", "ext.confidence", "located").first()


def test_mocked_response_offsets_ignored(spark):
    text = "Hello John Smith, SSN 123-45-6789"
    resp = json.dumps({"entities": [{"text": "John Smith", "type": "PERSON", "start": 0, "end": 3, "confidence": 0.9}],
                       "reasoning": "r", "confidence": "high"})
    r = _locate(spark, text, resp)
    s = r.located[0].spans
    assert r.success and [(x.start, x.end, x.text) for x in s] == [(6, 16, "John Smith")]


def test_repeated_and_overlapping_values(spark):
    text = "John Smith called John Smith at john@email.com and john@email.com; aaa"
    resp = json.dumps({"entities": [{"text": "John Smith"}, {"text": "john@email.com", "type": "EMAIL"}, {"text": "aa"}]})
    r = _locate(spark, text, resp)
    assert [len(e.spans) for e in r.located] == [2, 2, 2]     # "aa" overlaps itself in "aaa"
    assert r.located[0].type == "OTHER" and r.located[0].action == "mask" and r.located[0].confidence == 0.8


def test_fallbacks(spark):
    text = "Met ALICE Doe at the Grand Hotel Central Station yesterday"
    resp = json.dumps({"entities": [{"text": "alice doe"}, {"text": "Grand Hotel X Central Station"}, {"text": "Nowhere Else"}]})
    r = _locate(spark, text, resp)
    m = [[x.method for x in e.spans] for e in r.located]
    assert m == [["fuzzy"], ["partial"], []]


def test_malformed_and_void(spark):
    assert not _locate(spark, "x", "{not json").success
    assert not _locate(spark, "x", json.dumps({"entities": [{"type": "ORG"}]})).success
    assert not _locate(spark, "x", json.dumps({"entities": [{"text": "x", "confidence": "high"}]})).success
    assert _locate(spark, "   \n\t   ", json.dumps({"entities": []})).success


def _jobs(spark, rows):
    return spark.createDataFrame(rows, "job_id long, user_id long, created_at timestamp, status string, "
                                       "preview_only boolean, file_type string, file_size_bytes long, "
                                       "entities_detected long, processing_time_seconds double")


def test_admission_limits(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(i, 1, t0 + dt.timedelta(minutes=i), "completed", False, "txt", 100, 1, 1.0) for i in range(12)]
    rows += [(100, 1, t0 + dt.timedelta(days=40), "completed", False, "txt", 100, 1, 1.0)]   # new month
    rows += [(200, 2, t0, "completed", False, "xyz", 100, 1, 1.0),
             (201, 2, t0 + dt.timedelta(minutes=1), "completed", False, "txt", 6 * 1024 * 1024, 1, 1.0)]
    users = spark.createDataFrame([(1, "FREE"), (2, "FREE")], "user_id long, tier string")
    a = {r.job_id: r for r in G.admission(_jobs(spark, rows), users).collect()}
    assert [a[i].admitted for i in range(12)] == [True] * 10 + [False, False]
    assert a[10].reason == "monthly_limit" and a[100].admitted
    assert a[200].reason == "file_type" and a[201].reason == "file_size"


def test_admission_two_level_count_equals_single_window(spark):
    """The bucketed running count equals a plain window over the whole
    (user, month) group, including one user holding most rows."""
    import random
    rnd = random.Random(5)
    t0 = dt.datetime(2024, 1, 1)
    rows = []
    for i in range(3000):
        u = 1 if rnd.random() < 0.6 else rnd.randint(2, 20)
        rows.append((i, u, t0 + dt.timedelta(seconds=rnd.randint(0, 40 * 86400)),
                     rnd.choice(["completed", "completed", "failed"]), rnd.random() < 0.2,
                     rnd.choice(["txt", "pdf", "png", "xlsx"]), rnd.randint(0, 8 * 1024 * 1024), 1, 1.0))
    users = spark.createDataFrame([(u, rnd.choice(["FREE", "PAID", "ENTERPRISE", "X"])) for u in range(1, 21)],
                                  "user_id long, tier string")
    a = G.admission(_jobs(spark, rows), users)
    w = Window.partitionBy("user_id", "month").orderBy("created_at", "job_id").rowsBetween(Window.unboundedPreceding, -1)
    ref = a.withColumn("ref", F.least(F.col("monthly_limit"), F.coalesce(F.sum("eligible").over(w), F.lit(0))))
    assert ref.where(F.col("ref") != F.col("count_before")).count() == 0


def test_a_value_cuts_its_text_once(spark):
    """Overlapping, absent and broken texts; the text is cut by one pattern, once."""
    from scrubline.operators.external import exact_positions
    rows = [(1, b"aXaXa", "aXa"), (2, b"none", "aXa"), (3, b"x\xff", "�"), (4, b"", "a"), (5, b"a", "a")]
    d = spark.createDataFrame(rows, "i long, b binary, v string").withColumn("t", F.col("b").cast("string"))
    x = d.select("i", exact_positions(F.col("t"), F.col("v")).alias("s"))
    assert {r.i: [s.start for s in r.s] for r in x.collect()} == {1: [0, 2], 2: [], 3: [1], 4: [], 5: [0]}
    d = spark.createDataFrame([(1, "t", "v")], "i long, t string, v string")
    plan = d.select(exact_positions(F.col("t"), F.col("v")).alias("s"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("(?=") == 1
