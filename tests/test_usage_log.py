"""The usage log by batches, and admission on a stream."""
import collections
import datetime as dt
import random

from pyspark.sql import functions as F

from scrubline.operators import usage as G
from scrubline.plans.usage_log import UsageLog
from scrubline.streaming.stream import admission_stream, usage_log_stream

JOB = ("job_id long, user_id long, created_at timestamp, status string, preview_only boolean, file_type string, file_size_bytes long, "
       "entities_detected long, processing_time_seconds double")
USERS = [(u, ["FREE", "PAID", "ENTERPRISE", "TRIAL"][u % 4], 3 if u % 3 == 0 else None) for u in range(6)]


def make_jobs(n=240, seed=3):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        at = dt.datetime(2024, 1, 28) + dt.timedelta(seconds=rng.randrange(6 * 86400), microseconds=rng.randrange(10 ** 6))
        out.append((i, rng.choice([0, 0, 0, 1, 2, 3, 9, None]), at, rng.choice(["completed", "completed", "completed", "failed", None]),
                    rng.choice([False, False, True, None]), rng.choice(["txt", "txt", "pdf", "xyz", None]),
                    rng.choice([10, 10, 1 << 20, 6 << 20, None]), rng.randrange(9), rng.random()))
    return out


def users(spark):
    return spark.createDataFrame(USERS, "user_id long, tier string, monthly_limit int")


def as_rows(df):
    return collections.Counter(tuple(r) for r in df.select(*sorted(df.columns)).collect())


def test_usage_log_equals_the_rollup(spark, tmp_path):
    a = G.admission(spark.createDataFrame(make_jobs(), JOB), users(spark)).cache()
    log = UsageLog(spark, f"file://{tmp_path}/log")
    assert log.daily().count() == 0
    part = lambda k: a.where(F.col("job_id") % 4 == k)
    log.apply("w", part(3).where("created_at < '2024-01-31'"))
    for batch, rows in (("x", part(0)), ("y", part(1)), ("x", part(0)), ("z", part(0)), ("w", part(3))):
        log.apply(batch, rows)
    assert as_rows(log.daily()) != as_rows(G.usage_daily(a))
    log.apply("z", part(2))  # the same delivery with other rows
    assert as_rows(log.daily()) == as_rows(G.usage_daily(a))
    # a batch that comes again with nothing, and days that lose all their rows
    log.apply("y", part(1).limit(0))
    assert as_rows(log.daily()) == as_rows(G.usage_daily(a.where("job_id % 4 <> 1")))
    for batch in "wxz":
        log.apply(batch, a.limit(0))
    assert log.daily().count() == 0 and log.monthly().count() == 0


def test_admission_stream_equals_batch(spark, tmp_path):
    """Rows out of order, within the watermark, are decided as in one batch; the log follows."""
    jobs = sorted(make_jobs(), key=lambda r: r[2])
    rng = random.Random(8)
    for i in range(0, len(jobs) - 30, 30):  # up to a day late
        chunk = jobs[i:i + 45]
        rng.shuffle(chunk)
        jobs[i:i + 45] = chunk
    src = tmp_path / "in"
    src.mkdir()
    log = UsageLog(spark, f"file://{tmp_path}/log")
    stream = spark.readStream.schema(JOB).option("maxFilesPerTrigger", 1).parquet(f"file://{src}")
    decided = admission_stream(stream, users(spark), "3 days")
    # a request long after all others moves the watermark past them
    files = [jobs[:90], jobs[90:170], jobs[170:], [(9999, 77, dt.datetime(2025, 1, 1), "completed", False, "txt", 1, 0, 0.0)]]

    def put(rows, n):
        spark.createDataFrame(rows, JOB).coalesce(1).write.mode("append").parquet(f"file://{src}")
    for n, rows in enumerate(files):
        put(rows, n)
    kept = []
    q = decided.writeStream.foreachBatch(lambda df, n: kept.extend(df.collect())).option("checkpointLocation", f"{tmp_path}/c1").start()
    q.processAllAvailable()
    q.stop()
    want = G.admission(spark.createDataFrame(jobs, JOB), users(spark))
    cols = ["job_id", "user_id", "month", "count_before", "reason", "admitted", "charged"]
    got = collections.Counter(tuple(r[c] for c in cols) for r in kept)
    assert got == collections.Counter(tuple(r) for r in want.select(*cols).collect())
    q = usage_log_stream(decided, log, f"{tmp_path}/c2").start()
    q.processAllAvailable()
    q.stop()
    assert as_rows(log.daily()) == as_rows(G.usage_daily(want))
