"""Usage accounting over a job log.

Jobs: ``job_id, user_id, created_at, status, preview_only, file_type,
file_size_bytes, entities_detected, processing_time_seconds``.
Users: ``user_id, tier`` and optionally ``monthly_limit`` (a user's own limit).

Rows that cannot be judged are not admitted: an unknown or NULL user has the
FREE limits, a NULL size is rejected as ``file_size`` and a NULL type as
``file_type``; a NULL status is not completed, a NULL preview flag is no preview.

Admission (G7) depends on how many *earlier chargeable* requests the user made
that month.  A request is charged only if it was admitted, succeeded and was
not a preview; once the count reaches the user's limit every later request
that month is rejected, so

    count_before(i) = least(limit, #eligible requests before i)

where *eligible* = size and type allowed, completed, not a preview.  That is
a running count, computed in two levels so one hot user cannot pile a third
of the log into one window task: per-minute bucket counts (partial
aggregation), bucket offsets by a window over the small bucket table, then a
running count inside each (user, month, minute) bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Tier limits (documents per month, MB per file, formats,
# features) and the fallback tier for unknown names.
TIER_LIMITS = [
    ("FREE", 10, 5, ["txt", "pdf"], ["basic_redaction"]),
    ("PAID", 500, 50, ["txt", "pdf", "docx", "png", "jpg"],
     ["basic_redaction", "custom_prompts", "batch_processing"]),
    ("ENTERPRISE", 10000, 100, ["txt", "pdf", "docx", "png", "jpg", "xlsx"],
     ["basic_redaction", "custom_prompts", "batch_processing", "api_access", "audit_logs", "team_management"]),
]
FALLBACK_TIER = "FREE"
DEFAULT_MONTHLY_LIMIT = 10
MB = 1024 * 1024


def tier_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TIER_LIMITS, "tier_name string, monthly_documents int, max_file_size_mb int, "
                                              "supported_formats array<string>, features array<string>")


def with_tier_limits(users: DataFrame) -> DataFrame:
    """Attach the tier's limits; unknown tiers get the FREE limits.  The
    tier table has three rows, so it is broadcast."""
    known = [t[0] for t in TIER_LIMITS]
    eff = F.when(F.upper(F.col("tier")).isin(*known), F.upper(F.col("tier"))).otherwise(F.lit(FALLBACK_TIER))
    u = users.withColumn("effective_tier", eff)
    t = F.broadcast(tier_table(users.sparkSession))
    out = u.join(t, u["effective_tier"] == t["tier_name"], "left").drop("tier_name")
    own = [F.col("monthly_limit")] if "monthly_limit" in users.columns else []
    return out.withColumn("monthly_limit", F.coalesce(*own, F.col("monthly_documents"), F.lit(DEFAULT_MONTHLY_LIMIT)))


def judged(jobs: DataFrame, users: DataFrame) -> DataFrame:
    """Jobs with their user's limits, ``month``, whether size and type are
    allowed, and ``eligible`` (1 where an admitted request is charged)."""
    own = [c for c in ("user_id", "tier", "monthly_limit") if c in users.columns]
    false = F.lit(False)
    return (with_tier_limits(jobs.join(users.select(*own), "user_id", "left"))
         .withColumn("month", F.date_format("created_at", "yyyy-MM"))
         .withColumn("size_ok", F.coalesce(F.col("file_size_bytes") <= F.col("max_file_size_mb") * F.lit(MB), false))
         .withColumn("type_ok", F.coalesce(F.array_contains(F.col("supported_formats"), F.lower("file_type")), false))
         .withColumn("eligible", (F.col("size_ok") & F.col("type_ok") & F.coalesce(F.col("status") == "completed", false)
                                  & ~F.coalesce(F.col("preview_only"), false)).cast("int")))


def admission(jobs: DataFrame, users: DataFrame, bucket: str = "minute") -> DataFrame:
    """G7 + G8: per job ``admitted``, ``reason`` and ``charged``."""
    j = judged(jobs, users).withColumn("bucket", F.date_trunc(bucket, F.col("created_at")))
    per_bucket = j.groupBy("user_id", "month", "bucket").agg(F.sum("eligible").alias("n"))
    w_off = Window.partitionBy("user_id", "month").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_bucket.select(*[F.col(c).alias(f"__{c}") for c in ("user_id", "month", "bucket")],
                                F.coalesce(F.sum("n").over(w_off), F.lit(0)).alias("offset"))
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in ("user_id", "month", "bucket")]
    w_in = (Window.partitionBy("user_id", "month", "bucket").orderBy("created_at", "job_id")
            .rowsBetween(Window.unboundedPreceding, -1))
    j = (j.join(offsets, same)
          .withColumn("before", F.col("offset") + F.coalesce(F.sum("eligible").over(w_in), F.lit(0))))
    count_before = F.least(F.col("monthly_limit"), F.col("before"))
    reason = (F.when(count_before >= F.col("monthly_limit"), F.lit("monthly_limit"))
              .when(~F.col("size_ok"), F.lit("file_size"))
              .when(~F.col("type_ok"), F.lit("file_type"))
              .otherwise(F.lit("ok")))
    return (j.withColumn("count_before", count_before.cast("long"))
             .withColumn("reason", reason)
             .withColumn("admitted", F.col("reason") == "ok")
             .withColumn("charged", F.col("admitted") & (F.col("eligible") == 1))
             .drop("offset", "before", "bucket", *offsets.columns))


def usage_daily(admitted: DataFrame) -> DataFrame:
    """Per (user, day) over admitted, completed requests."""
    x = admitted.where(F.col("admitted") & (F.col("status") == "completed"))
    return x.groupBy("user_id", F.date_format("created_at", "yyyy-MM-dd").alias("date")).agg(
        F.count(F.lit(1)).alias("documents_processed"),
        F.sum("file_size_bytes").cast("long").alias("total_file_size_bytes"),
        F.sum("entities_detected").cast("long").alias("total_entities_detected"),
        F.sum("entities_detected").cast("long").alias("total_entities_redacted"),
        F.round(F.sum("processing_time_seconds"), 6).alias("total_processing_time_seconds"))


def usage_monthly(admitted: DataFrame) -> DataFrame:
    """Charged documents per (user, month); a new month starts at zero."""
    return admitted.groupBy("user_id", "month").agg(
        F.sum(F.col("charged").cast("long")).alias("documents_charged"),
        F.count(F.lit(1)).alias("requests"),
        F.sum((~F.col("admitted")).cast("long")).alias("rejected"))


def usage_profile(admitted: DataFrame, users: DataFrame) -> DataFrame:
    """Used, limit and whether usage remains, per (user, month); a user
    without requests has one row, with a NULL month and nothing used."""
    used = admitted.groupBy("user_id", "month").agg(F.sum(F.col("charged").cast("long")).alias("used"))
    return (with_tier_limits(users).select("user_id", "tier", F.col("monthly_limit").cast("long").alias("monthly_limit"))
            .join(used, "user_id", "left").withColumn("used", F.coalesce("used", F.lit(0)).cast("long"))
            .withColumn("has_usage_remaining", F.col("used") < F.col("monthly_limit")))
