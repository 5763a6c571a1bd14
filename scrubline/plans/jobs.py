"""End-to-end jobs: scan once, write every output.

The scanned rows (text + spans with actions) are written once under the
shared checkpoint folder and read back, so the mirror, findings, report,
review queue and job log all reuse one detection pass, and a lost executor
never re-runs the regex work of finished partitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.findings import job_log, scan_summary
from ..operators.policy import Policy
from ..session import materialize
from ..sources import sinks
from .scan import ScanConfig, scrub


def run_scrub_job(docs: DataFrame, out_dir: str, salt: str, key_col: str = "rel_path",
                  policy: Policy | None = None, config: ScanConfig | None = None,
                  review_threshold: float = 0.8) -> DataFrame:
    """Scrub ``docs`` (``key_col``, ``text``) and write ``mirror/``,
    ``findings/``, ``report/``, ``review/`` and ``jobs/`` under ``out_dir``.
    Returns the one-row scan summary."""
    scanned = materialize(scrub(docs, salt=salt, policy=policy, config=config), "scrubbed")
    base = out_dir.rstrip("/")
    sinks.write_mirror(scanned, f"{base}/mirror", key_col=key_col)
    sinks.write_findings(scanned, f"{base}/findings", [key_col])
    sinks.write_report(scanned.withColumn("__title", F.col(key_col)), f"{base}/report", "__title")
    sinks.write_review_queue(scanned, f"{base}/review", [key_col], review_threshold)
    sinks.append_job_log(job_log(scanned, [key_col]), f"{base}/jobs")
    return scan_summary(scanned)
