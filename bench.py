"""Benchmark the headline queries.

Runs each query end to end (``noop`` sink: every row computed, nothing
collected) on ``local[$BENCH_CPUS]`` over ``$BENCH_SF_DIR`` and prints one JSON
line: {"metric", "value", "unit", "queries", "sf"}.
"""
from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from scrubline.plans.queries import QUERIES  # noqa: E402
from scrubline.session import build_session  # noqa: E402

HEADLINE = [
    "scrub_documents",       # detect + merge + policy + rewrite (flagship)
    "merge_spans",           # all rule packs + cue rules, overlap fold
    "findings_by_document",
    "type_counts",           # rollup with partial aggregation
    "preview_blocks",
    "redaction_boxes",
    "locate_findings",       # external findings located in their documents
    "prompt_policy",
    "admission_check",       # skew-safe running count
    "usage_daily",
    "dictionary_entities",
    "preview_wrapped",
    "unlocated_findings",
    "chunk_detect",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(f"local[{cpus}]", shuffle_partitions=int(cpus) * 2,
                          extra={"spark.driver.memory": "16g"})
    # warm-up on the smallest scale: JVM start, class loading, JIT, codegen
    warm = os.environ.get("BENCH_WARM_DIR", "/root/testdata/sf0.001")
    if os.path.isdir(warm):
        for name in HEADLINE:
            QUERIES[name](spark, warm).write.format("noop").mode("overwrite").save()
    times, build = {}, {}
    for name in HEADLINE:
        t0 = time.perf_counter()  # building the plan counts
        df = QUERIES[name](spark, sf_dir)
        build[name] = round(time.perf_counter() - t0, 3)
        df.write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "build": build, "sf": float(m.group(1)) if m else sf_dir}))
    spark.stop()


if __name__ == "__main__":
    main()
