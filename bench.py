"""Benchmark the headline queries; prints ONE JSON line.

env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
Each query is executed in full with the ``noop`` sink (no driver collect); one warm-up of
the session, then one timed run per query. Tables written to cut lineage are not reused
across queries here (each query pays for its own work).
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from cohortsmith import session as S  # noqa: E402
from cohortsmith.plans import registry  # noqa: E402

HEADLINE = [
    "exposure_reaction_rates",
    "exposure_reaction_rates_orders",
    "cohort_notes",
    "cohort_prevalence",
    "pii_scan_counts",
    "pii_positions",
    "content_policy_hits",
    "distribution_conditions",
    "uniqueness_text",
    "name_safety",
    "guardrail_documents",
    "guardrail_report",
    "eval_set",
]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = S.local_session(cores=cpus, shuffle_partitions=max(8, int(cpus) * 2), driver_memory="16g",
                            app="cohortsmith-bench")
    # warm-up: JVM, codegen caches
    registry.QUERIES["cohort_prevalence"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINE:
        t0 = time.perf_counter()
        registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "headline_queries_total",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(m.group(1)) if m else sf_dir,
        "cpus": int(cpus),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
