"""Benchmark: run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints one JSON line: {"metric", "value" (total seconds), "unit", "queries" {name: sec}, "sf"}.
Each query is executed in full with the no-op sink (no collect to the driver).
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from longctx.plans.catalog import QUERIES  # noqa: E402
from longctx.session import local_session  # noqa: E402

HEADLINE = [
    "context_digest", "context_provenance", "matrix_cells", "matrix_groups", "prompt_payloads",
    "metric_token_f1", "metric_bleu", "metric_rouge_l", "conciseness_gate", "verdict_parse", "jury_verdict",
    "score_rows", "log_keep_last", "resume_pending", "responses_export", "pass_rate_by_difficulty",
    "error_classes", "synthetic_profiles", "generation_work",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cpus, shuffle_partitions=max(cpus, 8), app="longctx-bench")
    spark.range(1000).selectExpr("sum(id)").collect()  # JVM warm-up, not timed
    times = {}
    for name in HEADLINE:
        t0 = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(m.group(1)) if m else sf_dir}))
    spark.stop()


if __name__ == "__main__":
    main()
