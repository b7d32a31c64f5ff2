"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from sweeploom.plans import bindings  # noqa: E402
from sweeploom.session import local_session  # noqa: E402

HEADLINE = [
    "geometry_keys",
    "axis_order_breaks",
    "block_summaries",
    "singular_values_any_port",
    "parameter_coverage",
    "duplicate_response_differences",
    "nearest_neighbours",
    "verification_metrics",
    "error_regions",
    "ranked_regions",
    "training_wins",
    "split_conflicts",
    "reranked_trials",
    "setting_conflicts",
    "solve_sessions",
    "log_summaries",
    "halton_design",
    "interpolated_values",
    "matched_occurrences",
    "rational_stage",
    "dense_predictions",
    "hybrid_batch",
    "frequency_grids",
    "audit_issues",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    spark.sparkContext.setLogLevel("ERROR")
    # One small run starts the JVM paths and the Python workers.
    bindings.QUERIES["verification_metrics"](spark, folder).count()
    timings = {}
    for name in HEADLINE:
        start = time.perf_counter()
        bindings.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": Path(folder).name.removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
