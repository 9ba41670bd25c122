"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the tables, BENCH_CPUS the cores. Each query is warmed up
once, then timed to full consumption; the median of the timed runs counts.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from effectgrid.plans.registry import QUERIES  # noqa: E402
from effectgrid.session import local_session  # noqa: E402

HEADLINE = [
    "label_counts", "gene_set_sizes", "sig_by_cell", "sig_by_cell_path", "sig_by_cell_sex",
    "sig_heatmap", "direction_ratio", "recurrence_top", "sex_exclusive_fisher", "sex_enrichment",
    "bh_global", "effect_matrix", "row_distance", "pseudobulk", "assoc_fdr", "top_pathways",
    "sex_contrast", "interaction_fdr", "drivers",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    spark = local_session("bench", cores)
    spark.sparkContext.setLogLevel("ERROR")

    def once(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    seconds = {}
    for name in HEADLINE:
        once(name)
        seconds[name] = round(statistics.median(once(name) for _ in range(runs)), 3)
    print(
        json.dumps(
            {
                "metric": "total seconds of the headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(os.path.normpath(folder)).removeprefix("sf"),
                "cpus": cores,
                "runs": runs,
            }
        )
    )


if __name__ == "__main__":
    main()
