"""Time the headline queries: one warm run, then one timed run each; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from cohortlab.queries import QUERIES  # noqa: E402
from cohortlab.session import get_session  # noqa: E402

HEADLINE = [
    "cohort_flagship", "cohort_merge_outer", "proxy_filled", "composite_score", "region_agg", "recent_pair", "statistics_table",
    "welfare_wide", "counts_asylum", "measure_group_mean", "dedupe", "fill_median", "clip_outliers", "standard_scale", "box_stats",
    "label_corr", "corr_matrix_wide", "histogram", "kde", "split_stratified", "kfold_stratified", "roc_points", "model_table",
    "threshold_sweep", "gd_regression", "cv_metrics", "lr_scores", "ae_scores", "titled_csv", "merge_bucketed", "dedupe_wide", "merged_sketches",
    "gbt_two_rounds", "oof_scores",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_session("bench", master=f"local[{cpus}]", shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    taken = {}
    for name in HEADLINE:
        for _ in range(2):
            start = time.perf_counter()
            QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            taken[name] = round(time.perf_counter() - start, 3)
    total = round(sum(taken.values()), 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": total, "unit": "sec", "queries": taken, "sf": os.path.basename(sf),
        "cpus": cpus, "spark": spark.version, "shuffle_partitions": spark.conf.get("spark.sql.shuffle.partitions"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
