"""Time the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; one JSON line on standard output."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from tesserae import plans

HEADLINE = (
    "assay_percent_inhibition", "assay_robust_z", "assay_b_score", "assay_plate_quality", "assay_replicates", "assay_hits", "curate_counts", "curate_keep_first", "curate_pattern_flags", "curate_impute",
    "split_random", "split_stratified", "split_by_group", "split_group_folds", "metrics_regression", "metrics_multitask", "metrics_roc_auc", "metrics_bedroc", "calibration_errors", "acquisition_scores",
    "portfolio_pareto", "matched_pairs", "matched_pair_statistics", "catalogue_suppliers", "catalogue_upsert", "catalogue_cascade", "route_scores", "prospective_drift", "nearest_neighbours", "domain_box",
    "domain_lof", "cluster_rows", "similar_pairs", "metrics_kendall_prices", "portfolio_pareto_ranks", "calibration_isotonic", "route_prices", "message_sums",
)


def _slowness() -> float:
    """Milliseconds of a fixed loop on this machine just now, so that rounds can be compared."""
    took = []
    for _ in range(51):
        began = time.thread_time()
        sum(range(50_000))
        took.append((time.thread_time() - began) * 1000)
    return round(sorted(took)[25], 3)


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, seconds = plans.queries(), {}
    slowness = _slowness()
    queries["curate_counts"](spark, sf_dir).collect()  # start-up isn't the queries'
    for name in HEADLINE:
        began = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - began, 3)
    spark.stop()
    print(json.dumps({"metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "slowness": slowness, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
