"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from fleetgauge.catalog import load  # noqa: E402
from fleetgauge.session import local_session  # noqa: E402

HEADLINE = (
    "flagship_worst_window_precision_at_k", "v2_supply_days", "w1_census", "w4_dense_calendar", "w7_lagged_differences",
    "w13_enumerated_windows", "w16_tiling", "w18_random_windows", "w23_window_metadata", "w25_tile_features",
    "w25_strided_features", "w26_label_conflicts", "w29_live_windows", "e2_e3_roc_pr_auc", "e4_precision_at_k",
    "e5_precision_at_fraction", "e8_best_threshold", "e9_best_quantile_threshold", "e16_model_agreement",
    "e31_family_breakdown", "l5_l6_numeric_audit", "l7_categorical_audit", "l9_geometry_audit", "p2_attribute_coverage",
    "p8_correlations", "r3_rolling_stats", "r9_prior_reading", "x1_stratified_split", "x4_window_scaling", "s4_archive_build",
    "s15_convert_log_last", "t2_upsert_stream", "a1_score_fleet", "m1_boosted_trees",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    # Small inputs: let coalescing keep as many partitions as there are cores.
    spark = local_session(cpus, **{"spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k"})
    registry = load()
    names = sys.argv[1:] or HEADLINE
    registry["v1_events_days"].build(spark, sf_dir).write.format("noop").mode("overwrite").save()      # warm the JVM
    seconds = {}
    for name in names:
        start = time.perf_counter()
        registry[name].build(spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
