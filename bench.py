"""Headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from furrow.plans.catalog import QUERIES
from furrow.session import build_session

HEADLINES = [
    "summary_by_crop", "cost_profit_margin", "crop_baselines", "crop_medians", "category_shares", "group_extremes", "latest_per_key",
    "iqr_outliers", "correlations", "relative_price", "minmax_scores", "demand_score", "supply_score", "yield_price_factors",
    "price_fallback_join", "etl_output", "season_output", "dq_ranges", "dq_overview", "dq_warnings", "allocate_bounded",
    "allocate_smooth", "request_validation", "request_enrichment", "split_crops", "classification_metrics", "train_yield",
    "score_yield", "stream_latest",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "furrow-bench", f"local[{cpus}]", spark__driver__memory="16g", spark__sql__shuffle__partitions=cpus,
        spark__python__sql__dataFrameDebugging__enabled="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/region.parquet").count()
    times = {}
    for name in HEADLINES:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir)}))


if __name__ == "__main__":
    main()
