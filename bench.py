"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line. Each query: one warm run, then the median of three."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path
from statistics import median

ROOT = Path(__file__).resolve().parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = os.pathsep.join([str(ROOT), os.environ.get("PYTHONPATH", "")])
HEADLINES = (
    "groupby_basic gb_sum gb_missing gb_agg gb_quantile gb_transform gb_nth merge_inner merge_left merge_outer merge_keep_first lookup_require asof_backward asof_nearest asof_tolerance "
    "rolling_sum rolling_mean cumsum shift fill_forward time_window_sum ema_decay prefix_sum accum2_sum accum2_median accum_percent_T pivot melt cut qcut drop_duplicates_first sort_topk describe resample strings date_parts"
).split()


def main() -> None:
    from pyspark.sql import SparkSession

    from larkspan.plans import catalogue

    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "12g").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    took = {}
    for name in HEADLINES:
        times = []
        for _ in range(4):
            t = time.perf_counter()
            catalogue.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - t)
        took[name] = round(median(times[1:]), 3)
    print(json.dumps({"metric": "total_headline_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf}))


if __name__ == "__main__":
    main()
