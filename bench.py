"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query is built and written to the no-op sink: one warm-up, then the median of three runs.
"""
import json
import os
import statistics
import sys
import tempfile
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
os.environ.setdefault("PYTHONPATH", os.path.dirname(os.path.abspath(__file__)))

from letterwatch.functions import frames  # noqa: E402
from letterwatch.plans import base  # noqa: E402
from letterwatch.plans.queries import QUERIES  # noqa: E402

HEADLINE = {
    "normalize_classify_scan": base.scanned,
    "score_tier_kpis": QUERIES["tier_kpis"],
    "bursts": QUERIES["burst_flag"],
    "first_contact": QUERIES["first_contact"],
    "new_domains_lookback": QUERIES["new_domains_lookback"],
    "sender_rules": QUERIES["sender_anomalies"],
    "department_volumes": QUERIES["dept_volumes"],
    "iforest_fit_score": QUERIES["iforest_detect"],
    "anomaly_components": QUERIES["anomaly_clusters"],
}


def main():
    cpus = os.environ.get("BENCH_CPUS", "8")
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("letterwatch-bench")
             .config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "12g")
             .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="bench-"))
             .config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name, build in HEADLINE.items():
        times = []
        for _ in range(runs + 1):
            began = time.perf_counter()
            build(spark, folder).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - began)
        seconds[name] = round(statistics.median(times[1:]), 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
                      "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))
    frames.clear_scratch(spark)
    spark.stop()


if __name__ == "__main__":
    main()
