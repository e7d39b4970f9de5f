"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from tidewire import catalog
from tidewire.session import local_session

HEADLINE = [
    "j05_nearest_join", "j05_run_alignment", "j01_inner_chain", "a04_pctl_cont", "a01_basic", "a10_describe_study", "a26_tolerance_sweep", "w04_duplicate_lines", "w10_outliers_sql",
    "w12_counter_delta", "k02_worst_streams", "t01_instant", "t02_range_eval", "t03_rate", "t05_avg_over_time", "v05_projects", "v12_device_summary", "v32_pending_manual_entry", "r05_jitter",
    "m01_upsert", "x06_stream_avg"]


def main() -> None:
    path = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 4))
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    queries = catalog.queries()
    queries["a01_basic"](spark, path).write.format("noop").mode("overwrite").save()  # start-up is not measured
    seconds = {}
    for name in HEADLINE:
        start = time.time()
        queries[name](spark, path).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": seconds, "sf": os.path.basename(path.rstrip("/")), "cpus": cpus}))
    spark.stop()


if __name__ == "__main__":
    main()
