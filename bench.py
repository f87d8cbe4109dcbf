"""Benchmark: run every analytics query (none of the training-data ones) at $BENCH_SF_DIR on local[$BENCH_CPUS]
and print ONE JSON line with per-query wall seconds.

Each query is fully executed with the `noop` sink (every row produced, nothing
collected to the driver), $BENCH_REPEAT times (default 5); ``queries`` holds
the median run, ``cold`` the first run (plan + JIT warm-up included), and
``value`` the sum of the medians. One untimed warm-up query absorbs JVM start-up.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from growthlens.plans.registry import QUERIES  # noqa: E402
from growthlens.session import local_session  # noqa: E402


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]
    spark = local_session(cpus, shuffle_partitions=int(os.environ.get("BENCH_PARTITIONS", "8")),
                          app_name="growthlens-bench")
    names = only or list(QUERIES)
    QUERIES["gmv_mom"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm-up
    repeat = max(1, int(os.environ.get("BENCH_REPEAT", "5")))
    times: dict[str, float] = {}
    cold: dict[str, float] = {}
    for name in names:
        runs = []
        for _ in range(repeat):
            t0 = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - t0)
        times[name] = round(statistics.median(runs), 3)
        cold[name] = round(runs[0], 3)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({
        "metric": "total_query_seconds",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "cold": cold,
        "cold_total": round(sum(cold.values()), 3),
        "repeat": repeat,
        "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
        "cpus": cpus,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
