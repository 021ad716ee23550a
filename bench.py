"""Benchmark: headline queries at $BENCH_SF_DIR (default /root/testdata/sf0.1) on local[$BENCH_CPUS].

Each query runs once to warm up (JIT, codegen) and then $BENCH_REPS times (default 3); the median wall time of writing
the whole result to the ``noop`` sink is recorded, so that no column of it can be pruned away. Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "range_query", "range_query_many", "overlay_pairs_grid", "overlay_classes", "overlay_classes_compat",
    "prefix_join", "geohash_points", "grid_count", "cover", "common_prefix_cells", "wkt_ingest", "check_rings",
    "prefix_scan", "wkb_transcode", "range_query_stored", "overlay_stored", "range_scan_windows", "nested_cells",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    reps = int(os.environ.get("BENCH_REPS", "3"))
    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]
    from geotables.plans.catalog import QUERIES
    from geotables.session import get_spark
    spark = get_spark(cpus=cpus, shuffle_partitions=int(cpus) * 2)
    times: dict[str, float] = {}
    rows: dict[str, int] = {}
    for name in only or HEADLINE:
        fn = QUERIES[name]
        rows[name] = fn(spark, sf_dir).count()
        ts = []
        for _ in range(reps):
            t0 = time.perf_counter()
            fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
            ts.append(time.perf_counter() - t0)
        times[name] = round(statistics.median(ts), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "total_median_query_time", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "rows": rows, "sf": sf, "cpus": cpus}))
    spark.stop()


if __name__ == "__main__":
    main()
