"""Headline-query bench: prints ONE JSON line.

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
Every query is executed completely with the ``noop`` sink (the full plan runs,
nothing is collected to the driver); the time includes planning and any small
driver-side scalar jobs the operator needs.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "m24_inventory_by_part",
    "w1_w2_time_series_features",
    "a2_w3_customer_features",
    "a7_executive_kpis",
    "a8_a10_grouping_sets",
    "v2_v4_validation_report",
    "m1_w7_seasonal_naive_forecast",
    "m5_naive_mape",
    "m22_recommend_price",
    "m25_m27_observed_drift",
    "j7_asof_customer_spend",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    from stockroom.session import local_session

    spark = local_session(cpus, shuffle_partitions=int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", cpus)), app="stockroom-bench")
    spark.sparkContext.setLogLevel("ERROR")
    from stockroom.plans.catalog import QUERIES
    from stockroom.sources.tables import table

    names = [n for n in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if n]
    # warm-up: JVM, parquet footers, Python workers
    QUERIES["a9_revenue_by_region"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    all_times: dict[str, list[float]] = {n: [] for n in names}
    for _ in range(runs):  # best of ``runs`` per query (steady state); first run reported too
        for name in names:
            t0 = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            all_times[name].append(round(time.perf_counter() - t0, 3))
    times = {n: min(v) for n, v in all_times.items()}
    first_total = round(sum(v[0] for v in all_times.values()), 3)
    rows = table(spark, sf_dir, "lineitem").count()
    total = round(sum(times.values()), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": total,
                "unit": "sec",
                "queries": times,
                "sf": sf,
                "cpus": cpus,
                "lineitem_rows": rows,
                "rows_per_sec_per_query": round(rows * len(times) / total, 1) if total else None,
                "stat": f"min of {runs} runs per query",
                "first_run_total": first_total,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
