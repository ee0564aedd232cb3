"""Times the job on the test tables and prints one JSON line.

First the star schema is built from the sources and written, as the job does (`stage_warehouse`). The queries
then read the stored tables, and each is run to its last row. `*_from_sources` plan everything from the sources.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tallymart.plans import job, registry  # noqa: E402
from tallymart.session import build_session  # noqa: E402

FROM_SOURCES = ("state_performance", "payment_rollup", "latest_review")
STORED = (
    "kpis", "state_performance", "monthly_state_revenue", "category_performance", "weekly_orders", "dim_customer",
    "customer_features", "rfm_scores", "segment_summary", "weekly_demand", "supervised_features", "leaderboard",
    "fc_holt_damped", "fc_arima_111", "forecast_intervals", "main_category", "churn_labels", "churn_metrics_eval",
    "clv", "affinity_order", "affinity_customer", "cluster_profile", "fc_gbt_global", "churn_train",
    "kmeans_clusters",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        master=f"local[{cpus}]", spark_sql_shuffle_partitions=cpus, spark_driver_memory="12g",
        spark_ui_showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, seconds = registry.all_queries(), {}

    def timed(name, action):
        start = time.perf_counter()
        action()
        seconds[name] = round(time.perf_counter() - start, 3)

    def run(name):
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()

    run("state_performance")  # starts the JVM's compilers; not timed
    for name in FROM_SOURCES:
        timed(f"{name}_from_sources", lambda name=name: run(name))
    folder = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    timed("stage_warehouse", lambda: job.write_warehouse(registry.star(spark, sf_dir), folder))
    registry.serve_from(sf_dir, job.StoredWarehouse(spark, folder))
    for name in STORED:
        timed(name, lambda name=name: run(name))
    print(json.dumps({
        "metric": "star schema and headline queries, total wall time", "value": round(sum(seconds.values()), 3),
        "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
