"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR names the folder of tables, BENCH_CPUS the local threads. The raw trip files are made
from the driver's tables first (``setup_sec``, not counted). Then the stored tables are built from
them, timed as ``build_tables``, and each query runs to its last row.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from acceptance.dataset import dataset
from acceptance.queries import queries

HEADLINE = [
    "summary",
    "stop_markers",
    "daily_trips",
    "vehicle_days",
    "overnight_locations",
    "overnight_location_ranking",
    "depot_selection",
    "road_selection",
    "hourly_demand_profile",
    "weekly_demand_profile",
    "selection_vehicles",
    "merge_presence_windows",
    "power_location_profile",
    "power_heatmap",
    "scenario_profiles",
    "break_events",
    "break_demand_lines",
    "break_hourly_profile",
    "road_lines",
    "fleet_depots",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("dwellgrid-bench")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}

    def timed(name: str, work) -> None:
        start = time.perf_counter()
        work()
        times[name] = round(time.perf_counter() - start, 3)

    data = dataset(spark, folder)
    start = time.perf_counter()
    for source in ("raw", "geocode", "zones", "chargers", "edges", "fleet_vehicles", "fleet_depots"):
        getattr(data, source)
    setup = round(time.perf_counter() - start, 3)
    timed("build_tables", lambda: data.tables)
    registered = queries()
    for name in HEADLINE:
        timed(name, lambda name=name: registered[name](spark, folder).write.format("noop").mode("overwrite").save())
    print(
        json.dumps(
            {
                "metric": "total wall time of the table build and all headline queries",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "setup_sec": setup,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
