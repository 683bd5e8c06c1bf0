"""Time the headline queries: prints one JSON line.

``BENCH_SF_DIR`` names the folder of the tables, ``BENCH_CPUS`` the number of local
cores, ``BENCH_RUNS`` the number of timed runs after one warm-up (the median counts).
Feature tables are written before timing, as they are in use; building them is timed by
the ``f1_`` and ``f2_`` queries.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from cartloom.session import build_session  # noqa: E402
from cartloom.sources import roles  # noqa: E402
from verification.queries import QUERIES  # noqa: E402

HEADLINES = (
    "f1_sku_velocity",
    "f2_basket_affinity",
    "f2_basket_affinity_names",
    "r2_co_purchase_parts",
    "p4_search_by_name",
    "d1_documents",
    "v1_vector_search",
    "v1_vector_search_blocks",
    "b5_disjoint",
    "b8_promote",
    "r5_recommend",
    "t1_chunk_lines",
    "t3_chunk_blocks",
    "t4_grep",
    "t7_trace",
    "t8_refresh",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus if cpus.isdigit() else "8",
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "12g"),
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    for grain in ("name", "part"):
        house = roles.warehouse(spark, folder, grain)
        _ = house.velocity, house.neighbours  # written before the first run; the neighbours need the pairs

    seconds = {}
    for key in HEADLINES:
        times = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            QUERIES[key](spark, folder).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        seconds[key] = round(statistics.median(times[1:] or times), 3)
    print(
        json.dumps(
            {
                "metric": "total_seconds_headline_queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
