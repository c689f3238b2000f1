"""Time the headline queries and print one JSON line.

Each query writes its full result to the noop sink, so every row and column is computed and none is
collected. The first run is reported apart, as it pays for planning, code generation and file footers; the
value of a query is the median of the runs after it.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from paceline.plans import catalog, free
from paceline.plans.runner import drain
from paceline.session import build_session

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "5"))

HEADLINE = [
    "s01_gen_users",
    "s02_gen_orders",
    "s05_csv_quoted",
    "s05_csv_typed",
    "s11_scale_to_threshold",
    "i01_pk_violations",
    "i02_null_violations",
    "i03_fk_orphans",
    "i04_cascade_child",
    "i05_decimal_fit",
    "q01_read",
    "q02_join",
    "q02_join_all",
    "q03_aggregate",
    "q04_count",
    "q05_filter",
    "t01_table_stats",
    "t05_active_parts_size",
    "t06_segment_sizes",
    "t07_block_sizes",
    "m01_mean_runs",
    "m05_import_metrics_by_user",
    "m07_standard_leaders",
    "m08_custom_leaders",
    "m10_pivot_loads",
    "m12_load_grid",
    "m13_stats_grid",
    "m18_comparison",
    "w01_last_load",
    "w02_runs_during_loads",
    "w04_row_differences",
    "w06_quantiles_by_query",
    "w07_import_cube",
    "w08_change_of_runs",
]


def seconds(work) -> float:
    start = time.perf_counter()
    work()
    return time.perf_counter() - start


def main() -> None:
    spark = build_session(
        "bench",
        f"local[{CPUS}]",
        **{"spark.sql.shuffle.partitions": CPUS, "spark.ui.enabled": "false", "spark.driver.memory": "8g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    first, median = {}, {}
    for name in HEADLINE:
        run = (catalog.QUERIES | free.QUERIES)[name]
        times = [seconds(lambda run=run: drain(run(spark, SF_DIR))) for _ in range(RUNS + 1)]
        first[name] = round(times[0], 4)
        median[name] = round(statistics.median(times[1:]), 4)
    print(
        json.dumps(
            {
                "metric": "sum of median query times",
                "value": round(sum(median.values()), 4),
                "unit": "sec",
                "queries": median,
                "first_run": first,
                "runs": RUNS,
                "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
