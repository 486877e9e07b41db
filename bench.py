"""Times headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"

from tidyframe.operators import profile  # noqa: E402
from tidyframe.plans import queries as core  # noqa: E402

CORE = ("flagship", "apply_filters", "view", "page", "page_deep", "filter_is_duplicated", "drop_duplicates_first", "fill_missing_ffill", "group_by_agg_median", "column_stats", "quick_insights", "histogram", "diff_summary", "one_hot_encode", "read_csv", "row_position", "read_csv_quoted_lines", "changed_cells", "row_difference", "as_of_join", "overlap_join", "rolling_median_rows", "fill_missing_ffill_by_user", "incremental_profile", "interpolate", "grouping_sets_cube", "sessions")


def insights(spark: SparkSession, sf_dir: str):
    return profile.quick_insights(core.table(spark, sf_dir, "lineitem"))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    chosen = {n: core.QUERIES[n] for n in CORE} | {"quick_insights_lineitem": insights}
    try:
        import corpus_pipeline
        from tidyframe.llm import queries as llm

        chosen |= llm.QUERIES | {"pipeline": corpus_pipeline.run}
    except ImportError:
        pass
    times = {}
    for name, query in chosen.items():
        taken = []
        for _ in range(runs if not name.startswith(("op", "pipeline")) else 1):
            began = time.perf_counter()
            query(spark, sf_dir).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - began)
        times[name] = round(statistics.median(taken), 3)
    print(json.dumps({"metric": "total seconds of all queries (median run of each)", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
