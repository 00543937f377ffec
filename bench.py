"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Deriving the raw tables from the test tables is set-up and reported apart.
Layer queries run from the raw tables. Report queries read the written student
table, whose build is timed as ``build_student_table``. Every query is run once
to warm up and then $BENCH_RUNS times (default 3); the median is reported. A
``noop`` write forces all columns of all rows.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

from termtrail.plans import catalog
from termtrail.sources.tables import TABLE_NAMES

HEADLINE = (
    "demographics", "degree_info", "first_terms", "first_level_adjusted", "level_completion",
    "per_term_info", "sequences_relative", "sequences_absolute", "cohort_info", "flat_file",
    "degree_expanded", "demographic_base", "table1_demographics", "table3_program",
    "rq2_first_level", "sequence_features", "pathway_totals", "pathway_by_margin",
    "terms_within_pathway", "advancement_by_level", "crosstab_top12", "crosstab_margins",
    "level_heatmap", "retention", "summary_card")


def timed(action) -> float:
    start = time.perf_counter()
    action()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("bench")
             .config("spark.sql.shuffle.partitions", cpus)
             .config("spark.sql.adaptive.enabled", "true").config("spark.driver.memory", "16g")
             .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    force = lambda df: df.write.format("noop").mode("overwrite").save()
    journey = catalog.journey(spark, sf_dir)
    seconds: dict[str, float] = {}
    setup = timed(lambda: [getattr(journey.raw, n) for n in TABLE_NAMES])
    registered = catalog.queries()
    layer_names = [n for n in HEADLINE if n in catalog.LAYER_QUERIES]
    for name in layer_names + [n for n in HEADLINE if n not in layer_names]:
        if name not in catalog.LAYER_QUERIES and "build_student_table" not in seconds:
            seconds["build_student_table"] = timed(lambda: journey.stored)
        run = lambda: force(registered[name](spark, sf_dir))
        run()
        seconds[name] = statistics.median(timed(run) for _ in range(runs))
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": {n: round(s, 3) for n, s in seconds.items()},
        "setup_seconds": round(setup, 3),
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
