"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) holds the tables and BENCH_CPUS
(default 8) sets the number of local cores.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "recode_map",
    "band",
    "clean_survey",
    "area_covariates",
    "two_party_share",
    "area_mean",
    "area_interval",
    "line_area_mean",
    "psframe",
    "psframe_full",
    "cell_share",
    "marginals_long",
    "synthetic_estimate",
    "sample_uniform",
    "sample_weighted",
    "poststratify_fixed_coefs",
    "glm_logit_1x",
    "coef_table",
    "ols_2x",
    "group_ols",
    "mrp_complete_pooling",
    "mrp_fixed_effects_self",
    "mrp_partial_pooling",
    "mrsp_multilevel",
    "mrp_lasso",
    "mrp_forest",
    "mrp_stack",
    "caterpillar",
)


def main() -> None:
    from areacast.plans.queries import QUERIES

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("areacast-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    chosen = sys.argv[1:] or HEADLINE
    # One unmeasured query starts the JVM's compilers and the Python workers.
    QUERIES["multilevel_given_variance"](spark, folder).collect()
    times = {}
    for name in chosen:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    scale = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(
        json.dumps(
            {
                "metric": "survey_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": float(scale) if scale.replace(".", "", 1).isdigit() else scale,
            }
        )
    )


if __name__ == "__main__":
    main()
