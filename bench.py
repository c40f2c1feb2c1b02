"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from tablescout.plans import registry

HEADLINE = [
    "src_csv", "src_candidate_cells", "src_ckan", "prof_numeric", "prof_semantic_type",
    "prof_outliers", "prof_duplicates", "prof_concepts", "qgen_order_ids", "disc_catalog_search",
    "disc_overall", "rank_order", "eval_average_precision", "eval_ndcg_at_k", "int_match_columns",
    "int_overlap_values", "int_entity_resolve", "int_left_join", "int_conflicts", "int_status",
    "pipe_end_to_end", "pipe_feedback_loop",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    registry.QUERIES["qgen_sufficiency"](spark, sf_dir).count()  # start the JVM's caches
    times = {}
    for key in HEADLINE:
        start = time.perf_counter()
        registry.QUERIES[key](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[key] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(os.path.normpath(sf_dir))}))


if __name__ == "__main__":
    main()
