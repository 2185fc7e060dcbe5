"""Time the headline queries: prints one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_RUNS
(default 1; the median of the runs after one warm-up counts).
"""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

import workload

HEADLINE = [
    "flatten_line_paths",
    "key_frequency_lines",
    "path_profile_lines",
    "path_profile_events",
    "path_profile_orders",
    "match_properties_events",
    "distinct_subkeys_lines",
    "jxplain_profile_orders",
    "key_similarity_orders",
    "semantic_similarity_embeddings",
    "static_paths_closed",
    "static_paths_explicit",
    "label_paths_closed",
    "feature_table_lines",
    "validate_documents_lines",
    "abstracted_nodes_lines",
    "nested_schema_bytes_orders",
    "group_split_parts",
    "oversample_labels",
    "classification_report_labels",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    only = [n for n in os.environ.get("BENCH_ONLY", "").split(",") if n]
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    workload.load()
    seconds = {}
    for name in only or HEADLINE:
        times = []
        for attempt in range(runs + 1):
            start = time.perf_counter()
            workload.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            if attempt or runs == 0:
                times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times), 3)
    documents = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    profile = seconds.get("path_profile_lines")
    print(json.dumps({
        "metric": "total seconds of the headline queries",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
        "cores": cpus,
        "spark": spark.version,
        "documents_per_sec_profiled": round(documents / profile) if profile else None,
    }))


if __name__ == "__main__":
    main()
