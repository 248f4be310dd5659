"""Time the queries on one machine and print one JSON line.

Every query runs to the end of its plan over its whole tables (the ``noop`` sink takes
all rows), including its planning. The better of two runs counts, since the first one of
a fresh JVM mostly measures class loading and code generation.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pyspark.sql import SparkSession

from jobquarry.queries import QUERIES

HEADLINE = [
    "extract_posting", "process_pages", "extract_links", "dedup_url", "resume_merge", "page_counts",
    "process_urls", "processing_stats", "download_plan", "empty_page_runs", "list_items",
    "extract_skills", "classify_experience", "education_requirements", "salary_range_text",
    "infer_field_types", "check_mapping", "knn_search", "topk_hits", "embed_text",
    "semantic_search", "document_pages_text", "latest_snapshot", "stream_dedup",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    if names == ["all"]:
        names = list(QUERIES)
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="jobquarry-bench-"))
        # The sample tables are one row group each, which would be one task.
        .config("jobquarry.read.pieces", cpus)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    run = lambda name: QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        times = []
        for _ in range(2):
            start = time.perf_counter()
            run(name)
            times.append(time.perf_counter() - start)
        seconds[name] = round(min(times), 3)
    print(
        json.dumps(
            {
                "metric": "total query time",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
