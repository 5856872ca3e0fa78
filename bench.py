"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

HEADLINES = [
    "facts",                    # cleaning and the rainfall join
    "top_crops_by_production",  # grouped means
    "describe_facts",           # moments and exact quartiles
    "corr_matrix",
    "crop_year_yield",
    "build_documents",          # sentences and ids
    "similarity_topk",          # exact nearest vectors
    "similarity_topk_batch",
    "pruned_topk",              # the same through the pruned index, built for the query
    "retrieve",                 # questions embedded by the batch model and searched
    "filter_by_question",       # retrieval and question filter
    "answer_hits",              # every question answered
    "answer_batch",             # retrieved and answered
]
RUNS = 3  # the first run, which also compiles the query's code, counts; the median is given beside it
MANY_VECTORS = 200_000


def many_vectors(spark, sf_dir: str):
    """Ten label questions against the test vectors repeated, each time turned by a step, up to MANY_VECTORS."""
    from pyspark.sql import functions as F

    from agroclime.operators.vectors import similarity_topk

    base = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    times = -(-MANY_VECTORS // base.count())
    turned = base.withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(times - 1)))).select(
        (F.col("vec_id") * times + F.col("turn")).alias("vec_id"),
        F.concat(F.slice("embedding", F.col("turn") % 64 + 1, 64), F.slice("embedding", 1, F.col("turn") % 64)).alias("embedding"))
    asked = base.filter("vec_id < 10").select(F.col("vec_id").alias("question_id"), "embedding")
    return similarity_topk(asked, turned, 5, id_col="vec_id")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from agroclime.plans.catalog import QUERIES

    QUERIES["map_subdivision"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # JVM warm-up
    seconds, medians = {}, {}

    def measured(name: str, query) -> None:
        took = []
        for _ in range(RUNS):
            start = time.perf_counter()
            query().write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - start)
        seconds[name], medians[name] = round(took[0], 3), round(statistics.median(took), 3)

    for name in HEADLINES:
        measured(name, lambda name=name: QUERIES[name](spark, sf_dir))
    measured("topk_of_200000_vectors", lambda: many_vectors(spark, sf_dir))
    spark.stop()
    print(json.dumps({
        "metric": "total wall-clock of headline queries",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "median_of_three": medians,
        "sf": float(os.path.basename(sf_dir.rstrip("/")).removeprefix("sf") or 0),
    }))


if __name__ == "__main__":
    main()
