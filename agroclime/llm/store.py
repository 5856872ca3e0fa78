"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path under ``spark.checkpoint.dir``.

    Where it is unset, a session on one machine (``local`` master) gets a temporary folder;
    on a cluster that is an error, as executors would not see each other's files.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        root = _LOCAL.setdefault(app, "") or tempfile.mkdtemp(prefix="llm-")
        _LOCAL[app] = root
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write once, read back: cuts lineage, and a lost executor costs a re-read."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stored_by(df: DataFrame, name: str, key: str) -> DataFrame:
    """As ``stored``, in buckets of ``key``: a join or cogroup by it leaves these rows where they are.

    There are as many buckets as the session has shuffle partitions. Spark knows buckets by a table's name only, which
    is given back at once; the files stay, as those of ``stored`` do.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    table = path.rsplit("/", 1)[1].replace("-", "_")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(buckets, key).saveAsTable(table)
    kept = spark.table(table)
    spark.sql(f"DROP TABLE `{table}`")
    return kept


def release(spark: SparkSession) -> None:
    """Let go of the shuffle files of finished steps now; Spark otherwise waits for the driver's next collection.

    Python gives up its handles in the background, so the JVM collects a second time after a moment.
    """
    for _ in range(2):
        gc.collect()
        time.sleep(0.3)
        spark.sparkContext._jvm.System.gc()
    time.sleep(0.3)


def split_bytes(sizes, limit: int):
    """Ranges [a, b) of rows with at most ``limit`` bytes together (one larger row stands alone)."""
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if len(sizes) > start:
        yield start, len(sizes)
