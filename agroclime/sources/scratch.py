"""Tables that cut lineage, kept where every executor can reach them."""

from __future__ import annotations

import gc
import shutil
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession


_LOCAL_ROOTS: dict[str, str] = {}


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder named by ``spark.checkpoint.dir``.

    Only a session on one machine (``local`` master) without that setting gets a temporary
    folder; on a cluster its absence is an error, as executors do not share local disks.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _LOCAL_ROOTS:
            _LOCAL_ROOTS[app] = tempfile.mkdtemp(prefix="agroclime-")
        root = _LOCAL_ROOTS[app]
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def clean_scratch(spark: SparkSession) -> None:
    """Delete this session's temporary folder, if it had to make one. A named shared folder is left to its owner."""
    root = _LOCAL_ROOTS.pop(spark.sparkContext.applicationId, None)
    if root:
        shutil.rmtree(root, ignore_errors=True)


def as_table(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write the frame once, as small as Parquet makes it, and read it back.

    Readers get known file sizes (so Spark's own size check decides on a
    broadcast) and lost executors cost a re-read, not a recomputation.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let go of the shuffle files of finished steps now; Spark otherwise waits for the driver's next collection.

    Python gives up its handles in the background, so the JVM collects a second time after a moment.
    """
    for _ in range(2):
        gc.collect()
        time.sleep(0.3)
        spark.sparkContext._jvm.System.gc()
    time.sleep(0.3)
