"""Tables that grow by batches: every batch is written once, however often its job is repeated.

A batch goes to a folder of its own under ``data``; it belongs to the table from the moment its manifest, one JSON row
under ``commits/<batch>``, names that folder, its part files, its number of rows and its first and last time. A job that fails
before leaves files that no manifest names, and a repeated job finds the manifest and writes nothing. Readers open the
files that manifests name; the newest rows come from the last batches alone.

Manifests are one row a batch, and the driver reads them as it reads any file listing. Counts and times are observed
on the writing job itself, so that a batch is not read again for them.
"""

from __future__ import annotations

import re
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MANIFEST = T.StructType([
    T.StructField("batch", T.StringType()),
    T.StructField("folder", T.StringType()),
    T.StructField("parts", T.ArrayType(T.StringType())),
    T.StructField("n_rows", T.LongType()),
    T.StructField("first_time", T.StringType()),
    T.StructField("last_time", T.StringType()),
])


class BrokenTable(ValueError):
    """The files of a table are not those that its manifests name."""


class WrongRows(ValueError):
    """A batch holds rows that its table refuses; ``many`` says how many."""

    def __init__(self, many: int):
        super().__init__(f"{many} rows are refused")
        self.many = many


def commits(spark: SparkSession, root: str, batch: str | None = None) -> list[Row]:
    """The manifests of all batches, or of one. Should two jobs have committed one batch at once, the first folder by name counts."""
    folder = f"{root}/commits"
    spark.createDataFrame([], MANIFEST).write.mode("ignore").json(folder)  # a table without batches is an empty one
    manifests = spark.read.schema(MANIFEST).option("recursiveFileLookup", True).json(folder)
    found = (manifests if batch is None else manifests.filter(F.col("batch") == batch)).collect()
    by: dict[str, Row] = {}
    for row in sorted(found, key=lambda r: r.folder):
        by.setdefault(row.batch, row)
    return sorted(by.values(), key=lambda r: r.batch)


def append(rows: DataFrame, root: str, batch: str, time_col: str | None = None, wrong: Column | None = None) -> bool:
    """Adds ``rows`` as ``batch``, once: False if that batch was there already, whatever it holds.

    ``time_col``, a text column that sorts by time, lets ``newest`` find the last batches. Should any row be ``wrong``,
    which the writing job counts too, the batch is not committed: WrongRows.
    """
    if not re.fullmatch(r"[A-Za-z0-9._=-]+", batch):
        raise ValueError(f"batch names are letters, digits and ._=-: {batch!r}")
    spark = rows.sparkSession
    if commits(spark, root, batch):
        return False
    folder = f"{batch}-{uuid.uuid4().hex}"
    time = F.col(time_col) if time_col else F.lit(None).cast("string")
    seen = Observation()
    rows.observe(seen, F.count(F.lit(1)).alias("n"), F.min(time).alias("first"), F.max(time).alias("last"),
                 F.count_if(F.lit(False) if wrong is None else wrong).alias("wrong")).write.option("compression", "zstd").parquet(f"{root}/data/{folder}")
    parts = sorted(path.rsplit("/", 1)[1] for path in spark.read.schema(rows.schema).parquet(f"{root}/data/{folder}").inputFiles())
    count = seen.get
    if count["wrong"]:
        raise WrongRows(count["wrong"])
    manifest = spark.createDataFrame([(batch, folder, parts, count["n"], count.get("first"), count.get("last"))], MANIFEST)
    try:
        manifest.coalesce(1).write.mode("error").json(f"{root}/commits/{batch}")
    except AnalysisException as error:
        if error.getCondition() != "PATH_ALREADY_EXISTS":
            raise
        return False  # another job was faster
    return True


def _opened(spark: SparkSession, root: str, schema: T.StructType, manifests: list[Row]) -> DataFrame:
    paths = [f"{root}/data/{m.folder}/{part}" for m in manifests for part in m.parts]
    if not paths:
        return spark.createDataFrame([], schema)
    try:
        return spark.read.schema(schema).parquet(*paths)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            raise BrokenTable(f"{root} lacks files that its manifests name") from error
        raise


def read(spark: SparkSession, root: str, schema: T.StructType, batch: str | None = None) -> DataFrame:
    """All committed rows, or those of one batch; none where nothing is committed yet."""
    return _opened(spark, root, schema, commits(spark, root, batch))


def count(spark: SparkSession, root: str) -> int:
    """Number of committed rows, from the manifests."""
    return sum(m.n_rows for m in commits(spark, root))


def newest(spark: SparkSession, root: str, schema: T.StructType, time_col: str, n: int, then: str) -> DataFrame:
    """The last ``n`` rows by time, newest first, rows of one time by ``then``. Opens only batches that can hold them."""
    wanted = []
    timed = [m for m in commits(spark, root) if m.last_time is not None]
    for m in sorted(timed, key=lambda m: m.last_time, reverse=True):
        # Rows certainly newer than all of this batch, and of all batches after it.
        if sum(w.n_rows for w in wanted if w.first_time > m.last_time) >= n:
            break
        wanted.append(m)
    return _opened(spark, root, schema, wanted).orderBy(F.desc(time_col), then).limit(n)
