"""The vector store as a table that grows: only documents that are new are embedded, and loading checks what is there.

A document is known by a key, the digest of its id, its content and its occurrence: ids repeat by design, and so may
whole documents. An update compares the corpus with the store by key, stores the difference, embeds it and appends it as
one batch; documents that left the corpus are marked removed. The folder's config names model, width and index kind.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from agroclime.operators.vectors import INDEX_TYPE, embed
from agroclime.sources import growing
from agroclime.sources.schemas import VECTOR
from agroclime.sources.scratch import as_table, release

STORED = T.StructType([T.StructField("key", T.StringType()), T.StructField("turn", T.IntegerType()), *VECTOR.fields])
REMOVED = T.StructType([T.StructField("key", T.StringType()), T.StructField("turn", T.IntegerType())])
CONFIG = T.StructType([
    T.StructField("model_name", T.StringType()),
    T.StructField("embedding_dim", T.IntegerType()),
    T.StructField("index_type", T.StringType()),
])


class StoreMismatch(ValueError):
    """The store is not what its config and manifests, or its caller, say."""


def keyed_documents(documents: DataFrame) -> DataFrame:
    """Documents with ``occurrence``, from 0 among those of one id in order of content, and ``key``.

    The numbers follow from the content alone, so every run gives the same ones. A document moves once, by its id;
    equal ones are counted there and numbered as one row. Metadata moves as the text that it is ordered by, and is read
    from it again.
    """
    kind = documents.schema["metadata"].dataType
    return _numbered(_contents(documents).repartition("id")).select("id", "content.text", _metadata(kind), "occurrence", "key")


def _contents(documents: DataFrame) -> DataFrame:
    content = F.struct("text", F.to_json("metadata", {"ignoreNullFields": "false"}).alias("metadata"))
    return documents.select("id", content.alias("content"), F.lit(None).cast("string").alias("stored"))


def _metadata(kind: T.DataType):
    return F.from_json("content.metadata", kind).alias("metadata")


def _numbered(rows: DataFrame) -> DataFrame:
    """Rows (id, content, stored) that lie by id, with ``occurrence`` and ``key``; a row with a ``stored`` key keeps that and is not counted."""
    alike = rows.groupBy("id", "content", "stored").agg(F.count("*").alias("copies"))
    before = Window.partitionBy("id").orderBy("content").rowsBetween(Window.unboundedPreceding, -1)
    counted = F.when(F.col("stored").isNull(), F.col("copies"))
    placed = alike.withColumn("before", F.coalesce(F.sum(counted).over(before), F.lit(0)))
    each = placed.select("*", F.explode(F.sequence(F.col("before"), F.col("before") + F.col("copies") - 1)).alias("occurrence"))
    key = F.sha1(F.to_json(F.struct("id", "occurrence", "content"), {"ignoreNullFields": "false"}))
    return each.withColumn("key", F.coalesce("stored", key))


def _changes(documents: DataFrame, stored: DataFrame) -> DataFrame:
    """Documents whose key is not among the ``stored`` (id, key), and keys that no document has, as ``gone``.

    Documents and stored keys move in one shuffle by id, and a key's rows are looked at where its id's rows lie.
    """
    kind, contents = documents.schema["metadata"].dataType, _contents(documents)
    there = stored.select(F.col("id").cast(documents.schema["id"].dataType), F.lit(None).cast(contents.schema["content"].dataType).alias("content"), F.col("key").alias("stored"))
    met = Window.partitionBy("id", "key")
    sides = _numbered(contents.unionByName(there).repartition("id")).select(
        "*", F.count("stored").over(met).alias("kept"), F.count("*").over(met).alias("rows"))
    return sides.where("kept in (0, rows)").select("id", "content.text", _metadata(kind), "key", (F.col("kept") > 0).alias("gone"))


def _config(spark: SparkSession, root: str):
    return spark.read.schema(CONFIG).json(f"{root}/config").first()


def _stored(spark: SparkSession, root: str) -> DataFrame:
    """Rows that no later turn removed. Rows of the last turn that removed any, and of later ones, are not compared."""
    rows = growing.read(spark, f"{root}/vectors", STORED)
    if not growing.count(spark, f"{root}/removed"):
        return rows
    removed = growing.read(spark, f"{root}/removed", REMOVED)
    last = removed.agg(F.max("turn")).first()[0]
    gone = removed.select(F.col("key").alias("__key"), F.col("turn").alias("__turn"))
    older = rows.where(F.col("turn") < last).join(gone, (F.col("key") == F.col("__key")) & (F.col("__turn") > F.col("turn")), "left_anti")
    return older.unionByName(rows.where(F.col("turn") >= last))


def update_store(documents: DataFrame, root: str, encoder, model_name: str, dim: int, batch: str) -> int:
    """Brings the store to the present corpus; returns how many documents were embedded.

    ``encoder(df, text_col, out)`` as for ``embed``; vectors of another width are an error and nothing is stored. A job
    repeated under the same ``batch`` name adds nothing twice, wherever its first run ended.
    """
    spark = documents.sparkSession
    config = spark.createDataFrame([(model_name, dim, INDEX_TYPE)], CONFIG)
    config.coalesce(1).write.mode("ignore").json(f"{root}/config")  # the first update's stays
    check_config(spark, root, model_name, dim)
    done = {m.batch: m for m in growing.commits(spark, f"{root}/vectors")}
    # Turns count batches; a repeated batch has the turn it had.
    turn = sorted(done).index(batch) if batch in done else len(done)
    if batch in done:
        turns = growing.read(spark, f"{root}/vectors", STORED, batch).agg(F.max("turn")).first()[0]
        turn = turns if turns is not None else turn
    if batch in done and growing.commits(spark, f"{root}/removed", batch):
        return done[batch].n_rows  # a repeated job has nothing left to do
    known = _stored(spark, root).where(F.col("turn") < turn).select("id", "key") if done else None
    changed = as_table(keyed_documents(documents).drop("occurrence") if known is None else _changes(documents, known), "corpus")
    if batch not in done:
        fresh = changed if known is None else changed.where("not gone").drop("gone")
        coded = embed(fresh, "text", encoder).select("key", F.lit(turn).alias("turn"), *[f.name for f in VECTOR.fields])
        try:
            growing.append(coded.to(STORED), f"{root}/vectors", batch, wrong=F.col("embedding").isNull() | (F.size("embedding") != dim))
        except growing.WrongRows as error:
            raise StoreMismatch(f"{error.many} vectors of {model_name} are not {dim} wide") from error
    gone = changed.where("false") if known is None else changed.where("gone")
    growing.append(gone.select("key", F.lit(turn).alias("turn")).to(REMOVED), f"{root}/removed", batch)
    release(spark)
    return growing.commits(spark, f"{root}/vectors", batch)[0].n_rows


def check_config(spark: SparkSession, root: str, model_name: str, dim: int) -> None:
    found = _config(spark, root)
    for name, have, want in (("model", found.model_name, model_name), ("width", found.embedding_dim, dim), ("index kind", found.index_type, INDEX_TYPE)):
        if have != want:
            raise StoreMismatch(f"{root} has {name} {have}, not {want}")


def load_store(spark: SparkSession, root: str, model_name: str, dim: int, measure: bool = False) -> DataFrame:
    """The store's documents with key and vector.

    An error if the config names another model, width or index kind, if part files are missing, or if the files hold
    another number of rows than the manifests say; counting reads Parquet footers only. With ``measure`` the width of
    every vector is checked too, which reads them all.
    """
    check_config(spark, root, model_name, dim)
    rows = growing.read(spark, f"{root}/vectors", STORED)
    said, held = growing.count(spark, f"{root}/vectors"), rows.count()
    if said != held:
        raise StoreMismatch(f"{root} holds {held} vectors, its manifests name {said}")
    if measure:
        wrong = rows.where(F.col("embedding").isNull() | (F.size("embedding") != dim)).count()
        if wrong:
            raise StoreMismatch(f"{wrong} vectors in {root} are not {dim} wide")
    return _stored(spark, root).drop("turn")


def store_manifest(spark: SparkSession, root: str) -> DataFrame:
    """Model, width, number of live vectors and index kind, as one row."""
    live = _stored(spark, root).agg(F.count("*").alias("num_vectors"))
    return live.select(*[F.lit(_config(spark, root)[c]).alias(c) for c in ("model_name", "embedding_dim")], "num_vectors", F.lit(INDEX_TYPE).alias("index_type"))
