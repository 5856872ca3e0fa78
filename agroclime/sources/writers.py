"""Writers for the facts, the corpus, its sample, the vectors and their manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame

from agroclime.operators.clean import outcomes
from agroclime.operators.corpus import corpus_sample, observed_documents
from agroclime.operators.vectors import vector_manifest

FILE_ROWS = 1_000_000


def write_facts(df: DataFrame, path: str, fmt: str = "parquet", partition_by_year: bool = False) -> None:
    """Parquet for later stages (by year if asked, for pruning), CSV with a header for exchange."""
    if partition_by_year:  # one task per year, a heavy year split, instead of a file per task and year
        df = df.hint("rebalance", "year_cleaned")
    writer = df.write.mode("overwrite")
    if partition_by_year:
        writer = writer.partitionBy("year_cleaned")
    if fmt == "csv":
        writer.option("header", True).option("escape", '"').csv(path)
    else:
        writer.parquet(path)


def write_corpus(documents: DataFrame, path: str, compression: str = "gzip") -> None:
    """One JSON object per line; absent values are written as ``null``.

    The text is packed to a ninth of its size, or as ``compression`` says ("none": plain text). A packed file is read
    whole by one task, so a file takes no more than FILE_ROWS documents.
    """
    writer = documents.write.mode("overwrite").option("ignoreNullFields", "false")
    writer.option("compression", compression).option("maxRecordsPerFile", FILE_ROWS).json(path)


def write_counted_corpus(facts: DataFrame, path: str, created_at: str | None = None) -> DataFrame:
    """Writes the corpus of ``facts`` and returns what that very job wrote and skipped: (outcome, n_rows)."""
    documents, seen = observed_documents(facts, created_at)
    write_corpus(documents, path)
    return outcomes(facts.sparkSession, seen)


def write_corpus_sample(documents: DataFrame, path: str, n: int = 200) -> None:
    """The first ``n`` documents by id, flattened, as CSV."""
    corpus_sample(documents, n).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_vectors(vectors: DataFrame, path: str) -> None:
    vectors.write.mode("overwrite").option("compression", "zstd").parquet(path)


def write_manifest(vectors: DataFrame, path: str, model_name: str) -> None:
    vector_manifest(vectors, model_name).write.mode("overwrite").json(path)
