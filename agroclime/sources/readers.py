"""Readers for the raw tables, the facts, the corpus and the vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from agroclime.functions.keywords import NA_TOKENS
from agroclime.functions.numbers import text_to_double, year_number
from agroclime.operators.clean import FACT_KEYS, normalize_columns, rename_rain
from agroclime.sources.csv_files import read_csv
from agroclime.sources.schemas import DOCUMENT, FACTS, VECTOR


def na_to_null(df: DataFrame) -> DataFrame:
    """Turn the no-value spellings into NULL in every text column (exact match)."""
    return df.select(*[
        F.when(~F.col(f"`{f.name}`").isin(NA_TOKENS), F.col(f"`{f.name}`")).alias(f.name)
        if isinstance(f.dataType, T.StringType) else F.col(f"`{f.name}`")
        for f in df.schema.fields
    ])


def read_crop(spark: SparkSession, path, encoding: str | None = None) -> DataFrame:
    """Crop CSV with normalised headers, all cells text. Files of any size are split, quoted line breaks included.

    Without ``encoding`` each file is UTF-8 or else Latin-1. Every cell stays text: types are set by explicit coercion
    afterwards, so one bad cell costs that cell and no second pass infers anything.
    """
    return normalize_columns(na_to_null(read_csv(spark, path, encoding)))


def read_rain(spark: SparkSession, path, encoding: str | None = None) -> DataFrame:
    """Rainfall CSV with the build's column names, all cells text."""
    return rename_rain(na_to_null(read_csv(spark, path, encoding)))


def read_facts(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """The saved facts. CSV columns go by their header names and cells are coerced one by one; Parquet is typed already.

    A measure that a CSV file lacks is NULL; a missing key column is an error.
    """
    if fmt == "parquet":
        return spark.read.schema(FACTS).parquet(path).select(FACTS.names)
    raw = normalize_columns(na_to_null(read_csv(spark, path)))
    absent = [k for k in FACT_KEYS if k not in raw.columns]
    if absent:
        raise ValueError(f"no column {', '.join(absent)} in {path}")
    raw = raw.withColumns({f.name: F.lit(None).cast("string") for f in FACTS.fields if f.name not in raw.columns})
    return raw.select(*[
        F.col(f.name) if isinstance(f.dataType, T.StringType)
        else (year_number if isinstance(f.dataType, T.IntegerType) else text_to_double)(F.col(f.name)).alias(f.name)
        for f in FACTS.fields
    ])


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """Documents from JSON lines."""
    return spark.read.schema(DOCUMENT).json(path)


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """Documents with their vectors; both sit in one row, so nothing is paired by position."""
    return spark.read.schema(VECTOR).parquet(path)


def rows_to_df(spark: SparkSession, rows: list, schema: T.StructType | str) -> DataFrame:
    """A small in-memory table with an explicit schema."""
    return spark.createDataFrame(rows, schema)
