"""The data explorer and table profiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agroclime.functions.numbers import fixed


def explore(
    facts: DataFrame,
    states: Sequence[str] = (),
    crops: Sequence[str] = (),
    years: Sequence[int] = (),
) -> DataFrame:
    """AND of three IN lists; an empty list does not filter. Reaches the Parquet scan."""
    for name, wanted in (("state", states), ("crop", crops), ("year_cleaned", years)):
        if wanted:
            facts = facts.where(F.col(name).isin(list(wanted)))
    return facts


def explorer_page(facts: DataFrame, order_by: Sequence[str], n: int = 1000) -> DataFrame:
    """The first ``n`` rows under a stated order."""
    return facts.orderBy(*order_by).limit(n)


def preview(df: DataFrame, order_by: Sequence[str], n: int = 10) -> DataFrame:
    return explorer_page(df, order_by, n)


def explorer_metrics(facts: DataFrame) -> DataFrame:
    """Row count and mean production, yield and rainfall in one pass."""
    return facts.agg(
        F.count("*").alias("total_records"),
        F.avg("production").alias("avg_production"),
        F.avg("yield").alias("avg_yield"),
        F.avg("annual_rainfall").alias("avg_rainfall"),
    )


def metric_labels(metrics: DataFrame) -> DataFrame:
    """The explorer metrics as display text."""
    return metrics.select(
        F.col("total_records").cast("string").alias("total_records"),
        F.concat(fixed(F.col("avg_production"), 2), F.lit(" tonnes")).alias("avg_production"),
        F.concat(fixed(F.col("avg_yield"), 2), F.lit(" t/ha")).alias("avg_yield"),
        F.concat(fixed(F.col("avg_rainfall"), 1), F.lit(" mm")).alias("avg_rainfall"),
    )


def summary_counts(facts: DataFrame) -> DataFrame:
    """Records, distinct states, districts, crops, and the year range.

    Several exact distinct counts in one aggregate make Spark expand every row
    once per column. Going through the distinct key combinations first collapses
    the data map-side, so only combinations are expanded.
    """
    combos = facts.groupBy("state", "district", "crop", "year_cleaned").agg(F.count("*").alias("n"))
    return combos.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_records"),
        F.countDistinct("state").alias("states"),
        F.countDistinct("district").alias("districts"),
        F.countDistinct("crop").alias("crops"),
        F.min("year_cleaned").alias("first_year"),
        F.max("year_cleaned").alias("last_year"),
    )


def distinct_values(df: DataFrame, col: str, n: int | None = None) -> DataFrame:
    """Sorted option list of a column, optionally its first ``n``."""
    values = df.select(col).where(F.col(col).isNotNull()).distinct().orderBy(col)
    return values if n is None else values.limit(n)


def missing_summary(df: DataFrame) -> DataFrame:
    """NULLs per column: (column_name, missing)."""
    counted = df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in df.columns])
    return counted.unpivot([], list(df.columns), "column_name", "missing")


def profile(df: DataFrame) -> DataFrame:
    """Per column: data type, non-null count, and the table's row and column counts."""
    names = list(df.columns)
    rows = "__rows"
    counted = df.agg(F.count("*").alias(rows), *[F.count(F.col(f"`{c}`")).alias(c) for c in names])
    types = F.create_map(*[F.lit(x) for pair in df.dtypes for x in pair])
    return counted.unpivot([rows], names, "column_name", "non_null").select(
        "column_name",
        types[F.col("column_name")].alias("data_type"),
        "non_null",
        F.col(rows).alias("n_rows"),
        F.lit(len(names)).alias("n_columns"),
    )


def sample_rows(df: DataFrame, n: int, key: Sequence[str], seed: int = 42, strict: bool = False) -> DataFrame:
    """Exactly ``n`` rows without replacement, the same ones on every run.

    Rows are ordered by a digest of the seed and a unique key, so the choice does
    not depend on partitioning; each task keeps only its own ``n`` best. With
    ``strict`` a table smaller than ``n`` is an error.
    """
    if strict and df.select(*key).limit(n).count() < n:
        raise ValueError(f"cannot take {n} rows without replacement: the table is smaller")
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in key]))
    return df.withColumn("__digest", digest).orderBy("__digest", *key).limit(n).drop("__digest")
