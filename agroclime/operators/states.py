"""The explorer's measures from mergeable states: one row per (state, crop, year) instead of the facts.

A row holds counts, exact sums, extremes, a quantile sketch per measure and a sketch of the districts. States of new
facts are appended as batches; any filter on state, crop and year merges the rows it leaves, however many facts they
stand for. Counts, sums, means and extremes are exact. Quantiles and the number of districts are estimates: a quantile
is off by less than ``RANK_ERROR`` of the rows, the districts by about ``DISTINCT_ERROR`` of their number.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from agroclime.functions.numbers import nan_to_null
from agroclime.operators.clean import MEASURES
from agroclime.operators.explore import explore
from agroclime.sources import growing

RANK_ERROR = 0.0165    # of a quantile sketch with the default 200 items, at 99 % confidence
DISTINCT_ERROR = 0.03  # two standard errors of a sketch of 4,096 registers
QUARTILES = (0.25, 0.5, 0.75)
EXACT = T.DecimalType(38, 9)  # sums do not depend on the order of rows
STATES = T.StructType([
    T.StructField("state", T.StringType()),
    T.StructField("crop", T.StringType()),
    T.StructField("year_cleaned", T.IntegerType()),
    T.StructField("n_rows", T.LongType()),
    T.StructField("districts", T.BinaryType()),
    *[T.StructField(f"{m}_{name}", kind) for m in MEASURES for name, kind in (
        ("count", T.LongType()), ("sum", EXACT), ("min", T.DoubleType()), ("max", T.DoubleType()), ("sketch", T.BinaryType()))],
])


def partial_states(facts: DataFrame) -> DataFrame:
    """One row of states per (state, crop, year_cleaned); NaN counts as missing."""
    measured = facts.withColumns({m: nan_to_null(F.col(m)) for m in MEASURES})
    per = [
        column for m in MEASURES for column in (
            F.count(m).alias(f"{m}_count"), F.sum(F.col(m).cast("decimal(28,9)")).cast(EXACT).alias(f"{m}_sum"),
            F.min(m).alias(f"{m}_min"), F.max(m).alias(f"{m}_max"), F.kll_sketch_agg_double(m).alias(f"{m}_sketch"))
    ]
    return measured.groupBy("state", "crop", "year_cleaned").agg(
        F.count("*").alias("n_rows"), F.hll_sketch_agg("district").alias("districts"), *per).to(STATES)


def append_states(facts: DataFrame, root: str, batch: str) -> bool:
    """Adds the states of new facts under ``root``; a batch that is there already is not added again."""
    return growing.append(partial_states(facts), root, batch)


def read_states(spark: SparkSession, root: str) -> DataFrame:
    return growing.read(spark, root, STATES)


def merged_metrics(states: DataFrame, wanted_states: Sequence[str] = (), crops: Sequence[str] = (), years: Sequence[int] = ()) -> DataFrame:
    """One row for the facts behind the filtered states.

    total_records, states, crops, first_year, last_year and the measures' count, mean, min and max are exact;
    approx_districts and q1, median and q3 of each measure come from merged sketches, NULL without rows.
    """
    chosen = explore(states, wanted_states, crops, years)
    merged = chosen.agg(
        F.coalesce(F.sum("n_rows"), F.lit(0)).alias("total_records"), F.countDistinct("state").alias("states"), F.countDistinct("crop").alias("crops"),
        F.min("year_cleaned").alias("first_year"), F.max("year_cleaned").alias("last_year"),
        F.hll_sketch_estimate(F.hll_union_agg("districts")).alias("approx_districts"),
        *[c for m in MEASURES for c in (
            F.coalesce(F.sum(f"{m}_count"), F.lit(0)).alias(f"{m}_count"), F.sum(f"{m}_sum").alias(f"{m}_sum"),
            F.min(f"{m}_min").alias(f"min_{m}"), F.max(f"{m}_max").alias(f"max_{m}"), F.kll_merge_agg_double(f"{m}_sketch").alias(f"{m}_sketch"))],
    )
    shown = ["total_records", "states", "crops", "first_year", "last_year", "approx_districts"]
    for m in MEASURES:
        some = F.col(f"{m}_count") > 0
        shown += [
            F.col(f"{m}_count").alias(f"n_{m}"), F.when(some, F.col(f"{m}_sum").cast("double") / F.col(f"{m}_count")).alias(f"avg_{m}"), f"min_{m}", f"max_{m}",
            *[F.when(some, F.kll_sketch_get_quantile_double(f"{m}_sketch", F.lit(q))).alias(f"{name}_{m}")
              for name, q in zip(("q1", "median", "q3"), QUARTILES, strict=True)],
        ]
    return merged.select(*shown)


def rank_errors(facts: DataFrame, quantiles: DataFrame, cols: Sequence[str], shares: dict[str, float]) -> DataFrame:
    """How far estimated quantiles are from their ranks: (column_name, quantile, rank_error), as shares of the rows.

    ``quantiles`` is one row with a column ``{name}_{col}`` for every name of ``shares``. Zero if the estimate is a value
    whose ranks include the wanted one.
    """
    row = quantiles.first()
    parts = []
    for c in cols:
        for name, share in shares.items():
            v = F.lit(row[f"{name}_{c}"])
            below, upto, all_ = F.count_if(F.col(c) < v), F.count_if(F.col(c) <= v), F.count(c)
            parts.append(F.struct(
                F.lit(c).alias("column_name"), F.lit(name).alias("quantile"),
                F.greatest(below / all_ - share, share - upto / all_, F.lit(0.0)).alias("rank_error")).alias(f"r{len(parts)}"))
    return facts.agg(*parts).select(F.inline(F.array(*[f"r{i}" for i in range(len(parts))])))
