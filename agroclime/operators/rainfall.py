"""Rainfall comparison of states over the last years."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from agroclime.functions.numbers import fixed, nan_to_null

DEFAULT_YEARS = 5
# Replies.
NEED_TWO_STATES = "Please provide two states to compare."
NOT_SUPPORTED = "Question type not yet supported."


def rain_filter(rain: DataFrame, states: Sequence[str], years: Sequence[int]) -> DataFrame:
    return rain.where(F.col("state").isin(list(states)) & F.col("year").isin(list(years)))


def compare_rainfall(rain: DataFrame, states: Sequence[str], years: int | Sequence[int] = DEFAULT_YEARS) -> DataFrame:
    """Mean yearly rainfall per state: over listed years, or the last ``years`` of the table.

    ``rain`` is (state, year, annual_rainfall).
    """
    if isinstance(years, int):
        last = rain.agg(F.max("year").alias("last")).scalar()
        chosen = rain.where(F.col("state").isin(list(states)) & F.col("year").between(last - years + 1, last))
    else:
        chosen = rain_filter(rain, states, years)
    return chosen.groupBy("state").agg(F.avg("annual_rainfall").alias("avg_annual_rainfall"))


def rainfall_history(rain: DataFrame) -> DataFrame:
    """One row per state: its years in order, each with the sum and count of all rainfall up to it.

    Sums are decimals, so that differences of running sums are exact. A state has as many entries as there are years
    of records; rows without a number are in neither the sum nor the count.
    """
    number = nan_to_null(F.col("annual_rainfall")).cast("decimal(28,6)")
    yearly = rain.where("state is not null and year is not null").groupBy("state", "year").agg(F.sum(number).alias("total"), F.count(number).alias("n"))
    upto = Window.partitionBy("state").orderBy("year").rowsBetween(Window.unboundedPreceding, 0)
    running = yearly.select("state", "year", F.coalesce(F.sum("total").over(upto), F.lit(0)).alias("total"), F.sum("n").over(upto).alias("n"))
    return running.groupBy("state").agg(F.array_sort(F.collect_list(F.struct("year", "total", "n"))).alias("history"))


def _as_of(history: Column, year: Column) -> Column:
    """The running entry of the last year that is not after ``year``; NULL before the first."""
    return F.try_element_at(F.filter(history, lambda e: e["year"] <= year), F.lit(-1))


def answer_parsed(parsed: DataFrame, rain: DataFrame) -> DataFrame:
    """Answers every parsed question of the rainfall comparison class in one job.

    The mean over a range of years is the difference of two running entries of the state, so that a question meets one
    row per state, whatever range it asks for, in a join on the state alone.
    """
    asked = parsed.select(
        "question_id",
        "type",
        F.array_distinct("entities.states").alias("states"),
        F.coalesce(F.try_element_at(F.col("entities.numbers"), F.lit(1)), F.lit(DEFAULT_YEARS)).alias("n_years"),
    ).withColumn("last_year", rain.agg(F.max("year").alias("last")).scalar())
    comparable = asked.where((F.col("type") == "compare_rainfall") & (F.size("states") >= 2)).select(
        "question_id", "n_years", "last_year", F.explode("states").alias("state")
    )
    first_year = F.col("last_year") - F.col("n_years") + 1
    ends = comparable.join(rainfall_history(rain), "state").select(
        "question_id", "state", first_year.alias("first_year"), _as_of(F.col("history"), F.col("last_year")).alias("upto"),
        _as_of(F.col("history"), first_year - 1).alias("before"),
    )
    total = F.col("upto.total") - F.coalesce("before.total", F.lit(0))
    count = F.col("upto.n") - F.coalesce("before.n", F.lit(0))
    mean = F.struct("state", F.try_divide(total.cast("double"), count.cast("double")).alias("mean"))
    # A state without a year in the range has no mean to show.
    in_range = F.when(F.col("upto.year") >= F.col("first_year"), mean)
    pairs = ends.groupBy("question_id").agg(F.array_sort(F.collect_list(in_range)).alias("means"))

    def at(i: int, field: str):
        return F.try_element_at(F.col("means"), F.lit(i))[field]

    text = F.concat(
        F.lit("From "), (F.col("last_year") - F.col("n_years") + 1).cast("string"),
        F.lit(" to "), F.col("last_year").cast("string"), F.lit(", "),
        at(1, "state"), F.lit(" had an average annual rainfall of "), fixed(at(1, "mean"), 2),
        F.lit(" mm, while "), at(2, "state"), F.lit(" had "), fixed(at(2, "mean"), 2), F.lit(" mm."),
    )
    return asked.join(pairs, "question_id", "left").select(
        "question_id",
        F.when(F.col("type") != "compare_rainfall", F.lit(NOT_SUPPORTED))
        .otherwise(F.coalesce(text, F.lit(NEED_TWO_STATES)))
        .alias("answer"),
    )
