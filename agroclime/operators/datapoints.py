"""Aggregates over the data points of each question.

Data points are (question_id, rank, state, district, year, crop, production,
yield, rainfall, text). A question has at most its ``top_k`` of them, because
retrieval keeps no more; every window and group below is keyed by the question,
so one shuffle by ``question_id`` serves a whole chain of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from agroclime.functions.numbers import pearson, ordered_mean

FALLBACK_ROWS = 20
SPECIFIC_ROWS = 20
SPECIFIC_GROUPS = 5
COMPARISON_ROWS = 50
SHOWN_KEYS = 10
SAMPLE_ROWS = 5
MIN_PAIRS = 10
STRONG = 0.3

POINT = ("rank", "state", "district", "year", "crop", "production", "yield", "rainfall")


def per_question():
    return Window.partitionBy("question_id")


def data_points(hits: DataFrame, *keep: str) -> DataFrame:
    """Retrieved documents with metadata, flattened, renumbered in rank order."""
    order = per_question().orderBy("rank")
    return hits.where(F.col("metadata").isNotNull()).select(
        "question_id",
        *keep,
        F.row_number().over(order).alias("rank"),
        F.col("metadata.state").alias("state"),
        F.col("metadata.district").alias("district"),
        F.col("metadata.year").alias("year"),
        F.col("metadata.crop").alias("crop"),
        F.col("metadata.production").alias("production"),
        F.col("metadata.yield").alias("yield"),
        F.col("metadata.annual_rainfall").alias("rainfall"),
        "text",
    )


def matches_terms() -> Column:
    """Does a data point fit the question's state, crop and year terms?"""
    state_ok = F.col("q_state").isNull() | (F.lower("state") == F.col("q_state"))
    crop_ok = F.col("q_crop").isNull() | (F.lower("crop") == F.col("q_crop"))
    year_ok = (
        (F.size("q_years") == 0)
        | F.col("year").isNull()
        | (F.col("year") == 0)
        | F.col("q_open_years")
        | F.array_contains("q_years", F.col("year"))
    )
    return F.coalesce(state_ok & crop_ok & year_ok, F.lit(False))


def filter_by_question(points: DataFrame, terms: DataFrame, keep_all: Column | None = None) -> DataFrame:
    """The points that fit their question, or its first twenty if none does.

    ``terms`` is ``question_terms``; ``keep_all`` lifts the filter per question.
    The result is renumbered.
    """
    joined = points.join(terms, "question_id")
    fits = matches_terms() if keep_all is None else (matches_terms() | keep_all)
    flagged = joined.withColumn("__fits", fits).withColumn("__any", F.max("__fits").over(per_question()))
    chosen = flagged.where(F.when(F.col("__any"), F.col("__fits")).otherwise(F.col("rank") <= FALLBACK_ROWS))
    return chosen.withColumn("rank", F.row_number().over(per_question().orderBy("rank"))).drop(
        "__fits", "__any", "q_state", "q_crop", "q_years", "q_open_years"
    )


def present(c: str) -> Column:
    """Neither NULL, zero nor empty."""
    return F.when(F.col(c) != (0 if c == "year" else ""), F.col(c))


def first_per_group(points: DataFrame) -> DataFrame:
    """First point of each of the first five (state, crop, year) groups of the first twenty."""
    grouped = points.where(F.col("rank") <= SPECIFIC_ROWS).groupBy("question_id", "state", "crop", "year").agg(
        F.min_by(F.struct(*POINT), "rank").alias("first")
    )
    placed = grouped.withColumn("place", F.row_number().over(per_question().orderBy("first.rank")))
    return placed.where(F.col("place") <= SPECIFIC_GROUPS).select(
        "question_id", "place", *[f"first.{c}" for c in POINT if c != "rank"]
    )


def comparison_groups(points: DataFrame) -> DataFrame:
    """What a comparison shows: one row per compared year, state or crop.

    A question compares years if it says so or its points span several, else
    states, else crops. ``place`` numbers the groups shown (the last ten years, the
    first ten names) in display order and is NULL for groups that are not, so every
    question keeps at least one row.
    """
    def distinct(c: str) -> Column:
        return F.size(F.collect_set(present(c)).over(per_question()))

    sized = points.withColumn("n_points", F.count("*").over(per_question())).where(F.col("rank") <= COMPARISON_ROWS)
    mode = (
        F.when(F.lower("query").contains("year") | (distinct("year") > 1), "year")
        .when(distinct("state") > 1, "state")
        .when(distinct("crop") > 1, "crop")
        .otherwise("none")
    )
    key = (
        F.when(F.col("mode") == "year", present("year").cast("string"))
        .when(F.col("mode") == "state", present("state"))
        .when(F.col("mode") == "crop", present("crop"))
    )
    grouped = sized.withColumn("mode", mode).withColumn("key", key).groupBy(
        "question_id", "n_points", "mode", "key"
    ).agg(
        F.coalesce(ordered_mean(F.col("production")), F.lit(0.0)).alias("avg_production"),
        F.coalesce(ordered_mean(F.col("yield")), F.lit(0.0)).alias("avg_yield"),
        F.coalesce(ordered_mean(F.col("rainfall")), F.lit(0.0)).alias("avg_rainfall"),
    )
    by_year = F.col("mode") == "year"
    rank = F.row_number().over(per_question().orderBy(
        F.col("key").isNull(), F.when(by_year, -F.col("key").try_cast("int")).asc_nulls_last(), "key"
    ))
    shown = F.col("key").isNotNull() & (F.col("__rank") <= SHOWN_KEYS)
    return grouped.withColumn("__rank", rank).withColumn(
        "place", F.when(shown, F.when(by_year, SHOWN_KEYS + 1 - F.col("__rank")).otherwise(F.col("__rank")))
    ).drop("__rank")


def _compare_by(points: DataFrame, mode: str) -> DataFrame:
    return comparison_groups(points).where((F.col("mode") == mode) & F.col("place").isNotNull())


def compare_by_year(points: DataFrame) -> DataFrame:
    """Last ten years: the three means, 0 for an empty one."""
    return _compare_by(points, "year").select(
        "question_id", F.col("key").cast("int").alias("year"), "avg_production", "avg_yield", "avg_rainfall"
    )


def compare_by_state(points: DataFrame) -> DataFrame:
    return _compare_by(points, "state").select("question_id", F.col("key").alias("state"), "avg_production", "avg_yield")


def compare_by_crop(points: DataFrame) -> DataFrame:
    return _compare_by(points, "crop").select("question_id", F.col("key").alias("crop"), "avg_production", "avg_yield")


def trend_by_year(points: DataFrame, *keep: str) -> DataFrame:
    """Last ten years: the three means, a mean of zero counting as absent."""
    means = points.where(present("year").isNotNull()).groupBy("question_id", *keep, "year").agg(*[
        F.nullif(ordered_mean(F.col(c)), F.lit(0.0)).alias(f"avg_{c}") for c in ("production", "yield", "rainfall")
    ])
    latest = F.row_number().over(per_question().orderBy(F.desc("year")))
    return means.withColumn("__latest", latest).where(F.col("__latest") <= SHOWN_KEYS).drop("__latest")


def direction_measures() -> list[Column]:
    """Aggregates over ``trend_by_year`` rows: both ends of the production series."""
    year = F.when(F.col("avg_production").isNotNull(), F.col("year"))
    return [
        F.count("avg_production").alias("n_years"),
        F.min(year).alias("first_year"),
        F.max(year).alias("last_year"),
        F.min_by("avg_production", year).alias("first_production"),
        F.max_by("avg_production", year).alias("last_production"),
    ]


def has_direction() -> Column:
    return (F.col("n_years") >= 2) & (F.col("first_production") > 0)


def direction() -> Column:
    return F.when(F.col("last_production") > F.col("first_production"), "increasing").otherwise("decreasing")


def change_pct() -> Column:
    return F.try_divide(F.col("last_production") - F.col("first_production"), F.col("first_production")) * 100


def trend_direction(points: DataFrame) -> DataFrame:
    """First against last mean production within the last ten years."""
    ends = trend_by_year(points).groupBy("question_id").agg(*direction_measures())
    return ends.where(has_direction()).select(
        "question_id", direction().alias("direction"), change_pct().alias("change_pct"), "first_year", "last_year"
    )


def extreme_max(points: DataFrame) -> DataFrame:
    """The point with most production; the earliest wins a tie."""
    return _extreme(points.where(F.col("production").isNotNull()), F.max_by, -F.col("rank"))


def extreme_min(points: DataFrame) -> DataFrame:
    """The point with least production above zero; the earliest wins a tie."""
    return _extreme(points.where(F.col("production") > 0), F.min_by, F.col("rank"))


def _extreme(points: DataFrame, pick, tie: Column) -> DataFrame:
    best = points.groupBy("question_id").agg(
        pick(F.struct(*POINT), F.struct(F.col("production"), tie.alias("tie"))).alias("best")
    )
    return best.select("question_id", *[f"best.{c}" for c in POINT if c != "rank"])


def question_corr(points: DataFrame) -> DataFrame:
    """Rainfall against yield per question, over its points with both."""
    complete = F.col("rainfall").isNotNull() & F.col("yield").isNotNull()
    measured = points.groupBy("question_id").agg(
        F.count_if(complete).alias("n_pairs"),
        pearson(F.col("rainfall"), F.col("yield")).alias("correlation"),
        ordered_mean(F.when(complete, F.col("rainfall"))).alias("avg_rainfall"),
        ordered_mean(F.when(complete, F.col("yield"))).alias("avg_yield"),
    )
    r = F.col("correlation")
    band = F.when(r > STRONG, "positive").when(r < -STRONG, "negative").when(r.isNotNull(), "weak")
    return measured.withColumn("band", F.when(F.col("n_pairs") >= MIN_PAIRS, band).otherwise("limited"))


def summary_stats(points: DataFrame) -> DataFrame:
    """Mean, maximum and minimum of the measures, the count and the first five points."""
    measures = [
        fn(F.col(c)).alias(f"{name}_{c}")
        for c in ("production", "yield", "rainfall")
        for name, fn in (("avg", ordered_mean), ("max", F.max), ("min", F.min))
    ]
    sample = F.when(F.col("rank") <= SAMPLE_ROWS, F.struct("rank", "state", "year", "crop"))
    return points.groupBy("question_id").agg(
        *measures, F.count("*").alias("n_points"), F.array_sort(F.collect_list(sample)).alias("samples")
    )
