"""Exploratory aggregates over the facts.

Grouped means skip NULL measures and NULL keys. Every group-by is a partial
aggregate before its shuffle, so a hot state or crop costs nothing extra.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from agroclime.functions.numbers import nan_to_null, pearson
from agroclime.sources.scratch import as_table

QUARTILES = (("p25", 0.25), ("p50", 0.5), ("p75", 0.75))


def grouped_means(df: DataFrame, keys: Sequence[str], means: dict[str, str]) -> DataFrame:
    """Mean of each measure per key; ``means`` maps measure -> output column."""
    return df.dropna(subset=list(keys)).groupBy(*keys).agg(*[F.avg(m).alias(out) for m, out in means.items()])


def yearly_means(facts: DataFrame) -> DataFrame:
    return grouped_means(facts, ["year_cleaned"], {"annual_rainfall": "avg_rainfall", "yield": "avg_yield"})


def _top_mean(facts: DataFrame, key: str, measure: str, out: str, n: int | None) -> DataFrame:
    ranked = grouped_means(facts, [key], {measure: out}).orderBy(F.desc_nulls_last(out), key)
    return ranked if n is None else ranked.limit(n)


def top_crops_by_production(facts: DataFrame, n: int = 10) -> DataFrame:
    return _top_mean(facts, "crop", "production", "avg_production", n)


def top_crops_by_yield(facts: DataFrame, n: int = 15) -> DataFrame:
    return _top_mean(facts, "crop", "yield", "avg_yield", n)


def state_rainfall(facts: DataFrame) -> DataFrame:
    return _top_mean(facts, "state", "annual_rainfall", "avg_rainfall", None)


def state_yield(facts: DataFrame, n: int | None = None) -> DataFrame:
    return _top_mean(facts, "state", "yield", "avg_yield", n)


def state_rain_yield(facts: DataFrame) -> DataFrame:
    return grouped_means(facts, ["state"], {"annual_rainfall": "avg_rainfall", "yield": "avg_yield"})


def most_recorded_crops(facts: DataFrame, n: int = 5) -> DataFrame:
    """The crops with most rows; ties go to the earlier name."""
    counted = facts.dropna(subset=["crop"]).groupBy("crop").agg(F.count("*").alias("n_rows"))
    return counted.orderBy(F.desc("n_rows"), "crop").limit(n)


def restrict_to_top(facts: DataFrame, top: DataFrame) -> DataFrame:
    """Facts of the listed crops only."""
    return facts.join(top.select("crop"), "crop", "left_semi")


def crop_year_yield(facts: DataFrame, n: int = 5) -> DataFrame:
    """Mean yield per (year, crop) for the ``n`` most recorded crops.

    The crop is part of the group key, so the choice of crops can follow the
    aggregation: one pass over the facts, then the top crops are picked from the
    (crop, year) table, instead of reading the facts a second time to filter them.
    """
    by_year = facts.dropna(subset=["crop"]).groupBy("crop", "year_cleaned").agg(
        F.count("*").alias("n_rows"), F.avg("yield").alias("avg_yield")
    )
    by_crop = by_year.groupBy("crop").agg(
        F.sum("n_rows").alias("n_rows"),
        F.collect_list(F.when(F.col("year_cleaned").isNotNull(), F.struct("year_cleaned", "avg_yield"))).alias("years"),
    )
    return by_crop.orderBy(F.desc("n_rows"), "crop").limit(n).select("crop", F.inline("years"))


def chart_means(points: DataFrame, *keys: str) -> DataFrame:
    """Mean production and yield per (Year, State, Crop): both chart series in one pass."""
    return grouped_means(
        points, [*keys, "Year", "State", "Crop"], {"Production": "avg_production", "Yield": "avg_yield"}
    )


def chart_production(points: DataFrame) -> DataFrame:
    return grouped_means(points, ["Year", "State", "Crop"], {"Production": "avg_production"})


def chart_yield(points: DataFrame) -> DataFrame:
    return grouped_means(points, ["Year", "State", "Crop"], {"Yield": "avg_yield"})


def scatter_points(facts: DataFrame, x: str, y: str, hue: Sequence[str] = ()) -> DataFrame:
    """(x, y, labels) with both coordinates present."""
    return facts.dropna(subset=[x, y]).select(x, y, *hue)


def corr_pair(df: DataFrame, x: str, y: str, out: str = "correlation") -> DataFrame:
    return df.agg(pearson(F.col(x), F.col(y)).alias(out))


def corr_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Pearson matrix in wide form, each pair on its own complete rows, in one pass."""
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]
    one = df.agg(*[pearson(F.col(a), F.col(b)).alias(f"{a}|{b}") for a, b in pairs])

    def cell(a: str, b: str):
        name = f"{a}|{b}" if (a, b) in pairs else f"{b}|{a}"
        return F.col(f"`{name}`")

    lines = F.array(*[
        F.struct(F.lit(a).alias("column_name"), *[cell(a, b).alias(b) for b in cols]) for a in cols
    ])
    return one.select(F.inline(lines))


def value_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column_name, value, n, part), stored: how often each value occurs.

    Counting equal values first makes a hot value one row. The counts are then
    range-partitioned by value and written once; ``part`` numbers the ranges in
    value order, and the folder per range lets readers skip the others.
    """
    values = df.select(*[nan_to_null(F.col(c).cast("double")).alias(c) for c in cols])
    long = values.unpivot([], list(cols), "column_name", "value").where("value is not null")
    counts = long.groupBy("column_name", "value").agg(F.count("*").alias("n"))
    ranged = counts.repartitionByRange("column_name", "value").withColumn("part", F.spark_partition_id())
    return as_table(ranged, "value-counts", partition_by=["part"])


def quantiles_of_counts(stored: DataFrame, points=QUARTILES) -> DataFrame:
    """Exact, linearly interpolated quantiles per column of ``value_counts``.

    The built-in exact ``percentile`` gathers all distinct values in one task.
    Here per-range totals give every range its starting rank, and only the ranges
    that hold a wanted rank are ranked inside, so no task holds more than one range.
    """
    # One row per (column, range).
    totals = stored.groupBy("column_name", "part").agg(F.sum("n").alias("part_n"))
    before = Window.partitionBy("column_name").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    placed = totals.select(
        "column_name",
        "part",
        F.coalesce(F.sum("part_n").over(before), F.lit(0)).alias("first_rank"),
        "part_n",
        F.sum("part_n").over(Window.partitionBy("column_name")).alias("total"),
    )
    lower, upper = F.floor("position"), F.ceil("position")
    positions = F.array(*[
        F.struct(F.lit(name).alias("point"), (F.lit(p) * (F.col("total") - 1)).alias("position")) for name, p in points
    ])

    def overlapping(first, last):
        return lambda w: (F.floor(w["position"]) <= last) & (F.ceil(w["position"]) >= first)

    last_rank = F.col("first_rank") + F.col("part_n") - 1
    wanted = placed.withColumn("points", F.filter(positions, overlapping(F.col("first_rank"), last_rank))).where(
        F.size("points") > 0
    )

    running = Window.partitionBy("column_name", "part").orderBy("value").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    # At most two ranges per column and point are left in ``wanted``, whatever the
    # data size; the broadcast also prunes the other ranges' folders from the read.
    ranked = stored.join(F.broadcast(wanted), ["column_name", "part"]).select(
        "column_name", "points", "value", "n", (F.col("first_rank") + F.sum("n").over(running) - 1).alias("to_rank")
    ).withColumn("from_rank", F.col("to_rank") - F.col("n") + 1)
    near = ranked.where(F.exists("points", overlapping(F.col("from_rank"), F.col("to_rank")))).select(
        "column_name", "value", "from_rank", "to_rank", F.inline("points")
    )

    def at(rank):
        return F.max(F.when((F.col("from_rank") <= rank) & (rank <= F.col("to_rank")), F.col("value")))

    picked = near.groupBy("column_name", "point", "position").agg(at(lower).alias("lo"), at(upper).alias("hi"))
    share = F.col("position") - F.floor("position")
    return picked.groupBy("column_name").agg(*[
        F.max(F.when(F.col("point") == name, F.col("lo") + (F.col("hi") - F.col("lo")) * share)).alias(name)
        for name, _ in points
    ])


# percentile_approx is off by at most 1 / ACCURACY of the rows; brackets are twice as wide.
ACCURACY = 10_000


def _brackets(values: DataFrame, cols: Sequence[str], points) -> list[tuple[str, str, float, float, float]]:
    """(column, point, position of the wanted rank, low, high): values that enclose each wanted rank. One job, one row."""
    step = 2 / ACCURACY
    edges = [e for _, p in points for e in (max(p - step, 0.0), min(p + step, 1.0))]
    row = values.agg(*[
        F.struct(F.count(c).alias("n"), F.percentile_approx(c, edges, ACCURACY).alias("edges"),
                 F.min(c).alias("lo"), F.max(c).alias("hi")).alias(f"c{i}") for i, c in enumerate(cols)
    ]).first()
    found = []
    for i, c in enumerate(cols):
        if row[f"c{i}"]["n"]:
            n, at = row[f"c{i}"]["n"], row[f"c{i}"]["edges"]
            for j, (name, p) in enumerate(points):
                low = row[f"c{i}"]["lo"] if edges[2 * j] == 0 or n < ACCURACY else at[2 * j]
                high = row[f"c{i}"]["hi"] if edges[2 * j + 1] == 1 or n < ACCURACY else at[2 * j + 1]
                found.append((c, name, p * (n - 1), low, high))
    return found


def exact_quantiles(df: DataFrame, cols: Sequence[str], points=QUARTILES) -> DataFrame:
    """(column_name, p25, p50, p75) by default; exact, linearly interpolated.

    Values are not shuffled: one aggregate brackets every wanted rank, a second counts what lies under each bracket
    and keeps only the few values inside it, and those alone are ranked (``quantiles_of_counts`` spreads them by
    range). The columns are stored once, so a derived input is computed once.
    """
    typed = df.select(*[nan_to_null(F.col(c).cast("double")).alias(c) for c in cols])
    return _quantiles_of_stored(as_table(typed, "values"), cols, points)


def _quantiles_of_stored(values: DataFrame, cols: Sequence[str], points) -> DataFrame:
    spark = values.sparkSession
    brackets = _brackets(values, cols, points)
    schema = "column_name string, " + ", ".join(f"{name} double" for name, _ in points)
    if not brackets:
        return spark.createDataFrame([], schema)
    inside = F.array(*[
        F.when(F.col(c).between(low, high), F.struct(F.lit(i).alias("bracket"), F.col(c).alias("value")))
        for i, (c, _, _, low, high) in enumerate(brackets)
    ])
    slivers = values.select(F.inline(F.filter(inside, lambda x: x.isNotNull()))).groupBy(
        F.col("bracket").cast("string").alias("column_name"), "value"
    ).agg(F.count("*").alias("n"))
    counts = as_table(
        slivers.repartitionByRange("column_name", "value").withColumn("part", F.spark_partition_id()),
        "value-counts", partition_by=["part"],
    )
    under = values.agg(*[F.count_if(F.col(c) < low).alias(f"b{i}") for i, (c, _, _, low, _) in enumerate(brackets)]).first()
    held = {r["column_name"]: r["n"] for r in counts.groupBy("column_name").agg(F.sum("n").alias("n")).collect()}
    wanted = []
    for i, (c, name, position, _, _) in enumerate(brackets):
        local = position - under[f"b{i}"]
        if not 0 <= local <= held[str(i)] - 1:
            # Not seen within percentile_approx's stated error; the general way needs no bracket.
            return quantiles_of_counts(value_counts(values, cols), points)
        wanted.append((str(i), c, name, float(local)))
    asked = spark.createDataFrame(wanted, "column_name string, real string, point string, position double")
    at = _values_at(counts, asked)
    return at.groupBy(F.col("real").alias("column_name")).agg(*[
        F.max(F.when(F.col("point") == name, F.col("quantile"))).alias(name) for name, _ in points
    ])


def _values_at(counts: DataFrame, asked: DataFrame) -> DataFrame:
    """``asked(column_name, position, ...)`` with ``quantile``, the interpolated value at each position of its counts.

    Only the ranges that hold a wanted rank are ranked inside. ``asked`` has one row per bracket.
    """
    totals = counts.groupBy("column_name", "part").agg(F.sum("n").alias("part_n"))
    before = Window.partitionBy("column_name").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    placed = totals.withColumn("first_rank", F.coalesce(F.sum("part_n").over(before), F.lit(0)))
    holds = (F.floor("position") < F.col("first_rank") + F.col("part_n")) & (F.ceil("position") >= F.col("first_rank"))
    wanted = placed.join(F.broadcast(asked), "column_name").where(holds)
    running = Window.partitionBy("column_name", "part").orderBy("value").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    # At most two ranges per bracket are left in ``wanted``.
    ranked = counts.join(F.broadcast(wanted), ["column_name", "part"]).withColumn(
        "to_rank", F.col("first_rank") + F.sum("n").over(running) - 1
    )
    first = F.col("to_rank") - F.col("n") + 1

    def at(rank):
        return F.max(F.when((first <= rank) & (rank <= F.col("to_rank")), F.col("value")))

    kept = [c for c in asked.columns]
    picked = ranked.groupBy(*kept).agg(at(F.floor("position")).alias("lo"), at(F.ceil("position")).alias("hi"))
    share = F.col("position") - F.floor("position")
    return picked.withColumn("quantile", F.col("lo") + (F.col("hi") - F.col("lo")) * share)


def describe(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """count, mean, std (n-1), min, quartiles and max, one row per column.

    The columns are stored once; two aggregates and the few values near each quartile give the rest.
    """
    typed = df.select(*[nan_to_null(F.col(c).cast("double")).alias(c) for c in cols])
    values = as_table(typed, "values")
    moments = values.agg(*[
        F.struct(
            F.lit(c).alias("column_name"), F.count(c).alias("count"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"),
            F.min(c).alias("min"), F.max(c).alias("max"),
        ).alias(f"c{i}") for i, c in enumerate(cols)
    ]).select(F.inline(F.array(*[f"c{i}" for i in range(len(cols))])))
    return moments.join(_quantiles_of_stored(values, cols, QUARTILES), "column_name", "left").select(
        "column_name", "count", "mean", "std", "min", *[name for name, _ in QUARTILES], "max",
    )


def describe_approx(df: DataFrame, cols: Sequence[str], accuracy: int = ACCURACY) -> DataFrame:
    """``describe`` in one pass without a sort; quartiles within 1/accuracy of their rank, give or take one row."""
    stats = {"count": F.count, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    shares = [p for _, p in QUARTILES]
    one = df.agg(
        *[fn(c).alias(f"{c}|{name}") for c in cols for name, fn in stats.items()],
        *[F.percentile_approx(F.col(c).cast("double"), shares, accuracy).alias(f"{c}|quartiles") for c in cols],
    )
    return one.select(F.inline(F.array(*[
        F.struct(
            F.lit(c).alias("column_name"),
            *[F.col(f"`{c}|{name}`").alias(name) for name in ("count", "mean", "std", "min")],
            *[F.col(f"`{c}|quartiles`")[i].alias(name) for i, (name, _) in enumerate(QUARTILES)],
            F.col(f"`{c}|max`").alias("max"),
        )
        for c in cols
    ])))
