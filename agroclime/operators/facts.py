"""The facts table: crop rows joined with yearly rainfall."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agroclime.operators.clean import (
    FACT_COLUMNS,
    MEASURES,
    coerce_numeric,
    extract_year,
    flag_crop,
    flag_facts,
    kept,
    map_subdivision,
    project_available,
)


def join_rainfall(crop: DataFrame, rain: DataFrame, keep_rain_year: bool = False) -> DataFrame:
    """Inner join on (subdivision, year); several rainfall rows for a key fan out.

    The rainfall side is cut to three columns. Given as a stored table it has a
    known size, and Spark broadcasts it below ``autoBroadcastJoinThreshold``; above
    that the join shuffles and adaptive execution splits the skewed keys.
    """
    right = rain.select(
        "subdivision", F.col("year").alias("rain_year"), F.col("annual_rainfall")
    )
    joined = crop.join(
        right.withColumnRenamed("subdivision", "rain_subdivision"),
        (F.col("subdivision") == F.col("rain_subdivision")) & (F.col("year_cleaned") == F.col("rain_year")),
        "inner",
    ).drop("rain_subdivision")
    return joined if keep_rain_year else joined.drop("rain_year")


def duplicate_rain_keys(rain: DataFrame) -> DataFrame:
    """Rainfall keys that would fan the join out."""
    counted = rain.groupBy("subdivision", "year").agg(F.count("*").alias("n_rows"))
    return counted.where("n_rows > 1")


def build_facts(crop: DataFrame, rain: DataFrame, dim: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """Crop rows with ``state, district, crop, year`` and measures -> facts.

    ``extra`` names pass-through columns to keep (``area`` for the exploration
    notebook's tables). Bad measure cells become NULL, the row stays.
    """
    measures = [m for m in ("production", "yield", "area") if m in crop.columns]
    dated = extract_year(coerce_numeric(crop, measures))
    usable = kept(flag_crop(map_subdivision(dated, dim)))
    joined = join_rainfall(usable, rain)
    return kept(flag_facts(project_available(joined, [*FACT_COLUMNS, *extra])))


__all__ = ["MEASURES", "build_facts", "duplicate_rain_keys", "join_rainfall"]
