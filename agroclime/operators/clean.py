"""Cleaning of the raw crop and rainfall tables.

Rows are never dropped silently: ``flag_*`` adds a ``reject_reason`` (NULL means
kept), ``kept`` filters on it and ``reject_counts`` reports it, all in narrow
plans that run inside the scan stage.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from agroclime.functions.keywords import STATE_SUBDIVISION
from agroclime.functions.numbers import first_year, nan_to_null, strip, text_to_double, year_number

RAIN_KEYS = ("subdivision", "year", "annual_rainfall")
FACT_KEYS = ("state", "district", "crop", "year_cleaned")
FACT_COLUMNS = ("state", "district", "year_cleaned", "crop", "production", "yield", "annual_rainfall")
MEASURES = ("production", "yield", "annual_rainfall")


def normalize_columns(df: DataFrame) -> DataFrame:
    """Headers trimmed, lower-cased, blanks to underscores."""
    return df.toDF(*[name.strip().lower().replace(" ", "_") for name in df.columns])


def rename_rain(df: DataFrame) -> DataFrame:
    """Rainfall headers: trimmed and lower-cased, ``annual`` becomes ``annual_rainfall``."""
    lowered = df.toDF(*[name.strip().lower() for name in df.columns])
    return lowered.withColumnsRenamed({"annual": "annual_rainfall"})


def coerce_numeric(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Text to DOUBLE per cell, bad cells and NaN to NULL; numbers stay numbers."""
    def coerced(name: str) -> Column:
        if isinstance(df.schema[name].dataType, T.StringType):
            return text_to_double(F.col(name))
        return nan_to_null(F.col(name).cast("double"))

    return df.withColumns({name: coerced(name) for name in cols})


def coerced_cells(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """How many present cells of each column are not numbers: (column_name, coerced)."""
    counted = df.agg(*[
        F.count_if(F.col(c).isNotNull() & text_to_double(F.col(c).cast("string")).isNull()).alias(c) for c in cols
    ])
    return counted.unpivot([], list(cols), "column_name", "coerced")


def project_available(df: DataFrame, want: Sequence[str]) -> DataFrame:
    """The wanted columns that exist, in the wanted order."""
    return df.select(*[c for c in want if c in df.columns])


def subdivision_dim(spark, mapping: dict[str, str] | None = None) -> DataFrame:
    """The state -> subdivision dimension (31 literal rows unless given)."""
    pairs = STATE_SUBDIVISION if mapping is None else mapping
    # An inline table has a known size, so Spark's size check broadcasts it; a frame made from Python rows has none.
    quoted = [tuple("'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'" for s in p) for p in pairs.items()]
    rows = ", ".join(f"({s}, {d})" for s, d in quoted) or "(cast(null as string), cast(null as string))"
    return spark.sql(f"SELECT * FROM VALUES {rows} AS dim(state, subdivision)")


def map_subdivision(crop: DataFrame, dim: DataFrame) -> DataFrame:
    """Adds ``subdivision``; states outside the dimension get NULL.

    No hint: the literal dimension and any small file are broadcast by Spark's own
    size check, a larger one is shuffled.
    """
    return crop.join(dim.select("state", "subdivision"), "state", "left")


def extract_year(df: DataFrame, source: str = "year", target: str = "year_cleaned") -> DataFrame:
    """First four-digit run of the year text as INT."""
    return df.withColumn(target, first_year(F.col(source)))


def _first_reason(checks: Sequence[tuple[str, Column]]) -> Column:
    reason = F.lit(None).cast("string")
    for name, failed in reversed(checks):
        reason = F.when(failed, F.lit(name)).otherwise(reason)
    return reason


def flag_rain(rain: DataFrame) -> DataFrame:
    """Types the rainfall rows and says why a row is unusable."""
    seasonal = [c for c in ("jf", "mam", "jjas", "ond") if c in rain.columns]
    typed = coerce_numeric(rain, ["annual_rainfall", *seasonal]).withColumn("year_int", year_number(F.col("year")))
    reason = _first_reason([
        ("missing subdivision", F.col("subdivision").isNull()),
        ("missing year", F.col("year").isNull()),
        ("bad year", F.col("year_int").isNull()),
        ("missing rainfall", F.col("annual_rainfall").isNull()),
        ("year not after 1900", F.col("year_int") <= 1900),
    ])
    return typed.withColumn("reject_reason", reason).withColumn("year", F.col("year_int")).drop("year_int")


def flag_crop(crop: DataFrame) -> DataFrame:
    """Needs ``subdivision`` and ``year_cleaned``; flags the rows that cannot be joined."""
    return crop.withColumn("reject_reason", _first_reason([
        ("no year", F.col("year_cleaned").isNull()),
        ("unmapped state", F.col("subdivision").isNull()),
    ]))


def flag_facts(facts: DataFrame) -> DataFrame:
    """Flags facts without a full key."""
    return facts.withColumn("reject_reason", _first_reason([(f"missing {c}", F.col(c).isNull()) for c in FACT_KEYS]))


DOCUMENTABLE = ("blank state", "blank district", "blank crop", "missing year")


def flag_documentable(facts: DataFrame) -> DataFrame:
    """Flags facts that cannot become a document: a blank key text or no year."""
    def blank(name: str) -> Column:
        return F.coalesce(strip(F.col(name)) == "", F.lit(True))

    checks = [blank("state"), blank("district"), blank("crop"), F.col("year_cleaned").isNull()]
    return facts.withColumn("reject_reason", _first_reason(list(zip(DOCUMENTABLE, checks, strict=True))))


def kept(flagged: DataFrame) -> DataFrame:
    return flagged.where(F.col("reject_reason").isNull()).drop("reject_reason")


def reject_counts(flagged: DataFrame) -> DataFrame:
    """Rows per reason; kept rows are counted as ``written``."""
    return flagged.groupBy(F.coalesce("reject_reason", F.lit("written")).alias("outcome")).agg(
        F.count("*").alias("n_rows")
    )


def observed_counts(flagged: DataFrame, reasons: Sequence[str]) -> tuple[DataFrame, Observation]:
    """The frame, and an observation that counts its rows per reason while some later action runs over it.

    No pass is added: the counts are those of the very job that writes the rows. ``outcomes`` reads them.
    """
    seen = Observation()
    counts = [F.count_if(F.col("reject_reason").isNull()).alias("written")]
    counts += [F.count_if(F.col("reject_reason") == reason).alias(reason) for reason in reasons]
    return flagged.observe(seen, *counts), seen


def outcomes(spark, seen: Observation) -> DataFrame:
    """(outcome, n_rows) of a finished job, as ``reject_counts`` gives them; outcomes without rows are left out."""
    found = [(name, n) for name, n in seen.get.items() if n]
    return spark.createDataFrame(found, "outcome string, n_rows bigint")


def clean_rain(rain: DataFrame) -> DataFrame:
    """Typed rainfall with a full key and a year after 1900."""
    return kept(flag_rain(rain))


def strict_crop_clean(crop: DataFrame) -> DataFrame:
    """The strict mode: keys present and production, area and yield all numbers."""
    keyed = crop.dropna(subset=["state", "district", "crop", "year"])
    return coerce_numeric(keyed, ["production", "area", "yield"]).dropna(subset=["production", "area", "yield"])
