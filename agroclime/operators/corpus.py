"""Facts -> documents: one sentence, a stable id and a metadata record per row.

Everything is a narrow column expression, so corpus building is one stage from
scan to write.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from agroclime.functions.numbers import fixed, shortest_text, strip
from agroclime.operators.clean import DOCUMENTABLE, MEASURES, coerce_numeric, flag_documentable, kept, observed_counts
from agroclime.sources.schemas import DOCUMENT, METADATA

# Fixed value: the label every document carries.
SOURCE_LABEL = "Ministry of Agriculture (crop) & IMD (rainfall)"


def _trimmed(name: str) -> Column:
    return strip(F.col(name))


def sentence(year: Column, state: Column, district: Column, crop: Column,
             production: Column, yield_: Column, rainfall: Column) -> Column:
    """The fact as a sentence; absent measures drop their part of it."""
    return F.concat_ws(
        " ",
        F.when(year != 0, F.format_string("In %s,", year)).otherwise(F.lit("In an available year,")),
        F.concat(F.lit("the district "), district, F.lit(" in "), state),
        F.when(
            production.isNotNull(),
            F.concat(F.lit("produced "), fixed(production, 2), F.lit(" tonnes of "), crop),
        ).otherwise(F.concat(F.lit("reported production for "), crop)),
        F.concat(F.lit("with yield "), fixed(yield_, 2), F.lit(" tonnes per hectare")),
        F.concat(F.lit("and recorded "), fixed(rainfall, 1), F.lit(" mm annual rainfall.")),
    )


def document_id(state: Column, district: Column, crop: Column, year: Column, production: Column) -> Column:
    """First 16 hex digits of the SHA-1 of the five identifying fields."""
    parts = F.concat_ws("|", state, district, crop, year.cast("string"), shortest_text(production))
    return F.substring(F.sha1(parts), 1, 16)


def fact_sentences(facts: DataFrame) -> DataFrame:
    """The documentable facts with their sentence in ``text``."""
    return _told(flag_documentable(coerce_numeric(facts, MEASURES)))


def _told(flagged: DataFrame) -> DataFrame:
    return kept(flagged).withColumn("text", sentence(
        F.col("year_cleaned"), _trimmed("state"), _trimmed("district"), _trimmed("crop"),
        F.col("production"), F.col("yield"), F.col("annual_rainfall"),
    ))


def build_documents(facts: DataFrame, created_at: str | None = None, extra: tuple[str, ...] = ()) -> DataFrame:
    """Documents (id, text, metadata). Rows repeating the id fields keep equal ids.

    ``created_at`` pins the run's time stamp, so a re-run writes the same bytes.
    """
    return _documents(fact_sentences(facts), created_at, extra)


def observed_documents(facts: DataFrame, created_at: str | None = None) -> tuple[DataFrame, Observation]:
    """The same documents, and an observation of how many facts the job that uses them kept and rejected, by reason."""
    flagged, seen = observed_counts(flag_documentable(coerce_numeric(facts, MEASURES)), DOCUMENTABLE)
    return _documents(_told(flagged), created_at), seen


def _documents(told: DataFrame, created_at: str | None, extra: tuple[str, ...] = ()) -> DataFrame:
    stamp = (
        F.lit(created_at) if created_at is not None
        else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    )
    state, district, crop = _trimmed("state"), _trimmed("district"), _trimmed("crop")
    year = F.col("year_cleaned")
    metadata = F.struct(
        state.alias("state"),
        district.alias("district"),
        F.nullif(year, F.lit(0)).cast("int").alias("year"),
        crop.alias("crop"),
        F.col("production"),
        F.col("yield"),
        F.col("annual_rainfall"),
        F.lit(SOURCE_LABEL).alias("source"),
        stamp.alias("created_at"),
    ).cast(METADATA)
    return told.select(
        document_id(state, district, crop, year, F.col("production")).alias("id"),
        "text",
        metadata.alias("metadata"),
        *extra,
    )


def document_json(documents: DataFrame) -> DataFrame:
    """Each document as one JSON text, absent values written as null."""
    return documents.select(
        "id", F.to_json(F.struct("id", "text", "metadata"), {"ignoreNullFields": "false"}).alias("line")
    )


def parse_document_json(lines: DataFrame, line_col: str = "line") -> DataFrame:
    """JSON texts back to documents."""
    return lines.select(F.from_json(F.col(line_col), DOCUMENT).alias("doc")).select("doc.*")


def flatten_metadata(documents: DataFrame) -> DataFrame:
    """Metadata fields as top-level columns."""
    return documents.select("id", "text", "metadata.*")


def corpus_sample(documents: DataFrame, n: int = 200) -> DataFrame:
    """The first ``n`` documents by id, flattened."""
    return flatten_metadata(documents.orderBy("id", "text").limit(n))
