"""Reading questions: answer routes, classes, entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agroclime.functions import keywords as kw
from agroclime.functions.keywords import Vocabulary, contains_any, first_term_in, terms_in, with_vocabulary


def route(query: Column) -> Column:
    """The answer kind a question asks for; the first matching rule wins."""
    text = F.lower(query)
    compares = contains_any(text, kw.ASK_COMPARE)
    asks_value = contains_any(text, kw.ASK_VALUE)
    trends = contains_any(text, kw.ASK_TREND) | contains_any(query, kw.QUESTION_YEARS)
    return (
        F.when(compares, "comparison")
        .when(asks_value & trends, "trend")
        .when(asks_value, "specific")
        .when(contains_any(text, kw.ASK_TREND_LOOSE), "trend")
        .when(contains_any(text, kw.ASK_EXTREME), "extreme")
        .when(contains_any(text, kw.ASK_RELATION), "relationship")
        .otherwise("summary")
    )


def route_questions(questions: DataFrame) -> DataFrame:
    return questions.withColumn("route", route(F.col("query")))


def wants_chart(query: Column) -> Column:
    return contains_any(F.lower(query), kw.ASK_CHART)


def with_defaults(questions: DataFrame, top_k: int = 5, temperature: float = 0.7) -> DataFrame:
    """Retrieval depth and temperature where the question gives none."""
    return questions.withColumns({
        "top_k": F.coalesce(F.col("top_k"), F.lit(top_k)).cast("int"),
        "temperature": F.coalesce(F.col("temperature"), F.lit(temperature)).cast("double"),
    })


def question_terms(
    questions: DataFrame,
    states: Vocabulary = kw.QUESTION_STATES,
    crops: Vocabulary = kw.QUESTION_CROPS,
) -> DataFrame:
    """What a question filters on: its first known state and crop, and its years.

    Terms match anywhere in the lower-cased text. ``q_open_years`` marks texts with
    ``to`` or ``-``, which are read as ranges and so do not restrict the year.
    Vocabulary words are lower-case.
    """
    text = F.lower("query")
    questions, states = with_vocabulary(questions, "__states", states)
    questions, crops = with_vocabulary(questions, "__crops", crops)
    questions, years = with_vocabulary(questions, "__years", kw.QUESTION_YEARS)
    return questions.select(
        "question_id",
        "query",
        first_term_in(text, states).alias("q_state"),
        first_term_in(text, crops).alias("q_crop"),
        terms_in(F.col("query"), years).cast("array<int>").alias("q_years"),
        contains_any(text, ["to", "-"]).alias("q_open_years"),
    )


def classify(query: Column) -> Column:
    """The question class of the exploration notebook's parser."""
    text = F.lower(query)
    result = F.lit("unknown")
    for name, words in reversed(kw.QUESTION_CLASSES):
        result = F.when(contains_any(text, words), name).otherwise(result)
    return result


def entities(query: Column, states: Column, crops: Column) -> Column:
    """States, crops, four-digit years and short whole numbers, by vocabulary and pattern.

    States come in the order they are mentioned.
    """
    text = F.lower(query)
    mentioned = F.transform(
        F.filter(states, lambda s: F.instr(text, F.lower(s)) > 0),
        lambda s: F.struct(F.instr(text, F.lower(s)).alias("at"), s.alias("name")),
    )
    return F.struct(
        F.transform(F.array_sort(mentioned), lambda m: m["name"]).alias("states"),
        F.filter(crops, lambda c: F.instr(text, F.lower(c)) > 0).alias("crops"),
        F.regexp_extract_all(query, F.lit(r"(\d{4})"), 1).cast("array<int>").alias("years"),
        F.regexp_extract_all(query, F.lit(r"\b(\d{1,3})\b"), 1).cast("array<int>").alias("numbers"),
    )


def parse_questions(
    questions: DataFrame,
    states: Vocabulary = tuple(kw.STATE_SUBDIVISION),
    crops: Vocabulary = kw.ENTITY_CROPS,
) -> DataFrame:
    """(question_id, question, type, entities)."""
    questions, states = with_vocabulary(questions, "__states", states)
    questions, crops = with_vocabulary(questions, "__crops", crops)
    return questions.select(
        "question_id",
        F.col("query").alias("question"),
        classify(F.col("query")).alias("type"),
        entities(F.col("query"), states, crops).alias("entities"),
    )
