"""Routes, classes, terms and entities (goldens G10, G11)."""

import pytest
from pyspark.sql import functions as F

from agroclime.operators import questions as q

ROUTES = {
    "What is the rice production in Tamil Nadu in 2015?": "trend",
    "What is the rice production in Tamil Nadu?": "specific",
    "Compare rainfall and rice yield in Tamil Nadu for 2015-2020": "comparison",
    "Which state has the highest wheat production?": "extreme",
    "Which state has the highest wheat production in 2020?": "trend",
    "Show me crop yield trends for Maharashtra from 2010-2020": "trend",
    "What is the correlation between rainfall and crop yield in Punjab?": "specific",
    "Which districts in Karnataka produced the most sugarcane in 2020?": "trend",
    "Correlation between rainfall and yield": "relationship",
    "Rice in Punjab": "summary",
    "Tell me the comparison": "comparison",
    "How much rice in 1996": "specific",
}
CLASSES = {
    "Compare the average annual rainfall in Kerala and Tamil Nadu for the last 5 years.": "compare_rainfall",
    "Which district in Maharashtra had the highest rice production last year?": "top_crops",
    "Show trend of maize yield in Karnataka over the last decade.": "trend_analysis",
    "How does it correlate": "correlation_analysis",
    "An argument for wheat": "policy_argument",
    "Hello": "unknown",
}


def asked(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "question_id int, query string")


def test_routes(spark):
    got = {r.query: r.route for r in q.route_questions(asked(spark, ROUTES)).collect()}
    assert got == ROUTES


def test_classes(spark):
    rows = asked(spark, CLASSES).select("query", q.classify(F.col("query")).alias("c")).collect()
    assert {r.query: r.c for r in rows} == CLASSES


def test_chart_words(spark):
    rows = asked(spark, ["Show it", "rice"]).select(q.wants_chart(F.col("query")).alias("c")).collect()
    assert [r.c for r in rows] == [True, False]


@pytest.mark.parametrize("text, state, crop, years, open_years", [
    ("rice in punjab and bihar", "punjab", "rice", [], False),
    ("the price of potato", None, "rice", [], True),
    ("Wheat 2010 and 1996", None, "wheat", [2010], False),
    ("cotton 2010-2012", None, "cotton", [2010, 2012], True),
])
def test_terms(spark, text, state, crop, years, open_years):
    row = q.question_terms(asked(spark, [text])).collect()[0]
    assert (row.q_state, row.q_crop, row.q_years, row.q_open_years) == (state, crop, years, open_years)


def test_terms_from_a_vocabulary_table(spark):
    words = spark.createDataFrame([(["nation_1", "nation_12"],)], "w array<string>")
    row = q.question_terms(asked(spark, ["in NATION_12"]), words, []).collect()[0]
    assert (row.q_state, row.q_crop) == ("nation_1", None)


def test_entities(spark):
    text = "Compare rainfall in Tamil Nadu and Kerala for rice over the last 3 years since 2001"
    row = q.parse_questions(asked(spark, [text])).collect()[0]
    assert row.type == "compare_rainfall" and row.entities.asDict() == {
        "states": ["Tamil Nadu", "Kerala"], "crops": ["rice"], "years": [2001], "numbers": [3],
    }


def test_defaults(spark):
    rows = spark.createDataFrame([(1, "a", None, None), (2, "b", 9, 0.1)], "question_id int, query string, top_k int, temperature double")
    assert [(r.top_k, r.temperature) for r in q.with_defaults(rows).collect()] == [(5, 0.7), (9, 0.1)]
