"""Data point aggregates and answer texts (goldens G9, G12, G13)."""

import pytest
from pyspark.sql import functions as F

from agroclime.operators import answers as an
from agroclime.operators import datapoints as dp
from agroclime.operators import rainfall
from agroclime.operators.corpus import build_documents
from agroclime.operators.questions import question_terms
from agroclime.operators.vectors import HashingEncoder, embed
from agroclime.sources.schemas import DOCUMENT, FACTS

POINT = ("question_id int, rank int, state string, district string, year int, crop string, "
         "production double, yield double, rainfall double, text string")


def points(spark, rows, qid=1):
    """rows: (state, year, crop, production, yield, rainfall) in rank order."""
    full = [(qid, i, s, "D", y, c, p, yl, r, "t") for i, (s, y, c, p, yl, r) in enumerate(rows, 1)]
    return spark.createDataFrame(full, POINT)


def asked(spark, query, qid=1):
    return spark.createDataFrame([(qid, query)], "question_id int, query string")


def with_query(spark, rows, query):
    return points(spark, rows).withColumn("query", F.lit(query))


def answer(df):
    got = {r.question_id: r.answer for r in df.collect()}
    assert list(got) == [1]
    return got[1]


def by_year(*pairs):
    return [("Kerala", y, "Rice", p, None, None) for y, p in pairs]


# ------------------------------------------------------------ question filter

def filtered(spark, query, rows):
    got = dp.filter_by_question(points(spark, rows), question_terms(asked(spark, query)))
    return [(r.rank, r.state, r.year, r.crop) for r in got.orderBy("rank").collect()]


def test_first_state_of_the_vocabulary_wins(spark):
    rows = [("Bihar", 2001, "Rice", 1.0, 1.0, 1.0), ("PUNJAB", 2001, "Rice", 1.0, 1.0, 1.0)]
    assert filtered(spark, "rice in bihar and punjab", rows) == [(1, "PUNJAB", 2001, "Rice")]


def test_year_terms(spark):
    rows = [("x", 2010, "Wheat", 1.0, 1.0, 1.0), ("x", 2011, "Wheat", 1.0, 1.0, 1.0), ("x", None, "Wheat", 1.0, 1.0, 1.0)]
    assert [y for _, _, y, _ in filtered(spark, "wheat 2010", rows)] == [2010, None]
    rows = [(s, y, "Cotton", p, yl, r) for s, y, _, p, yl, r in rows]
    assert [y for _, _, y, _ in filtered(spark, "cotton 2010", rows)] == [2010, 2011, None]


def test_fallback_to_first_twenty(spark):
    rows = [("x", 2010, "Barley", float(i), 1.0, 1.0) for i in range(30)]
    got = filtered(spark, "wheat 2010", rows)
    assert [rank for rank, *_ in got] == list(range(1, 21))


# ----------------------------------------------------------------- aggregates

def direction(spark, *pairs):
    return [tuple(r) for r in dp.trend_direction(points(spark, by_year(*pairs))).collect()]


def test_trend_direction(spark):
    assert direction(spark, (2001, 10.0), (2002, 10.0)) == [(1, "decreasing", 0.0, 2001, 2002)]
    assert direction(spark, (2001, 0.0), (2002, 5.0)) == []
    assert direction(spark, (2001, None), (2002, 5.0), (2003, 10.0)) == [(1, "increasing", 100.0, 2002, 2003)]
    twelve = [(2000 + i, 100.0 - i) for i in range(12)]
    assert direction(spark, *twelve) == [(1, "decreasing", pytest.approx(-900 / 98), 2002, 2011)]


def test_last_ten_years(spark):
    twelve = by_year(*[(2000 + i, float(i)) for i in range(12)])
    assert sorted(r.year for r in dp.trend_by_year(points(spark, twelve)).collect()) == list(range(2002, 2012))
    got = dp.compare_by_year(with_query(spark, twelve, "compare")).orderBy("year").collect()
    assert [(r.year, r.avg_production, r.avg_yield) for r in got] == [(2000 + i, float(i), 0.0) for i in range(2, 12)]


def test_comparison_modes(spark):
    states = [(f"s{i:02d}", 2001, "Rice", float(i), 1.0, 1.0) for i in range(12)]
    got = dp.compare_by_state(with_query(spark, states, "compare")).orderBy("state").collect()
    assert [r.state for r in got] == [f"s{i:02d}" for i in range(10)]
    assert dp.compare_by_year(with_query(spark, states, "compare by year")).count() == 1
    crops = [("a", 2001, c, 1.0, 1.0, 1.0) for c in ("x", "y")]
    assert dp.compare_by_crop(with_query(spark, crops, "compare")).count() == 2


def test_only_fifty_rows_are_compared(spark):
    rows = [("a", 2001, "x", 1.0, 1.0, 1.0)] * 50 + [("b", 2002, "y", 1.0, 1.0, 1.0)]
    got = dp.comparison_groups(with_query(spark, rows, "compare")).collect()
    assert [(r.mode, r.key, r.n_points) for r in got] == [("none", None, 51)]


def test_extremes(spark):
    rows = by_year((2001, 0.0), (2002, 7.0), (2003, 7.0), (2004, 3.0), (2005, None), (2006, 3.0))
    assert dp.extreme_max(points(spark, rows)).collect()[0].year == 2002
    assert dp.extreme_min(points(spark, rows)).collect()[0].year == 2004


def test_first_per_group(spark):
    rows = [("a", 2001, "x", 1.0, 1.0, 1.0), ("a", 2001, "x", 2.0, 1.0, 1.0)] + [
        ("b", 2000 + i, "x", 9.0, 1.0, 1.0) for i in range(7)]
    got = dp.first_per_group(points(spark, rows)).orderBy("place").collect()
    assert [(r.place, r.state, r.year, r.production) for r in got] == [
        (1, "a", 2001, 1.0), (2, "b", 2000, 9.0), (3, "b", 2001, 9.0), (4, "b", 2002, 9.0), (5, "b", 2003, 9.0)]


def test_correlation_needs_ten_pairs(spark):
    nine = [("a", 2001, "x", 1.0, float(i), float(i)) for i in range(9)] + [("a", 2001, "x", 1.0, None, 1.0)]
    assert dp.question_corr(points(spark, nine)).collect()[0].band == "limited"
    ten = nine + [("a", 2001, "x", 1.0, 9.0, 9.0)]
    row = dp.question_corr(points(spark, ten)).collect()[0]
    assert (row.band, row.n_pairs, round(row.correlation, 9)) == ("positive", 10, 1.0)


# ---------------------------------------------------------------------- texts

def test_specific_text(spark):
    rows = [("Kerala", 2015, "Rice", 1234.5, 2.5, None), ("Kerala", None, "Rice", None, None, None)]
    assert answer(an.answer_specific(with_query(spark, rows, "what is"))) == (
        "**Kerala** | (District: D) | - Year 2015 | - Crop: Rice\n"
        "  Production: **1,234.50 tonnes** | Yield: **2.50 tonnes/hectare**\n"
        "\n"
        "**Kerala** | (District: D) | - Crop: Rice\n"
    )


def test_comparison_text(spark):
    rows = [("Kerala", 2015, "Rice", 1000.0, 2.0, 10.0), ("Kerala", 2014, "Rice", None, None, None)]
    assert answer(an.answer_comparison(with_query(spark, rows, "compare"))) == (
        "**Comparison Analysis:**\n\n*Year-wise Comparison:*\n"
        "  **2014**: Avg Production: 0.0 tonnes | Avg Yield: 0.00 t/ha | Avg Rainfall: 0.0 mm\n"
        "  **2015**: Avg Production: 1,000.0 tonnes | Avg Yield: 2.00 t/ha | Avg Rainfall: 10.0 mm"
    )
    assert answer(an.answer_comparison(with_query(spark, rows[:1], "compare"))) == an.LIMITED_COMPARISON
    same = [("Kerala", 2015, "Rice", 1.0, 1.0, 1.0)] * 2
    assert answer(an.answer_comparison(with_query(spark, same, "compare"))) == "**Comparison Analysis:**\n"


def test_trend_text(spark):
    rows = by_year((2001, 10.0), (2002, 15.0), (2003, 0.0))
    assert answer(an.answer_trend(with_query(spark, rows, "trend"))) == (
        "**Trend Analysis:**\n\n*Year-wise Data:*\n"
        "  **2001** | Production: 10.0 tonnes\n  **2002** | Production: 15.0 tonnes\n  **2003**\n"
        "\n*Production Trend: increasing by 50.0% from 2001 to 2002*"
    )
    one_year = by_year((2001, 10.0), (2001, 20.0))
    assert answer(an.answer_trend(with_query(spark, one_year, "trend"))).startswith("**Summary of Available Data:**\n")
    assert answer(an.answer_trend(with_query(spark, one_year[:1], "trend"))) == an.LIMITED_TREND


def test_extreme_text(spark):
    rows = [("Kerala", 2001, "Rice", 1234.5, 0.0, 7.0), ("Bihar", 2002, "Rice", 3.0, 1.0, 1.0)]
    assert answer(an.answer_extreme(with_query(spark, rows, "Highest and lowest"))) == (
        "**Highest Production:**\n  State: Kerala\n  District: D\n  Crop: Rice\n  Year: 2001\n"
        "  Production: **1,234.50 tonnes**\n  Rainfall: 7.0 mm"
    )
    assert answer(an.answer_extreme(with_query(spark, rows, "lowest"))) == (
        "**Lowest Production:**\n  State: Bihar\n  District: D\n  Crop: Rice\n  Year: 2002\n  Production: **3.00 tonnes**"
    )
    assert answer(an.answer_extreme(with_query(spark, rows, "best"))) == an.NO_EXTREME
    nothing = [("Kerala", 2001, "Rice", 0.0, 1.0, 1.0)]
    assert answer(an.answer_extreme(with_query(spark, nothing, "lowest"))) == an.NO_EXTREME


def test_relationship_text(spark):
    rows = [("a", 2001, "x", 1.0, float(-i), float(i)) for i in range(10)]
    assert answer(an.answer_relationship(points(spark, rows))) == (
        "**Rainfall vs Crop Yield Relationship Analysis:**\n\n*Correlation Coefficient: -1.000*\n"
        + an.RELATIONSHIP_BANDS["negative"] + "\n\n*Average Values:*\n  - Average Rainfall: 4.5 mm\n"
        "  - Average Yield: -4.50 tonnes/hectare"
    )
    flat = [("a", 2001, "x", 1.0, 2.0, float(i)) for i in range(10)]
    assert "Correlation" not in answer(an.answer_relationship(points(spark, flat)))


def test_summary_text(spark):
    rows = [("Kerala", 2001, "Rice", 1000.0, None, 1.0), (None, None, None, 3000.0, None, None)]
    assert answer(an.answer_summary(with_query(spark, rows, "x"))) == (
        "**Summary of Available Data:**\n\n*Production Statistics:*\n  - Average: 2,000.0 tonnes\n"
        "  - Maximum: 3,000.0 tonnes\n  - Minimum: 1,000.0 tonnes\n\n*Rainfall Statistics:*\n  - Average: 1.0 mm\n"
        "  - Maximum: 1.0 mm\n  - Minimum: 1.0 mm\n\n*Sample Records (2 of 2):*\n  - Kerala (2001) - Rice"
    )


# ---------------------------------------------------------------------- batch

def hits(spark, rows):
    """rows: (question_id, rank, metadata or None)."""
    schema = f"question_id int, rank int, id string, text string, metadata {DOCUMENT['metadata'].dataType.simpleString()}, similarity_score double"
    return spark.createDataFrame([(q, r, f"d{r}", f"text {r}", m, 1.0 / r) for q, r, m in rows], schema)


def meta(state="Kerala", year=2001, crop="Rice", production=1.0):
    return (state, "D", year, crop, production, 2.0, 3.0, "src", "now")


def questions(spark, texts):
    return spark.createDataFrame([(i, t, 5, 0.7) for i, t in texts.items()],
                                 "question_id int, query string, top_k int, temperature double")


def test_answers_of_every_kind(spark):
    texts = {
        1: "What is it", 2: "Compare all", 3: "Trend of rice", 4: "Trend", 5: "Trend", 6: "Highest", 7: "Impact",
        8: "Rice", 9: "Nothing retrieved", 10: "Compare without metadata",
    }
    rows = [(q, r, meta(year=2000 + r)) for q in (1, 2, 3, 6, 7, 8) for r in (1, 2)]
    rows += [(4, 1, meta()), (4, 2, meta()), (5, 1, meta()), (10, 1, None)]
    got = {r.question_id: r for r in an.answer_hits(questions(spark, texts), hits(spark, rows)).collect()}
    note = "\n\n\n*Based on {} relevant records from the agricultural and climate database.*"
    assert len(got) == len(texts)
    assert got[1].answer.startswith("**Kerala** | ") and got[1].answer.endswith(note.format(2))
    assert got[2].answer.startswith("**Comparison Analysis:**")
    assert got[3].answer.startswith("**Trend Analysis:**")
    assert got[4].answer.startswith("**Summary of Available Data:**")
    assert got[5].answer == an.LIMITED_TREND + note.format(1)
    assert got[6].answer.startswith("**Highest Production:**")
    assert got[7].answer == an.LIMITED_RELATIONSHIP + note.format(2)
    assert got[8].answer.startswith("**Summary of Available Data:**")
    assert (got[9].answer, got[9].num_sources, got[9].sources) == (an.NO_DOCUMENTS, 0, None)
    assert got[10].answer == an.NO_DATA["comparison"] + note.format(1)
    assert [s.text for s in got[1].sources] == ["text 1", "text 2"]


def test_relationship_ignores_the_question_filter(spark):
    rows = [(1, r, meta(state=f"s{r}", production=float(r))) for r in range(1, 12)]
    asked = questions(spark, {1: "impact in punjab"})
    planned = an.planned_points(asked, hits(spark, rows))
    assert planned.count() == 11


def test_context_and_prompt(spark):
    asked = questions(spark, {1: "Q?", 2: "empty"})
    contexts = an.context_text(hits(spark, [(1, 2, None), (1, 1, meta())]))
    expected = (
        "=== RELEVANT DATA CONTEXT ===\n\n[Document 1]\nText: text 1\n"
        "Details: State: Kerala, District: D, Year: 2001, Crop: Rice\n\n[Document 2]\nText: text 2\n\n=== END CONTEXT ===\n"
    )
    assert contexts.collect()[0].context == expected
    prompts = {r.question_id: r.prompt for r in an.prompt_text(asked, contexts).collect()}
    assert f"CONTEXT DATA:\n{expected}\n\nUSER QUESTION:\nQ?\n\nINSTRUCTIONS:" in prompts[1]
    assert "=== RELEVANT DATA CONTEXT ===\n\n=== END CONTEXT ===\n" in prompts[2]


def test_batch_end_to_end(spark):
    rows = [(s, "D", y, c, float(100 * i + 1), 2.0, 3.0) for i, (s, y, c) in enumerate(
        (s, y, c) for s in ("Punjab", "Bihar") for y in (2001, 2002, 2003) for c in ("Rice", "Wheat"))]
    docs = build_documents(spark.createDataFrame(rows, FACTS), "t")
    encoder = HashingEncoder.fit(docs, dim=64)
    vectors = embed(docs, "text", encoder)
    asked = spark.createDataFrame(
        [(1, "Compare Wheat in Punjab", 6, None), (2, "Compare Wheat in Punjab", 6, None), (3, "Bihar Rice", None, 0.2)],
        "question_id bigint, query string, top_k int, temperature double")
    table = an.answer_batch(asked, vectors, encoder)
    first = table.collect()
    got = {r.query: r for r in first}
    assert sorted(r.question_id for r in first) == [1, 2, 3]
    assert len({(r.query, r.answer) for r in first}) == 2
    assert got["Compare Wheat in Punjab"].num_sources == 6 and got["Bihar Rice"].num_sources == 5
    assert "Year-wise" in got["Compare Wheat in Punjab"].answer
    assert [s.metadata.state for s in got["Bihar Rice"].sources][0] == "Bihar"
    known = spark.createDataFrame([r.asDict(recursive=True) for r in first], table.schema)
    marked = known.withColumn("answer", F.concat(F.lit("kept: "), "answer"))
    more = asked.union(spark.createDataFrame([(4, None, 2, 0.5)], asked.schema))
    again = {r.question_id: r.answer for r in an.answer_batch(more, vectors, encoder, marked).collect()}
    assert set(again) == {1, 2, 3, 4} and all(again[i].startswith("kept: ") for i in (1, 2, 3))
    assert again[4] is not None and not again[4].startswith("kept")
    log = an.log_queries(spark.createDataFrame([("q", "a" * 150)], "query string, answer string"), "2026-01-01")
    assert log.collect()[0].answer_preview == "a" * 100 + "..."
    assert an.recent_history(log).count() == 1


def test_chart_series(spark):
    rows = [(1, 1, meta(production=1.0)), (1, 2, meta(production=3.0)), (1, 3, meta(year=None)), (2, 1, meta())]
    got = an.chart_series(questions(spark, {1: "Show rice", 2: "rice"}), hits(spark, rows)).collect()
    assert [(r.question_id, r.Year, r.avg_production) for r in got] == [(1, 2001, 2.0)]


# ------------------------------------------------------------------- rainfall

RAIN = [(s, y, v) for s, vs in (("Kerala", (3100.0, 2950.0, 3200.0)), ("Tamil Nadu", (950.0, 980.0, 1050.0)))
        for y, v in zip((2019, 2020, 2021), vs)]


def test_compare_rainfall(spark):
    rain = spark.createDataFrame(RAIN, "state string, year int, annual_rainfall double")
    got = {r.state: round(r.avg_annual_rainfall, 2) for r in rainfall.compare_rainfall(rain, ["Kerala", "Tamil Nadu"], 3).collect()}
    assert got == {"Kerala": 3083.33, "Tamil Nadu": 993.33}
    got = {r.state: r.avg_annual_rainfall for r in rainfall.compare_rainfall(rain, ["Kerala"], [2019, 2020]).collect()}
    assert got == {"Kerala": 3025.0}


def test_answer_parsed(spark):
    rain = spark.createDataFrame(RAIN, "state string, year int, annual_rainfall double")
    schema = "question_id int, type string, entities struct<states: array<string>, crops: array<string>, years: array<int>, numbers: array<int>>"
    parsed = spark.createDataFrame([
        (1, "compare_rainfall", (["Tamil Nadu", "Kerala"], [], [], [3])),
        (2, "compare_rainfall", (["Kerala"], [], [], [])),
        (3, "top_crops", (["Kerala", "Tamil Nadu"], [], [], [])),
        (4, "compare_rainfall", (["Kerala", "Goa"], [], [], [])),
    ], schema)
    got = {r.question_id: r.answer for r in rainfall.answer_parsed(parsed, rain).collect()}
    assert got[1] == ("From 2019 to 2021, Kerala had an average annual rainfall of 3083.33 mm, "
                      "while Tamil Nadu had 993.33 mm.")
    assert got[2] == got[4] == rainfall.NEED_TWO_STATES and got[3] == rainfall.NOT_SUPPORTED
