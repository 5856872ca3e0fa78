"""Term index against plain search, mergeable states against the facts, running rainfall sums against the range."""

import random

from pyspark.sql import functions as F

from agroclime.operators import matching, rainfall, states
from agroclime.sources.schemas import FACTS


def test_terms_are_those_of_plain_search(spark):
    r = random.Random(3)
    alphabet = "abcé日\n "
    word = lambda low, high: "".join(r.choice(alphabet) for _ in range(r.randint(low, high)))
    terms = [word(1, 9) for _ in range(400)] + ["abcabcabc", "", None, "zz"]
    texts = [(i, word(0, 60)) for i in range(200)] + [(900, None), (901, ""), (902, "abcabcabc" * 3)]
    numbered = spark.createDataFrame(list(enumerate(terms)), "position long, term string").repartition(3)
    found = matching.find_terms(spark.createDataFrame(texts, "k long, t string"), matching.term_index(numbered), "k", "t")
    place = {}
    for i, t in enumerate(terms):
        if t:
            place.setdefault(t, i)
    want = {k: sorted((place[t], t) for t in place if t in x) for k, x in texts if x}
    want = {k: v for k, v in want.items() if v}
    assert {r.id: r.terms for r in matching.all_terms(found).collect()} == {k: [t for _, t in v] for k, v in want.items()}
    assert {r.id: r.term for r in matching.first_terms(found).collect()} == {k: v[0][1] for k, v in want.items()}
    assert found.count() == sum(map(len, want.values()))


def test_texts_are_not_shuffled_for_a_vocabulary_that_tasks_can_hold(spark, monkeypatch):
    """Both ways find the same terms, short ones at the very end of a text too; only the large one's moves texts."""
    texts = spark.createDataFrame([(1, "plain rice"), (2, "ri"), (3, ""), (4, "the price is éa"), (5, "x" * 3000 + "rice")], "k int, t string").repartition(3)
    terms = [(i, t) for i, t in enumerate(["rice", "price", "ri", "e", "éa", "a", "plain rice", "xxxxxx", "nothing"])]
    index = matching.term_index(spark.createDataFrame(terms, "position int, term string"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        sent = matching.find_terms(texts, index, "k", "t")
        text = sent._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in text and "Exchange hashpartitioning" not in text
        got = sorted(map(tuple, sent.collect()))
        monkeypatch.setattr(matching, "SENT_TERMS", 0)
        joined = matching.find_terms(texts, index, "k", "t")
        assert "SortMergeJoin" in joined._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(tuple, joined.collect())) == got
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == sorted((r.k, t, i) for r in texts.collect() for i, t in terms if t in r.t)


def test_repeated_and_null_ids_are_found_alike_both_ways(spark, monkeypatch):
    texts = spark.createDataFrame([(1, "rice"), (1, "rice"), (2, "rice and tea"), (2, "tea"), (None, "rice"), (3, "price"), (4, None)], "k int, t string").repartition(3)
    index = matching.term_index(spark.createDataFrame([(0, "rice"), (1, "tea"), (2, "rice and")], "position int, term string"))
    sent = sorted(map(tuple, matching.find_terms(texts, index, "k", "t").collect()))
    monkeypatch.setattr(matching, "SENT_TERMS", 0)
    assert sent == sorted(map(tuple, matching.find_terms(texts, index, "k", "t").collect()))
    assert (3, "rice", 0) in sent and all(r[0] is not None for r in sent)


def test_a_hundred_thousand_terms(spark):
    """Every question meets only the few terms whose rarest gram it holds; the vocabulary is not gathered."""
    terms = spark.range(100_000).select(F.format_string("crop %06d", "id").alias("term"), F.col("id").alias("position"))
    index = matching.term_index(terms)
    asked = spark.range(0, 100_000, 500).select("id", F.format_string("how much crop %06d and crop 000007 did we grow?", "id").alias("q"))
    found = matching.find_terms(asked, index, "id", "q")
    assert "ScalarSubquery" not in found._jdf.queryExecution().toString()
    got = {r.id: r.terms for r in matching.all_terms(found).collect()}
    assert got == {i: sorted({f"crop {i:06d}", "crop 000007"}) for i in range(0, 100_000, 500)}


def test_empty_vocabularies_and_texts(spark):
    none = matching.term_index(spark.createDataFrame([], "term string, position long"))
    texts = spark.createDataFrame([(1, "abc")], "k long, t string")
    assert matching.find_terms(texts, none, "k", "t").count() == 0
    some = matching.term_index(spark.createDataFrame([("b", 1)], "term string, position long"))
    assert matching.find_terms(texts.where("false"), some, "k", "t").count() == 0


def facts(spark, seed, n):
    r = random.Random(seed)
    value = lambda: r.choice([None, float("nan"), round(r.uniform(0, 1000), 2)])
    rows = [(r.choice("AB"), f"D{r.randint(0, 300)}", r.choice([2001, 2002, None]), r.choice(["Rice", "Tea"]), value(), round(r.uniform(0, 9), 3), value()) for _ in range(n)]
    return spark.createDataFrame(rows, FACTS).repartition(3)


def test_states_merge_to_the_measures_of_all_facts(spark, tmp_path):
    one, two, root = facts(spark, 1, 3000), facts(spark, 2, 4000), str(tmp_path / "states")
    assert states.append_states(one, root, "a") and states.append_states(two, root, "b") and not states.append_states(two, root, "b")
    table = states.read_states(spark, root)
    assert table.count() <= 2 * 12
    every = one.unionAll(two)
    for wanted, crops, years in (((), (), ()), (["A"], ["Tea"], [2002]), (["none"], (), ())):
        got = states.merged_metrics(table, wanted, crops, years).first()
        chosen = states.explore(every, wanted, crops, years)
        rows = chosen.collect()
        assert got.total_records == len(rows) and got.states == len({r.state for r in rows})
        for m in ("production", "yield", "annual_rainfall"):
            values = [r[m] for r in rows if r[m] is not None and r[m] == r[m]]
            assert got[f"n_{m}"] == len(values)
            if values:
                assert abs(got[f"avg_{m}"] - sum(values) / len(values)) < 1e-7 and got[f"min_{m}"] == min(values) and got[f"max_{m}"] == max(values)
                for name, q in (("q1", 0.25), ("median", 0.5), ("q3", 0.75)):
                    v = got[f"{name}_{m}"]
                    assert sum(x < v for x in values) / len(values) - states.RANK_ERROR <= q <= sum(x <= v for x in values) / len(values) + states.RANK_ERROR
            else:
                assert got[f"avg_{m}"] is None and got[f"q1_{m}"] is None
        exact = len({r.district for r in rows})
        assert abs((got.approx_districts or 0) - exact) <= states.DISTINCT_ERROR * exact + 1


def test_rainfall_ranges_are_differences_of_running_sums(spark):
    rain = spark.createDataFrame(
        [(s, y, v) for s, rows in {"A": [(2000, 1.1), (2002, 2.2), (2002, 4.4), (2005, None), (2006, 0.3)], "B": [(1999, 7.0), (2006, 9.5)], "C": [(1980, 1.0)]}.items() for y, v in rows],
        "state string, year int, annual_rainfall double")
    rows = [(i, "compare_rainfall", s, n) for i, (s, n) in enumerate([(["A", "B"], 5), (["A", "B"], 2), (["B", "A"], 100), (["A", "C"], 5), (["A", "A"], 5), (["A", "B"], 0)])]
    parsed = spark.createDataFrame([(i, t, (s, [n])) for i, t, s, n in rows], "question_id long, type string, entities struct<states:array<string>,numbers:array<int>>")
    said = {r.question_id: r.answer for r in rainfall.answer_parsed(parsed, rain).collect()}
    assert said[0] == "From 2002 to 2006, A had an average annual rainfall of 2.30 mm, while B had 9.50 mm."
    assert said[2] == "From 1907 to 2006, A had an average annual rainfall of 2.00 mm, while B had 8.25 mm."
    assert said[1].endswith("A had an average annual rainfall of 0.30 mm, while B had 9.50 mm.")
    assert said[3] == said[4] == said[5] == rainfall.NEED_TWO_STATES
    plan = rainfall.answer_parsed(parsed, rain)._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Join" in line and ("<=" in line or ">=" in line)]
