"""What the physical plans must and must not contain."""

import pytest
from pyspark.sql import functions as F

from agroclime.operators import eda, explore
from agroclime.operators.questions import question_terms
from agroclime.operators import datapoints as dp
from agroclime.plans import bindings as b
from agroclime.plans.catalog import QUERIES
from agroclime.sources import readers, writers
from agroclime.sources.scratch import scratch_path

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark):
    path = scratch_path(spark, "facts")
    writers.write_facts(b.facts(spark, SF), path)
    return readers.read_facts(spark, path)


def test_rainfall_is_broadcast_by_size(spark):
    text = plan(b.facts(spark, SF))
    assert "BroadcastHashJoin [subdivision" in text and "CartesianProduct" not in text
    assert "BroadcastNestedLoopJoin" not in text


def test_filters_and_columns_reach_the_scan(spark, stored):
    text = plan(eda.grouped_means(explore.explore(stored, crops=["PROMO", "SMALL"]), ["state"], {"yield": "m"}))
    assert "In(crop, [PROMO,SMALL])" in text
    assert "ReadSchema: struct<state:string,crop:string,yield:double>" in text


def test_one_scan_for_the_top_crop_trend(spark, stored):
    text = plan(eda.crop_year_yield(stored))
    assert text.count("FileScan") == 1 and "TakeOrderedAndProject" in text


def test_hits_are_cut_before_the_shuffle(spark, stored):
    text = plan(b.hits(stored))
    shuffle = text.index("Exchange hashpartitioning(question_id")
    assert text.count("WindowGroupLimit") == 2 and text.rindex("WindowGroupLimit") > shuffle


def test_only_rows_that_can_win_are_paired_with_their_question(spark):
    """A question's bar leaves its best rows, or all it has, and keeps the rest from being sorted for it."""
    ready = spark.range(20_000).selectExpr(
        "'S' as state", "'D' as district", "if(id < 19990, 'big', 'small') as crop", "if(id < 19990, 1999, 2000) as year", "cast(conv(substr(sha1(cast(id as string)), 1, 8), 16, 10) as double) / 4294967296D as score",
    ).withColumn("level", b._nearness(F.col("score")))
    asked = b._asked(ready).select("crop", F.explode("asked").alias("a")).select("crop", "a.*").collect()
    assert len(asked) == 2 * len(b.FAMILIES)
    rows = ready.select("crop", "level", "score").collect()
    for a in asked:
        family_rows = [r for r in rows if r.crop == a.crop]
        passed = [r.score for r in family_rows if r.level <= a.bar]
        assert len(passed) >= min(b.HITS_PER_QUESTION, len(family_rows)) and len(passed) < 400
        best = sorted((r.score for r in family_rows), reverse=True)[:b.HITS_PER_QUESTION]
        assert a.crop == "small" or sorted(passed, reverse=True)[:b.HITS_PER_QUESTION] == best


def test_one_shuffle_serves_the_data_point_chain(spark, stored):
    hits = b.as_table(b.hits(stored), "hits")
    terms = b.as_table(question_terms(b.questions(stored)), "terms")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(dp.trend_by_year(dp.filter_by_question(dp.data_points(hits), terms)))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert text.count("Exchange hashpartitioning") == 2  # the points once, the terms once


@pytest.mark.parametrize("name", ["similarity_topk", "answer_sources", "chart_series", "restrict_to_top"])
def test_no_cross_joins(spark, name):
    text = plan(QUERIES[name](spark, SF))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_results_do_not_depend_on_partitions(spark):
    def rows():
        return sorted(map(tuple, QUERIES["answer_summary"](spark, SF).collect()))

    first = rows()
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        assert rows() == first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_literal_dimension_does_not_shuffle_the_facts(spark):
    from agroclime.operators import clean

    spark.range(200_000).selectExpr("concat('S', id % 40) as state", "id").write.mode("overwrite").parquet(path := scratch_path(spark, "states"))
    plan = clean.map_subdivision(spark.read.parquet(path), clean.subdivision_dim(spark))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan
