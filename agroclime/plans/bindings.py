"""The library's tables derived from the star-schema test tables.

Orders placed by customers of a nation play the harvests of a state, their
average value by region and year plays the rainfall of a subdivision.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from agroclime.operators.clean import clean_rain, flag_documentable, kept, rename_rain
from agroclime.operators.corpus import build_documents, document_id
from agroclime.operators.datapoints import data_points, filter_by_question
from agroclime.operators.facts import build_facts
from agroclime.operators.questions import question_terms
from agroclime.sources.scratch import as_table

CREATED_AT = "2026-01-01T00:00:00+00:00"
ROW_KEY = ("l_orderkey", "l_linenumber", "l_partkey")
HITS_PER_QUESTION = 60


# The columns in use. A stated schema spares a footer-reading job per table.
TABLES = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "part": "p_partkey bigint, p_name string, p_type string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_returnflag string, l_linestatus string",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{sf_dir}/{name}.parquet")


def _states(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        "n_nationkey", F.col("n_name").alias("state"), F.col("r_name").alias("subdivision")
    )


def subdivisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(state, subdivision): nation -> region."""
    return _states(spark, sf_dir).select("state", "subdivision")


def _placed_orders(spark: SparkSession, sf_dir: str, places: DataFrame) -> DataFrame:
    """Orders with their customer and the customer's nation."""
    return (
        table(spark, sf_dir, "orders")
        .join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(places, F.col("c_nationkey") == F.col("n_nationkey"))
    )


def rain_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SUBDIVISION, YEAR, ANNUAL and the four seasons."""
    season = F.quarter("o_orderdate")
    placed = _placed_orders(spark, sf_dir, _states(spark, sf_dir))
    return placed.groupBy(
        F.col("subdivision").alias("SUBDIVISION"), F.year("o_orderdate").cast("string").alias("YEAR")
    ).agg(
        F.round(F.avg("o_totalprice"), 2).alias("ANNUAL"),
        *[
            F.round(F.avg(F.when(season == i, F.col("o_totalprice"))), 2).alias(name)
            for i, name in enumerate(("JF", "MAM", "JJAS", "OND"), 1)
        ],
    )


def crop_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """state, district, crop, year text, area, production, yield, and the row key."""
    orders = _placed_orders(spark, sf_dir, table(spark, sf_dir, "nation")).select(
        "o_orderkey",
        F.col("n_name").alias("state"),
        F.col("c_mktsegment").alias("district"),
        F.year("o_orderdate").alias("y"),
    )
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_type").alias("crop"))
    return (
        table(spark, sf_dir, "lineitem")
        # Two large tables: shuffled at any size. Left alone, Spark would collect the
        # line items on the driver for a broadcast while they are still small.
        .join(orders.hint("merge"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(part, F.col("l_partkey") == F.col("p_partkey"))
        .select(
            "state",
            "district",
            "crop",
            F.concat(F.col("y").cast("string"), F.lit("-"),
                     F.lpad(((F.col("y") + 1) % 100).cast("string"), 2, "0")).alias("year"),
            F.col("l_quantity").cast("double").alias("area"),
            F.col("l_extendedprice").alias("production"),
            (F.col("l_extendedprice") / F.col("l_quantity")).alias("yield"),
            *ROW_KEY,
        )
    )


def rain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cleaned rainfall table, stored once.

    Read back as a file it has a known, tiny size, so Spark's own size check turns
    the join with the facts into a broadcast and the facts are not shuffled on a
    handful of (subdivision, year) keys.
    """
    return as_table(clean_rain(rename_rain(rain_raw(spark, sf_dir))), "rain")


def state_rain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(state, year, annual_rainfall): the mean order value per nation and year."""
    return _placed_orders(spark, sf_dir, table(spark, sf_dir, "nation")).groupBy(
        F.col("n_name").alias("state"), F.year("o_orderdate").alias("year")
    ).agg(F.round(F.avg("o_totalprice"), 2).alias("annual_rainfall"))


def facts(spark: SparkSession, sf_dir: str, extra: tuple[str, ...] = ()) -> DataFrame:
    return build_facts(crop_raw(spark, sf_dir), rain(spark, sf_dir), subdivisions(spark, sf_dir), extra)


def stored_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The facts written once, for queries that read them more than once."""
    return as_table(facts(spark, sf_dir), "facts")


def documents(facts_table: DataFrame) -> DataFrame:
    return build_documents(facts_table, CREATED_AT)


# ----------------------------------------------------------------- questions
# Questions come from the key combinations that occur in the facts. Each family is
# a set of key columns with its question templates; a fact belongs to one question
# of every family, so pairing facts with questions never multiplies beyond four.

FAMILIES = {
    "state-year": (("state", "year"), [
        "What is the output in {state} in {year}?",
        "Compare crops in {state}",
        "Which crop has the highest production in {state}",
        "What was grown in {state}?",
        "Lowest production in {state}",
        "Overview of {state} for {year}",
    ]),
    "district-crop": (("district", "crop"), [
        "Show the production trend of {crop}",
        "Compare {crop} by year in district {district}",
        "Correlation between rainfall and yield for {crop}",
        "Best and worst {crop} districts",
    ]),
    "district-crop-year": (("district", "crop", "year"), [
        "Compare {crop} production in all states",
        "Relationship of rainfall and {crop} yield",
        "{crop} from {year} to the next season",
        "Trend of {crop} over time",
    ]),
    "state-crop": (("state", "crop"), [
        "How did {crop} in {state} change over time?",
        "How much {crop} did {state} grow in 1999?",
        "Summary of {crop} in {state}",
        "Impact of rain on {crop} in {state}",
        "Compare {crop} in {state}",
        "{crop} in NATION_0 for 1998",
    ]),
}


def question_key(family: str, col) -> Column:
    keys, _ = FAMILIES[family]
    return F.concat_ws("|", F.lit(family), *[col(k).cast("string") for k in keys])


def question_id(key: Column) -> Column:
    return F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("bigint")


def _question_text(qid: Column, family: str) -> Column:
    keys, templates = FAMILIES[family]

    def filled(template: str) -> Column:
        text = F.lit(template)
        for k in keys:
            text = F.replace(text, F.lit("{" + k + "}"), F.col(k).cast("string"))
        return text

    return F.element_at(F.array(*[filled(t) for t in templates]), (qid % len(templates)).cast("int") + 1)


def questions(facts_table: DataFrame) -> DataFrame:
    """(question_id, query, top_k, temperature)."""
    combos = facts_table.select(
        "state", "district", "crop", F.col("year_cleaned").alias("year")
    ).distinct()
    asked = combos.select(F.explode(F.array(*[
        F.struct(
            question_key(f, F.col).alias("key"),
            _question_text(question_id(question_key(f, F.col)), f).alias("query"),
        ) for f in FAMILIES
    ])).alias("q")).select("q.*").distinct()
    return asked.select(
        question_id(F.col("key")).alias("question_id"),
        "query",
        F.lit(HITS_PER_QUESTION).alias("top_k"),
        F.lit(0.7).alias("temperature"),
    )


def state_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: the state names in key order."""
    ordered = F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name")))
    return table(spark, sf_dir, "nation").agg(F.transform(ordered, lambda n: n["n_name"]).alias("words"))


def term_vocabularies(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Lower-case states in key order, lower-case crops in name order."""
    states = state_words(spark, sf_dir).select(F.transform("words", F.lower).alias("words"))
    crops = table(spark, sf_dir, "part").agg(F.array_sort(F.collect_set(F.lower("p_type"))).alias("words"))
    return states, crops


def _nearness(score: Column) -> Column:
    """0 for the best scores, then one more for each doubling of the distance to 1, up to 32: never falls as scores fall."""
    return F.floor(F.log2((F.lit(1.0) - score) * F.lit(4294967296.0))).cast("int")


def _asked(ready: DataFrame) -> DataFrame:
    """(state, district, crop, year, asked): the questions of each key combination, and the ``bar`` of each.

    At or below its bar a question has at least HITS_PER_QUESTION rows, or all of its rows. Rows are counted by key
    combination and level before any shuffle, and only those counts are exploded over the questions.
    """
    keys = ["state", "district", "crop", "year"]
    counted = as_table(ready.groupBy(*keys, "level").agg(F.count("*").alias("n")), "levels")
    asking = F.explode(F.array(*[question_id(question_key(f, F.col)) for f in FAMILIES])).alias("question_id")
    held = counted.select("level", "n", asking).groupBy("question_id", "level").agg(F.sum("n").alias("n"))
    so_far = F.sum("n").over(Window.partitionBy("question_id").orderBy("level"))
    bars = held.withColumn("so_far", so_far).groupBy("question_id").agg(F.coalesce(
        F.min(F.when(F.col("so_far") >= HITS_PER_QUESTION, F.col("level"))), F.max("level")).alias("bar"))
    combos = counted.select(*keys).distinct().select(*keys, asking).join(bars, "question_id")
    return as_table(combos.groupBy(*keys).agg(F.collect_list(F.struct("question_id", "bar")).alias("asked")), "asked")


def hits(facts_table: DataFrame) -> DataFrame:
    """The top documents of every question, scored by a digest instead of a model.

    The score is exact in any engine, which an embedding's is not. The facts are read twice (give a stored table): once
    to count rows by level of score, then only rows that can be among a question's best are paired with it and sorted.
    """
    ready = kept(flag_documentable(facts_table)).withColumn("id", document_id(
        F.col("state"), F.col("district"), F.col("crop"), F.col("year_cleaned"), F.col("production")
    )).withColumn("year", F.col("year_cleaned")).withColumn(
        "similarity_score", F.conv(F.substring("id", 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    ).withColumn("level", _nearness(F.col("similarity_score")))
    near = ready.join(_asked(ready), ["state", "district", "crop", "year"])
    keyed = near.withColumn("question", F.explode(F.filter("asked", lambda a: a["bar"] >= F.col("level")))).select(
        *[c for c in ready.columns if c != "level"], "question.question_id")
    order = Window.partitionBy("question_id").orderBy(F.desc("similarity_score"), "id", "yield", "annual_rainfall")
    best = keyed.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= HITS_PER_QUESTION)
    # Sentences are written for the winners only.
    return build_documents(best, CREATED_AT, ("question_id", "rank", "similarity_score")).select(
        "question_id", "rank", "id", "text", "metadata", "similarity_score"
    )


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filtered data points of every question."""
    base = stored_facts(spark, sf_dir)
    terms = question_terms(questions(base), *term_vocabularies(spark, sf_dir))
    return filter_by_question(data_points(hits(base)), terms)


def parser_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-state rainfall questions and others, one per (state, year) with rainfall."""
    base = state_rain(spark, sf_dir)
    nation = table(spark, sf_dir, "nation")
    neighbour = nation.alias("b").select(
        (F.col("n_nationkey") - 1).alias("before"), F.col("n_name").alias("other")
    )
    pairs = nation.join(neighbour, F.col("n_nationkey") == F.col("before"), "left").select(
        F.col("n_name").alias("state"), "other"
    )
    numbered = base.join(pairs, "state").withColumn("key", F.concat_ws("|", "state", F.col("year").cast("string")))
    n = (F.col("year") % 4 + 2).cast("string")
    text = (
        F.when(F.col("other").isNotNull() & (F.col("year") % 2 == 0), F.concat(
            F.lit("Compare the average annual rainfall in "), F.col("state"), F.lit(" and "), F.col("other"),
            F.lit(" for the last "), n, F.lit(" seasons."),
        ))
        .when(F.col("year") % 3 == 0, F.concat(F.lit("Most produced rice and tea in "), F.col("state")))
        .when(F.col("year") % 3 == 1, F.concat(
            F.lit("Show growth of maize in "), F.col("state"), F.lit(" since "), F.col("year").cast("string")))
        .otherwise(F.concat(F.lit("Hello "), F.col("state")))
    )
    return numbered.select(
        question_id(F.col("key")).alias("question_id"), text.alias("query"), F.lit(5).alias("top_k"),
        F.lit(0.7).alias("temperature"),
    )
