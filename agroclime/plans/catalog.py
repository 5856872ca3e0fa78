"""Every registered query: name -> function of (session, table folder).

Results are made plain for comparison: whole numbers as BIGINT, decimals rounded,
nested values flattened.
"""

from __future__ import annotations

import sys
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from agroclime.functions.keywords import STATE_SUBDIVISION
from agroclime.functions.numbers import year_number
from agroclime.operators import answers as an
from agroclime.operators import clean, corpus, eda, explore, matching, rainfall, states, vector_index, vector_store, vectors
from agroclime.operators import datapoints as dp
from agroclime.operators import questions as qs
from agroclime.operators.facts import build_facts, duplicate_rain_keys, join_rainfall
from agroclime.plans import bindings as b
from agroclime.sources import readers, writers
from agroclime.sources.schemas import FACTS as SCHEMA_OF_FACTS
from agroclime.sources.scratch import as_table, release, scratch_path

# The code of this module travels with the tasks, so workers need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

MEASURES = ["production", "yield", "annual_rainfall"]
FACTS = list(clean.FACT_COLUMNS)


# Stored values and their extremes are the same bits in any engine and stay as they
# are; only computed decimals are rounded.
STORED = {
    f"{prefix}{name}" for prefix in ("", "min_", "max_")
    for name in (*MEASURES, "rainfall", "area", "Production", "Yield", "Rainfall")
}


def plain(df: DataFrame, digits: int, stored: set[str]) -> DataFrame:
    def shown(f: T.StructField):
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            return c.cast("bigint").alias(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)) and f.name not in stored:
            # Off exact ties, where the last bit of a sum would decide.
            return F.round(c.cast("double") + F.lit(3 * 10.0 ** -(digits + 3)), digits).alias(f.name)
        return c
    return df.select(*[shown(f) for f in df.schema.fields])


def query(digits: int = 4, stored: set[str] = STORED):
    def register(fn: Query) -> Query:
        QUERIES[fn.__name__] = lambda spark, sf_dir: plain(fn(spark, sf_dir), digits, stored)
        return fn
    return register


def _documents(spark, sf):
    return b.documents(b.facts(spark, sf))


def _questions(spark, sf):
    return b.questions(b.facts(spark, sf))


def _hits(spark, sf):
    return b.hits(b.stored_facts(spark, sf))


# --------------------------------------------------------- cleaning and facts

@query()
def normalize_columns(spark, sf):
    raw = b.table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    return clean.normalize_columns(raw.toDF(" Customer Key", "Market Segment ", "ACCOUNT Balance"))


@query()
def normalize_rain(spark, sf):
    return b.rain(spark, sf)


@query()
def null_tokens(spark, sf):
    raw = b.table(spark, sf, "lineitem").select(
        F.concat("l_returnflag", F.lit("/A")).alias("flag"), F.col("l_linestatus").alias("status")
    )
    return readers.na_to_null(raw).groupBy("flag", "status").agg(F.count("*").alias("n_rows"))


@query()
def extract_year(spark, sf):
    dated = clean.extract_year(b.crop_raw(spark, sf))
    return dated.groupBy("year", "year_cleaned").agg(F.count("*").alias("n_rows"))


@query()
def coerce_numeric(spark, sf):
    text = b.table(spark, sf, "orders").select(
        "o_orderkey", F.col("o_totalprice").cast("string").alias("price"), F.col("o_orderpriority").alias("priority"),
        F.split("o_orderpriority", "-")[0].alias("level"),
    )
    return clean.coerce_numeric(text, ["price", "priority", "level"])


@query()
def coerced_cells(spark, sf):
    text = b.table(spark, sf, "orders").select(
        F.col("o_totalprice").cast("string").alias("price"), F.col("o_orderpriority").alias("priority")
    )
    return clean.coerced_cells(text, ["price", "priority"])


@query()
def to_int_year(spark, sf):
    years = b.table(spark, sf, "orders").select(
        F.concat(F.year("o_orderdate").cast("string"), F.lit(".0")).alias("year_text"), "o_orderstatus"
    )
    return years.select(
        "year_text", year_number(F.col("year_text")).alias("year"), year_number(F.col("o_orderstatus")).alias("bad_year")
    ).groupBy("year_text", "year", "bad_year").agg(F.count("*").alias("n_rows"))


@query()
def map_subdivision_literal(spark, sf):
    """Nations renamed to the literal states, mapped by the literal dimension."""
    states = sorted(STATE_SUBDIVISION)
    name = F.element_at(F.array(*map(F.lit, states)), (F.col("n_nationkey") % len(states) + 1).cast("int"))
    named = b.table(spark, sf, "customer").join(
        b.table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), name.alias("state")), "c_nationkey"
    )
    mapped = clean.map_subdivision(named.select("c_custkey", "state"), clean.subdivision_dim(spark))
    return mapped.groupBy("state", "subdivision").agg(F.count("*").alias("n_rows"))


@query()
def map_subdivision(spark, sf):
    mapped = clean.map_subdivision(b.crop_raw(spark, sf), b.subdivisions(spark, sf))
    return mapped.groupBy("state", "subdivision").agg(F.count("*").alias("n_rows"))


@query()
def strict_crop_clean(spark, sf):
    return clean.strict_crop_clean(b.crop_raw(spark, sf)).select(
        "state", "district", "crop", "year", "area", "production", "yield"
    )


@query()
def flag_rain_counts(spark, sf):
    """Nation-level rainfall as text, the priority text standing in for a bad year on urgent orders."""
    raw = b.table(spark, sf, "orders").select(
        F.col("o_orderstatus").alias("subdivision"),
        F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_orderpriority"))
        .otherwise(F.year("o_orderdate").cast("string")).alias("year"),
        F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_totalprice").cast("string")).alias("annual_rainfall"),
    )
    return clean.reject_counts(clean.flag_rain(raw))


@query()
def facts(spark, sf):
    return b.facts(spark, sf)


@query()
def join_rainfall_years(spark, sf):
    crop = clean.extract_year(clean.map_subdivision(b.crop_raw(spark, sf), b.subdivisions(spark, sf)))
    joined = join_rainfall(crop, b.rain(spark, sf), keep_rain_year=True)
    return joined.groupBy("subdivision", "rain_year", "annual_rainfall").agg(
        F.count("*").alias("n_rows"), F.avg("area").alias("avg_area")
    )


@query()
def join_rainfall_fan_out(spark, sf):
    """Nation-level rainfall under its subdivision: five rows per key, so every crop row fans out."""
    dim = b.subdivisions(spark, sf)
    crop = clean.extract_year(clean.map_subdivision(b.crop_raw(spark, sf), dim))
    rain = b.state_rain(spark, sf).join(dim, "state")
    return join_rainfall(crop, rain).groupBy("state", "year_cleaned").agg(
        F.count("*").alias("n_rows"), F.avg("annual_rainfall").alias("avg_rainfall")
    )


@query()
def duplicate_rain(spark, sf):
    return duplicate_rain_keys(b.state_rain(spark, sf).join(b.subdivisions(spark, sf), "state"))


@query()
def reject_counts(spark, sf):
    """Documentable facts by outcome; small parts' type is blanked to give the check something to reject."""
    raw = b.crop_raw(spark, sf).withColumn("crop", F.when(F.col("crop") != "SMALL", F.col("crop")).otherwise(F.lit(" ")))
    return clean.reject_counts(clean.flag_documentable(clean.extract_year(raw)))


# ------------------------------------------------------------------- explorer

@query()
def summary_counts(spark, sf):
    return explore.summary_counts(b.facts(spark, sf))


@query()
def explorer_filter(spark, sf):
    return explore.explore(b.facts(spark, sf), ["NATION_1", "NATION_7"], ["PROMO", "SMALL"], [1998, 1999])


@query()
def explorer_page(spark, sf):
    return explore.explorer_page(explore.explore(b.facts(spark, sf), states=["NATION_3"]), FACTS, 1000)


@query()
def preview(spark, sf):
    return explore.preview(b.facts(spark, sf), FACTS, 10)


@query()
def explorer_metrics(spark, sf):
    return explore.explorer_metrics(explore.explore(b.facts(spark, sf), crops=["PROMO", "LARGE"]))


@query()
def merged_metrics(spark, sf):
    """Exact measures of a filter from states appended in two batches, one of them twice, and whether the sketches keep their bounds."""
    facts, root = b.stored_facts(spark, sf), scratch_path(spark, "states")
    half = F.col("district") < "F"
    for batch, chosen in (("a", half), ("b", ~half), ("b", ~half)):
        states.append_states(facts.where(chosen), root, batch)
    crops, years = ["PROMO", "LARGE"], [1996, 1997, 1998]
    merged = as_table(states.merged_metrics(states.read_states(spark, root), (), crops, years), "merged")
    chosen = explore.explore(facts, (), crops, years)
    errors = states.rank_errors(chosen, merged, MEASURES, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    within = errors.agg((F.max("rank_error") <= states.RANK_ERROR).alias("quartiles_within"))
    districts = chosen.agg(F.countDistinct("district").alias("districts"))
    shown = [c for c in merged.columns if not c.startswith(("q1_", "median_", "q3_", "approx_"))]
    return merged.join(within, F.lit(True)).join(districts, F.lit(True)).select(
        *shown, "quartiles_within", (F.abs(F.col("approx_districts") - F.col("districts")) <= F.ceil(states.DISTINCT_ERROR * F.col("districts"))).alias("districts_within"))


@query(stored=set())
def describe_approx(spark, sf):
    """One-pass statistics, and whether the quartiles are within their stated share of the rows."""
    facts = b.stored_facts(spark, sf)
    said = as_table(eda.describe_approx(facts, MEASURES), "described")
    names = [name for name, _ in eda.QUARTILES]
    wide = said.groupBy().agg(*[F.max(F.when(F.col("column_name") == m, F.col(f"`{n}`"))).alias(f"{n}_{m}") for m in MEASURES for n in names])
    errors = states.rank_errors(facts, wide, MEASURES, dict(eda.QUARTILES)).groupBy("column_name").agg(F.max("rank_error").alias("error"))
    return said.join(errors, "column_name").select(
        "column_name", "count", "mean", "std", "min", "max", (F.col("error") <= 1 / eda.ACCURACY + 1 / F.col("count")).alias("quartiles_within"))


@query()
def metric_labels(spark, sf):
    return explore.metric_labels(explore.explorer_metrics(b.facts(spark, sf)))


@query()
def distinct_values(spark, sf):
    return explore.distinct_values(b.facts(spark, sf), "crop")


@query()
def first_states(spark, sf):
    return explore.distinct_values(b.facts(spark, sf), "state", 10)


@query()
def missing_summary(spark, sf):
    return explore.missing_summary(b.rain(spark, sf).select("subdivision", "year", "annual_rainfall", "jf", "mam", "jjas", "ond"))


@query()
def profile(spark, sf):
    return explore.profile(b.facts(spark, sf))


@query()
def sample_rows(spark, sf):
    wide = b.facts(spark, sf, b.ROW_KEY)
    return explore.sample_rows(wide, 2000, [*b.ROW_KEY, "production"], seed=42)


# ------------------------------------------------------------------------ EDA

@query()
def describe_facts(spark, sf):
    return eda.describe(b.facts(spark, sf, ("area",)), ["area", *MEASURES])


@query()
def describe_rain(spark, sf):
    return eda.describe(b.rain(spark, sf), ["annual_rainfall", "jf", "mam", "jjas", "ond"])


@query()
def yearly_means(spark, sf):
    return eda.yearly_means(b.facts(spark, sf))


@query()
def top_crops_by_production(spark, sf):
    return eda.top_crops_by_production(b.facts(spark, sf))


@query()
def top_crops_by_yield(spark, sf):
    return eda.top_crops_by_yield(b.facts(spark, sf))


@query()
def state_rainfall(spark, sf):
    return eda.state_rainfall(b.facts(spark, sf))


@query()
def state_rain_yield(spark, sf):
    return eda.state_rain_yield(b.facts(spark, sf))


@query()
def state_yield(spark, sf):
    return eda.state_yield(b.facts(spark, sf))


@query()
def best_states(spark, sf):
    return eda.state_yield(b.facts(spark, sf), 5)


@query()
def most_recorded_crops(spark, sf):
    return eda.most_recorded_crops(b.facts(spark, sf))


@query()
def restrict_to_top(spark, sf):
    facts = b.stored_facts(spark, sf)
    return eda.restrict_to_top(facts, eda.most_recorded_crops(facts, 5)).select(FACTS)


@query()
def crop_year_yield(spark, sf):
    return eda.crop_year_yield(b.facts(spark, sf))


def _explorer_chart(spark, sf):
    return b.facts(spark, sf).select(
        F.col("year_cleaned").alias("Year"), F.col("state").alias("State"), F.col("crop").alias("Crop"),
        F.col("production").alias("Production"), F.col("yield").alias("Yield"),
    )


@query()
def chart_production(spark, sf):
    return eda.chart_production(_explorer_chart(spark, sf))


@query()
def chart_yield(spark, sf):
    return eda.chart_yield(_explorer_chart(spark, sf))


@query(6)
def corr_pair(spark, sf):
    return eda.corr_pair(b.facts(spark, sf), "annual_rainfall", "yield")


@query(6, stored=set())
def corr_matrix(spark, sf):
    return eda.corr_matrix(b.facts(spark, sf), MEASURES)


@query()
def scatter_points(spark, sf):
    return eda.scatter_points(b.facts(spark, sf), "annual_rainfall", "yield", ["state"])


@query()
def scatter_production(spark, sf):
    return eda.scatter_points(b.facts(spark, sf), "annual_rainfall", "production")


# ------------------------------------------------------------------- rainfall

@query()
def rain_filter(spark, sf):
    return rainfall.rain_filter(b.state_rain(spark, sf), ["NATION_2", "NATION_5"], [1997, 1998])


@query()
def compare_rainfall(spark, sf):
    return rainfall.compare_rainfall(b.state_rain(spark, sf), ["NATION_2", "NATION_5"], 3)


@query()
def compare_rainfall_listed(spark, sf):
    return rainfall.compare_rainfall(b.state_rain(spark, sf), ["NATION_2", "NATION_5"], [1996, 1997, 1999])


@query()
def classify_question(spark, sf):
    return b.parser_questions(spark, sf).select("question_id", "query", qs.classify(F.col("query")).alias("type"))


def _parsed(spark, sf):
    return qs.parse_questions(b.parser_questions(spark, sf), b.state_words(spark, sf))


@query()
def extract_entities(spark, sf):
    joined = lambda c: F.array_join(F.col(f"entities.{c}").cast("array<string>"), ",").alias(c)
    return _parsed(spark, sf).select("question_id", *[joined(c) for c in ("states", "crops", "years", "numbers")])


@query()
def answer_parsed(spark, sf):
    return rainfall.answer_parsed(_parsed(spark, sf), b.state_rain(spark, sf))


# --------------------------------------------------------------------- corpus

@query()
def fact_sentences(spark, sf):
    return corpus.fact_sentences(b.facts(spark, sf)).select("text", *FACTS)


@query()
def documents_by_the_clock(spark, sf):
    """Documents stamped by the clock: one stamp a run, in the stated form, between the times before and after."""
    before = spark.sql("select date_format(current_timestamp(), \"yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX\")").first()[0]
    stamped = as_table(corpus.build_documents(b.facts(spark, sf)), "documents").select("metadata.state", "metadata.created_at")
    form = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}\.[0-9]{6}(Z|[+-][0-9]{2}:[0-9]{2})$"
    in_time = F.to_timestamp("created_at").between(F.to_timestamp(F.lit(before)), F.current_timestamp())
    return stamped.groupBy("state").agg(
        F.count("*").alias("n_documents"), F.countDistinct("created_at").alias("n_stamps"), F.bool_and(F.col("created_at").rlike(form) & in_time).alias("stamped"))


@query()
def rows_to_table(spark, sf):
    """A few facts taken to the driver and made a table again with a stated schema: values and types are kept."""
    few = explore.preview(b.facts(spark, sf), FACTS, 50).select(FACTS).collect()
    return readers.rows_to_df(spark, [tuple(r) for r in few], SCHEMA_OF_FACTS)


@query()
def build_documents(spark, sf):
    return corpus.flatten_metadata(_documents(spark, sf))


@query()
def document_json(spark, sf):
    return corpus.flatten_metadata(corpus.parse_document_json(corpus.document_json(_documents(spark, sf))))


@query()
def corpus_sample(spark, sf):
    return corpus.corpus_sample(_documents(spark, sf)).select("id", "text")


# --------------------------------------------------------------- file sources

@query()
def facts_csv(spark, sf):
    path = scratch_path(spark, "facts-csv")
    writers.write_facts(b.facts(spark, sf), path, "csv")
    return readers.read_facts(spark, path, "csv")


@query()
def facts_csv_reordered(spark, sf):
    """A file with its columns in another order and without yield: names decide, the absent measure is NULL."""
    path = scratch_path(spark, "facts-csv")
    shuffled = b.facts(spark, sf).select("district", "crop", "annual_rainfall", "production", "year_cleaned", "state")
    shuffled.write.option("header", True).option("escape", '"').csv(path)
    return readers.read_facts(spark, path, "csv")


@query()
def facts_parquet(spark, sf):
    """All facts written by year and read back."""
    path = scratch_path(spark, "facts-parquet")
    writers.write_facts(b.facts(spark, sf), path, partition_by_year=True)
    return readers.read_facts(spark, path)


@query()
def raw_csv(spark, sf):
    """Raw tables written as CSV, read in splits, cleaned and joined."""
    crop_path, rain_path = scratch_path(spark, "crop-csv"), scratch_path(spark, "rain-csv")
    b.crop_raw(spark, sf).drop(*b.ROW_KEY).toDF(
        "State", "District", "Crop", "Year", "Area ", "Production", " Yield"
    ).write.option("header", True).csv(crop_path)
    b.rain_raw(spark, sf).write.option("header", True).csv(rain_path)
    rain = clean.clean_rain(readers.read_rain(spark, rain_path))
    return build_facts(readers.read_crop(spark, crop_path), rain, b.subdivisions(spark, sf))


@query()
def csv_quoted_breaks(spark, sf):
    """Documents in CSV folders of two encodings and column orders: their texts hold quotes and line breaks."""
    root = scratch_path(spark, "csv")
    docs = b.table(spark, sf, "documents").filter("text is not null").select(
        F.col("doc_id").cast("string").alias("doc_id"), "lang", F.concat(F.lit('"é",\n'), F.replace("text", F.lit("\r"))).alias("text"))
    latin = docs.filter(F.decode(F.encode("text", "ISO-8859-1"), "ISO-8859-1") == F.col("text"))
    options = {"header": True, "escape": '"', "quoteAll": True, "nullValue": ""}
    docs.write.options(**options).csv(f"{root}/utf8")
    latin.select("text", "doc_id").write.options(encoding="ISO-8859-1", **options).csv(f"{root}/latin1")
    cells = readers.read_csv(spark, f"{root}/*")
    return cells.groupBy("doc_id", "text").agg(F.count("*").alias("n_rows"), F.count("lang").alias("n_lang"), F.max("lang").alias("lang"))


@query()
def corpus_json(spark, sf):
    path = scratch_path(spark, "corpus")
    writers.write_corpus(_documents(spark, sf), path)
    return corpus.flatten_metadata(readers.read_corpus(spark, path))


@query()
def written_counts(spark, sf):
    """What the job that writes the corpus kept and skipped, beside the rows in its files; one crop is blanked."""
    path = scratch_path(spark, "corpus")
    facts = b.facts(spark, sf).withColumn("crop", F.when(F.col("crop") != "SMALL", F.col("crop")).otherwise(F.lit(" ")))
    counts = writers.write_counted_corpus(facts, path, b.CREATED_AT)
    return counts.unionAll(readers.read_corpus(spark, path).agg(F.lit("read back"), F.count("*")))


@query()
def corpus_sample_csv(spark, sf):
    path = scratch_path(spark, "sample")
    writers.write_corpus_sample(_documents(spark, sf), path)
    typed = "id string, text string, state string, district string, year int, crop string, production double, yield double, annual_rainfall double, source string, created_at string"
    return spark.read.schema(typed).option("header", True).option("escape", '"').csv(path)


# -------------------------------------------------------------------- vectors

def _embeddings(spark, sf):
    return b.table(spark, sf, "embeddings")


def _label_questions(spark, sf):
    """One question per label: the mean vector of its members."""
    long = _embeddings(spark, sf).select("label", F.posexplode("embedding").alias("pos", "x"))
    means = long.groupBy("label", "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return means.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("v")).select(
        F.col("label").cast("bigint").alias("question_id"), F.transform("v", lambda e: e["x"]).alias("embedding")
    )


@query()
def l2_normalize(spark, sf):
    doubled = _embeddings(spark, sf).withColumn("embedding", F.transform("embedding", lambda x: x * 2))
    unit = vectors.normalize_vectors(doubled)
    return unit.select(
        "vec_id",
        F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")).alias("squares"),
        F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double")).alias("total"),
    )


@query()
def vector_manifest(spark, sf):
    return vectors.vector_manifest(_embeddings(spark, sf), "table-64")


@query(6)
def similarity_topk(spark, sf):
    return vectors.similarity_topk(
        _label_questions(spark, sf), _embeddings(spark, sf), 5, id_col="vec_id", payload=("label",)
    )


@query(6)
def similarity_topk_batch(spark, sf):
    """Every vector as a question against every vector."""
    asked = _embeddings(spark, sf).select(F.col("vec_id").alias("question_id"), "embedding")
    return vectors.similarity_topk(asked, _embeddings(spark, sf), 5, id_col="vec_id")


@query(6)
def similarity_topk_blocks(spark, sf):
    """The same from a pruned index, as for more questions than every task can hold."""
    asked = _embeddings(spark, sf).select(F.col("vec_id").alias("question_id"), "embedding")
    return vectors.similarity_topk(asked, _embeddings(spark, sf), 5, id_col="vec_id", max_questions=10)


def _clustered(spark, sf):
    """The test vectors drawn together around their labels: a direction of its own for each, at five times the length."""
    return _embeddings(spark, sf).withColumn("embedding", F.transform(
        "embedding", lambda x, i: (x + F.when(i % 10 == F.col("label"), F.lit(2.0)).otherwise(F.lit(0.0))).cast("float")))


def _clustered_index(spark, sf):
    return vector_index.write_index(_clustered(spark, sf), scratch_path(spark, "index"), "vec_id", payload=("label",))


@query(6)
def pruned_topk(spark, sf):
    """Every vector as a question; the winners' labels are joined by row."""
    asked = _clustered(spark, sf).select(F.col("vec_id").alias("question_id"), "embedding")
    return vector_index.pruned_topk(asked, _clustered_index(spark, sf), 7)


@query()
def prune_report(spark, sf):
    """How many vectors of its 7-best search each question left out: counted, and none for a search of all."""
    asked = _clustered(spark, sf).select(F.col("vec_id").alias("question_id"), "embedding")
    said = vector_index.prune_report(asked, _clustered_index(spark, sf), 7)
    return said.select(
        "question_id", "vectors", (F.col("vectors_scored") >= 7).alias("enough"), (F.col("vectors_scored") <= F.col("vectors")).alias("at_most_all"),
        (F.col("cells_scored") <= F.col("cells")).alias("cells_at_most_all"))


@query(6)
def attach_documents(spark, sf):
    """Hits joined with the documents table on the document id."""
    hits = vectors.similarity_topk(_label_questions(spark, sf), _embeddings(spark, sf), 5, id_col="vec_id")
    docs = b.table(spark, sf, "documents").select(F.col("doc_id").alias("vec_id"), "text", "lang")
    return vectors.attach_documents(hits, docs, "vec_id")


MODEL_DIM = 64


def _encoder(spark):
    """The batch model from its file, shipped to the executors."""
    model_file = vectors.write_model(spark, scratch_path(spark, "model"), vectors.HashModel.content(MODEL_DIM))
    return vectors.file_encoder(spark, model_file)


@F.arrow_udf(T.StringType())
def _millionths(vectors: pa.Array) -> pa.Array:
    """Each vector's components in millionths, halves away from zero, joined by commas; null for a null vector."""
    flat = np.asarray(vectors.flatten().to_numpy(zero_copy_only=False), np.float64) * 1e6
    whole = np.floor(np.abs(flat))
    rounded = np.copysign(whole + (np.abs(flat) - whole >= 0.5), flat).astype(np.int64)
    sizes = np.where(vectors.is_valid().to_numpy(zero_copy_only=False), pc.list_value_length(vectors).fill_null(0).to_numpy(zero_copy_only=False), 0)
    texts = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(rounded).cast(pa.string()))
    return pc.if_else(vectors.is_valid(), pc.binary_join(texts, ","), pa.scalar(None, pa.string()))


def _shown(vector="embedding"):
    """A vector as text, its components in millionths."""
    return _millionths(F.col(vector))


def _vector_rows(df):
    return df.select("id", "text", "metadata.*", _shown().alias("embedding"))


def _stored_vectors(spark, sf):
    """Facts, documents and vectors, each stage stored for the next: (facts, vectors, encoder)."""
    base, encoder = b.stored_facts(spark, sf), _encoder(spark)
    release(spark)
    path = scratch_path(spark, "vectors")
    writers.write_vectors(vectors.embed(b.documents(base), "text", encoder), path)
    return base, readers.read_vectors(spark, path), encoder


@query()
def vectors_parquet(spark, sf):
    """Documents with their vectors written as one table and read back, all rows and columns."""
    return _vector_rows(_stored_vectors(spark, sf)[1])


def _grown_store(spark, sf):
    """A store of all documents, brought up in three updates: half of the states, others with some of the first gone, all."""
    root, encoder = scratch_path(spark, "store"), _encoder(spark)
    docs = b.documents(b.stored_facts(spark, sf))
    release(spark)
    number = F.regexp_extract("metadata.state", r"(\d+)$", 1).cast("int")
    for batch, chosen in (("1", number % 2 == 0), ("2", number % 3 > 0), ("3", F.lit(True)), ("3", F.lit(True))):
        vector_store.update_store(docs.where(chosen), root, encoder, "md5-words", MODEL_DIM, batch)
    return root


@query()
def grown_vector_store(spark, sf):
    return _vector_rows(vector_store.load_store(spark, _grown_store(spark, sf), "md5-words", MODEL_DIM, measure=True))


@query()
def grown_vector_manifest(spark, sf):
    return vector_store.store_manifest(spark, _grown_store(spark, sf))


@query()
def document_keys(spark, sf):
    """Documents numbered within their id by content; the part without production repeats ids most."""
    docs = b.documents(b.facts(spark, sf).withColumn("production", F.lit(None).cast("double")))
    return vector_store.keyed_documents(docs).select("id", "occurrence", "text")


@query()
def embed_documents(spark, sf):
    """Unit vectors of whole texts; a text without words stays a zero vector."""
    coded = vectors.embed(b.table(spark, sf, "documents"), "text", _encoder(spark))
    return coded.select("doc_id", _shown().alias("embedding"))


@query(6)
def retrieve(spark, sf):
    base, stored, encoder = _stored_vectors(spark, sf)
    return vectors.retrieve(b.questions(base), stored, encoder, 5).select(
        "question_id", "rank", "id", "text", "similarity_score"
    )


@query(6)
def answer_batch(spark, sf):
    """All questions answered from retrieved documents, five each, with their sources."""
    base, stored, encoder = _stored_vectors(spark, sf)
    words, crops = b.term_vocabularies(spark, sf)
    asked = b.questions(base).withColumn("top_k", F.lit(None).cast("int"))
    told = an.answer_batch(asked, stored, encoder, states=words, crops=crops)
    source = F.transform("sources", lambda s: F.concat_ws("/", s["text"], s["metadata"]["district"]))
    return told.withColumn("sources", F.array_join(source, chr(10)))


# ----------------------------------------------------------------- data points

@query()
def question_hits(spark, sf):
    return _hits(spark, sf).select("question_id", "rank", "id", "similarity_score")


@query()
def flatten_hits(spark, sf):
    return dp.data_points(_hits(spark, sf))


@query()
def route_questions(spark, sf):
    return qs.route_questions(_questions(spark, sf)).select("question_id", "query", "route")


@query()
def wants_chart(spark, sf):
    return _questions(spark, sf).select("question_id", qs.wants_chart(F.col("query")).cast("int").alias("chart"))


@query()
def with_defaults(spark, sf):
    """Parser questions where only the comparisons state a depth."""
    asked = b.parser_questions(spark, sf).withColumns({
        "top_k": F.when(F.col("query").startswith("Compare"), 3), "temperature": F.lit(None).cast("double"),
    })
    return qs.with_defaults(asked)


@query()
def filter_by_question(spark, sf):
    return b.points(spark, sf).drop("text")


@query()
def first_per_group(spark, sf):
    return dp.first_per_group(b.points(spark, sf))


@query()
def compare_by_year(spark, sf):
    return dp.compare_by_year(b.points(spark, sf))


@query()
def compare_by_state(spark, sf):
    return dp.compare_by_state(b.points(spark, sf))


@query()
def compare_by_crop(spark, sf):
    return dp.compare_by_crop(b.points(spark, sf))


@query()
def trend_by_year(spark, sf):
    return dp.trend_by_year(b.points(spark, sf))


@query()
def trend_direction(spark, sf):
    return dp.trend_direction(b.points(spark, sf))


@query()
def extreme_max(spark, sf):
    return dp.extreme_max(b.points(spark, sf))


@query()
def extreme_min(spark, sf):
    return dp.extreme_min(b.points(spark, sf))


@query(6)
def question_corr(spark, sf):
    return dp.question_corr(dp.data_points(_hits(spark, sf)))


@query()
def summary_stats(spark, sf):
    stats = dp.summary_stats(b.points(spark, sf))
    return stats.withColumn("samples", F.array_join(F.transform(
        "samples", lambda s: F.concat_ws("/", s["rank"].cast("string"), s["state"], s["year"].cast("string"), s["crop"])
    ), ","))


# --------------------------------------------------------------- large vocabularies

@query()
def find_terms(spark, sf):
    """Every word and pair of neighbouring words of the benchmark looked for in every document."""
    words = spark.read.parquet(f"{sf}/benchmark.parquet").select(F.split(F.lower("text"), "[^a-z]+").alias("w"))
    pairs = F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda i: F.concat_ws(" ", F.col("w")[i - 1], F.col("w")[i]))
    terms = words.select(F.explode(F.concat("w", F.when(F.size("w") > 1, pairs).otherwise(F.array().cast("array<string>")))).alias("term"))
    index = matching.term_index(matching.numbered_terms(terms, "term"))
    docs = b.table(spark, sf, "documents").select("doc_id", F.lower("text").alias("text"))
    found = as_table(matching.find_terms(docs, index, "doc_id", "text"), "found")
    first, every = matching.first_terms(found), matching.all_terms(found)
    return every.join(first, "id").select(
        F.col("id").alias("doc_id"), F.size("terms").alias("n_terms"), F.col("term").alias("first_term"), F.md5(F.array_join("terms", "|")).alias("terms_md5"))


@query()
def question_terms_by_index(spark, sf):
    vocabularies = [matching.term_index(matching.vocabulary_rows(v)) for v in b.term_vocabularies(spark, sf)]
    return matching.question_terms_by_index(_questions(spark, sf), *vocabularies)


# --------------------------------------------------------------------- answers

@query()
def context_text(spark, sf):
    return an.context_text(_hits(spark, sf))


@query()
def prompt_text(spark, sf):
    base = b.stored_facts(spark, sf)
    return an.prompt_text(b.questions(base), an.context_text(b.hits(base)))


@query()
def answer_specific(spark, sf):
    return an.answer_specific(b.points(spark, sf))


@query()
def answer_comparison(spark, sf):
    return an.answer_comparison(b.points(spark, sf))


@query()
def answer_trend(spark, sf):
    return an.answer_trend(as_table(b.points(spark, sf), "points"))


@query()
def answer_extreme(spark, sf):
    return an.answer_extreme(b.points(spark, sf))


@query()
def answer_relationship(spark, sf):
    return an.answer_relationship(dp.data_points(_hits(spark, sf)))


@query()
def answer_summary(spark, sf):
    return an.answer_summary(b.points(spark, sf))


@query(6)
def answer_sources(spark, sf):
    packed = an.answer_sources(_hits(spark, sf)).select("question_id", F.posexplode("sources").alias("pos", "s"))
    return packed.select("question_id", (F.col("pos") + 1).alias("rank"), "s.text", "s.metadata.state", "s.similarity_score")


@query()
def answer_hits(spark, sf):
    """Every question routed, filtered, aggregated and answered."""
    base = b.stored_facts(spark, sf)
    words, crops = b.term_vocabularies(spark, sf)
    return an.answer_hits(
        as_table(b.questions(base), "questions"), as_table(b.hits(base), "hits"), include_sources=False,
        states=words, crops=crops,
    )


@query()
def chart_points(spark, sf):
    return an.chart_points(_hits(spark, sf))


@query()
def chart_series(spark, sf):
    base = b.stored_facts(spark, sf)
    return an.chart_series(b.questions(base), b.hits(base))


@query(stored={"x", "y", "size"})
def chart_scatter(spark, sf):
    base = b.stored_facts(spark, sf)
    return an.chart_scatter(b.questions(base), b.hits(base))


@query()
def unanswered(spark, sf):
    asked = as_table(_questions(spark, sf), "questions")
    answered = qs.route_questions(asked).where("route = 'summary'")
    return an.unanswered(asked, answered)


def _answered(spark, sf):
    """(questions, a function that answers some of them from their digest-scored hits)."""
    base = b.stored_facts(spark, sf)
    words, crops = b.term_vocabularies(spark, sf)
    asked, hits = as_table(b.questions(base), "questions"), as_table(b.hits(base), "hits")

    def answer(fresh):
        found = hits.join(fresh.select("question_id"), "question_id", "left_semi")
        return an.answer_hits(fresh, found, include_sources=False, states=words, crops=crops)

    return asked, answer


@query()
def log_queries(spark, sf):
    """The log rows of all questions' answers, of every kind."""
    asked, answer = _answered(spark, sf)
    return an.log_queries(answer(asked), b.CREATED_AT)


def _served(spark, sf):
    """The folder where all questions were answered in three batches; the second repeats the first one's and ran twice."""
    asked, answer = _answered(spark, sf)
    root, third = scratch_path(spark, "kept"), F.pmod("question_id", F.lit(3))
    for day, batch, chosen in ((1, "a", third == 0), (2, "b", third <= 1), (3, "b", third <= 1), (4, "c", F.lit(True))):
        an.serve(asked.where(chosen), root, batch, f"2026-01-0{day}T00:00:00", answer)
    return root


@query()
def kept_answers(spark, sf):
    return an.kept_answers(spark, _served(spark, sf))


@query()
def kept_history(spark, sf):
    return an.kept_history(spark, _served(spark, sf), 200)


@query()
def served_answers(spark, sf):
    """What the last batch's askers get: kept answers and new ones."""
    asked, answer = _answered(spark, sf)
    root = scratch_path(spark, "kept")
    an.serve(asked.where("question_id % 3 = 0"), root, "a", "2026-01-01T00:00:00", answer)
    return an.serve(asked, root, "b", "2026-01-02T00:00:00", answer)


@query()
def recent_history(spark, sf):
    log = b.table(spark, sf, "orders").select(
        F.concat_ws(" ", "o_orderpriority", F.col("o_orderkey").cast("string")).alias("query"),
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"),
        F.concat("o_orderstatus", F.lit("...")).alias("answer_preview"),
    )
    return an.recent_history(log)
