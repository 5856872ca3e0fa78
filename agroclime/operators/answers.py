"""Answers as text: one renderer per answer kind, and the batch that combines them."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from agroclime.functions import keywords as kw
from agroclime.functions.keywords import contains_any
from agroclime.functions.numbers import fixed, grouped
from agroclime.operators import datapoints as dp
from agroclime.operators.eda import chart_means
from agroclime.operators.questions import question_terms, route, wants_chart, with_defaults
from agroclime.operators.vectors import retrieve
from agroclime.sources import growing
from agroclime.sources.schemas import ANSWER, LOG
from agroclime.sources.scratch import as_table

# ---- fixed values: reply texts and templates, as the answers must read ----

NO_DOCUMENTS = (
    "I couldn't find any relevant data to answer your question. "
    "Please try rephrasing or asking about a different topic."
)
NO_DATA = {
    "specific": "I couldn't find relevant data for your query.",
    "comparison": "I couldn't find relevant data for comparison.",
    "trend": "I couldn't find relevant data for trend analysis.",
    "extreme": "I couldn't find relevant data.",
    "relationship": "I couldn't find relevant data for relationship analysis.",
    "summary": "I couldn't find relevant data for your query.",
}
LIMITED_COMPARISON = (
    "I found limited data for comparison. "
    "Please ensure your query includes multiple states, years, or crops to compare."
)
LIMITED_TREND = "I found limited data for trend analysis. Please ensure your query covers multiple years."
LIMITED_RELATIONSHIP = (
    "I found limited data for relationship analysis. Need more records with both rainfall and yield data."
)
NO_EXTREME = "Could not determine extreme values."
COMPARISON_TITLE = "**Comparison Analysis:**\n"
COMPARISON_HEADERS = {
    "year": "*Year-wise Comparison:*",
    "state": "*State-wise Comparison:*",
    "crop": "*Crop-wise Comparison:*",
}
TREND_TITLE = "**Trend Analysis:**\n\n*Year-wise Data:*"
RELATIONSHIP_TITLE = "**Rainfall vs Crop Yield Relationship Analysis:**\n"
RELATIONSHIP_BANDS = {
    "positive": "  - **Positive relationship**: Higher rainfall tends to correlate with higher crop yields.",
    "negative": "  - **Negative relationship**: Higher rainfall tends to correlate with lower crop yields.",
    "weak": "  - **Weak relationship**: Rainfall and crop yield show limited correlation in the data.",
}
SUMMARY_TITLE = "**Summary of Available Data:**\n"
SOURCE_NOTE = ("\n\n*Based on ", " relevant records from the agricultural and climate database.*")
CONTEXT_START = "=== RELEVANT DATA CONTEXT ===\n"
CONTEXT_END = "=== END CONTEXT ===\n"
PROMPT_START = """You are an expert AI assistant specializing in Indian agriculture, climate, and crop production data analysis.

You have access to factual data from the Ministry of Agriculture (crop production) and IMD (Indian Meteorological Department - rainfall data).

Use the following context to answer the user's question accurately and comprehensively. If the question asks for comparisons, trends, or analysis, provide detailed insights with specific numbers and facts from the data.

CONTEXT DATA:
"""
PROMPT_QUESTION = "\n\nUSER QUESTION:\n"
PROMPT_END = """

INSTRUCTIONS:
1. Answer the question based ONLY on the provided context data above.
2. If the question asks for comparisons, charts, or trends, mention the specific states, districts, years, crops, rainfall values, yields, and production figures.
3. If specific data is not available in the context, clearly state what information is missing.
4. Be precise with numbers, units (tonnes, mm, hectares), and years.
5. If asked for analysis, provide insights about relationships between rainfall and crop yield/production.
6. Write in a clear, professional, and helpful tone.

ANSWER:"""

# ---- end of fixed values ----

KEYS = ("query", "top_k", "temperature")


def _words(*parts) -> Column:
    """Text and columns run together; NULL if any part is."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _lines(order: Column | str, line: Column) -> Column:
    """Aggregate: the non-NULL lines in order, one per row; NULL if there are none."""
    order = F.col(order) if isinstance(order, str) else order
    entry = F.when(line.isNotNull(), F.struct(order.alias("at"), line.alias("line")))
    ordered = F.array_sort(F.collect_list(entry))
    return F.nullif(F.array_join(F.transform(ordered, lambda e: e["line"]), "\n"), F.lit(""))


def _choice(c: Column, texts: dict[str, str]) -> Column:
    result = F.lit(None).cast("string")
    for name, text in texts.items():
        result = F.when(c == name, F.lit(text)).otherwise(result)
    return result


def _shown(c: Column) -> Column:
    """A value inside a sentence; an absent one reads ``None``."""
    return F.coalesce(c.cast("string"), F.lit("None"))


def _nonzero(c: str) -> Column:
    return F.nullif(F.col(c), F.lit(0.0))


# --------------------------------------------------------- context and prompt

def context_text(hits: DataFrame) -> DataFrame:
    """One context block per question: its documents, numbered, with their details."""
    m = {}
    for name, empty in (("state", ""), ("district", ""), ("year", "0"), ("crop", "")):
        value = F.col(f"metadata.{name}").cast("string")
        m[name] = F.when(value != empty, value)
    details = F.nullif(F.concat_ws(
        ", ",
        _words("State: ", m["state"]), _words("District: ", m["district"]),
        _words("Year: ", m["year"]), _words("Crop: ", m["crop"]),
    ), F.lit(""))
    block = F.concat_ws(
        "\n",
        _words("[Document ", F.col("rank").cast("string"), "]"),
        _words("Text: ", F.col("text")),
        _words("Details: ", details),
        F.lit(""),
    )
    return hits.groupBy("question_id").agg(
        F.concat_ws("\n", F.lit(CONTEXT_START), _lines("rank", block), F.lit(CONTEXT_END)).alias("context")
    )


def prompt_text(questions: DataFrame, contexts: DataFrame) -> DataFrame:
    """The context and the question inside the instruction template."""
    empty = F.lit(f"{CONTEXT_START}\n{CONTEXT_END}")
    return questions.join(contexts, "question_id", "left").select(
        "question_id",
        _words(
            PROMPT_START, F.coalesce("context", empty), PROMPT_QUESTION, F.col("query"), PROMPT_END
        ).alias("prompt"),
    )


# ------------------------------------------------------------------ renderers
# Each takes data points of questions of its kind, with ``query``, and returns
# (question_id, answer).

def answer_specific(points: DataFrame) -> DataFrame:
    head = F.concat_ws(
        " | ",
        _words("**", dp.present("state"), "**"),
        F.when(F.col("district") != "Unknown", _words("(District: ", dp.present("district"), ")")),
        _words("- Year ", dp.present("year").cast("string")),
        _words("- Crop: ", dp.present("crop")),
    )
    details = _words("  ", F.nullif(F.concat_ws(
        " | ",
        _words("Production: **", grouped(F.col("production"), 2), " tonnes**"),
        _words("Yield: **", fixed(F.col("yield"), 2), " tonnes/hectare**"),
        _words("Annual Rainfall: **", fixed(F.col("rainfall"), 1), " mm**"),
    ), F.lit("")))
    block = F.concat_ws("\n", head, details, F.lit(""))
    return dp.first_per_group(points).groupBy("question_id").agg(_lines("place", block).alias("answer"))


def answer_comparison(points: DataFrame) -> DataFrame:
    start = _words("  **", F.col("key"), "**: Avg Production: ", grouped(F.col("avg_production"), 1),
                   " tonnes | Avg Yield: ", fixed(F.col("avg_yield"), 2), " t/ha")
    rain = _words(" | Avg Rainfall: ", fixed(F.col("avg_rainfall"), 1), " mm")
    line = F.when(
        F.col("place").isNotNull(),
        F.concat(start, F.when(F.col("mode") == "year", rain).otherwise(F.lit(""))),
    )
    told = dp.comparison_groups(points).groupBy("question_id", "n_points", "mode").agg(
        _lines("place", line).alias("lines")
    )
    text = F.concat_ws("\n", F.lit(COMPARISON_TITLE), _choice(F.col("mode"), COMPARISON_HEADERS), F.col("lines"))
    return told.select(
        "question_id", F.when(F.col("n_points") < 2, F.lit(LIMITED_COMPARISON)).otherwise(text).alias("answer")
    )


def _with_spread(points: DataFrame) -> DataFrame:
    return points.withColumns({
        "n_points": F.count("*").over(dp.per_question()),
        "n_years": F.size(F.collect_set(dp.present("year")).over(dp.per_question())),
    })


def trend_text(points: DataFrame) -> DataFrame:
    """The trend answer of questions whose points span at least two years."""
    line = F.concat_ws(
        " | ",
        _words("  **", F.col("year").cast("string"), "**"),
        _words("Production: ", grouped(F.col("avg_production"), 1), " tonnes"),
        _words("Yield: ", fixed(F.col("avg_yield"), 2), " t/ha"),
        _words("Rainfall: ", fixed(F.col("avg_rainfall"), 1), " mm"),
    )
    told = dp.trend_by_year(points).groupBy("question_id").agg(
        _lines("year", line).alias("lines"), *dp.direction_measures()
    )
    closing = F.when(dp.has_direction(), _words(
        "\n*Production Trend: ", dp.direction(), " by ", fixed(F.abs(dp.change_pct()), 1), "% from ",
        F.col("first_year").cast("string"), " to ", F.col("last_year").cast("string"), "*",
    ))
    return told.select("question_id", F.concat_ws("\n", F.lit(TREND_TITLE), F.col("lines"), closing).alias("answer"))


def limited_trend(points: DataFrame) -> DataFrame:
    return points.select("question_id").distinct().select("question_id", F.lit(LIMITED_TREND).alias("answer"))


def answer_trend(points: DataFrame) -> DataFrame:
    """Trend, or the summary when the points fall in one year, or the limited-data reply."""
    spread = _with_spread(points)
    parts = [
        trend_text(spread.where("n_points >= 2 and n_years >= 2")),
        answer_summary(spread.where("n_points >= 2 and n_years < 2").drop("n_points", "n_years")),
        limited_trend(spread.where("n_points < 2")),
    ]
    return reduce(DataFrame.unionByName, parts)


def _extreme_text(title: str, detailed: bool) -> Column:
    extra = [
        _words("  Yield: ", fixed(_nonzero("yield"), 2), " tonnes/hectare"),
        _words("  Rainfall: ", fixed(_nonzero("rainfall"), 1), " mm"),
    ] if detailed else []
    return F.concat_ws(
        "\n",
        F.lit(title),
        _words("  State: ", _shown(F.col("state"))),
        _words("  District: ", _shown(F.col("district"))),
        _words("  Crop: ", _shown(F.col("crop"))),
        _words("  Year: ", _shown(F.col("year"))),
        _words("  Production: **", grouped(F.col("production"), 2), " tonnes**"),
        *extra,
    )


def answer_extreme(points: DataFrame) -> DataFrame:
    """Highest production if the question says so, else lowest, in one pass."""
    text = F.lower("query")
    side = F.when(contains_any(text, kw.ASK_MAX), "max").when(contains_any(text, kw.ASK_MIN), "min").otherwise("none")
    row = F.struct(*dp.POINT)
    sided = points.withColumn("side", side)
    usable_max = (F.col("side") == "max") & F.col("production").isNotNull()
    usable_min = (F.col("side") == "min") & (F.col("production") > 0)
    found = sided.groupBy("question_id", "side").agg(
        F.max_by(row, F.when(usable_max, F.struct(F.col("production"), (-F.col("rank")).alias("tie")))).alias("hi"),
        F.min_by(row, F.when(usable_min, F.struct(F.col("production"), F.col("rank")))).alias("lo"),
    )
    best = found.withColumn("best", F.coalesce("hi", "lo")).select("question_id", "side", "best", "best.*")
    told = F.when(F.col("side") == "max", _extreme_text("**Highest Production:**", True)).otherwise(
        _extreme_text("**Lowest Production:**", False)
    )
    return best.select(
        "question_id", F.when(F.col("best").isNull(), F.lit(NO_EXTREME)).otherwise(told).alias("answer")
    )


def answer_relationship(points: DataFrame) -> DataFrame:
    """Uses every data point of the question, not the filtered ones."""
    told = F.concat_ws(
        "\n",
        F.lit(RELATIONSHIP_TITLE),
        _words("*Correlation Coefficient: ", fixed(F.col("correlation"), 3), "*"),
        _choice(F.col("band"), RELATIONSHIP_BANDS),
        F.lit("\n*Average Values:*"),
        _words("  - Average Rainfall: ", fixed(F.col("avg_rainfall"), 1), " mm"),
        _words("  - Average Yield: ", fixed(F.col("avg_yield"), 2), " tonnes/hectare"),
    )
    return dp.question_corr(points).select(
        "question_id",
        F.when(F.col("band") == "limited", F.lit(LIMITED_RELATIONSHIP)).otherwise(told).alias("answer"),
    )


def answer_summary(points: DataFrame) -> DataFrame:
    def block(title: str, c: str, show, digits: int, unit: str) -> Column:
        return F.concat_ws("\n", F.lit(title), *[
            _words(f"  - {label}: ", show(F.col(f"{stat}_{c}"), digits), f" {unit}")
            for label, stat in (("Average", "avg"), ("Maximum", "max"), ("Minimum", "min"))
        ])

    def if_any(c: str, text: Column) -> Column:
        return F.when(F.col(f"avg_{c}").isNotNull(), text)

    sample_lines = F.array_join(F.filter(F.transform("samples", lambda s: F.nullif(F.concat_ws(
        " ",
        F.nullif(s["state"], F.lit("")),
        F.concat(F.lit("("), F.nullif(s["year"], F.lit(0)).cast("string"), F.lit(")")),
        F.concat(F.lit("- "), F.nullif(s["crop"], F.lit(""))),
    ), F.lit(""))), lambda line: line.isNotNull()), "\n  - ")
    told = F.concat_ws(
        "\n",
        F.lit(SUMMARY_TITLE),
        if_any("production", block("*Production Statistics:*", "production", grouped, 1, "tonnes")),
        if_any("yield", block("\n*Yield Statistics:*", "yield", fixed, 2, "tonnes/hectare")),
        if_any("rainfall", block("\n*Rainfall Statistics:*", "rainfall", fixed, 1, "mm")),
        _words("\n*Sample Records (", F.least(F.lit(dp.SAMPLE_ROWS), F.col("n_points")).cast("string"),
               " of ", F.col("n_points").cast("string"), "):*"),
        _words("  - ", F.nullif(sample_lines, F.lit(""))),
    )
    return dp.summary_stats(points).select("question_id", told.alias("answer"))


RENDERERS = {
    "specific": answer_specific,
    "comparison": answer_comparison,
    "trend": trend_text,
    "limited trend": limited_trend,
    "extreme": answer_extreme,
    "relationship": answer_relationship,
    "summary": answer_summary,
}


# ---------------------------------------------------------------------- batch

def unanswered(questions: DataFrame, answered: DataFrame | None) -> DataFrame:
    """Questions whose (query, top_k, temperature) has no answer yet, each key once."""
    fresh = questions
    if answered is not None:
        known = answered.select(*[F.col(k).alias(f"__{k}") for k in KEYS]).distinct()
        same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in KEYS])
        fresh = questions.join(known, same, "left_anti")
    return fresh.groupBy(*KEYS).agg(F.min("question_id").alias("question_id")).select("question_id", *KEYS)


def planned_points(questions: DataFrame, hits: DataFrame, states=kw.QUESTION_STATES, crops=kw.QUESTION_CROPS) -> DataFrame:
    """Filtered data points with ``kind``, the renderer each question goes to."""
    terms = question_terms(questions, states, crops).withColumn("route", route(F.col("query")))
    filtered = dp.filter_by_question(dp.data_points(hits), terms, keep_all=F.col("route") == "relationship")
    spread = _with_spread(filtered)
    kind = (
        F.when((F.col("route") == "trend") & (F.col("n_points") < 2), "limited trend")
        .when((F.col("route") == "trend") & (F.col("n_years") < 2), "summary")
        .otherwise(F.col("route"))
    )
    return spread.withColumn("kind", kind).drop("n_points", "n_years", "route")


def answer_sources(hits: DataFrame) -> DataFrame:
    """The documents behind each answer, best first."""
    entry = F.struct("rank", F.struct("text", "metadata", "similarity_score").alias("source"))
    return hits.groupBy("question_id").agg(
        F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["source"]).alias("sources")
    )


def answer_hits(
    questions: DataFrame, hits: DataFrame, include_sources: bool = True,
    states=kw.QUESTION_STATES, crops=kw.QUESTION_CROPS,
) -> DataFrame:
    """Answers for questions whose documents are retrieved already.

    The filtered points are written once, one folder per answer kind, and every
    renderer reads its own folder: the points are computed once and read once,
    although several renderers follow.
    """
    points = as_table(planned_points(questions, hits, states, crops), "points", partition_by=["kind"])
    told = reduce(DataFrame.unionByName, [
        render(points.where(F.col("kind") == kind)) for kind, render in RENDERERS.items()
    ])
    per_question = (
        answer_sources(hits).withColumn("num_sources", F.size("sources")) if include_sources
        else hits.groupBy("question_id").agg(F.count("*").cast("int").alias("num_sources"))
    )
    note = _words(SOURCE_NOTE[0], F.col("num_sources").cast("string"), SOURCE_NOTE[1])
    answer = F.when(F.col("num_sources").isNull(), F.lit(NO_DOCUMENTS)).otherwise(
        F.concat_ws("\n", F.coalesce(F.col("answer"), _choice(route(F.col("query")), NO_DATA)), note)
    )
    joined = questions.join(per_question, "question_id", "left").join(told, "question_id", "left")
    return joined.select(
        "question_id",
        *KEYS,
        answer.alias("answer"),
        F.coalesce("num_sources", F.lit(0)).alias("num_sources"),
        *(["sources"] if include_sources else []),
    )


def answer_batch(
    questions: DataFrame, vectors: DataFrame, encoder, answered: DataFrame | None = None,
    include_sources: bool = True, states=kw.QUESTION_STATES, crops=kw.QUESTION_CROPS, **retrieval,
) -> DataFrame:
    """One answer per asked question: repeats share one, and ``answered`` (earlier rows of this result) is reused.

    Only new (query, top_k, temperature) keys are retrieved. The hits are the expensive part and feed several
    branches, so they are written to the shared folder once.
    """
    asked = as_table(with_defaults(questions), "asked")
    fresh = as_table(unanswered(asked, answered), "questions")
    hits = as_table(retrieve(fresh, vectors, encoder, **retrieval), "hits")
    told = answer_hits(fresh, hits, include_sources, states, crops).drop("question_id")
    if answered is not None:
        told = told.unionByName(answered.select(*told.columns).dropDuplicates(list(KEYS)))
    known = told.withColumnsRenamed({k: f"__{k}" for k in KEYS})
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in KEYS])
    return asked.select("question_id", *KEYS).join(known, same, "left").drop(*[f"__{k}" for k in KEYS])


def log_queries(answers: DataFrame, timestamp: str) -> DataFrame:
    """Log rows for newly computed answers: query, time, 100-character preview."""
    return answers.select(
        "query",
        F.lit(timestamp).alias("timestamp"),
        F.concat(F.substring("answer", 1, 100), F.lit("...")).alias("answer_preview"),
    )


def recent_history(log: DataFrame, n: int = 10) -> DataFrame:
    """The last entries, newest first."""
    return log.orderBy(F.desc("timestamp"), "query").limit(n)


# ------------------------------------------------------------ kept answers

def _same_key(left: str = "", right: str = "__") -> Column:
    return reduce(lambda a, b: a & b, [F.col(left + k).eqNullSafe(F.col(right + k)) for k in KEYS])


def kept_answers(spark: SparkSession, root: str) -> DataFrame:
    """All answers kept under ``root``: (query, top_k, temperature, answer, num_sources, batch), each key once.

    Should two batches that ran at once have answered the same key, the first batch by name counts.
    """
    rows = growing.read(spark, f"{root}/answers", ANSWER)
    first = F.min(F.struct("batch", "answer", "num_sources")).alias("first")
    return rows.groupBy(*KEYS).agg(first).select(*KEYS, "first.answer", "first.num_sources", "first.batch")


def serve(
    questions: DataFrame, root: str, batch: str, timestamp: str, answer: Callable[[DataFrame], DataFrame],
) -> DataFrame:
    """An answer for every question: kept ones are served, new (query, top_k, temperature) keys are answered and kept.

    ``answer`` gets the new questions, each key once, and returns (query, top_k, temperature, answer, num_sources), as
    ``answer_hits`` does. Its rows and their log entries are kept as ``batch``: a job repeated under the same batch
    name computes and appends nothing, wherever the first run ended. The log follows from the kept answers, so that
    it has exactly one entry for every answer.
    """
    spark = questions.sparkSession
    asked = as_table(with_defaults(questions), "asked")
    if not growing.commits(spark, f"{root}/answers", batch):
        fresh = as_table(unanswered(asked, kept_answers(spark, root)), "questions")
        told = answer(fresh).select(*KEYS, "answer", "num_sources", F.lit(batch).alias("batch"))
        growing.append(told.to(ANSWER), f"{root}/answers", batch)
    written = growing.read(spark, f"{root}/answers", ANSWER, batch)
    growing.append(log_queries(written, timestamp).to(LOG), f"{root}/log", batch, "timestamp")
    known = kept_answers(spark, root).withColumnsRenamed({k: f"__{k}" for k in KEYS})
    return asked.select("question_id", *KEYS).join(known, _same_key(), "left").drop(*[f"__{k}" for k in KEYS], "batch")


def kept_history(spark: SparkSession, root: str, n: int = 10) -> DataFrame:
    """The last entries of the kept log, newest first; older batches are not opened."""
    return growing.newest(spark, f"{root}/log", LOG, "timestamp", n, "query")


# --------------------------------------------------------------------- charts

def chart_points(hits: DataFrame) -> DataFrame:
    """Chart rows of the retrieved documents that carry a year and a crop."""
    year, crop = F.col("metadata.year"), F.col("metadata.crop")
    return hits.where((year != 0) & (crop != "")).select(
        "question_id",
        year.alias("Year"),
        crop.alias("Crop"),
        F.col("metadata.state").alias("State"),
        F.col("metadata.production").alias("Production"),
        F.col("metadata.yield").alias("Yield"),
        F.col("metadata.annual_rainfall").alias("Rainfall"),
    )


def _charted(questions: DataFrame, hits: DataFrame) -> DataFrame:
    asking = questions.where(wants_chart(F.col("query"))).select("question_id")
    return chart_points(hits).join(asking, "question_id", "left_semi")


def chart_series(questions: DataFrame, hits: DataFrame) -> DataFrame:
    """Production and yield series of the questions that ask for a chart."""
    return chart_means(_charted(questions, hits), "question_id")


def chart_scatter(questions: DataFrame, hits: DataFrame) -> DataFrame:
    """Third series of those questions: rainfall against yield, a point per document.

    Coloured by crop, sized by production, labelled with state and year. Points without either measure, or without a
    size, cannot be drawn and are left out.
    """
    drawn = _charted(questions, hits).dropna(subset=["Rainfall", "Yield", "Production"])
    return drawn.select(
        "question_id", F.col("Rainfall").alias("x"), F.col("Yield").alias("y"), F.col("Crop").alias("color"),
        F.col("Production").alias("size"), "State", "Year",
    )
