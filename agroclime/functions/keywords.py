"""Fixed vocabularies and keyword tests over question text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---- fixed values: these must stay exactly as they are for right results ----

# Terms a question is searched for, in order of precedence.
QUESTION_STATES = [
    "tamil nadu", "maharashtra", "punjab", "karnataka", "gujarat", "west bengal",
    "bihar", "andhra pradesh", "telangana", "rajasthan", "uttar pradesh",
]
QUESTION_CROPS = ["rice", "wheat", "sugarcane", "cotton", "maize", "banana", "potato", "tomato"]
QUESTION_YEARS = [str(y) for y in range(1997, 2018)]

# Answer router.
ASK_VALUE = ["what is", "how much", "how many", "what was", "tell me"]
ASK_COMPARE = ["compare", "comparison"]
ASK_TREND = ["trend", "over time"]
ASK_TREND_LOOSE = ["trend", "over time", "year", "2015", "2016", "2017", "2018", "2019", "2020"]
ASK_EXTREME = ["highest", "lowest", "maximum", "minimum", "top", "best", "worst"]
ASK_RELATION = ["correlation", "relationship", "relation", "impact", "effect"]
ASK_MAX = ["highest", "maximum", "top"]
ASK_MIN = ["lowest", "minimum"]
ASK_CHART = ["compare", "trend", "show", "plot", "chart", "graph"]

# Question classes, first hit wins.
QUESTION_CLASSES = [
    ("compare_rainfall", ["compare", "rainfall", "precipitation"]),
    ("top_crops", ["top", "highest", "most produced", "production"]),
    ("trend_analysis", ["trend", "over the years", "increase", "decrease", "growth"]),
    ("correlation_analysis", ["correlate", "relationship", "impact", "effect"]),
    ("policy_argument", ["policy", "promote", "support", "argument"]),
]
ENTITY_CROPS = ["rice", "wheat", "maize", "cotton", "sugarcane", "millet", "barley", "tea", "coffee"]

# State -> rainfall subdivision.
STATE_SUBDIVISION = {
    "Andaman and Nicobar Islands": "Andaman & Nicobar Islands",
    "Arunachal Pradesh": "Arunachal Pradesh",
    "Assam": "Assam & Meghalaya",
    "Meghalaya": "Assam & Meghalaya",
    "Nagaland": "Naga Mani Mizo Tripura",
    "Manipur": "Naga Mani Mizo Tripura",
    "Mizoram": "Naga Mani Mizo Tripura",
    "Tripura": "Naga Mani Mizo Tripura",
    "West Bengal": "Gangetic West Bengal",
    "Sikkim": "Sub Himalayan West Bengal & Sikkim",
    "Odisha": "Orissa",
    "Jharkhand": "Jharkhand",
    "Bihar": "Bihar",
    "Uttar Pradesh": "East Uttar Pradesh",
    "Uttarakhand": "West Uttar Pradesh",
    "Haryana": "Haryana Delhi Chandigarh",
    "Delhi": "Haryana Delhi Chandigarh",
    "Punjab": "Punjab",
    "Himachal Pradesh": "Himachal Pradesh",
    "Jammu and Kashmir": "Jammu & Kashmir",
    "Chhattisgarh": "Chhattisgarh",
    "Madhya Pradesh": "West Madhya Pradesh",
    "Gujarat": "Saurashtra Kutch & Diu",
    "Maharashtra": "Konkan & Goa",
    "Goa": "Konkan & Goa",
    "Andhra Pradesh": "Coastal Andhra Pradesh",
    "Telangana": "Telangana",
    "Karnataka": "South Interior Karnataka",
    "Kerala": "Kerala",
    "Tamil Nadu": "Tamil Nadu",
    "Rajasthan": "East Rajasthan",
}

# Cell texts that mean "no value" in a CSV.
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

# ---- end of fixed values ----


def contains_any(text: Column, words: Sequence[str]) -> Column:
    """True if any of the words occurs anywhere in the text."""
    hit = F.lit(False)
    for word in words:
        hit = hit | text.contains(word)
    return hit


Vocabulary = Sequence[str] | Column | DataFrame


def with_vocabulary(df: DataFrame, name: str, words: Vocabulary) -> tuple[DataFrame, Column]:
    """The vocabulary as an array column of ``df``.

    A list is a literal, a column is taken as it is, and a table of one row and one
    array column becomes a scalar subquery, so nothing is fetched to build the plan.
    """
    if isinstance(words, DataFrame):
        return df.withColumn(name, words.scalar()), F.col(name)
    return df, words if isinstance(words, Column) else F.array(*[F.lit(w) for w in words])


def terms_in(text: Column, words: Column) -> Column:
    """The vocabulary terms found in the text, in vocabulary order."""
    return F.filter(words, lambda w: F.instr(text, w) > 0)


def first_term_in(text: Column, words: Column) -> Column:
    """The first vocabulary term found in the text; NULL if none is."""
    return F.try_element_at(terms_in(text, words), F.lit(1))
