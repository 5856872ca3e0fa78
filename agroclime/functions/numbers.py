"""Numeric coercion, number text and statistics as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A plain decimal or scientific literal. Spark's cast alone also takes Java
# suffixes such as "12d", which are not numbers in a data file.
NUMBER_PATTERN = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def text_to_double(c: Column) -> Column:
    """Text to DOUBLE; anything that is not a number becomes NULL."""
    return F.when(c.rlike(NUMBER_PATTERN), c.try_cast("double"))


def nan_to_null(c: Column) -> Column:
    """NaN and NULL are one thing here: NULL."""
    return F.when(~F.isnan(c), c)


def year_number(c: Column) -> Column:
    """Number (or text of one) to INT, cutting decimals; bad input is NULL."""
    return text_to_double(c.cast("string")).try_cast("int")


def first_year(c: Column) -> Column:
    """First run of four digits in the text as INT; NULL if there is none.

    Most texts start with the year. Four characters that make a number of at least
    1000 can only be four digits, so those rows skip the regular expression.
    """
    text = c.cast("string")
    head = F.substring(text, 1, 4).try_cast("int")
    found = F.nullif(F.regexp_extract(text, r"(\d{4})", 1), F.lit("")).cast("int")
    return F.when(head >= 1000, head).otherwise(found)


def strip(c: Column) -> Column:
    """Text without white space at either end: blanks, tabs, line ends, no-break and other Unicode spaces."""
    space = r"[\s\p{Z}\x1c-\x1f\x85]+"
    return F.regexp_replace(c, f"^{space}|{space}$", "")


def fixed(c: Column, digits: int) -> Column:
    """``1234.5`` -> ``1234.50``: half-even on the exact binary value, no separators."""
    return F.translate(F.format_number(c, digits), ",", "")


def grouped(c: Column, digits: int) -> Column:
    """``1234.5`` -> ``1,234.50``."""
    return F.format_number(c, digits)


def _shortest_java(c: Column) -> Column:
    """The JVM's text of a DOUBLE, or a shorter one of 15 to 17 digits that reads back as the same number.

    JVMs before 19 sometimes print a digit too many.
    """
    text = c.cast("string")
    shorter = [F.format_string(f"%.{n - 1}e", c) for n in (15, 16, 17)]
    def tidy(t: Column) -> Column:
        mantissa = F.regexp_replace(F.substring_index(t, "e", 1), r"(\.\d*?)0+$", "$1")
        mantissa = F.when(mantissa.endswith("."), F.concat(mantissa, F.lit("0"))).otherwise(mantissa)
        return F.concat(mantissa, F.lit("E"), F.substring_index(t, "e", -1).try_cast("int").cast("string"))
    fits = F.coalesce(*[F.when(t.try_cast("double") == c, tidy(t)) for t in shorter], text)
    long = F.length(F.regexp_replace(F.substring_index(text, "E", 1), r"[^0-9]", "")) >= 17
    return F.when(text.contains("E") & long, fits).otherwise(text)


def shortest_text(c: Column) -> Column:
    """A DOUBLE as its shortest decimal text.

    Positional between 1e-4 and 1e16 (``12345678.9``, ``1234.0``), scientific
    with a signed two-digit exponent outside, ``nan`` for NULL.
    """
    java = _shortest_java(c)
    zeros_cut = F.regexp_replace(java.try_cast("decimal(38,21)").cast("string"), "0+$", "")
    positional = F.when(zeros_cut.endswith("."), F.concat(zeros_cut, F.lit("0"))).otherwise(zeros_cut)
    mantissa = F.regexp_replace(F.substring_index(java, "E", 1), r"\.0$", "")
    exponent = F.substring_index(java, "E", -1).try_cast("int")
    scientific = F.concat(
        mantissa,
        F.when(exponent < 0, F.lit("e-")).otherwise(F.lit("e+")),
        F.when(F.abs(exponent) < 10, F.lit("0")).otherwise(F.lit("")), F.abs(exponent).cast("string"),
    )
    size = F.abs(c)
    return (
        F.when(c.isNull() | F.isnan(c), F.lit("nan"))
        .when(~java.contains("E"), java)
        .when((size >= 1e-4) & (size < 1e16), positional)
        .otherwise(scientific)
    )


def pearson(x: Column, y: Column) -> Column:
    """Aggregate: Pearson correlation over the rows where both sides are present.

    NULL for fewer than two rows or when a side does not vary; the built-in
    ``corr`` raises on zero variance under ANSI mode.
    """
    both = x.isNotNull() & y.isNotNull()
    px, py = F.when(both, x), F.when(both, y)
    return F.try_divide(F.covar_samp(px, py), F.stddev_samp(px) * F.stddev_samp(py))


def ordered_mean(c: Column) -> Column:
    """Aggregate: the mean of a bounded group, summed from the smallest value up.

    For means that are shown as text, where the last bit of a floating sum would decide a rounding tie: the order of
    the sum, not the values, is fixed. It gathers the group, so it is for groups bounded by ``top_k`` rows.
    """
    values = F.array_sort(F.collect_list(nan_to_null(c)))
    return F.try_divide(F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x), F.size(values).cast("double"))


def l2_normalized(v: Column) -> Column:
    """Unit-length ARRAY<FLOAT>; a zero vector stays all zeros."""
    squares = F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
    norm = F.sqrt(squares)
    return F.transform(
        v, lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(F.lit(0.0)).cast("float")
    )
