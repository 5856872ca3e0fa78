"""Number text, coercion and statistics (goldens G5, G7)."""

import math

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from agroclime.functions import numbers as n


def column(spark, kind, values, expr):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.out for r in rows.select("i", expr(F.col("v")).alias("out")).orderBy("i").collect()]


def test_first_year(spark):
    values = ["2001-02", "2001", "unknown", None, "season 1998", "+2001", " 200", "0999", "12", "199 2003"]
    assert column(spark, "string", values, n.first_year) == [2001, 2001, None, None, 1998, 2001, None, 999, None, 2003]


def test_text_to_double(spark):
    values = ["1.5", " 12 ", "abc", "12d", "1e3", "-.5", "nan", None, "", "1_000"]
    assert column(spark, "string", values, n.text_to_double) == [1.5, 12.0, None, None, 1000.0, -0.5, None, None, None, None]


def test_year_number(spark):
    assert column(spark, "string", ["2001", "2001.0", "2001.9", "x", None], n.year_number) == [2001, 2001, 2001, None, None]


def test_fixed_and_grouped(spark):
    values = [0.125, 2.675, 0.375, 1234567.125]
    assert column(spark, "double", values, lambda c: n.fixed(c, 2)) == ["0.12", "2.67", "0.38", "1234567.12"]
    assert column(spark, "double", values, lambda c: n.grouped(c, 2))[3] == "1,234,567.12"


def test_shortest_text(spark):
    values = [1e7, 12345678.9, 1234.0, None, 0.0, 1e15, 1e16, 1.5e-7, 0.0001, 123456789012345.67, -2.5e-5]
    expected = ["nan" if v is None else repr(v) for v in values]
    assert column(spark, "double", values, n.shortest_text) == expected


@settings(max_examples=5, deadline=None)
@given(st.lists(st.floats(min_value=-1e12, max_value=1e12).map(lambda x: round(x, 2)), min_size=5, max_size=40))
def test_number_texts_are_pythons(spark, values):
    values = [v + 0.0 for v in values]
    assert column(spark, "double", values, lambda c: n.grouped(c, 1)) == [f"{v:,.1f}" for v in values]
    assert column(spark, "double", values, n.shortest_text) == [repr(v) for v in values]


def aggregate(spark, rows, schema, expr):
    return spark.createDataFrame(rows, schema).agg(expr.alias("out")).collect()[0].out


def test_pearson(spark):
    pair = n.pearson(F.col("x"), F.col("y"))
    rows = [(1.0, 1.0), (3.0, 5.0), (4.0, 4.0), (None, 9.0), (7.0, None)]
    assert math.isclose(aggregate(spark, rows, "x double, y double", pair), 0.838628, abs_tol=1e-6)
    assert aggregate(spark, [(2.0, 1.0), (2.0, 5.0)], "x double, y double", pair) is None
    assert aggregate(spark, [(2.0, 1.0)], "x double, y double", pair) is None


def test_ordered_mean(spark):
    mean = n.ordered_mean(F.col("x"))
    assert aggregate(spark, [(0.1,), (0.2,), (None,)], "x double", mean) == (0.1 + 0.2) / 2
    assert aggregate(spark, [(3e-9,), (4e-9,)], "x double", mean) == (3e-9 + 4e-9) / 2
    assert aggregate(spark, [(None,)], "x double", mean) is None
    assert aggregate(spark, [(1e300,), (3e300,)], "x double", mean) == 2e300


def test_l2_normalized(spark):
    rows = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<float>")
    got = [[round(x, 6) for x in r.u] for r in rows.select(n.l2_normalized(F.col("v")).alias("u")).collect()]
    assert got == [[0.6, 0.8], [0.0, 0.0]]


def test_strip(spark):
    df = spark.createDataFrame([("\tKerala\n",), ("\u00a0 a b\u2003",), ("",), (None,)], "x string")
    assert [r[0] for r in df.select(n.strip(F.col("x"))).collect()] == ["Kerala", "a b", "", None]


def test_shortest_text_of_large_values(spark):
    values = [7.283615649429924e18, 1.2345678901234567e17, 1e16, 123456789012345680.0, 2.5e-300, 1.7976931348623157e308, -2.5e20]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    assert [r[0] for r in df.select(n.shortest_text(F.col("x"))).collect()] == [repr(v) for v in values]
