"""Statistics against numpy and pandas (golden G8)."""

import numpy as np
import pandas as pd

from agroclime.operators import eda

FACTS = "state string, crop string, year_cleaned int, production double, yield double, annual_rainfall double"


def random_facts(spark, n=400):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({
        "state": rng.choice(["a", "b", "c"], n), "crop": rng.choice(list("uvwxyz"), n, p=[.4, .2, .1, .1, .1, .1]),
        "year_cleaned": rng.integers(2000, 2006, n), "production": rng.integers(0, 50, n) / 4,
        "yield": rng.normal(size=n), "annual_rainfall": rng.normal(size=n),
    })
    rows = pdf.astype(object)
    for name in ("production", "yield", "annual_rainfall"):
        rows.loc[rng.random(n) < 0.1, name] = None
    data = [tuple(r) for r in rows.itertuples(index=False)]
    return spark.createDataFrame(data, FACTS), pd.DataFrame(data, columns=pdf.columns).astype(
        {c: float for c in ("production", "yield", "annual_rainfall")})


def test_describe_golden(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (4.0,), (9.0,), (None,)], "v double")
    row = eda.describe(df, ["v"]).collect()[0]
    assert (row["count"], row["mean"], round(row["std"], 6)) == (4, 4.0, 3.559026)
    assert (row["min"], row["p25"], row["p50"], row["p75"], row["max"]) == (1.0, 1.75, 3.0, 5.25, 9.0)


def test_describe_matches_pandas(spark):
    df, pdf = random_facts(spark)
    cols = ["production", "yield", "annual_rainfall"]
    expected = pdf[cols].describe()
    for r in eda.describe(df.repartition(5), cols).collect():
        got = [r["count"], r["mean"], r["std"], r["min"], r["p25"], r["p50"], r["p75"], r["max"]]
        assert np.allclose(got, expected[r.column_name].to_numpy())


def test_quantiles_with_one_hot_value(spark):
    values = [5.0] * 700 + [float(i) for i in range(300)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    row = eda.exact_quantiles(df, ["v"]).collect()[0]
    assert [row.p25, row.p50, row.p75] == list(np.percentile(values, [25, 50, 75]))


def test_describe_of_an_empty_column(spark):
    row = eda.describe(spark.createDataFrame([(None,)], "v double"), ["v"]).collect()[0]
    assert row["count"] == 0 and row["p50"] is None


def test_grouped_means_and_tops(spark):
    df, pdf = random_facts(spark)
    want = pdf.groupby("crop")["production"].mean().sort_values(ascending=False)
    got = eda.top_crops_by_production(df, 3).collect()
    assert [r.crop for r in got] == list(want.index[:3]) and np.allclose([r.avg_production for r in got], want[:3])
    want = pdf.groupby("year_cleaned")[["annual_rainfall", "yield"]].mean()
    for r in eda.yearly_means(df).collect():
        assert np.allclose([r.avg_rainfall, r.avg_yield], want.loc[r.year_cleaned])


def test_crop_year_yield(spark):
    df, pdf = random_facts(spark)
    counts = pdf["crop"].value_counts()
    top = sorted(counts.index, key=lambda c: (-counts[c], c))[:2]
    want = pdf[pdf.crop.isin(top)].groupby(["crop", "year_cleaned"])["yield"].mean()
    got = {(r.crop, r.year_cleaned): r.avg_yield for r in eda.crop_year_yield(df, 2).collect()}
    assert set(got) == set(want.index) and all(np.isclose(got[k], want[k]) for k in got)
    again = eda.restrict_to_top(df, eda.most_recorded_crops(df, 2))
    assert {r.crop for r in again.select("crop").distinct().collect()} == set(top)


def test_null_keys_are_dropped(spark):
    df = spark.createDataFrame([(None, None, 2000, 1.0, 1.0, 1.0), ("a", "u", 2000, 3.0, None, 1.0)], FACTS)
    assert [tuple(r) for r in eda.state_rainfall(df).collect()] == [("a", 1.0)]
    assert [r.avg_yield for r in eda.state_yield(df).collect()] == [None]


def test_corr_matrix_is_pairwise(spark):
    df, pdf = random_facts(spark)
    cols = ["production", "yield", "annual_rainfall"]
    want = pdf[cols].corr()
    for r in eda.corr_matrix(df, cols).collect():
        assert np.allclose([r[c] for c in cols], want.loc[r.column_name])


def test_describe_approx_is_close(spark):
    df, pdf = random_facts(spark)
    expected = pdf[["yield"]].describe()["yield"].to_numpy()
    r = eda.describe_approx(df, ["yield"]).collect()[0]
    got = [r["count"], r["mean"], r["std"], r["min"], r["p25"], r["p50"], r["p75"], r["max"]]
    assert np.allclose(got, expected, atol=0.05)


def test_nan_counts_as_missing(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (3.0,)], "v double")
    row = eda.describe(df, ["v"]).collect()[0]
    assert (row["count"], row["mean"], row["max"]) == (2, 2.0, 3.0)
