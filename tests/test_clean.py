"""Cleaning and joining (goldens G1-G3)."""

from agroclime.operators import clean, explore
from agroclime.operators.facts import build_facts, duplicate_rain_keys

CROP = "state string, district string, crop string, year string, area string, production string, yield string"
RAIN = "subdivision string, year string, annual_rainfall string"
ROWS = [
    ("Kerala", "D1", "Rice", "2001-02", "10", "25.5", "2.55"),
    ("Kerala", "D1", "Rice", "2001", None, "25.5", "2.55"),
    ("Kerala", "D1", "Rice", "unknown", "10", "25.5", "2.55"),
    ("Nowhere", "D1", "Rice", "2001-02", "10", "25.5", "2.55"),
    ("Kerala", None, "Rice", "2001-02", "10", "25.5", "2.55"),
    ("Kerala", "D2", "Wheat", "2001-02", "10", "abc", "2.0"),
]
RAINS = [
    ("Kerala", "2001", "3000.5"), ("Kerala", "2002.0", "3000.5"), ("Kerala", "1900", "3000.5"),
    ("Kerala", "2001", None), ("Kerala", "x", "3000.5"), (None, "2001", "1"),
]


def test_facts(spark):
    crop = spark.createDataFrame(ROWS, CROP)
    rain = clean.clean_rain(spark.createDataFrame(RAINS, RAIN))
    facts = build_facts(crop, rain, clean.subdivision_dim(spark))
    got = sorted(tuple(r) for r in facts.select("state", "district", "crop", "year_cleaned", "annual_rainfall").collect())
    assert got == [("Kerala", "D1", "Rice", 2001, 3000.5)] * 2 + [("Kerala", "D2", "Wheat", 2001, 3000.5)]
    assert facts.where("crop = 'Wheat'").collect()[0]["production"] is None
    assert facts.columns == list(clean.FACT_COLUMNS)


def test_coerced_cells_are_counted(spark):
    crop = spark.createDataFrame(ROWS, CROP)
    got = {r.column_name: r.coerced for r in clean.coerced_cells(crop, ["production", "area"]).collect()}
    assert got == {"production": 1, "area": 0}


def test_strict_mode(spark):
    crop = spark.createDataFrame(ROWS, CROP)
    got = clean.strict_crop_clean(crop).collect()
    assert [(r.state, r.year) for r in got] == [("Kerala", "2001-02"), ("Kerala", "unknown"), ("Nowhere", "2001-02")]


def test_rain_reasons(spark):
    flagged = clean.flag_rain(spark.createDataFrame(RAINS, RAIN))
    got = {r.outcome: r.n_rows for r in clean.reject_counts(flagged).collect()}
    assert got == {"written": 2, "bad year": 1, "missing rainfall": 1, "missing subdivision": 1, "year not after 1900": 1}
    assert sorted(r.year for r in clean.kept(flagged).collect()) == [2001, 2002]


def test_rows_are_accounted_for(spark):
    crop = clean.extract_year(spark.createDataFrame(ROWS, CROP))
    flagged = clean.flag_crop(clean.map_subdivision(crop, clean.subdivision_dim(spark)))
    got = {r.outcome: r.n_rows for r in clean.reject_counts(flagged).collect()}
    assert got == {"written": 4, "no year": 1, "unmapped state": 1}
    assert sum(got.values()) == len(ROWS)


def test_duplicate_rain_fans_out(spark):
    crop = spark.createDataFrame(ROWS[:1], CROP)
    rain = clean.clean_rain(spark.createDataFrame([("Kerala", "2001", "1.0"), ("Kerala", "2001", "2.0")], RAIN))
    dim = clean.subdivision_dim(spark)
    assert sorted(r.annual_rainfall for r in build_facts(crop, rain, dim).collect()) == [1.0, 2.0]
    assert [tuple(r) for r in duplicate_rain_keys(rain).collect()] == [("Kerala", 2001, 2)]
    assert build_facts(crop, rain.where("year = 1999"), dim).count() == 0


def test_documentable_reasons(spark):
    rows = [("a", "b", "c", 2000), (" ", "b", "c", 2000), ("a", None, "c", 2000), ("a", "b", "c", None)]
    facts = spark.createDataFrame(rows, "state string, district string, crop string, year_cleaned int")
    got = {r.outcome: r.n_rows for r in clean.reject_counts(clean.flag_documentable(facts)).collect()}
    assert got == {"written": 1, "blank state": 1, "blank district": 1, "missing year": 1}


def test_headers(spark):
    raw = spark.createDataFrame([(1, 2)], "` State Name` int, `Yield ` int")
    assert clean.normalize_columns(raw).columns == ["state_name", "yield"]
    rain = spark.createDataFrame([(1, 2, 3, 4)], "SUBDIVISION int, ` YEAR` int, ANNUAL int, JF int")
    assert clean.rename_rain(rain).columns == ["subdivision", "year", "annual_rainfall", "jf"]
    assert clean.project_available(rain, ["JF", "gone", "ANNUAL"]).columns == ["JF", "ANNUAL"]


def test_profile_and_missing(spark):
    df = spark.createDataFrame([(1, None), (2, "x")], "a int, b string")
    assert {r.column_name: r.missing for r in explore.missing_summary(df).collect()} == {"a": 0, "b": 1}
    got = {r.column_name: (r.data_type, r.non_null, r.n_rows, r.n_columns) for r in explore.profile(df).collect()}
    assert got == {"a": ("int", 2, 2, 2), "b": ("string", 1, 2, 2)}


def test_sample_is_exact_and_repeatable(spark):
    df = spark.range(1000)
    first = {r.id for r in explore.sample_rows(df, 100, ["id"]).collect()}
    again = {r.id for r in explore.sample_rows(df.repartition(7), 100, ["id"]).collect()}
    assert len(first) == 100 and first == again
    try:
        explore.sample_rows(df, 1001, ["id"], strict=True)
        raise AssertionError("a sample larger than the table must fail")
    except ValueError:
        pass
