"""File round trips."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F
from agroclime.operators.corpus import build_documents
from agroclime.operators.vectors import HashingEncoder, embed
from agroclime.sources import readers, scratch, writers
from agroclime.sources.schemas import FACTS

ROWS = [
    ("Kerala", "D, \"1\"", 2001, "Rice", 1234.56, 2.5, 987.6),
    ("Kerala", "D2", 2002, "Wheat", None, None, 10.0),
]


def facts(spark):
    return readers.rows_to_df(spark, ROWS, FACTS)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_facts_round_trip(spark, tmp_path):
    for fmt in ("csv", "parquet"):
        path = str(tmp_path / fmt)
        writers.write_facts(facts(spark), path, fmt)
        assert rows(readers.read_facts(spark, path, fmt)) == rows(facts(spark))
    path = str(tmp_path / "by-year")
    writers.write_facts(facts(spark), path, partition_by_year=True)
    assert rows(readers.read_facts(spark, path)) == rows(facts(spark))


def test_latin1_and_null_tokens(spark, tmp_path):
    path = tmp_path / "crop.csv"
    path.write_bytes(" State ,District,Crop,Year,Production\nOrissa,Béd,NA,2001,n/a\n".encode("latin1"))
    row = readers.read_crop(spark, str(path), encoding="ISO-8859-1").collect()[0]
    assert row.asDict() == {"state": "Orissa", "district": "Béd", "crop": None, "year": "2001", "production": None}
    rain = tmp_path / "rain.csv"
    rain.write_text("SUBDIVISION,YEAR,ANNUAL,JF\nKerala,2001,-nan,NULL\n")
    assert readers.read_rain(spark, str(rain)).collect()[0].asDict() == {
        "subdivision": "Kerala", "year": "2001", "annual_rainfall": None, "jf": None,
    }


def test_corpus_round_trip_writes_nulls(spark, tmp_path):
    docs = build_documents(facts(spark), "t")
    path = str(tmp_path / "corpus")
    writers.write_corpus(docs, path)
    lines = [line.value for line in spark.read.text(path).collect()]
    assert sum('"production":null' in line for line in lines) == 1
    assert rows(readers.read_corpus(spark, path)) == rows(docs)


def test_corpus_is_packed_in_bounded_files(spark, tmp_path, monkeypatch):
    docs = build_documents(facts(spark), "t")
    many = docs.crossJoin(spark.range(500).select()).coalesce(1)
    packed, plain = str(tmp_path / "packed"), str(tmp_path / "plain")
    writers.write_corpus(many, packed)
    writers.write_corpus(many, plain, "none")
    size = lambda path: sum(f.stat().st_size for f in Path(path).glob("part-*"))
    assert all(f.name.endswith(".json.gz") for f in Path(packed).glob("part-*")) and 5 * size(packed) < size(plain)
    assert rows(readers.read_corpus(spark, packed)) == rows(readers.read_corpus(spark, plain)) == rows(many)
    monkeypatch.setattr(writers, "FILE_ROWS", 600)
    writers.write_corpus(many, packed)
    assert len(list(Path(packed).glob("part-*"))) == -(-many.count() // 600)


def test_sample_vectors_and_manifest(spark, tmp_path):
    docs = build_documents(facts(spark), "t")
    writers.write_corpus_sample(docs, str(tmp_path / "sample"), 1)
    sample = spark.read.option("header", True).csv(str(tmp_path / "sample"))
    assert sample.count() == 1 and "annual_rainfall" in sample.columns
    vectors = embed(docs, "text", HashingEncoder.fit(docs, dim=16))
    writers.write_vectors(vectors, str(tmp_path / "vectors"))
    stored = readers.read_vectors(spark, str(tmp_path / "vectors"))
    assert stored.count() == 2
    writers.write_manifest(stored, str(tmp_path / "manifest"), "m")
    assert spark.read.json(str(tmp_path / "manifest")).collect()[0].asDict() == {
        "model_name": "m", "embedding_dim": 16, "num_vectors": 2, "index_type": "IndexFlatIP",
    }


def test_scratch_uses_the_named_folder(spark):
    root = spark.conf.get("spark.checkpoint.dir", None)
    path = scratch.scratch_path(spark, "x")
    assert path.startswith(f"{root}/x-" if root else "/") and path != scratch.scratch_path(spark, "x")
    assert rows(scratch.as_table(facts(spark), "x")) == rows(facts(spark))


def test_facts_csv_goes_by_header(spark, tmp_path):
    (tmp_path / "f.csv").write_text('District,state,crop,year_cleaned,yield,production\n"D\n1",Kerala,Rice,2001,2.5,10\n')
    row = readers.read_facts(spark, str(tmp_path / "f.csv"), "csv").collect()[0]
    assert (row.state, row.district, row.production, row["yield"], row.annual_rainfall) == ("Kerala", "D\n1", 10.0, 2.5, None)
    (tmp_path / "g.csv").write_text("state,crop,year_cleaned\nKerala,Rice,2001\n")
    with pytest.raises(ValueError, match="district"):
        readers.read_facts(spark, str(tmp_path / "g.csv"), "csv")


def test_scratch_needs_a_shared_folder_on_a_cluster(spark):
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master, applicationId = "spark://host:7077", "app"

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch.scratch_path(Session(), "x")


def test_stored_tables_are_packed(spark, tmp_path):
    """Vectors and intermediate tables take Parquet's zstd, whatever the session's default."""
    df = build_documents(facts(spark), "t").withColumn("embedding", F.array(F.lit(1.0).cast("float")))
    writers.write_vectors(df, str(tmp_path / "vectors"))
    table = scratch.as_table(df.drop("metadata"), "t")
    paths = [str(f) for f in Path(tmp_path / "vectors").glob("part-*")] + [f.removeprefix("file://") for f in table.inputFiles()]
    assert len(paths) > 1 and all(f.endswith(".zstd.parquet") for f in paths)
