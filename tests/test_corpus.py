"""Sentences and ids (goldens G4, G6)."""

import hashlib

from agroclime.operators.corpus import build_documents, document_json, fact_sentences, parse_document_json
from agroclime.sources.schemas import FACTS


def texts(spark, *measures):
    rows = [("Kerala", " X ", 2015, "Rice", *m) for m in measures]
    return [r.text for r in fact_sentences(spark.createDataFrame(rows, FACTS)).collect()]


def test_sentences(spark):
    got = texts(spark, (1234.56, 2.5, 987.6), (None, 2.5, 987.6), (1234.56, None, None))
    assert got == [
        "In 2015, the district X in Kerala produced 1234.56 tonnes of Rice with yield 2.50 tonnes per hectare "
        "and recorded 987.6 mm annual rainfall.",
        "In 2015, the district X in Kerala reported production for Rice with yield 2.50 tonnes per hectare "
        "and recorded 987.6 mm annual rainfall.",
        "In 2015, the district X in Kerala produced 1234.56 tonnes of Rice",
    ]


def test_ids(spark):
    rows = [("Kerala", "X", 2015, "Rice", p, 1.0, 1.0) for p in (1234.0, 12345678.9, None)]
    docs = build_documents(spark.createDataFrame(rows, FACTS), "t")
    texts = [f"Kerala|X|Rice|2015|{p}" for p in ("1234.0", "12345678.9", "nan")]
    assert [d.id for d in docs.collect()] == [hashlib.sha1(t.encode()).hexdigest()[:16] for t in texts]
    assert docs.collect()[0].id == "2a9903953acb1f3c"


def test_equal_rows_keep_equal_ids(spark):
    rows = [("Kerala", "X", 2015, "Rice", 1.0, y, 1.0) for y in (1.0, 2.0)]
    docs = build_documents(spark.createDataFrame(rows, FACTS), "t")
    assert docs.count() == 2 and docs.select("id").distinct().count() == 1


def test_json_round_trip(spark):
    rows = [("Kérala", "X", 2015, "Rice", None, 2.0, 1e-7)]
    docs = build_documents(spark.createDataFrame(rows, FACTS), "t")
    line = document_json(docs).collect()[0].line
    assert '"production":null' in line and "Kérala" in line
    assert parse_document_json(document_json(docs)).collect() == docs.collect()


def test_counts_come_from_the_writing_job(spark, tmp_path):
    """Written and skipped facts by reason, counted while writing: the input is scanned once."""
    from pyspark.sql import functions as F

    from agroclime.sources import writers

    rows = [("Kerala", "D", 2001, "Rice"), ("Kerala", " ", 2001, "Rice"), (None, "D", 2001, "Rice"), ("Kerala", "D", None, "Tea"), ("Kerala", "D", 2002, "")]
    facts = spark.createDataFrame([(*r, 1.0, 2.0, 3.0) for r in rows * 3], FACTS).repartition(3)
    scans = spark.sparkContext.accumulator(0)

    def noted(batches):
        for batch in batches:
            scans.add(len(batch))
            yield batch

    seen = facts.mapInPandas(noted, FACTS)
    counts = writers.write_counted_corpus(seen, str(tmp_path / "corpus"), "t")
    assert {r.outcome: r.n_rows for r in counts.collect()} == {
        "written": 3, "blank state": 3, "blank district": 3, "blank crop": 3, "missing year": 3}
    assert scans.value == 15 and spark.read.text(str(tmp_path / "corpus")).count() == 3
    nothing = writers.write_counted_corpus(facts.where(F.lit(False)), str(tmp_path / "none"), "t")
    assert nothing.count() == 0
