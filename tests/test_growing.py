"""Tables that grow by batches: repeated and failed jobs, the newest rows, answers and their log."""

import os

import pytest
from pyspark.sql import functions as F

from agroclime.operators import answers as an
from agroclime.sources import growing
from agroclime.sources.schemas import LOG

QUESTION = "question_id bigint, query string, top_k int, temperature double"


def log(spark, day, n, name=""):
    return spark.createDataFrame([(f"q{name}{i:03d}", f"2026-01-{day:02d}T00:00:{i:02d}", "...") for i in range(n)], LOG).repartition(2)


def test_a_batch_is_written_once(spark, tmp_path):
    root = str(tmp_path / "t")
    assert growing.read(spark, root, LOG).count() == 0 and growing.count(spark, root) == 0
    assert growing.append(log(spark, 1, 5), root, "a", "timestamp")
    assert not growing.append(log(spark, 2, 9), root, "a", "timestamp")
    assert growing.append(log(spark, 2, 3), root, "b", "timestamp")
    assert growing.append(log(spark, 2, 0), root, "none", "timestamp")
    assert growing.read(spark, root, LOG).count() == growing.count(spark, root) == 8
    assert growing.read(spark, root, LOG, "b").count() == 3
    by = {m.batch: (m.n_rows, m.first_time, m.last_time) for m in growing.commits(spark, root)}
    assert by == {"a": (5, "2026-01-01T00:00:00", "2026-01-01T00:00:04"), "b": (3, "2026-01-02T00:00:00", "2026-01-02T00:00:02"), "none": (0, None, None)}
    with pytest.raises(ValueError, match="batch names"):
        growing.append(log(spark, 1, 1), root, "../a")


def test_files_without_a_manifest_do_not_count(spark, tmp_path):
    root = str(tmp_path / "t")
    log(spark, 1, 7).write.parquet(f"{root}/data/a-left-behind")  # a job that failed before its manifest
    assert growing.read(spark, root, LOG).count() == 0
    assert growing.append(log(spark, 1, 5), root, "a", "timestamp")
    assert growing.read(spark, root, LOG).count() == 5
    m = growing.commits(spark, root)[0]
    log(spark, 3, 4).coalesce(1).write.mode("append").parquet(f"{root}/data/{m.folder}")  # nor do further files of its folder
    assert growing.read(spark, root, LOG).count() == 5
    os.remove(f"{root}/data/{m.folder}/{m.parts[0]}")
    with pytest.raises(growing.BrokenTable):
        growing.read(spark, root, LOG)


def test_two_jobs_that_commit_one_batch_at_once(spark, tmp_path):
    root = str(tmp_path / "t")
    growing.append(log(spark, 1, 5), root, "a", "timestamp")
    growing.append(log(spark, 2, 3), root, "twin", "timestamp")
    twin = growing.commits(spark, root, "twin")[0]
    late = spark.createDataFrame([("a", f"z-{twin.folder}", twin.parts, 3, twin.first_time, twin.last_time)], growing.MANIFEST)
    late.coalesce(1).write.mode("append").json(f"{root}/commits/a")
    assert [m.n_rows for m in growing.commits(spark, root, "a")] == [5]


def test_the_newest_rows_open_the_last_batches(spark, tmp_path):
    root = str(tmp_path / "t")
    for day in range(1, 7):
        growing.append(log(spark, day, 4, f"{day}-"), root, f"d{day}", "timestamp")
    growing.append(log(spark, 5, 2, "late-"), root, "late", "timestamp")  # overlaps day 5
    all_rows = growing.read(spark, root, LOG).orderBy(F.desc("timestamp"), "query")
    for n in (1, 4, 5, 9, 100):
        assert growing.newest(spark, root, LOG, "timestamp", n, "query").collect() == all_rows.limit(n).collect()
    opened = {f.split("/data/")[1].split("-")[0] for f in growing.newest(spark, root, LOG, "timestamp", 3, "query").inputFiles()}
    assert opened == {"d6"}
    opened = {f.split("/data/")[1].split("-")[0] for f in growing.newest(spark, root, LOG, "timestamp", 5, "query").inputFiles()}
    assert opened == {"d6", "d5", "late"}


def questions(spark, *rows):
    return spark.createDataFrame(list(rows), QUESTION)


def counted_answers(calls):
    def answer(fresh):
        calls.append(sorted(r.query or "" for r in fresh.collect()))
        return fresh.select(*an.KEYS, F.concat(F.lit("answer to "), "query").alias("answer"), F.lit(3).alias("num_sources"))
    return answer


def test_answers_are_kept_and_logged_once(spark, tmp_path):
    root, calls = str(tmp_path / "kept"), []
    answer = counted_answers(calls)
    first = questions(spark, (1, "rice", 5, 0.7), (2, "rice", None, None), (3, "tea", 5, 0.7))
    got = an.serve(first, root, "a", "2026-01-01", answer)
    assert sorted((r.question_id, r.answer) for r in got.collect()) == [(1, "answer to rice"), (2, "answer to rice"), (3, "answer to tea")]
    second = questions(spark, (4, "rice", 5, 0.7), (5, "rice", 9, 0.7), (6, None, 5, 0.7))
    for _ in range(2):  # the same job twice
        got = an.serve(second, root, "b", "2026-01-02", answer)
        assert sorted((r.question_id, r.answer) for r in got.collect()) == [(4, "answer to rice"), (5, "answer to rice"), (6, None)]
    assert len(calls) == 2 and calls[0] == ["rice", "tea"]
    assert an.kept_answers(spark, root).count() == 4
    history = [(r.query, r.timestamp) for r in an.kept_history(spark, root).collect()]
    assert history == [(None, "2026-01-02"), ("rice", "2026-01-02"), ("rice", "2026-01-01"), ("tea", "2026-01-01")]


def test_a_job_that_failed_before_its_log(spark, tmp_path, monkeypatch):
    root, calls = str(tmp_path / "kept"), []
    answer, plain = counted_answers(calls), an.log_queries
    asked = questions(spark, (1, "rice", 5, 0.7))

    def fails(*_):
        raise RuntimeError("lost driver")

    monkeypatch.setattr(an, "log_queries", fails)
    with pytest.raises(RuntimeError):
        an.serve(asked, root, "a", "2026-01-01", answer)
    monkeypatch.setattr(an, "log_queries", plain)
    assert an.kept_history(spark, root).count() == 0
    an.serve(asked, root, "a", "2026-01-01", answer)
    assert len(calls) == 1 and an.kept_history(spark, root).count() == 1
