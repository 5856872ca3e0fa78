"""CSV in splits against Python's csv module: quoted line breaks, encodings, headers, torn files."""

import csv
import io
import random

import pytest

from agroclime.sources import csv_files, readers


def written(rows, end="\n"):
    out = io.StringIO()
    csv.writer(out, lineterminator=end).writerows(rows)
    return out.getvalue()


def cells(seed, n, longest=6):
    r = random.Random(seed)
    made = ["plain", "Béd", "two\nlines", 'a "quote"', "x,y", "\n\nbreaks\n", '"', '""\n"', "", "日本"]
    return [[str(i), *["".join(r.choice(made) for _ in range(r.randint(0, longest))) for _ in range(3)]] for i in range(n)]


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def collected(df):
    return sorted(tuple("" if x is None else x for x in r) for r in df.collect())


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_one_file_in_many_tasks(spark, tmp_path, small_splits, end):
    rows = cells(1, 700)
    path = tmp_path / "f.csv"
    path.write_bytes(written([["i", "a b", "c", "d"], *rows], end).encode())
    blocks = csv_files.block_table(spark, str(path))
    assert blocks.count() > 10 and blocks.filter("odd").count() > 0
    df = csv_files.read_csv(spark, str(path))
    assert df.columns == ["i", "a b", "c", "d"]
    assert collected(df) == sorted(map(tuple, rows))


def test_a_cell_over_many_splits_and_batches(spark, tmp_path, small_splits):
    long = "\n".join(f"line {i} \"x\"" for i in range(3000))
    rows = [["1", "a", "b", "c"], ["2", long, "", long], ["3", "x", "y\n", "z"]]
    path = tmp_path / "f.csv"
    path.write_text(written([["i", "a", "b", "c"], *rows]))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert collected(csv_files.read_csv(spark, str(path))) == sorted(map(tuple, rows))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_encodings_and_headers_differ_by_file(spark, tmp_path, small_splits):
    rows = [[str(i), f"Béd{i}", "p\nq" if i % 3 else "ñ"] for i in range(400)]
    (tmp_path / "a.csv").write_bytes(("﻿" + written([["i", "name", "n"], *rows])).encode())
    (tmp_path / "b.csv").write_bytes(written([["name", "i"], *[[r[1], "b" + r[0]] for r in rows]]).encode("latin-1"))
    (tmp_path / "c.csv").write_bytes(b"")
    (tmp_path / "d.csv").write_bytes(b"\n\r\n\ni,name,n\n\n7,x,\n\n8,y,z")  # blank lines, no last line break
    got = collected(csv_files.read_csv(spark, str(tmp_path)).select("i", "name", "n"))
    assert got == sorted([*map(tuple, rows), *[("b" + r[0], r[1], "") for r in rows], ("7", "x", ""), ("8", "y", "z")])


def test_a_header_with_a_line_break(spark, tmp_path):
    (tmp_path / "f.csv").write_text('"State\nname",Crop,Crop,\nKerala,Rice,Tea,1\n')
    df = csv_files.read_csv(spark, str(tmp_path / "f.csv"))
    assert df.columns == ["State\nname", "Crop", "Crop.1", "_c3"] and [tuple(r) for r in df.collect()] == [("Kerala", "Rice", "Tea", "1")]


def test_torn_and_empty_files(spark, tmp_path):
    (tmp_path / "t.csv").write_text('a,b\n1,"x\n2,y\n')
    with pytest.raises(csv_files.TornFile, match="t.csv"):
        csv_files.read_csv(spark, str(tmp_path / "t.csv"))
    (tmp_path / "e.csv").write_text("")
    assert csv_files.read_csv(spark, str(tmp_path / "e.csv")).count() == 0
    (tmp_path / "h.csv").write_text("a,b\n")
    df = csv_files.read_csv(spark, str(tmp_path / "h.csv"))
    assert df.columns == ["a", "b"] and df.count() == 0
    with pytest.raises(ValueError, match="utf-16"):
        csv_files.read_csv(spark, str(tmp_path / "h.csv"), "utf-16")


def test_readers_find_the_encoding(spark, tmp_path):
    (tmp_path / "crop.csv").write_bytes(" State ,District,Crop\nOrissa,Béd,NA\n".encode("latin-1"))
    assert readers.read_crop(spark, str(tmp_path / "crop.csv")).collect()[0].asDict() == {"state": "Orissa", "district": "Béd", "crop": None}


def test_no_file_is_read_by_one_task(spark, tmp_path, small_splits):
    path = tmp_path / "f.csv"
    path.write_text(written([["a", "b"], *[[str(i), "x\ny"] for i in range(2000)]]))
    plan = csv_files.read_csv(spark, str(path))._jdf.queryExecution().toString()
    assert "multiLine" not in plan and "wholetext" not in plan
