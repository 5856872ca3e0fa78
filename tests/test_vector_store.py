"""The growing vector store: difference by key, repeated and failed jobs, checks on load; the model from a file."""

import hashlib
import os
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from agroclime.operators import vector_store as vs
from agroclime.operators import vectors as v
from agroclime.operators.corpus import build_documents
from agroclime.sources import growing
from agroclime.sources.schemas import FACTS


def docs(spark, *rows):
    return build_documents(spark.createDataFrame([("Kerala", "D1", y, c, p, yl, 9.0) for y, c, p, yl in rows], FACTS), "t").repartition(2)


A, B, C = (2001, "Rice", 1.0, 2.0), (2002, "Tea", 3.0, 4.0), (2003, "Wheat", 5.0, 6.0)
A_AGAIN = (2001, "Rice", 1.0, 7.0)  # the same id, another yield


def counting(spark, tmp_path, dim=16):
    """An encoder that notes every text it is given."""
    encode = v.file_encoder(spark, v.write_model(spark, str(tmp_path / f"model-{dim}"), v.HashModel.content(dim)))
    seen = []

    def run(df, text_col, out):
        seen.append(df.count())
        return encode(df, text_col, out)

    return run, seen


def rows(df):
    return sorted((r.key, r.id, r.text, tuple(r.metadata), tuple(r.embedding)) for r in df.collect())


def expected(text, dim=16):
    out = np.zeros(dim)
    for w in re.findall("[0-9a-z]+", text.lower()):
        h = hashlib.md5(w.encode()).hexdigest()
        b = int(h[:8], 16) % dim
        out[b] += (1 + b % 7) * (1 if h[8] in "01234567" else -1)
    return out / (np.linalg.norm(out) or 1)


def test_keys_are_the_same_on_every_run(spark):
    one = docs(spark, A, A, A_AGAIN, B)
    two = docs(spark, B, A_AGAIN, A, A).coalesce(1)
    keys = lambda d: sorted((r.id, r.occurrence, r.text, r.key) for r in vs.keyed_documents(d).collect())
    assert keys(one) == keys(two) and len({k[3] for k in keys(one)}) == 4
    assert sorted(k[1] for k in keys(one)) == [0, 0, 1, 2]
    assert vs.keyed_documents(one.where("false")).count() == 0


def test_two_steps_equal_one(spark, tmp_path):
    encode, seen = counting(spark, tmp_path)
    grown, whole = str(tmp_path / "grown"), str(tmp_path / "whole")
    assert vs.update_store(docs(spark, A, A, B), grown, encode, "m", 16, "one") == 3
    assert vs.update_store(docs(spark, A, A, A_AGAIN, B, C), grown, encode, "m", 16, "two") == 2
    assert vs.update_store(docs(spark, A, A, A_AGAIN, B, C), grown, encode, "m", 16, "two") == 2  # the job again
    assert vs.update_store(docs(spark, A, A, A_AGAIN, B, C), grown, encode, "m", 16, "three") == 0
    assert seen == [3, 2, 0]
    vs.update_store(docs(spark, C, B, A_AGAIN, A, A), whole, encode, "m", 16, "all")
    got = rows(vs.load_store(spark, grown, "m", 16, measure=True))
    assert got == rows(vs.load_store(spark, whole, "m", 16)) and len(got) == 5
    for _, _, text, _, vector in got:
        assert np.allclose(vector, expected(text), atol=1e-6)


def test_an_update_writes_its_corpus_and_its_vectors_once(spark, tmp_path, monkeypatch):
    """No further copy of documents or vectors is stored on the way, and a repeated job stores nothing at all."""
    encode, _ = counting(spark, tmp_path)
    root, stored, kept = str(tmp_path / "s"), [], vs.as_table
    monkeypatch.setattr(vs, "as_table", lambda df, name: stored.append((name, df.columns)) or kept(df, name))
    for batch in ("1", "1"):
        assert vs.update_store(docs(spark, A, A, B), root, encode, "m", 16, batch) == 3
    assert stored == [("corpus", ["id", "text", "metadata", "key"])]
    assert vs.update_store(docs(spark, A, B, C), root, encode, "m", 16, "2") == 1
    assert len(stored) == 2 and vs.load_store(spark, root, "m", 16).count() == 3


def test_a_document_moves_once_and_an_update_stores_what_changed(spark, tmp_path, monkeypatch):
    """Numbering takes one shuffle; known documents are not stored again, and a repeated or broken store gives the same."""
    plan = vs.keyed_documents(docs(spark, A, A, B))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    encode, seen = counting(spark, tmp_path)
    root, kept, stored = str(tmp_path / "s"), vs.as_table, []
    monkeypatch.setattr(vs, "as_table", lambda df, name: stored.append(kept(df, name)) or stored[-1])
    vs.update_store(docs(spark, A, A, B), root, encode, "m", 16, "1")
    vs.update_store(docs(spark, A, A_AGAIN, A, C), root, encode, "m", 16, "2")
    assert sorted((r.id is not None, r.text is not None, r.gone) for r in stored[1].collect()) == [(True, False, True), (True, True, False), (True, True, False)]
    whole = str(tmp_path / "whole")
    vs.update_store(docs(spark, A, A_AGAIN, A, C), whole, encode, "m", 16, "all")
    assert rows(vs.load_store(spark, root, "m", 16)) == rows(vs.load_store(spark, whole, "m", 16))
    assert seen == [3, 2, 4]
    plan = vs.load_store(spark, root, "m", 16)._jdf.queryExecution().optimizedPlan().toString()
    assert "turn" in plan and "Union" in plan  # the rows of the last turn are not compared with the removed keys


def test_documents_leave_and_come_back(spark, tmp_path):
    encode, _ = counting(spark, tmp_path)
    root = str(tmp_path / "s")
    crops = lambda: sorted(r.metadata.crop for r in vs.load_store(spark, root, "m", 16).collect())
    vs.update_store(docs(spark, A, B), root, encode, "m", 16, "1")
    vs.update_store(docs(spark, B), root, encode, "m", 16, "2")
    assert crops() == ["Tea"] and vs.store_manifest(spark, root).first().num_vectors == 1
    assert vs.update_store(docs(spark, A, B), root, encode, "m", 16, "3") == 1
    assert crops() == ["Rice", "Tea"]
    vs.update_store(docs(spark, A, B).where("false"), root, encode, "m", 16, "4")
    assert crops() == []


def test_loading_checks_the_store(spark, tmp_path):
    encode, _ = counting(spark, tmp_path)
    root = str(tmp_path / "s")
    vs.update_store(docs(spark, A, B, C), root, encode, "m", 16, "1")
    for model, dim in (("other", 16), ("m", 32)):
        with pytest.raises(vs.StoreMismatch):
            vs.load_store(spark, root, model, dim)
        with pytest.raises(vs.StoreMismatch):
            vs.update_store(docs(spark, A), root, encode, model, dim, "2")
    narrow, _ = counting(spark, tmp_path, 8)
    with pytest.raises(vs.StoreMismatch, match="not 16 wide"):
        vs.update_store(docs(spark, A, (2009, "Tea", 1.0, 1.0)), root, narrow, "m", 16, "2")
    assert growing.count(spark, f"{root}/vectors") == 3
    m = growing.commits(spark, f"{root}/vectors")[0]
    part = next(p for p in m.parts if spark.read.parquet(f"{root}/vectors/data/{m.folder}/{p}").count())
    few = vs.growing.read(spark, f"{root}/vectors", vs.STORED).limit(0).coalesce(1)
    few.write.parquet(str(tmp_path / "few"))
    new = next(f for f in os.listdir(tmp_path / "few") if f.endswith(".parquet"))
    target = f"{root}/vectors/data/{m.folder}/{part}"
    os.remove(f"{os.path.dirname(target)}/.{part}.crc")
    with open(tmp_path / "few" / new, "rb") as source, open(target, "wb") as out:
        out.write(source.read())
    with pytest.raises(vs.StoreMismatch, match="manifests name 3"):
        vs.load_store(spark, root, "m", 16)


def test_a_model_is_opened_once_per_worker_not_per_batch(spark, tmp_path):
    notes = str(tmp_path)

    def open_model():
        import os
        import uuid
        with open(f"{notes}/open-{os.getpid()}-{uuid.uuid4().hex}", "w"):
            pass
        return lambda texts: np.ones((len(texts), 2))

    df = spark.range(200).select(F.col("id").cast("string").alias("t")).coalesce(1)
    assert v.embed(df, "t", v.model_encoder(open_model, batch=8)).where("size(embedding) = 2").count() == 200
    by_worker = [f.split("-")[1] for f in os.listdir(notes) if f.startswith("open-")]
    assert len(by_worker) == len(set(by_worker))
