"""Exact top-k against brute force, and the encoders (golden G14)."""

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.util import PythonEvalType

from agroclime.operators import vectors as v
from agroclime.operators.corpus import build_documents
from agroclime.sources.schemas import FACTS

SCHEMA = "id string, embedding array<float>, tag int"


def brute_force(questions, vectors, k):
    out = {}
    for qid, q in questions:
        scored = [(round(float(np.dot(np.float64(q), np.float64(np.float32(e)))), 10), i) for i, e, _ in vectors]
        out[qid] = [i for s, i in sorted(scored, key=lambda x: (-x[0], x[1]))[: k[qid] if isinstance(k, dict) else k]]
    return out


def collected(hits):
    out = {}
    for r in hits.orderBy("question_id", "rank").collect():
        out.setdefault(r.question_id, []).append(r.id)
    return out


def data(n, q, dim=8, copies=0, seed=1):
    rng = np.random.default_rng(seed)
    vecs = np.float32(rng.normal(size=(n, dim)))
    if copies:  # one vector repeated many times, under scattered ids
        vecs[rng.choice(n, copies, replace=False)] = vecs[0]
    rows = [(f"d{int(i):05d}", [float(x) for x in e], int(i)) for i, e in zip(rng.permutation(n), vecs)]
    asked = [(int(i), [float(x) for x in np.float32(rng.normal(size=dim))]) for i in range(q)]
    asked[0] = (0, rows[0][1])
    return rows, asked


@pytest.mark.parametrize("copies", [0, 300])
@pytest.mark.parametrize("path", ["broadcast", "index"])
def test_topk_is_brute_force(spark, copies, path):
    rows, asked = data(900, 37, copies=copies)
    vectors = spark.createDataFrame(rows, SCHEMA).repartition(5)
    questions = spark.createDataFrame(asked, "question_id bigint, embedding array<float>")
    options = {} if path == "broadcast" else {"max_questions": 5}
    hits = v.similarity_topk(questions, vectors, 7, payload=("tag",), **options)
    assert collected(hits) == brute_force(asked, rows, 7)
    assert hits.where(F.concat(F.lit("d"), F.lpad(F.col("tag").cast("string"), 5, "0")) != F.col("id")).count() == 0


def test_small_batches_and_hot_copies(spark):
    """Many Arrow batches per task: the bar carries over, ties still go to the lower id."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    try:
        rows, asked = data(600, 9, copies=400)
        vectors = spark.createDataFrame(rows, SCHEMA).coalesce(2)
        questions = spark.createDataFrame(asked, "question_id bigint, embedding array<float>")
        want = brute_force(asked, rows, 5)
        assert collected(v.similarity_topk(questions, vectors, 5)) == want
        assert collected(v.similarity_topk(questions, vectors, 5, max_questions=1)) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("options", [{}, {"max_questions": 0}])
def test_k_per_question_and_k_above_the_table(spark, options):
    rows, asked = data(6, 3)
    k = {0: 2, 1: 50, 2: 1}
    vectors = spark.createDataFrame(rows, SCHEMA)
    questions = spark.createDataFrame([(i, e, k[i]) for i, e in asked], "question_id bigint, embedding array<float>, top_k int")
    assert collected(v.similarity_topk(questions, vectors, **options)) == brute_force(asked, rows, k)


def test_equal_documents_are_all_kept(spark):
    """Ids may repeat; every row is its own hit, as in a positional index."""
    rows = [("same", [1.0, 0.0], i) for i in range(4)] + [("other", [0.0, 1.0], 9)]
    vectors = spark.createDataFrame(rows, SCHEMA).repartition(3)
    questions = spark.createDataFrame([(1, [1.0, 0.0])], "question_id bigint, embedding array<float>")
    hits = v.similarity_topk(questions, vectors, 4, payload=("tag",)).orderBy("rank").collect()
    assert [(r.id, r.tag) for r in hits] == [("same", i) for i in range(4)]


def test_no_questions_and_null_vectors(spark):
    vectors = spark.createDataFrame([("a", [1.0], 1), ("b", None, 2)], SCHEMA)
    questions = spark.createDataFrame([(1, [1.0]), (2, None)], "question_id bigint, embedding array<float>")
    assert collected(v.similarity_topk(questions, vectors, 5)) == {1: ["a"]}
    assert v.similarity_topk(questions.where("false"), vectors, 5).count() == 0


def murmur3(data, seed=42):
    mask = 0xFFFFFFFF

    def rotl(x, r):
        return ((x << r) | (x >> (32 - r))) & mask

    def mix(k):
        return rotl(k * 0xCC9E2D51 & mask, 15) * 0x1B873593 & mask

    h, end = seed, len(data) // 4 * 4
    for i in range(0, end, 4):
        h = (rotl(h ^ mix(int.from_bytes(data[i:i + 4], "little")), 13) * 5 + 0xE6546B64) & mask
    if len(data) > end:
        h ^= mix(int.from_bytes(data[end:], "little"))
    h ^= len(data)
    for shift, mult in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        h = (h ^ (h >> shift)) * mult & mask
    h ^= h >> 16
    return h - (1 << 32) if h >> 31 else h


def test_hashing_encoder_is_brute_force(spark):
    texts = ["Rice in Kerala, rice!", "wheat 2001", "Rice", "", None, "!!!"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    got = {r.i: r.embedding for r in v.embed(df, "text", v.HashingEncoder.fit(df, dim=32)).collect()}
    words = [[w for w in "".join(c if c.isalnum() else " " for c in (t or "").lower()).split()] for t in texts]
    counts = np.zeros((len(texts), 32))
    for i, ws in enumerate(words):
        for w in ws:
            counts[i, murmur3(w.encode()) % 32] += 1
    idf = np.log((len(texts) + 1) / ((counts > 0).sum(axis=0) + 1))
    weighted = counts * idf
    norms = np.linalg.norm(weighted, axis=1, keepdims=True)
    want = np.divide(weighted, norms, out=np.zeros_like(weighted), where=norms > 0)
    for i in range(len(texts)):
        assert np.allclose(got[i], want[i], atol=1e-6), texts[i]


def test_model_encoder(spark):
    def open_model():
        return lambda texts: np.array([[len(t), 1.0] for t in texts])

    df = spark.createDataFrame([(1, "abc"), (2, None)], "i int, text string")
    got = {r.i: r.embedding for r in v.embed(df, "text", v.model_encoder(open_model, batch=1)).collect()}
    assert np.allclose(got[1], np.array([3, 1]) / np.sqrt(10)) and np.allclose(got[2], [0, 1])


def test_hash_model_sums_a_batch_at_once(spark):
    """The bytes of a word-by-word sum; texts and vectors pass between Spark and the model as Arrow arrays."""
    texts = [f"In {1990 + i % 30}, the District D{i % 900} of État {i % 25} reported {i * 7919 % 100_003} tonnes; yield {i % 50}.{i % 97:02d}\n-- recorded" for i in range(4096)]
    texts += ["", "...", "é", "A" * 5000, "z Z\x00z"]
    model, known = v.HashModel(v.HashModel.content(64)), {}

    def placed(word):
        if word not in known:
            digest = hashlib.md5(word).hexdigest()
            known[word] = int(digest[:8], 16) % 64, 1 if digest[8] < "8" else -1
        return known[word]

    def summed(texts):
        out = np.zeros((len(texts), 64))
        for row, text in zip(out, texts, strict=True):
            for word in re.findall(rb"[0-9a-z]+", text.encode().lower()):
                at, sign = placed(word)
                row[at] += sign
        return out * model.weights

    got = np.concatenate([model(texts[i : i + 256]) for i in range(0, len(texts), 256)])
    assert got.tobytes() == summed(texts).tobytes() and model([]).shape == (0, 64)

    df = spark.createDataFrame([(t,) for t in texts[:300]], "text string")
    coded = v.embed(df, "text", v.model_encoder(lambda: v.HashModel(v.HashModel.content(64))))
    assert f", {PythonEvalType.SQL_SCALAR_ARROW_ITER_UDF}" in coded._jdf.queryExecution().executedPlan().toString()


def test_model_with_too_few_rows_is_an_error(spark):
    df = spark.createDataFrame([(str(i),) for i in range(5)], "text string").coalesce(1)
    with pytest.raises(Exception, match="4 rows for 5 texts"):
        v.embed(df, "text", v.model_encoder(lambda: lambda texts: np.ones((len(texts) - 1, 2)))).collect()


def test_retrieve_is_brute_force(spark):
    rows = [(s, d, y, c, float(i), 1.0, 2.0) for i, (s, d, y, c) in enumerate(
        (s, d, y, c) for s in ("Kerala", "Punjab") for d in ("D1", "D2") for y in (2001, 2002) for c in ("Rice", "Wheat"))]
    docs = build_documents(spark.createDataFrame(rows, FACTS), "t")
    encoder = v.HashingEncoder.fit(docs, dim=64)
    vectors = v.embed(docs, "text", encoder)
    questions = spark.createDataFrame([(1, "rice in Kerala 2001"), (2, "Punjab D2")], "question_id bigint, query string")
    coded = [(r.question_id, r.embedding) for r in v.embed(questions, "query", encoder).collect()]
    stored = [(r.id, r.embedding, 0) for r in vectors.collect()]
    hits = v.retrieve(questions, vectors, encoder, 6)
    assert collected(hits) == brute_force(coded, stored, 6)
    best = hits.where("question_id = 1 and rank = 1").collect()[0]
    assert (best.metadata.state, best.metadata.crop, best.metadata.year) == ("Kerala", "Rice", 2001)


def test_attach_documents(spark):
    hits = spark.createDataFrame([(1, 1, "a")], "question_id int, rank int, id string")
    docs = spark.createDataFrame([("a", "x"), ("b", "y")], "id string, text string")
    assert [r.text for r in v.attach_documents(hits, docs).collect()] == ["x"]


def test_vectors_are_shown_by_column_not_by_component(spark):
    """Millionths with halves away from zero as SQL rounds them, made a batch at a time; empty and null vectors too."""
    from agroclime.plans.catalog import _shown

    rows = [(1, [0.5, -0.25, 0.0, -0.0]), (2, [1.5 / (1 << 20), -0.0000005, 1e-9, -1.0]), (3, []), (4, None), (5, [0.1, 0.3333333, 2.5 / (1 << 7), 123.456])]
    df = spark.createDataFrame(rows, "k int, embedding array<float>").coalesce(1)
    shown = df.select("k", _shown().alias("s"))
    assert "ArrowEvalPython" in shown._jdf.queryExecution().executedPlan().toString()
    plainly = F.array_join(F.transform("embedding", lambda x: F.round(x.cast("double") * 1e6).cast("bigint").cast("string")), ",")
    assert shown.collect() == df.select("k", plainly.alias("s")).collect()
