"""Pruned search against brute force, what it leaves out, and its plan."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from agroclime.operators import vector_index as vi

SCHEMA = "id string, embedding array<float>, tag int"
ASKED = "question_id bigint, embedding array<float>"


def clustered(n, dim, groups, spread, seed=1, copies=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, dim)) * 3
    vecs = np.float32(centres[rng.integers(0, groups, n)] + spread * rng.normal(size=(n, dim)))
    if copies:
        vecs[rng.choice(n, copies, replace=False)] = vecs[0]
    asked = np.float32(centres[rng.integers(0, groups, 40)] + spread * rng.normal(size=(40, dim)))
    return vecs, asked


def tables(spark, vecs, asked):
    rows = [(f"d{i:05d}", [float(x) for x in v], i) for i, v in enumerate(vecs)]
    return (spark.createDataFrame(rows, SCHEMA).repartition(3),
            spark.createDataFrame([(i, [float(x) for x in q]) for i, q in enumerate(asked)], ASKED))


def expected(vecs, asked, k):
    exact = np.float64(asked) @ np.float64(vecs).T
    return {(q, r + 1): f"d{i:05d}" for q in range(len(asked)) for r, i in enumerate(np.lexsort((np.arange(len(vecs)), -np.round(exact[q], 9)))[:k])}


@pytest.fixture
def small_cells(monkeypatch):
    monkeypatch.setattr(vi, "CELL_ROWS", 20)
    monkeypatch.setattr(vi, "LANE", 30)
    monkeypatch.setattr(vi, "PAGE", 16)


@pytest.mark.parametrize("spread,copies,k", [(0.2, 0, 5), (3.0, 0, 5), (0.2, 700, 9), (0.2, 0, 3000)])
def test_it_is_brute_force(spark, tmp_path, small_cells, spread, copies, k):
    vecs, asked = clustered(1500, 6, 12, spread, copies=copies)
    vectors, questions = tables(spark, vecs, asked)
    index = vi.write_index(vectors, str(tmp_path / "index"), payload=("tag",))
    rows = vi.pruned_topk(questions, index, k).collect()
    assert {(r.question_id, r["rank"]): r.id for r in rows} == expected(vecs, asked, k)
    assert all(r.id == f"d{r.tag:05d}" for r in rows)


def test_clustered_vectors_leave_most_cells_out(spark, tmp_path, small_cells):
    vecs, asked = clustered(6000, 6, 30, 0.05)
    vectors, questions = tables(spark, vecs, asked)
    index = vi.write_index(vectors, str(tmp_path / "index"))
    said = vi.prune_report(questions, index, 5).agg(F.sum("vectors_scored"), F.sum("vectors"), F.sum("cells_scored"), F.sum("cells")).first()
    assert said[0] < 0.2 * said[1] and said[2] < 0.2 * said[3]


def test_bounds_hold(spark, tmp_path, small_cells):
    """No stored vector scores above its cell's bound."""
    vecs, asked = clustered(800, 5, 6, 1.0, seed=3)
    vectors, _ = tables(spark, vecs, asked)
    index = vi.write_index(vectors, str(tmp_path / "index"))
    bound = vi._Bounds(index.pivots, index.cells)(np.float64(asked))
    where = {int(c): i for i, c in enumerate(index.cells[:, 0])}
    for r in index.keys.collect():
        assert (np.float64(asked) @ np.float64(r.vec) <= bound[:, where[r.cell]]).all()


def test_repeated_ids_find_their_own_document(spark, tmp_path):
    rows = [("same", [1.0, 0.0], i) for i in range(4)] + [("other", [0.0, 1.0], 9)]
    index = vi.write_index(spark.createDataFrame(rows, SCHEMA), str(tmp_path / "index"), payload=("tag",))
    got = vi.pruned_topk(spark.createDataFrame([(1, [1.0, 0.0])], ASKED), index, 5).orderBy("rank").collect()
    assert sorted(r.tag for r in got[:4]) == [0, 1, 2, 3] and got[4].id == "other"


def test_k_per_question_null_vectors_and_empty_tables(spark, tmp_path, small_cells):
    vecs, asked = clustered(300, 4, 5, 0.5)
    vectors, _ = tables(spark, vecs, asked)
    questions = spark.createDataFrame([(0, [float(x) for x in asked[0]], 2), (1, [float(x) for x in asked[1]], 290), (2, None, 3), (3, [0.0] * 4, 2), (4, [1.0] * 4, 0)],
                                      ASKED + ", top_k int")
    index = vi.write_index(vectors.unionAll(spark.createDataFrame([("null", None, 1)], SCHEMA)), str(tmp_path / "index"))
    got = {(r.question_id, r["rank"]): r.id for r in vi.pruned_topk(questions, index).collect()}
    want = expected(vecs, asked[:2], 290)
    want = {(q, r): i for (q, r), i in want.items() if r <= (2, 290)[q]} | {(3, 1): "d00000", (3, 2): "d00001"}
    assert got == want
    empty = vi.write_index(vectors.where("false"), str(tmp_path / "empty"))
    assert vi.pruned_topk(questions, empty, 3).count() == 0
    assert vi.pruned_topk(questions.where("false"), index, 3).count() == 0


def test_vectors_are_neither_exploded_nor_joined(spark, tmp_path, small_cells):
    vecs, asked = clustered(300, 4, 5, 0.5)
    vectors, questions = tables(spark, vecs, asked)
    index = vi.write_index(vectors, str(tmp_path / "index"), payload=("tag",))
    plan = vi.pruned_topk(questions, index, 3)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "explode" not in plan.lower()


@pytest.fixture
def small_blocks(monkeypatch, small_cells):
    for name, value in {"BLOCK_ROWS": 8, "BLOCKS": 3, "BLOCK": 15, "CHUNK": 12, "TILE": 64, "PAIRS": 7}.items():
        monkeypatch.setattr(vi, name, value)


@pytest.fixture
def stored_rows(monkeypatch):
    """How many rows each stored step has."""
    seen, store = {}, vi.as_table

    def counting(df, name, *rest):
        table = store(df, name, *rest)
        seen[name] = table.count()
        return table

    monkeypatch.setattr(vi, "as_table", counting)
    return seen


def test_questions_are_not_written_once_per_cell(spark, tmp_path, small_cells, stored_rows):
    """Vectors without clusters: no cell is left out, and still no step has the questions times the cells."""
    rng = np.random.default_rng(2)
    vecs, asked = (np.float32(rng.normal(size=(n, 16))) for n in (1500, 600))
    vectors, questions = tables(spark, vecs, asked)
    index = vi.write_index(vectors, str(tmp_path / "index"))
    rows = vi.pruned_topk(questions, index, 5).collect()
    assert {(r.question_id, r["rank"]): r.id for r in rows} == expected(vecs, asked, 5)
    said = vi.prune_report(questions, index, 5).agg(F.sum("cells_scored"), F.count("*")).first()
    assert len(index.cells) > 50 and said[0] > 0.9 * 600 * len(index.cells) and said[1] == 600
    assert max(stored_rows.values()) <= 600 * 5 + 1500, stored_rows


@pytest.mark.parametrize("case", ["plain", "copies", "alike", "long"])
def test_many_blocks_are_brute_force(spark, tmp_path, small_blocks, stored_rows, case):
    """Several blocks, chunks of a cell and tiles; copies; scores closer than single precision tells apart; lengths beyond it."""
    vecs, asked = clustered(900, 6, 5, 2.0, seed=4, copies=500 * (case == "copies"))
    if case == "alike":
        vecs = np.float32(vecs[0] + 3e-7 * np.random.default_rng(5).normal(size=vecs.shape))
    if case == "long":
        vecs, asked = vecs * np.float32(1e17), asked * np.float32(1e19)
    vectors, questions = tables(spark, vecs, asked)
    index = vi.write_index(vectors, str(tmp_path / "index"))
    rows = vi.pruned_topk(questions, index, 4).collect()
    assert {(r.question_id, r["rank"]): r.id for r in rows} == expected(vecs, asked, 4)
    assert stored_rows["blocks"] == 40


def test_null_and_repeated_question_ids(spark, tmp_path, small_cells):
    """A question without an id is searched like any other; questions that share one have their hits ranked together."""
    rng = np.random.default_rng(6)
    vecs, asked = (np.float32(rng.normal(size=(n, 12))) for n in (700, 4))
    vectors, _ = tables(spark, vecs, asked)
    index = vi.write_index(vectors, str(tmp_path / "index"))
    questions = spark.createDataFrame([(i, [float(x) for x in q]) for i, q in zip([None, 1, 2, 2], asked, strict=True)], ASKED)
    exact = np.round(np.float64(asked) @ np.float64(vecs).T, 9)
    want = {(i, r + 1): s for i, scores in ((None, exact[0]), (1, exact[1]), (2, exact[2:].ravel())) for r, s in enumerate(sorted(scores, reverse=True)[:6])}
    got = {(r.question_id, r["rank"]): r.similarity_score for r in vi.pruned_topk(questions, index, 6).collect()}
    assert got == pytest.approx(want, abs=1e-9)

    single = {r.question_id: r for r in vi.prune_report(questions.withColumn("question_id", F.monotonically_increasing_id()), index, 6).collect()}
    said = {r.question_id: r for r in vi.prune_report(questions, index, 6).collect()}
    scored = sorted(r.vectors_scored for r in single.values())
    assert set(said) == {None, 1, 2} and all(len(index.cells) >= r.cells_scored and r.vectors == 700 for r in said.values())
    assert scored[0] <= said[2].vectors_scored <= 700
