"""Exact nearest vectors with pruning: vectors are stored by pivot and distance, and cells that cannot win are not read.

Every vector belongs to its nearest pivot and, by its distance to it, to a shell of that pivot; a pivot's shell is a
cell. From a question's distance to the pivot, the shell's least and largest distance and the largest length in it, the
triangle inequality bounds every inner product in the cell. The best cells of a question are scored first, until they
hold k vectors; their k-th best score rules out all cells whose bound is below. What is left is scored against that bar:
questions with like best cells form a block, each cell goes once to every block with a question that it may serve, and
there only to such questions. So what is moved grows with the vectors times the blocks, not with the pairs of questions
and cells, although vectors without clusters leave nothing out.

Only keys and vectors are scored; documents join the winners by row number, so that each hit finds exactly one document
although ids may repeat. Numbers of pivots and cells do not grow beyond ``PIVOTS`` and ``CELLS``, so their table is
known on the driver; a cell of any size is dealt into lanes of at most ``LANE`` vectors. A task holds one lane and a page
of questions, or one block of questions and ``CHUNK`` vectors of a cell.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from agroclime.operators.vectors import SCORE_SLACK, _matrix, _pair_scores
from agroclime.sources.scratch import as_table

# The code of this module travels with the tasks, so workers need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

PIVOTS = 256
CELLS = 4096
CELL_ROWS = 256        # cells are not made smaller than this on average
SAMPLE = 8192          # vectors on which pivots are fitted at most, those with the smallest row hashes
LANE = 16_384
PAGE = 512             # questions of a lane scored at a time, and those whose bounds are held at a time; a multiple of 8
BLOCK = 32_768         # questions of a block at most, on average
BLOCKS = 24            # blocks at least, unless that leaves them fewer than BLOCK_ROWS questions
BLOCK_ROWS = 1024
BLOCK_HITS = 1 << 20   # hits that a block's questions ask for at most, on average
CHUNK = 2048           # vectors of a cell scored at a time
TILE = 1 << 19         # scores held at a time
PAIRS = 1 << 16        # pairs scored one by one at a time
SLACK = 1e-6           # of the lengths' product: bounds are safe against rounding


# --------------------------------------------------------------------- pivots

def fit_pivots(vectors: np.ndarray, many: int, rounds: int = 10) -> np.ndarray:
    """k-means from spread-out starts; the same vectors give the same pivots."""
    first = int(np.argmax(((vectors - vectors.mean(axis=0)) ** 2).sum(axis=1)))
    picked = [first]
    far = ((vectors - vectors[first]) ** 2).sum(axis=1)
    while len(picked) < many and far.max() > 0:
        picked.append(int(np.argmax(far)))
        far = np.minimum(far, ((vectors - vectors[picked[-1]]) ** 2).sum(axis=1))
    pivots = vectors[picked].copy()
    for _ in range(rounds):
        own = np.argmin((pivots ** 2).sum(axis=1) - 2 * vectors @ pivots.T, axis=1)
        for i in range(len(pivots)):
            if (own == i).any():
                pivots[i] = vectors[own == i].mean(axis=0)
    return pivots


def _distances(vectors: np.ndarray, pivots: np.ndarray, own: np.ndarray) -> np.ndarray:
    return np.sqrt(((vectors - pivots[own]) ** 2).sum(axis=1))


def _assigned(rows: DataFrame, pivots: np.ndarray, schema: T.StructType) -> DataFrame:
    """Rows with their pivot, the distance to it and the vector's length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = _matrix(batch.column(batch.schema.get_field_index("vec")))
            own = np.argmin((pivots ** 2).sum(axis=1) - 2 * m @ pivots.T, axis=1) if len(m) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(own.astype(np.int32)), pa.array(_distances(m, pivots, own)), pa.array(np.sqrt((m ** 2).sum(axis=1)))],
                names=[*batch.schema.names, "pivot", "distance", "length"])

    added = [T.StructField("pivot", T.IntegerType()), T.StructField("distance", T.DoubleType()), T.StructField("length", T.DoubleType())]
    return rows.mapInArrow(run, T.StructType([*schema.fields, *added]))


# ---------------------------------------------------------------------- index

@dataclass
class _Bounds:
    pivots: np.ndarray
    cells: np.ndarray

    def __call__(self, questions: np.ndarray) -> np.ndarray:
        """(questions, cells): no vector of the cell has a larger inner product with the question."""
        size = np.sqrt((questions ** 2).sum(axis=1))[:, None]
        at = self.cells[:, 1].astype(np.int64)
        near, far, longest = self.cells[:, 2], self.cells[:, 3], self.cells[:, 4]
        inner = questions @ self.pivots.T
        apart = np.sqrt(np.maximum(0, size ** 2 + (self.pivots ** 2).sum(axis=1) - 2 * inner))[:, at]
        gap = np.maximum(0, np.maximum(apart - far, near - apart) - SLACK * (size + longest))
        best = np.minimum(inner[:, at] + size * far, size * longest)
        best = np.minimum(best, (size ** 2 + longest ** 2 - gap ** 2) / 2)
        return best + SLACK * size * longest + SLACK


@dataclass
class VectorIndex:
    """Stored keys (cell, lane, row, id, vec), documents by row, and the table of cells."""

    spark: SparkSession
    path: str
    key_schema: T.StructType
    document_schema: T.StructType
    pivots: np.ndarray   # (pivots, width)
    cells: np.ndarray    # one row per cell: cell, pivot, least and largest distance, largest length, rows

    @property
    def keys(self) -> DataFrame:
        return self.spark.read.schema(self.key_schema).parquet(f"{self.path}/keys")

    @property
    def documents(self) -> DataFrame:
        return self.spark.read.schema(self.document_schema).parquet(f"{self.path}/documents")

    @property
    def n_rows(self) -> int:
        return int(self.cells[:, 5].sum())

    def lanes(self) -> np.ndarray:
        return np.maximum(1, -(-self.cells[:, 5].astype(np.int64) // LANE))


def write_index(vectors: DataFrame, path: str, id_col: str = "id", vec_col: str = "embedding", payload: Sequence[str] = ()) -> VectorIndex:
    """Stores the vectors by cell, and ids and ``payload`` by row. Rows without a vector are left out."""
    spark = vectors.sparkSession
    rows = vectors.where(F.col(vec_col).isNotNull()).select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(vec_col).alias("vec"), *[F.col(c).alias(f"p_{c}") for c in payload])
    numbered = as_table(rows, "numbered")
    key = numbered.select("row", "id", "vec")
    sample = key.orderBy(F.xxhash64("row"), "row").limit(SAMPLE).select("vec").toArrow()
    key_schema = T.StructType([T.StructField("cell", T.IntegerType()), T.StructField("lane", T.IntegerType()), *key.schema.fields])
    documents = numbered.drop("vec").toDF("row", id_col, *payload)
    documents.write.parquet(f"{path}/documents")
    if not sample.num_rows:
        spark.createDataFrame([], key_schema).write.parquet(f"{path}/keys")
        return VectorIndex(spark, path, key_schema, documents.schema, np.zeros((0, 0)), np.zeros((0, 6)))
    n_cells = min(CELLS, max(1, key.count() // CELL_ROWS))
    pivots = fit_pivots(_matrix(sample.column("vec")), min(PIVOTS, max(1, round(2 * n_cells ** 0.5))))
    shells = max(1, n_cells // len(pivots))
    placed = as_table(_assigned(key, pivots, key.schema), "assigned")
    shares = [i / shells for i in range(1, shells)]
    cuts = {  # one row per pivot
        r.pivot: sorted(set(r.cuts or [])) for r in placed.groupBy("pivot").agg(
            (F.percentile_approx("distance", shares, 1000) if shares else F.lit(None).cast("array<double>")).alias("cuts")).collect()}
    table = spark.createDataFrame([(p, c) for p, c in cuts.items()], "pivot int, cuts array<double>")
    cell = (F.col("pivot") * shells + F.size(F.filter("cuts", lambda c: c < F.col("distance")))).cast("int")
    celled = placed.join(F.broadcast(table), "pivot").withColumn("cell", cell)  # at most PIVOTS rows
    seen = celled.groupBy("cell", "pivot").agg(
        F.min("distance").alias("near"), F.max("distance").alias("far"), F.max("length").alias("longest"), F.count("*").alias("n"))
    cells = np.array(sorted(tuple(r) for r in seen.collect()), np.float64)  # one row per cell
    index = VectorIndex(spark, path, key_schema, documents.schema, pivots, cells)
    lanes = spark.createDataFrame(list(zip(cells[:, 0].astype(int).tolist(), index.lanes().tolist(), strict=True)), "cell int, lanes int")
    (
        celled.join(F.broadcast(lanes), "cell")  # at most CELLS rows
        .withColumn("lane", F.pmod(F.xxhash64("row"), F.col("lanes")).cast("int"))
        .repartitionByRange("cell", "lane").sortWithinPartitions("cell", "lane", "row")
        .select(key_schema.names).write.parquet(f"{path}/keys")
    )
    return index


# --------------------------------------------------------------------- search

def _seeds(bound: np.ndarray, rows: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(each question's best cell, its seeds): its best cells, up to the one that makes k rows."""
    home = np.where(np.isnan(bound), -np.inf, bound).argmax(axis=1)
    seeds = np.zeros(bound.shape, bool)
    seeds[np.arange(len(home)), home] = True
    short = np.flatnonzero(rows[home] < k)
    order = np.argsort(-bound[short], axis=1, kind="stable")
    held = np.cumsum(rows[order], axis=1)
    chosen = np.zeros(order.shape, bool)
    np.put_along_axis(chosen, order, (held - rows[order]) < k[short, None], axis=1)
    seeds[short] = chosen
    return home, seeds


def _pairs(asked: DataFrame, index: VectorIndex) -> DataFrame:
    """Questions with the cells and lanes that are their seeds, and with their best cell (home)."""
    bounds = _Bounds(index.pivots, index.cells)
    cells, lanes, rows = index.cells[:, 0].astype(np.int32), index.lanes(), index.cells[:, 5]
    at_k, at_vec = asked.columns.index("top_k"), asked.columns.index("vec")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, PAGE):
                batch = whole.slice(start, PAGE)
                home, seeds = _seeds(bounds(_matrix(batch.column(at_vec))), rows, batch.column(at_k).to_numpy())
                q, c = np.nonzero(seeds)
                again = np.repeat(np.arange(len(q)), lanes[c])
                lane = np.arange(len(again)) - np.repeat(np.cumsum(lanes[c]) - lanes[c], lanes[c])
                for a in range(0, len(again), 8 * PAGE):
                    part = again[a:a + 8 * PAGE]
                    picked = batch.take(pa.array(q[part]))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(cells[c[part]]), pa.array(lane[a:a + 8 * PAGE].astype(np.int32)), pa.array(cells[home[q[part]]]), *picked.columns],
                        names=["cell", "lane", "home", *batch.schema.names])

    added = [T.StructField(c, T.IntegerType()) for c in ("cell", "lane", "home")]
    return asked.mapInArrow(run, T.StructType([*added, *asked.schema.fields]))


class _Stored:
    """Stored rows by id and row, nulls first, without the copies of a vector beyond its first ``most``."""

    def __init__(self, rows: pa.Table, most: int):
        rows = rows.take(pc.sort_indices(rows, sort_keys=[("id", "ascending"), ("row", "ascending")], null_placement="at_start"))
        self.exact = _matrix(rows.column("vec"))
        self.rows = rows.select(["id", "row"]).combine_chunks()
        copies = self._copies(most) if len(self.exact) > most else np.zeros(0, np.int64)
        if len(copies):
            rest = np.delete(np.arange(len(self.exact)), copies)
            self.exact, self.rows = self.exact[rest], self.rows.take(pa.array(rest))
        self.longest = float(np.sqrt((self.exact ** 2).sum(axis=1)).max(initial=0))
        self.rough = self.exact.astype(np.float32) if self.longest < 1e18 else None

    def _copies(self, most: int) -> np.ndarray:
        """Positions of vectors that equal ``most`` vectors before them: no question can want them."""
        bits = self.exact.view(np.uint64)
        mix = (bits ^ (bits >> np.uint64(29))) @ (np.arange(1, bits.shape[1] + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) | np.uint64(1))
        _, first, group = np.unique(mix, return_index=True, return_inverse=True)
        if len(first) == len(mix):
            return np.zeros(0, np.int64)
        same = np.flatnonzero((bits == bits[first[group]]).all(axis=1))  # a vector that only its digest joins to others stays
        same = same[np.argsort(group[same], kind="stable")]
        starts = np.searchsorted(group[same], np.arange(len(first)))
        return same[np.arange(len(same)) - starts[group[same]] >= most]


class _Best:
    """The best k rows seen so far for each question of a page or block.

    A product in single precision screens the rows; pairs that may pass the question's bar, its k-th best score so far,
    are scored one by one in double precision.
    """

    def __init__(self, matrix: np.ndarray, k: np.ndarray, bar: np.ndarray):
        self.exact, self.k, self.bar = matrix, k.astype(np.int64), bar.astype(np.float64)
        self.length = np.sqrt((matrix ** 2).sum(axis=1))
        self.rough = matrix.astype(np.float32) if self.length.max(initial=0) < 1e18 else None
        self.q, self.score, self.rows, self.held = [], [], [], 0
        self.most = max(TILE, 4 * int(self.k.sum()))

    def add(self, stored: _Stored, which: np.ndarray | None = None) -> None:
        """``which``: the questions that the rows may serve, if not all."""
        n, many = len(stored.exact), len(self.k) if which is None else len(which)
        step = max(1, TILE // max(1, n))
        fast = self.rough is not None and stored.rough is not None
        asked, vectors = (self.rough, stored.rough) if fast else (self.exact, stored.exact)
        off = SCORE_SLACK + (4 + asked.shape[1]) * 2.0 ** -23 * fast
        q, at, score, held = [], [], [], 0
        for start in range(0, many if n else 0, step):
            part = slice(start, min(many, start + step)) if which is None else which[start:start + step]
            rough, k = asked[part] @ vectors.T, self.k[part]
            slack = SCORE_SLACK + off * self.length[part] * stored.longest
            low = self.bar[part] - slack
            if np.isneginf(low).any():  # no k-th best yet: take these rows' own
                low = np.maximum(low, self._own(rough, k, slack))
            found = np.flatnonzero(rough >= self._below(low, rough)[:, None])
            if len(found) > 4 * int(k.sum()):
                found = np.flatnonzero(rough >= self._below(np.maximum(low, self._own(rough, k, slack)), rough)[:, None])
            for a in range(0, len(found), PAIRS):
                i, j = np.divmod(found[a:a + PAIRS], n)
                i = i + start if which is None else part[i]
                exact = _pair_scores(self.exact[i], stored.exact[j])
                keep = exact >= self.bar[i] - SCORE_SLACK
                q.append(i[keep])
                at.append(j[keep])
                score.append(exact[keep])
                held += len(q[-1])
            if self.held + held > self.most:
                self._keep(q, at, score, stored)
                self.compact()
                q, at, score, held = [], [], [], 0
        self._keep(q, at, score, stored)

    @staticmethod
    def _own(rough: np.ndarray, k: np.ndarray, slack: np.ndarray) -> np.ndarray:
        """What the k best of these rows reach for each question, with twice the slack; -inf if they are fewer."""
        depth = int(k.max())
        if rough.shape[1] < depth:
            return np.full(len(k), -np.inf)
        cut = rough.shape[1] - depth
        return np.partition(rough, cut, axis=1)[:, cut] - 2 * slack

    @staticmethod
    def _below(low: np.ndarray, rough: np.ndarray) -> np.ndarray:
        return np.nextafter(low.astype(rough.dtype), rough.dtype.type(-np.inf))

    def _keep(self, q: list, at: list, score: list, stored: _Stored) -> None:
        if sum(map(len, q)):
            self.q.append(np.concatenate(q))
            self.score.append(np.concatenate(score))
            self.rows.append(stored.rows.take(pa.array(np.concatenate(at))))
            self.held += len(self.q[-1])

    def compact(self) -> None:
        if not self.held:
            return
        q, score, rows = np.concatenate(self.q), np.concatenate(self.score), pa.concat_tables(self.rows).combine_chunks()
        ids = pc.rank(rows.column("id"), sort_keys="ascending", null_placement="at_start", tiebreaker="dense").to_numpy()
        order = np.lexsort((rows.column("row").to_numpy(), ids, -score, q))
        q, score = q[order], score[order]
        place = np.arange(len(q)) - np.searchsorted(q, np.arange(len(self.k)))[q]
        last = place == self.k[q] - 1
        self.bar[q[last]] = score[last]
        keep = place < self.k[q]
        self.q, self.score, self.rows = [q[keep]], [score[keep]], [rows.take(pa.array(order[keep]))]
        self.held = int(keep.sum())

    def result(self, questions: pa.Table) -> Iterator[pa.RecordBatch]:
        """``questions``: question_id and top_k, in the matrix's order."""
        self.compact()
        if not self.held:
            return
        asked, rows = questions.select(["q", "question_id", "top_k"]).take(pa.array(self.q[0])), self.rows[0]
        table = pa.table({**{c: asked.column(c) for c in asked.column_names}, "score": self.score[0], "id": rows.column("id"), "row": rows.column("row")})
        yield from table.combine_chunks().to_batches(max_chunksize=10_000)


MET = ["part", "lane", "row", "id", "vec", "q", "question_id", "top_k", "bar"]


def _shaped(df: DataFrame, index: VectorIndex, asked: DataFrame) -> DataFrame:
    """Stored rows or questions with the columns of both."""
    kind = {**{f.name: f.dataType for f in (*index.key_schema.fields, *asked.schema.fields)}, "part": T.IntegerType(), "bar": T.DoubleType()}
    return df.select(*[F.col(c) if c in df.columns else F.lit(None).cast(kind[c]).alias(c) for c in MET])


def _found_schema(index: VectorIndex, asked: DataFrame) -> T.StructType:
    return T.StructType([
        *[asked.schema[c] for c in ("q", "question_id", "top_k")], T.StructField("score", T.DoubleType()),
        T.StructField("id", index.key_schema["id"].dataType), T.StructField("row", T.LongType())])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, bool, pa.Table]]:
    """(part, lane, whether stored rows, rows): runs of rows that agree in these."""
    for batch in batches:
        part, lane = (batch.column(i).fill_null(-1).to_numpy() for i in (0, 1))
        stored = batch.column(MET.index("row")).is_valid().to_numpy(zero_copy_only=False)
        turns = (part[1:] != part[:-1]) | (lane[1:] != lane[:-1]) | (stored[1:] != stored[:-1])
        cuts = [0, *(np.flatnonzero(turns) + 1).tolist(), batch.num_rows]
        table = pa.Table.from_batches([batch])
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a < b:
                yield int(part[a]), int(lane[a]), bool(stored[a]), table.slice(a, b - a)


def _scored(pairs: DataFrame, index: VectorIndex, most: int) -> DataFrame:
    """(q, question_id, top_k, score, id, row): each lane's best rows for the questions that have it as a seed."""
    wanted = [r.cell for r in pairs.select("cell").distinct().collect()]  # at most CELLS numbers
    keys = index.keys.filter(F.col("cell").isin(wanted)) if len(wanted) < len(index.cells) else index.keys
    met = _shaped(keys.withColumnRenamed("cell", "part"), index, pairs).unionAll(_shaped(pairs.withColumnRenamed("cell", "part"), index, pairs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, lane, stored, page = None, [], None, []

        def asked() -> Iterator[pa.RecordBatch]:
            if stored is not None and page:
                questions = pa.concat_tables(page)
                best = _Best(_matrix(questions.column("vec")), questions.column("top_k").to_numpy(), np.full(questions.num_rows, -np.inf))
                best.add(stored)
                yield from best.result(questions)

        for part, number, is_stored, rows in _runs(batches):
            if (part, number) != key:
                yield from asked()
                key, lane, stored, page = (part, number), [], None, []
            if is_stored:
                lane.append(rows)
                continue
            if lane:
                stored, lane = _Stored(pa.concat_tables(lane), most), []
            for start in range(0, rows.num_rows, PAGE):
                page.append(rows.slice(start, PAGE))
                if sum(p.num_rows for p in page) >= PAGE:
                    yield from asked()
                    page = []
        yield from asked()

    return met.repartition("part", "lane").sortWithinPartitions("part", "lane", F.col("row").asc_nulls_last()).mapInArrow(run, _found_schema(index, pairs))


def _ranked(found: DataFrame, by: str) -> DataFrame:
    order = Window.partitionBy(by).orderBy(F.desc("score"), "id", "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= F.col("top_k"))


def _asked(questions: DataFrame, k: int | None, question_id: str, question_vec: str) -> DataFrame:
    """The questions, stored with numbers (q) of their own."""
    return as_table(questions.where(F.col(question_vec).isNotNull()).select(
        F.monotonically_increasing_id().alias("q"),
        F.col(question_id).alias("question_id"),
        (F.lit(k) if k is not None else F.col("top_k")).cast("int").alias("top_k"),
        F.col(question_vec).alias("vec"),
    ).where("top_k > 0"), "asked")


def _seeded(asked: DataFrame, index: VectorIndex, most: int) -> tuple[DataFrame, DataFrame]:
    """(what the seeds give, questions with their best cell and their bar)."""
    pairs = as_table(_pairs(asked, index), "seeds")
    seeds = as_table(_ranked(_scored(pairs, index, most), "q"), "seed-hits")
    # The k-th best of the seeds; a question whose seeds are fewer than k rows has met every cell, and has no bar.
    bars = seeds.where(F.col("rank") == F.col("top_k")).select("q", F.col("score").alias("bar"))
    return seeds, pairs.where("cell = home and lane = 0").drop("cell", "lane").join(bars, "q", "left")


def _blocked(barred: DataFrame, most_hits: int) -> tuple[DataFrame, int]:
    """(questions with their block, number of blocks): blocks of like size, of questions with the same or adjoining best cells."""
    spark = barred.sparkSession
    sizes = sorted(tuple(r) for r in barred.groupBy("home").count().collect())  # at most CELLS rows
    total = sum(n for _, n in sizes)
    blocks = max(min(BLOCKS, -(-total // BLOCK_ROWS)), -(-total // BLOCK), -(-most_hits // BLOCK_HITS), 1)
    starts = np.cumsum([0, *[n for _, n in sizes]]).tolist()
    table = spark.createDataFrame([(h, s, n) for (h, n), s in zip(sizes, starts, strict=False)], "home int, start long, n long")
    at = F.col("start") + F.col("n") * F.pmod(F.xxhash64("q"), F.lit(1 << 20)) / float(1 << 20)
    block = F.least(F.floor(at * blocks / max(1, total)), F.lit(blocks - 1)).cast("int")
    return barred.join(F.broadcast(table), "home").withColumn("block", block).drop("home", "start", "n"), blocks


def _reached(barred: DataFrame, index: VectorIndex, blocks: int) -> DataFrame:
    """(part, cell): the blocks that a cell goes to, as a question's bound of it reaches the question's bar."""
    bounds, cells = _Bounds(index.pivots, index.cells), index.cells[:, 0].astype(np.int32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reached = np.zeros((blocks, len(cells)), bool)
        for whole in batches:
            for start in range(0, whole.num_rows, PAGE):
                block, vec, bar = whole.slice(start, PAGE).columns
                near = bounds(_matrix(vec)) >= bar.to_numpy()[:, None]
                for b in np.unique(block):
                    reached[b] |= near[block.to_numpy() == b].any(axis=0)
        b, c = np.nonzero(reached)
        yield pa.RecordBatch.from_arrays([pa.array(b.astype(np.int32)), pa.array(cells[c])], names=["part", "cell"])

    return barred.select("block", "vec", "bar").mapInArrow(run, "part int, cell int").distinct()


def _searched(barred: DataFrame, index: VectorIndex, blocks: int, most: int) -> DataFrame:
    """(q, question_id, top_k, score, id, row): the best k rows of each question, from all cells that its bar leaves."""
    reached = as_table(_reached(barred, index, blocks), "reached")
    keys = index.keys.drop("lane").join(F.broadcast(reached), "cell").withColumnRenamed("cell", "lane")  # at most CELLS rows a block
    met = _shaped(barred.withColumnRenamed("block", "part"), index, barred).unionAll(_shaped(keys, index, barred))
    bounds, place = _Bounds(index.pivots, index.cells), {int(c): i for i, c in enumerate(index.cells[:, 0])}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, page, best, questions, wants, cell, chunk = None, [], None, None, None, None, []

        def start() -> None:
            nonlocal best, questions, wants, page
            questions = pa.concat_tables(page)
            matrix, bar = _matrix(questions.column("vec")), questions.column("bar").to_numpy()
            best, questions, page = _Best(matrix, questions.column("top_k").to_numpy(), bar), questions.select(["q", "question_id", "top_k"]), []
            wants = np.concatenate([  # by cell, a bit for each question
                np.packbits((bounds(matrix[a:a + PAGE]) >= bar[a:a + PAGE, None]).T, axis=1) for a in range(0, len(bar), PAGE)], axis=1)

        def score() -> None:
            nonlocal chunk
            if chunk and best is not None:
                which = np.flatnonzero(np.unpackbits(wants[place[cell]], count=len(best.k)))
                best.add(_Stored(pa.concat_tables(chunk), most), which if len(which) < len(best.k) else None)
            chunk = []

        for part, at, is_stored, rows in _runs(batches):
            if part != key or at != cell:
                score()
            if part != key:
                if best is not None:
                    yield from best.result(questions)
                key, page, best = part, [], None
            cell = at
            if not is_stored:
                page.append(rows)
                continue
            if page:
                start()
            for a in range(0, rows.num_rows, CHUNK):
                chunk.append(rows.slice(a, CHUNK))
                if sum(c.num_rows for c in chunk) >= CHUNK:
                    score()
        score()
        if best is not None:
            yield from best.result(questions)

    dealt = met.repartitionById(blocks, "part").sortWithinPartitions("part", F.col("lane").asc_nulls_first())
    return dealt.mapInArrow(run, _found_schema(index, barred))


def pruned_topk(
    questions: DataFrame, index: VectorIndex, k: int | None = None, *, question_id: str = "question_id", question_vec: str = "embedding",
) -> DataFrame:
    """The exact best ``k`` stored vectors by inner product for every question, with their documents.

    Returns (question_id, rank, similarity_score, and the index's id and payload columns). ``k`` may be a number or, if
    None, the questions' ``top_k``. Ties go to the lower id, then to the row stored first; question ids are unique.
    """
    asked = _asked(questions, k, question_id, question_vec)
    documents = index.documents
    most, hits = asked.agg(F.max("top_k"), F.sum(F.col("top_k").cast("long"))).first()
    if not index.n_rows or most is None:
        none = documents.where("false").withColumns({"rank": F.lit(1), "similarity_score": F.lit(0.0)})
        return none.join(asked.select("question_id"), F.lit(True)).select("question_id", "rank", "similarity_score", *[c for c in documents.columns if c != "row"])
    seeds, homes = _seeded(asked, index, most)
    barred, blocks = _blocked(as_table(homes.where(F.col("bar").isNotNull()), "barred"), hits)
    barred = as_table(barred, "blocks")
    columns = ["question_id", "top_k", "score", "id", "row"]
    found = seeds.join(barred.select("q"), "q", "left_anti").select(columns)  # these met every cell
    if not barred.isEmpty():
        found = found.unionAll(_searched(barred, index, blocks, most).select(columns))
    hits = _ranked(found, "question_id").select("question_id", "rank", F.col("score").alias("similarity_score"), "row")
    return hits.join(documents, "row").drop("row")


def _counted(homes: DataFrame, index: VectorIndex, each: bool) -> DataFrame:
    """(question_id, cells_scored, vectors_scored), or, ``each``, (question_id, cell) of the cells scored."""
    bounds, cells, rows = _Bounds(index.pivots, index.cells), index.cells[:, 0].astype(np.int32), index.cells[:, 5]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, PAGE):
                ids, k, vec, bar = whole.slice(start, PAGE).columns
                bound = bounds(_matrix(vec))
                scored = _seeds(bound, rows, k.to_numpy())[1] | (bound >= bar.to_numpy(zero_copy_only=False)[:, None])  # no bar: NaN
                if each:
                    q, c = np.nonzero(scored)
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(q)), pa.array(cells[c])], names=["question_id", "cell"])
                else:
                    yield pa.RecordBatch.from_arrays(
                        [ids, pa.array(scored.sum(axis=1)), pa.array((scored @ rows).astype(np.int64))], names=["question_id", "cells_scored", "vectors_scored"])

    names = [("cell", T.IntegerType())] if each else [("cells_scored", T.LongType()), ("vectors_scored", T.LongType())]
    return homes.select("question_id", "top_k", "vec", "bar").mapInArrow(
        run, T.StructType([homes.schema["question_id"], *[T.StructField(*n) for n in names]]))


def prune_report(questions: DataFrame, index: VectorIndex, k: int | None = None, *, question_id: str = "question_id", question_vec: str = "embedding") -> DataFrame:
    """(question_id, cells, cells_scored, vectors, vectors_scored): what a search of the index leaves out, by question.

    Counted where the bounds are; only the cells of ids that several questions share are brought together.
    """
    asked = _asked(questions, k, question_id, question_vec)
    homes = as_table(_seeded(asked, index, asked.agg(F.max("top_k")).first()[0] or 1)[1], "homes")
    shared = homes.groupBy("question_id").count().where("count > 1").select(F.col("question_id").alias("shared"))
    sizes = index.spark.createDataFrame([(int(c[0]), int(c[5])) for c in index.cells], "cell int, n long")
    own = F.col("question_id").eqNullSafe(F.col("shared"))
    single = _counted(homes.join(shared, own, "left_anti"), index, False)
    several = _counted(homes.join(shared, own, "left_semi"), index, True).distinct().join(F.broadcast(sizes), "cell").groupBy("question_id").agg(  # at most CELLS rows
        F.count("*").alias("cells_scored"), F.sum("n").alias("vectors_scored"))
    return single.unionByName(several).select(
        "question_id", F.lit(len(index.cells)).cast("long").alias("cells"), "cells_scored", F.lit(index.n_rows).cast("long").alias("vectors"), "vectors_scored")
