"""Hard negatives by shared candidate lists of anchor clusters.

Anchors are clustered by direction. For a cluster with centre c and largest angle b between c and a member, no member
u can have a larger inner product with candidate i than |u| |i| cos(max(0, angle(i, c) - b)). The candidates are
sorted by that bound once per cluster, and every member walks the same list, block by block, until its worst kept
score is above the bound of all that is left: the result is then certified to be exact. Positives (best rows of the
anchor's label) and hard negatives (best rows of other labels whose score is a given share of the positive's) are two
such walks.

Candidates are dealt into shards of at most ``SHARD_BYTES``, and the anchors, a small share of all rows, are sent to
every shard: one shuffle, no pairs of rows outside a task, and each task holds one shard and one group of at most
``GROUP`` members. Each shard has its own part of every cluster's list; the best of all shards are merged by rank.
"""

from __future__ import annotations

import sys
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from agroclime.llm.store import stored

# The code of this module travels with the tasks, so workers need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SAMPLE = 4096             # anchors on which the cluster centres are fitted at most, those with the smallest id hashes
CENTRES = 64
GROUP = 256               # members of a cluster that walk together
SHARD_BYTES = 64 << 20
SHARD_ROWS = 2048         # smaller shards than this aren't made for the sake of parallel work
BLOCK = 512               # list entries scored at a time
LARGEST = 1 << 26         # of a whole-number component: a long holds every inner product up to 2,048 components
ANGLE_SLACK, SCORE_SLACK = 1e-6, 1e-9


# ------------------------------------------------------------------ preparation

def whole_vectors(rows: DataFrame, id_col: str, label_col: str, vec_col: str, scale: int) -> DataFrame:
    """(vec_id, label, v): rows that take part, one per id, components floor(scale * x)."""
    x = F.transform(F.col(vec_col), lambda e: F.floor(e.cast("double") * F.lit(float(scale))))
    usable = F.forall(F.col(vec_col), lambda e: F.coalesce(
        ~F.isnan(e.cast("double")) & (F.abs(e.cast("double")) * scale < F.lit(float(LARGEST))), F.lit(False)))
    kept = rows.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.coalesce(usable, F.lit(False)))
    plain = kept.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), x.cast("array<int>").alias("v"))
    return plain.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("r")).select("vec_id", "r.label", "r.v")


def _matrix(column, width: int) -> np.ndarray:
    """Lists as rows of doubles, zeros where a list is shorter."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.zeros((len(sizes), width))
    out[np.arange(width)[None, :] < sizes[:, None]] = flat
    return out


def _unit(m: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


def fit_centres(vectors: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means from spread-out starts; the same input gives the same centres."""
    unit = _unit(vectors)
    picked = [0]
    nearest = unit @ unit[0]
    while len(picked) < min(k, len(unit)):
        picked.append(int(np.argmin(nearest)))
        nearest = np.maximum(nearest, unit @ unit[picked[-1]])
    centres = unit[picked]
    for _ in range(rounds):
        own = np.argmax(unit @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, unit)
        moved = _unit(sums)
        centres = np.where(np.linalg.norm(moved, axis=1, keepdims=True) > 0, moved, centres)
    return centres


def clustered(anchors: DataFrame, centres: np.ndarray) -> DataFrame:
    """Anchors with the number of their centre and their angle to it; a zero vector fits any, at angle 0."""
    width = centres.shape[1]

    def run(batches):
        for batch in batches:
            unit = _unit(_matrix(batch.column(2), width))
            cos = unit @ centres.T
            own = np.argmax(cos, axis=1)
            angle = np.where(unit.any(axis=1), np.arccos(np.clip(cos[np.arange(len(own)), own], -1, 1)), 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own.astype(np.int32)), pa.array(angle)], names=[*batch.schema.names, "cluster", "angle"])

    return anchors.mapInArrow(run, "vec_id long, label long, v array<int>, cluster int, angle double")


# ------------------------------------------------------------------ the walk

class _Best:
    """The best ``k`` (score, id) of each of ``n`` searches, higher scores and then smaller ids first."""

    def __init__(self, n: int, k: int):
        self.k, self.score, self.id, self.many = k, np.zeros((n, k), np.int64), np.zeros((n, k), np.int64), np.zeros(n, np.int64)

    def bar(self, at: np.ndarray) -> np.ndarray:
        """The worst kept score of each search, or the lowest number where fewer than k are kept."""
        return np.where(self.many[at] == self.k, self.score[at, self.k - 1], np.iinfo(np.int64).min)

    def offer(self, i: int, score: np.ndarray, ids: np.ndarray) -> None:
        m = int(self.many[i])
        score, ids = np.concatenate([self.score[i, :m], score]), np.concatenate([self.id[i, :m], ids])
        order = np.lexsort((ids, -score))[:self.k]
        self.many[i] = len(order)
        self.score[i, :len(order)], self.id[i, :len(order)] = score[order], ids[order]


class _Shard:
    """Candidates of one shard, and each cluster's list of them in order of bound."""

    def __init__(self, table: pa.Table, centres: np.ndarray):
        self.ids = table.column("vec_id").to_numpy()
        self.labels = table.column("label").to_numpy()
        self.v = _matrix(table.column("v"), centres.shape[1])
        self.norm = np.linalg.norm(self.v, axis=1)
        self.unit = _unit(self.v)
        self.centres, self.list_of = centres, (None,)

    def in_order(self, cluster: int, widest: float):
        """Candidates by falling bound (for a member of length 1), equal ones by id; sorted once per cluster."""
        if self.list_of[0] != cluster:
            angle = np.arccos(np.clip(self.unit @ self.centres[cluster], -1, 1))
            bound = self.norm * (np.cos(np.maximum(0, angle - widest - ANGLE_SLACK)) + SCORE_SLACK)
            order = np.lexsort((self.ids, -bound))
            self.list_of = (cluster, order, bound[order])
        return self.list_of[1:]


def _scores(members: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Whole inner products: by floating point where that is exact, else in whole numbers."""
    largest = np.abs(members).max(initial=0) * np.abs(candidates).max(initial=0) * members.shape[1]
    if largest < 2 ** 53:
        return (members @ candidates.T).astype(np.int64)
    return members.astype(np.int64) @ candidates.astype(np.int64).T


def _walk(shard: _Shard, group: pa.Table, widest: float, k: int, low: int, high: int):
    """Searches of one group of members: (search's anchor row, its positive, best kept).

    Without the column ``positives`` a member looks for rows of its own label; with it, once for each positive for rows
    of other labels within the positive's band of scores.
    """
    ids, labels = group.column("vec_id").to_numpy(), group.column("label").to_numpy()
    v = _matrix(group.column("v"), shard.v.shape[1])
    norm = np.linalg.norm(v, axis=1)
    same = "positives" not in group.column_names
    if same:
        of, mate, floor, ceiling = np.arange(len(ids)), None, None, None
    else:
        listed = group.column("positives").combine_chunks()
        of = np.repeat(np.arange(len(ids)), np.diff(listed.offsets.to_numpy()))
        flat = listed.flatten()
        mate = flat.field("id").to_numpy(zero_copy_only=False), flat.field("score").to_numpy(zero_copy_only=False)
        floor, ceiling = -((-low * mate[1]) // 100), (high * mate[1]) // 100
    best = _Best(len(of), k)
    open_ = np.ones(len(of), bool) if same else floor <= ceiling
    order, bound = shard.in_order(int(group.column("cluster")[0].as_py()), widest)
    for start in range(0, len(order), BLOCK):
        # Certified: all that is left scores under the worst kept one, or under the band.
        left = norm[of] * bound[start] if bound[start] >= 0 else norm[of] * bound[start] * (1 - SCORE_SLACK)
        open_ &= ~(best.bar(np.arange(len(of))) > left)
        if not same:
            open_ &= ~(floor > left)
        who = np.flatnonzero(open_)
        if not len(who):
            break
        block = order[start:start + BLOCK]
        rows, at = np.unique(of[who], return_inverse=True)
        score = _scores(v[rows], shard.v[block])[at]
        own = labels[of[who]][:, None] == shard.labels[block][None, :]
        if same:
            fits = own & (ids[of[who]][:, None] != shard.ids[block][None, :])
        else:
            fits = ~own & (score >= floor[who][:, None]) & (score <= ceiling[who][:, None])
        fits &= score >= best.bar(who)[:, None]
        for i in np.flatnonzero(fits.any(axis=1)):
            best.offer(int(who[i]), score[i, fits[i]], shard.ids[block][fits[i]])
    return ids, of, mate, best


def _searched(candidates: DataFrame, members: DataFrame, centres: np.ndarray, widest: dict[int, float], shards: int, k: int, low: int, high: int) -> DataFrame:
    """The best ``k`` of each shard for every search: (vec_id, positive, positive_score, id, score)."""
    with_positives = "positives" in members.columns
    kind = "array<struct<score:bigint,id:bigint>>"
    dealt = candidates.select(
        F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int").alias("shard"), F.lit(-1).alias("cluster"), F.lit(0).alias("chunk"),
        "vec_id", "label", "v", F.lit(None).cast(kind).alias("positives"))
    sent = members.select(
        F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), "cluster", "chunk", "vec_id", "label", "v",
        (F.col("positives") if with_positives else F.lit(None)).cast(kind).alias("positives"))
    met = dealt.unionAll(sent).repartition(shards, "shard").sortWithinPartitions("shard", "cluster", "chunk", "vec_id")
    out = "vec_id long, positive long, positive_score long, id long, score long"

    def flush(shard, rows):
        key = rows.slice(0, 1).select(["shard", "cluster"]).to_pylist()[0]
        if key["cluster"] < 0:  # the shard's own rows come first
            return (key["shard"], _Shard(rows, centres)), None
        if shard is None or shard[0] != key["shard"]:
            return shard, None  # a shard without candidates
        group = rows if with_positives else rows.drop_columns(["positives"])
        ids, of, mate, best = _walk(shard[1], group, widest[key["cluster"]], k, low, high)
        who = np.repeat(np.arange(len(of)), best.many)
        filled = np.arange(k)[None, :] < best.many[:, None]
        nothing = pa.nulls(len(who), pa.int64())
        return shard, pa.RecordBatch.from_arrays([
            pa.array(ids[of[who]]), pa.array(mate[0][who]) if mate else nothing, pa.array(mate[1][who]) if mate else nothing,
            pa.array(best.id[filled]), pa.array(best.score[filled]),
        ], names=["vec_id", "positive", "positive_score", "id", "score"])

    def run(batches):
        shard, held, key = None, [], None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            marks = np.stack([table.column(c).to_numpy() for c in ("shard", "cluster", "chunk")])
            cuts = [0, *(np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                now = tuple(marks[:, a].tolist())
                if held and now != key:
                    shard, found = flush(shard, pa.concat_tables(held))
                    held = []
                    if found is not None:
                        yield found
                key = now
                held.append(table.slice(a, b - a))
        if held:
            _, found = flush(shard, pa.concat_tables(held))
            if found is not None:
                yield found

    return met.mapInArrow(run, out)


# ------------------------------------------------------------------ the operator

def _first(found: DataFrame, by: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def hard_negatives(
    rows: DataFrame, is_anchor: Callable[[Column], Column], id_col: str = "vec_id", label_col: str = "label", vec_col: str = "embedding",
    positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for every anchor and positive.

    Scores are inner products of components floor(scale * x). An anchor's positives are its ``positives`` best other
    rows of the same label; a positive's hard negatives are the ``negatives`` best rows of other labels with
    low * positive_score <= 100 * score <= high * positive_score. Higher scores come first, ties by the smaller id;
    fewer are given where there are no more, and an anchor without a positive or a match has no row.

    No part is taken by rows with a null id or label, a null vector, a null or non-finite component, or a component of
    2**26 or more (a long could not hold its products). Of rows with one id the first by (label, vector) counts.
    Missing components of a shorter vector are zero. Empty tables give no rows. Other columns are not read.
    """
    spark = rows.sparkSession
    table = stored(whole_vectors(rows, id_col, label_col, vec_col, scale), "whole-vectors")
    n, width = table.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    empty = spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    anchors = table.filter(is_anchor(F.col("vec_id")))
    sample = anchors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v").toArrow()
    if not sample.num_rows:
        return empty
    many = max(1, min(CENTRES, round(sample.num_rows ** 0.5)))
    centres = fit_centres(_matrix(sample.column("v"), max(1, width)), many)
    placed = stored(clustered(anchors, centres), "anchors")
    sizes = placed.groupBy("cluster").agg(F.count("*").alias("n"), F.max("angle").alias("widest")).collect()  # one row per centre
    widest = {r.cluster: r.widest for r in sizes}
    chunks = F.element_at(F.create_map(*[F.lit(x) for r in sizes for x in (r.cluster, -(-r.n // GROUP))]), F.col("cluster"))
    members = placed.withColumn("chunk", F.pmod(F.xxhash64("vec_id"), chunks).cast("int")).drop("angle")
    parallel = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards = max(-(-n * max(1, width) * 8 // SHARD_BYTES), min(parallel, -(-n // SHARD_ROWS)), 1)

    near = _first(_searched(table, members, centres, widest, shards, positives, low, high), ["vec_id"], positives)
    mates = near.groupBy("vec_id").agg(F.sort_array(F.collect_list(F.struct("score", "id"))).alias("positives"))
    asking = stored(members.join(mates, "vec_id"), "positives")
    found = _first(_searched(table, asking, centres, widest, shards, negatives, low, high), ["vec_id", "positive"], negatives)
    return found.select(
        F.col("vec_id").alias("anchor_id"), F.col("positive").alias("positive_id"), "rank", F.col("id").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"))
