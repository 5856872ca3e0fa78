"""Approximate nearest neighbours: a neighbour graph by NN-descent, searched greedily.

Equal vectors are one node, so a vector that a third of all rows share is one node as well. The graph starts from
blocks of vectors that lie together in random-hyperplane order and is improved by joins of neighbours of neighbours:
every node meets, at each node it is linked with in either direction, that node's neighbours. These pairs number
about 1.5 x nodes x neighbours**2 whatever the in-degrees, because two in-links of a hub are never paired with each other.
A query keeps a pool of its nearest nodes so far and expands unexpanded ones until none is left among the best.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from agroclime.llm.store import release, stored

NEIGHBOURS, TABLES, BLOCK, ROUNDS = 28, 4, 96, 6
MOST_ROUNDS, SETTLED = 12, 0.05  # rounds go on while a larger share of the links is new
POOL, EXPAND, HOPS = 160, 32, 24
PART_NODES = 20_000  # nodes that one search task holds at a time
_BITS = 48
_EDGE = "id long, near long, d float"


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, vec): vectors of the table's commonest length without null, non-finite or all-zero components."""
    v = vectors.select(F.col(id_col).cast("long").alias("id"), F.transform(F.col(vector_col).cast("array<double>"), lambda x: x + F.lit(0.0)).alias("vec"))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    good = v.filter(F.col("id").isNotNull() & F.col("vec").isNotNull() & ~F.exists("vec", bad)).filter(F.exists("vec", lambda x: x != 0))
    common = good.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return good.filter(F.size("vec") == (common[0]["n"] if common else -1))


def _matrix(column: pa.Array, kind) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(column), -1) if len(column) else np.zeros((0, 1), kind)


def _between(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances row by row, of differences: near-copies far from the origin keep all their digits."""
    d = a - b
    return np.einsum("...i,...i->...", d, d)


def _closer(a: np.ndarray, b: np.ndarray, bound: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (row of a, row of b, squared distance) nearer than the bounds of either row; scalar products only leave out the rest."""
    norms = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :]
    rough = norms - 2 * a @ b.T - 1e-13 * norms
    i, j = np.nonzero((rough < bound[:, None]) | (rough < other[None, :]))
    return i, j, _between(a[i], b[j])


def _edges(ids, near, d) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(near, pa.int64()), pa.array(d, pa.float32())], names=["id", "near", "d"])


def _top(edges: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("id").orderBy("d", "near")
    return edges.groupBy("id", "near").agg(F.min("d").alias("d")).withColumn("r", F.row_number().over(best)).filter(F.col("r") <= k).drop("r")


def _first_links(rows: DataFrame, kind, dim: int, k: int) -> DataFrame:
    def sums(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([_opened(batch.column(1), kind, dim).sum(axis=0)], pa.list_(pa.float64()))], names=["n", "total"])

    parts = rows.mapInArrow(sums, "n long, total array<double>").agg(F.sum("n"), *(F.sum(F.get("total", F.lit(i))) for i in range(dim))).first()
    mean = np.array(parts[1:], float) / parts[0] if parts[0] else np.zeros(dim)
    planes = np.random.default_rng(5).normal(size=(TABLES, dim, _BITS))

    def code(batches):
        weight = 1 << np.arange(_BITS - 1, -1, -1, dtype=np.int64)
        for batch in batches:
            x = _opened(batch.column(1), kind, dim) - mean
            for t in range(TABLES):
                bits = (x @ planes[t] > 0) @ weight + (t << _BITS)
                yield pa.RecordBatch.from_arrays([pa.array(bits), batch.column(0), batch.column(1)], names=["code", "id", "data"])

    def link(batches):
        held_ids, held = np.zeros(0, np.int64), None

        def block(ids, x):
            d = np.stack([_between(x, y) for y in x])
            d[ids[:, None] == ids[None, :]] = np.inf
            n = min(k, len(ids) - 1)
            if n > 0:
                at = np.argpartition(d, n - 1, axis=1)[:, :n]
                yield _edges(np.repeat(ids, n), ids[at].ravel(), np.take_along_axis(d, at, 1).ravel())

        for batch in batches:
            x, ids = _opened(batch.column(2), kind, dim), batch.column(1).to_numpy(zero_copy_only=False)
            held = x if held is None else np.vstack((held, x))
            held_ids = np.concatenate((held_ids, ids))
            while len(held_ids) >= 2 * BLOCK:
                yield from block(held_ids[:BLOCK], held[:BLOCK])
                held_ids, held = held_ids[BLOCK // 2 :], held[BLOCK // 2 :]  # blocks overlap by half
        if len(held_ids):
            yield from block(held_ids, held)

    coded = rows.mapInArrow(code, "code long, id long, data binary")
    return coded.repartitionByRange("code", "id").sortWithinPartitions("code", "id").select("code", "id", "data").mapInArrow(link, _EDGE)


def _bytes(nodes: DataFrame) -> tuple[DataFrame, type]:
    """(id, data): vectors as bytes without rounding, and their kind: single precision where that holds every component.

    All are scaled by one power of two so that squared distances of finite vectors stay finite.
    """
    single = F.exists("vec", lambda x: x.cast("float").cast("double") != x)
    most, double = nodes.agg(F.max(F.array_max(F.transform("vec", F.abs))), F.max(single)).first()
    down, kind = -int(np.frexp(most or 1.0)[1]), np.float64 if double else np.float32

    def run(batches):
        for batch in batches:
            x = np.ldexp(_matrix(batch.column(1), float), down).astype(kind)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in x], pa.binary())], names=["id", "data"])

    return nodes.select("id", "vec").mapInArrow(run, "id long, data binary"), kind


def _opened(column: pa.Array, kind, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, dim).astype(float)


def _improve(graph: DataFrame, vectors: DataFrame, kind, dim: int, k: int) -> DataFrame:
    """Better links found where neighbours meet: rows (centre, lane, member) bring the member's vector and its worst link.

    Lane 0 are the centre's neighbours, lane 1 nodes that have the centre as neighbour; lane 0 comes first, so lane 1
    streams past it and a hub's many in-links are never held together.
    """
    worst = graph.groupBy("id").agg(F.max("d").alias("worst"), F.count("*").alias("n"))
    member = vectors.join(worst, "id").select(F.col("id").alias("member"), "data", F.when(F.col("n") < k, F.lit(float("inf"))).otherwise(F.col("worst")).cast("float").alias("worst"))
    links = graph.select(F.col("id").alias("centre"), F.col("near").alias("member"), F.lit(0).alias("lane")).union(
        graph.select(F.col("near").alias("centre"), F.col("id").alias("member"), F.lit(1).alias("lane"))
    )
    rows = links.join(member, "member").select("centre", "lane", "member", "data", "worst")

    def meet(batches):
        centre, own, origin = None, None, 0.0
        done, size = [], 0

        def better(a, b, both_ways):
            ids, x, bound = a
            i, j, d = _closer(x, b[1], bound, b[2] if both_ways else np.full(len(b[0]), -np.inf))
            other = ids[i] != b[0][j]
            use = other & (d < bound[i])
            out = [(ids[i[use]], b[0][j[use]], d[use])]
            if both_ways:
                use = other & (d < b[2][j])
                out.append((b[0][j[use]], ids[i[use]], d[use]))
            return out

        for batch in batches:
            if not batch.num_rows:
                continue
            centres, lanes, ids, worsts = (batch.column(n).to_numpy(zero_copy_only=False) for n in (0, 1, 2, 4))
            x = _opened(batch.column(3), kind, dim)
            cuts = np.flatnonzero((np.diff(centres) != 0) | (np.diff(lanes) != 0)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(ids)], strict=True):
                if centres[a] != centre:
                    centre, own, origin = centres[a], None, x[a]
                # One origin within the meeting: products of near-copies' small differences lose nothing.
                here = (ids[a:b], x[a:b] - origin, worsts[a:b])
                found = []
                if lanes[a] == 0:
                    # a neighbour list cut by a batch border meets its first part as well
                    if own is not None:
                        found += better(here, own, True)
                    found += better(here, here, False)
                    own = here if own is None else tuple(np.concatenate(p) for p in zip(own, here, strict=True))
                elif own is not None:
                    for c in range(0, b - a, 512):
                        found += better(tuple(p[c : c + 512] for p in here), own, True)
                for f in found:
                    done.append(f)
                    size += len(f[0])
            if size > 50_000:
                yield _edges(*(np.concatenate(c) for c in zip(*done, strict=True)))
                done, size = [], 0
        if size:
            yield _edges(*(np.concatenate(c) for c in zip(*done, strict=True)))

    return rows.repartition("centre").sortWithinPartitions("centre", "lane").mapInArrow(meet, _EDGE)


def build_graph(nodes: DataFrame, dim: int, k: int = NEIGHBOURS, rounds: int = ROUNDS) -> DataFrame:
    """(id, near, d): each node's nearest ``k`` found after ``rounds`` of NN-descent, or more where links still change."""
    rows, kind = _bytes(nodes)
    vectors = stored(rows, "bytes")
    graph = stored(_top(_first_links(vectors, kind, dim, k), k), "graph")
    for done in range(1, max(rounds, MOST_ROUNDS) + 1):
        before, graph = graph, stored(_top(graph.unionByName(_improve(graph, vectors, kind, dim, k)), k), "graph")
        release(nodes.sparkSession)
        if done >= rounds and graph.join(before, ["id", "near"], "left_anti").count() <= SETTLED * graph.count():
            break
    return graph


def search(queries: DataFrame, graph: DataFrame, nodes: DataFrame, pool: int = POOL, expand: int = EXPAND, hops: int = HOPS) -> DataFrame:
    """(query, id, d, visited): the pool of nearest nodes found for each query (query, vec), and how many nodes it measured.

    A query that is a node starts at its links. Distances are in double precision. A query's state is one row: its
    pool, which of it has been expanded, and the ids it has measured. A hop joins only the expanded nodes with the
    links and sends each query the new ones; nothing is broadcast, and a few entry nodes are literals.
    """
    either = graph.select("id", "near").union(graph.select(F.col("near"), F.col("id"))).distinct()
    links = stored(either, "links")
    entries = [r["id"] for r in nodes.orderBy(F.xxhash64("id")).limit(8).select("id").collect()]
    started = queries.select("query").join(links.withColumnRenamed("id", "query"), "query").select("query", F.col("near").alias("id"))
    entry = F.explode(F.array(*map(F.lit, entries)).cast("array<long>"))
    first = started.union(queries.select("query", entry.alias("id"))).distinct()

    spark = nodes.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-nodes.count() // PART_NODES))
    part = F.pmod(F.xxhash64("id"), F.lit(parts)).alias("part")
    placed = nodes.select(part, "id", "vec")

    def measure(held: pa.Table, asked: pa.Table) -> pa.Table:
        ids = held.column("id").to_numpy()
        order = np.argsort(ids)
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if len(ids) and asked.num_rows:
            x = _matrix(held.column("vec").combine_chunks(), float)
            for query, q, wanted in zip(asked.column("query").to_pylist(), _matrix(asked.column("q").combine_chunks(), float), asked.column("ids"), strict=True):
                near = wanted.values.to_numpy(zero_copy_only=False)
                d = x[order[np.searchsorted(ids, near, sorter=order)]] - q
                out.append((np.full(len(near), query), near, np.sqrt((d * d).sum(axis=1))))
        q, i, d = (np.concatenate(c) for c in zip(*out, strict=True))
        return pa.table({"query": pa.array(q, pa.int64()), "id": pa.array(i, pa.int64()), "d": pa.array(d, pa.float64())})

    def measured(pairs: DataFrame) -> DataFrame:
        """(query, found): distances of each query's new nodes, unexpanded, nearest first."""
        # A query goes once to each part that holds some of its candidates; nodes' vectors are not copied per pair.
        asked = pairs.select("query", "id", part).groupBy("query", "part").agg(F.collect_list("id").alias("ids"))
        sent = asked.join(queries.select("query", F.col("vec").alias("q")), "query").select("part", "query", "q", "ids")
        near = placed.groupBy("part").cogroup(sent.groupBy("part")).applyInArrow(measure, "query long, id long, d double")
        entry = F.struct("d", "id", F.lit(True).alias("open"))
        return near.groupBy("query").agg(F.array_sort(F.collect_list(entry)).alias("found"))

    ids_of = lambda found: F.transform(found, lambda e: e["id"])
    state = measured(first).select("query", F.slice("found", 1, pool).alias("pool"), ids_of("found").alias("visited"))
    state = stored(state, "pool")
    for _ in range(hops):
        chosen = state.select("query", F.explode(F.slice(F.filter("pool", lambda e: e["open"]), 1, expand)).alias("e")).select("query", F.col("e.id").alias("id"))
        if chosen.isEmpty():
            break
        near = chosen.join(links, "id").groupBy("query").agg(F.collect_set("near").alias("near"))
        fresh = near.join(state.select("query", "visited"), "query").select("query", F.explode(F.array_except("near", "visited")).alias("id"))
        # The nearest unexpanded nodes are expanded now.
        unopened = F.filter("pool", lambda e: e["open"])
        now = F.transform(F.slice(unopened, 1, expand), lambda e: e["id"])
        after = state.withColumn("now", now).select("query", "visited", F.transform(
            "pool", lambda e: F.struct(e["d"].alias("d"), e["id"].alias("id"), (e["open"] & ~F.array_contains(F.col("now"), e["id"])).alias("open"))).alias("pool"))
        both = after.join(measured(fresh), "query", "left")
        merged = F.slice(F.array_sort(F.concat("pool", "found")), 1, pool)
        # All measured nodes stay known, so none is measured twice; only the pool's are ever expanded.
        state = stored(both.select(
            "query", F.when(F.col("found").isNull(), F.col("pool")).otherwise(merged).alias("pool"),
            F.when(F.col("found").isNull(), F.col("visited")).otherwise(F.concat("visited", ids_of("found"))).alias("visited")), "pool")
    return state.select("query", F.size("visited").alias("visited"), F.explode("pool").alias("e")).select("query", "e.id", "e.d", "visited")


def nearest(vectors: DataFrame, is_query, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score`` of each query row's ``k`` nearest other rows found.

    ``is_query(id)`` is a Column. Rows without id, and vectors null, zero, of another than the commonest length or
    with null or non-finite components take no part. Equal vectors are ranked by id; of rows with one id the first by
    vector counts. Fewer than ``k`` other rows give as many as there are; other columns are not read.
    """
    rows = stored(usable(vectors, id_col, vector_col).groupBy("id").agg(F.min("vec").alias("vec")), "vectors")
    sizes = rows.select(F.size("vec").alias("n")).limit(1).collect()
    dim = sizes[0]["n"] if sizes else 1
    nodes = stored(rows.groupBy("vec").agg(F.min("id").alias("id")).select("id", "vec"), "nodes")
    members = stored(rows.join(nodes.withColumnRenamed("id", "node"), "vec").select("id", "node"), "members")
    graph = build_graph(nodes, dim)
    asked = members.filter(is_query(F.col("id"))).select(F.col("id").alias("query_id"), "node")
    queries = stored(nodes.join(asked.select(F.col("node").alias("id")).distinct(), "id").select(F.col("id").alias("query"), "vec"), "queries")
    pool = search(queries, graph, nodes).drop("visited")
    own = queries.select("query", F.col("query").alias("id"), F.lit(0.0).alias("d"))
    pool = pool.filter("query <> id").unionByName(own).withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy("d", "id"))).filter(F.col("r") <= k + 1).drop("r")
    # k + 1 members of a node are enough: the query itself may be one of them.
    listed = members.withColumn("r", F.row_number().over(Window.partitionBy("node").orderBy("id"))).filter(F.col("r") <= k + 1).select(F.col("id").alias("vec_id"), "node")
    answers = pool.join(listed.withColumnRenamed("node", "id"), "id").select("query", "vec_id", "d")
    shortlist = answers.withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy("d", "vec_id"))).filter(F.col("r") <= k + 1).drop("r")
    named = asked.join(shortlist.withColumnRenamed("query", "node"), "node").filter("query_id <> vec_id")
    ranked = named.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("d", "vec_id"))).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", F.col("d").alias("score"))
