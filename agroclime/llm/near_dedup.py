"""Near duplicates by tensored MinHash banding.

Two small collections of hash tuples, A and B, are computed per document; table key (i, j) combines tuple A_i
with tuple B_j, so ``tuples**2`` tables cost only ``2 * tuples * width`` minhashes. Two sets share a table exactly
if they share some A_i and some B_j; with 16 tuples of 3 hashes in each collection a pair at similarity 0.8 is
missed with probability 2e-5, less above. Every candidate is confirmed on the two whole shingle sets.

No pairs within a group are enumerated: documents with equal sets become one class first, each table's bucket
links its members to its smallest member, and only buckets still holding more than one component afterwards get
their remaining cross-component pairs. Of these, pairs that cannot be similar by how many shingles are each
document's own are ruled out (exactly) before they are formed, and in crowded buckets the join itself compares the
two hash sets, so that only similar pairs leave it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agroclime.llm import textvec as tv
from agroclime.llm.components import components
from agroclime.llm.store import stored

TUPLES, WIDTH = 16, 3
CROWD = 64  # buckets with more open documents than this bring their shingle hashes, and pairs are compared before they are formed


def _minhash_keys(h: np.ndarray, begin: np.ndarray, tuples: int, width: int) -> np.ndarray:
    """(texts, 2 * tuples) keys: first collection A, then B. Texts without shingles get zeros."""
    full = np.flatnonzero(np.diff(begin))
    keys = np.zeros((len(begin) - 1, 2 * tuples), np.uint64)
    if not len(full):
        return keys
    at = begin[:-1][full]
    seeds = tv.mix(np.arange(1, 2 * 2 * tuples * width + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    for t in range(2 * tuples):
        key = np.full(len(full), t + 1, np.uint64)
        for w in range(width):
            k = 2 * (t * width + w)
            low = np.minimum.reduceat(h * (seeds[k] | np.uint64(1)) + seeds[k + 1], at)
            key = tv.mix(key * np.uint64(0xFF51AFD7ED558CCD) + low)
        keys[full, t] = key
    return keys


def signatures(docs: DataFrame, id_col: str, text_col: str, shingle: int, tuples: int = TUPLES, width: int = WIDTH) -> DataFrame:
    """(id, n_shingles, digest, keys): set size, SHA-256 of the text's word sequence, and the hash tuples."""

    def run(batches):
        for batch in tv.sub_batches(batches):
            words = tv.words_of(batch.column(1))
            h, begin = tv.distinct_per_text(*tv.shingle_hashes(words, shingle))
            n = np.diff(begin)
            keys = _minhash_keys(h, begin, tuples, width)
            flat = pa.array(keys.view(np.int64).ravel())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * 2 * tuples), flat)
            digests = pa.array(tv.normalized_digests(words, tv.text_bytes(batch.column(1))[1]), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n.astype(np.int64)), digests, lists], names=["id", "n_shingles", "digest", "keys"])

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, "id long, n_shingles long, digest binary, keys array<long>")


def similar(a: str | None, b: str | None, shingle: int, percent: int) -> bool:
    """Whether the two whole shingle sets have 100 * intersection >= percent * union; empty sets never do."""
    x, y = shingle_set(a, shingle), shingle_set(b, shingle)
    both = len(x & y)
    return both > 0 and 100 * both >= percent * (len(x) + len(y) - both)


_ASCII_LOWER = {c: c + 32 for c in range(65, 91)}
_BREAK = {9: " ", 10: " ", 11: " ", 12: " ", 13: " "}


def shingle_set(text: str | None, size: int) -> set:
    words = [w for w in (text or "").translate({**_ASCII_LOWER, **_BREAK}).split(" ") if w]
    if len(words) < size:
        return {tuple(words)} if words else set()
    return set(zip(*(words[i:] for i in range(size)), strict=False))


def _confirmed(pairs: DataFrame, docs: DataFrame, id_col: str, text_col: str, shingle: int, percent: int) -> DataFrame:
    """Every pair (a, b) with whether it is similar. Pairs meet their texts by joins; equal ids of one batch share a set."""
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    joined = (
        pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
        .join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
        .select("a", "b", "text_a", "text_b")
    )

    def run(batches):
        last, left = None, set()
        for batch in batches:
            a, b = batch.column(0), batch.column(1)
            said = []
            for i in range(len(a)):
                if last != a[i].as_py():
                    last, left = a[i].as_py(), shingle_set(batch.column(2)[i].as_py(), shingle)
                right = shingle_set(batch.column(3)[i].as_py(), shingle)
                both = len(left & right)
                said.append(both > 0 and 100 * both >= percent * (len(left) + len(right) - both))
            yield pa.RecordBatch.from_arrays([a, b, pa.array(said, pa.bool_())], names=["a", "b", "same"])

    return joined.mapInArrow(run, "a long, b long, same boolean")


def _held(ids: DataFrame, docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(id, g): the distinct shingle hashes of these documents."""
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).join(ids, "id", "left_semi")

    def run(batches):
        for batch in tv.sub_batches(batches):
            h, begin = tv.distinct_per_text(*tv.shingle_hashes(tv.words_of(batch.column(1)), shingle))
            of = np.repeat(np.arange(batch.num_rows), np.diff(begin))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of)), pa.array(h.view(np.int64))], names=["id", "g"])

    return texts.select("id", "text").mapInArrow(run, "id long, g long")


def _possible(ids: DataFrame, sizes: DataFrame, docs: DataFrame, id_col: str, text_col: str, shingle: int, percent: int) -> DataFrame:
    """(id, n, own) of the documents that can have a partner among ``ids``.

    ``own`` counts shingles found in no other of these documents. Two sets share at most ``n - own`` of each, so one
    whose own shingles exceed 100 - percent of it has no partner here, and pairs are bounded likewise.
    """
    held = _held(ids, docs, id_col, text_col, shingle)
    single = held.groupBy("g").agg(F.count("*").alias("times"), F.min("id").alias("id")).filter("times = 1")
    own = single.groupBy("id").agg(F.count("*").alias("own"))
    all_of = sizes.join(ids, "id").join(own, "id", "left").select("id", "n", F.coalesce("own", F.lit(0)).alias("own"))
    return stored(all_of.filter(f"100 * (n - own) >= {percent} * n"), "possible")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: ``id, n_shingles, component_id, kept``.

    Null or wordless texts have an empty set and are linked with nothing. Rows with one id are one document and give
    one row: repeats count once, and of different texts any may link it, while n_shingles is the largest set's. A null
    id gives a row of its own, linked with nothing. Texts of equal words (known by SHA-256 of the word sequence) under
    different ids are one class; texts of any length are read whole. Other columns are not read.
    """
    docs = docs.select(F.col(id_col), F.col(text_col))
    sigs = stored(signatures(docs, id_col, text_col, shingle), "signatures")
    live = sigs.filter("n_shingles > 0 and id is not null").groupBy("id", "digest").agg(F.first("n_shingles").alias("n_shingles"), F.first("keys").alias("keys"))
    repeated = stored(sigs.filter("id is not null").groupBy("id").agg(F.count("*").alias("n"), F.count_distinct("digest").alias("texts")).filter("n > 1"), "repeated")
    again = not repeated.isEmpty()
    if again:  # their texts are looked at once each
        key = repeated.select(F.col("id").alias(id_col))
        docs = docs.join(key, id_col, "left_anti").unionByName(docs.join(key, id_col, "left_semi").distinct())
    classes = live.groupBy("digest").agg(F.min("id").alias("rep"))
    members = stored(live.join(classes, "digest").select("id", "rep", F.when(F.col("id") == F.col("rep"), F.col("keys")).alias("keys")), "members")
    reps = members.filter("id = rep").select("id", "keys")
    # A document of several texts links the classes of all of them.
    spanning = members.join(repeated.filter("texts > 1").select("id"), "id", "left_semi").filter("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b"))

    # A table key (i, j) can only be shared where A_i and B_j are: keep those alone before combining.
    single = reps.select("id", F.posexplode("keys").alias("t", "key"))
    shared = single.groupBy("t", "key").agg(F.count("*").alias("n")).filter("n > 1").drop("n")
    useful = (
        single.join(shared, ["t", "key"])
        .groupBy("id").agg(
            F.array_sort(F.collect_list(F.when(F.col("t") < TUPLES, F.struct("t", "key")))).alias("left"),
            F.array_sort(F.collect_list(F.when(F.col("t") >= TUPLES, F.struct("t", "key")))).alias("right"),
        )
    )
    tables = (
        useful.select("id", F.explode("left").alias("l"), "right").select("id", "l", F.explode("right").alias("r"))
        .select("id", F.xxhash64("l.t", "l.key", "r.t", "r.key").alias("key"))
    )
    low = tables.groupBy("key").agg(F.min("id").alias("head"), F.count("*").alias("n")).filter("n > 1")
    buckets = stored(tables.join(low.drop("n"), "key"), "buckets")
    stars = buckets.filter("id <> head").select(F.col("head").alias("a"), F.col("id").alias("b")).distinct()
    tested = stored(_confirmed(stars, docs, id_col, text_col, shingle, percent), "tested")
    links = tested.filter("same").select("a", "b")
    if again:
        links = stored(links.union(spanning), "links")
    found = components(links)

    # Buckets that still hold several components: their pairs across components, each formed once. They are joined on
    # collection A alone, at their first common tuple, and must share a tuple of B.
    labelled = buckets.join(found, "id", "left").select("key", "id", F.coalesce("component", "id").alias("component"))
    mixed = labelled.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi").select("key")
    open_ids = stored(labelled.join(mixed, "key").select("id", "component").distinct(), "open")
    largest = sigs.groupBy("id").agg(F.max("n_shingles").alias("n_shingles")) if again else sigs.select("id", "n_shingles")
    possible = _possible(open_ids.select("id").distinct(), largest.select("id", F.col("n_shingles").alias("n")), docs, id_col, text_col, shingle, percent)
    keyed = stored(
        open_ids.join(possible, "id").join(reps, "id")
        .select("id", "component", "n", "own", F.slice("keys", 1, TUPLES).alias("left"), F.slice("keys", TUPLES + 1, TUPLES).alias("right"))
        .withColumn("key", F.explode("left")),
        "keyed",
    )
    crowded = keyed.groupBy("key").count().filter(F.col("count") > CROWD).select("key", F.lit(True).alias("crowded"))
    dense = keyed.join(crowded, "key", "left_semi").select("id").distinct()
    sets = stored(_held(dense, docs, id_col, text_col, shingle).groupBy("id").agg(F.collect_list("g").alias("held")), "sets")
    rest = stored(
        keyed.join(crowded, "key", "left").join(sets, "id", "left")
        .withColumn("held", F.when(F.col("crowded"), F.col("held"))).drop("crowded"),
        "rest",
    )
    fits = f"(100 + {percent}) * (x.n + y.n - x.own - y.own) >= {2 * percent} * (x.n + y.n) and (100 + {percent}) * least(x.n - x.own, y.n - y.own) >= {percent} * (x.n + y.n)"
    close = f"(x.held is null or (100 + {percent}) * size(array_intersect(x.held, y.held)) >= {percent} * (x.n + y.n))"
    once = "arrays_overlap(x.right, y.right) and array_intersect(x.left, y.left)[0] = x.key"
    across = (
        rest.alias("x").join(rest.alias("y"), F.expr(f"x.key = y.key and x.component < y.component and {fits} and {once} and {close}"))
        .select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b"))
        .join(tested.select("a", "b"), ["a", "b"], "left_anti")
    )
    more = stored(_confirmed(across, docs, id_col, text_col, shingle, percent), "tested")
    if not more.filter("same").isEmpty():
        found = components(links.union(more.filter("same").select("a", "b")))
    placed = members.select("id", "rep").join(found.select(F.col("id").alias("rep"), "component"), "rep", "left").select("id", F.coalesce("component", "rep").alias("component"))
    if again:
        placed = placed.groupBy("id").agg(F.min("component").alias("component"))
        largest = largest.filter("id is not null").unionByName(sigs.filter("id is null").select("id", "n_shingles"))
    return (
        largest.join(placed, "id", "left")
        .select("id", "n_shingles", F.coalesce("component", "id").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("component_id") == F.col("id"), F.lit(True)))
    )
