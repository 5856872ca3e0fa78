"""Target-distribution importance resampling of documents.

Hashed one- and two-word features of the raw documents and of the target texts are counted into one array of
buckets each; the log ratio of the two distributions is an array of gains, and a document's weight is the mean gain
of its features. Gumbel noise from the document's id turns weights into scores whose highest are a draw without
replacement. The cutoff between drawn and undrawn is found by numeric bisection: every step is one exact count job
over the persisted scores, first on the score, then on the id among documents tied at that score. Only the drawn
rows are then range-partitioned and sorted for their ranks.

Tasks hold one batch of at most ``PIECE`` bytes of text and the bucket arrays, whose length is a parameter; longer
texts are taken in pieces. The driver sees the bucket counts, one count per bisection step and one per range.
"""

from __future__ import annotations

import hashlib
import math
import sys
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agroclime.llm.store import stored

# The code of this module travels with the tasks, so workers need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BUCKETS = 10_000
PIECE = 1 << 20      # bytes of text whose features are in memory at once
LONG_WORD = 48       # longer words are hashed one by one
PARTS_PER_STEP = 16  # a count job tells the rows under 15 thresholds: four halvings in one job
LAST = (1 << 63) - 1

_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _crc_table() -> np.ndarray:
    rows = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        rows = np.where(rows & 1, (rows >> 1) ^ np.uint32(0xEDB88320), rows >> 1)
    return rows


_CRC = _crc_table()


def _extended(crc: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The CRC-32 of each string whose CRC is ``crc``, followed by its span of ``data``."""
    out = crc.copy()
    size = ends - starts
    order = np.argsort(-size, kind="stable")
    many = int(np.searchsorted(-size[order], -LONG_WORD))  # spans longer than LONG_WORD come first
    for i in order[:many].tolist():
        out[i] = zlib.crc32(data[starts[i]:ends[i]].tobytes(), int(crc[i]))
    rest = order[many:]
    at, left, state = starts[rest], -size[rest], ~crc[rest]
    for j in range(int(size[rest[0]]) if len(rest) else 0):
        n = int(np.searchsorted(left, -j))  # spans with more than j bytes
        state[:n] = _CRC[(state[:n] ^ data[at[:n] + j]) & 0xFF] ^ (state[:n] >> 8)
    out[rest] = ~state
    return out


def _pieces(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first text, texts, their word starts, ends, text of each word), with about PIECE bytes at a time.

    A text longer than that comes in several pieces, cut before a word; each but the first begins with the last word
    of the piece before, marked by a negative text number, so that no pair of words is lost.
    """
    n = len(offsets) - 1
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + PIECE, "right")) - 1)
        begin, end = int(offsets[a]), int(offsets[b])
        carried = None
        while True:
            stop = min(end, begin + PIECE) if b == a + 1 else end
            if stop < end:  # to the end of the word that the cut would hit
                while stop < end and _WORD[data[stop]]:
                    tail = _WORD[data[stop:min(end, stop + 4096)]]
                    stop += len(tail) if tail.all() else int(np.argmin(tail))
            inside = np.zeros(stop - begin + 2, np.int8)
            inside[1:-1] = _WORD[data[begin:stop]]
            change = np.diff(inside)
            # Neighbouring texts may touch without a byte between them: cut there too.
            edges = offsets[a + 1:b] - begin
            edges = edges[(edges > 0) & (edges < stop - begin)]
            edges = np.unique(edges[(inside[edges] == 1) & (inside[edges + 1] == 1)])
            starts = np.sort(np.concatenate([np.flatnonzero(change == 1), edges])) + begin
            ends = np.sort(np.concatenate([np.flatnonzero(change == -1), edges])) + begin
            text = np.searchsorted(offsets[a + 1:b + 1], starts, "right") if len(starts) else np.zeros(0, np.int64)
            if carried is not None:
                starts, ends = np.concatenate([[carried[0]], starts]), np.concatenate([[carried[1]], ends])
                text = np.concatenate([[-1], text])
            yield a, b - a, starts, ends, text
            if stop >= end:
                break
            if len(starts):
                carried = (int(starts[-1]), int(ends[-1]))
            begin = stop
        a = b


def _text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column = pc.fill_null(column, "").cast(pa.large_string())
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    return _LOWER[np.frombuffer(data or b"", np.uint8)[offsets[0]:offsets[-1]]], offsets - offsets[0]


def hashed_features(column: pa.Array, buckets: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first text, texts, words of each, text of each feature, its bucket) for pieces of a text column.

    Features are all single words and all pairs of consecutive words, repeats included.
    """
    data, offsets = _text_bytes(column)
    for first, n, starts, ends, text in _pieces(data, offsets):
        word = _extended(np.zeros(len(starts), np.uint32), data, starts, ends)
        own = text >= 0
        text = np.maximum(text, 0)
        blank = _CRC[(~word ^ np.uint32(32)) & 0xFF] ^ (~word >> 8)
        left = np.flatnonzero(text[1:] == text[:-1])
        pair = _extended(~blank[left], data, starts[left + 1], ends[left + 1])
        of = np.concatenate([text[own], text[left]])
        yield first, n, np.bincount(text[own], minlength=n), of, np.concatenate([word[own], pair]) % np.uint32(buckets)


def bucket_counts(texts: DataFrame, text_col: str, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts fall into each bucket: one array per task, summed by Spark."""

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, _, _, at in hashed_features(batch.column(0), buckets):
                total += np.bincount(at, minlength=buckets)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], names=["bucket", "n"])

    counted = texts.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "bucket int, n long")
    out = np.zeros(buckets, np.int64)
    for row in counted.groupBy("bucket").agg(F.sum("n").alias("n")).toLocalIterator():  # at most one row per bucket
        out[row.bucket] = row.n
    return out


def bucket_gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln(target share / raw share)) of each bucket, with one added to every count."""
    s, t, n = int(raw.sum()), int(target.sum()), len(raw)
    return np.array([
        math.floor(1000 * math.log(float((int(b) + 1) * (s + n)) / float((int(a) + 1) * (t + n)))) for a, b in zip(raw, target, strict=True)
    ], np.int64)


def gumbel(doc_id: str, seed: int) -> int:
    h = int(hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gains: np.ndarray, id_col: str, text_col: str, seed: int) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(gains)  # as long as the number of buckets

    def run(batches):
        for batch in batches:
            table = shared.value
            n = batch.num_rows
            words, features, total = (np.zeros(n, np.int64) for _ in range(3))
            for first, m, per_text, of, at in hashed_features(batch.column(1), len(table)):
                words[first:first + m] += per_text
                features[first:first + m] += np.bincount(of, minlength=m)
                high, low = table[at] >> 20, table[at] & 0xFFFFF  # sums of doubles below stay whole numbers
                total[first:first + m] += (np.bincount(of, high, m).astype(np.int64) << 20) + np.bincount(of, low, m).astype(np.int64)
            weight = total // np.maximum(features, 1)
            noise = np.array([gumbel("" if i is None else str(i), seed) for i in batch.column(0).to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *map(pa.array, (words, features, weight, weight + noise))],
                names=["doc_id", "n_words", "n_features", "weight", "score"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long, score long")


def nth_smallest(rows: DataFrame, value: Column, lo: int, hi: int, n: int) -> tuple[int, int]:
    """(v, rows under v): the smallest v in [lo, hi] with at least ``n`` rows at or under it, by bisection.

    Every step is one job that counts all rows at or under evenly spaced thresholds; only the counts come back.
    """
    under = 0  # rows at or under lo - 1
    while lo < hi:
        cuts = sorted({lo + (hi - lo) * i // PARTS_PER_STEP for i in range(PARTS_PER_STEP)})
        found = rows.agg(*[F.count_if(value <= F.lit(c)).alias(f"c{i}") for i, c in enumerate(cuts)]).first()
        at = next((i for i in range(len(cuts)) if found[i] >= n), len(cuts))
        if at < len(cuts):
            hi = cuts[at]
        if at > 0:
            lo, under = cuts[at - 1] + 1, found[at - 1]
    return lo, under


def resample(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text",
    min_words: int = 20, percent: int = 25, buckets: int = BUCKETS, seed: int = 7,
) -> DataFrame:
    """One row per document: ``doc_id, n_features, weight, score, rank``; rank is NULL for the undrawn.

    Of the N documents with at least ``min_words`` words the floor(percent * N / 100) highest scores are drawn, ties
    to the smaller id. A null text is empty: no features, weight 0. Rows with a null id take their noise from the
    empty text and come after all ids in a tie. Repeated rows count, score and are drawn one by one; among rows equal
    in score and id any may come first. Texts of any length are read whole, in pieces. With no target text, or no
    document, the counts are zero and only their sums differ. Other columns are not read.
    """
    spark = docs.sparkSession
    gains = bucket_gains(bucket_counts(docs, text_col, buckets), bucket_counts(target, target_col, buckets))
    numbered = scored(docs, gains, id_col, text_col, seed).withColumn("row", F.monotonically_increasing_id())
    rows = stored(numbered, "scores")

    # Order of drawing: highest score, smallest id, row. Every part is a whole number and ascends.
    able = rows.filter(F.col("n_words") >= min_words)
    known = able.agg(F.count("*"), F.min(-F.col("score")), F.max(-F.col("score"))).first()
    take = percent * known[0] // 100
    if take == 0:
        return rows.select("doc_id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank"))
    keys = [-F.col("score"), F.coalesce("doc_id", F.lit(LAST)), F.col("row")]
    ahead, drawn = F.lit(False), F.lit(False)
    need, tied, span = take, able, (known[1], known[2])
    for i, key in enumerate(keys):
        if i:
            seen = tied.agg(F.min(key), F.max(key)).first()
            span = (seen[0], seen[1])
        cut, under = nth_smallest(tied, key, *span, need)
        ahead = ahead | ((key < cut) if i == 0 else (same & (key < cut)))
        same = (key == cut) if i == 0 else (same & (key == cut))
        need, tied = need - under, tied.filter(key == cut)
        drawn = ahead | same
        if tied.count() == need:  # all that are tied here are drawn: the cutoff is found
            break
    drawn = F.coalesce((F.col("n_words") >= min_words) & drawn, F.lit(False))

    # Ranks: ranges of the drawn rows, sorted; the numbers Spark gives them hold the range and the place in it.
    placed = (
        rows.filter(drawn).repartitionByRange(F.desc("score"), keys[1], "row")
        .sortWithinPartitions(F.desc("score"), keys[1], "row")
        .withColumn("place", F.monotonically_increasing_id())
    )
    placed = stored(placed, "drawn")
    part, inside = F.shiftright("place", 33), F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    before, sizes = 0, []
    for r in placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect():  # one row per range
        sizes.append((r.part, before))
        before += r.n
    starts = spark.createDataFrame(sizes, "part long, before long")
    ranked = placed.withColumn("part", part).join(starts, "part").withColumn("rank", F.col("before") + inside + 1)
    columns = ["doc_id", "n_features", "weight", "score"]
    return ranked.select(*columns, "rank").unionAll(rows.filter(~drawn).select(*columns, F.lit(None).cast("long").alias("rank")))
