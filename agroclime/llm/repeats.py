"""Repeated byte windows across documents by a depth-limited most-significant-digit radix sort.

Only the first ``window`` bytes of a suffix matter, so the sort stops there, and equal groups are exactly the
repeated windows. The digits, from most to least significant:

1. the smallest hash among the window's ``anchor``-byte strings (equal windows have equal smallest hashes, and
   neighbouring windows share theirs, so a run of windows takes one row instead of one row each);
2. the bytes of the whole run: where two runs are equal, all their windows are;
3. the bytes of the single window, only for each kind's smallest document, where the first digit also occurs in another kind.

A pass deals its rows out by digit in packed arrays and sorts each part in memory; groups with one member end there.
Copies inside one batch of documents are settled before anything is shuffled, so a passage in a third of all
documents costs a row per batch.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agroclime.llm import textvec as tv
from agroclime.llm.store import release, stored

WINDOW, ANCHOR = 50, 24
_PACK = [("key", np.uint64), ("content", np.uint64), ("doc", np.int64), ("start", np.int32), ("count", np.int32)]
_MARK = pa.schema([("doc", pa.int64()), ("settled", pa.bool_()), ("start", pa.int32()), ("count", pa.int32()), ("key", pa.int64())])
_MARK_SQL = "doc long, settled boolean, start int, count int, key long"


def _pack(rows: dict[str, np.ndarray]) -> bytes:
    """Arrays byte by byte (all first bytes, then all second bytes, ...): equal high bytes stand together and compress."""
    return b"".join(np.ascontiguousarray(rows[n].astype(t)).view(np.uint8).reshape(-1, np.dtype(t).itemsize).T.tobytes() for n, t in _PACK)


def _unpack(data: bytes) -> dict[str, np.ndarray]:
    n = len(data) // sum(np.dtype(t).itemsize for _, t in _PACK)
    out, at = {}, 0
    for name, t in _PACK:
        size = np.dtype(t).itemsize
        part = np.frombuffer(data, np.uint8, n * size, at).reshape(size, n)
        out[name] = np.ascontiguousarray(part.T).view(t).ravel()
        at += n * size
    return out


def runs(data: np.ndarray, offsets: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, ...]:
    """Runs of neighbouring windows with one smallest anchor hash: key, content hash, text, first start in text, count."""
    n, span = len(data), window - anchor + 1
    if n < window:
        return tuple(np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64, np.int64))
    at = np.arange(n - anchor + 1)
    low, wide = tv.span_hashes(data, at, at + anchor), 1
    while wide < span:
        step = min(wide, span - wide)
        low = np.minimum(low[: len(low) - step], low[step:])
        wide += step
    starts = np.arange(len(low))
    whole = starts + window <= np.repeat(offsets[1:], np.diff(offsets))[: len(low)]
    begins = whole.copy()
    begins[1:] &= ~(whole[:-1] & (low[1:] == low[:-1]))
    ends = whole.copy()
    ends[:-1] &= ~(whole[1:] & ~begins[1:])
    first, last = np.flatnonzero(begins), np.flatnonzero(ends)
    text = np.searchsorted(offsets, first, "right") - 1
    return low[first], tv.span_hashes(data, first, last + window), text, first - offsets[text], last - first + 1


def _groups(key: np.ndarray, content: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by key, content, document, and in it which rows begin a new (key, content)."""
    order = np.lexsort((doc, content, key))
    k, c = key[order], content[order]
    new = np.ones(len(order), bool)
    new[1:] = (k[1:] != k[:-1]) | (c[1:] != c[:-1])
    return order, new


def _later(doc: np.ndarray, order: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Rows (in sorted order) whose document is larger than the smallest of their group."""
    d = doc[order]
    return d > d[np.flatnonzero(new)[np.cumsum(new) - 1]] if len(d) else np.zeros(0, bool)


def _deal(rows: dict[str, np.ndarray], settle: bool, parts: int):
    """Rows packed by digit: (part, data), the batch's own later copies as part -1."""
    order, new = _groups(rows["key"], rows["content"], rows["doc"])
    later = _later(rows["doc"], order, new)
    # Of one (key, content) a batch sends the places in its smallest document; all others are settled.
    send = order[~later]
    kept = {n: a[send] for n, a in rows.items()}
    part = (tv.mix(kept["key"] ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(parts)).astype(np.int64)
    by = np.argsort(part, kind="stable")
    cut = np.flatnonzero(np.diff(part[by], prepend=-1, append=-1))
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        yield int(part[by[a]]), _pack({n: x[by[a:b]] for n, x in kept.items()})
    gone = order[later]
    if len(gone) and settle:
        yield -1, _pack({n: x[gone] for n, x in rows.items()})


def _packed(out) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p for p, _ in out], pa.int64()), pa.array([d for _, d in out], pa.binary())], names=["part", "data"])


def _joined(packs: list[bytes]) -> dict[str, np.ndarray]:
    opened = [_unpack(p) for p in packs]
    return {n: np.concatenate([o[n] for o in opened]) for n, _ in _PACK}


def _sort_parts(dealt: DataFrame, refine: bool) -> DataFrame:
    """Marks: windows settled as repeats, and with ``refine`` the smallest document's runs of each kind where a first digit has several kinds."""

    def marks(rows, order, settled):
        n = len(order)
        return pa.RecordBatch.from_arrays([pa.array(rows["doc"][order]), pa.array(np.full(n, settled)), pa.array(rows["start"][order]), pa.array(rows["count"][order]), pa.array(rows["key"][order].view(np.int64))], schema=_MARK)

    def close(packs):
        rows = _joined(packs)
        order, new = _groups(rows["key"], rows["content"], rows["doc"])
        later = _later(rows["doc"], order, new)
        yield marks(rows, order[later], True)
        if refine:
            key = rows["key"][order]
            at = np.cumsum(np.concatenate(([0], key[1:] != key[:-1])))
            several = np.bincount(at, new)[at] > 1
            yield marks(rows, order[several & ~later], False)

    def run(batches):
        part, packs = None, []
        for batch in batches:
            for p, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if p == -1:
                    rows = _unpack(data.as_py())
                    yield marks(rows, np.arange(len(rows["doc"])), True)
                    continue
                if p != part and packs:
                    yield from close(packs)
                    packs = []
                part = p
                packs.append(data.as_py())
        if packs:
            yield from close(packs)

    # Settled rows (part -1) are spread by their content; they only pass through.
    spread = F.when(F.col("part") >= 0, F.col("part")).otherwise(F.xxhash64(F.length("data"), F.substring("data", 1, 64)))
    return dealt.repartition(spread).sortWithinPartitions("part").mapInArrow(run, _MARK_SQL)


def _parts(spark: SparkSession) -> int:
    return 16 * max(16, int(spark.conf.get("spark.sql.shuffle.partitions")))


def _intervals(marks: DataFrame, window: int) -> DataFrame:
    """(doc, marks): neighbouring or overlapping byte ranges of each document's settled windows, as an array of ranges."""
    return marks.filter("settled").groupBy("doc").agg(F.collect_list(F.struct("start", (F.col("start") + F.col("count") - 1 + F.lit(window)).alias("end"))).alias("ranges"))


def repeated_ranges(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """(doc, ranges): byte ranges covered by windows that also start in a document with a smaller id."""
    spark = docs.sparkSession
    parts = _parts(spark)
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).filter(f"id is not null and octet_length(text) >= {window}")

    def first_digit(batches):
        for batch in tv.sub_batches(batches):
            data, offsets = tv.text_bytes(batch.column(1))
            key, content, text, start, count = runs(data, offsets, window, anchor)
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            if len(key):
                yield _packed(list(_deal({"key": key, "content": content, "doc": ids[text], "start": start, "count": count}, True, parts)))

    marks = stored(_sort_parts(source.mapInArrow(first_digit, "part long, data binary"), refine=True), "marks")
    release(spark)

    wanted = marks.filter("not settled").groupBy(F.col("doc").alias("id")).agg(F.collect_list(F.struct("start", "count", "key")).alias("runs"))

    def windows(batches):
        for batch in tv.sub_batches(batches):
            data, offsets = tv.text_bytes(batch.column(1))
            lists = batch.column(2)
            which = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            flat = lists.flatten()
            start, count, key = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(3))
            within = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            at = np.repeat(start, count) + within
            text = np.repeat(which, count)
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            content = tv.span_hashes(data, at + offsets[text], at + offsets[text] + window)
            rows = {"key": np.repeat(key, count).view(np.uint64), "content": content, "doc": ids[text], "start": at, "count": np.ones(len(at), np.int64)}
            if len(at):
                yield _packed(list(_deal(rows, True, parts)))

    opened = source.join(wanted, "id").select("id", "text", "runs").mapInArrow(windows, "part long, data binary")
    last = stored(_sort_parts(opened, refine=False), "windows")
    release(spark)
    return _intervals(marks.filter("settled").unionByName(last), window)


def _merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal covered runs of overlapping or touching ranges."""
    order = np.argsort(starts, kind="stable")
    s, reach = starts[order], np.maximum.accumulate(ends[order])
    new = np.ones(len(s), bool)
    new[1:] = s[1:] > reach[:-1]
    at = np.flatnonzero(new)
    return s[at], reach[np.append(at[1:], len(s)) - 1]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, texts: bool = False) -> DataFrame:
    """One row per document: ``id_col, n_bytes, n_removed, n_spans, kept_sha256`` (and with ``texts`` the kept bytes).

    A null text is empty and nothing is removed from texts under ``window`` bytes. Ids are unique: a row repeated
    whole gives equal rows and does not count as its own earlier copy. Rows with a null id keep all bytes and are no
    one's source. Other columns are not read.
    """
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    joined = source.join(repeated_ranges(docs, id_col, text_col, window), F.col("id") == F.col("doc"), "left").select("id", "text", "ranges")
    names = [id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if texts else [])]
    kinds = [pa.int64()] * 4 + [pa.string(), *([pa.binary()] if texts else [])]

    def run(batches):
        for batch in tv.sub_batches(batches):
            rows = []
            lists = batch.column(2)
            edge = lists.offsets.to_numpy()
            flat = lists.flatten()
            base = edge[0] if len(edge) else 0
            lo, hi = (flat.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(2))
            for i, (doc_id, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1), strict=True)):
                data = memoryview(text.as_buffer() or b"") if text.is_valid else memoryview(b"")
                s, e = _merged(lo[edge[i] - base : edge[i + 1] - base], hi[edge[i] - base : edge[i + 1] - base]) if edge[i + 1] > edge[i] else ((), ())
                digest, kept, at = hashlib.sha256(), [], 0
                for a, b in [*zip(s, e, strict=True), (len(data), len(data))]:
                    digest.update(data[at:a])
                    if texts:
                        kept.append(bytes(data[at:a]))
                    at = b
                gone = int(np.sum(np.subtract(e, s))) if len(s) else 0
                rows.append((doc_id, len(data), gone, len(s), digest.hexdigest(), *([b"".join(kept)] if texts else [])))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return joined.mapInArrow(run, f"`{id_col}` long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if texts else ""))
