"""Benchmark passages in documents: SimHash of windows sized to the items, multi-index Hamming blocks, exact check.

Every item gives disjoint windows, so many that edits in all of them (words changed, added, dropped or moved) would
push the similarity below ``least``: one window is always untouched. Every window of each size class in every document
gets a 64-bit SimHash of its words by sliding sums. Four blocks of 16 bits index the item fingerprints: within distance
7 some block differs in at most one bit, so looking up every key within one bit of an item's block finds all
fingerprints in the radius. Each is confirmed on all windows of the item's full length that hold it, by the weighted
Jaccard similarity of word shingles (weight: how often a shingle occurs).
"""

from __future__ import annotations

from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agroclime.llm import textvec as tv

RADIUS, BLOCKS = 7, 4
PIECE_ITEMS = 20_000   # benchmark items that go to the tasks at once; a larger benchmark takes more passes
PIECE_BYTES = 32 << 20
_WORDS = 1 << 15       # words whose bit sums are held at once


def size_class(words: int) -> int:
    """The largest of 1, 2, 3, 4, 6, 8, 12, 16, 24, ... that is at most ``words``."""
    best = 1
    for base in (2, 3):
        k = base
        while k <= words:
            best, k = max(best, k), 2 * k
    return best


def _least_lost(layout: list[tuple[int, int]], words: int, shingle: int) -> int:
    """The fewest shingles of an item that are lost when something changes inside each window of the layout.

    A changed word loses the shingles that hold it, a break between two words those that span it.
    """
    last = words - shingle
    ways = [(-1, 0)]  # shingles lost up to, and how many
    for begin, size in layout:
        events = [(max(p - shingle + 1, 0), min(p, last)) for p in range(begin, begin + size)]
        events += [(max(p - shingle + 1, 0), min(p - 1, last)) for p in range(begin + 1, begin + size)]
        cheapest: dict[int, int] = {}
        for a, b in set(events):
            n = min(lost + max(b - max(a, upto + 1) + 1, 0) for upto, lost in ways)
            cheapest[b] = min(cheapest.get(b, n), n)
        ways = list(cheapest.items())
    return min(lost for _, lost in ways)


@lru_cache(maxsize=4096)
def windows(words: int, shingle: int, least: float) -> tuple[tuple[int, int], ...]:
    """(first word, words) of an item's disjoint windows, one of which any window of similarity ``least`` leaves whole.

    ``n`` shingles of which ``x`` are lost leave a similarity of at most (n - x) / n.
    """
    if words < shingle:  # such an item must be there word by word
        return ((0, size_class(words)),)
    total = words - shingle + 1
    allowed = int(total * (1 - least) + 1e-9)
    count = 1
    while True:
        edges = [j * words // count for j in range(count + 1)]
        sizes = [size_class(b - a) for a, b in zip(edges[:-1], edges[1:], strict=True)]
        layout = [(a, c) for a, c in zip(edges[:-1], sizes, strict=True)]
        if count > 1:
            layout[-1] = (words - sizes[-1], sizes[-1])
        missing = allowed + 1 - _least_lost(layout, words, shingle)
        if missing <= 0 or count == words:
            return tuple(layout)
        count = min(count + max(1, missing // shingle), words)


def simhashes(hashes: np.ndarray, size: int, counted: np.ndarray | None = None) -> np.ndarray:
    """64-bit SimHash of each run of ``size`` words; bit b is set where most words have it."""
    sums = bit_sums(hashes) if counted is None else counted
    inside = sums[size:] - sums[:-size]
    return np.packbits(inside > size // 2, axis=1, bitorder="little").view("<u8").ravel()


def bit_sums(hashes: np.ndarray) -> np.ndarray:
    bits = np.unpackbits(np.ascontiguousarray(hashes).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    sums = np.zeros((len(hashes) + 1, 64), np.uint16)
    np.cumsum(bits, axis=0, dtype=np.uint16, out=sums[1:])
    return sums


class HammingIndex:
    """All fingerprints within RADIUS of a query, through BLOCKS tables of 16-bit keys within one bit."""

    def __init__(self, prints: np.ndarray):
        self.prints = prints
        near = np.concatenate(([0], 1 << np.arange(16))).astype(np.uint16)
        self.tables = []
        for b in range(BLOCKS):
            keys = ((prints >> np.uint64(16 * b)) & np.uint64(0xFFFF)).astype(np.uint16)
            all_keys = (keys[:, None] ^ near[None, :]).ravel()
            owner = np.repeat(np.arange(len(prints)), len(near))
            order = np.argsort(all_keys, kind="stable")
            begin = np.searchsorted(all_keys[order], np.arange(65537))
            self.tables.append((begin, owner[order], np.diff(begin) > 0))

    def search(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query index, fingerprint index) within the radius, each once."""
        parts = np.ascontiguousarray(queries).view("<u2").reshape(-1, BLOCKS)
        found = [np.zeros(0, np.int64)]
        for b, (begin, owner, used) in enumerate(self.tables):
            q = np.flatnonzero(used[parts[:, b]])
            key = parts[q, b].astype(np.int64)
            n = begin[key + 1] - begin[key]
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin[key], n)
            who, q = owner[at], np.repeat(q, n)
            close = np.bitwise_count(queries[q] ^ self.prints[who]) <= RADIUS
            found.append(q[close] * len(self.prints) + who[close])
        pairs = np.unique(np.concatenate(found))
        return pairs // len(self.prints), pairs % len(self.prints)


def weighted(words: list, size: int) -> Counter:
    if len(words) < size:
        return Counter([tuple(words)] if words else [])
    return Counter(zip(*(words[i:] for i in range(size)), strict=False))


def similarity(x: Counter, y: Counter) -> float:
    both = sum((x & y).values())
    either = sum(x.values()) + sum(y.values()) - both
    return both / either if either else 0.0


def _items(rows: list[tuple[int, str]], shingle: int, least: float):
    """Words, shingle weights and per-class Hamming indexes of a piece of the benchmark."""
    column = pa.array([t for _, t in rows], pa.string())
    words = tv.words_of(column)
    text = bytes(words.data)
    lists = [[text[s:e] for s, e in zip(words.starts[a:b].tolist(), words.ends[a:b].tolist(), strict=True)] for a, b in zip(words.first[:-1], words.first[1:], strict=True)]
    classes: dict[int, list] = {}
    for i, w in enumerate(lists):
        if w:
            h = words.hashes[words.first[i] : words.first[i + 1]]
            for begin, c in windows(len(w), shingle, least):
                classes.setdefault(c, []).append((simhashes(h[begin : begin + c], c)[0], i))
    indexes = {c: (HammingIndex(np.array([x[0] for x in v], np.uint64)), np.array([x[1] for x in v], np.int64)) for c, v in classes.items()}
    return lists, [weighted(w, shingle) for w in lists], indexes


def _best_window(words: list, item: list, weights: Counter, spans: list[tuple[int, int]], shingle: int, least: float):
    """(score, first word, last word + 1) of the best window of the item's length, the first of equals, that starts in a span.

    ``words`` are the document's; a window reaching over its begin or end is cut there. None where none reaches ``least``.
    """
    size, n = len(item), len(words)
    if size < shingle:
        at = next((x for a, b in spans for x in range(max(a, 0), b + 1) if words[x : x + size] == item), None)
        return None if at is None else (1.0, at, at + size)
    total, best = sum(weights.values()), None
    for a, b in spans:
        begin, end = max(a, 0), min(b + size, n)
        grams = list(zip(*(words[begin + j : end] for j in range(shingle)), strict=False))
        limits = [weights.get(g, 0) for g in grams]
        if sum(map(bool, limits)) < least * total - 1e-9:
            continue
        held: Counter = Counter()
        both = lo = hi = 0
        for x in range(a, b + 1):
            first, last = max(x, 0) - begin, min(x + size, n) - begin - shingle + 1
            while hi < last:
                held[grams[hi]] += 1
                both += held[grams[hi]] <= limits[hi]
                hi += 1
            while lo < min(first, hi):
                both -= held[grams[lo]] <= limits[lo]
                held[grams[lo]] -= 1
                lo += 1
            score = both / (total + hi - lo - both)
            if score >= least and (best is None or score > best[0]):
                best = (score, max(x, 0), min(x + size, n))
    return best


def _matches(batch, ids, lists, weights, indexes, shingle: int, least: float):
    """(doc position, item id, score, first word, last word + 1) of confirmed windows of a record batch."""
    words = tv.words_of(batch.column(1))
    text, n = words.data, len(words.hashes)
    doc_of = np.repeat(np.arange(batch.num_rows), np.diff(words.first))
    sizes = np.array([len(w) for w in lists], np.int64)
    widest = max(indexes, default=1)
    tries = [np.zeros((4, 0), np.int64)]  # document, item, first and last start of the windows that hold the fingerprint's words
    for a in range(0, n, _WORDS):
        b = min(n, a + _WORDS + widest - 1)
        sums = bit_sums(words.hashes[a:b])
        for c, (index, item) in indexes.items():
            last = min(a + _WORDS, n - c + 1)
            if last <= a:
                continue
            prints = simhashes(words.hashes[a:b], c, sums[: last - a + c])
            q, who = index.search(prints)
            whole = doc_of[a + q] == doc_of[a + q + c - 1]
            q, i = a + q[whole], item[who[whole]]
            start = q - words.first[doc_of[q]]
            tries.append(np.stack((doc_of[q], i, start + c - sizes[i], start)))
    found = np.concatenate(tries, axis=1)
    found = found[:, np.lexsort((found[2], found[1], found[0]))]
    edge = np.flatnonzero(np.any(found[:2, 1:] != found[:2, :-1], axis=0)) + 1 if found.shape[1] else []
    held, mine = None, []
    for x, y in zip([0, *edge], [*edge, found.shape[1]], strict=True) if found.shape[1] else ():
        d, i = int(found[0, x]), int(found[1, x])
        spans: list[tuple[int, int]] = []
        for lo, hi in zip(found[2, x:y].tolist(), found[3, x:y].tolist(), strict=True):
            if spans and lo <= spans[-1][1] + 1:
                spans[-1] = (spans[-1][0], max(spans[-1][1], hi))
            else:
                spans.append((lo, hi))
        if held != d:
            p, q = words.first[d], words.first[d + 1]
            held, mine = d, [text[s:e].tobytes() for s, e in zip(words.starts[p:q].tolist(), words.ends[p:q].tolist(), strict=True)]
        best = _best_window(mine, lists[i], weights[i], spans, shingle, least)
        if best is not None:
            yield d, ids[i], *best


def pieces(benchmark: DataFrame, id_col: str, text_col: str):
    """The benchmark in pieces of at most PIECE_ITEMS items and about PIECE_BYTES bytes, streamed to the driver in order."""
    held, size = [], 0
    rows = benchmark.select(F.col(id_col).cast("long"), F.coalesce(F.col(text_col).cast("string"), F.lit(""))).distinct()
    for item, text in rows.toLocalIterator():
        held.append((item, text))
        size += 4 * len(text)
        if len(held) >= PIECE_ITEMS or size >= PIECE_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", shingle: int = 5, least: float = 0.8) -> DataFrame:
    """One row per document and benchmark item found in it: ``id_col, item_id, score, first_word, end_word``.

    ``score`` is the best weighted shingle similarity of a window of the item's length, at least ``least``; a window that
    reaches over the text's begin or end is cut there, and of equal windows the first is given. Null or
    wordless texts and items match nothing; repeated documents each give their rows; an empty benchmark gives none.
    Other columns are not read.
    """
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = f"`{id_col}` long, `{item_id}` long, score double, first_word long, end_word long"
    names = [id_col, item_id, "score", "first_word", "end_word"]
    kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
    spark = docs.sparkSession
    out = spark.createDataFrame([], schema)

    for number, rows in enumerate(pieces(benchmark, item_id, item_text)):
        sent = spark.sparkContext.broadcast(rows)

        def run(batches, sent=sent):
            ids = [i for i, _ in sent.value]
            lists, weights, indexes = _items(sent.value, shingle, least)
            for batch in tv.sub_batches(batches):
                found = list(_matches(batch, ids, lists, weights, indexes, shingle, least))
                if found:
                    d, *rest = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(d)), *(pa.array(c, k) for c, k in zip(rest, kinds[1:], strict=True))], names=names)

        found = source.mapInArrow(run, schema)
        out = found if number == 0 else out.unionByName(found)
    return out
