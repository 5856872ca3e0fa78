"""Byte-level BPE: Spark higher-order functions fold ranked merges over the bytes of distinct words.

A task packs its documents into blocks: one row with the block's distinct words and, per document, which words it
is made of. Distinct words are dealt into buckets by hash, and a bucket's distinct words are folded once for all
blocks, in the JVM against a literal rank map. Codes go back to the blocks in packed rows, one per bucket and block,
and a last step lays them out as documents. Blocks are stored dealt by their number, so that they stay where they are
when their codes come. No table of words is gathered on the driver or sent to all tasks.
Decoding concatenates the binary pieces of the ids.

Bytes are kept as one character each (ISO-8859-1), so that string functions work on them. A fold costs the square of
a word's length: words of ``LONG`` bytes or more, such as a long run of one character, are merged by ``tiktoken``
itself, whose merges of a long word take linear-logarithmic time.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agroclime.llm import textvec as tv
from agroclime.llm.store import split_bytes, stored_by

BLOCK_BYTES = 8 << 20
LAY_BYTES = 2 << 20
BUCKET_WORDS = 96_000  # words of all blocks that a bucket holds on average
LONG = 192
_BUCKETS = 16_384


@functools.cache
def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def jvm_pattern(pattern: str) -> str:
    """The same pattern for Java: Unicode meaning of ``\\s``."""
    return "(?U)" + pattern


def _let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def _murmur3(data: bytes) -> int:
    """Spark's ``hash`` of a string of these UTF-8 bytes."""
    mask, h = 0xFFFFFFFF, 42

    def mixed(h, k):
        k = k * 0xCC9E2D51 & mask
        k = (k << 15 | k >> 17) & mask
        h ^= k * 0x1B873593 & mask
        h = (h << 13 | h >> 19) & mask
        return (h * 5 + 0xE6546B64) & mask

    whole = len(data) // 4 * 4
    for i in range(0, whole, 4):
        h = mixed(h, int.from_bytes(data[i : i + 4], "little"))
    for b in data[whole:]:
        h = mixed(h, (b - 256 if b > 127 else b) & mask)
    h ^= len(data)
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        h = (h ^ h >> shift) * factor & mask
    h ^= h >> 16
    return h - (1 << 32) if h >> 31 else h


class Vocabulary:
    """The rank literal of one rank file. The map is split by hash so that a look-up scans a few entries.

    The literal is bound once per expression (``_let``) and used through that variable: plans, and the tasks that are
    made of them, then hold one copy of it.
    """

    def __init__(self, ranks: dict[bytes, int]):
        buckets: list[dict[str, int]] = [{} for _ in range(_BUCKETS)]
        for token, rank in ranks.items():
            text = token.decode("latin-1")
            buckets[_murmur3(text.encode()) % _BUCKETS][text] = rank
        # from_json of a literal is computed once, by the optimizer
        self.buckets = F.from_json(F.lit(json.dumps(buckets, ensure_ascii=False)), "array<map<string,int>>")
        # ids travel as two bytes where that holds them all
        self.middle, self.kind = (32_768, "smallint") if max(ranks.values()) < 65_536 else (0, "int")

    def encode_words(self, words: Column) -> Column:
        """Ids of every word of an array (array<array<int>>)."""
        return _let(self.buckets, lambda b: F.transform(words, _Merges(b).encode_word))


class _Merges:
    """Merges of one word against the bound rank literal."""

    def __init__(self, buckets: Column):
        self._buckets = buckets

    def rank(self, token: Column) -> Column:
        return F.try_element_at(F.get(self._buckets, F.pmod(F.hash(token), F.lit(_BUCKETS))), token)

    def _pair_ranks(self, tokens: Column) -> Column:
        n = F.size(tokens)
        return F.zip_with(F.slice(tokens, F.lit(1), n - 1), F.slice(tokens, F.lit(2), n), lambda a, b: F.when(b.isNotNull(), self.rank(F.concat(a, b))))

    def _merge(self, state: Column) -> Column:
        """Merge the lowest pair at its first place; only the two pairs beside it get new ranks.

        What a ``_let`` returns is copied, so that only the last one holds the whole state.
        """
        tokens, ranks = state["tokens"], state["ranks"]
        n, none = F.size(tokens), F.array().cast("array<int>")

        def met(p: Column) -> Column:
            return F.struct(p.alias("place"), F.concat(F.get(tokens, p - 1), F.get(tokens, p)).alias("merged"))

        def rebuilt(x: Column) -> Column:
            p, m = x["place"], x["merged"]
            before = F.when(p > 1, F.array(self.rank(F.concat(F.get(tokens, p - 2), m)))).otherwise(none)
            after = F.when(p + 1 < n, F.array(self.rank(F.concat(m, F.get(tokens, p + 1))))).otherwise(none)
            left = F.transform(tokens, lambda t, i: F.when(i == p, F.lit(None)).when(i == p - 1, m).otherwise(t))
            return F.struct(
                F.filter(left, lambda t: t.isNotNull()).alias("tokens"),
                F.flatten(F.array(F.slice(ranks, F.lit(1), F.greatest(p - 2, F.lit(0))), before, after, F.slice(ranks, p + 2, n))).alias("ranks"),
            )

        place = F.array_position(ranks, F.array_min(ranks)).cast("int")
        return F.when(F.array_min(ranks).isNull(), state).otherwise(_let(_let(place, met), rebuilt))

    def encode_word(self, word: Column) -> Column:
        """Ids of one word (array<int>)."""
        raw = F.decode(F.encode(word, "UTF-8"), "ISO-8859-1")

        def fold(w: Column) -> Column:
            tokens = F.split(w, "")
            start = F.struct(tokens.alias("tokens"), self._pair_ranks(tokens).alias("ranks"))
            merged = F.aggregate(F.sequence(F.lit(2), F.length(w)), start, lambda s, _: self._merge(s))["tokens"]
            # A word that is a token itself needs no merges.
            return _let(self.rank(w), lambda r: F.when(r.isNotNull(), F.array(r)).otherwise(F.transform(merged, self.rank)))

        return _let(raw, fold)


class _Pieces:
    """Bytes of every id, and the merges of long words; built from the rank table in a task."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self._codec = ranks, None
        by_id = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            by_id[rank] = token
        self.raw = np.frombuffer(b"".join(by_id), np.uint8)
        self.sizes = np.array([len(b) for b in by_id], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def direct(self, words: list[str]) -> list[list[int] | None]:
        """Ids of the words that need no fold: those that are tokens themselves, and long ones."""
        return [[rank] if (rank := self.ranks.get(raw := w.encode())) is not None else self.encode(w) if len(raw) >= LONG else None for w in words]

    def encode(self, word: str) -> list[int]:
        if self._codec is None:
            import tiktoken

            self._codec = tiktoken.Encoding("words", pat_str="(?s).+", mergeable_ranks=self.ranks, special_tokens={})
        return self._codec.encode_ordinary(word)


def _squeezed(values: np.ndarray) -> bytes:
    """32-bit numbers as four planes of bytes, compressed: the high planes are nearly all zero."""
    planes = np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()
    return len(values).to_bytes(4, "little") + pa.compress(planes, "zstd", asbytes=True)


def _opened(packed: bytes) -> np.ndarray:
    n = int.from_bytes(packed[:4], "little")
    planes = np.frombuffer(pa.decompress(packed[4:], 4 * n, "zstd", asbytes=True), np.uint8).reshape(4, n)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def _steps(at: np.ndarray) -> bytes:
    """Ascending numbers by their differences."""
    return _squeezed(np.diff(at, prepend=0))


def _places(packed: bytes) -> np.ndarray:
    return np.cumsum(_opened(packed), dtype=np.int64)


def _squeezed_words(words: pa.Array) -> tuple[bytes, bytes]:
    """Sizes and bytes of strings."""
    sizes = pc.binary_length(words).to_numpy(zero_copy_only=False)
    data = b"".join(words.cast(pa.binary()).to_pylist())
    return _squeezed(sizes), len(data).to_bytes(4, "little") + pa.compress(data, "zstd", asbytes=True)


def _opened_words(sizes: bytes, data: bytes) -> pa.Array:
    ends = np.concatenate(([0], np.cumsum(_opened(sizes)))).astype(np.int32)
    raw = pa.decompress(data[4:], int.from_bytes(data[:4], "little"), "zstd")
    return pa.StringArray.from_buffers(len(ends) - 1, pa.py_buffer(ends.tobytes()), raw)


_BODY = "block long, ids array<long>, counts array<int>, places binary, n_words long, word_sizes binary, word_data binary, sizes array<int>, codes array<int>"


def _blocks(batches, direct):
    """One row per block of documents: ids, words per document, index of each word, distinct words, codes of known ones.

    Indexes count the words whose ids are known without a fold (``direct``) first, then the others.
    """
    held, size = [], 0
    number = TaskContext.get().partitionId() << 33

    def block():
        ids = pa.concat_arrays([b for b, _, _ in held])
        counts = np.concatenate([c for _, c, _ in held])
        coded = pa.chunked_array([w for _, _, w in held]).combine_chunks().dictionary_encode()
        # Frequent words get small numbers, which pack well.
        order = np.argsort(-np.bincount(coded.indices.to_numpy(zero_copy_only=False), minlength=len(coded.dictionary)), kind="stable")
        ranked = coded.dictionary.take(pa.array(order))
        ids_of = direct(ranked.to_pylist())
        folded = np.array([x is None for x in ids_of], bool)
        known = [x for x in ids_of if x is not None]
        place = np.empty(len(order), np.int64)
        place[order] = np.where(folded, len(known) + np.cumsum(folded) - 1, np.cumsum(~folded) - 1)
        word_sizes, word_data = _squeezed_words(ranked.filter(pa.array(folded)))
        places = place[coded.indices.to_numpy(zero_copy_only=False)]
        one = lambda values, kind: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values.cast(kind))
        made = pa.RecordBatch.from_arrays([
            pa.array([number]), one(ids, pa.int64()), one(pa.array(counts), pa.int32()), pa.array([_squeezed(places)], pa.binary()), pa.array([int(folded.sum())], pa.int64()),
            *(pa.array([x], pa.binary()) for x in (word_sizes, word_data)),
            *(one(pa.array(x, pa.int32()), pa.int32()) for x in ([len(x) for x in known], [i for x in known for i in x])),
        ], names=["block", "ids", "counts", "places", "n_words", "word_sizes", "word_data", "sizes", "codes"])
        pa.default_memory_pool().release_unused()
        return made

    for batch in batches:
        words = batch.column(1)
        ends = words.offsets.to_numpy().astype(np.int64)
        flat = words.flatten()
        sizes = np.concatenate(([0], np.cumsum(pc.binary_length(flat).to_numpy(zero_copy_only=False).astype(np.int64))))
        ends = ends - ends[0]
        for a, b in split_bytes((sizes[ends[1:]] - sizes[ends[:-1]]).tolist(), BLOCK_BYTES):
            n = sizes[ends[b]] - sizes[ends[a]]
            if held and size + n > BLOCK_BYTES:
                yield block()
                held, size, number = [], 0, number + 1
            held.append((batch.column(0).slice(a, b - a), np.diff(ends[a : b + 1]), flat.slice(ends[a], ends[b] - ends[a])))
            size += n
    if held:
        yield block()


def _dealt(batches, buckets: int):
    """A block's words by bucket: one row per bucket with their places in the block."""
    for batch in batches:
        for r in range(batch.num_rows):
            words = _opened_words(batch.column(1)[r].as_py(), batch.column(2)[r].as_py())
            if not len(words):
                continue
            data, ends = tv.text_bytes(words)
            bucket = (tv.word_hashes(data, ends[:-1], ends[1:]) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            edges = np.concatenate(([0], np.flatnonzero(np.diff(bucket[order])) + 1, [len(order)]))
            dealt = words.take(pa.array(order))
            block = batch.column(0)[r].as_py()
            for first in range(0, len(edges) - 1, 256):
                rows = [(int(bucket[order[a]]), block, _steps(order[a:b]), *_squeezed_words(dealt.slice(a, b - a))) for a, b in zip(edges[first : first + 256], edges[first + 1 : first + 257], strict=False)]
                kinds = pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["bucket", "block", "at", "word_sizes", "word_data"])


def _gathered(batches):
    """One row per bucket: its distinct words, and for each block the places and which words they are."""
    now, held = None, []

    def bucket():
        lists = [_opened_words(sizes, data) for _, _, sizes, data in held]
        coded = pa.concat_arrays(lists).dictionary_encode()
        edges = np.concatenate(([0], np.cumsum([len(w) for w in lists])))
        index = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), coded.indices.cast(pa.int32()))
        one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
        return pa.RecordBatch.from_arrays([
            one(coded.dictionary), one(pa.array([x[0] for x in held], pa.int64())), one(pa.array([x[1] for x in held], pa.binary())),
            one(index),
        ], names=["words", "blocks", "at", "index"])

    for batch in batches:
        for r in range(batch.num_rows):
            key, *row = (batch.column(c)[r].as_py() for c in range(5))
            if held and key != now:
                yield bucket()
                held = []
            now = key
            held.append(row)
    if held:
        yield bucket()


def _returned(words: Column, vocabulary: Vocabulary) -> Column:
    """A gathered bucket's words folded, and the codes of each block's words: (block, at, sizes, codes) per block.

    Sizes and ids are moved by half their range, so that they fit into one and two bytes.
    """
    def by_block(codes: Column) -> Column:
        return F.transform(F.arrays_zip("blocks", "at", "index"), lambda z: F.struct(
            z["blocks"].alias("block"), z["at"].alias("at"), F.transform(z["index"], lambda i: (F.size(F.get(codes, i)) - 128).cast("tinyint")).alias("sizes"),
            F.transform(F.flatten(F.transform(z["index"], lambda i: F.get(codes, i))), lambda x: (x - vocabulary.middle).cast(vocabulary.kind)).alias("codes")))

    return _let(vocabulary.encode_words(words), by_block)


def _spread(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs ``values[starts[i]:starts[i] + sizes[i]]`` for i in places, joined, and where each begins."""
    n = sizes[places]
    begin = np.concatenate(([0], np.cumsum(n)))
    at = np.arange(begin[-1]) + np.repeat(starts[places] - begin[:-1], n)
    return values[at], begin


OUTPUTS = {"ids": pa.list_(pa.int32()), "decoded": pa.binary(), "n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}
_SPARK = {"ids": "array<int>", "decoded": "binary", "n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"}


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, columns: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and the asked columns, one row per document.

    ``ids`` are the token ids without special tokens, ``decoded`` the bytes they stand for, ``ids_sha256`` is over
    little-endian 32-bit ids. A null or empty text has no ids. Other columns are not read; repeated ids and texts
    give a row each.
    """
    ranks = load_ranks(ranks_path)
    vocabulary, shared = Vocabulary(ranks), docs.sparkSession.sparkContext.broadcast(ranks)  # one rank file
    split = F.regexp_extract_all(F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.lit(jvm_pattern(pattern)), F.lit(0))
    words = docs.select(F.col(id_col).cast("long").alias("id"), split.alias("words"))

    def pieces() -> _Pieces:
        if not hasattr(_Pieces, "kept") or _Pieces.kept.ranks is not shared.value:
            _Pieces.kept = _Pieces(shared.value)
        return _Pieces.kept

    blocks = stored_by(words.mapInArrow(lambda batches: _blocks(batches, lambda w: pieces().direct(w)), _BODY), "blocks", "block")
    n_words = blocks.agg(F.coalesce(F.sum("n_words"), F.lit(0))).first()[0]
    buckets = max(1, -(-n_words // BUCKET_WORDS))
    dealt = blocks.select("block", "word_sizes", "word_data").mapInArrow(lambda batches: _dealt(batches, buckets), "bucket int, block long, at binary, word_sizes binary, word_data binary")
    met = dealt.repartition(buckets, "bucket").sortWithinPartitions("bucket", "block")
    gathered = met.mapInArrow(_gathered, "words array<string>, blocks array<long>, at array<binary>, index array<array<int>>")
    coded = gathered.select(F.inline(_returned(F.col("words"), vocabulary)))

    middle = vocabulary.middle

    def lay_out(body: pa.Table, back: pa.Table) -> pa.Table:
        kept = pieces()
        whole = lambda table, name: table.column(name).combine_chunks()
        ids, counts, known, codes = (whole(body, name).flatten() for name in ("ids", "counts", "sizes", "codes"))
        places = _opened(whole(body, "places")[0].as_py())
        at = np.concatenate([np.arange(len(known)), *(len(known) + _places(x) for x in whole(back, "at").to_pylist())])
        size = np.concatenate([known.to_numpy(zero_copy_only=False), whole(back, "sizes").flatten().to_numpy(zero_copy_only=False).astype(np.int64) + 128])
        flat = np.concatenate([codes.to_numpy(zero_copy_only=False), whole(back, "codes").flatten().to_numpy(zero_copy_only=False).astype(np.int64) + middle]).astype("<u4")
        starts, lengths = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        starts[at], lengths[at] = np.cumsum(size) - size, size
        ends = np.concatenate(([0], np.cumsum(counts.to_numpy(zero_copy_only=False).astype(np.int64))))
        reach = np.concatenate(([0], np.cumsum(lengths[places])))
        laid = []
        for a, b in split_bytes((4 * np.diff(reach[ends])).tolist(), LAY_BYTES):
            here, edge = places[ends[a] : ends[b]], ends[a : b + 1] - ends[a]
            tokens, begin = _spread(flat, starts, lengths, here)
            raw, start = _spread(kept.raw, kept.starts, kept.sizes, tokens)
            begin = begin[edge]
            laid.append(_laid(ids.slice(a, b - a), tokens, begin, raw, start[begin]))
        return pa.Table.from_batches(laid)

    def _laid(ids, tokens, begin, raw, start):
        pairs = lambda x: zip(x[:-1], x[1:], strict=True)
        made = {
            "ids": lambda: pa.ListArray.from_arrays(pa.array(begin, pa.int32()), pa.array(tokens.view(np.int32))),
            "decoded": lambda: pa.array([raw[a:b].tobytes() for a, b in pairs(start)], pa.binary()),
            "n_tokens": lambda: pa.array(np.diff(begin)),
            "ids_sha256": lambda: pa.array([hashlib.sha256(tokens[a:b]).hexdigest() for a, b in pairs(begin)]),
            "decoded_sha256": lambda: pa.array([hashlib.sha256(raw[a:b]).hexdigest() for a, b in pairs(start)]),
        }
        return pa.RecordBatch.from_arrays([ids, *(made[c]() for c in columns)], names=[id_col, *columns])

    body = blocks.select("block", "ids", "counts", "places", "sizes", "codes")
    return body.groupBy("block").cogroup(coded.groupBy("block")).applyInArrow(lay_out, ", ".join([f"`{id_col}` long", *(f"{c} {_SPARK[c]}" for c in columns)]))
