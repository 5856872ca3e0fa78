"""Best-fit packing of tokenised documents into sequences, improved by swap-based local search.

Documents become token ids and an end id; only those longer than a sequence are cut. Full pieces are sequences of
their own. The rest are dealt into parts of at most ``PART`` pieces. In a part pieces are first placed best fit, longest
first; then underfull sequences exchange pieces one for one, two for one or one for two, or move one, whenever that
raises the sum of squared fills, so that the emptiest of them run empty. Full sequences are finished; the underfull
ones of all parts are dealt anew, whole sequences together, for another round with new neighbours, until the number of
sequences reaches its lower bound or a round empties none.

A task holds one part; the driver sees two sums a round.
"""

from __future__ import annotations

import itertools
import json
import re
import sys
import zlib

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agroclime.llm.store import stored

# The code of this module travels with the tasks, so workers need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

WINDOW = 1024
PART = 32_768          # pieces packed by one task
DONORS = 64            # emptiest sequences that give pieces away at a time
LONG_TEXT = 1 << 18    # characters encoded at a time, where a text can be cut without changing its ids


# ------------------------------------------------------------------ pieces

class Encoder:
    """Token ids as the ``tokenizers`` library gives them for a byte-level BPE file, without added special tokens.

    The merges run in ``tiktoken``, which is several times as fast with the same vocabulary: a byte-level BPE whose
    ids follow the order of its merges is a rank table. A file that is none, and a text that is too much for that
    library's pattern (runs of about a million blanks), go to ``tokenizers`` itself.
    """

    def __init__(self, content: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_str(content)
        parts = json.loads(content)
        model, split = parts["model"], parts.get("pre_tokenizer") or {}
        self.fast = None
        merged = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in model.get("merges", [])]
        by_id = sorted(model.get("vocab", {}), key=model["vocab"].get)
        if (split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space") and not parts.get("normalizer")
                and not model.get("continuing_subword_prefix") and not model.get("end_of_word_suffix") and by_id[256:] == merged):
            # The printable alphabet of byte-level BPE and its split pattern.
            shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
            alphabet = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
            pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
            ranks = {bytes(alphabet[c] for c in token): i for token, i in model["vocab"].items()}
            plain = {t["content"]: t["id"] for t in parts.get("added_tokens", []) if not (t["single_word"] or t["lstrip"] or t["rstrip"])}
            if len(plain) == len(parts.get("added_tokens", [])):
                self.fast = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens=plain)

    def _one(self, text: str) -> np.ndarray:
        if self.fast is not None:
            try:
                return self.fast.encode_to_numpy(text, allowed_special="all").astype(np.uint32)
            except ValueError:  # the pattern ran out of stack
                pass
        return np.array(self.exact.encode(text, add_special_tokens=False).ids, np.uint32)

    def __call__(self, text: str) -> np.ndarray:
        if len(text) <= LONG_TEXT:
            return self._one(text)
        # No match of the split pattern reaches over a single blank between two small letters.
        found, at = [], 0
        between = re.compile("[a-z](?= [a-z])")
        while at < len(text):
            cut = between.search(text, at + LONG_TEXT)
            end = cut.end() if cut else len(text)
            found.append(self._one(text[at:end]))
            at = end
        return np.concatenate(found)


def pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, eos: int = 2, keep_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): a document is its ids and ``eos``; a null text is empty.

    A document longer than ``window`` is cut into full pieces from its end; the first takes what is left over.
    ``tokenizer`` is a path on the driver; its content, one vocabulary, is broadcast.
    """
    with open(tokenizer, encoding="utf-8") as file:
        content = file.read()
    shared = docs.sparkSession.sparkContext.broadcast(content)  # one vocabulary file

    def run(batches):
        encode = Encoder(shared.value)
        for batch in batches:
            rows = {"doc_id": [], "piece": [], "start": [], "length": [], "ids_crc32": []}
            held = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.append(encode(text or ""), np.uint32(eos)).astype("<u4")
                first = (len(ids) - 1) % window + 1
                for k, begin in enumerate([0, *range(first, len(ids), window)]):
                    cut = ids[begin:first + k * window]
                    for key, value in zip(rows, (doc, k, begin, len(cut), zlib.crc32(cut.tobytes())), strict=True):
                        rows[key].append(value)
                    held.append(cut)
            columns = [pa.array(rows["doc_id"], pa.int64()), pa.array(rows["piece"], pa.int32()), *(pa.array(rows[c], pa.int64()) for c in ("start", "length", "ids_crc32"))]
            names = list(rows)
            if keep_ids:
                ends = np.concatenate([[0], np.cumsum([len(c) for c in held])]).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(held).astype(np.int64) if held else np.zeros(0, np.int64))))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<long>" if keep_ids else ""))


# ------------------------------------------------------------------ packing of one part

def best_fit(sizes: list[int], window: int) -> list[list[int]]:
    """Sequences (lists of sizes): each piece, longest first, goes where the least room is left after it."""
    bins: list[list[int]] = []
    by_room: dict[int, list[int]] = {}
    rooms = 0  # bit r: some sequence has room r
    for size in sorted(sizes, reverse=True):
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            at = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
            bins[at].append(size)
        else:
            room, at = window, len(bins)
            bins.append([size])
        if room > size:
            by_room.setdefault(room - size, []).append(at)
            rooms |= 1 << (room - size)
    return bins


def squared_fill(bins: list[list[int]]) -> int:
    return sum(sum(b) ** 2 for b in bins)


class _Donors:
    """The sizes, and sums of two sizes, that a few of the emptiest sequences could give away."""

    def __init__(self):
        self.bins: dict[int, list[int]] = {}
        self.fill: dict[int, int] = {}
        self.ones: dict[int, set[int]] = {}
        self.twos: dict[int, dict[int, tuple[int, int]]] = {}
        self.one_bits = self.two_bits = 0

    def put(self, key: int, sizes: list[int]) -> None:
        self.bins[key], self.fill[key] = sizes, sum(sizes)
        counts: dict[int, int] = {}
        for s in sizes:
            counts[s] = counts.get(s, 0) + 1
        distinct = sorted(counts)
        for s in distinct:
            self.ones.setdefault(s, set()).add(key)
            self.one_bits |= 1 << s
        for i, s in enumerate(distinct):
            for t in distinct[i if counts[s] > 1 else i + 1:]:
                self.twos.setdefault(s + t, {})[key] = (s, t)
                self.two_bits |= 1 << (s + t)

    def take(self, key: int) -> list[int]:
        sizes = self.bins.pop(key)
        del self.fill[key]
        for s in set(sizes):
            self.ones[s].discard(key)
            if not self.ones[s]:
                self.one_bits &= ~(1 << s)
        for s, t in itertools.combinations(sorted(sizes), 2):
            holders = self.twos.get(s + t)
            if holders and holders.pop(key, None) and not holders:
                self.two_bits &= ~(1 << (s + t))
        return sizes


def _highest(bits: int, under: int) -> int:
    """The highest set bit below ``under``, or -1."""
    return (bits & ((1 << under) - 1)).bit_length() - 1


def _exchange(sizes: list[int], fill: int, room: int, donors: _Donors):
    """The exchange that fills ``sizes`` most: (gain, given away, donor, taken), or None.

    The receiver ends fuller than the donor was, so the sum of squared fills rises.
    """
    best = None
    distinct = sorted(set(sizes))
    give: list[tuple[int, ...]] = [(), *((s,) for s in distinct)]
    pairs = {s + t: (s, t) for i, s in enumerate(distinct) for t in distinct[i if sizes.count(s) > 1 else i + 1:]}
    give += pairs.values()
    for out in give:
        x = sum(out)
        for two in (False, True) if len(out) == 1 else (False,):
            bits = donors.two_bits if two else donors.one_bits
            y = _highest(bits, x + room + 1)
            while y > x and (best is None or y - x > best[0]):
                holders = donors.twos[y] if two else donors.ones[y]
                key = min(holders, key=donors.fill.__getitem__)
                if fill + y - x > donors.fill[key]:
                    best = (y - x, out, key, holders[key] if two else (y,))
                    break
                y = _highest(bits, y)
            if best and best[0] == room:
                return best
    return best


def local_search(bins: list[list[int]], window: int) -> list[list[int]]:
    """Exchanges between underfull sequences, fullest receivers and emptiest donors first, until a pass empties none."""
    done = [b for b in bins if sum(b) == window]
    bins = [b for b in bins if sum(b) < window]
    while len(bins) > 1:
        before = len(bins)
        bins.sort(key=sum)
        donors, given = _Donors(), min(DONORS, len(bins) - 1)
        for i in range(given):
            donors.put(i, bins[i])
        left: dict[int, list[int]] = {}
        for r in range(len(bins) - 1, -1, -1):
            if r < given:  # a donor may receive from the others
                if r not in donors.bins:
                    continue
                sizes = donors.take(r)
            else:
                sizes = bins[r]
            fill = sum(sizes)
            while fill < window and donors.bins:
                found = _exchange(sizes, fill, window - fill, donors)
                if found is None:
                    break
                gain, out, key, taken = found
                other = donors.take(key)
                for s in out:
                    sizes.remove(s)
                    other.append(s)
                for s in taken:
                    other.remove(s)
                    sizes.append(s)
                fill += gain
                if other:
                    donors.put(key, other)
                elif given < r:  # an empty sequence is gone, the next emptiest gives
                    donors.put(given, bins[given])
                    given += 1
            left[r] = sizes
        left |= donors.bins
        bins = [b for b in left.values() if b]
        done += [b for b in bins if sum(b) == window]
        bins = [b for b in bins if sum(b) < window]
        lower = -(-sum(map(sum, bins)) // window)
        emptied = before - len(bins) - (len(left) - len(bins) - sum(not b for b in left.values()))
        if len(bins) <= lower or emptied <= 0:
            break
    return done + bins


def pack_part(items: np.ndarray, sizes: np.ndarray, now: np.ndarray, window: int, fresh: bool):
    """(order of items, sequence of each, place in it) for one part; ``now`` is each item's present sequence."""
    lists: dict[int, list[int]] = {}
    for seq, size in zip(now.tolist(), sizes.tolist(), strict=True):
        lists.setdefault(seq, []).append(size)
    bins = best_fit(sizes.tolist(), window)
    if not fresh:
        kept = list(lists.values())
        if (len(kept), -squared_fill(kept)) <= (len(bins), -squared_fill(bins)):
            bins = kept
    bins = local_search(bins, window)
    # Pieces of one size are interchangeable: hand them out in order.
    order = np.lexsort((items, sizes))
    first = {}
    for at, size in enumerate(sizes[order].tolist()):
        first.setdefault(size, at)
    at, seq, place = [], [], []
    for b in bins:
        mine = []
        for size in b:
            mine.append(int(order[first[size]]))
            first[size] += 1
        name, offset = min(int(items[i]) for i in mine), 0
        for i in sorted(mine, key=lambda i: int(items[i])):
            at.append(i)
            seq.append(name)
            place.append(offset)
            offset += int(sizes[i])
    return np.array(at, np.int64), np.array(seq, np.int64), np.array(place, np.int64)


# ------------------------------------------------------------------ all parts

def _packed_round(open_: DataFrame, parts: int, turn: int, window: int) -> DataFrame:
    kind = "item long, length long, sequence_id long, offset long, full boolean"

    def run(table: pa.Table) -> pa.Table:
        items, sizes, now = (table.column(c).to_numpy() for c in ("item", "length", "sequence_id"))
        at, seq, place = pack_part(items, sizes, now, window, turn == 0)
        sizes = sizes[at]
        start = np.flatnonzero(place == 0)
        fill = np.add.reduceat(sizes, start) if len(start) else np.zeros(0, np.int64)
        full = np.repeat(fill == window, np.diff([*start, len(at)]))
        return pa.table({"item": items[at], "length": sizes, "sequence_id": seq, "offset": place, "full": full})

    dealt = open_.withColumn("part", F.pmod(F.xxhash64("sequence_id", F.lit(turn)), F.lit(parts)))
    return dealt.groupBy("part").applyInArrow(run, kind)


def pack(cut: DataFrame, window: int = WINDOW) -> DataFrame:
    """``cut`` with ``sequence_id`` and ``offset``; pieces have a ``length`` from 1 to ``window``.

    Sequences are gapless from 0, hold whole pieces and at most ``window`` tokens. Which piece of equal ones lies where,
    and the sequence ids (distinct numbers), follow from the order of the stored pieces. Any columns may travel along
    but ``item``, ``sequence_id``, ``offset``, ``part``, ``full``. An empty table gives no rows.
    """
    spark = cut.sparkSession
    table = stored(cut.withColumn("item", F.monotonically_increasing_id()), "pieces")
    open_ = table.filter(F.col("length") < window).select("item", "length", F.col("item").alias("sequence_id"))
    placed = [table.filter(F.col("length") == window).select("item", F.col("item").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))]
    columns = ["item", "sequence_id", "offset"]
    many, total, bins, turn = *open_.agg(F.count("*"), F.sum("length")).first(), None, 0
    while many:
        parts = -(-many // PART)
        tried = stored(_packed_round(open_, parts, turn, window), "packed")
        placed.append(tried.filter("full").select(*columns))
        rest = tried.filter("not full")
        seen = rest.agg(F.count("*"), F.sum("length"), F.count_if(F.col("offset") == 0)).first()
        closed = tried.filter("full").agg(F.count_if(F.col("offset") == 0)).first()[0]
        saved = None if bins is None else bins - seen[2] - closed
        many, total, bins = seen
        if many == 0:
            break
        if parts == 1 or saved == 0 or bins == -(-total // window):
            placed.append(rest.select(*columns))
            break
        open_, turn = rest.select("item", "length", "sequence_id"), turn + 1
    where = placed[0]
    for more in placed[1:]:
        where = where.unionAll(more)
    return table.join(where, "item").drop("item")


def pack_documents(
    docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, eos: int = 2, keep_ids: bool = False,
) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` (and ``ids`` if kept).

    A null or empty text is the end id alone. Repeated rows, and rows with a null id, are packed one by one. Texts over
    ``LONG_TEXT`` characters are encoded in stretches where a cut changes no id, else whole. Other columns are not read.
    """
    return pack(pieces(docs, tokenizer, id_col, text_col, window, eos, keep_ids), window)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids) of packed pieces that kept their ids; a sequence has at most ``window`` of them."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
