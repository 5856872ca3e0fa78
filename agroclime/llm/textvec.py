"""Whole Arrow batches of text as byte arrays: words, word hashes and word shingles without a loop over rows.

Words are maximal runs without the bytes 0x09-0x0D and 0x20; upper case A-Z is lowered. A null text is empty.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from agroclime.llm.store import split_bytes

BATCH_BYTES = 2 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_P = 0x9E3779B97F4A7C15 | 1
_INV = pow(_P, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _pow(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(12, int(n - 1).bit_length())
        have = np.full(size, base, np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if size <= 4 * BATCH_BYTES:
            _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts in one array, and where each text starts (one more entry than texts)."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(buffers[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def sub_batches(batches, text: str = "text", limit: int = BATCH_BYTES):
    """Record batches whose texts take at most ``limit`` bytes (or one row)."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        sizes = pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False)
        for a, b in split_bytes(sizes.tolist(), limit):
            yield batch.slice(a, b - a)


@dataclass
class Words:
    data: np.ndarray      # lowered bytes
    starts: np.ndarray    # first byte of each word
    ends: np.ndarray      # one after its last byte
    first: np.ndarray     # index of each text's first word; one more entry than texts
    hashes: np.ndarray    # 64 bits of each word


def words_of(column: pa.Array) -> Words:
    data, offsets = text_bytes(column)
    data = _LOWER[data]
    n = len(data)
    inside = np.zeros(n + 1, bool)
    np.logical_not(_SPACE[data], out=inside[:n])
    begins = inside[:n].copy()
    begins[1:] &= ~inside[: n - 1]
    cut = offsets[:-1][offsets[:-1] < offsets[1:]]
    begins[cut] = inside[:n][cut]
    final = inside[:n] & ~inside[1:]
    last = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    final[last] = inside[:n][last]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(final) + 1
    first = np.searchsorted(starts, offsets)
    return Words(data, starts, ends, first, word_hashes(data, starts, ends))


def normalized_digests(words: Words, offsets: np.ndarray) -> list[bytes]:
    """SHA-256 of each text's words, joined by one blank."""
    inside = np.zeros(len(words.data) + 1, bool)
    np.add.at(change := np.zeros(len(words.data) + 1, np.int32), words.starts, 1)
    np.add.at(change, words.ends, -1)
    inside[:-1] = np.cumsum(change[:-1]) > 0
    # A word's bytes and the first blank after it; a word at the end of its text has none.
    kept = inside[:-1].copy()
    kept[1:] |= inside[:-2]
    kept[offsets[:-1][offsets[:-1] < len(kept)]] &= inside[offsets[:-1][offsets[:-1] < len(kept)]]
    data = np.where(inside[:-1], words.data, 32)[kept].astype(np.uint8)
    at = np.concatenate(([0], np.cumsum(kept)))[offsets]
    whole = data.tobytes()
    return [hashlib.sha256(whole[a:b].rstrip(b" ")).digest() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


# Two primes below 2**31 and a base for each: sums of their residues fit into 64 bits.
_PRIMES = ((2147483647, 1128476521), (2147483629, 964374583))
_HASHED = 1 << 16  # bytes hashed at once, so that tables and sums stay small
_residues: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _prime_powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a prime's base and of its inverse, modulo the prime."""
    prime, base = _PRIMES[which]
    have = _residues.get(which)
    if have is None or len(have[0]) < n:
        size, both = 1 << max(12, int(n - 1).bit_length()), []
        for b in (base, pow(base, -1, prime)):
            out = np.ones(size, np.uint64)
            done = 1
            while done < size:
                out[done : 2 * done] = out[:done] * np.uint64(pow(b, done, prime)) % np.uint64(prime)
                done *= 2
            both.append(out)
        have = tuple(both)
        if size <= 2 * _HASHED:
            _residues[which] = have
    return have[0][:n], have[1][:n]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span, of two polynomials modulo primes and one modulo 2**64. Spans stand in order.

    The last alone has texts with equal hashes under every base (those of the Thue-Morse pattern).
    """
    out = np.zeros(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + _HASHED, "right")))
        a, b = int(starts[i]), int(ends[j - 1])
        out[i:j] = _word_hashes(data[a:b], starts[i:j] - a, ends[i:j] - a)
        i = j
    return out


def _word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    out = span_hashes(data, starts, ends)
    for which, (prime, _) in enumerate(_PRIMES):
        p = np.uint64(prime)
        powers, inverse = _prime_powers(which, len(data) + 1)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[:-1] % p, out=sums[1:])
        h = (sums[ends] - sums[starts]) % p * inverse[starts] % p
        out = mix(out ^ mix(h + np.uint64(which << 32)))
    return out


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span: a polynomial modulo 2**64 by prefix sums, then mixed with the length."""
    n = len(data)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _pow(_P, n), out=sums[1:]) if n else None
    h = (sums[ends] - sums[starts]) * _pow(_INV, n + 1)[starts]
    return mix(h ^ ((ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))


def shingle_hashes(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all ``size``-word shingles in text order, and where each text's begin.

    A text with fewer words, but at least one, has its whole word sequence as its only shingle.
    """
    h, first = words.hashes, words.first
    counts = np.diff(first)
    n = len(h)
    c = np.uint64(0xFF51AFD7ED558CCD)
    rolled = np.zeros(n, np.uint64)
    for j in range(size):
        rolled *= c
        rolled[: n - j] += h[j:]
    per_text = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    begin = np.concatenate(([0], np.cumsum(per_text)))
    text = np.repeat(np.arange(len(counts)), per_text)
    at = np.arange(begin[-1]) - begin[text] + first[text]
    out = rolled[at]
    for t in np.flatnonzero((counts > 0) & (counts < size)):
        value = 0
        for x in h[first[t] : first[t + 1]].tolist():
            value = (value * int(c) + x) & 0xFFFFFFFFFFFFFFFF
        out[begin[t]] = value ^ (int(counts[t]) << 56)
    return mix(out), begin


def distinct_per_text(hashes: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each text, and where each text's begin."""
    text = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
    order = np.lexsort((hashes, text))
    h, t = hashes[order], text[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (t[1:] != t[:-1])
    h, t = h[keep], t[keep]
    return h, np.concatenate(([0], np.cumsum(np.bincount(t, minlength=len(begin) - 1))))
