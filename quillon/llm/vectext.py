"""Vectorised word hashing over Arrow string columns (NumPy, no per-word Python).

Texts are cut into blocks of a few hundred kilobytes; within a block every word
of every text gets a 64-bit hash by prefix sums of a polynomial, so the cost is
some twenty passes over the bytes, whatever the number of words. A text is never
cut: a longer one is a block of its own. Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
BLOCK_BYTES = 1 << 18
_P = 0x9E3779B97F4A7C15
_P_INV = pow(_P, -1, 1 << 64)
_powers_of: dict[str, np.ndarray] = {}

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes that are part of a word, after lower-casing. Bytes over 0x7F belong to longer UTF-8 sequences.
SPACED = np.ones(256, bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: a bijection whose output bits all depend on all input bits."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64; a longer text than usual gets arrays of its own."""
    if n > BLOCK_BYTES * 2:
        return _progression(_P, n), _progression(_P_INV, n)
    if not _powers_of:
        _powers_of["up"], _powers_of["down"] = _progression(_P, BLOCK_BYTES * 2), _progression(_P_INV, BLOCK_BYTES * 2)
    return _powers_of["up"][:n], _powers_of["down"][:n]


def _progression(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, U)
    out[0] = 1
    return np.multiply.accumulate(out, out=out)


def blocks(texts: pa.Array | pa.ChunkedArray, block_bytes: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row behind the last, UTF-8 bytes of these rows, each row's offset in them and the end)."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    n = len(texts)
    if n == 0:
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = min(n, max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + block_bytes, "right")) - 1))
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def word_hashes(data: np.ndarray, offsets: np.ndarray, word: np.ndarray = SPACED, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words of a block in order, the word at which each row begins (with the end), and the words' byte starts and ends."""
    n = len(data)
    if n == 0:
        return np.zeros(0, U), np.zeros(len(offsets), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    if lower:
        data = LOWER[data]
    inside = word[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    at = offsets[:-1]
    at = at[at < n]
    begins[at] = inside[at]  # words end with their row
    ends = np.empty(n, bool)
    ends[-1] = inside[-1]
    ends[:-1] = inside[:-1] & (~inside[1:] | begins[1:])
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    power, inverse = _powers(n + 1)
    sums = np.empty(n + 1, U)
    sums[0] = 0
    np.cumsum((data + np.uint16(1)).astype(U) * power[:n], out=sums[1:])
    hashes = mix((sums[stops] - sums[starts]) * inverse[starts] + (stops - starts).astype(U))
    return hashes, np.searchsorted(starts, offsets), starts, stops


def ngrams(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """A hash for the k words from each word on, and whether those lie in one row."""
    n = len(hashes)
    out = np.zeros(n, U)
    for j in range(min(k, n)):
        out[: n - j] = out[: n - j] * U(_P) + hashes[j:]
    row_end = np.repeat(first[1:], np.diff(first))
    return mix(out), np.arange(n) + k <= row_end


def prefixes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray, lengths: range) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length: which words, given by their byte starts and ends, are longer, and a hash of so many of their first bytes (A-Z in lower case)."""
    n = len(data)
    power, inverse = _powers(n + 1)
    sums = np.empty(n + 1, U)
    sums[0] = 0
    np.cumsum((LOWER[data] + np.uint16(1)).astype(U) * power[:n], out=sums[1:])
    for k in lengths:
        longer = np.flatnonzero(stops - starts > k)
        at = starts[longer]
        yield longer, mix((sums[at + k] - sums[at]) * inverse[at] + U(k | 1 << 32))
