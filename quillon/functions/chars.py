"""Character statistics of texts in one pass over their UTF-8 bytes: an Arrow function, NumPy inside, no Python per character."""

from __future__ import annotations

import unicodedata
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shipping import ship

# Counted characters, with the features' names, and two sets of them that count together.
COUNTED = {"caret": "^", "dollar": "$", "percent": "%", "pipe": "|", "greater": ">", "less": "<", "ampersand": "&", "semicolon": ";", "backslash": "\\", "slash": "/", "dash": "-", "single_quote": "'", "double_quote": '"', "at": "@", "braces": "{}", "brackets": "[]"}
HOSTILE, QUOTES = "^`%$+&;", "\"'"
SPACE = "\t\n\v\f\r "

_ASCII = [chr(k) for k in range(128)]
#: What an ASCII character adds to each count.
SETS: dict[str, np.ndarray] = {
    "alpha": np.array([c.isalpha() for c in _ASCII]),
    "digit": np.array([c.isdigit() for c in _ASCII]),
    "space": np.array([c in SPACE for c in _ASCII]),
    "upper": np.array([c.isupper() for c in _ASCII]),
    "lower": np.array([c.islower() for c in _ASCII]),
    **{name: np.array([c in chars for c in _ASCII]) for name, chars in (COUNTED | {"hostile": HOSTILE, "quotes": QUOTES}).items()},
}
WEIGHTS = np.stack(list(SETS.values()), axis=1).astype(np.int64)
#: Kinds of other characters: letters by case, and white space.
LETTER, UPPER, LOWER, BLANK = 1, 2, 4, 8
KINDS = {"Lu": LETTER | UPPER, "Ll": LETTER | LOWER, "Lt": LETTER, "Lm": LETTER, "Lo": LETTER}
# White space beyond ASCII.
BLANKS = frozenset([0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
FIELDS = [*((n, pa.int64()) for n in ("length", "num_tokens", "max_token_len", *SETS, "outside")), ("entropy", pa.float64())]
SCHEMA = T.StructType([T.StructField(n, T.DoubleType() if t == pa.float64() else T.LongType()) for n, t in FIELDS])
BLOCK_BYTES, BLOCK_ROWS = 1 << 20, 1 << 14


@cache
def _kind(code: int) -> int:
    return KINDS.get(unicodedata.category(chr(code)), 0) | (BLANK if code in BLANKS else 0)


def _code_points(data: np.ndarray, leads: np.ndarray) -> np.ndarray:
    """The characters that begin at some lead bytes beyond ASCII."""
    follow = np.concatenate([data, np.zeros(3, np.uint8)]).astype(np.int64) & 0x3F
    b = data[leads].astype(np.int64)
    two, three = ((b & 0x1F) << 6) | follow[leads + 1], ((b & 0x0F) << 12) | (follow[leads + 1] << 6) | follow[leads + 2]
    four = ((b & 0x07) << 18) | (follow[leads + 1] << 12) | (follow[leads + 2] << 6) | follow[leads + 3]
    return np.where(b < 0xE0, two, np.where(b < 0xF0, three, four))


def _block(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    n = len(offsets) - 1
    row = np.repeat(np.arange(n), np.diff(offsets))
    ascii_ = data < 0x80
    counts = np.bincount(row[ascii_] * 128 + data[ascii_], minlength=n * 128).reshape(n, 128)
    sums = counts @ WEIGHTS
    out = {name: sums[:, k] for k, name in enumerate(SETS)}
    leads = np.flatnonzero(data >= 0xC0)
    codes, at = _code_points(data, leads), row[leads]
    kinds, inverse = np.unique(codes, return_inverse=True)
    kinds = np.array([_kind(c) for c in kinds.tolist()], np.int64)[inverse] if len(codes) else np.zeros(0, np.int64)
    for name, bit in (("alpha", LETTER), ("upper", UPPER), ("lower", LOWER)):
        out[name] = out[name] + np.bincount(at, (kinds & bit) > 0, n).astype(np.int64)
    out["outside"] = np.bincount(at, (kinds & BLANK) == 0, n).astype(np.int64)
    length = out["length"] = counts.sum(axis=1) + np.bincount(at, minlength=n)
    each = np.sum(counts * np.log2(np.maximum(counts, 1)), axis=1)
    same = np.unique(at * (1 << 21) + codes, return_counts=True)
    each += np.bincount(same[0] >> 21, same[1] * np.log2(same[1]), n)
    out["entropy"] = np.where(length > 0, np.log2(np.maximum(length, 1)) - each / np.maximum(length, 1), 0.0) + 0.0
    blank = np.zeros(256, bool)
    blank[list(SPACE.encode())] = True
    word = ~blank[data]
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    first = offsets[:-1][np.diff(offsets) > 0]
    begins[first] = word[first]
    out["num_tokens"] = np.bincount(row[begins], minlength=n)
    out["max_token_len"] = np.zeros(n, np.int64)
    starts = np.flatnonzero(begins)
    if len(starts):
        sizes = np.add.reduceat((word & ((data & 0xC0) != 0x80)).astype(np.int64), starts)  # white space behind a word adds none
        np.maximum.at(out["max_token_len"], row[starts], sizes)
    return out


def stats_of(texts: pa.Array) -> pa.StructArray:
    """length, tokens, counts and entropy of each text; a null counts as empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    n = len(texts)
    parts: list[dict[str, np.ndarray]] = []
    if n:
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
        lo = 0
        while lo < n:
            hi = min(n, lo + BLOCK_ROWS, max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + BLOCK_BYTES, "right")) - 1))
            parts.append(_block(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]))
            lo = hi
    columns = [pa.array(np.concatenate([p[name] for p in parts]) if parts else [], kind) for name, kind in FIELDS]
    return pa.StructArray.from_arrays(columns, [name for name, _ in FIELDS])


@F.arrow_udf(SCHEMA)
def _stats(texts: pa.Array) -> pa.Array:
    return stats_of(texts)


def stats(text: Column) -> Column:
    """A struct of a text's character statistics (FIELDS). Equal calls in one projection are evaluated once."""
    ship(SparkSession.getActiveSession())
    return _stats(text)
