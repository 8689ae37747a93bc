"""Words of Arrow text columns as dictionary codes, by Arrow kernels: exact, and without Python work per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

DIGITS, LETTERS = range(0x30, 0x3A), range(0x61, 0x7B)


def folding(*kept: range) -> np.ndarray:
    """A table of bytes: A-Z in lower case, the ASCII ranges in kept and all beyond ASCII as they are, other bytes a space."""
    out = np.full(256, 0x20, np.uint8)
    for part in (*kept, range(0x80, 0x100)):
        out[part.start : part.stop] = np.arange(part.start, part.stop)
    out[0x41:0x5B] = np.arange(0x61, 0x7B)
    return out


def plain(texts: pa.Array | pa.ChunkedArray) -> pa.Array:
    """One array of large strings, null as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string())
    return texts.fill_null("") if texts.null_count else texts


def folded(texts: pa.Array, table: np.ndarray) -> pa.Array:
    """Texts with every byte replaced by the table's."""
    if not len(texts):
        return texts
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(offsets - offsets[0]), pa.py_buffer(table[data]))


def slices(texts: pa.Array, most_bytes: int) -> Iterator[tuple[int, int]]:
    """Row ranges of at most so many bytes; a longer text is a range of its own."""
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    lo = 0
    while lo < len(texts):
        hi = min(len(texts), max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most_bytes, "right")) - 1))
        yield lo, hi
        lo = hi


def coded(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """All words between ASCII white space in order, as codes; where each text's begin, and the end; the words the codes stand for."""
    words = pc.ascii_split_whitespace(texts)
    values = words.flatten()
    codes = values.dictionary_encode()
    first = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(pc.list_value_length(words).to_numpy(zero_copy_only=False), out=first[1:])
    code, known = codes.indices.to_numpy(zero_copy_only=False).astype(np.int64), codes.dictionary
    empty = pc.index(known, pa.scalar("", known.type)).as_py()
    if empty >= 0:  # white space at a text's ends
        real = code != empty
        first = np.r_[0, np.cumsum(real)][first]
        code = code[real]
        code -= code > empty
        known = pa.concat_arrays([known.slice(0, empty), known.slice(empty + 1)])
    return code, first, known
