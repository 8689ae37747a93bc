"""Benchmark decontamination by winnowing.

Words are [0-9a-z and all beyond ASCII] runs of the text with A-Z in lower case.
A benchmark item's windows are its runs of ``span`` consecutive words (an item of
fewer words, but not none, is one window). Both sides keep, of every ``w``
consecutive k-grams, the one with the least hash, with k + w - 1 = span: any
shared stretch of span words holds a fingerprint that both sides kept. Shared
fingerprints are seeds; a seed is extended to the windows of span words around
it, and those that an item has count, so no shared window is left out, and what
is found is exact but for 64-bit hashes of words and windows. Short items are
matched by one hash over all their words, at every position (k = their length,
w = 1). A window that many items share is looked up once, whatever their number.

Two plans give the same rows. If the benchmark's texts are at most
``broadcast_bytes`` in all (measured first), its fingerprints and windows go to
every task and documents are read once, without a shuffle. Beyond that, seeds are
found by a join on fingerprint hashes, and the windows around them by a join on
window hashes; texts take part once, and items only as the ids of a window.

Nulls and odd rows: a null text has no words. Items without words or id are left
out. Items that share an id are one item. Repeated document rows are judged
alike, each on its own. Empty tables give empty results or documents without
hits. Extra columns pass through; result columns replace those of their name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import vectext
from .common import ascii_lower, body, ship, stored

SPAN, K = 10, 5
RESULT = [T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("items", T.ArrayType(T.StringType())), T.StructField("contaminated", T.BooleanType())]


def fingerprints(hashes: np.ndarray, first: np.ndarray, k: int, w: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the k-grams that winnowing keeps: the last least of every w in a row of text."""
    grams, ok = vectext.ngrams(hashes, first, k)
    n = len(grams)
    if w == 1:
        at = np.flatnonzero(ok)
        return at, grams[at]
    _, whole = vectext.ngrams(hashes, first, k + w - 1)
    best, at = grams.copy(), np.arange(n)
    for j in range(1, min(w, n)):
        less = grams[j:] <= best[: n - j]
        best[: n - j][less] = grams[j:][less]
        at[: n - j][less] = np.arange(j, n)[less]
    keep = np.zeros(n, bool)
    keep[at[whole]] = True
    at = np.flatnonzero(keep)
    return at, grams[at]


def sizes_of(lengths: np.ndarray, span: int, k: int) -> list[tuple[int, int, int]]:
    """(words of a window, k, w) for the items there are: long ones by winnowing, short ones whole."""
    short = sorted({int(n) for n in lengths if 0 < n < span})
    return [(n, n, 1) for n in short] + ([(span, k, span - k + 1)] if (lengths >= span).any() else [])


def window_hashes(hashes: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """A hash of the size words from each start on."""
    out = np.zeros(len(starts), np.uint64)
    for j in range(size):
        out = out * np.uint64(0x9E3779B97F4A7C15) + hashes[starts + j]
    return vectext.mix(out)


def around(seeds: np.ndarray, first: np.ndarray, size: int, k: int) -> np.ndarray:
    """Starts of the windows that hold a k-gram at one of the seeds, inside their rows."""
    if not len(seeds):
        return seeds
    starts = np.unique((seeds[:, None] - np.arange(size - k + 1)).ravel())
    starts = starts[starts >= 0]
    end = first[np.searchsorted(first, starts, "right")]
    row_of = np.searchsorted(first, starts, "right")
    # a start before the seed's row would lie in another one, whose end comes first
    return starts[(starts + size <= end) & (row_of < len(first))]


def _words(block) -> tuple[np.ndarray, np.ndarray]:
    _, _, data, offsets = block
    hashes, first, _, _ = vectext.word_hashes(data, offsets, vectext.ALNUM)
    return hashes, first


class Index:
    """A benchmark's fingerprints and windows as flat arrays, small enough to send to every task."""

    def __init__(self, ids: list[str], texts: list[str], span: int = SPAN, k: int = K):
        self.ids = np.array(sorted(set(ids)), dtype=object)
        number = {x: i for i, x in enumerate(self.ids)}
        items = [(number[ids[lo + i]], hashes[a:b]) for block in vectext.blocks(pa.array(texts, pa.large_string())) for lo in [block[0]] for hashes, first in [_words(block)] for i, (a, b) in enumerate(zip(first[:-1], first[1:]))]
        self.tables = []
        for size, gram, w in sizes_of(np.array([len(h) for _, h in items]), span, k):
            mine = [(i, h) for i, h in items if (len(h) >= span if size == span else len(h) == size)]
            hashes, first = np.concatenate([h for _, h in mine]), np.cumsum([0, *(len(h) for _, h in mine)])
            starts = np.concatenate([np.arange(a, b - size + 1) for a, b in zip(first[:-1], first[1:])])
            owner = np.array([i for i, _ in mine])[np.searchsorted(first, starts, "right") - 1]
            pairs = np.unique(np.stack([window_hashes(hashes, starts, size), owner.astype(np.uint64)], axis=1), axis=0)
            windows, at = np.unique(pairs[:, 0], return_index=True)
            self.tables.append((size, gram, w, np.unique(fingerprints(hashes, first, gram, w)[1]), windows, np.r_[at, len(pairs)], pairs[:, 1].astype(np.int64)))

    def match(self, texts: pa.Array) -> tuple[list[int], list[int], list[list[str]]]:
        """For each text: its words, those hit, and the ids of items found, sorted."""
        n_words, n_hit, found = [], [], []
        for block in vectext.blocks(texts):
            hashes, first = _words(block)
            change, items = np.zeros(len(hashes) + 1, np.int64), [np.zeros((0, 2), np.int64)]
            for size, k, w, prints, windows, at, owners in self.tables:
                places, mine = fingerprints(hashes, first, k, w)
                starts = around(places[_in(mine, prints)], first, size, k)
                values = window_hashes(hashes, starts, size)
                known = _in(values, windows)
                starts, window = starts[known], np.searchsorted(windows, values[known])
                np.add.at(change, starts, 1)
                np.add.at(change, starts + size, -1)
                pairs = np.unique(np.stack([np.searchsorted(first, starts, "right") - 1, window], axis=1), axis=0)
                many = at[pairs[:, 1] + 1] - at[pairs[:, 1]]
                each = np.repeat(at[pairs[:, 1]], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                items.append(np.stack([np.repeat(pairs[:, 0], many), owners[each]], axis=1))
            total = np.r_[0, np.cumsum(np.cumsum(change[:-1]) > 0)]
            n_words += np.diff(first).tolist()
            n_hit += (total[first[1:]] - total[first[:-1]]).tolist()
            pairs = np.unique(np.concatenate(items), axis=0)
            cut = np.searchsorted(pairs[:, 0], np.arange(len(first)))
            found += [self.ids[pairs[a:b, 1]].tolist() for a, b in zip(cut[:-1], cut[1:])]
        return n_words, n_hit, found


def _in(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Which values a sorted table has."""
    if not len(table):
        return np.zeros(len(values), bool)
    return table[np.minimum(np.searchsorted(table, values), len(table) - 1)] == values


def decontaminate(docs: DataFrame, benchmark: DataFrame, keep: list[str] | None = None, broadcast_bytes: int = 64 << 20, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """docs (the columns in keep, or all) with n_words, n_hit, items (ids, sorted as strings) and contaminated."""
    ship(docs.sparkSession)
    items = benchmark.where(F.col(item_col).isNotNull()).select(F.col(item_col).cast("string").alias("id"), body(item_text_col).alias("text"))
    nbytes = items.agg(F.sum(F.octet_length("text") + F.octet_length("id"))).first()[0] or 0
    if nbytes <= broadcast_bytes:
        rows = items.collect()
        return _broadcast_plan(docs, Index([r.id for r in rows], [r.text for r in rows]), keep, text_col)
    return _shuffle_plan(docs, items, keep, text_col)


def _schema(docs: DataFrame, keep: list[str]) -> T.StructType:
    names = {f.name.lower() for f in RESULT}
    return T.StructType([docs.schema[c] for c in keep if c.lower() not in names] + RESULT)


def _broadcast_plan(docs: DataFrame, index: Index, keep: list[str] | None, text_col: str) -> DataFrame:
    schema = _schema(docs, docs.columns if keep is None else keep)
    shared = docs.sparkSession.sparkContext.broadcast(index)
    kept = [f.name for f in schema.fields[: -len(RESULT)]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            words, hit, found = index.match(batch.column(text_col))
            extra = [pa.array(words, pa.int64()), pa.array(hit, pa.int64()), pa.array(found, pa.list_(pa.string())), pa.array([x > 0 for x in hit], pa.bool_())]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + extra, schema.names)

    wanted = list(dict.fromkeys([*kept, text_col]))
    return docs.select(*wanted).mapInArrow(run, schema)


_COUNT = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _n_words(text_col: str):
    return F.regexp_count(ascii_lower(body(text_col)), F.lit(_COUNT))


def _rows_of(names: list[str], sizes: list[tuple[int, int, int]], of_items: bool, whole: bool):
    """From texts to a row per fingerprint (place and hash), or with whole per window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in vectext.blocks(batch.column("text")):
                hashes, first = _words(block)
                length = np.diff(first)
                for size, k, w in sizes:
                    if whole:
                        at = np.flatnonzero(vectext.ngrams(hashes, first, size)[1])
                        values = window_hashes(hashes, at, size)
                    else:
                        at, values = fingerprints(hashes, first, k, w)
                    rows = np.searchsorted(first, at, "right") - 1
                    if of_items:
                        ok = length[rows] >= size if w > 1 else length[rows] == size
                        at, values, rows = at[ok], values[ok], rows[ok]
                    keys = [batch.column(c).take(pa.array(rows + block[0])) for c in names]
                    yield pa.RecordBatch.from_arrays([*keys, pa.array(np.full(len(at), size), pa.int32()), pa.array(at - first[rows], pa.int64()), pa.array(values.view(np.int64))], [*names, "size", "place", "h"])

    return run


def _around_seeds(sizes: list[tuple[int, int, int]]):
    """From texts with their seeds to a row per window around them."""
    grams = {size: k for size, k, _ in sizes}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in vectext.blocks(batch.column("text")):
                hashes, first = _words(block)
                seeds = batch.column("seeds").slice(block[0], block[1] - block[0]).to_pylist()
                for size, k in grams.items():
                    at = np.array([first[i] + s["place"] for i, row in enumerate(seeds) for s in row if s["size"] == size], np.int64)
                    at = around(np.unique(at), first, size, k)
                    rows = np.searchsorted(first, at, "right") - 1
                    keys = [batch.column(c).take(pa.array(rows + block[0])) for c in ("__a", "__b")]
                    yield pa.RecordBatch.from_arrays([*keys, pa.array(np.full(len(at), size), pa.int32()), pa.array(at - first[rows], pa.int64()), pa.array(window_hashes(hashes, at, size).view(np.int64))], ["__a", "__b", "size", "place", "h"])

    return run


def _shuffle_plan(docs: DataFrame, items: DataFrame, keep: list[str] | None, text_col: str) -> DataFrame:
    """Two joins by hash, of fingerprints and of windows. Results hang on texts alone: two hashes of the text are the key."""
    names = {f.name.lower() for f in RESULT}
    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() not in names]
    key = [F.xxhash64(body(text_col)).alias("__a"), F.hash(body(text_col)).alias("__b")]
    texts = docs.select(*key, body(text_col).alias("text")).dropDuplicates(["__a", "__b"])
    lengths = [int(r[0]) for r in items.select(F.least(_n_words("text"), F.lit(SPAN))).distinct().collect()]  # at most span + 1 numbers
    sizes = sizes_of(np.array(lengths or [0]), SPAN, K)
    kind = "size int, place long, h long"

    prints = items.mapInArrow(_rows_of(["id"], sizes, True, False), f"id string, {kind}").select("size", "h").distinct()
    seeds = texts.mapInArrow(_rows_of(["__a", "__b"], sizes, False, False), f"__a long, __b int, {kind}").join(prints, ["size", "h"], "left_semi")
    seeds = seeds.groupBy("__a", "__b").agg(F.collect_list(F.struct("size", "place")).alias("seeds"))  # at most a text's words
    windows = texts.join(seeds, ["__a", "__b"]).mapInArrow(_around_seeds(sizes), f"__a long, __b int, {kind}")
    owners = stored(items.mapInArrow(_rows_of(["id"], sizes, True, True), f"id string, {kind}").select("size", "h", "id").distinct(), "item-windows")
    hits = stored(windows.join(owners.select("size", "h").distinct(), ["size", "h"], "left_semi"), "window-hits")
    found = hits.select("__a", "__b", "size", "h").distinct().join(owners, ["size", "h"]).groupBy("__a", "__b").agg(F.sort_array(F.collect_set("id")).alias("items"))
    runs = hits.groupBy("__a", "__b").agg(F.sort_array(F.collect_list(F.struct("place", (F.col("place") + F.col("size")).alias("end")))).alias("runs"))
    covered = F.aggregate("runs", F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end")), lambda s, r: F.struct((s["n"] + F.greatest(F.lit(0), r["end"] - F.greatest(r["place"], s["end"]))).alias("n"), F.greatest(s["end"], r["end"]).alias("end")))["n"]
    judged = found.join(runs, ["__a", "__b"]).select(F.col("__a").alias("__c"), F.col("__b").alias("__d"), F.col("items").alias("__items"), covered.alias("__hit"))
    rows = docs.select(*kept, *key, _n_words(text_col).cast("long").alias("n_words"))
    out = rows.join(judged, (F.col("__a") == F.col("__c")) & (F.col("__b") == F.col("__d")), "left")
    hit = F.coalesce("__hit", F.lit(0).cast("long"))
    return out.select(*kept, "n_words", hit.alias("n_hit"), F.coalesce("__items", F.array().cast("array<string>")).alias("items"), (hit > 0).alias("contaminated"))
