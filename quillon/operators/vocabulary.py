"""The most frequent terms of a corpus, by summaries of heavy hitters: exact, without a shuffle of all terms.

Each task counts its terms in a summary of at most ``room`` entries. When it is
full, the count of the first entry out of room is taken off all of them, and those
that fall to nothing go; what was taken off is the summary's error. Summaries
add up: a term's true count lies between its summed count and that plus the
summed errors E. Let L be the count of rank V among the sums. The V most frequent
terms all reach L or more, so a term whose count plus E is under L is not among
them, and a term in no summary is not if E is under L. The rest, the survivors,
are counted exactly in a second pass, and their ranks decide. Where E reaches L,
the summaries prove nothing, and all terms are counted instead.

A document is a bag: its distinct terms and how often each stands. Bags are
made once, where the document is, and stored; all passes read them. Passes take a
batch in slices of some terms, so that a worker's memory is that of a batch as it
came, a slice and a summary, however many documents a task has.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.shipping import ship
from ..sources.shared import stored

ROOM = 1 << 20  # entries of a task's summary
SLICE = 1 << 20  # terms that are worked on at once, or one document's
SENT_BYTES = 16 << 20  # of survivors' text that goes to every task; more are joined
COUNTS = "term string, df long, total long"


def _flat(lists: pa.ListArray) -> tuple[pa.Array, np.ndarray]:
    """All values, and the row of each."""
    size = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return lists.flatten(), np.repeat(np.arange(len(lists)), size)


def _slices(batches: Iterator[pa.RecordBatch], size: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most size terms, or of one row."""
    for batch in batches:
        ends = np.cumsum(batch.column("terms").value_lengths().fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
        lo = 0
        while lo < len(ends):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + size, "right")))
            yield batch.slice(lo, hi - lo)
            lo = hi


def bags(docs: DataFrame, key: str, terms: Column) -> DataFrame:
    """key, terms and tf: a row per document (a row of docs), stored."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            values, row = _flat(batch.column("terms"))
            coded = values.dictionary_encode()
            known = coded.dictionary
            place = row * max(1, len(known)) + coded.indices.to_numpy(zero_copy_only=False)
            place, tf = np.unique(place, return_counts=True)
            row, code = np.divmod(place, max(1, len(known)))
            ends = pa.array(np.searchsorted(row, np.arange(len(batch) + 1)), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.ListArray.from_arrays(ends, known.take(pa.array(code))), pa.ListArray.from_arrays(ends, pa.array(tf, pa.int32()))], [key, "terms", "tf"])

    kind = docs.schema[key].dataType.simpleString()
    return stored(docs.select(key, terms.alias("terms")).mapInArrow(run, f"`{key}` {kind}, terms array<string>, tf array<int>"), "bags")


class Summary:
    """Counts of at most room terms after each pruning; error is what may be missing from each."""

    def __init__(self, room: int):
        self.room, self.error = room, 0
        self.counts = pa.table({"term": pa.array([], pa.string()), "n": pa.array([], pa.int64())})

    def add(self, terms: pa.Array, counts: np.ndarray) -> None:
        """Terms may repeat; they are put together once there are many."""
        self.counts = pa.concat_tables([self.counts, pa.table({"term": terms.cast(pa.string()), "n": pa.array(counts, pa.int64())})])
        if len(self.counts) > 2 * self.room:
            self.prune()

    def prune(self) -> None:
        summed = self.counts.group_by("term", use_threads=False).aggregate([("n", "sum")]).rename_columns({"n_sum": "n"}).select(["term", "n"])
        if len(summed) > self.room:
            values = summed.column("n").to_numpy()
            off = int(np.partition(values, len(values) - self.room - 1)[len(values) - self.room - 1])
            self.error += off
            summed = summed.filter(pa.array(values > off)).set_column(1, "n", pa.array(values[values > off] - off))
        self.counts = summed


def _totals(bag: pa.RecordBatch) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct terms of a batch of bags, their documents and occurrences."""
    values, _ = _flat(bag.column("terms"))
    tf = bag.column("tf").flatten().to_numpy(zero_copy_only=False)
    coded = values.dictionary_encode()
    code = coded.indices.to_numpy(zero_copy_only=False)
    n = len(coded.dictionary)
    return coded.dictionary, np.bincount(code, minlength=n), np.bincount(code, tf, n).astype(np.int64)


def summaries(bag: DataFrame, room: int = ROOM) -> DataFrame:
    """term and n, a task's summary each; the row of a null term is its error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = Summary(room)
        for batch in _slices(batches):
            known, _, total = _totals(batch)
            mine.add(known, total)
        mine.prune()
        yield from mine.counts.to_batches(max_chunksize=SLICE >> 4)
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.string()), pa.array([mine.error], pa.int64())], ["term", "n"])

    return bag.select("terms", "tf").mapInArrow(run, "term string, n long")


def exact_counts(bag: DataFrame, only: pa.Array | None = None) -> DataFrame:
    """COUNTS of all terms, or of those in only, which every task gets. A task sums its terms before they are shuffled."""
    shared = None if only is None else bag.sparkSession.sparkContext.broadcast(only)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = None if shared is None else shared.value
        for batch in _slices(batches):
            known, df, total = _totals(batch)
            if wanted is not None:
                at = np.flatnonzero(pc.is_in(known, value_set=wanted).to_numpy(zero_copy_only=False))
                known, df, total = known.take(pa.array(at)), df[at], total[at]
            yield pa.RecordBatch.from_arrays([known, pa.array(df, pa.int64()), pa.array(total)], ["term", "df", "total"])

    return bag.select("terms", "tf").mapInArrow(run, COUNTS).groupBy("term").agg(F.sum("df").alias("df"), F.sum("total").alias("total"))


def most_frequent(bag: DataFrame, size: int, room: int = ROOM, sent_bytes: int = SENT_BYTES) -> DataFrame:
    """COUNTS of the terms of the greatest totals, by term among equals. survivors() says what was counted."""
    kept = survivors(bag, size, room)
    counts = None
    if kept is not None:
        nbytes = kept.agg(F.sum(F.octet_length("term") + 8)).first()[0] or 0
        counts = exact_counts(bag, kept.toArrow().column("term").combine_chunks()) if nbytes <= sent_bytes else exact_counts(bag).join(kept, "term", "left_semi")
    return (exact_counts(bag) if counts is None else counts).orderBy(F.desc("total"), "term").limit(size)


def survivors(bag: DataFrame, size: int, room: int = ROOM) -> DataFrame | None:
    """The terms that may be among the most frequent; None where the summaries cannot tell."""
    merged = stored(summaries(bag, room).groupBy("term").agg(F.sum("n").alias("n")), "summaries")
    error = merged.where("term is null").agg(F.sum("n")).first()[0] or 0
    least = merged.where("term is not null").orderBy(F.desc("n")).limit(size).agg(F.count("*").alias("ranks"), F.min("n").alias("n")).first()
    if least.ranks < size:  # all terms there are, if none was lost
        return merged.where("term is not null").select("term") if error == 0 else None
    return merged.where((F.col("n") + error >= least.n) & F.col("term").isNotNull()).select("term") if error < least.n else None


def weights(bag: DataFrame, key: str, counts: DataFrame, n_docs: int) -> DataFrame:
    """A row per document and term of counts (COUNTS; a vocabulary, which every task gets): key, term, tf, df, w = tf (ln((1 + n) / (1 + df)) + 1), and tfidf: w over the length of the document's."""
    chosen = counts.select("term", "df").collect()
    shared = bag.sparkSession.sparkContext.broadcast(([r.term for r in chosen], np.array([r.df for r in chosen], np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, df = shared.value
        known = pa.array(names, pa.string())
        idf = np.log((1 + n_docs) / (1.0 + df)) + 1
        for batch in _slices(batches):
            values, row = _flat(batch.column("terms"))
            at = pc.index_in(values, value_set=known)
            in_ = np.flatnonzero(at.is_valid().to_numpy(zero_copy_only=False))
            code, row = at.take(pa.array(in_)).to_numpy(zero_copy_only=False), row[in_]
            tf = batch.column("tf").flatten().to_numpy(zero_copy_only=False)[in_]
            w = tf * idf[code]
            length = np.sqrt(np.bincount(row, w * w, len(batch)))
            yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(row)), known.take(pa.array(code)), pa.array(tf, pa.int64()), pa.array(df[code]), pa.array(w), pa.array(w / length[row])], [key, "term", "tf", "df", "w", "tfidf"])

    kind = bag.schema[key].dataType.simpleString()
    return bag.mapInArrow(run, f"`{key}` {kind}, term string, tf long, df long, w double, tfidf double")
