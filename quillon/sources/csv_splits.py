"""Quoted CSV read in splits: one large file is many tasks' work, though rows may hold line breaks.

Spark's text scan deals a file out by lines. Whether a line begins inside quotes
hangs on all lines before it, so the scan runs twice. First each split says where
it would end, inside or outside quotes, for both ways it may begin: what a line
does to that state is one of four functions (keep, swap, set, clear), and a
split's is their composition. The driver composes a row per split, which it holds
anyway to schedule them, into the state each split begins in. Then each split
gives its whole records; a record that a border cuts is given in pieces, which
meet in a shuffle of pieces alone. Records become columns by from_csv.

A quote opens a field only at its start, and two quotes in a quoted field stand
for one. Rows end at \\n or \\r\\n; the latter stays inside quotes as it is. Empty
lines outside quotes are no rows. The first record of each file is its head; it
begins in the file's first split.
A quote that never closes takes the rest of its file into one record.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.shipping import ship

#: One field, whole, of a line that begins outside quotes; behind a closing quote no quote follows.
_FIELD = r'(?:"(?:[^"]|"")*"(?:[^",][^,]*)?|[^",][^,]*|)'
#: Lines that end outside quotes if they begin outside, and if they begin inside.
FROM_OUT = rf"(?s)^{_FIELD}(?:,{_FIELD})*$"
FROM_IN = rf'(?s)^(?:[^"]|"")*"(?:[^",][^,]*)?(?:,{_FIELD})*$'
WHOLE, HEAD, MIDDLE, TAIL = range(4)
SPLIT = "path string, begin long, from_out boolean, from_in boolean"
RECORD = "path string, begin long, kind int, first boolean, record string"
#: RFC 4180 quoting; backslashes are data, rows may span lines.
QUOTING = {"quote": '"', "escape": '"', "multiLine": "true"}


def line_states(lines: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """For each line: is its end inside quotes, if its beginning is outside, and if it is inside."""
    out, in_ = np.zeros(len(lines), bool), np.ones(len(lines), bool)
    quoted = np.flatnonzero(pc.match_substring(lines, '"').to_numpy(zero_copy_only=False))
    if len(quoted):
        some = lines.take(pa.array(quoted))
        for state, pattern in ((out, FROM_OUT), (in_, FROM_IN)):
            state[quoted] = ~pc.match_substring_regex(some, pattern).to_numpy(zero_copy_only=False)
    return out, in_


def after_each(out: np.ndarray, in_: np.ndarray, begin: bool) -> np.ndarray:
    """The state after each line: what the last line that sets or clears it left, turned by those that swap since."""
    fixed = out == in_
    last = np.maximum.accumulate(np.where(fixed, np.arange(len(out)), -1))
    swaps = np.cumsum(out & ~in_)
    since = swaps - np.where(last >= 0, swaps[last], 0)
    return np.where(last >= 0, out[last], begin) ^ (since % 2 == 1)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, pa.Array]]:
    """(path, begin of the split, lines) of stretches of one split. A task may hold several splits, each in order."""
    for batch in batches:
        split = batch.column("split").to_numpy(zero_copy_only=False)
        cuts = np.r_[0, np.flatnonzero(split[1:] != split[:-1]) + 1, len(split)]
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            if b > a:
                yield batch.column("path")[a].as_py(), batch.column("begin")[a].as_py(), batch.column("value").slice(a, b - a)


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per split: its ends for both beginnings."""
    found: dict[tuple[str, int], tuple[bool, bool]] = {}
    for path, begin, lines in _runs(batches):
        out, in_ = line_states(lines)
        before = found.get((path, begin), (False, True))
        found[path, begin] = tuple(bool(after_each(out, in_, x)[-1]) for x in before)
    rows = [(p, b, *ends) for (p, b), ends in found.items()]
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.string(), pa.int64(), pa.bool_(), pa.bool_()))], [x.split()[0] for x in SPLIT.split(", ")])


def beginnings(ends: list[tuple[str, int, bool, bool]]) -> set[tuple[str, int]]:
    """The splits that begin inside quotes."""
    of = defaultdict(list)
    for path, *split in ends:
        of[path].append(split)
    inside = set()
    for path, splits in of.items():
        state = False
        for begin, from_out, from_in in sorted(splits):
            if state:
                inside.add((path, begin))
            state = from_in if state else from_out
    return inside


def _joined(lines: pa.Array, ends: np.ndarray) -> pa.Array:
    """Lines put together, each record ending behind one of ends."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), lines.slice(0, int(ends[-1]) if len(ends) else 0)), "\n")


def _records(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inside = shared.value
        key, state, cut, open_, head = None, False, False, [], False

        def rows(kinds: list[int], records: pa.Array) -> pa.RecordBatch:
            """The file's first record that is not empty is marked; others that are empty go."""
            nonlocal head
            kept = [i for i, r in enumerate(records.to_pylist()) if r not in ("", "\r") or kinds[i] != WHOLE]
            records, kinds = records.take(pa.array(kept, pa.int64())), [kinds[i] for i in kept]
            n = len(kinds)
            first = [head and i == 0 for i in range(n)]
            head = head and not n
            return pa.RecordBatch.from_arrays([pa.array([key[0]] * n, pa.string()), pa.array([key[1]] * n, pa.int64()), pa.array(kinds, pa.int32()), pa.array(first, pa.bool_()), records.cast(pa.string())], [x.split()[0] for x in RECORD.split(", ")])

        def left() -> Iterator[pa.RecordBatch]:
            """Lines of a record that its split does not end."""
            if open_:
                yield rows([MIDDLE if cut else TAIL], pa.array(["\n".join(open_)]))

        for path, begin, lines in _runs(batches):
            if (path, begin) != key:
                yield from left()
                key, open_, head = (path, begin), [], begin == 0
                state = cut = key in inside  # cut: the first record began in an earlier split
            after = after_each(*line_states(lines), state)
            state = bool(after[-1])
            ends = np.flatnonzero(~after) + 1
            if not len(ends):
                open_ += lines.to_pylist()
                continue
            records = _joined(lines, ends)
            if open_:
                records = pa.concat_arrays([pa.array(["\n".join([*open_, records[0].as_py()])], records.type), records.slice(1)])
            yield rows([HEAD if cut else WHOLE] + [WHOLE] * (len(records) - 1), records)
            cut, open_ = False, lines.slice(int(ends[-1])).to_pylist()
        if key is not None:
            yield from left()

    return run


def records(spark: SparkSession, *paths: str) -> DataFrame:
    """path, begin (of the split), first (of its file) and record: all records of the files, without their line ends."""
    ship(spark)
    meta = F.col("_metadata")
    lines = spark.read.option("lineSep", "\n").option("recursiveFileLookup", "true").text(list(paths)).select("value", meta["file_path"].alias("path"), meta["file_block_start"].alias("begin"))
    lines = lines.withColumn("split", F.xxhash64("path", "begin"))
    inside = beginnings([tuple(r) for r in lines.mapInArrow(_ends, SPLIT).collect()])
    found = lines.mapInArrow(_records(spark.sparkContext.broadcast(inside)), RECORD)
    whole = found.where(F.col("kind") == WHOLE).select("path", "begin", "first", "record")
    # pieces are some per split; a record's are those from a tail on
    number = F.sum((F.col("kind") == TAIL).cast("int")).over(Window.partitionBy("path").orderBy("begin", "kind"))
    pieces = found.where(F.col("kind") != WHOLE).withColumn("n", number)
    cut = pieces.groupBy("path", "n").agg(F.min("begin").alias("begin"), F.max("first").alias("first"), F.sort_array(F.collect_list(F.struct("begin", "kind", "record"))).alias("parts"))
    cut = cut.select("path", "begin", "first", F.array_join(F.transform("parts", lambda p: p["record"]), "\n").alias("record"))
    return whole.unionByName(cut).withColumn("record", F.regexp_replace("record", "\r$", ""))


def read(spark: SparkSession, *paths: str, schema: T.StructType | str | None = None) -> DataFrame:
    """The files' rows below their heads. Columns are those of the first file's head, as text, or of schema."""
    kind = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema or spark.read.options(header="true", **QUOTING).csv(list(paths)).schema
    return records(spark, *paths).where(~F.col("first")).select(F.from_csv("record", F.lit(kind.toDDL()), QUOTING).alias("r")).select("r.*")
