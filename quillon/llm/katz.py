"""Language-model scores: Katz backoff with Good-Turing discounts.

Tokens: words between ASCII white space, A-Z in lower case, then one end. Grams
of every order are counted over the training rows. Counts up to 5 are discounted
by Good-Turing, the mass so freed goes to the next lower order with weights that
normalise exactly: alpha(context) = (1 - sum of discounted probabilities of what
was seen after it) / (1 - sum of the lower order's probabilities of the same).
At order 1 it goes to one unknown word. Where a context frees no mass, its total
grows by one, and that one is the mass. A context never seen hands its token to
the lower order whole. Where plain Good-Turing is not usable (a count of counts
is zero, or a discount leaves (0, 1], as groups of copies make it), an order's
counts of counts are first smoothed by a log-linear fit; where that does not fall
as it must, counts lose an absolute discount. An order is not discounted only
where nothing occurs once and no line can be fitted.

Plan. Documents are packed once into chunks of some sixteen megabytes of text:
word hashes and token places, in files of the shared folder (Arrow, a batch per
chunk), with a small table that names them. Counting: each chunk sends its
distinct grams with their training counts, sorted by hash and cut into hash
ranges, to the tasks that own the ranges. The number of ranges is the number of
tokens over ``part_tokens``, so a range stays as large whatever the input is; a
gram costs one entry per chunk however frequent it is, so no key is hot. A range
adds up, answers each chunk with the totals, and gives its part of the model: a
row of sorted hashes and counts. Answers meet at their chunk and are put into a
file again. Sums of discounted mass travel in the same way, from the one chunk
that owns a gram. Then each chunk evaluates its tokens recursively. The model is
two tables, counts by order and range and sums by order and range, and scores
other texts, too (score_with). Only sums of counts of counts reach the driver.

Nulls and odd rows: a null text is empty, its only token the end. Rows of a null
id are training rows. Repeated rows count as often as they stand. Empty tables
give empty results. The result has the id and the scores; other columns, of
whatever name, are left out. Texts are used whole. 64-bit hashes stand for words
and grams.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import vectext
from .common import body, fresh_path, ship, stored

END, BEGIN = np.uint64(0x656E64), np.uint64(0x626567696E)
LIMIT = 5  # counts up to this are discounted
STEP = np.uint64(0x9E3779B97F4A7C15)
PACKED = pa.schema([(c, pa.binary()) for c in ("ids", "sizes", "train", "words", "tokens")])
ANSWERED = pa.schema([("order", pa.int32()), ("data", pa.list_(pa.binary()))])
#: A chunk's place: a file and a batch in it, and the same for the answers to it so far.
CHUNK = "chunk long, tokens long, files array<string>, batches array<int>"
#: What travels: of an order and hash range, from or to a chunk (negative: rows of the model), its columns and, of the model, some sums.
MESSAGE = "order int, part int, chunk long, data array<binary>, sums array<long>"
MESSAGE_ARROW = pa.schema([("order", pa.int32()), ("part", pa.int32()), ("chunk", pa.int64()), ("data", pa.list_(pa.binary())), ("sums", pa.list_(pa.int64()))])


def pack(a: np.ndarray) -> bytes:
    """Bytes by plane, so that equal high bytes compress."""
    a = np.ascontiguousarray(a)
    planes = np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T) if len(a) else np.zeros(0, np.uint8)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(data: bytes, kind) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(size, len(raw) // size).T).reshape(-1).view(kind)


def pack_sorted(a: np.ndarray) -> bytes:
    return pack(np.diff(a, prepend=a.dtype.type(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data, np.uint64), dtype=np.uint64)


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys, each one's first place, and each place's index among them."""
    order = np.argsort(keys, kind="stable")
    s = keys[order]
    new = np.ones(len(s), bool)
    new[1:] = s[1:] != s[:-1]
    index = np.empty(len(s), np.int64)
    index[order] = np.cumsum(new) - 1
    return s[new], order[new], index


def range_cuts(sorted_hashes: np.ndarray, parts: int) -> np.ndarray:
    """Where each of the equal hash ranges begins, and the end."""
    bounds = np.array([(k << 64) // parts for k in range(parts)], dtype=object).astype(np.uint64)
    return np.concatenate([np.searchsorted(sorted_hashes, bounds), [len(sorted_hashes)]])


class Chunk:
    """A chunk's documents as token places, and its grams of each order."""

    def __init__(self, row: dict):
        self.chunk, self.files, self.batches = row["chunk"], row["files"], row["batches"]
        packed = _read_batch(self.files[0], self.batches[0]).to_pylist()[0]
        self.ids = packed["ids"]
        self.sizes = unpack(packed["sizes"], np.int32).astype(np.int64)
        self.train = unpack(packed["train"], np.bool_)
        self.words = unpack_sorted(packed["words"])
        self.token = unpack(packed["tokens"], np.uint32).astype(np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.sizes)])
        self.trained = np.repeat(self.train, self.sizes)
        self.place = np.arange(len(self.token)) - np.repeat(self.first[:-1], self.sizes)  # in its document
        self._answers: dict[int, list[list[bytes]]] = {}

    def answers(self, step: int, order: int, kinds: list) -> list[np.ndarray]:
        """The answers of an exchange to the grams of an order, column by column in hash order."""
        if step not in self._answers:
            self._answers[step] = _read_batch(self.files[step], self.batches[step]).to_pylist()
        rows = [r["data"] for r in self._answers[step] if r["order"] == order]
        return [np.concatenate([unpack(r[i], k) for r in rows]) for i, k in enumerate(kinds)]

    def grams(self, order: int) -> tuple[np.ndarray, np.ndarray]:
        """Per token, hashes of the gram that ends there and of its context; history before a document is one begin mark."""
        word = self.words[self.token]
        context = np.zeros(len(word), np.uint64)
        for back in range(order - 1, 0, -1):
            earlier = np.full(len(word), BEGIN, np.uint64)
            has = self.place >= back
            earlier[has] = word[np.flatnonzero(has) - back]
            context = vectext.mix(context * STEP + earlier + np.uint64(1))
        return (vectext.mix(context * STEP + word + np.uint64(1)) if order > 1 else word), context


def _open_fs(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri.removeprefix("file:"))


class _Batches:
    """A task attempt's file in the shared folder, a batch per chunk. It has a name of its own, so a repeated task never overwrites what another named."""

    def __init__(self, folder: str, schema: pa.Schema):
        context = TaskContext.get()
        self.path, self.schema = f"{folder}/{context.partitionId():05d}-{context.taskAttemptId()}.arrow", schema
        self.n, self.out, self.sink = 0, None, None

    def add(self, batch: pa.RecordBatch) -> int:
        if self.out is None:
            system, local = _open_fs(self.path)
            system.create_dir(local.rpartition("/")[0], recursive=True)
            self.sink = system.open_output_stream(local, compression=None)
            self.out = pa.ipc.new_file(self.sink, self.schema)
        self.out.write_batch(batch)
        self.n += 1
        return self.n - 1

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.sink.close()


def _read_batch(path: str, number: int) -> pa.RecordBatch:
    system, local = _open_fs(path)
    with system.open_input_file(local) as f:
        return pa.ipc.open_file(f).get_batch(number)


def _chunk_rows(rows: list[tuple]) -> pa.RecordBatch:
    chunk, tokens, files, batches = zip(*rows) if rows else ((), (), (), ())
    return pa.RecordBatch.from_arrays([pa.array(chunk, pa.int64()), pa.array(tokens, pa.int64()), pa.array(files, pa.list_(pa.string())), pa.array(batches, pa.list_(pa.int32()))], ["chunk", "tokens", "files", "batches"])


def _pack_chunks(folder: str, chunk_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, number = _Batches(folder, PACKED), 0
        ids, sizes, train, hashes, held = [], [], [], [], 0

        def flush() -> tuple:
            nonlocal number, ids, sizes, train, hashes, held
            words, _, index = distinct(np.concatenate(hashes))
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, ids[0].schema) as stream:
                for part in ids:
                    stream.write_batch(part)
            row = {
                "ids": zstandard.ZstdCompressor().compress(sink.getvalue().to_pybytes()),
                "sizes": pack(np.concatenate(sizes).astype(np.int32)),
                "train": pack(np.concatenate(train)),
                "words": pack_sorted(words),
                "tokens": pack(index.astype(np.uint32)),
            }
            at = out.add(pa.RecordBatch.from_pylist([row], PACKED))
            number += 1
            ids, sizes, train, hashes, held = [], [], [], [], 0
            return (TaskContext.get().partitionId() << 24) + number - 1, len(index), [out.path], [at]

        rows = []
        for batch in batches:
            for lo, hi, data, offsets in vectext.blocks(batch.column("__text")):
                words, first, _, _ = vectext.word_hashes(data, offsets)
                ids.append(batch.select(["__id"]).slice(lo, hi - lo))
                train.append(~batch.column("held_out").slice(lo, hi - lo).to_numpy(zero_copy_only=False))
                sizes.append(np.diff(first) + 1)
                hashes.append(np.insert(words, first[1:], END))
                held += len(data)
                if held >= chunk_bytes:
                    rows.append(flush())
        if ids:
            rows.append(flush())
        out.close()
        yield _chunk_rows(rows)

    return run


def _rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        yield from batch.to_pylist()


def _messages(order: int, chunk: int, hashes: np.ndarray, columns: list[np.ndarray], parts: int) -> pa.RecordBatch:
    """A row per hash range that holds any of the hashes."""
    cuts = range_cuts(hashes, parts)
    rows = [{"order": order, "part": int(p), "chunk": chunk, "data": [pack_sorted(hashes[cuts[p] : cuts[p + 1]]), *(pack(c[cuts[p] : cuts[p + 1]]) for c in columns)], "sums": None} for p in np.flatnonzero(np.diff(cuts))]
    return pa.RecordBatch.from_pylist(rows, MESSAGE_ARROW)


def _answer_table(order: int, part: int, chunks: list[int], data: list[list[bytes]], model: list[np.ndarray], sums: list[int]) -> pa.Table:
    """Answers to chunks, and the range's row of the model, under a negative chunk number so that these rows spread."""
    at = [i for i, c in enumerate(chunks) if c >= 0]
    n = len(at) + 1
    rows = [[*(data[i] for i in at), [pack_sorted(model[0]), *map(pack, model[1:])]], [*(chunks[i] for i in at), -1 - part], [*([None] * len(at)), sums]]
    return pa.table({"order": pa.array([order] * n, pa.int32()), "part": pa.array([part] * n, pa.int32()), "chunk": pa.array(rows[1], pa.int64()), "data": pa.array(rows[0], pa.list_(pa.binary())), "sums": pa.array(rows[2], pa.list_(pa.int64()))})


def _gather(table: pa.Table) -> tuple[list[int], list[list[bytes]], np.ndarray, np.ndarray, np.ndarray]:
    """A hash range's messages: chunks, data, where each chunk's begin, and all distinct hashes with each place's index."""
    table = table.sort_by("chunk")
    chunks, data = table.column("chunk").to_pylist(), table.column("data").to_pylist()
    hashes = [unpack_sorted(d[0]) for d in data]
    first = np.cumsum([0, *map(len, hashes)])
    keys, _, index = distinct(np.concatenate(hashes))
    return chunks, data, first, keys, index


def _count(key: tuple, table: pa.Table) -> pa.Table:
    """Totals of a hash range's grams; each gram with a count belongs to the first chunk that has it. The model's row has N, V and the counts of counts as sums."""
    chunks, data, first, keys, index = _gather(table)
    own = np.concatenate([unpack(d[1], np.uint32) for d in data]).astype(np.int64)
    total = np.bincount(index, own, len(keys)).astype(np.int64)
    counted = np.flatnonzero(own > 0)
    owner = np.full(len(keys), -1, np.int64)
    owner[index[counted][::-1]] = counted[::-1]
    mine = owner[index] == np.arange(len(index))
    out = [[pack(total[index[a:b]].astype(np.uint32)), pack(mine[a:b])] for a, b in zip(first[:-1], first[1:])]
    seen = total > 0
    sums = [int(x) for x in (total.sum(), seen.sum(), *((total == r).sum() for r in range(1, LIMIT + 2)))]
    return _answer_table(key[0].as_py(), key[1].as_py(), chunks, out, [keys[seen], total[seen].astype(np.uint32)], sums)


def _add(key: tuple, table: pa.Table) -> pa.Table:
    """Sums over chunks of the columns behind the hash, sent back to each."""
    chunks, data, first, keys, index = _gather(table)
    sums = [np.bincount(index, np.concatenate([unpack(d[i], np.float64) for d in data]), len(keys)) for i in (1, 2, 3)]
    seen = sums[0] > 0
    return _answer_table(key[0].as_py(), key[1].as_py(), chunks, [[pack(s[index[a:b]]) for s in sums] for a, b in zip(first[:-1], first[1:])], [keys[seen], *(s[seen] for s in sums)], [])


def _settle(folder: str):
    """In rows sorted by chunk, order and range, the chunk's own row first: puts the answers to a chunk into a file and names it in the chunk's row. Rows of the model pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, row, held = _Batches(folder, ANSWERED), None, []

        def flush() -> pa.RecordBatch:
            at = out.add(pa.RecordBatch.from_pylist(held, ANSWERED))
            return pa.RecordBatch.from_pylist([{**row, "files": [*row["files"], out.path], "batches": [*row["batches"], at], "order": None, "part": None, "data": None, "sums": None}], SETTLED_ARROW)

        for x in _rows_of(batches):
            if x["chunk"] < 0:
                yield pa.RecordBatch.from_pylist([x], SETTLED_ARROW)
            elif x["files"] is not None:
                if row is not None:
                    yield flush()
                row, held = x, []
            else:
                held.append({"order": x["order"], "data": x["data"]})
        if row is not None:
            yield flush()
        out.close()

    return run


SETTLED = CHUNK + ", order int, part int, data array<binary>, sums array<long>"
SETTLED_ARROW = pa.schema([("chunk", pa.int64()), ("tokens", pa.int64()), ("files", pa.list_(pa.string())), ("batches", pa.list_(pa.int32())), ("order", pa.int32()), ("part", pa.int32()), ("data", pa.list_(pa.binary())), ("sums", pa.list_(pa.int64()))])


def smoothed(n: list[int]) -> np.ndarray | None:
    """Counts of counts (index 0 unused) by simple Good-Turing: each is spread over the zeros beside it, and a line is fitted in logarithms. None without two points or a fall steeper than 1 / r, which no discount can come from."""
    r = np.flatnonzero(n)
    if len(r) < 2:
        return None
    gap = np.diff(np.r_[0, r, 2 * r[-1] - r[-2]])
    slope, height = np.polyfit(np.log(r), np.log(2 * np.array(n, float)[r] / (gap[:-1] + gap[1:])), 1)
    return np.r_[0.0, np.exp(height + slope * np.log(np.arange(1, len(n))))] if slope < -1 else None


def katz_factors(n) -> np.ndarray | None:
    """Katz's factors of counts of counts 0 to LIMIT + 1 (index 0 unused); None if one is not in (0, 1]."""
    if min(n[1:]) <= 0 or (rest := (LIMIT + 1) * n[LIMIT + 1] / n[1]) >= 1:
        return None
    d = np.array([1.0, *(((r + 1) * n[r + 1] / (r * n[r]) - rest) / (1 - rest) for r in range(1, LIMIT + 1))])
    return d if ((d > 0) & (d <= 1)).all() else None


def discounts(counts_of_counts: list[int]) -> np.ndarray:
    """Factors for counts 0 to LIMIT (index 0 unused): Katz's, of the smoothed counts of counts where the plain ones give none; else 1 - D / r with D = n1 / (n1 + 2 n2). All ones where nothing occurs once and no line can be fitted."""
    n = [0, *counts_of_counts]
    d = katz_factors(n)
    if d is None and (line := smoothed(n)) is not None:
        d = katz_factors(line)
    if d is None:
        d = np.ones(LIMIT + 1)
        if n[1]:
            d[1:] -= n[1] / (n[1] + 2 * max(n[2], 1)) / np.arange(1, LIMIT + 1)
    return d


def discounted(counts: np.ndarray, factors: np.ndarray) -> np.ndarray:
    return counts * np.where(counts <= LIMIT, factors[np.minimum(counts, LIMIT)], 1.0)


class Model:
    """What every task knows: per order the factors; for order 1 the totals and the unknown word's mass. The tables stay where they are: rows of MESSAGE, of counts and of sums."""

    def __init__(self, order: int, parts: int):
        self.order, self.parts = order, parts
        self.total = self.kinds = 0
        self.factors: list[np.ndarray] = []
        self.unknown, self.denominator = 1.0, 1.0
        self.paths: dict[str, str] = {}

    def learn_factors(self, sums: dict[int, list[int]]) -> None:
        """From N, V and the counts of counts of each order."""
        for n in range(1, self.order + 1):
            self.factors.append(discounts(sums[n][2:] if n in sums else [0] * (LIMIT + 1)))
        self.total, self.kinds = sums[1][:2] if 1 in sums else (0, 0)
        known = np.array(sums[1][2 : LIMIT + 2] if 1 in sums else [0] * LIMIT) * np.arange(1, LIMIT + 1)
        freed = float((known * (1 - self.factors[0][1:])).sum())
        self.denominator = float(self.total) if freed > 0 else self.total + 1.0
        self.unknown = (freed if freed > 0 else 1.0) / self.denominator

    def word_counts(self, c: Chunk) -> np.ndarray:
        return c.answers(1, 1, [np.uint32, np.bool_])[0].astype(np.int64)

    def probabilities(self, c: Chunk, order: int) -> np.ndarray:
        """Per token, its probability at an order, by recursion to the lower ones."""
        if order == 1:
            counts = self.word_counts(c)
            return np.where(counts > 0, discounted(counts, self.factors[0]) / self.denominator, self.unknown)[c.token]
        lower = self.probabilities(c, order - 1)
        grams, contexts = c.grams(order)
        _, _, gram = distinct(grams)
        _, _, context = distinct(contexts)
        count = c.answers(1, order, [np.uint32, np.bool_])[0].astype(np.int64)[gram]
        total, freed, below = (x[context] for x in c.answers(order, order, [np.float64] * 3))
        # freed: sum of discounted counts after the context
        tight = total - freed < 1e-9 * np.maximum(total, 1)
        denominator = np.where(tight, total + 1, np.maximum(total, 1))
        left = 1 - freed / denominator
        alpha = left / np.maximum(1 - below, 1e-300)
        return np.where(total == 0, lower, np.where(count > 0, discounted(count, self.factors[order - 1]) / denominator, alpha * lower))


def _send_counts(order: int, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in map(Chunk, _rows_of(batches)):
            for n in range(1, order + 1):
                grams, _ = c.grams(n)
                keys, _, index = distinct(grams)
                yield _messages(n, c.chunk, keys, [np.bincount(index, c.trained, len(keys)).astype(np.uint32)], parts)

    return run


def _send_sums(n: int, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = shared.value
        for c in map(Chunk, _rows_of(batches)):
            lower = m.probabilities(c, n - 1)
            grams, contexts = c.grams(n)
            _, at, _ = distinct(grams)
            counts, mine = c.answers(1, n, [np.uint32, np.bool_])
            heads, _, context = distinct(contexts)
            own = at[mine]
            counts = counts[mine].astype(np.int64)
            columns = [np.bincount(context[own], x, len(heads)) for x in (counts, discounted(counts, m.factors[n - 1]), lower[own])]
            yield _messages(n, c.chunk, heads, columns, m.parts)

    return run


def _dealt(chunks: DataFrame, tasks: int) -> DataFrame:
    """Rows that name chunks, dealt anew: their few bytes say nothing of the work behind them."""
    return chunks.repartition(tasks, "chunk")


def _exchange(chunks: DataFrame, send: Callable, answer: Callable, known: DataFrame | None, parts: int, tasks: int, name: str) -> tuple[DataFrame, DataFrame, str]:
    """One round: messages to the hash ranges, answers to the chunks. Returns the chunks with the answers' places, and the rows of the model with the table they are in. known: rows of a model made before."""
    spark = chunks.sparkSession
    rows = _dealt(chunks, tasks).mapInArrow(send, MESSAGE)
    if known is not None:
        rows = rows.unionByName(known)
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), parts)
    answers = rows.repartition(ranges, "order", "part").groupBy("order", "part").applyInArrow(answer, MESSAGE)
    to_chunks = chunks.unionByName(answers, allowMissingColumns=True).repartition(tasks, "chunk").sortWithinPartitions("chunk", F.col("files").isNull(), "order", "part")
    settled = to_chunks.select("chunk", "tokens", "files", "batches", "order", "part", "data", "sums").mapInArrow(_settle(fresh_path(spark, f"{name}-answers")), SETTLED)
    path = fresh_path(spark, name)
    settled.withColumn("of_model", F.col("chunk") < 0).write.partitionBy("of_model").parquet(path)
    table = spark.read.schema(SETTLED + ", of_model boolean").parquet(path)
    mine, model = table.where("not of_model"), table.where("of_model")
    return mine.select("chunk", "tokens", "files", "batches"), model.select("order", "part", "chunk", "data", "sums"), path


def _model_rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SETTLED + ", of_model boolean").parquet(path).where("of_model").select("order", "part", "chunk", "data", "sums")


def _packed(docs: DataFrame, held_out: Column, chunk_bytes: int, id_col: str, text_col: str) -> tuple[DataFrame, int, int]:
    """The table of chunks, the number of tokens, and the number of tasks for work on chunks."""
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col(id_col).alias("__id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), body(text_col).alias("__text"))
    chunks = stored(rows.mapInArrow(_pack_chunks(fresh_path(spark, "packed"), chunk_bytes), CHUNK), "chunks")
    n, tokens = chunks.agg(F.count(F.lit(1)), F.sum("tokens")).first()
    return chunks, tokens or 0, max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * (n or 0))


def _scores(chunks: DataFrame, model: Model, kind: T.DataType, tasks: int, id_col: str, base_add: float) -> DataFrame:
    shared = chunks.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([T.StructField(id_col, kind), T.StructField("held_out", T.BooleanType()), *(T.StructField(x, T.LongType()) for x in ("n_tokens", "n_known", "train_tokens")), T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType())])

    def evaluate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = shared.value
        for row in _rows_of(batches):
            c = Chunk(row)
            counts = m.word_counts(c)
            base = np.log10((counts + base_add) / (m.total + base_add * (m.kinds + 1)))[c.token]
            score = np.log10(m.probabilities(c, m.order))
            per_doc = lambda x: np.add.reduceat(x, c.first[:-1])  # noqa: E731  every document has its end token
            ids = pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(c.ids)).read_all().column("__id").combine_chunks()
            n = len(ids)
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(~c.train), pa.array(c.sizes), pa.array(per_doc((counts > 0)[c.token].astype(np.int64))), pa.array(np.full(n, m.total)), pa.array(per_doc(base)), pa.array(per_doc(score))],
                schema.names,
            )

    return _dealt(chunks, tasks).mapInArrow(evaluate, schema)


def fit_and_score(docs: DataFrame, held_out: Column, order: int = 2, chunk_bytes: int = 16 << 20, part_tokens: int = 1 << 19, id_col: str = "doc_id", text_col: str = "text", base_add: float = 0.1) -> tuple[DataFrame, Model]:
    """The scores of all rows, and the model learned from those that are not held out."""
    spark = docs.sparkSession
    chunks, tokens, tasks = _packed(docs, held_out, chunk_bytes, id_col, text_col)
    model = Model(order, -(-tokens // part_tokens) or 1)
    chunks, counted, model.paths["counts"] = _exchange(chunks, _send_counts(order, model.parts), _count, None, model.parts, tasks, "counts")
    sums = counted.groupBy("order").agg(*(F.sum(F.get("sums", F.lit(i))).alias(str(i)) for i in range(LIMIT + 3)))
    model.learn_factors({r[0]: [int(x) for x in r[1:]] for r in sums.collect()})
    for n in range(2, order + 1):
        chunks, _, model.paths[f"sums-{n}"] = _exchange(chunks, _send_sums(n, spark.sparkContext.broadcast(model)), _add, None, model.parts, tasks, f"sums-{n}")
    return _scores(chunks, model, docs.schema[id_col].dataType, tasks, id_col, base_add), model


def score_texts(docs: DataFrame, held_out: Column, **options) -> DataFrame:
    """A row per row of docs: id, held_out, n_tokens, n_known, train_tokens, base_score (add-constant unigrams) and score (log10). Learns from rows that are not held out."""
    return fit_and_score(docs, held_out, **options)[0]


def score_with(model: Model, docs: DataFrame, chunk_bytes: int = 16 << 20, id_col: str = "doc_id", text_col: str = "text", base_add: float = 0.1) -> DataFrame:
    """The same for other texts, by a model's tables; all rows are held out."""
    spark = docs.sparkSession
    chunks, _, tasks = _packed(docs, F.lit(True), chunk_bytes, id_col, text_col)
    shared = spark.sparkContext.broadcast(model)
    chunks, _, _ = _exchange(chunks, _send_counts(model.order, model.parts), _count, _model_rows(spark, model.paths["counts"]), model.parts, tasks, "asked-counts")
    for n in range(2, model.order + 1):
        chunks, _, _ = _exchange(chunks, _send_sums(n, shared), _add, _model_rows(spark, model.paths[f"sums-{n}"]), model.parts, tasks, f"asked-sums-{n}")
    return _scores(chunks, model, docs.schema[id_col].dataType, tasks, id_col, base_add)
