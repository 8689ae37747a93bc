"""Token ids as length-delimited binary records, with a separate offset index.

A record: the payload's length (8 bytes), a masked checksum of those 8 bytes,
the payload, a masked checksum of the payload; checksums are CRC-32C, rotated
and shifted so that a checksum of data that holds checksums is no weaker. All
numbers are little-endian. A payload: bytes of an id (2 or 4, by the
vocabulary), 1 if there is a key, the key's length, the key (UTF-8, padded to 4
bytes), the ids with the end id behind them. These frames are those of record
files that common training readers take.

Writing: rows are range-partitioned and sorted by id, nulls last; each task
encodes its range once and writes files of at most ``file_bytes`` (or of one
record), named by partition and attempt, so that a repeated task never
overwrites what another returned. The index, a table, has a record's key, file,
place, length and number of ids, and the ids before it in the file; the files
table has the ids before each file. A key or a null that many rows share is
spread over tasks by the texts' hashes and by the rows' places.

Reading: index rows are dealt by file and place, records that lie together are
read in one piece of at most ``piece_bytes``, both checksums are verified, and a
mismatch ends the job. ``read_records`` keeps the files' order within a task;
``shuffled`` deals and orders the index by a seeded hash, so an epoch reads
records in an order of its own without moving token data.

With ``by_words`` (only for tokenizers that never join across ASCII white space)
a worker encodes a word once while it remembers it, from task to task; it keeps
at most ``memo_words``, dropping those it met longest ago. New words are encoded
many at a time, between spaces, and told apart by their tokens' lengths; where
those do not add up to the words' own, each word is encoded alone.

Nulls and odd rows: null text is empty and gives the end id alone. Repeated rows
and ids are records of their own. An empty table gives no file and an empty
index. Extra columns are left out. Texts are encoded whole; the ids of one text
must fit a task's memory. Keys are stored as text and read as the id's type.
"""

from __future__ import annotations

import functools
import hashlib
import struct
from collections.abc import Iterator
from pathlib import Path
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import terms
from .common import body, ship, stored
from .warc import open_fs, read_range

FILE_BYTES, PIECE_BYTES, TASK_BYTES = 256 << 20, 4 << 20, 32 << 20
INDEX = "part int, seq int, file string, offset long, length long, n_tokens long, first long"
HEAD, TAIL = 12, 4
#: The constants of masked CRC-32C in record files: the reflected polynomial and what a mask adds.
POLYNOMIAL, MASK = 0x82F63B78, 0xA282EAD8
UNIT = 64  # bytes that are summed alike for all records


class Corrupt(ValueError):
    """A record whose length or payload does not have its checksum."""


@functools.cache
def _of_two() -> np.ndarray:
    """The checksum register after two bytes, by their 16-bit number."""
    one = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        one = np.where(one & 1, (one >> 1) ^ np.uint32(POLYNOMIAL), one >> 1)
    pair = np.arange(1 << 16, dtype=np.uint32)
    low = one[pair & 0xFF]
    return one[(low ^ (pair >> 8)) & 0xFF] ^ (low >> 8)


@functools.cache
def _zeros(n: int) -> tuple[np.ndarray, np.ndarray]:
    """How n zero bytes (a power of two, 2 at least) change the register: tables for its lower and upper half."""
    half = np.arange(1 << 16, dtype=np.uint32)
    if n == 2:
        return _of_two(), half.copy()
    low, high = _zeros(n // 2)
    return _past(low, n // 2), _past(high, n // 2)


def _past(register: np.ndarray, n: int) -> np.ndarray:
    low, high = _zeros(n)
    return low[register & 0xFFFF] ^ high[register >> 16]


def crc32c(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC-32C of the ranges (4 bytes long at least) of a byte array, all at once: registers of equal blocks, each moved by what follows it, then added."""
    if not len(starts):
        return np.zeros(0, np.uint32)
    n_units = -(-lengths // UNIT)
    ends = np.cumsum(n_units) * UNIT
    padded = np.zeros(int(ends[-1]), np.uint8)  # zeros before a message leave an empty register empty
    for a, n, end in zip(starts.tolist(), lengths.tolist(), ends.tolist()):
        padded[end - n : end] = data[a : a + n]
        padded[end - n : end - n + 4] ^= 0xFF  # the register's first value
    register = _of_two()[padded.view(np.uint16)]
    size = 2
    while size < UNIT:
        register = _past(register[0::2], size) ^ register[1::2]
        size *= 2
    first = np.cumsum(n_units) - n_units
    behind = np.repeat(first + n_units, n_units) - 1 - np.arange(len(register))
    bit = 0
    while (behind >> bit).any():
        moved = np.flatnonzero((behind >> bit) & 1)
        register[moved] = _past(register[moved], UNIT << bit)
        bit += 1
    return np.bitwise_xor.reduceat(register, first) ^ np.uint32(0xFFFFFFFF)


def masked(crc: np.ndarray) -> np.ndarray:
    return ((crc >> np.uint32(15)) | (crc << np.uint32(17))) + np.uint32(MASK)


def frames(keys: list[str | None], ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Records of rows (key; ids from first to the next first), as bytes, and where each begins, with the end."""
    width = ids.itemsize
    named = [k.encode() if k is not None else b"" for k in keys]
    room = np.array([-(-len(k) // 4) * 4 for k in named], np.int64)
    length = 8 + room + np.diff(first) * width
    at = np.r_[0, np.cumsum(length + HEAD + TAIL)]
    out = np.zeros(int(at[-1]), np.uint8)
    body_at = at[:-1] + HEAD
    out[at[:-1, None] + np.arange(8)] = length.astype("<u8").view(np.uint8).reshape(-1, 8)
    raw = ids.view(np.uint8)
    for key, name, pad, a, x, y in zip(keys, named, room.tolist(), body_at.tolist(), (first[:-1] * width).tolist(), (first[1:] * width).tolist()):
        out[a : a + 8 + len(name)] = np.frombuffer(struct.pack("<HHI", width, key is not None, len(name)) + name, np.uint8)
        out[a + 8 + pad : a + 8 + pad + y - x] = raw[x:y]
    for where, starts, lengths in ((at[:-1] + 8, at[:-1], np.full(len(keys), 8)), (body_at + length, body_at, length)):
        out[where[:, None] + np.arange(4)] = masked(crc32c(out, starts, lengths)).astype("<u4").view(np.uint8).reshape(-1, 4)
    return out, at


def parse(data: np.ndarray, at: np.ndarray, where: str = "") -> list[tuple[str | None, np.ndarray]]:
    """(key, ids) of the records that begin at these places, the last of which is the end. Raises Corrupt."""
    number = lambda places, n, kind: data[places[:, None] + np.arange(n)].reshape(-1).view(kind)
    starts, length = at[:-1], np.diff(at) - HEAD - TAIL
    if (length < 8).any() or (number(starts, 8, "<u8") != length).any() or (number(starts + 8, 4, "<u4") != masked(crc32c(data, starts, np.full(len(starts), 8)))).any():
        raise Corrupt(f"a record's length does not fit its checksum or the index: {where}")
    if (number(starts + HEAD + length, 4, "<u4") != masked(crc32c(data, starts + HEAD, length))).any():
        raise Corrupt(f"a record's payload does not fit its checksum: {where}")
    out = []
    for a, n in zip((starts + HEAD).tolist(), length.tolist()):
        width, named, size = struct.unpack("<HHI", data[a : a + 8].tobytes())
        ids = data[a + 8 + -(-size // 4) * 4 : a + n].view("<u2" if width == 2 else "<u4")
        out.append((data[a + 8 : a + 8 + size].tobytes().decode() if named else None, ids))
    return out


class Encoder:
    """Texts to token ids, without begin, end or added special tokens, special strings inside texts as the library handles them by default."""

    def __init__(self, kind: str, model: bytes, by_words: bool, memo_words: int):
        if kind == ".model":
            import sentencepiece

            pieces = sentencepiece.SentencePieceProcessor(model_proto=model)
            self.size, self.ids_of, self.lengths = pieces.get_piece_size(), lambda texts: pieces.encode(texts, num_threads=1), None
        else:
            import os

            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_str(model.decode())
            tokenizer.no_padding()
            tokenizer.no_truncation()
            self.size, self.ids_of = tokenizer.get_vocab_size(), lambda texts: [x.ids for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            self.normalize = tokenizer.normalizer.normalize_str if tokenizer.normalizer else str
            suffix = getattr(tokenizer.model, "end_of_word_suffix", None) or ""
            self.lengths = np.zeros(self.size, np.int64)  # of tokens in bytes, for vocabularies that spell a byte as one character
            for token, i in tokenizer.get_vocab().items():
                self.lengths[i] = len(token.removesuffix(suffix))
        self.by_words, self.memo_words = by_words, memo_words
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self._kind: np.dtype | None = None

    def kind(self, end_id: int) -> np.dtype:
        kind = np.dtype("<u2" if max(self.size - 1, end_id) < 1 << 16 else "<u4")
        if kind != self._kind:  # what it remembers is packed by kind
            self.new, self.old, self._kind = {}, {}, kind
        return kind

    def _apart(self, words: list[str], kind: np.dtype) -> list[bytes]:
        """Packed ids of each word. The tokens' bytes are those of the normalised words, and no token spans two of them."""
        if self.lengths is not None and len(words) > 1:
            text = " ".join(words)
            size = [len(w.encode()) for w in self.normalize(text).split(" ")]
            ids = np.array(self.ids_of([text])[0], np.int64)
            ends, wanted = np.cumsum(self.lengths[ids]), np.cumsum(size)
            cut = np.minimum(np.searchsorted(ends, wanted), len(ends) - 1)
            if len(size) == len(words) and min(size) > 0 and len(ends) and ends[-1] == wanted[-1] and (ends[cut] == wanted).all():
                raw, cut = ids.astype(kind).tobytes(), ((cut + 1) * kind.itemsize).tolist()
                return [raw[a:b] for a, b in zip([0, *cut], cut)]
        return [np.array(x, kind).tobytes() for x in self.ids_of(words)]

    def _learn(self, words: list[str], kind: np.dtype) -> None:
        """Encodes new words, together where normalising cannot make or take white space."""
        plain = [w for w in words if w.isascii() or (is_normalized("NFKC", w) and not w.isspace())]
        if plain and " ".join(plain).split() != plain:
            plain = [w for w in plain if w.split() == [w]]
        for lo in range(0, len(plain), 256):
            group = plain[lo : lo + 256]
            self.new.update(zip(group, self._apart(group, kind)))
        for word in words:
            if word not in self.new:
                self.new[word] = np.array(self.ids_of([word])[0], kind).tobytes()

    def _packed(self, words: list[str], kind: np.dtype) -> list[bytes]:
        found = list(map(self.new.get, words))
        at = [i for i, x in enumerate(found) if x is None]
        missing = [words[i] for i in at]
        older = list(map(self.old.get, missing))
        self.new.update((w, x) for w, x in zip(missing, older) if x is not None)
        self._learn([w for w, x in zip(missing, older) if x is None], kind)
        for i, word in zip(at, missing):
            found[i] = self.new[word]
        if len(self.new) > self.memo_words // 2:
            self.old, self.new = self.new, {}
        return found

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids, the end id behind each text's, and where each text's begin, with the end."""
        kind = self.kind(end_id)
        if not self.by_words:
            rows = self.ids_of(texts.to_pylist())
            first = np.cumsum([0, *(len(x) + 1 for x in rows)])
            return np.array([i for x in rows for i in (*x, end_id)], kind), first
        code, first, known = terms.coded(texts)
        found = [*self._packed(known.to_pylist(), kind), np.array([end_id], kind).tobytes()]
        pool = np.frombuffer(b"".join(found), kind)
        size = np.fromiter(map(len, found), np.int64, len(found)) // kind.itemsize
        begin = np.cumsum(size) - size
        code = np.insert(code, first[1:], len(known))
        many = size[code]
        total = np.r_[0, np.cumsum(many)]
        ids = pool[np.repeat(begin[code] - total[:-1], many) + np.arange(total[-1])]
        return ids, total[first + np.arange(len(first))]


_kept: dict[tuple, Encoder] = {}


def encoder(kind: str, model: bytes, by_words: bool, memo_words: int) -> Encoder:
    """A worker's one encoder, with what it remembers."""
    key = (kind, hashlib.sha256(model).digest(), by_words, memo_words)
    if key not in _kept:
        _kept.clear()
        _kept[key] = Encoder(kind, model, by_words, memo_words)
    return _kept[key]


class _Files:
    """The files that one task attempt writes."""

    def __init__(self, folder: str, file_bytes: int):
        context = TaskContext.get()
        self.part, self.attempt, self.folder, self.file_bytes = context.partitionId(), context.taskAttemptId(), folder, file_bytes
        self.seq, self.out, self.offset, self.first = -1, None, 0, 0

    def add(self, data: np.ndarray, at: np.ndarray, n_ids: np.ndarray) -> list[tuple]:
        """Writes records, a new file wherever one is full; returns their index rows."""
        rows, lo = [], 0
        while lo < len(n_ids):
            if self.out is None or self.offset >= self.file_bytes:
                self.close()
                self.seq, self.offset, self.first = self.seq + 1, 0, 0
                self.path = f"{self.folder}/ids-{self.part:05d}-{self.seq:04d}-{self.attempt}.rec"
                system, local = open_fs(self.path)
                system.create_dir(local.rpartition("/")[0], recursive=True)
                self.out = system.open_output_stream(local, compression=None)
            hi = max(lo + 1, int(np.searchsorted(at, at[lo] + self.file_bytes - self.offset, "right")) - 1)
            hi = min(hi, len(n_ids))
            self.out.write(memoryview(data[at[lo] : at[hi]]))
            for i in range(lo, hi):
                rows.append((self.part, self.seq, self.path, self.offset + int(at[i] - at[lo]), int(at[i + 1] - at[i]), int(n_ids[i]), self.first))
                self.first += int(n_ids[i])
            self.offset += int(at[hi] - at[lo])
            lo = hi
        return rows

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.out = None


def write_records(docs: DataFrame, tokenizer_path: str, folder: str, end_id: int, by_words: bool = False, file_bytes: int = FILE_BYTES, memo_words: int = 1 << 19, block_bytes: int = 4 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes record files of all texts in ascending order of their ids; returns the stored index: id and place of each record."""
    spark = docs.sparkSession
    ship(spark)
    model = spark.sparkContext.broadcast((Path(tokenizer_path).suffix, Path(tokenizer_path).read_bytes()))
    # the hash and the row's place keep a repeated id from being one task's
    order = [F.col("id").asc_nulls_last(), F.xxhash64("text"), F.col("place")]
    rows = docs.select(F.col(id_col).alias("id"), body(text_col).alias("text"), F.monotonically_increasing_id().alias("place"))
    schema = f"id {docs.schema[id_col].dataType.simpleString()}, {INDEX}"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library, files = encoder(*model.value, by_words, memo_words), _Files(folder, file_bytes)
        for batch in batches:
            texts, keys = terms.plain(batch.column("text")), batch.column("id").cast(pa.string()).to_pylist()
            places: list[tuple] = []
            for lo, hi in terms.slices(texts, block_bytes):
                ids, first = library.encode(texts.slice(lo, hi - lo), end_id)
                places += files.add(*frames(keys[lo:hi], ids, first), np.diff(first))
            kinds = (pa.int32(), pa.int32(), pa.string(), *[pa.int64()] * 4)
            columns = list(zip(*places)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(c, k) for c, k in zip(columns, kinds))], ["id", *(x.split()[0] for x in INDEX.split(", "))])
        files.close()

    path = f"{folder}/index"
    rows.repartitionByRange(*order).sortWithinPartitions(*order).select("id", "text").mapInArrow(write, schema).write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def with_starts(index: DataFrame) -> DataFrame:
    """The index with start: the ids of all records before each one. A row per file meets in one task."""
    files = index.groupBy("part", "seq", "file").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    files = stored(files.select(F.col("file").alias("__file"), F.coalesce(F.sum("n").over(before), F.lit(0)).cast("long").alias("__base")), "record-files")
    return index.join(files, F.col("file") == F.col("__file")).withColumn("start", F.col("__base") + F.col("first")).drop("__file", "__base")


def _pieces(rows: list[tuple[str, int, int]], piece_bytes: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows (file, offset, length) that lie together in a file, of at most so many bytes or one record."""
    lo = 0
    for i in range(1, len(rows) + 1):
        if i == len(rows) or rows[i][0] != rows[lo][0] or rows[i][1] != rows[i - 1][1] + rows[i - 1][2] or rows[i][1] + rows[i][2] - rows[lo][1] > piece_bytes:
            yield lo, i
            lo = i


def _read(index: DataFrame, piece_bytes: int, arrays: bool) -> DataFrame:
    """A row per index row, in its order: the record's key, the index's columns, and ids as little-endian 32-bit numbers or as an array."""
    kind = index.schema["id"].dataType
    names = [c for c in index.columns if c != "id"]
    schema = ", ".join(["key string", *(f"{c} {index.schema[c].dataType.simpleString()}" for c in names), "ids array<bigint>" if arrays else "ids binary"])
    packed = (lambda x: pa.array(x.astype(np.int64))) if arrays else (lambda x: x.astype("<u4").tobytes())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: dict = {}
        for batch in batches:
            rows = list(zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length"))))
            for lo, hi in _pieces(rows, piece_bytes):
                path, begin, _ = rows[lo]
                at = np.array([rows[lo][1], *(r[1] + r[2] for r in rows[lo:hi])], np.int64) - begin
                data = np.frombuffer(read_range(path, begin, int(at[-1]), opened), np.uint8)
                if len(data) != at[-1]:
                    raise Corrupt(f"{path} ends before {begin + at[-1]}")
                found = parse(data, at, f"{path} from {begin}")
                if [len(x) for _, x in found] != batch.column("n_tokens").slice(lo, hi - lo).to_pylist():
                    raise Corrupt(f"{path} from {begin}: other numbers of ids than in the index")
                own = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.string()), *(own.column(c) for c in names), pa.array([packed(x) for _, x in found], pa.list_(pa.int64()) if arrays else pa.binary())], ["key", *names, "ids"])
        for f in opened.values():
            f.close()

    return index.mapInArrow(read, schema).select(F.col("key").cast(kind).alias("id"), *names, "ids")


def read_records(index: DataFrame, piece_bytes: int = PIECE_BYTES, task_bytes: int = TASK_BYTES, arrays: bool = False) -> DataFrame:
    """Records of the index, dealt by file and place to as many tasks as their bytes ask for, in the files' order within each."""
    total = index.agg(F.sum("length")).first()[0] or 0
    dealt = index.repartition(max(1, -(-total // task_bytes)), "file", F.floor(F.col("offset") / task_bytes))
    return _read(dealt.sortWithinPartitions("file", "offset"), piece_bytes, arrays)


def shuffled(index: DataFrame, seed: int, task_bytes: int = TASK_BYTES, arrays: bool = False) -> DataFrame:
    """Records of the index in the order of a seeded hash of their places, over all tasks: an epoch's order."""
    total = index.agg(F.sum("length")).first()[0] or 0
    order = [F.xxhash64(F.lit(seed), F.col("part"), F.col("seq"), F.col("offset")), F.col("file"), F.col("offset")]
    return _read(index.repartitionByRange(max(1, -(-total // task_bytes)), *order).sortWithinPartitions(*order), 1, arrays)
