"""WARC archives with revisit records and a two-level capture index.

Writing: equal payloads of at least ``min_bytes`` are kept once, in the record
of the largest page id; the others become revisit records that refer to it. Each
task writes one archive of gzip members, under a name of its own attempt, so a
repeated task never overwrites what another returned; rows of the entry table
name the archives that count.

Index: a capture's key is its URL with the host reversed, then its page id.
Entries are sorted by key over all tasks and cut into gzip blocks of
``block_lines`` lines; the directory has a row per block: its first key, place
and length. Its top has the first key of each index file, a row per
``file_blocks`` blocks. A lookup bisects the top, which alone is sent to every task, for the
file; meets that file's directory rows by a shuffle and bisects them for the
block; reads one block; and then reads the record's bytes alone, in order of
their places, by as many tasks as the bytes ask for.

Files go through pyarrow.fs, by URI, to the folder that executors share.

Nulls and odd rows: null html is an empty payload, null url an empty key. Rows
of a null page id are written but never stand for others. Rows that share the
largest page id and payload are all responses. Empty tables give empty archives
and indexes. Extra columns are left out. Payloads are stored whole.
"""

from __future__ import annotations

import hashlib
import io
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import body, fresh_path, ship, stored

MIN_BYTES, BLOCK_LINES, FILE_BLOCKS = 1000, 1000, 1000
DATE = "2025-01-01T00:00:00Z"
ENTRY = "surt string, page_id long, record_type string, refers_to long, path string, offset long, length long"
DIRECTORY = "first_surt string, first_id long, path string, offset long, length long, n_lines long"
TASK_BYTES = 32 << 20  # of records, compressed, for one task to read
READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def surt(url: Column) -> Column:
    """host labels reversed, port, then path and query: com,example,www)/a?b."""
    url = F.coalesce(url, F.lit(""))
    rest = F.regexp_replace(F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://", ""), r"#.*$", "")
    host = F.lower(F.regexp_extract(rest, r"^([^/?]*)", 1))
    name = F.regexp_extract(host, r"^([^:]*)", 1)
    port = F.regexp_extract(host, r"(:[0-9]+)$", 1)
    path = F.substr(rest, F.length(host) + F.lit(1))
    return F.concat(F.array_join(F.reverse(F.split(name, r"\.")), ","), port, F.lit(")"), F.when(path == "", "/").otherwise(path))


def open_fs(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri.removeprefix("file:"))


def record(page_id: int | None, url: str, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One gzip member: a response with its payload, or a revisit with the HTTP head alone."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {url}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response"]
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines.append(f"Content-Length: {len(block)}")
    packer = zlib.compressobj(6, wbits=31)
    return packer.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and payload (empty for a revisit) of one gzip member."""
    raw = zlib.decompress(member, wbits=31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    fields["payload_length"] = next(x.split(b": ")[1] for x in http.split(b"\r\n") if x.startswith(b"Content-Length: ")).decode()
    return fields, payload


def write_archives(pages: DataFrame, folder: str, min_bytes: int = MIN_BYTES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes archives for pages (page_id, url, html); returns the stored entry table: key, record type and place of each record."""
    spark = pages.sparkSession
    ship(spark)
    payload = F.encode(body(html_col), "UTF-8")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), surt(F.col(url_col)).alias("surt"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    # who refers to whom is found on ids and digests; payloads are dealt by id, so a page that half the web repeats is no hot key
    ids = rows.select("page_id", "digest", F.octet_length("payload").alias("n"))
    held = ids.where((F.col("n") >= min_bytes) & F.col("page_id").isNotNull()).groupBy("digest").agg(F.max("page_id").alias("keeper"))
    held = stored(held, "keepers")
    refers = ids.where(F.col("n") >= min_bytes).join(held, "digest").where(~F.col("page_id").eqNullSafe(F.col("keeper")))
    refers = stored(refers.select(F.col("page_id").alias("__id"), F.col("digest").alias("__digest"), F.col("keeper").alias("refers_to")).distinct(), "revisits")
    rows = rows.join(refers, F.col("page_id").eqNullSafe(F.col("__id")) & (F.col("digest") == F.col("__digest")), "left").select("page_id", "url", "surt", "payload", "digest", "refers_to")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        path = f"{folder}/archive-{context.partitionId():05d}-{context.taskAttemptId()}.warc.gz"
        system, local = open_fs(path)
        out, offset = None, 0
        for batch in batches:
            places = []
            for page_id, url, data, digest, refers_to in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "refers_to"))):
                if out is None:
                    system.create_dir(local.rpartition("/")[0], recursive=True)
                    out = system.open_output_stream(local, compression=None)
                member = record(page_id, url.replace("\r", "%0D").replace("\n", "%0A"), data, digest, refers_to)
                out.write(member)
                places.append((offset, len(member)))
                offset += len(member)
            n = len(places)
            kinds = ["response" if x is None else "revisit" for x in batch.column("refers_to").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("surt"), batch.column("page_id"), pa.array(kinds, pa.string()), batch.column("refers_to"), pa.array([path] * n, pa.string()), pa.array([x for x, _ in places], pa.int64()), pa.array([x for _, x in places], pa.int64())],
                [x.split()[0] for x in ENTRY.split(", ")],
            )
        if out is not None:
            out.close()

    table = f"{folder}/entries"
    rows.mapInArrow(write, ENTRY).write.parquet(table)
    return spark.read.schema(ENTRY).parquet(table)


def build_index(entries: DataFrame, folder: str, block_lines: int = BLOCK_LINES, file_blocks: int = FILE_BLOCKS) -> DataFrame:
    """Writes sorted entries as compressed blocks, some file_blocks to a file; returns the stored directory, a row per block."""
    spark = entries.sparkSession
    ship(spark)
    order = [F.col("surt"), F.col("page_id").asc_nulls_first(), F.col("path"), F.col("offset")]
    ranged = entries.repartitionByRange(-(-entries.count() // (block_lines * file_blocks)) or 1, *order).sortWithinPartitions(*order)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        path = f"{folder}/index-{context.partitionId():05d}-{context.taskAttemptId()}.cdx.gz"
        system, local = open_fs(path)
        out, offset, rows = None, 0, []

        def flush(lines: list[dict]) -> dict:
            nonlocal out, offset
            if out is None:
                system.create_dir(local.rpartition("/")[0], recursive=True)
                out = system.open_output_stream(local, compression=None)
            packer = zlib.compressobj(6, wbits=31)
            sink = io.BytesIO()
            with pa.ipc.new_stream(sink, lines[0].schema) as stream:
                for part in lines:
                    stream.write_batch(part)
            data = packer.compress(sink.getvalue()) + packer.flush()
            out.write(data)
            row = {"first_surt": lines[0].column("surt")[0].as_py(), "first_id": lines[0].column("page_id")[0].as_py(), "path": path, "offset": offset, "length": len(data), "n_lines": sum(len(x) for x in lines)}
            offset += len(data)
            return row

        waiting: list[pa.RecordBatch] = []
        for batch in batches:
            while len(batch):
                room = block_lines - sum(len(x) for x in waiting)
                waiting.append(batch.slice(0, room))
                batch = batch.slice(room)
                if sum(len(x) for x in waiting) == block_lines:
                    rows.append(flush(waiting))
                    waiting = []
        if waiting:
            rows.append(flush(waiting))
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("first_surt", pa.string()), ("first_id", pa.int64()), ("path", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("n_lines", pa.int64())]))

    table = f"{folder}/directory"
    ranged.mapInArrow(write, DIRECTORY).write.parquet(table)
    return spark.read.schema(DIRECTORY).parquet(table)


def read_range(path: str, offset: int, length: int, opened: dict | None = None) -> bytes:
    """length bytes of a file; opened keeps the last file open between calls."""
    opened = {} if opened is None else opened
    if path not in opened:
        for f in opened.values():
            f.close()
        opened.clear()
        system, local = open_fs(path)
        opened[path] = system.open_input_file(local)
    f = opened[path]
    f.seek(offset)
    return f.read(length)


def _key(surt_: str, page_id: int | None) -> tuple[bytes, bool, int]:
    return (surt_ or "").encode(), page_id is not None, page_id or 0


def find_captures(queries: DataFrame, directory: DataFrame) -> DataFrame:
    """Index entries for queries (surt, page_id), found by bisection of the two levels and one read per block in use."""
    spark = queries.sparkSession
    ship(spark)
    blocks = directory.where("n_lines > 0")
    top = blocks.groupBy("path").agg(F.min(F.struct("first_surt", "first_id")).alias("first")).select("path", "first.*").collect()  # a row per task of build_index
    top = sorted((_key(r.first_surt, r.first_id), r.path) for r in top)
    shared = spark.sparkContext.broadcast(([k for k, _ in top], [p for _, p in top]))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, paths = shared.value
        for batch in batches:
            out = [(s, p, paths[x]) for s, p in zip(batch.column("surt").to_pylist(), batch.column("page_id").to_pylist()) for x in _holders(keys, _key(s, p))]
            s, p, files = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(s, pa.string()), pa.array(p, pa.int64()), pa.array(files, pa.string())], ["surt", "page_id", "path"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: dict = {}
        path, keys, places, last, entries = None, [], [], None, {}
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["path"] != path:
                    path, keys, places, last = row["path"], [], [], None
                key = _key(row["surt"], row["page_id"])
                if row["length"] is not None:
                    keys.append(key)
                    places.append((path, row["offset"], row["length"]))
                    continue
                for x in _holders(keys, key):
                    if x != last:
                        last, entries = x, {}
                        for e in _block(read_range(*places[x], opened)):
                            entries.setdefault((e["surt"], e["page_id"]), []).append(e)
                    out += entries.get((row["surt"], row["page_id"]), [])
            yield pa.RecordBatch.from_pylist(out, _entry_schema())

    placed = queries.select("surt", "page_id").distinct().mapInArrow(place, "surt string, page_id long, path string")
    level = blocks.select(F.col("first_surt").alias("surt"), F.col("first_id").alias("page_id"), "path", "offset", "length")
    both = level.unionByName(placed, allowMissingColumns=True)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), len(top))
    both = both.repartition(tasks, "path").sortWithinPartitions("path", F.col("length").isNull(), "surt", F.col("page_id").asc_nulls_first(), "offset")
    return both.mapInArrow(read, ENTRY)


def _holders(firsts: list, key: tuple) -> range:
    """Which of some sorted stretches, given by their first keys, can hold a key: equal keys may begin in the one before the first that starts with them."""
    return range(max(0, bisect_left(firsts, key) - 1), bisect_right(firsts, key))


def _entry_schema() -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64()}
    return pa.schema([(n, kinds[t]) for n, t in (x.split() for x in ENTRY.split(", "))])


def _block(data: bytes) -> list[dict]:
    with pa.ipc.open_stream(zlib.decompress(data, wbits=31)) as stream:
        return stream.read_all().to_pylist()


def read_records(entries: DataFrame) -> DataFrame:
    """Reads each entry's record by its byte range. A response's length and digest are taken anew from its payload; a revisit's from its own headers."""
    ship(entries.sparkSession)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: dict = {}
        for batch in batches:
            out = []
            for path, offset, length in zip(*(batch.column(c).to_pylist() for c in ("path", "offset", "length"))):
                fields, payload = parse(read_range(path, offset, length, opened))
                page_id = fields["WARC-Record-ID"][10:-1]
                revisit = fields["WARC-Type"] == "revisit"
                out.append(
                    {
                        "page_id": int(page_id) if page_id else None,
                        "payload_bytes": int(fields["payload_length"]) if revisit else len(payload),
                        "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha1:") if revisit else hashlib.sha1(payload).hexdigest(),
                        "record_type": fields["WARC-Type"],
                        "refers_to": int(fields["WARC-Refers-To"][10:-1]) if revisit else None,
                    }
                )
            yield pa.RecordBatch.from_pylist(out, pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]))

    # few bytes name many: the number of tasks comes from the records' lengths, and each reads its stretch of the archives in order
    places = stored(entries.select("path", "offset", "length"), "places")
    total = places.agg(F.sum("length")).first()[0] or 0
    tasks = max(entries.sparkSession.sparkContext.defaultParallelism, -(-total // TASK_BYTES))
    return places.repartitionByRange(tasks, "path", "offset").sortWithinPartitions("path", "offset").mapInArrow(read, READ)


def archive(pages: DataFrame, folder: str | None = None, min_bytes: int = MIN_BYTES, block_lines: int = BLOCK_LINES, file_blocks: int = FILE_BLOCKS) -> tuple[DataFrame, DataFrame]:
    """Writes archives and index under folder; returns (entries, directory)."""
    folder = folder or fresh_path(pages.sparkSession, "warc")
    entries = write_archives(pages, folder, min_bytes)
    return entries, build_index(entries, folder, block_lines, file_blocks)


def lookup(spark: SparkSession, directory: DataFrame, urls: list[tuple[str, int]]) -> DataFrame:
    """The records of some (url, page id) captures."""
    asked = spark.createDataFrame(urls, "url string, page_id long").select(surt(F.col("url")).alias("surt"), "page_id")
    return read_records(find_captures(asked, directory))
