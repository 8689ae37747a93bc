"""Token counts with a digest cache.

A text's content is normalised in ways that the tokenizer does not see (for a
tokenizer that drops white space: its runs become one space), and its SHA-256
with the tokenizer's version digest is the key of a cached count. Keys that the
cache lacks are encoded once each, however many rows share them, and appended;
then every row is joined with the cache. The cache is a Parquet table,
partitioned by version, in a folder that all executors share; two writers may
append the same key, readers take one.

With ``by_words`` (only for tokenizers that never join across ASCII white space)
a worker encodes a distinct word once and adds up; its memory of words is
bounded by ``memo_words``.

Nulls and odd rows: null text is empty and counts 0 tokens. Repeated rows share
a key. An empty table gives an empty result. Extra columns pass through; result
columns replace those of their name. Texts are encoded whole.
"""

from __future__ import annotations

import hashlib
import importlib.metadata
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from .common import SPACE, body, ship, stored

CACHE = "digest binary, n_tokens long"


def version(path: str) -> str:
    """Digest of the tokenizer's file and of the library that reads it."""
    library = "sentencepiece" if path.endswith(".model") else "tokenizers"
    return hashlib.sha256(Path(path).read_bytes() + f"{library} {importlib.metadata.version(library)}".encode()).hexdigest()[:32]


def counter(kind: str, model: bytes) -> Callable[[list[str]], list[int]]:
    """A function from texts to token counts. Special strings inside texts are handled as the library does by default."""
    if kind == ".model":
        import sentencepiece

        pieces = sentencepiece.SentencePieceProcessor(model_proto=model)
        return lambda texts: [len(x) for x in pieces.encode(texts, num_threads=1)]
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(model.decode())
    tokenizer.no_padding()
    tokenizer.no_truncation()
    return lambda texts: [len(x) for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


def _content(text_col: str, by_words: bool):
    text = body(text_col)
    return F.btrim(F.regexp_replace(text, r"[\x20\x09-\x0D]+", " "), F.lit(SPACE)) if by_words else text


def read_cache(spark: SparkSession, path: str, tokenizer_version: str) -> DataFrame:
    """Stored counts, one per digest; none where the cache does not exist yet."""
    try:
        found = spark.read.schema(CACHE + ", version string").parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        found = spark.createDataFrame([], CACHE + ", version string")
    return found.where(F.col("version") == tokenizer_version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def count_tokens(docs: DataFrame, tokenizer_path: str, cache_path: str, by_words: bool = False, keep: list[str] | None = None, text_col: str = "text", memo_words: int = 1 << 18, batch_chars: int = 1 << 20) -> DataFrame:
    """docs (the columns in keep, or all) with n_bytes and n_tokens. Runs the encoding job and appends to the cache before it returns."""
    spark = docs.sparkSession
    ship(spark)
    tokenizer_version = version(tokenizer_path)
    model = spark.sparkContext.broadcast((Path(tokenizer_path).suffix, Path(tokenizer_path).read_bytes()))
    content = _content(text_col, by_words)
    key = F.unhex(F.sha2(content.cast("binary"), 256))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(*model.value)
        memo: dict[str, int] = {"": 0}
        for batch in batches:
            texts = batch.column("content").to_pylist()
            counts: list[int] = []
            if by_words:
                for text in texts:
                    words = text.split(" ")
                    missing = list({w for w in words if w not in memo})
                    memo.update(zip(missing, count(missing)))
                    counts.append(sum(map(memo.__getitem__, words)))
                    if len(memo) > memo_words:
                        memo = {"": 0}
            else:
                some: list[str] = []
                for text in texts:
                    some.append(text)
                    if sum(map(len, some[-64:])) > batch_chars or len(some) >= 256:
                        counts += count(some)
                        some = []
                counts += count(some) if some else []
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(counts, pa.int64())], ["digest", "n_tokens"])

    # repeated contents go before the shuffle, task by task, so that no content is hot; the join with the cache reads the same partitions
    distinct = docs.select(key.alias("digest"), content.alias("content")).dropDuplicates(["digest"])
    missing = distinct.join(read_cache(spark, cache_path, tokenizer_version), "digest", "left_anti")
    missing.select("digest", "content").mapInArrow(encode, CACHE).withColumn("version", F.lit(tokenizer_version)).write.partitionBy("version").mode("append").parquet(cache_path)
    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() not in ("n_bytes", "n_tokens")]
    rows = docs.select(*kept, key.alias("__digest"), F.octet_length(body(text_col)).cast("long").alias("n_bytes"))
    # a table, so that a content of very many rows can be split among tasks
    counts = stored(read_cache(spark, cache_path, tokenizer_version).select(F.col("digest").alias("__d"), F.col("n_tokens").alias("__n")), "token-counts")
    return rows.join(counts, F.col("__digest") == F.col("__d"), "left").select(*kept, "n_bytes", F.col("__n").alias("n_tokens"))
