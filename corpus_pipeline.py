"""From raw documents to a training mix: five stages, each a table of its own.

Every stage works on all rows that its predecessor kept. All but the last return
the columns of documents. Stages are plain functions (spark, docs, sf_dir) ->
DataFrame; run() writes each stage's rows and reads them again for the next, so
a lost executor costs a stage's tasks at most.

Nulls and odd rows: a document without a word (null, empty, white space) goes at
the first stage; short ones are judged by their lines alone. Null ids, sources
and languages stay as they are, and null sources are one source. Of equal or near
documents one row stays, the first by id (a null id last), then by source,
language and text, whether ids repeat, are null or not. Extra columns, of whatever names,
are left out. Empty tables give empty stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from quillon.llm import decontaminate, line_dedup, mixing, neardup, quality
from quillon.llm.common import stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: No SQL: near-duplicate groups are components over all pairs of texts. tests/llm holds run() against a brute-force version.
ORACLE_SQL = None


def _documents(rows: DataFrame) -> DataFrame:
    """The columns of documents, with n_chars of the text as it is now."""
    return rows.withColumn("n_chars", F.length(F.coalesce("text", F.lit(""))).cast("long")).select(*COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines go; documents that the rules reject go. A short document is no reason to reject it; one without a word is."""
    return _documents(quality.accepted(docs, min_words=1))


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that ten or more documents share go from all of them."""
    return _documents(line_dedup.dedup_lines(docs, min_docs=10, min_chars=1))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similarity 0.8 and more stays, that of the least id; of rows of one group that share that id, or have none, one. Documents without words are no group; equal ones stay once an id."""
    found = neardup.near_duplicates(docs, percent=80, keep=COLUMNS).where("kept")
    alone = F.when(F.col("group_id").isNull(), F.struct("doc_id", F.xxhash64("text")))
    first = Window.partitionBy("group_id", "__alone").orderBy("source", "lang", F.xxhash64("text"))
    return found.withColumn("__alone", alone).withColumn("__rank", F.row_number().over(first)).where("__rank = 1").select(*COLUMNS)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    out = decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.where(~F.col("contaminated")).select(*COLUMNS)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document as often as its source's target asks, with the size that counts."""
    return mixing.expand(mixing.mix_sources(docs)).select(*COLUMNS, "size", "copies")


STAGES = [("quality rules", quality_rules), ("line dedup", repeated_lines), ("near duplicates", near_duplicates), ("decontamination", benchmark_passages), ("source mix", source_mix)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
