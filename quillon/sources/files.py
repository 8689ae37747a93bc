"""Scans, sinks and caches: CSV tables, run directories, keyed Parquet caches, text reports."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import csv_splits

CSV = {"header": "true", **csv_splits.QUOTING}
# What a widespread CSV reader takes as missing.
MISSING = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")
RULES_VERSION = "1"


def read_csv(spark: SparkSession, *paths: str, schema: T.StructType | str | None = None, whole_files: bool = False) -> DataFrame:
    """Rows of CSV files, large ones read by many tasks; whole_files takes a file in one, by Spark's own reader."""
    if not whole_files:
        return csv_splits.read(spark, *paths, schema=schema)
    reader = spark.read.options(**CSV)
    return (reader.schema(schema) if schema else reader).csv(list(paths))


def read_commands(spark: SparkSession, *paths: str, whole_files: bool = False) -> DataFrame:
    """Raw command tables: command_line, and process_name and total_occurrences where the files have them (null where it is no number)."""
    df = read_csv(spark, *paths, whole_files=whole_files)
    if "command_line" not in df.columns:
        raise ValueError("column command_line is missing")
    df = df.select(*(F.when(~F.trim(F.col(c)).isin(*MISSING), F.col(c)).alias(c) for c in df.columns))
    return df.withColumn("total_occurrences", F.col("total_occurrences").try_cast("long")) if "total_occurrences" in df.columns else df


def read_with_path(spark: SparkSession, *patterns: str, name: str = "summary_path") -> DataFrame:
    """CSV files by comma-separated lists of globs, searched recursively, with the file each row is from. Columns may differ between files."""
    paths = sorted({p.strip() for x in patterns for p in x.split(",") if p.strip()})
    out: DataFrame | None = None
    for p in paths:
        df = spark.read.options(**CSV).option("inferSchema", "true").option("recursiveFileLookup", "true").csv(p).select("*", F.col("_metadata.file_path").alias(name))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    if out is None:
        raise ValueError("no path is given")
    return out


def find_models(spark: SparkSession, root: str) -> DataFrame:
    """Paths of saved models below root; file contents are not read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*_model.pt").option("recursiveFileLookup", "true").load(root).select("path")


def write_csv(df: DataFrame, path: str, single: bool = False) -> None:
    (df.coalesce(1) if single else df).write.mode("overwrite").options(header="true", quote='"', escape='"').csv(path)


def write_text(lines: DataFrame, path: str, single: bool = True) -> None:
    """One string column as a text report, in one file or in files whose order is the lines'."""
    (lines.coalesce(1) if single else lines).write.mode("overwrite").text(path)


def key_of(*parts: str) -> str:
    """Eight hex digits that name a cache entry; the rules' version is part of it."""
    return hashlib.md5("_".join([*parts, RULES_VERSION]).encode()).hexdigest()[:8]


def _there(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def cached(spark: SparkSession, folder: str, name: str, make: Callable[[], DataFrame], force: bool = False) -> DataFrame:
    """The table stored under a name, made and written first if it is not there or force is set. A table counts when it was written whole."""
    path = f"{folder.rstrip('/')}/{name}"
    if force or not _there(spark, f"{path}/_SUCCESS"):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def split_name(seed: int, test_size: float, *paths: str) -> str:
    return f"seed{seed}_split{test_size}_{key_of(*paths)}"


def graphs_name(config: str, path: str, embedder: str | None = None) -> str:
    return f"graphs_{config}_{embedder + '_' if embedder else ''}{key_of(path)}"
