"""Labelling, union, class weights and the stratified split."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def labelled(malware: DataFrame, clean: DataFrame, column: str = "command_line") -> DataFrame:
    """Both tables' commands with label 1 and 0."""
    return malware.select(column, F.lit(1).alias("label")).unionByName(clean.select(column, F.lit(0).alias("label")))


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """label, n and n_total / (2 n). Two rows meet in the window."""
    counts = df.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("weight", F.sum("n").over(Window.partitionBy(F.lit(1))) / (2 * F.col("n")))


def stratified_split(df: DataFrame, key: str, seed: int, test_size: float = 0.3, label: str = "label", buckets: int = 4096) -> DataFrame:
    """df with is_test: of each label, the share test_size that comes first by the hash of seed and key.

    Exact ranks without a task that holds a label: counts per label and hash
    bucket give each bucket's first rank, rows are ranked inside buckets.
    """
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")))
    rows = df.withColumns({"__md5": digest, "__bucket": F.conv(F.substring(digest, 1, 3), 16, 10).cast("int")})
    counts = rows.groupBy(F.col(label).alias("__label"), F.col("__bucket").alias("__b")).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("__label").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("__label")
    counts = counts.withColumns({"__before": F.coalesce(F.sum("__n").over(before), F.lit(0)), "__total": F.sum("__n").over(whole)})
    rows = rows.join(counts, (F.col(label) == F.col("__label")) & (F.col("__bucket") == F.col("__b")))
    rank = F.col("__before") + F.row_number().over(Window.partitionBy("__label", "__bucket").orderBy("__md5", key))
    rows = rows.withColumn("is_test", rank <= F.round(F.lit(test_size) * F.col("__total")))
    return rows.drop("__md5", "__bucket", "__label", "__b", "__n", "__before", "__total")
