"""Tables that grow by key: what is missing is made and appended, the rest is read. Bucketed and sorted by the key, so that joins on it need no exchange of what is kept."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

BUCKETS = 64


class KeyedTable:
    """A Parquet table below a folder, named by what its rows were made with.

    The number of buckets is part of its place. A session that does not know the
    table yet declares it over the files there. One writer at a time; a job that
    fails leaves no rows. A key that was given is not made again.
    """

    def __init__(self, spark: SparkSession, folder: str, name: str, schema: str, key: str, buckets: int = BUCKETS):
        self.spark, self.key, self.buckets = spark, key, buckets
        self.schema = T.StructType.fromDDL(schema)
        self.path = f"{folder.rstrip('/')}/{name}_b{buckets}"
        self.table = "kept_" + hashlib.md5(self.path.encode()).hexdigest()
        path = self.path.replace("'", "\\'")
        spark.sql(f"CREATE TABLE IF NOT EXISTS {self.table} ({self.schema.toDDL()}) USING parquet CLUSTERED BY ({key}) SORTED BY ({key}) INTO {buckets} BUCKETS LOCATION '{path}'")

    def read(self) -> DataFrame:
        self.spark.catalog.refreshTable(self.table)
        return self.spark.table(self.table)

    def lacking(self, rows: DataFrame) -> DataFrame:
        """The rows whose key is not kept. Kept keys are read in their buckets."""
        return rows.join(self.read().select(self.key), self.key, "left_anti")

    def grow(self, rows: DataFrame, make: Callable[[DataFrame], DataFrame]) -> int:
        """Makes and appends what rows (one a key) lack; how many were made."""
        missing = self.lacking(rows)
        if missing.isEmpty():
            return 0
        before = self.read().count()
        made = make(missing).select(*self.schema.names).repartition(self.buckets, self.key)  # a file a bucket
        made.write.mode("append").format("parquet").option("path", self.path).bucketBy(self.buckets, self.key).sortBy(self.key).saveAsTable(self.table)
        return self.read().count() - before
