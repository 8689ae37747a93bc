"""Command lines as a stream: parsed and judged row by row, and optionally dropped when seen before within a window."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.shipping import ship
from ..operators.clean import PARSED, as_arrow, parse_row, parsed_columns
from ..operators.features import manual_features


def read_stream(spark: SparkSession, folder: str, schema: str = "command_line string, ts timestamp") -> DataFrame:
    """New Parquet files of a folder."""
    return spark.readStream.schema(schema).parquet(folder)


def parsed_stream(stream: DataFrame, command: str = "command_line") -> DataFrame:
    """The stream with tree, tokens, valid, error and nodes. No state: a batch's rows are parsed where they are."""
    ship(stream.sparkSession)

    @F.arrow_udf(PARSED)
    def parse(commands: pa.Array) -> pa.Array:
        return as_arrow([parse_row(c, None) for c in commands.to_pylist()])

    return stream.withColumn("__p", parse(F.col(command))).select(*stream.columns, *parsed_columns(F.col("__p")))


def scored_stream(stream: DataFrame, score: Callable[[DataFrame], DataFrame], command: str = "command_line") -> DataFrame:
    """Hand-made features as columns, then a model's transform."""
    return score(stream.select("*", *(c.alias(k) for k, c in manual_features(F.col(command)).items())))


def first_seen(stream: DataFrame, column: str = "tree", time: str = "ts", within: str = "1 hour") -> DataFrame:
    """Each tree once per stretch of time; state older than the watermark goes."""
    return stream.withWatermark(time, within).dropDuplicatesWithinWatermark([column])


def counts_per_window(stream: DataFrame, time: str = "ts", width: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Valid and other commands per window; rows later than late are not counted."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width)).agg(F.count_if("valid").alias("valid"), F.count_if(~F.col("valid")).alias("invalid"))


def write_stream(stream: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Appends to Parquet, exactly once, until all files that are there now are done."""
    return stream.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
