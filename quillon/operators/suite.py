"""Experiments: every combination of seeds and models on one labelled table, their summary, and latency by stage."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import features, learn, metrics, split

#: A fitted model as a function from rows with its text column to rows with label and pred.
Predictor = Callable[[DataFrame], DataFrame]


def manual_model(train: DataFrame, text: str) -> Predictor:
    """Scaled hand-made features and logistic regression."""
    f = features.manual_features(F.col(text))
    wide = lambda df: df.select("label", *(c.alias(k) for k, c in f.items()))
    rows = wide(train)
    model = learn.logistic(learn.scale(rows, [], list(f))[0], list(f))
    return lambda df: model.transform(learn.scale(rows, [wide(df)], list(f))[1]).select("label", F.col("prediction").cast("int").alias("pred"))


def tfidf_model(analyzer: str) -> Callable[[DataFrame, str], Predictor]:
    def fit(train: DataFrame, text: str) -> Predictor:
        model, terms = learn.tfidf_logistic(train, text, analyzer=analyzer)
        return lambda df: model.transform(df.withColumn("terms", terms)).select("label", F.col("prediction").cast("int").alias("pred"))

    return fit


MODELS: dict[str, Callable[[DataFrame, str], Predictor]] = {"manual": manual_model, "tfidf_word": tfidf_model("word"), "tfidf_char": tfidf_model("char"), "tfidf_char_wb": tfidf_model("char_wb")}


def run(df: DataFrame, key: str, text: str, models: Iterable[str], seeds: Iterable[int], test_size: float = 0.3, held_out: DataFrame | None = None) -> DataFrame:
    """A row per seed and model: metrics on the test part, and with the prefix test_ on a held-out table."""
    spark = df.sparkSession
    out: DataFrame | None = None
    for seed, name in itertools.product(dict.fromkeys(seeds), dict.fromkeys(models)):
        rows = split.stratified_split(df, key, seed, test_size)
        predict = MODELS[name](rows.where("not is_test"), text)
        m = metrics.metrics(predict(rows.where("is_test")))
        if held_out is not None:
            later = metrics.metrics(predict(held_out))
            m = m.crossJoin(later.select(*(F.col(c).alias(f"test_{c}") for c in later.columns)))  # one row by one row
        m = spark.createDataFrame(m.select(F.lit(seed).alias("seed"), F.lit(name).alias("model"), "*").collect())
        out = m if out is None else out.unionByName(m, allowMissingColumns=True)
    return out


def latency(times: DataFrame) -> DataFrame:
    """Of serving.timings: per stage the seconds in all, and milliseconds per command and per batch: mean, population deviation and, for batches, quantiles."""
    n = F.col("commands")
    rows = times.where(n > 0).withColumn("combined_s", F.col("preprocess_s") + F.col("model_s"))
    share = F.col("model_s") / n
    each = rows.select(F.explode("command_s").alias("s"), share.alias("m"))
    stage = lambda name, s: F.struct(F.lit(name).alias("stage"), s.alias("s"))
    batches = rows.select("commands", F.inline(F.array(stage("preprocess", F.col("preprocess_s")), stage("model", F.col("model_s")), stage("combined", F.col("combined_s")))))
    commands = each.select(F.inline(F.array(stage("preprocess", F.col("s")), stage("model", F.col("m")), stage("combined", F.col("s") + F.col("m")))))
    of_batch = batches.groupBy("stage").agg(
        F.count("*").alias("batches"), F.sum("commands").alias("commands"), F.sum("s").alias("total_s"), (F.avg("s") * 1000).alias("batch_ms_mean"), (F.stddev_pop("s") * 1000).alias("batch_ms_std"),
        *((F.percentile_approx("s", q, 10_000) * 1000).alias(f"batch_ms_p{round(q * 100)}") for q in (0.5, 0.95, 0.99)),
    )
    of_command = commands.groupBy("stage").agg((F.avg("s") * 1000).alias("row_ms_mean"), (F.stddev_pop("s") * 1000).alias("row_ms_std"))
    return of_batch.join(of_command, "stage")
