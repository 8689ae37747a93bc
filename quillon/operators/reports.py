"""Reports as lines of text, a row each: confusion with scores, and the listing of what was judged wrong."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import metrics, runs

RULE = "-" * 50


def _lines(df: DataFrame, lines: list[Column]) -> DataFrame:
    """One row's lines, in order."""
    return df.select(F.posexplode(F.array(*lines)).alias("n", "line")).orderBy("n").select("line")


def confusion(judged: DataFrame, title: str, label: str = "label", pred: str = "pred") -> DataFrame:
    """Counts of (label, pred) as a square, then the scores."""
    text = lambda form, *xs: F.format_string(form, *xs)
    c = F.col
    head = [F.lit(title), F.lit(RULE), F.lit(f"{'':20}{'said clean':>12}{'said malware':>14}")]
    square = [text("%-20s%12d%14d", F.lit("is clean"), c("tn"), c("fp")), text("%-20s%12d%14d", F.lit("is malware"), c("fn"), c("tp")), F.lit(RULE)]
    scores = [F.concat(F.rpad(F.lit(k), 20, " "), runs.cell(c(k))) for k in ("accuracy", "f1_macro", "f1_weighted", "f1_malware", "precision_malware", "recall_malware", "fpr")]
    return _lines(metrics.metrics(judged, None, label, pred), head + square + scores)


def wrong(judged: DataFrame, key: str, text: str, label: str = "label", pred: str = "pred") -> DataFrame:
    """False positives and then false negatives by rank, under a head with their number. Lines lie in order over as many tasks as Spark makes of them; line breaks inside a text are written as \\n."""
    kinds = judged.agg(*(F.count_if((F.col(label) == y) & (F.col(pred) == 1 - y)).alias(k) for k, y in (("FP", 0), ("FN", 1))))
    names = {"FP": "false positives (clean, judged malware): ", "FN": "false negatives (malware, judged clean): "}
    heads = kinds.select(F.inline(F.array(*(F.struct(F.lit(i).alias("part"), F.lit(0).cast("long").alias("rank"), F.concat(F.lit(t), F.col(k).cast("string")).alias("line")) for i, (k, t) in enumerate(names.items())))))
    one_line = F.replace(F.coalesce(F.col(text), F.lit("")), F.lit("\n"), F.lit("\\n"))
    rows = metrics.errors(judged, key, label, pred).select((F.col("kind") == "FN").cast("int").alias("part"), "rank", F.concat(F.col("rank").cast("string"), F.lit(". "), one_line).alias("line"))
    return heads.unionByName(rows).orderBy("part", "rank").select("line")
