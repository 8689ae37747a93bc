"""Binary classification metrics from (label, prediction) columns, as aggregates: one pass, map-side combined."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import stored


def _safe(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def confusion_counts(df: DataFrame, by: list[str] | None = None, label: str = "label", pred: str = "pred") -> DataFrame:
    cells = {"tp": (1, 1), "tn": (0, 0), "fp": (0, 1), "fn": (1, 0)}
    return df.groupBy(*(by or [])).agg(*(F.count_if((F.col(label) == y) & (F.col(pred) == p)).alias(name) for name, (y, p) in cells.items()))


def class_scores() -> dict[str, dict[str, Column]]:
    """Precision, recall, f1 and support per class, over columns tp, tn, fp, fn."""
    tp, tn, fp, fn = (F.col(c).cast("double") for c in ("tp", "tn", "fp", "fn"))
    out = {}
    for name, hit, false, missed in (("malware", tp, fp, fn), ("clean", tn, fn, fp)):
        out[name] = {"precision": _safe(hit, hit + false), "recall": _safe(hit, hit + missed), "f1": _safe(2 * hit, 2 * hit + false + missed), "support": hit + missed}
    return out


def metrics(df: DataFrame, by: list[str] | None = None, label: str = "label", pred: str = "pred") -> DataFrame:
    """accuracy, F1 of several kinds, precision and recall of the positive class, false positive rate, and the counts."""
    s = class_scores()
    n = F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")
    columns = {
        "accuracy": _safe(F.col("tp") + F.col("tn"), n),
        "f1_macro": (s["malware"]["f1"] + s["clean"]["f1"]) / 2,
        "f1_weighted": _safe(s["malware"]["f1"] * s["malware"]["support"] + s["clean"]["f1"] * s["clean"]["support"], n),
        "f1_malware": s["malware"]["f1"],
        "precision_malware": s["malware"]["precision"],
        "recall_malware": s["malware"]["recall"],
        "fpr": _safe(F.col("fp").cast("double"), F.col("fp") + F.col("tn")),
    }
    return confusion_counts(df, by, label, pred).select(*(by or []), *(c.alias(k) for k, c in columns.items()), "tp", "tn", "fp", "fn")


def classification_report(df: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    """A row per class, and their plain and weighted means: class, precision, recall, f1, support."""
    s, names = class_scores(), ("precision", "recall", "f1", "support")
    total = s["malware"]["support"] + s["clean"]["support"]
    rows = [F.struct(F.lit(k).alias("class"), *(v[n].alias(n) for n in names)) for k, v in s.items()]
    mean = [((s["malware"][n] + s["clean"][n]) / 2).alias(n) for n in names[:3]]
    weighted = [_safe(s["malware"][n] * s["malware"]["support"] + s["clean"][n] * s["clean"]["support"], total).alias(n) for n in names[:3]]
    rows += [F.struct(F.lit("macro avg").alias("class"), *mean, total.alias("support")), F.struct(F.lit("weighted avg").alias("class"), *weighted, total.alias("support"))]
    return confusion_counts(df, None, label, pred).select(F.inline(F.array(*rows)))


def confusion_matrix(df: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    """A row per label, a column per prediction."""
    return df.groupBy(F.col(label).alias("label")).pivot(pred, [0, 1]).count().select("label", F.coalesce("`0`", F.lit(0)).alias("pred_0"), F.coalesce("`1`", F.lit(0)).alias("pred_1"))


def with_rule_label(df: DataFrame, pred: str = "pred", rule: str = "rule_label") -> DataFrame:
    """The rule's label where it has one (is not -1), else the model's."""
    return df.withColumn(pred, F.coalesce(F.nullif(F.col(rule), F.lit(-1)), F.col(pred)))


def errors(df: DataFrame, key: str, label: str = "label", pred: str = "pred") -> DataFrame:
    """False positives and negatives with their rank by key within each kind.

    No task holds a kind: rows are stored in ranges of the key, whose counts give
    each range's first rank, and are ranked inside the ranges.
    """
    wrong = df.where(F.col(label) != F.col(pred)).withColumn("kind", F.when(F.col(label) == 0, "FP").otherwise("FN"))
    rows = stored(wrong.repartitionByRange("kind", key).withColumn("__range", F.spark_partition_id()), "errors")
    counts = rows.groupBy(F.col("kind").alias("__kind"), F.col("__range").alias("__r")).agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy("__kind").orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.join(counts.withColumn("__before", before), (F.col("kind") == F.col("__kind")) & (F.col("__range") == F.col("__r")))
    inside = F.row_number().over(Window.partitionBy("kind", "__range").orderBy(key))
    return rows.withColumn("rank", F.col("__before") + inside).drop("__range", "__kind", "__r", "__n", "__before")


# Losses of a row from its two logits and its label.


def log_probability(logits: tuple[Column, Column], label: Column) -> Column:
    high = F.greatest(*logits)
    total = high + F.log(F.exp(logits[0] - high) + F.exp(logits[1] - high))
    return F.when(label == 1, logits[1]).otherwise(logits[0]) - total


def cross_entropy(logits: tuple[Column, Column], label: Column, weights: tuple[float, float] | None = None, smoothing: float = 0.0) -> Column:
    w0, w1 = (F.lit(float(w)) for w in (weights or (1.0, 1.0)))
    p0, p1 = (log_probability(logits, F.lit(k)) for k in (0, 1))
    hard = -F.when(label == 1, w1 * p1).otherwise(w0 * p0)
    return (1 - smoothing) * hard + smoothing / 2 * -(w0 * p0 + w1 * p1)


def focal(logits: tuple[Column, Column], label: Column, gamma: float = 2.0, alpha: float = 1.0, weights: tuple[float, float] | None = None) -> Column:
    loss = cross_entropy(logits, label, weights)
    return alpha * F.pow(1 - F.exp(-loss), F.lit(gamma)) * loss
