"""Run analytics: summaries of experiments and the catalogue of runs that is their directory paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = ("feature_config", "model", "loss_type", "analyzer")
METRICS = ("accuracy", "f1_macro", "f1_weighted", "f1_malware", "precision_malware", "recall_malware", "fpr", "tp", "tn", "fp", "fn")


def present(df: DataFrame, names: tuple[str, ...]) -> list[str]:
    return [n for n in names if n in df.columns]


def sorted_rows(df: DataFrame, by: str | None, limit: int | None = None) -> DataFrame:
    """Descending, missing values last; a column that is absent sorts nothing."""
    df = df.orderBy(F.desc_nulls_last(by)) if by in df.columns else df
    return df if limit is None else df.limit(limit)


def mean_std(df: DataFrame, values: list[str], keys: list[str] | None = None, sort_by: str | None = None, limit: int | None = None) -> DataFrame:
    """Mean and population deviation of values by the keys there are (rows of null keys are a group), NaN and null left out; a limit is applied to the rows before they are grouped. A group without values has deviation 0, a whole table without values none."""
    if sort_by or limit is not None:
        df = sorted_rows(df, sort_by, limit)
    keys = present(df, KEYS) if keys is None else keys
    there = {v: F.when(~F.isnan(F.col(v).cast("double")), F.col(v)) for v in values}
    std = lambda x: F.coalesce(F.stddev_pop(x), F.lit(0.0)) if keys else F.stddev_pop(x)
    out = [c for v, x in there.items() for c in (F.avg(x).alias(f"{v}_mean"), std(x).alias(f"{v}_std"))]
    return df.groupBy(*keys).agg(*out)


def mean_std_levels(df: DataFrame, values: list[str], keys: list[str], sets: list[list[str]]) -> DataFrame:
    """mean_std over several sets of keys, one of which may be empty (all rows), in one plan: keys, level (a bit for each key that a set leaves out, the first key's the highest) and the figures. A null key of a row is a group of its own level, apart from totals."""
    there = {v: F.when(~F.isnan(F.col(v).cast("double")), F.col(v)) for v in values}
    out = [c for v, x in there.items() for c in (F.avg(x).alias(f"{v}_mean"), F.coalesce(F.stddev_pop(x), F.lit(0.0)).alias(f"{v}_std"))]
    return df.groupingSets([[F.col(k) for k in x] for x in sets], *(F.col(k) for k in keys)).agg(F.grouping_id().cast("int").alias("level"), *out)


def training_course(history: DataFrame, run: list[str], epoch: str = "epoch", f1: str = "f1_malware", macro: str = "f1_macro", rate: float = 1e-3, patience: int = 5, plateau: int = 3) -> DataFrame:
    """history (a row per run and epoch) with what training makes of it, by windows over each run's epochs.

    An epoch is better if its score is above all before it. better, best_epoch (so
    far), since_best (epochs since), and for the macro score the same as flat (epochs
    since a better one or since the rate was halved, which is when there were more
    than plateau), rate_after, and ends: the first epoch at which since_best reaches
    patience, behind which no epoch counts. A null score is never better.
    """
    before = Window.partitionBy(*run).orderBy(epoch).rowsBetween(Window.unboundedPreceding, -1)
    so_far = Window.partitionBy(*run).orderBy(epoch).rowsBetween(Window.unboundedPreceding, 0)
    above = lambda c: F.coalesce(F.col(c) > F.coalesce(F.max(c).over(before), F.lit(float("-inf"))), F.lit(False))
    rows = history.withColumns({"better": above(f1), "__macro": above(macro)})
    rows = rows.withColumns({"__island": F.count_if("better").over(so_far), "__run": F.count_if("__macro").over(so_far)})
    inside = lambda island: Window.partitionBy(*run, island).orderBy(epoch)
    behind = lambda island: F.row_number().over(inside(island)) - F.when(F.col(island) > 0, 1).otherwise(0)
    rows = rows.withColumns({"since_best": behind("__island"), "__flat": behind("__run"), "best_epoch": F.max(F.when(F.col("better"), F.col(epoch))).over(so_far)})
    halved = (F.col("__flat") > 0) & (F.col("__flat") % (plateau + 1) == 0)
    rows = rows.withColumns({"flat": F.col("__flat") % (plateau + 1), "rate_after": F.lit(rate) * F.pow(F.lit(0.5), F.count_if(halved).over(so_far))})
    ends = F.min(F.when(F.col("since_best") >= patience, F.col(epoch))).over(Window.partitionBy(*run))
    return rows.withColumn("ends", ends).drop("__macro", "__island", "__run", "__flat")


def best_of(df: DataFrame, value: str, rows: str, columns: str, names: list | None = None) -> DataFrame:
    """The greatest value per row and column key, columns as columns."""
    return df.groupBy(rows).pivot(columns, names).agg(F.max(value))


def cell(value: Column, whole: bool = False) -> Column:
    """A table cell: whole numbers bare, others with four digits, missing ones empty."""
    return F.when(value.isNull() | F.isnan(value.cast("double")), "").otherwise(value.cast("long").cast("string") if whole else F.format_string("%.4f", value.cast("double")))


def parse_run_path(path: Column) -> dict[str, Column]:
    """The parts of …/test_size/seedN/ft/ea/embedder/feature_config/MODEL_loss_model.pt, found from the seed part; null where the path is no run's (too short, or no number before the seed)."""
    parts = F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/")
    seed = F.array_position(F.transform(parts, lambda x: x.rlike("^seed[0-9]+$")), True).cast("int")
    at = lambda k: F.get(parts, seed - 1 + k)
    stem = F.regexp_replace(F.element_at(parts, -1), r"_model\.pt$", "")
    test_size = at(-1).try_cast("double")
    ok = (seed >= 2) & (F.size(parts) >= seed + 5) & test_size.isNotNull()
    found = {
        "timestamp": at(-2), "test_size": test_size, "seed": F.regexp_extract(at(0), "^seed([0-9]+)$", 1).try_cast("int"), "feature_type": at(1), "edge_ablation": at(2),
        "embedder": F.regexp_replace(at(3), "^([^_]*)_", "$1/"), "feature_config": at(4), "model": F.substring_index(stem, "_", 1), "loss": F.regexp_extract(stem, "^[^_]*_(.*)$", 1),
        "run_dir": F.array_join(F.slice(parts, 1, F.size(parts) - 1), "/"),
    }
    return {k: F.when(ok, v) for k, v in found.items()}


def parsed_runs(df: DataFrame, path: str = "path") -> DataFrame:
    """The runs among paths; others are left out."""
    return df.select(path, *(c.alias(k) for k, c in parse_run_path(F.col(path)).items())).where(F.col("seed").isNotNull())


def lookup(runs: DataFrame, models: list[str] | None = None, prefixes: list[str] | None = None, **asked) -> DataFrame:
    """Runs whose columns equal what is asked, or are in it if it is a list. models are exact; prefixes are beginnings of model and loss (MODEL_loss) in any case, of which one must fit."""
    for column, value in (asked | {"model": models}).items():
        if isinstance(value, (list, tuple)) and value:
            runs = runs.where(F.col(column).isin(*value))
        elif value not in (None, [], ()):
            runs = runs.where(F.col(column) == value)
    if prefixes:
        name = F.lower(F.concat_ws("_", "model", F.nullif(F.col("loss"), F.lit(""))))
        runs = runs.where(F.exists(F.array(*(F.lit(p.lower()) for p in prefixes)), lambda p: F.startswith(name, p)))
    return runs


def first_run(runs: DataFrame) -> DataFrame:
    return runs.orderBy("path").limit(1)


def run_sets(runs: DataFrame) -> DataFrame:
    """A row per run directory with its models and losses, sorted."""
    return runs.groupBy("run_dir").agg(F.array_sort(F.collect_set("model")).alias("models"), F.array_sort(F.collect_set("loss")).alias("losses"))


def without_repeats(values: Column) -> Column:
    return F.array_distinct(values)


def input_width(semantic: int, token: bool, positional: bool) -> int:
    """Node features in all: the embedding, 15 of the token, and 4 + 4 of position and degree; at least the constant."""
    return semantic + 15 * token + 8 * positional or 1


def parameters(model: str, width: int | Column, hidden: int = 128, layers: int = 3, classes: int = 2, relations: int = 5, heads: int = 4) -> int | Column:
    """Trainable parameters of a graph model, in closed form; of many at once if width is a column."""
    pool = 2 * hidden
    head = pool * hidden + hidden + hidden * classes + classes
    sizes = [width] + [hidden] * (layers - 1)
    norm = 2 * hidden
    if model == "gcn":
        return sum(w * hidden + hidden + norm for w in sizes) + head
    if model == "sage":
        return sum(2 * w * hidden + hidden + norm for w in sizes) + head
    if model == "gat":
        return sum(w * hidden + 2 * hidden + hidden + norm for w in sizes) + head
    if model == "rgcn":
        return sum((relations + 1) * w * hidden + hidden + norm for w in sizes) + head
    if model == "gin":
        mlp = sum(w * hidden + hidden + norm + hidden * hidden + hidden + norm for w in sizes)
        jump = layers * hidden
        return mlp + jump * hidden + hidden + hidden * classes + classes
    raise ValueError(model)
