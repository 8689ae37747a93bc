"""spark-submit quillon/cli.py COMMAND …: the engine's jobs from a shell."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from quillon.operators import clean, gnn, graph, metrics, reports, runs, serving, suite
from quillon.sources import files, run_catalogue
from quillon.sources.shared import clear, stored

TABLES = ("malware", "clean", "test_malware", "test_clean")


def unique(spark: SparkSession, args) -> None:
    """Each raw table NAME.csv of a folder to NAME_unique.csv, by descending text."""
    spark = spark.newSession()  # of its own, as make_unique asks
    for name in args.tables:
        seen = Observation(name)
        out = clean.make_unique(files.read_commands(spark, f"{args.folder}/{name}.csv"), seen)
        columns = [c for c in ("command_line", "total_occurrences") if c in out.columns]
        files.write_csv(out.select(*columns).orderBy(F.desc("command_line")), f"{args.out or args.folder}/{name}_unique.csv", single=True)
        print(name, *(f"{k}={v}" for k, v in seen.get.items()))


def show(df: DataFrame) -> None:
    """Every row, one at a time, as tab-separated text under a head line."""
    print("\t".join(df.columns))
    for row in df.toLocalIterator():
        print("\t".join("" if v is None else ",".join(map(str, v)) if isinstance(v, list) else str(v) for v in row))


def summarize(spark: SparkSession, args) -> None:
    df = files.read_with_path(spark, *args.patterns)
    values = [c for c in (*runs.METRICS, *(f"test_{m}" for m in runs.METRICS)) if c in df.columns]
    rows, groups = runs.sorted_rows(df, args.sort_by, args.limit), runs.mean_std(df, values, sort_by=args.sort_by, limit=args.limit)
    for name, table in (("rows", rows), ("groups", groups)):
        show(table)
        if args.out:
            files.write_csv(table, f"{args.out}/{name}", single=True)


def _found(spark: SparkSession, args) -> DataFrame:
    asked = {k: getattr(args, k) for k in ("seed", "test_size", "feature_type", "edge_ablation", "embedder", "feature_config")}
    return runs.lookup(run_catalogue.saved_runs(spark, args.root), None, args.model, **asked)


def find(spark: SparkSession, args) -> None:
    show(runs.run_sets(_found(spark, args)).orderBy("run_dir"))


def _tables(spark: SparkSession, malware: str | None, clean_: str | None) -> DataFrame | None:
    if bool(malware) != bool(clean_):
        raise SystemExit("tables of malware and of clean commands go together")
    if not malware:
        return None
    return serving.labelled_commands(*(clean.read_back(files.read_commands(spark, p)) for p in (malware, clean_)))


def train(spark: SparkSession, args) -> None:
    """Graph models, or baselines on text, over all combinations asked for; metrics go to experiment_summary below the results."""
    rows, later = _tables(spark, args.malware, args.clean), _tables(spark, args.test_malware, args.test_clean)
    if args.kind == "gnn":
        out = serving.train_grid(rows, args.results, args.seed, args.feature_type, args.edge_ablation, args.model or ["rgcn"], args.loss, args.test_size, args.epochs, args.batch_size, args.num_layers, held_out=later, cache=args.cache)
    else:
        models = ["manual"] if args.kind == "manual" else [f"tfidf_{a}" for a in args.analyzer]
        out = suite.run(rows, "key", "text", models, args.seed, args.test_size, later)
    files.write_csv(out, f"{args.results}/experiment_summary", single=True)
    show(out)


def infer(spark: SparkSession, args) -> None:
    """Predictions for a table of unique or raw commands by one saved model, how many commands had no tree, metrics if it has labels, and the time of each stage."""
    if not args.model_path:
        first = _found(spark, args).orderBy("path").select("path").first()
        if first is None:
            raise SystemExit("no run is what was asked for")
    model, config, ablation = serving.rebuild(spark, args.model_path or first["path"])
    raw = files.read_csv(spark, args.csv)
    raw = stored((raw if args.limit is None else raw.limit(args.limit)).withColumn("key", F.monotonically_increasing_id()), "asked")
    prepared = stored((clean.parsed if args.raw else clean.read_back)(raw), "prepared")
    label = "label" if "label" in raw.columns else None
    out = serving.infer(prepared.withColumn("label", F.col("label").cast("int")) if label else prepared, "key", model, config, ablation, label, args.batch_size)
    if args.out:
        files.write_csv(out, args.out)
    show(serving.outcomes(prepared))
    if label:
        show(metrics.metrics(out))
        show(metrics.confusion_matrix(out))
    show(suite.latency(serving.timings(raw, model, config, ablation, args.raw, args.batch_size, args.warmup)))
    clear(spark)


def evaluate(spark: SparkSession, args) -> None:
    """A saved model on the part of its tables that its training left out and on later tables, with reports as text."""
    first = _found(spark, args).orderBy("path").first()
    if first is None:
        raise SystemExit("no run is what was asked for")
    model, config, ablation = serving.rebuild(spark, first["path"])
    rows, later = _tables(spark, args.malware, args.clean), _tables(spark, args.test_malware, args.test_clean)
    judged = stored(serving.evaluate(rows, later, model, config, ablation, first["seed"], first["test_size"], ["text"]), "judged")
    scores = metrics.metrics(judged, ["part"])
    show(scores)
    for part in ("validation", "later"):
        files.write_text(reports.confusion(judged.where(F.col("part") == part), f"{first['model']}_{first['loss']}, {part}"), f"{args.out}/{part}_confusion")
        files.write_text(reports.wrong(judged.where(F.col("part") == part), "graph_id", "text"), f"{args.out}/{part}_errors", single=False)
    files.write_csv(scores, f"{args.out}/scores", single=True)
    clear(spark)


def count(spark: SparkSession, args) -> None:
    for m in args.model:
        print(m, runs.parameters(m, args.width, args.hidden_dim, args.num_layers, args.num_classes))


def _run_options(a: argparse.ArgumentParser) -> None:
    """What a run must be; models are beginnings of MODEL_loss in any case."""
    a.add_argument("--model", nargs="*")
    a.add_argument("--seed", type=int)
    a.add_argument("--test-size", type=float)
    a.add_argument("--feature-type")
    a.add_argument("--edge-ablation")
    a.add_argument("--embedder")
    a.add_argument("--feature-config", nargs="*")


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__)
    sub = p.add_subparsers(required=True)
    a = sub.add_parser("unique")
    a.add_argument("folder")
    a.add_argument("--out")
    a.add_argument("--tables", nargs="+", default=TABLES)
    a.set_defaults(run=unique)
    a = sub.add_parser("summarize")
    a.add_argument("patterns", nargs="+")
    a.add_argument("--sort-by")
    a.add_argument("--limit", type=int)
    a.add_argument("--out")
    a.set_defaults(run=summarize)
    a = sub.add_parser("find")
    a.add_argument("root")
    _run_options(a)
    a.set_defaults(run=find)
    a = sub.add_parser("train")
    a.add_argument("kind", choices=("gnn", "tfidf", "manual"))
    a.add_argument("malware")
    a.add_argument("clean")
    a.add_argument("--test-malware")
    a.add_argument("--test-clean")
    a.add_argument("--results", default="results")
    a.add_argument("--cache", help="a folder where graphs and splits are kept for later jobs")
    a.add_argument("--seed", type=int, nargs="+", default=[42])
    a.add_argument("--test-size", type=float, default=0.3)
    a.add_argument("--model", nargs="+", choices=gnn.KINDS)
    a.add_argument("--feature-type", nargs="+", default=["semantic_only"], choices=tuple(graph.CONFIGS))
    a.add_argument("--edge-ablation", nargs="+", default=["all"], choices=tuple(graph.KEEP))
    a.add_argument("--loss", nargs="+", default=["standard"], choices=tuple(serving.LOSSES))
    a.add_argument("--analyzer", nargs="+", default=["char_wb", "word"], choices=("word", "char", "char_wb"))
    a.add_argument("--epochs", type=int, default=25)
    a.add_argument("--batch-size", type=int, default=64)
    a.add_argument("--num-layers", type=int, default=3)
    a.set_defaults(run=train)
    a = sub.add_parser("infer")
    a.add_argument("csv")
    a.add_argument("--model-path")
    a.add_argument("--root", default="results")
    _run_options(a)
    a.add_argument("--raw", action="store_true", help="the commands are not parsed yet")
    a.add_argument("--batch-size", type=int, default=32)
    a.add_argument("--limit", type=int, help="only so many rows")
    a.add_argument("--warmup", type=int, default=2)
    a.add_argument("--out")
    a.set_defaults(run=infer)
    a = sub.add_parser("evaluate")
    a.add_argument("malware")
    a.add_argument("clean")
    a.add_argument("test_malware")
    a.add_argument("test_clean")
    a.add_argument("--root", default="results")
    a.add_argument("--out", default="results/evaluation")
    _run_options(a)
    a.set_defaults(run=evaluate)
    a = sub.add_parser("count-params")
    a.add_argument("--model", nargs="+", default=("gcn", "sage", "gin", "gat", "rgcn"))
    a.add_argument("--width", type=int, default=64)
    a.add_argument("--hidden-dim", type=int, default=128)
    a.add_argument("--num-layers", type=int, default=3)
    a.add_argument("--num-classes", type=int, default=2)
    a.set_defaults(run=count)
    args = p.parse_args(argv)
    args.run(SparkSession.builder.getOrCreate(), args)


if __name__ == "__main__":
    main()
