"""Graph models end to end: graphs of parsed commands, files of models, runs rebuilt from their paths, training grids and inference."""

from __future__ import annotations

import io
import itertools
import pickle
import time
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shipping import ship
from ..sources import files
from ..sources.cache import BUCKETS, KeyedTable
from ..sources.shared import fresh_path, stored
from . import clean, embed, gnn, graph, metrics, runs, split, tree_graphs

# How model kinds are written in file names, losses by their names there, and the words of feature configurations.
FILE_NAMES = {"gcn": "GCN", "sage": "GraphSAGE", "gin": "GIN", "gat": "GAT", "rgcn": "RGCN"}
LOSSES = {"standard": "ce", "weighted": "weighted", "smoothed": "smoothed", "focal": "focal"}
TOKEN_WORDS = ("syntactic", "sintactic")
SEMANTIC_WIDTH = 64


def parts_of(config: str) -> tuple[bool, bool, bool]:
    """(semantic, token, positional) of a configuration, by its name here or the words in a directory's."""
    if config in graph.CONFIGS:
        return graph.CONFIGS[config]
    return "semantic" in config, any(w in config for w in TOKEN_WORDS), "positional" in config


def graphs(parsed: DataFrame, key: str, config: str = "semantic_only", ablation: str = "all", label: str | None = None, embedder: embed.Embedder | None = None, kept: KeyedTable | None = None) -> DataFrame:
    """A row per parsed command for gnn: features of its nodes by the configuration (a constant if it has none), edges, label (0 if there is none) and rule label.

    Graphs are made once per distinct tree, or found in the table of kept graphs, and joined by the tree's digest: commands, and keys, may repeat.
    """
    rows = parsed.where("nodes is not null").select(F.col(key).alias("graph_id"), tree_graphs.tree_id(F.col("tree")).alias("tree_id"), (F.col(label) if label else F.lit(0)).cast("int").alias("label"))
    trees = tree_graphs.distinct_trees(parsed)
    if kept is None:
        made = tree_graphs.graphs_of(trees, parts_of(config), ablation, embedder)
    else:
        kept.grow(trees, lambda missing: tree_graphs.graphs_of(missing, parts_of(config), ablation, embedder))
        made = kept.read()
    return rows.join(made, "tree_id").drop("tree_id")


def kept_graphs(spark: SparkSession, folder: str, config: str, ablation: str = "all", embedder: str = "hashing_grams", buckets: int = BUCKETS) -> KeyedTable:
    """Where graphs of a configuration stay, for all jobs that name the folder. Graphs of different rules or embedders do not mix."""
    return KeyedTable(spark, folder, files.graphs_name(graph.config_name(config, ablation), "trees", embedder), tree_graphs.GRAPH, "tree_id", buckets)


# --- files of models ----------------------------------------------------------


def _file(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def save_model(spark: SparkSession, model: gnn.Model, path: str) -> None:
    """One file of plain arrays, wherever Spark can write; no code is in it."""
    sink = io.BytesIO()
    shape = [model.width, model.hidden, model.layers, model.classes, model.relations, model.heads]
    np.savez(sink, kind=np.array(model.kind), shape=np.array(shape), dropout=np.array(model.dropout), **{f"w/{k}": v for k, v in model.weights.items()}, **{f"r/{k}": v for k, v in model.running.items()})
    target, system = _file(spark, path)
    out = system.create(target, True)
    try:
        out.write(bytearray(sink.getvalue()))
    finally:
        out.close()


def load_model(spark: SparkSession, path: str) -> gnn.Model:
    content = bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])
    with np.load(io.BytesIO(content), allow_pickle=False) as z:
        width, hidden, layers, classes, relations, heads = z["shape"].tolist()
        model = gnn.Model(str(z["kind"]), width, hidden, layers, classes, relations, heads, float(z["dropout"]))
        model.weights = {k[2:]: z[k] for k in z.files if k.startswith("w/")}
        model.running = {k[2:]: z[k] for k in z.files if k.startswith("r/")}
    return model


def model_path(root: str, stamp: str, test_size: float, seed: int, config: str, ablation: str, kind: str, loss: str, embedder: str = "hashing_grams", labels: tuple[str, str] | None = None) -> str:
    """Where a run's model lies; parse_run_path reads it back. labels: how the whole job's features and ablations are called."""
    feature_label, edge_label = labels or (config, ablation)
    return f"{root.rstrip('/')}/{stamp}/{test_size}/seed{seed}/{feature_label}/{edge_label}/{embedder}/{graph.config_name(config, ablation)}/{FILE_NAMES[kind]}_{loss}_model.pt"


def rebuild(spark: SparkSession, path: str) -> tuple[gnn.Model, str, str]:
    """A saved model with its feature configuration and edge ablation, as its path tells them."""
    config, _, ablation = path.replace("\\", "/").rsplit("/", 2)[-2].partition("_edges_")
    return load_model(spark, path), config, ablation or "all"


# --- training grid ------------------------------------------------------------


def labelled_commands(malware: DataFrame, clean: DataFrame) -> DataFrame:
    """Both unique tables, read back, with label and a key for each row."""
    both = malware.withColumn("label", F.lit(1)).unionByName(clean.withColumn("label", F.lit(0)), allowMissingColumns=True)
    return both.withColumn("key", F.concat(F.col("label").cast("string"), F.lit("-"), F.md5("command_line")))


def train_grid(
    df: DataFrame, root: str, seeds: Iterable[int] = (42,), configs: Iterable[str] = ("semantic_only",), ablations: Iterable[str] = ("all",), kinds: Iterable[str] = ("rgcn",), losses: Iterable[str] = ("standard",),
    test_size: float = 0.3, epochs: int = 25, batch: int = 64, layers: int = 3, hidden: int = 128, held_out: DataFrame | None = None, stamp: str | None = None, cache: str | None = None,
) -> DataFrame:
    """Every combination trained on the split of its seed and saved below root; a row of metrics each, with the prefix test_ on a held-out table.

    Below cache (a folder of this job, if none is named) graphs are kept by tree
    and configuration, and splits by seed and by the rows' keys, so a later job
    makes only what is new. Epochs' losses and scores are a table at root/history.
    """
    spark, out, history = df.sparkSession, [], []
    stamp = stamp or time.strftime("%Y%m%d_%H%M%S")
    cache = cache or fresh_path(spark, "training-cache")
    made = {}
    for config, ablation in itertools.product(dict.fromkeys(configs), dict.fromkeys(ablations)):
        kept = kept_graphs(spark, cache, config, ablation)
        made[config, ablation] = [None if x is None else graphs(x, "key", config, ablation, "label", kept=kept) for x in (df, held_out)]
    keys = df.select("key", "label")
    content = keys.agg(F.bit_xor(F.xxhash64("key", "label")).alias("x"), F.count("*").alias("n")).first()
    for seed in dict.fromkeys(seeds):
        part = files.cached(spark, cache, files.split_name(seed, test_size, f"{content.x}-{content.n}"), lambda: split.stratified_split(keys, "key", seed, test_size).select(F.col("key").alias("graph_id"), "is_test"))  # noqa: B023
        for ((config, ablation), (rows, later)), kind, loss in itertools.product(made.items(), dict.fromkeys(kinds), dict.fromkeys(losses)):
            rows = rows.join(part, "graph_id")
            train, test = rows.where("not is_test").drop("is_test"), rows.where("is_test").drop("is_test")
            semantic, token, positional = parts_of(config)
            model = gnn.Model(kind, runs.input_width(SEMANTIC_WIDTH if semantic else 0, token, positional), hidden, layers, relations=len(graph.KEEP[ablation])).start(seed)
            model, epochs_ = gnn.train(train, test, model, LOSSES[loss], epochs, batch, seed=seed)
            path = model_path(root, stamp, test_size, seed, config, ablation, kind, loss)
            save_model(spark, model, path)
            found = {"seed": seed, "feature_config": graph.config_name(config, ablation), "model": FILE_NAMES[kind], "loss_type": loss, "path": path}
            history += [found | e for e in epochs_]
            for prefix, data in (("", test), ("test_", later)):
                if data is not None:
                    found |= {prefix + k: v for k, v in metrics.metrics(gnn.predict(data, model)).first().asDict().items()}
            out.append(found)
    spark.createDataFrame(history, HISTORY).write.mode("append").parquet(f"{root.rstrip('/')}/history")
    return spark.createDataFrame(out)


HISTORY = "path string, seed int, feature_config string, model string, loss_type string, epoch int, loss double, rate double, f1_malware double, f1_macro double"


def infer(parsed: DataFrame, key: str, model: gnn.Model, config: str, ablation: str = "all", label: str | None = None, batch: int = 32, keep: list[str] | None = None) -> DataFrame:
    """graph_id, label, pred, logits and the columns in keep of parsed commands. A tree is judged once, however many commands have it; commands without a tree have no row."""
    if not 1 <= batch <= 64:
        raise ValueError("a batch has 1 to 64 graphs")
    made = tree_graphs.graphs_of(tree_graphs.distinct_trees(parsed), parts_of(config), ablation).withColumnRenamed("tree_id", "graph_id")
    judged = gnn.predict(made.withColumn("label", F.lit(0)), model, batch=batch).select(F.col("graph_id").alias("__tree"), "pred", "logit_0", "logit_1")
    rows = parsed.where("nodes is not null").select(F.col(key).alias("graph_id"), (F.col(label) if label else F.lit(0)).cast("int").alias("label"), tree_graphs.tree_id(F.col("tree")).alias("__of"), *(keep or []))
    return rows.join(judged, F.col("__of") == F.col("__tree")).select("graph_id", "label", "pred", "logit_0", "logit_1", *(keep or []))


def infer_commands(commands: DataFrame, key: str, model: gnn.Model, config: str, ablation: str = "all", command: str = "command_line", batch: int = 32) -> DataFrame:
    """graph_id, pred and logits of raw commands: infer, but trees go to the model as the parser made them, and rows meet only what became of their tree."""
    rows, trees = clean.parsed_by_tree(commands.select(key, command), command)
    parsed = trees.select("__key", *clean.parsed_columns(F.col("__parsed")))
    judged = infer(parsed, "__key", model, config, ablation, batch=batch).select(F.col("graph_id").alias("__key"), "pred", "logit_0", "logit_1")
    return rows.select("__key", F.col(key).alias("graph_id")).join(stored(judged, "judged"), "__key").drop("__key")


def evaluate(df: DataFrame, later: DataFrame, model: gnn.Model, config: str, ablation: str, seed: int, test_size: float, keep: list[str] | None = None) -> DataFrame:
    """infer on what the split of a run's seed left out of training (part 'validation') and on later commands (part 'later'), in one pass.

    Both without the trees that training saw, by label or not: a command that
    stands in the training part is no test, wherever it stands again.
    """
    halves = split.stratified_split(df.select("key", "label"), "key", seed, test_size).select("key", "is_test")
    rows = df.join(halves, "key").withColumn("part", F.when(F.col("is_test"), "validation").otherwise("training")).drop("is_test")
    rows = stored(rows.unionByName(later.withColumn("part", F.lit("later")), allowMissingColumns=True).withColumn("__tree_id", tree_graphs.tree_id(F.col("tree"))), "evaluated")
    seen = stored(rows.where("part = 'training'").select("__tree_id").distinct(), "training-trees")
    fresh = rows.where("part <> 'training'").join(seen, "__tree_id", "left_anti").drop("__tree_id")
    return infer(fresh, "key", model, config, ablation, "label", keep=["part", *(keep or [])])


def outcomes(parsed: DataFrame) -> DataFrame:
    """How many commands have a graph, and how many none, by reason."""
    reason = F.when(F.col("nodes").isNotNull(), "graph").when(F.col("command_line").isNull(), "no command")
    if "error" in parsed.columns:
        reason = reason.when(F.col("error").isNotNull(), "not parsed")
    return parsed.groupBy(reason.otherwise("no tree").alias("outcome")).agg(F.count(F.lit(1)).alias("commands"))


TIMES = "commands int, skipped int, command_s array<double>, preprocess_s double, model_s double"


def timings(commands: DataFrame, model: gnn.Model, config: str, ablation: str = "all", raw: bool = False, batch: int = 32, warmup: int = 2, command: str = "command_line", embedder: embed.Embedder | None = None) -> DataFrame:
    """A row per batch of commands, timed in the workers: commands with a graph, others, seconds that each of the former took to become a tree, seconds of the batch until its graphs are ready, and of the model.

    Every row is worked on, repeated ones too. The first batches of a task are not
    counted, but for its last.
    """
    spark = commands.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(pickle.dumps(model))
    read = (lambda text: clean.parse_row(text, None)) if raw else clean.read_row
    parts = parts_of(config)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, make = pickle.loads(shared.value), embedder or embed.hashing_embedder()
        held, counted, passed = None, False, 0
        for whole in batches:
            texts = whole.column(0).to_pylist()
            for lo in range(0, len(texts), batch):
                part = texts[lo : lo + batch]
                began, each, rows = time.perf_counter(), [], []
                for text in part:
                    start = time.perf_counter()
                    row = read(text)
                    if row[3]:
                        rows.append(row)
                        each.append(time.perf_counter() - start)
                x = tree_graphs.batch_of(clean.as_arrow(rows).field("nodes"), parts, ablation, make) if rows else None
                ready = time.perf_counter()
                if x is not None:
                    m.run(x)[0].value.argmax(1)
                done = time.perf_counter()
                found = pa.RecordBatch.from_arrays([pa.array([len(rows)], pa.int32()), pa.array([len(part) - len(rows)], pa.int32()), pa.array([each], pa.list_(pa.float64())), pa.array([ready - began]), pa.array([done - ready])], [c.split()[0] for c in TIMES.split(", ")])
                passed += 1
                if passed <= warmup:
                    held = found
                else:
                    counted = True
                    yield found
        if held is not None and not counted:
            yield held

    return commands.select(command).mapInArrow(run, TIMES)
