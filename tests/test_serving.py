"""From unique tables to graphs, models, files and metrics; the shell's commands."""

from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F
from quillon import cli
from quillon.functions import cmdline
from quillon.operators import clean, features, gnn, graph, metrics, reports, runs, serving, split, tree_graphs
from quillon.sources import files, shared

HERE = Path(__file__).parent / "fixtures"


def unique(spark, name):
    return clean.read_back(files.read_commands(spark, f"file://{HERE}/{name}_unique.csv"))


@pytest.mark.parametrize(
    ("text", "tree"),
    [
        ("('a', ('b', \"it's\"), 'c\\\\d')", ("a", ("b", "it's"), "c\\d")),
        ('["a", ["b"], "é"]', ("a", ("b",), "é")),
        ("('one',)", ("one",)),
        ("'bare'", "bare"),
        ("()", ()),
        ("__import__('os').getcwd()", None),
        ("(1, 'a')", None),
        ("('a'", None),
        ("", None),
        (None, None),
    ],
)
def test_tree_literals(text, tree):
    assert clean.read_tree(text) == tree


def test_read_back_is_what_was_written(spark):
    made = clean.make_unique(files.read_commands(spark, f"file://{HERE}/malware.csv"))
    back = clean.read_back(made.select("command_line", F.col("tokens").alias("want")))
    for r in back.collect():
        assert r.tokens == r.want and r.text == " ".join(r.want)
    odd = clean.read_back(spark.createDataFrame([("(a, 'b')",), (None,), ("",)], "command_line string")).collect()
    assert [(r.tree, r.text) for r in odd] == [(None, " a   b  "), (None, ""), (None, "")]


def test_every_configuration_gives_its_width(spark):
    rows = unique(spark, "clean").withColumn("key", F.md5("command_line"))
    for config, (semantic, token, positional) in graph.CONFIGS.items():
        got = serving.graphs(rows, "key", config, "self_loops_parent_child").collect()
        width = runs.input_width(64 if semantic else 0, token, positional)
        assert len(got) == rows.count() and all(r.width == width and len(r.x) == width * (max(r.dst) + 1) and set(r.type) <= {0, 1, 2} for r in got)
    assert all(set(r.x) == {1.0} for r in serving.graphs(rows, "key", "no_features").collect())


def test_tables_to_metrics_and_back_from_files(spark, tmp_path):
    rows = serving.labelled_commands(unique(spark, "malware"), unique(spark, "clean"))
    later = serving.labelled_commands(unique(spark, "test_malware"), unique(spark, "test_clean"))
    root = f"file://{tmp_path}/results"
    out = serving.train_grid(rows, root, [3], ["syntactic_positional"], ["all"], ["gcn"], ["standard", "focal"], epochs=2, hidden=8, held_out=later, stamp="2025").collect()
    assert {r.loss_type for r in out} == {"standard", "focal"} and all(0 <= r.test_accuracy <= 1 and r.tp + r.tn + r.fp + r.fn > 0 for r in out)
    found = runs.parsed_runs(files.find_models(spark, root))
    assert {(r.model, r.loss, r.seed, r.test_size, r.feature_config) for r in found.collect()} == {("GCN", x, 3, 0.3, "syntactic_positional") for x in ("standard", "focal")}
    assert runs.lookup(found, prefixes=["gcn_f"], seed=3, test_size=0.3, feature_config=["x", "syntactic_positional"]).count() == 1 and runs.lookup(found, prefixes=["rg"]).count() == 0
    path = next(r.path for r in out if r.loss_type == "focal")
    model, config, ablation = serving.rebuild(spark, path)
    assert (config, ablation) == ("syntactic_positional", "all")
    again = metrics.metrics(serving.infer(later, "key", model, config, ablation, "label")).first()
    want = next(r for r in out if r.loss_type == "focal")
    assert again.accuracy == pytest.approx(want.test_accuracy) and again.fp == want.test_fp


@pytest.mark.parametrize("kind", gnn.KINDS)
def test_saved_model_is_the_same(spark, tmp_path, kind):
    m = gnn.Model(kind, 5, hidden=8, relations=3).start(4)
    serving.save_model(spark, m, f"file://{tmp_path}/x_model.pt")
    back = serving.load_model(spark, f"file://{tmp_path}/x_model.pt")
    assert (back.kind, back.width, back.hidden, back.relations, back.count()) == (kind, 5, 8, 3, m.count())
    assert all(np.array_equal(back.weights[k], v) for k, v in m.weights.items()) and all(np.array_equal(back.running[k], v) for k, v in m.running.items())


def test_shell(spark, tmp_path, capsys):
    where = f"file://{tmp_path}/r"
    tables = [f"file://{HERE}/{n}_unique.csv" for n in ("malware", "clean")]
    cli.main(["train", "gnn", *tables, "--results", where, "--feature-type", "positional_only", "--model", "gin", "--epochs", "1", "--seed", "7"])
    cli.main(["find", where, "--model", "gin", "--seed", "7"])
    assert "GIN" in capsys.readouterr().out
    labelled = spark.createDataFrame([(t, k % 2) for k, t in enumerate(r.command_line for r in unique(spark, "clean").collect())], "command_line string, label int")
    files.write_csv(labelled, f"{where}/in", single=True)
    cli.main(["infer", f"{where}/in", "--root", where, "--model", "gin", "--warmup", "0", "--out", f"{where}/out"])
    said = capsys.readouterr().out
    assert "f1_macro" in said and "combined" in said and "batch_ms_mean" in said
    assert files.read_csv(spark, f"{where}/out").count() == labelled.count()
    cli.main(["evaluate", *tables, *(f"file://{HERE}/test_{n}_unique.csv" for n in ("malware", "clean")), "--root", where, "--model", "gin", "--out", f"{where}/evaluation"])
    assert "validation" in capsys.readouterr().out and spark.read.text(f"{where}/evaluation/later_confusion").count() == 13
    cli.main(["summarize", f"{where}/experiment_summary", "--out", f"{where}/summary"])
    assert "accuracy_mean" in capsys.readouterr().out and files.read_csv(spark, f"{where}/summary/groups").count() == 1


def test_run_paths(spark):
    paths = ["a/0.3/seed4/ft/all/org_m/cfg/RGCN_ce_model.pt", "0.3/seed4/ft/all/org_m/cfg/GCN_model.pt", "abc/seed4/x/y/z/w/GCN_ce_model.pt", "0.1/seed4/short.pt", "seed4/a/b/c/d/e_model.pt", "r/0.5/seedx/a/b/c/d/e.pt", "t/0.2/seed99999999999/a/b/c/d/GIN_x_model.pt"]
    got = {r.path: (r.test_size, r.seed, r.model, r.loss, r.timestamp) for r in runs.parsed_runs(spark.createDataFrame([(p,) for p in paths], "path string")).collect()}
    assert got == {paths[0]: (0.3, 4, "RGCN", "ce", "a"), paths[1]: (0.3, 4, "GCN", "", None)}


def test_summaries_leave_nan_out(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", float("nan")), ("a", 3.0), ("b", None)], "model string, fpr double")
    got = {r.model: (r.fpr_mean, r.fpr_std) for r in runs.mean_std(df, ["fpr"]).collect()}
    assert got == {"a": (2.0, 1.0), "b": (None, 0.0)}
    assert runs.mean_std(df.where("model = 'b'"), ["fpr"], []).first().fpr_std is None


def test_tree_of_any_depth(spark):
    links = [("r", None), ("other", None), ("lost", "gone"), ("below lost", "lost"), ("c1", "c2"), ("c2", "c3"), ("c3", "c1"), ("below circle", "c1"), ("self", "self"), *((f"n{i}", f"n{i - 1}" if i else "r") for i in range(12))]
    got = {r.node: (r.depth, r.subtree) for r in graph.depth_and_subtree(spark.createDataFrame(links, "node string, parent string")).collect()}
    assert got == {"r": (0, 13), "other": (0, 1)} | {f"n{i}": (i + 1, 12 - i) for i in range(12)}


def test_deep_trees_take_few_rounds(spark, monkeypatch):
    """A chain of 100,000 nodes beside a bush and a star, in 18 rounds."""
    rounds = []
    stored_at = graph.stored_at
    monkeypatch.setattr(graph, "stored_at", lambda df, name: rounds.append(name) or stored_at(df, name))
    n = 100_000
    chain = spark.range(n).select("id", F.when(F.col("id") > 0, F.col("id") - 1).alias("parent"))
    bush = spark.range(n, n + 1023).select("id", F.when(F.col("id") > n, n + F.floor((F.col("id") - n - 1) / 2)).alias("parent"))
    star = spark.range(2 * n, 2 * n + 5000).select("id", F.when(F.col("id") > 2 * n, F.lit(2 * n)).cast("long").alias("parent"))
    got = graph.depth_and_subtree(chain.union(bush).union(star).withColumnRenamed("id", "node"))
    assert len(rounds) <= 19
    assert got.where(f"node < {n} and (depth <> node or subtree <> {n} - node)").count() == 0 and got.count() == n + 1023 + 5000
    size = lambda k: 1023 if k == 0 else (1 << (10 - (k + 1).bit_length() + 1)) - 1
    assert {r.node - n: (r.depth, r.subtree) for r in got.where(f"node >= {n} and node < {2 * n}").collect()} == {k: ((k + 1).bit_length() - 1, size(k)) for k in range(1023)}
    assert {tuple(r) for r in got.where(f"node >= {2 * n}").groupBy("depth", "subtree").count().collect()} == {(0, 5000, 1), (1, 1, 4999)}


def test_parser_has_no_depth_of_its_own():
    deep = ("a", "b")
    for _ in range(300):
        deep = ("n", deep)
    assert len(clean.arena(deep)) > 300
    with pytest.raises(ValueError, match="levels"):
        cmdline._unwind("0", None, lambda command, parent: (yield from [(str(int(command) + 1), None)]), str, 50)


def test_shared_folder(spark):
    assert shared.shared_dir(spark).partition(":")[1] == ":"

    class Unset:
        @staticmethod
        def get(name, default):
            return default

        getConf = lambda: Unset
        master = "spark://host:7077"

    class Session:
        conf = sparkContext = Unset

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared.shared_dir(Session)
    Unset.master = "local[4]"
    assert shared.shared_dir(Session).startswith("file:///tmp/")


@pytest.mark.parametrize("ablation", list(graph.KEEP))
def test_graphs_in_a_row_are_those_of_node_tables(spark, ablation):
    """Edges, degrees, places and token features of the one-pass builder against the operators on node and edge tables."""
    rows = unique(spark, "clean").unionByName(unique(spark, "malware"), allowMissingColumns=True).withColumn("key", tree_graphs.tree_id(F.col("tree")))
    nodes = graph.nodes_of(rows.dropDuplicates(["key"]), "key")
    edges = graph.ablate(graph.edges(nodes), ablation)
    wide = nodes.select("graph_id", "idx", F.array(*features.token_features(F.col("value")).values()).alias("t"))
    for more, name in ((graph.positional_features(nodes), "p"), (graph.degree_features(nodes, edges), "d")):
        names = [c for c in more.columns if c not in ("graph_id", "idx")]
        wide = wide.join(more.select("graph_id", "idx", F.array(*(F.col(c).cast("double") for c in names)).alias(name)), ["graph_id", "idx"])
    labels = rows.select(F.col("key").alias("graph_id"), F.lit(0).alias("label"), graph.rule_label(F.col("tokens")).alias("rule_label")).distinct()
    want = {r.graph_id: r for r in gnn.graph_rows(wide.select("graph_id", "idx", F.concat("t", "p", "d").alias("v")), edges, "v", labels, 23).collect()}
    got = tree_graphs.graphs_of(tree_graphs.distinct_trees(rows), (False, True, True), ablation).collect()
    assert {r.tree_id for r in got} == set(want) and len(got) == len(want)
    for r in got:
        w = want[r.tree_id]
        assert (r.src, r.dst, r.type, r.width, r.rule_label) == (w.src, w.dst, w.type, w.width, w.rule_label) and np.allclose(r.x, w.x, rtol=1e-6)


def test_repeated_commands_are_judged_alike(spark):
    """One command, the same twice, and a null: as many rows as commands with a tree, equal ones with equal results."""
    lines = ["cmd.exe /c dir c:\\temp a b c", "cmd.exe /c dir c:\\temp a b c", "powershell -nop -w hidden x y z", None]
    rows = clean.parsed(spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "key int, command_line string"))
    model = gnn.Model("gcn", runs.input_width(64, True, True), hidden=8).start(1)
    got = {r.graph_id: r[2:] for r in serving.infer(rows, "key", model, "all").collect()}
    one = serving.infer(rows.where("key = 0"), "key", model, "all").first()
    assert set(got) == {0, 1, 2} and got[0] == got[1] == pytest.approx(tuple(one[2:])) and got[2] != got[0]
    sizes = {r.graph_id: (len(r.x), len(r.src)) for r in serving.graphs(rows, "key", "all").collect()}
    assert sizes[0] == sizes[1]
    same_key = serving.graphs(rows.withColumn("key", F.lit(7)), "key", "all").collect()
    assert sorted((len(r.x), len(r.src)) for r in same_key) == sorted(sizes.values())
    assert {r.outcome: r.commands for r in serving.outcomes(rows).collect()} == {"graph": 3, "no command": 1}
    timed = serving.timings(spark.createDataFrame([(t,) for t in lines], "command_line string").coalesce(1), model, "all", raw=True, batch=2, warmup=1).collect()
    assert [(r.commands, r.skipped, len(r.command_s)) for r in timed] == [(1, 1, 1)] and timed[0].model_s > 0
    plan = serving.infer(rows, "key", model, "all")._jdf.queryExecution().executedPlan().toString()
    assert "embedding" not in plan and "Window" not in plan


def test_kept_graphs_are_made_once(spark, tmp_path):
    """A second job makes nothing, a third only what is new; kept rows are joined in their buckets."""
    rows = unique(spark, "clean").withColumn("key", F.col("command_line"))
    more = rows.unionByName(unique(spark, "malware").withColumn("key", F.col("command_line")), allowMissingColumns=True)
    where = f"file://{tmp_path}/kept"
    made = []

    def graphs(df):
        kept = serving.kept_graphs(spark, where, "syntactic_positional", buckets=4)
        before = kept.read().count()
        out = serving.graphs(df, "key", "syntactic_positional", kept=kept)
        made.append(kept.read().count() - before)
        return out

    first, again, later = graphs(rows), graphs(rows), graphs(more)
    trees = [df.select("tree").distinct().count() for df in (rows, more)]
    assert made == [trees[0], 0, trees[1] - trees[0]]
    plain = serving.graphs(more, "key", "syntactic_positional")
    key = lambda r: (r.graph_id, r.width, r.src, r.dst, r.type, r.x)
    assert sorted(map(key, later.collect())) == sorted(map(key, plain.collect())) and sorted(map(key, first.collect())) == sorted(map(key, again.collect()))
    spark.catalog.clearCache()
    kept = serving.kept_graphs(spark, where, "syntactic_positional", buckets=4)
    spark.sql(f"DROP TABLE {kept.table}")  # what a new session knows
    kept = serving.kept_graphs(spark, where, "syntactic_positional", buckets=4)
    assert kept.read().count() == trees[1]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        side = kept.read().select("tree_id", F.size("src").alias("n"))
        plan = side.join(kept.read().select("tree_id", "width"), "tree_id")._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "SortMergeJoin" in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_dropped_rows_are_counted_by_the_writing_job(spark, tmp_path):
    lines = [("cmd.exe /c dir c:\\temp a b c", "p"), ("cmd.exe /c dir c:\\temp a b c", "p"), ("x y", "p"), (None, "p"), ("powershell -nop -w hidden x y z", None), ("wmic process 55 get name a b", "p")]
    seen = Observation("unique")
    out = clean.make_unique(spark.newSession().createDataFrame(lines, "command_line string, process_name string"), seen)
    out.write.parquet(f"file://{tmp_path}/u")
    kept = spark.read.parquet(f"file://{tmp_path}/u").count()
    assert seen.get == {"rows": 6, "with_null": 2, "not_parsed": 0, "not_valid": 1, "kept": 3} and kept == 2


def test_evaluation_leaves_out_what_training_saw(spark, tmp_path, capsys):
    rows = serving.labelled_commands(unique(spark, "malware"), unique(spark, "clean"))
    later = serving.labelled_commands(unique(spark, "test_malware"), unique(spark, "test_clean"))
    known = rows.limit(6).withColumn("key", F.concat(F.lit("again-"), "key"))  # later tables repeat some commands
    model = gnn.Model("gcn", runs.input_width(0, True, True), hidden=8).start(1)
    got = serving.evaluate(rows, later.unionByName(known, allowMissingColumns=True), model, "syntactic_positional", "all", 3, 0.3, ["tree"]).collect()
    halves = split.stratified_split(rows.select("key", "label"), "key", 3, 0.3).join(rows.select("key", "tree"), "key").collect()
    trained = {r.tree for r in halves if not r.is_test}
    assert not trained & {r.tree for r in got}
    assert {r.graph_id for r in got if r.part == "validation"} == {r.key for r in halves if r.is_test and r.tree is not None and r.tree not in trained}
    want = {r.key for r in later.collect() if r.tree is not None and r.tree not in trained} | {r.key for r in known.collect() if r.tree not in trained}
    assert {r.graph_id for r in got if r.part == "later"} == want


def test_reports(spark):
    judged = spark.createDataFrame([("a", 0, 1, "x\ny"), ("b", 0, 1, "z"), ("c", 1, 0, "w"), ("d", 1, 1, "v"), ("e", 0, 0, "u")], "key string, label int, pred int, text string")
    lines = [r.line for r in reports.confusion(judged, "title").collect()]
    assert lines[0] == "title" and lines[3].split() == ["is", "clean", "1", "2"] and lines[4].split() == ["is", "malware", "1", "1"] and "accuracy            0.4000" in lines
    assert [r.line for r in reports.wrong(judged, "key", "text").collect()] == ["false positives (clean, judged malware): 2", "1. x\\ny", "2. z", "false negatives (malware, judged clean): 1", "1. w"]
