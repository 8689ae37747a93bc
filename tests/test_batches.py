"""Rules over batches against the plain ones, text by text."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from quillon.functions import batches, cmdline, rules
from quillon.operators import clean, gnn, parsing, runs, serving
from test_parsing import odd
from test_program import commands, mixed

EDGES = [
    "S-1-5-21-3-4", "x S-1-2-3S-1-4-5 y", "s-1-2-3", "aS-1-2-3", "0123456789abcdef0123456789ABCDEF", "77777777777777777777777777756427", 'find "17" x', 'find ""7"" x', "echo 'abcdefghijkl12'", "echo 'abcdefghijkl12",
    "fe80::1%eth0 ::1 1:2:3", "10.0.0.1:80 8.8.8.8", "a1 b2 c3 ", "x\n", "a12\n", "é a12", "\x1f a12", "\\mnt\\c/x/y.txt", "cmd.exe /c a^&b", "a1\tb2", "", " ", None, 'C:\\a\\b\\c.exe', "git 0a1b2c3 " + "0" * 40, "ſ-1-2-3 K",
]


def mutated(texts, seed):
    rng = random.Random(seed)
    pieces = [*(x for x in EDGES if x), *map(chr, range(32, 127)), "\t", "\n", "é"]
    for text in texts:
        for _ in range(rng.randint(1, 6)):
            i = rng.randint(0, len(text))
            text = text[:i] + rng.choice([rng.choice(pieces), ""]) + text[i + rng.choice([0, 0, 1, 5]) :]
        yield text


def test_batches_are_the_plain_rules():
    plain = [x for x in dict.fromkeys([*odd(), *commands(), *mixed(1500, 11)])]
    texts = [*EDGES, *plain, *mutated(plain, 12), *mutated(plain, 13)]
    for prepare in (True, False):
        got = batches.ruled_batch(pa.array(texts), prepare).to_pylist()
        want = [None if t is None else rules.rewrite_but_payloads(cmdline.prepared(t) if prepare else t) for t in texts]
        bad = [x for x in zip(texts, want, got) if x[1] != x[2]]
        assert not bad, (len(bad), bad[:3])


@pytest.mark.parametrize("rows, size", [(1, 1 << 20), (7, 1 << 20), (1 << 12, 100)])
def test_slices(monkeypatch, rows, size):
    """Where slices end, and that what looks like a word across the border of two texts is none."""
    monkeypatch.setattr(batches, "SLICE_ROWS", rows)
    monkeypatch.setattr(batches, "SLICE_BYTES", size)
    texts = [*EDGES, "ends with met", "ric=5 begins", "x metric=5", *commands()] * 2
    want = [None if t is None else rules.rewrite_but_payloads(t) for t in texts]
    assert batches.ruled_batch(pa.array(texts), False).to_pylist() == want
    assert batches.ruled_batch(pa.array(["skip", *texts, "skip"]).slice(1, len(texts)), False).to_pylist() == want
    assert batches.ruled_batch(pa.array([], pa.string()), True).to_pylist() == []


def test_rules_change_only_rows_that_are_looked_at():
    """Each text that a rule changes holds a literal of its, and its pattern without what that looks at."""
    texts = [x for x in dict.fromkeys([*filter(None, EDGES), *odd(), *commands(), *mixed(800, 14)]) if x.isascii() and x.isprintable()]
    for step in batches.steps():
        if not isinstance(step, str):
            changed = [t for t in texts if step.rule.pattern.sub(step.rule.replacement, t) != t]
            missed = [t for t, found in zip(changed, batches._matches(pa.array(changed, pa.string()), step.loose)) if not found]
            without = [t for t in changed if step.literals and not any(w.decode() in (t.lower() if step.any_case else t) for w in step.literals)]
            assert not missed and not without, (step.rule.name, missed[:2], without[:2])


def test_rules_are_no_expressions_of_the_plan(spark):
    """A distinct command passes the rules in one batch function; as expressions they took 2 ms of a core each."""
    df = spark.createDataFrame([("1", "ping 10.0.0.1")], "id string, text string")
    plan = parsing.rewritten(df, "text", "shape")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "regexp_replace" not in plan


def test_rows_meet_their_tree_without_their_text(spark):
    """The text goes into a digest where it is read, and no exchange carries it to its tree."""
    df = spark.createDataFrame([(i, f"ping 10.0.0.{i} -n {i}") for i in range(9)] + [(9, None), (10, "")], "id int, command_line string")
    out = clean.parsed(df.repartition(3)).select("id", "tree", "valid")
    rows = {r.id: (r.tree, r.valid) for r in out.collect()}
    assert len(rows) == 11 and rows[9] == (None, None) and rows[10] == ("null", False) and rows[3] == rows[4]
    joins = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    for k, v in joins.items():
        spark.conf.set(k, v)
    try:
        plan = clean.parsed(df).select("id", "tree", "valid")._jdf.queryExecution().executedPlan().toString()
    finally:
        for k in joins:
            spark.conf.unset(k)
    assert [x for x in plan.splitlines() if "Exchange" in x and "__row" in x] and plan.count("md5(cast(command_line") == 1 and plan.count("command_line") == 2, plan


def test_commands_inside_their_own_deep_parts(spark, monkeypatch):
    """Of a shape's commands, those whose text is that of a deep part are parsed on their own, and no others."""
    texts = [*odd(), *mixed(80, 15), "ping 10.0.0.1 -n 1", "ping 10.0.0.2 -n 2", "ping 10.0.0.3 -n 3"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, command_line string")
    shapes, lone, alone = parsing.shape_values, parsing.lone_values, []
    monkeypatch.setattr(parsing, "shape_values", lambda x: shapes(x).withColumn("deep", F.array(F.lit("ping 10.0.0.2 -n 2"), F.lit("echo"))))
    monkeypatch.setattr(parsing, "lone_values", lambda x: alone.extend(r.text for r in x.collect()) or lone(x))
    rows = clean.parsed(df).select("i", "tree").collect()
    bad = [(texts[r.i], r.tree, clean.parse_row(texts[r.i], None)[0]) for r in rows if r.tree != clean.parse_row(texts[r.i], None)[0]]
    assert len(rows) == len(texts) and not bad and alone == ["ping 10.0.0.2 -n 2"], bad[:2]


def test_judged_commands_meet_only_their_prediction(spark, monkeypatch):
    """What is stored of commands for the model is as wide as digests, whatever their length; each tree is judged once."""
    names, judged, keep, predict = {}, [], clean.stored, gnn.predict
    monkeypatch.setattr(clean, "stored", lambda df, name: names.update({name: df.columns}) or keep(df, name))
    monkeypatch.setattr(gnn, "predict", lambda graphs, *a, **k: judged.append(graphs.count()) or predict(graphs, *a, **k))
    commands = spark.createDataFrame([(i, f"ping 10.0.0.{i} -n {i} " + "long " * 50) for i in range(9)] + [(9, "whoami /all"), (10, None)], "id int, c string")
    model = gnn.Model("rgcn", runs.input_width(serving.SEMANTIC_WIDTH, True, True), hidden=8).start(7)
    out = serving.infer_commands(commands, "id", model, "all", command="c")
    rows = {r.graph_id: (r.pred, r.logit_0) for r in out.collect()}
    assert sorted(rows) == list(range(10)) and len({rows[i] for i in range(9)}) == 1 and rows[9] != rows[0] and judged == [2]
    assert "__raw" not in names["commands"] and {"__id", "__key"} <= set(names["commands"])
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("md5(cast(c#") == 1
