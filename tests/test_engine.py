"""Parsing, unique tables, sources, streams: against goldens and by properties."""

import base64
import gzip
import json
from pathlib import Path

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from quillon.functions import cmdline, decode, native, paths, rules
from quillon.operators import clean, features, graph, learn, runs, split
from quillon.sources import files
from quillon.streaming import commands

HERE = Path(__file__).parent / "fixtures"


@pytest.mark.parametrize("name", ["clean", "malware", "test_clean", "test_malware"])
def test_unique_table_is_golden(spark, name):
    out = clean.make_unique(files.read_commands(spark, f"file://{HERE}/{name}.csv")).select("command_line").orderBy(F.desc("command_line"))
    want = files.read_csv(spark, f"file://{HERE}/{name}_unique.csv")
    assert [r[0] for r in out.collect()] == [r[0] for r in want.collect()]


def test_occurrences_nulls_and_errors(spark):
    rows = [("cmd.exe /c dir one two three four", "cmd.exe", 2), ("CMD.exe /c dir one two three four", "cmd.exe", 5), (None, "x", 1), ("a", None, 3), ("日本語日本語", "p", 1)]
    df = spark.createDataFrame(rows, "command_line string, process_name string, total_occurrences long")
    assert [(r.total_occurrences, r.command_line) for r in clean.make_unique(df).collect()] == [(7, "('cmd.exe', '/c', 'dir', 'one', 'two', 'three', 'four')")]
    parsed = {r.command_line: r for r in clean.parsed(df, process="process_name").collect()}
    assert parsed[None].tree is None and parsed["日本語日本語"].tree == '"p"' and not parsed["a"].valid
    assert clean.make_unique(df.limit(0)).count() == 0


@pytest.mark.parametrize(
    ("command", "want"),
    [
        ('a.exe "b c" d\\"e f\\\\"g h"', ["a.exe", "b c", 'd"e', "f\\g h"]),
        ('"C:\\p q\\x.exe" "a""b" "" z', ["C:\\p q\\x.exe", 'a"b', "", "z"]),
        ("   ", []),
        ('x "unclosed y', ["x", "unclosed y"]),
        ("x a\\\\b \\\\host", ["x", "a\\\\b", "\\\\host"]),
    ],
)
def test_windows_split(command, want):
    assert cmdline.split_windows(command) == want


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("ping 10.0.0.1 and 8.8.8.8:53", "ping <int_ip> and <ext_ip>:<port>"),
        ("mail a.b@c.example.de now", "mail <email> now"),
        ("C:\\Users\\bob\\x\\y\\note.txt z", "<Users>\\<path>\\.txt z"),
        ("id 550e8400-e29b-41d4-a716-446655440000", "id <guid>"),
        ("set S-1-5-21-1-2 at 1700000000", "set <SID> at <timestamp>"),
        ("run /a/b/c", "run  /a /b /c"),
        ("fe80::1 ok", "<int_ip> ok"),
        ("HKLM\\Software x", "HKLM\\Software x"),
    ],
)
def test_rules(text, want):
    assert rules.rewrite(text) == want


def test_rule_table_is_whole():
    numbers = [r.number for r in rules.PROGRAM if isinstance(r, rules.Rule)]
    assert sorted(set(numbers)) == list(range(2, 121)) and numbers == sorted(numbers)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("cmd.exe C:\\a\\b ~1 @ user=x 20250102 10:11 AM ://h http://x.com/y 1.2.3.4 fe80::1 -p 1:2 $a =1 %V%\\x ../q.sh sleep 5 a-b \\\\h\\s /a/b ^& `n ( .ssh/x tcp:h,1 /ST 10:10 find 12 guid".split(" ")), max_size=12))
def test_literals_change_nothing(parts):
    text = " ".join(parts)
    s = rules.State(text)
    gate = True
    for step in rules.PROGRAM:
        if isinstance(step, str):
            rules.MARKS[step](s)
            continue
        if step.number not in rules._SHARED_GATE:
            gate = step.gate is None or step.gate(s)
        if gate:
            s.text = step.pattern.sub(step.replacement, s.text)
    assert rules.rewrite(text) == s.text.strip()


def test_payloads():
    text = "Write-Host 'hello world'"
    for data in (text.encode("utf-16-le"), text.encode(), gzip.compress(text.encode())):
        assert decode.payload_text(base64.b64encode(data).decode()) == text
    assert decode.payload_text("") is None and decode.payload_text(base64.b64encode(b"\x01").decode()) is None
    tree = cmdline.parse("powershell.exe -enc " + base64.b64encode("Get-ChildItem C now".encode("utf-16-le")).decode())
    assert tree == ["powershell.exe", "-enc", ("get-childitem", "c", "now")]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab1 \\/\"'<>|&.-:%$,;*?C^`é", max_size=60))
def test_parser_ends_and_lowers(command):
    tree = cmdline.parse(command)
    assert all(leaf == leaf.lower() for leaf in cmdline.flat(tuple(tree)))
    nodes = clean.arena(tuple(tree))
    assert all(p < i for i, p, *_ in nodes) and nodes[0][4] == len(nodes)


def test_arena_and_edges(spark):
    tree = ("cmd", ("a", "b"), (("c",),), "d")
    df = spark.createDataFrame([(1, json.dumps(tree))], "id int, t string").select("id", F.lit(None).alias("x"))
    nodes = spark.createDataFrame([(1, *n) for n in clean.arena(tree)], "graph_id int, idx int, parent int, pos int, depth int, subtree int, value string")
    assert [r.value for r in nodes.orderBy("idx").collect()] == ["cmd", "<subcommand>", "a", "b", "c", "d"]
    edges = {(r.src, r.dst, r.type) for r in graph.edges(nodes).collect()}
    assert {(0, 1, 0), (0, 4, 0), (1, 4, 1), (4, 5, 1), (0, 1, 1), (1, 2, 1), (2, 3, 1)} <= edges
    assert {(b, a) for a, b, t in edges if t == 1} == {(a, b) for a, b, t in edges if t == 3} and sum(t == 4 for *_, t in edges) == 6
    assert {r.type for r in graph.ablate(graph.edges(nodes), "self_loops_parent_child").collect()} == {0, 1, 2}
    assert df.count() == 1


def test_native_rules_match_python(spark):
    texts = ["mail a@b.co port=80 --port 9 kill-port 5 findstr :7", "wmic process 12 ProcessId=4 -eq 9 chcp 850 metric=3", "plain", "x 1700000000 http://a.b/c"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for name in ("email", "port_option", "port_equals", "wmic_process", "process_id", "compare", "timestamp", "url"):
        got = {r.t: r.o for r in df.select("t", native.apply(F.col("t"), name).alias("o")).collect()}
        for t in texts:
            s = rules.State(t, t.lower())
            rules.RULES[name](s)
            assert got[t] == s.text, (name, t)


def test_paths_native_matches_python(spark):
    names = ["a.txt", "run.exe", "x.123", "y.extension9", "v.txt@2", "job77", "123", "1700000000", "", "a.b.c"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    for keep in (True, False):
        got = {r.n: r.o for r in df.select("n", native.short_name(F.col("n"), keep).alias("o")).collect()}
        assert got == {n: paths.short_name(n, keep) for n in names}


def worth_keeping(tokens):
    """The filter in plain words: long enough for what it names, no bare host, no mark alone, no assignment."""

    def file(t):
        stem, dot, end = t.partition(".")
        short = dot and "." not in end and (len(end) < 5 or stem[-1:] in ("\\", "/") and stem)
        return short or any(t.endswith(x) for x in clean.PROGRAMS) or any(x in t for x in clean.FILE_TAGS)

    head = tokens[0].strip("\\")
    if len(tokens) < 4 or (len(tokens) < 6 and any(file(t) for t in tokens[1:])):
        return False
    if head[:1].isdigit() or any(head.startswith(x) for x in ("<int_ip>", "<ext_ip>", "<host>")):
        return False
    return not (tokens[0] in ("//", "x") or tokens[0].startswith("//--") or (tokens[1] == "=" and tokens[0][:1] in ("%", "$")))


def test_token_filter_matches_plain(spark):
    import random

    r = random.Random(1)
    pool = ["a", "b.txt", ".ps1", "x.exe", "<path>\\.md", "c", "=", "%v", "//", "x", "<int_ip>", "9a", "long.extension", "d\\.abcdefgh", "//--q", "$e"]
    rows = [[r.choice(pool) for _ in range(r.randint(1, 8))] for _ in range(300)]
    got = spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, w array<string>").select("i", clean.valid_tokens(F.col("w")).alias("v")).collect()
    assert {g.i: g.v for g in got} == {i: worth_keeping(x) for i, x in enumerate(rows)}


def test_features_of_empty_text(spark):
    df = spark.createDataFrame([("",), (None,)], "t string")
    f = features.manual_features(F.col("t"))
    assert len(f) == 43
    assert all(set(r) == {0.0} for r in df.select(*f.values()).collect())
    assert len(features.token_features(F.col("t"))) == 15
    assert spark.createDataFrame([("aab",)], "t string").select(features.entropy(F.col("t"))).first()[0] == pytest.approx(0.918296, abs=1e-6)


def test_split_is_stratified(spark):
    df = spark.range(1000).select(F.col("id").alias("k"), (F.col("id") % 4 == 0).cast("int").alias("label"))
    out = split.stratified_split(df, "k", 7, 0.3)
    assert {(r.label, r["count"]) for r in out.where("is_test").groupBy("label").count().collect()} == {(0, 225), (1, 75)}


def test_grams(spark):
    df = spark.createDataFrame([("ab cd",)], "t string")
    assert df.select(learn.char_grams(F.col("t"), 3, 4)).first()[0] == ["ab ", "b c", " cd", "ab c", "b cd"]
    assert df.select(learn.char_grams(F.col("t"), 3, 3, True)).first()[0] == [" ab", "ab ", " cd", "cd "]
    assert df.select(learn.word_grams(F.col("t"))).first()[0] == ["ab", "cd", "ab cd"]
    train = spark.createDataFrame([("good fine", 0), ("bad evil", 1)] * 10, "t string, label int")
    model, terms = learn.tfidf_logistic(train, "t")
    assert model.transform(train.withColumn("terms", terms)).where("prediction <> label").count() == 0


def test_sources(spark, tmp_path):
    root = f"file://{tmp_path}"
    files.write_csv(spark.createDataFrame([('a\\b "q"', 1), (None, 2)], "command_line string, n int"), f"{root}/t", single=True)
    back = files.read_csv(spark, f"{root}/t")
    assert {tuple(r) for r in back.collect()} == {('a\\b "q"', "1"), (None, "2")}
    assert files.read_with_path(spark, f"{root}/t").columns[-1] == "summary_path"
    (tmp_path / "runs/2025/0.3/seed4/all/all/org_m/semantic_only").mkdir(parents=True)
    (tmp_path / "runs/2025/0.3/seed4/all/all/org_m/semantic_only/RGCN_ce_model.pt").write_bytes(b"x")
    run = runs.parsed_runs(files.find_models(spark, f"{root}/runs")).first()
    assert (run.seed, run.model, run.loss, run.embedder, run.test_size) == (4, "RGCN", "ce", "org/m", 0.3)
    calls = []
    make = lambda: calls.append(1) or spark.range(3)
    for _ in range(2):
        assert files.cached(spark, root, files.split_name(1, 0.3, "a", "b"), make).count() == 3
    assert len(calls) == 1


def test_stream(spark, tmp_path):
    rows = [("cmd.exe /c dir one two three four", "2025-01-01 00:00:00"), ("cmd.exe /c dir one two three four", "2025-01-01 00:01:00"), ("x", "2025-01-01 00:02:00")]
    spark.createDataFrame(rows, "command_line string, ts string").withColumn("ts", F.to_timestamp("ts")).write.parquet(f"file://{tmp_path}/in")
    stream = commands.first_seen(commands.parsed_stream(commands.read_stream(spark, f"file://{tmp_path}/in")))
    commands.write_stream(stream.select("tree", "valid"), f"file://{tmp_path}/out", f"file://{tmp_path}/cp").awaitTermination()
    assert sorted(r.valid for r in spark.read.parquet(f"file://{tmp_path}/out").collect()) == [False, True]
