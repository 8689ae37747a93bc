"""The judged stream: as the batch job judges, over restarts, with exact counts, and trees judged once while they are remembered."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from quillon.operators import clean, gnn, runs, serving
from quillon.streaming import serving as live
from quillon.streaming.commands import write_stream

COMMANDS = ["cmd.exe /c dir c:\\temp a b c", "powershell -nop -w hidden x y z", "wmic process 55 get name a b", "cmd.exe /c echo a | findstr b", None, ""]
BEGIN = dt.datetime(2025, 1, 1)


@pytest.fixture
def rocks(spark):
    live.state_store(spark)
    yield
    spark.conf.unset(live.STORE)


def put(spark, folder, rows):
    spark.createDataFrame(rows, "source string, ts timestamp, command_line string").coalesce(1).write.mode("append").parquet(folder)


def model():
    return gnn.Model("gcn", runs.input_width(0, True, True), hidden=8).start(3)


def run(spark, tmp_path, **options):
    stream = spark.readStream.schema("source string, ts timestamp, command_line string").option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    query = write_stream(live.judged_stream(stream, model(), "syntactic_positional", lanes=2, **options), f"file://{tmp_path}/out", f"file://{tmp_path}/checkpoint")
    query.awaitTermination()
    return spark.read.parquet(f"file://{tmp_path}/out")


def test_as_the_batch_job_over_restarts(spark, tmp_path, rocks):
    rows = [(("a", "b", None)[k % 3], BEGIN + dt.timedelta(minutes=k), COMMANDS[k % len(COMMANDS)]) for k in range(36)]
    for lo in (0, 12):
        put(spark, f"file://{tmp_path}/in", rows[lo : lo + 12])
    run(spark, tmp_path)
    put(spark, f"file://{tmp_path}/in", rows[24:])
    out = run(spark, tmp_path).collect()  # goes on from its checkpoint
    every = clean.parsed(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "key int, source string, ts timestamp, command_line string"))
    batch = {r.graph_id: r for r in serving.infer(every, "key", model(), "syntactic_positional").collect()}
    want = sorted((rows[k][0] or "", rows[k][1], rows[k][2], r.pred, round(r.logit_0, 9)) for k, r in batch.items())
    judged = [r for r in out if r.kind == "judged"]
    assert sorted((r.source, r.ts, r.command_line, r.pred, round(r.logit_0, 9)) for r in judged) == want
    skipped = {s: sum(r.commands for r in out if r.kind == "skipped" and r.source == s) for s in ("a", "b", "")}
    assert skipped == {s: sum(1 for k, r in enumerate(rows) if (r[0] or "") == s and k not in batch) for s in skipped} and sum(skipped.values()) > 0
    assert sorted(r.source + r.tree_id for r in judged if r.first) == sorted({r.source + r.tree_id for r in judged})  # new once per source, over the restart, too
    again = run(spark, tmp_path)
    assert again.count() == len(out)


def test_trees_are_forgotten_by_event_time(spark, tmp_path, rocks):
    first = COMMANDS[0]
    for minutes in (0, 30, 300, 301, 302):
        put(spark, f"file://{tmp_path}/in", [("a", BEGIN + dt.timedelta(minutes=minutes), first if minutes != 300 else COMMANDS[1])])
    out = run(spark, tmp_path, late="1 minute", forget_ms=3_600_000).where(F.col("command_line") == first).orderBy("ts").collect()
    assert [r.first for r in out] == [True, False, True, False] and len({(r.pred, r.logit_0) for r in out}) == 1
