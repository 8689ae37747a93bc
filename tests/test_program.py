"""The rewrite program as columns against the plain one, rule by rule and as a whole."""

import csv
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from quillon.functions import program, rules
from quillon.plans import examples

HERE = Path(__file__).parent / "fixtures"


def commands():
    out = []
    for name in ("clean", "malware", "test_clean", "test_malware"):
        with (HERE / f"{name}.csv").open(newline="", encoding="utf-8") as f:
            out += [r["command_line"] for r in csv.DictReader(f)]
    return out + [g.replace("{n}", "17") for _, g, _ in examples.RULES] + [r[0].replace("{n}", "23") for r in examples.COMMANDS]


def mixed(n, seed=1):
    """Pieces of all examples, put together at random: what one rule leaves meets the next."""
    rng = random.Random(seed)
    words = sorted({w for c in commands() for w in c.split(" ")})
    return [rng.choice(["cmd.exe ", "powershell.exe ", "msbuild ", "git ", "wmic ", "wscript ", "", "/"]) + rng.choice([" ", "  ", '"']).join(rng.choices(words, k=rng.randint(1, 9))) for _ in range(n)]


def test_each_rule(spark):
    """Every rule on every text, with both snapshots set."""
    texts = commands() + mixed(60)
    table = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").repartition(4)
    names = list(rules.RULES)
    rows = table.select("i", *(program.one(n, F.col("t"), F.lower("t"), F.contains("t", F.lit("/"))).alias(n) for n in names)).collect()
    bad = []
    for r in rows:
        for n in names:
            s = rules.State(texts[r.i], texts[r.i].lower(), "/" in texts[r.i])
            rules.RULES[n](s)
            if s.text != r[n]:
                bad.append((n, texts[r.i], s.text, r[n]))
    assert not bad, (len(bad), sorted({b[0] for b in bad}), bad[:3])


def test_whole_program(spark):
    texts = commands() + mixed(1500, 2)
    rows = program.rewrite(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").repartition(8), "t", "out").collect()
    bad = [(texts[r.i], rules.rewrite(texts[r.i]), r.out) for r in rows if rules.rewrite(texts[r.i]) != r.out]
    assert len(rows) == len(texts) and not bad, (len(bad), bad[:4])
