"""Parsing by levels against the plain parser, which takes parts from a stack."""

import base64
import json

from pyspark.sql import functions as F
from quillon.functions import cmdline, native
from quillon.operators import parsing
from test_program import commands, mixed


def encoded(text):
    return base64.b64encode(text.encode("utf-16-le")).decode()


def odd():
    inner = 'cmd /c "echo a b c" > out.txt'
    deep = "whoami /all"
    for _ in range(4):
        deep = f"powershell -enc {encoded(deep)}"
    return [
        deep, f"powershell -e {encoded(inner)} && dir", "powershell [Convert]::FromBase64String('" + encoded("get-item x y z") + "') rest", "x FromBase64String(AAECAwQ=) y",
        'cmd.exe /c "cmd.exe /c ""echo one two"" | more"', "", '"', '""', "a", "   ", '"a b" "a b"', "echo é ü | findstr x >> y 2>&1", 'a "b c "d e" f" g', "x\ty\nz",
    ]


def test_prepared(spark):
    texts = [*odd(), *commands(), *mixed(300, 5), '"""a b"""', '"a"""', "a<b <c> <<d>>e", "<tag>>x", '""x"" y', "a 2>&1 b &> c 3>&- d"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", native.prepared(F.col("t")).alias("out")).collect()
    bad = [(texts[r.i], cmdline.prepared(texts[r.i]), r.out) for r in rows if cmdline.prepared(texts[r.i]) != r.out]
    assert not bad, (len(bad), bad[:3])


def test_levels(spark):
    texts = list(dict.fromkeys([*odd(), *commands(), *mixed(500, 6)]))
    rows = parsing.values(spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "id string, text string").repartition(6)).collect()
    assert len(rows) == len(texts)
    bad = []
    for r in rows:
        want = cmdline.parse(texts[int(r.id)])
        if r.error or ", ".join(r.items) != json.dumps(want, ensure_ascii=False)[1:-1] or r.leaves != [x for t in want for x in cmdline.flat(t)]:
            bad.append((texts[int(r.id)], want, r.items, r.error))
    assert not bad, (len(bad), bad[:3])


def test_too_many_levels_are_an_error(spark):
    texts = [("deep", 'x "echo a | more" y'), ("flat", "echo a")]
    rows = {r.id: r for r in parsing.values(spark.createDataFrame(texts, "id string, text string"), levels=1).collect()}
    assert "levels" in rows["deep"].error and rows["flat"].error is None and rows["flat"].leaves == ["echo", "a"]
    assert {r.error for r in parsing.values(spark.createDataFrame(texts, "id string, text string"), levels=3).collect()} == {None}
    assert parsing.values(spark.createDataFrame([], "id string, text string")).count() == 0


def test_commands_of_one_shape_are_split_once(spark, monkeypatch):
    """Numbers become tags, so these commands differ in nothing that is left: their parts are parsed once, not once a command."""
    seen, level = [], parsing._level
    monkeypatch.setattr(parsing, "_level", lambda parts: seen.append(parts.count()) or level(parts))
    texts = [f"cmd.exe /c wscript.exe pid {n} /try:{n % 7} {1000000000 + n} end" for n in range(2000, 2040)]
    rows = parsing.values(spark.createDataFrame([(t, t) for t in texts], "id string, text string")).collect()
    assert len(rows) == 40 and all(r.leaves == [x for t in cmdline.parse(r.id) for x in cmdline.flat(t)] for r in rows)
    assert seen and max(seen) <= 7


def test_commands_on_their_own(spark):
    """What commands take that stand inside their own deep parts."""
    texts = list(dict.fromkeys(x for x in [*odd(), *mixed(60, 9)] if x))
    rows = parsing.lone_values(spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "id string, text string")).collect()
    assert len(rows) == len(texts) and all(r.error or r.leaves == [x for t in cmdline.parse(texts[int(r.id)]) for x in cmdline.flat(t)] for r in rows)
    assert not any(r.error for r in rows)
