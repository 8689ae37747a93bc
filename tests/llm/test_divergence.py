"""The divergence audit against plain sums over all terms and pairs: many small blocks, many sources, ties, odd rows."""

import random
import re
from collections import Counter, defaultdict

import pytest
from quillon.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def plain(rows, min_docs=3, top=200):
    """rows: (text, lang, source). The audit's rows, from dense tables."""
    counts, df = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        words = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in TERM.findall(text or "")]
        counts[lang or "", source or ""].update(words)
        df[lang or ""].update(set(words))
    out = []
    for lang in df:
        kept = sorted(w for w, n in df[lang].items() if n >= min_docs)
        sources = sorted(s for x, s in counts if x == lang)
        total = {s: sum(counts[lang, s][w] for w in kept) for s in sources}
        whole = {w: sum(counts[lang, s][w] for s in sources) for w in kept}
        p = {s: {w: 1 + 10**9 * (counts[lang, s][w] + 1) // (total[s] + len(kept)) for w in kept} for s in sources}
        q = {w: 1 + 10**9 * (whole[w] + 1) // (sum(whole.values()) + len(kept)) for w in kept}
        f = lambda a, b: (a - b) * (a - b) // b
        for s in sources:
            pairs = sorted((-sum(f(p[s][w], p[o][w]) for w in kept), o.encode(), o) for o in sources if o != s)
            terms = sorted((-f(p[s][w], q[w]), w.encode(), w) for w in kept if counts[lang, s][w] and p[s][w] > q[w])[:top]
            for part, found in (("pair", pairs), ("term", terms)):
                out += [(lang, s, part, item, -v, r) for r, (v, _, item) in enumerate(found, 1)]
    return sorted(out)


def audit(spark, rows, **options):
    table = spark.createDataFrame(rows, "text string, lang string, source string").repartition(4)
    out = divergence.audit(table, **options)
    assert out.columns == ["lang", "source", "part", "item", "value", "rank"] and dict(out.dtypes)["value"] == "bigint" and dict(out.dtypes)["rank"] == "int"
    return sorted(tuple(r) for r in out.collect())


@pytest.mark.parametrize("block_bytes,at_once", [(1 << 20, 1 << 21), (400, 7)])
def test_against_plain(spark, monkeypatch, block_bytes, at_once):
    monkeypatch.setattr(divergence, "PAIRS_AT_ONCE", at_once)
    rng = random.Random(4)
    vocabulary = [f"{a}{b}" for a in "abcdefghé" for b in ("x", "Y", "zz", "ß")]
    rows = [("-".join(rng.choices(vocabulary[i % 5 :], [1 / (j + 1) for j in range(len(vocabulary) - i % 5)], k=rng.randint(1, 40))), f"l{i % 2}", f"s{i * i % 13}") for i in range(300)]
    assert audit(spark, rows, block_bytes=block_bytes, top_terms=5) == plain(rows, top=5)


def test_odd_rows(spark):
    """Null and empty values are one group; a source without terms, a language that keeps none, a source of one language alone, one very long text, repeated rows, digits and marks that cut terms."""
    rows = [(None, None, None), ("", "", ""), ("A b", "en", "one"), ("A b", "en", "one"), ("a1b_a", "en", "two"), ("...", "en", "three"), ("unique words", "xx", "one"), ("other", "xx", "two"), ("solo solo", "yy", "one"), ("solo", "yy", "one"), ("solo", "yy", "one"), ("a " * 300000 + "long", "en", "four"), ("É é É", "fr", None), ("É é", "fr", "z"), ("É", "fr", "z")]
    assert audit(spark, rows) == plain(rows)


def test_empty_and_extra_columns(spark):
    assert audit(spark, []) == []
    rows = [("a b", "en", "one"), ("a", "en", "two"), ("a c", "en", "two")]
    table = spark.createDataFrame([(*r, 5, "x", 1) for r in rows], "text string, lang string, source string, n long, term string, rank int")
    assert sorted(tuple(r) for r in divergence.audit(table).collect()) == plain(rows)


def test_large_counts_stay_exact(spark):
    """10^9 (n+1) passes 64 bits from 9.2 thousand million occurrences on."""
    row = spark.sql("SELECT CAST(50000000000000 AS BIGINT) AS n, CAST(70000000000001 AS BIGINT) AS total, CAST(123 AS BIGINT) AS v")
    from pyspark.sql import functions as F

    assert row.select(divergence._p(F.col("n"), F.col("total"), F.col("v"))).first()[0] == 1 + 10**9 * (50000000000000 + 1) // (70000000000001 + 123)
