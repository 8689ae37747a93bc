import functools
import math
import zlib
from collections import Counter, defaultdict

import brute
import pytest
from pyspark.sql import functions as F
from quillon.llm import katz


def plain_katz(docs, order):
    """docs: (id, text, held). {id: (n_tokens, n_known, base, score)} and the model, by dictionaries."""
    tokens = {i: [*brute.SPACED.findall(brute.lower(t or "")), None] for i, t, _ in docs}
    counts = [defaultdict(Counter) for _ in range(order)]  # counts[n - 1][context][word]
    for i, _, held in docs:
        if not held:
            padded = ["<"] * (order - 1) + tokens[i]
            for k, w in enumerate(tokens[i]):
                for n in range(order):
                    counts[n][tuple(padded[k + order - 1 - n : k + order - 1])][w] += 1
    factors = [katz.discounts([sum(c == r for x in level.values() for c in x.values()) for r in range(1, katz.LIMIT + 2)]) for level in counts]

    n_tokens = sum(counts[0][()].values())

    def cut(n, c):
        return c * (factors[n][c] if c <= katz.LIMIT else 1.0)

    @functools.cache
    def below(context):
        return sum(p(x, context[1:]) for x in counts[len(context)][context])

    @functools.cache
    def kept_of(context):
        return sum(cut(len(context), c) for c in counts[len(context)][context].values())

    def p(w, context):
        n = len(context)
        seen = counts[n].get(context, {})
        if n == 0:
            total = n_tokens
            freed = total - kept_of(())
            if freed <= 0:
                total, freed = total + 1, 1
            return cut(0, seen[w]) / total if w in seen else freed / total
        if not seen:
            return p(w, context[1:])
        total = sum(seen.values())
        kept = kept_of(context)
        if total - kept < 1e-9 * total:
            total += 1
        if w in seen:
            return cut(n, seen[w]) / total
        return (1 - kept / total) / (1 - below(context)) * p(w, context[1:])

    uni = counts[0][()]
    total, kinds = sum(uni.values()), len(uni)
    out = {}
    for i, _, _ in docs:
        padded = ["<"] * (order - 1) + tokens[i]
        out[i] = (
            len(tokens[i]),
            sum(uni[w] > 0 for w in tokens[i]),
            sum(math.log10((uni[w] + 0.1) / (total + 0.1 * (kinds + 1))) for w in tokens[i]),
            sum(math.log10(p(w, tuple(padded[k : k + order - 1]))) for k, w in enumerate(tokens[i])),
        )
    return out, p, uni, counts


def rows(n):
    import random

    r = random.Random(5)
    words = [f"W{int(r.paretovariate(0.7))}é" for _ in range(4000)]
    docs = [(i, " ".join(r.choices(words, k=r.randint(0, 60))), zlib.crc32(str(i).encode()) % 10 == 0) for i in range(n)]
    return [*docs, (n, None, False), (n + 1, "", False), (n + 2, "never seen words\tat\nall", True)]


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_against_plain(spark, order):
    docs = rows(120)
    df = spark.createDataFrame(docs, "doc_id long, text string, held boolean").repartition(3)
    got = {r.doc_id: r for r in katz.score_texts(df, F.col("held"), order=order, chunk_bytes=2000, part_tokens=700).collect()}
    want, p, uni, counts = plain_katz(docs, order)
    assert len(got) == len(docs)
    for i, (n, known, base, score) in want.items():
        assert (got[i].n_tokens, got[i].n_known) == (n, known)
        assert got[i].base_score == pytest.approx(base, rel=1e-9)
        assert got[i].score == pytest.approx(score, rel=1e-9)
    if order == 2:  # exactly normalised: known words and one unknown word
        for context in list(counts[1])[:20]:
            assert sum(p(w, context) for w in uni) + p("no such word", context) == pytest.approx(1)


def test_tables_score_other_texts(spark):
    """Texts that were not there when the model was made get what they would have got as held-out rows."""
    docs = rows(60)
    new = [(1000 + i, t, True) for i, t, _ in rows(25)]
    schema = "doc_id long, text string, held boolean"
    together = {r.doc_id: r for r in katz.score_texts(spark.createDataFrame(docs + new, schema), F.col("held"), chunk_bytes=2000, part_tokens=700).collect()}
    _, model = katz.fit_and_score(spark.createDataFrame(docs, schema), F.col("held"), chunk_bytes=3000, part_tokens=500)
    alone = {r.doc_id: r for r in katz.score_with(model, spark.createDataFrame(new, schema), chunk_bytes=1500).collect()}
    assert len(alone) == len(new)
    for i, r in alone.items():
        assert (r.n_known, r.train_tokens) == (together[i].n_known, together[i].train_tokens)
        assert r.score == pytest.approx(together[i].score, rel=1e-9) and r.base_score == pytest.approx(together[i].base_score, rel=1e-9)


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a b", False, 5, 6.0)], "doc_id long, text string, held boolean, chunk int, score double")
    assert katz.score_texts(df, F.col("held")).columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]


def test_empty_and_repeated(spark):
    df = spark.createDataFrame([], "doc_id long, text string, held boolean")
    assert katz.score_texts(df, F.col("held")).count() == 0
    df = spark.createDataFrame([(1, "a b", False)] * 3 + [(None, "a b", None)], "doc_id long, text string, held boolean")
    got = katz.score_texts(df, F.col("held")).collect()
    assert len(got) == 4 and {r.train_tokens for r in got} == {12} and len({r.score for r in got}) == 1


def fitted(n):
    """Katz's factors of a line through log r, log n[r], by plain sums."""
    x, y = [math.log(r) for r in range(1, 7)], [math.log(c) for c in n]
    mx, my = sum(x) / 6, sum(y) / 6
    slope = sum((a - mx) * (b - my) for a, b in zip(x, y)) / sum((a - mx) ** 2 for a in x)
    rest = 6 ** (slope + 1)
    return [(((r + 1) / r) ** (slope + 1) - rest) / (1 - rest) for r in range(1, 6)]


def test_discounts():
    plain = [1000, 400, 210, 130, 90, 66]
    rest = 6 * 66 / 1000
    assert katz.discounts(plain)[1:].tolist() == pytest.approx([((r + 1) * plain[r] / (r * plain[r - 1]) - rest) / (1 - rest) for r in range(1, 6)])
    copies = [100000, 15000, 4000, 1904, 2579, 900]  # more of count 5 than of count 4
    assert katz.discounts(copies)[1:].tolist() == pytest.approx(fitted(copies))
    for n in (copies, [0, 900, 0, 200, 0, 70], [500, 0, 0, 0, 0, 0], [500, 20, 0, 0, 30, 0], [10, 10, 10, 10, 10, 10], [5, 6, 7, 8, 9, 50]):
        d = katz.discounts(n)[1:]
        assert ((d > 0) & (d < 1)).all(), n
    assert katz.discounts([0, 0, 0, 3, 0, 0]).tolist() == [1] * 6  # one count alone: nothing to learn from


def test_copies_are_discounted(spark):
    """Bigrams of a text with groups of copies: the scores are those of discounted counts."""
    docs = [(i, t, False) for i, t in enumerate([*(f"a{i} b{i}" for i in range(100)), *(f"a{i} b{i}" for i in range(30)), *(f"c{i % 20} d{i % 20}" for i in range(60)), *(f"f{i % 2} g{i % 2}" for i in range(8)), *(f"h{i % 9} i{i % 9}" for i in range(45)), *["x y"] * 6])]
    got = {r.doc_id: r.score for r in katz.score_texts(spark.createDataFrame([*docs, (999, "a99 i0", True)], "doc_id long, text string, held boolean"), F.col("held"), order=2).collect()}
    # each word of these is seen in one context: a gram of count r, of total r, has its factor as probability, but for the first word
    n1, n = [70, 30, 20, 2, 9, 1], sum((70, 60, 60, 8, 45, 6))
    first, inner = fitted([70, 30, 20, 2, 9, 1]), fitted([140, 60, 40, 4, 18, 2])
    assert sum(r * c for r, c in zip(range(1, 7), n1)) == n
    assert 10 ** got[99] == pytest.approx(first[0] / n * inner[0] ** 2)
    assert 10 ** got[160] == pytest.approx(3 * first[2] / n * inner[2] ** 2)
