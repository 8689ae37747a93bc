"""Features, trees and calibration of the toxicity scorer against plain Python."""

import itertools
import math
import random
import re

import brute
import numpy as np
import pyarrow as pa
import pytest
from quillon.llm import toxicity, vectext

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
MASKED = re.compile(rb"[a-z0-9@$!*._\-]+")


def hash_of(word: bytes, prefix: int | None = None) -> int:
    if prefix is None:
        (block,) = vectext.blocks(pa.array([word.decode("utf-8")]))
        return int(vectext.word_hashes(block[2], block[3], vectext.ALNUM)[0][0])
    data = np.frombuffer(word, np.uint8)
    for words, h in vectext.prefixes(data, np.array([0]), np.array([len(word)]), range(prefix, prefix + 1)):
        return int(h[0])


def lexicon_of(words, beginnings):
    """odds by word and by word beginning, and the same as the operator has them."""
    odds = {hash_of(w): v for w, v in words.items()} | {hash_of(b + b"zz", len(b)): v for b, v in beginnings.items()}
    return toxicity.Lexicon(odds)


def plain_features(text, words, beginnings):
    low = brute.lower(text or "").encode()
    raw = (text or "").encode()
    tokens = WORD.findall(low)
    score = lambda w: max([0.0, words.get(w, 0.0), *(beginnings.get(w[:k], 0.0) for k in range(3, 10) if k < len(w))])
    scores = [score(w) for w in tokens]
    n = max(1, len(tokens))
    top = sorted((s for s in scores if s > 0), reverse=True)[:3] + [0.0] * 3
    hot = [i for i, s in enumerate(scores) if s >= 3]
    second = [i for i, w in enumerate(tokens) if w.decode() in toxicity.SECOND]
    near = sum(any(abs(i - j) <= 5 for j in second) for i in hot) / max(1, len(hot))
    masked = []
    for run in MASKED.findall(low):
        if len(re.findall(rb"[a-z]+", run)) >= 2:
            plain = run.translate(bytes.maketrans(b"013457@$!", b"oieastasi"), b"*._-")
            masked.append(score(plain))
    kinds = [sum(toxicity.CLASSES[b] == k for b in raw) for k in range(9)]
    size = max(1, len(raw))
    runs = sum(raw[i] == raw[i - 1] == raw[i - 2] and bytes([raw[i]]).isalpha() for i in range(2, len(raw)))
    return [
        math.log1p(len(tokens)), sum(s for s in scores if s >= 2) / n, *top[:3], *(math.log1p(sum(s >= k for s in scores)) for k in (2, 3, 4, 5)), len(hot) / n, near, len(second) / n, len(masked) / n,
        math.log1p(sum(s >= 3 for s in masked)), max(masked, default=0.0), kinds[1] / max(1, kinds[1] + kinds[2] + kinds[8]), kinds[4] / size, kinds[5] / size, kinds[6] / size, kinds[3] / size, kinds[8] / size, runs / n, len(raw) / n,
    ]


def test_features_against_plain():
    r = random.Random(3)
    pool = ["you", "Vile", "vileness", "scum", "sc0undrel", "s.c.u.m", "it's", "élan", "tú", "AAAA", "loooud!!", "x-ray", "12", "a1", "1a", "@home", "no", "der", "dich", "rotten", "rot", "...", "$$$", "b@d", "--", "e.g."]
    words, beginnings = {b"vile": 4.0, b"scum": 5.5, b"rotten": 2.5, b"bad": 3.0}, {b"scou": 3.5, b"vile": 2.0, b"rot": 1.2}
    texts = [None, "", " ", "a", "aaa", "1", *(" ".join(r.choice(pool) + r.choice(["", ",", "\n", "\t"]) for _ in range(r.randint(0, 40))) for _ in range(300)), " ".join(r.choices(pool, k=60000))]
    got = toxicity.features(pa.array(texts), lexicon_of(words, beginnings))
    assert got.shape == (len(texts), len(toxicity.NAMES))
    for t, x in zip(texts, got):
        assert x == pytest.approx(plain_features(t, words, beginnings), abs=1e-12), t


def test_isotonic_is_the_least_squares_one():
    r = np.random.default_rng(1)
    for n in (1, 2, 7, 60):
        x, y = np.sort(r.normal(size=n)), (r.random(n) < 0.4).astype(float)
        means = lambda i, j: y[i : j + 1].mean()
        want = [max(min(means(i, j) for j in range(k, n)) for i in range(k + 1)) for k in range(n)]
        knots = toxicity.isotonic(x, y)
        # at the mean of a pooled block the fit is the block's value
        blocks = [(float(x[[i for i, _ in g]].mean()), v) for v, g in ((v, list(g)) for v, g in itertools.groupby(enumerate(want), key=lambda t: t[1]))]
        assert np.interp([b[0] for b in blocks], *knots) == pytest.approx([b[1] for b in blocks])
        assert (np.diff(knots[1]) > 0).all()


def test_first_tree_is_the_best_split():
    r = np.random.default_rng(2)
    x = r.normal(size=(300, 3))
    y = ((x[:, 1] > 0.3) ^ (r.random(300) < 0.1)).astype(float)
    t = toxicity.Trees(n_trees=1, depth=1, bins=8).fit(x, y)
    p = y.mean()
    g, h = y - p, np.full(300, p * (1 - p))
    best = (0.0, None)
    for j in range(3):
        for e in t.edges[j]:
            left = x[:, j] < e
            if min(left.sum(), (~left).sum()) >= t.least:
                gain = sum(g[s].sum() ** 2 / (h[s].sum() + t.ridge) for s in (left, ~left)) - g.sum() ** 2 / (h.sum() + t.ridge)
                best = max(best, (gain, (j, float(e))), key=lambda v: v[0])
    feature, cut, value = t.trees[0]
    assert (feature[0], t.edges[feature[0]][cut[0]]) == best[1]
    left = x[:, best[1][0]] < best[1][1]
    want = np.log(p / (1 - p)) + t.rate * np.where(left, g[left].sum() / (h[left].sum() + t.ridge), g[~left].sum() / (h[~left].sum() + t.ridge))
    assert t.raw(x) == pytest.approx(want)


def test_order_is_kept_within_a_step():
    s = toxicity.Scorer(toxicity.Lexicon({}), None, (np.array([0.0, 1.0]), np.array([0.2, 0.2])), 0.0)
    got = s.calibrated(np.array([-1.0, 0.0, 2.0]))
    assert (np.diff(got) > 0).all() and got == pytest.approx([0.2] * 3, abs=2e-6)


def test_clashing_columns_and_long_text(spark):
    rows = [(1, "word " * 400_000, 3, "x"), (2, None, 4, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int, predicted string")
    out = toxicity.score(docs, toxicity.Scorer(toxicity.Lexicon({}), None, (np.zeros(1), np.zeros(1)), 0.25))
    assert out.columns == ["doc_id", "text", "score", "predicted"] and [(r.score, r.predicted) for r in out.orderBy("doc_id").collect()] == [(0.25, 0)] * 2
