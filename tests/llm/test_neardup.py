"""Near duplicates that share only common content: every planted link of templated texts is found."""

import random

import brute
import pytest
from quillon.llm import neardup


def templated(n, pairs, seed=1, template=300, snippets=1000, own=25):
    """Texts of one template, two of some snippets that many texts each hold, and words of their own; pairs of texts with equal snippets. Similarity 0.864 within pairs, below 0.85 elsewhere."""
    rng = random.Random(seed)
    words = [f"t{i}" for i in range(template)]
    parts = [" ".join(f"s{k}x{i}" for i in range(5)) for k in range(snippets)]
    docs = []

    def text(i, two):
        return " ".join([*words[:150], parts[two[0]], *words[150:], parts[two[1]], *(f"o{i}w{j}" for j in range(own))])

    used = set()
    while len(docs) < n + 2 * pairs:
        two = tuple(rng.sample(range(snippets), 2))
        if two in used or two[::-1] in used:
            continue
        used.add(two)
        for _ in range(2 if len(docs) < 2 * pairs else 1):
            docs.append((len(docs), text(len(docs), two)))
    return docs


def test_no_link_is_lost_in_templated_texts(spark):
    docs = templated(4000, 300, snippets=230)  # some 40 texts a snippet
    a, b = brute.shingles(docs[0][1]), brute.shingles(docs[1][1])
    assert 0.85 < len(a & b) / len(a | b) < 0.88
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(8), percent=85).collect()}
    lost = [i for i in range(0, 600, 2) if not got[i] == got[i + 1] == i]
    assert not lost and all(got[i] == i for i in range(600, len(docs)))


@pytest.mark.parametrize("percent", [80, 85])
def test_components_by_brute_force_where_all_front_shingles_are_common(spark, percent, monkeypatch):
    """Small lists count as common, and seekers come in blocks, so that every pair goes the way of common shingles; the forest finds nothing."""
    monkeypatch.setattr(neardup, "LIST", 2)
    monkeypatch.setattr(neardup, "BLOCK", 3)
    nodes_only = lambda nodes, percent: nodes.sparkSession.createDataFrame([], "a long, b long")
    monkeypatch.setattr(neardup, "candidates", nodes_only)
    rng = random.Random(percent)
    docs = []
    for i in range(260):
        base = [f"b{i % 7}w{j}" for j in range(30 + 5 * (i % 3))]
        for _ in range(rng.choice([0, 1, 2, 3, 6])):
            base[rng.randrange(len(base))] = f"r{rng.randrange(40)}"
        docs.append((i, " ".join(base[: rng.choice([len(base), len(base) - 2, len(base) - 6])])))
    docs += [(1000, None), (1001, ""), (1002, "two words"), (1003, "two words")]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), percent=percent).collect()}
    assert got == brute.near_duplicates(docs, percent)
