"""Lexical search against plain scoring: ties, copies, early stops, shards of any size, whole and partial indexes, odd rows."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F
from quillon.llm import lexical
from quillon.llm.common import fresh_path

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in TERM.findall(text or "")]


def plain(docs, queries, k):
    """[(query id, rank, doc id, score)] by scoring all documents."""
    bags = [(i, Counter(words(t))) for i, t in docs]
    bags = [(i, b) for i, b in bags if b]
    n_docs, n_terms = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(w for _, b in bags for w in b)
    out = []
    for q, text in queries:
        scores = []
        for i, b in bags:
            m = 100 - 25 + 25 * sum(b.values()) * n_docs // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (1_000_000_000 * b[w] // (1000 * b[w] + 12 * m)) for w in words(text) if w in b)
            if s > 0:
                scores.append((-s, i is None, i))
        out += [(q, r, i, -s) for r, (s, _, i) in enumerate(sorted(scores)[:k], 1)]
    return out


def found(df):
    return sorted(((r[0], r[1], r[2], r[3]) for r in df.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def ordered(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def corpus(n, seed=1):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    weights = [1 / (i + 1) for i in range(300)]
    docs = [(i, " ".join(rng.choices(vocabulary, weights, k=rng.choice([3, 20, 60])))) for i in range(n)]
    return docs + [(n + i, docs[5][1]) for i in range(40)], [(q, " ".join(rng.choices(vocabulary, weights, k=12))) for q in range(25)]


@pytest.mark.parametrize("shard_bytes,whole", [(1 << 20, True), (700, False), (20, True)])
def test_against_plain(spark, shard_bytes, whole):
    docs, queries = corpus(400)
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    asked = spark.createDataFrame(queries, "item_id long, text string")
    out = lexical.search_documents(table, asked, k=7, vocabulary_bytes=0 if whole else 1 << 20, shard_bytes=shard_bytes)
    assert out.columns == ["item_id", "rank", "doc_id", "score"] and [t for _, t in out.dtypes] == ["bigint", "int", "bigint", "bigint"]
    assert found(out) == plain(docs, queries, 7)


def test_early_stop_leaves_postings_and_changes_nothing():
    """A rare term settles the best documents, so the long list of a frequent one is not added up; results are those of a full pass."""
    rng = random.Random(2)
    docs = [(i, "the " * rng.randint(1, 4) + ("rare " * 3 if i % 500 == 0 else "") + f"x{i}") for i in range(4000)]
    texts = [t for _, t in docs]
    import numpy as np
    import pyarrow as pa

    row = lexical._shard(pa.array(range(4000)), lexical.terms.plain(pa.array(texts)), None)
    n_terms = sum(len(words(t)) for t in texts)
    shard = lexical.Shard(row, row["ids"], row["terms"], np.asarray(row["df"]), pa.array(["rare", "the"]), 4000, n_terms)
    query = [(0, math.floor(1000 * math.log(8002 / 17))), (1, 1)]
    stopped = lexical.search_shard(shard, query, 5, 0, 8)
    full = lexical.search_shard(shard, query, 5, 0, 1 << 30)
    assert stopped[2] < full[2] / 10 and [x.tolist() for x in stopped[:2]] == [x.tolist() for x in full[:2]]


def test_kept_index_in_blocks(spark):
    docs, queries = corpus(150, 3)
    index = lexical.build_index(spark.createDataFrame(docs, "doc_id long, text string"), fresh_path(spark, "kept-search-index"), shard_bytes=900)
    asked = spark.createDataFrame(queries, "item_id long, text string")
    assert found(lexical.search(index, asked, k=3, block_bytes=120)) == plain(docs, queries, 3)


def test_odd_rows(spark):
    """Nulls in every column, empty texts, repeated rows, ids of text, other alphabets, one very long text, extra columns of the result's names."""
    docs = [("b", "Éa é one", 1), ("a", None, 2), (None, "one two", 3), ("b", "Éa é one", 4), ("c", "", 5), ("a", "--- !!", 6), ("z", "one " * 300000 + "two", 7), (None, "one two", 8)]
    queries = [("q", "ONE two é", 1), ("q", "ONE two é", 2), (None, "éa one", 3), ("n", None, 4), ("m", "unknown", 5)]
    table = spark.createDataFrame(docs, "doc_id string, text string, score int")
    out = lexical.search_documents(table, spark.createDataFrame(queries, "item_id string, text string, rank int"), k=20)
    want = plain([d[:2] for d in docs], [q[:2] for q in queries], 20)
    key = lambda r: (r[0] or "", r[1], r[3], r[2] or "")
    assert sorted((tuple(r) for r in out.collect()), key=key) == sorted(want, key=key)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert lexical.search_documents(docs, items).count() == 0
    some = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert lexical.search_documents(some, items.where(F.lit(False))).count() == 0
    assert lexical.search_documents(some.withColumn("text", F.lit("...")), items).count() == 0
