"""Most frequent terms by summaries: the same as by counting all, also where summaries lose terms, and only survivors are counted exactly."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from quillon.operators import vocabulary


def corpus(seed, n=600, words=4000):
    rng = random.Random(seed)
    names = [f"t{i}" for i in range(words)]
    return [(i, rng.choices(names, [1 / (k + 1) for k in range(words)], k=rng.choice([0, 5, 60]))) for i in range(n)] + [(n, None), (n, []), (n + 1, ["é", "é", "", " "])]


def bag_of(spark, rows):
    return vocabulary.bags(spark.createDataFrame(rows, "doc long, given array<string>").repartition(6), "doc", F.col("given"))


def plain(rows, size):
    total = Counter(t for _, d in rows for t in d or ())
    df = Counter(t for _, d in rows for t in set(d or ()))
    return [(t, df[t], n) for t, n in sorted(total.items(), key=lambda x: (-x[1], x[0]))[:size]]


@pytest.mark.parametrize(("room", "size", "sent_bytes"), [(1 << 20, 100, 1 << 20), (900, 30, 1 << 20), (900, 30, 0), (5, 40, 1 << 20), (1 << 20, 100_000, 1 << 20), (40, 100_000, 1 << 20)])
def test_as_counting_all(spark, room, size, sent_bytes):
    rows = corpus(1)
    got = [tuple(r) for r in vocabulary.most_frequent(bag_of(spark, rows), size, room, sent_bytes).collect()]
    assert got == plain(rows, size)


def test_few_terms_survive(spark):
    """With room for a part of the terms, summaries lose some, yet prove that few of them can matter; with too little they say so."""
    rows = corpus(2)
    bag = bag_of(spark, rows)
    assert vocabulary.summaries(bag, 900).where("term is null").agg(F.sum("n")).first()[0] > 0
    kept = {r.term for r in vocabulary.survivors(bag, 20, 900).collect()}
    assert {t for t, _, _ in plain(rows, 20)} <= kept and len(kept) < 200 < len(plain(rows, 10**6))
    assert vocabulary.survivors(bag, 20, 3) is None
    sent = vocabulary.summaries(bag, 50).groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert sent <= 51  # what a task sends is bounded, however many terms it has


def test_summary_bounds():
    rng = random.Random(3)
    true, mine = Counter(), vocabulary.Summary(20)
    for _ in range(300):
        part = Counter(f"w{int(rng.paretovariate(0.7))}" for _ in range(40))
        true.update(part)
        mine.add(pa.array(list(part)), np.array(list(part.values())))
    mine.prune()
    counts = dict(zip(*(c.to_pylist() for c in mine.counts.columns)))
    assert len(counts) <= 20 and mine.error > 0
    assert all(n <= true[t] <= n + mine.error for t, n in counts.items()) and all(true[t] <= mine.error for t in true if t not in counts)


def test_weights(spark):
    rows = corpus(4, 50, 30)
    bag = bag_of(spark, rows)
    counts = vocabulary.most_frequent(bag, 8)
    n = bag.count()
    assert n == len(rows)
    df = {t: d for t, d, _ in plain(rows, 8)}
    want = []
    for key, given in rows:
        tf = Counter(t for t in given or () if t in df)
        w = {t: k * (np.log((1 + n) / (1 + df[t])) + 1) for t, k in tf.items()}
        want += [(key, t, tf[t], df[t], x, x / np.sqrt(sum(v * v for v in w.values()))) for t, x in w.items()]
    got = sorted(tuple(r) for r in vocabulary.weights(bag, "doc", counts, n).collect())
    assert [r[:4] for r in got] == [r[:4] for r in sorted(want)] and np.allclose([r[4:] for r in got], [r[4:] for r in sorted(want)])


def test_empty_table(spark):
    bag = vocabulary.bags(spark.createDataFrame([], "doc long, given array<string>"), "doc", F.col("given"))
    assert vocabulary.most_frequent(bag, 5).count() == 0 and vocabulary.weights(bag, "doc", vocabulary.most_frequent(bag, 5), 0).count() == 0


def test_batches_are_taken_in_slices():
    """A worker's arrays are as large as a slice, not as a batch of 10,000 documents; nothing is lost or put in another order."""
    lists = [["a"] * 3, None, [], ["b"] * 9, ["c"], ["d"] * 2, ["e"] * 2]
    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(lists, pa.list_(pa.string()))], ["doc", "terms"])
    parts = list(vocabulary._slices(iter([batch, batch.slice(0, 0)]), 4))
    assert pa.Table.from_batches(parts).to_pylist() == batch.to_pylist()
    assert all(len(p) == 1 or sum(map(len, filter(None, p.column("terms").to_pylist()))) <= 4 for p in parts)


def test_a_summary_holds_little_more_than_its_room():
    mine, most = vocabulary.Summary(1000), 0
    for lo in range(0, 20_000, 100):
        mine.add(pa.array([f"w{x}" for x in range(lo, lo + 100)]), np.ones(100, int))
        most = max(most, len(mine.counts))
    assert most <= 2000
