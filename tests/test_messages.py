"""Message passing against a plain version."""

from collections import Counter

from pyspark.sql import functions as F
from quillon.operators import learn


def test_mean_of_ragged_vectors_with_gaps(spark):
    """Means are of the values that are there; a dimension that holds none has a row without a mean."""
    vectors = {k: [None if (k + d) % 7 == 0 else k * 10.0 + d for d in range(n)] for k, n in enumerate((0, 1, 15, 16, 17, 40))} | {9: None, 10: [None]}
    edges = [(k % 8, k % 3) for k in range(60)] + [(0, 7), (9, 8), (10, 9), (5, 5), (5, 5), (1, 5)]
    want = {}
    for (src, dst), n in Counter(edges).items():
        for d, v in enumerate(vectors.get(src) or ()):
            cell = want.setdefault((dst, d + 1), [0.0, 0])
            if v is not None:
                cell[0] += n * v
                cell[1] += n
    table = spark.createDataFrame(list(vectors.items()), "node int, x array<float>")
    got = {(r.dst, r.dim): r.mean for r in learn.message_mean(spark.createDataFrame(edges, "src int, dst int"), table).collect()}
    assert got.keys() == want.keys()
    assert all((got[k] is None) if n == 0 else abs(got[k] - s / n) < 1e-6 for k, (s, n) in want.items())


def test_groups_are_blocks_of_dimensions(spark):
    """What is grouped has a row per edge and block of dimensions, not per dimension."""
    vectors = spark.range(50).select(F.col("id").alias("node"), F.array_repeat(F.col("id").cast("float"), 64).alias("x"))
    out = learn.message_mean(spark.range(200).select((F.col("id") % 50).alias("src"), F.col("id").alias("dst")), vectors)
    assert out.count() == 200 * 64
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode" not in plan and "explode(sequence(0, (size(x" in plan
