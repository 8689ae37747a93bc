"""Connected components of an undirected edge table, by contraction.

Every round, each node points to the least of its neighbours and itself; the
pointers form trees, which pointer doubling flattens; edges move to the roots,
and loops and repeats go. A round at least halves the nodes that still have an
edge. Only sums by key and joins by key are used, each step is a table in the
shared folder, and nothing but row counts reaches the driver.

Nulls and odd rows: loops and edges with a null end are none, repeated edges
count once. An empty table gives an empty result. Extra columns, of whatever
names, are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _flatten(pointers: DataFrame) -> DataFrame:
    """pointers: node, root (a node too, never greater). Every node's final root."""
    while True:
        up = pointers.select(F.col("node").alias("__n"), F.col("root").alias("__r"))
        for _ in range(2):
            pointers = pointers.join(up, F.col("root") == F.col("__n")).select("node", F.col("__r").alias("root"), (F.col("root") != F.col("__r")).alias("moved"))
            pointers = pointers.select("node", "root", "moved")
        pointers = stored(pointers, "pointers")
        if pointers.where("moved").limit(1).count() == 0:
            return pointers.select("node", "root")
        pointers = pointers.select("node", "root")


def components(edges: DataFrame) -> DataFrame:
    """edges: a, b (long). A row (node, root) for each node with an edge; root is the least node of its component."""
    edges = stored(edges.where("a <> b").select("a", "b").distinct(), "edges")
    levels: list[DataFrame] = []
    while edges.limit(1).count():
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        pointers = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("root"))
        levels.append(_flatten(stored(pointers, "least")))
        roots = [levels[-1].select(F.col("node").alias(f"__{x}"), F.col("root").alias(f"r{x}")) for x in "ab"]
        moved = edges.join(roots[0], F.col("a") == F.col("__a")).join(roots[1], F.col("b") == F.col("__b")).where("ra <> rb")
        edges = stored(moved.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "edges")
    if not levels:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = levels[0]
    for level in levels[1:]:
        up = level.select(F.col("node").alias("__n"), F.col("root").alias("__r"))
        out = out.join(up, F.col("root") == F.col("__n"), "left").select("node", F.coalesce("__r", "root").alias("root"))
    return out
