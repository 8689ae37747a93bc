"""Token trees as graphs: edges of five types, their ablation, and node features.

nodes: graph_id, idx (pre-order), parent (-1 at the root), pos (among siblings), depth, subtree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import drop_path, stored_at

# Edge types, and which stay under an ablation.
CHILD, NEXT, PARENT, PREVIOUS, SELF = range(5)
KEEP = {"all": (0, 1, 2, 3, 4), "self_loops_only": (4,), "self_loops_parent_child": (0, 2, 4), "self_loops_sequential": (1, 3, 4)}


def nodes_of(parsed: DataFrame, graph_id: str) -> DataFrame:
    """A row per node, out of parsed rows' arrays."""
    return parsed.select(F.col(graph_id).alias("graph_id"), F.inline("nodes"))


def edges(nodes: DataFrame) -> DataFrame:
    """graph_id, src, dst, type. Sequential edges run from a parent to its first child and from each child to the next."""
    siblings = Window.partitionBy("graph_id", "parent").orderBy("pos", "idx")
    before = F.coalesce(F.lag("idx").over(siblings), F.col("parent"))
    edge = lambda a, b, t: F.struct(a.alias("src"), b.alias("dst"), F.lit(t).alias("type"))
    i, p, q = F.col("idx"), F.col("parent"), F.col("__before")
    pairs = F.array(edge(p, i, CHILD), edge(q, i, NEXT), edge(i, p, PARENT), edge(i, q, PREVIOUS), edge(i, i, SELF))
    rows = nodes.withColumn("__before", before)
    return rows.select("graph_id", F.inline(F.when(p < 0, F.array(edge(i, i, SELF))).otherwise(pairs)))


def ablate(edge_rows: DataFrame, ablation: str = "all") -> DataFrame:
    """Only the types that the ablation keeps, numbered anew without gaps."""
    kept = KEEP[ablation]
    renumbered = F.coalesce(*(F.when(F.col("type") == t, F.lit(k)) for k, t in enumerate(kept)))
    return edge_rows.where(F.col("type").isin(*kept)).withColumn("type", renumbered)


def degree_features(nodes: DataFrame, edge_rows: DataFrame) -> DataFrame:
    """graph_id, idx, and degrees in, out, in all, and in all over the graph's largest (1 where that is 0)."""
    ends = edge_rows.select("graph_id", F.inline(F.array(F.struct(F.col("dst").alias("idx"), F.lit(1).alias("i"), F.lit(0).alias("o")), F.struct(F.col("src").alias("idx"), F.lit(0).alias("i"), F.lit(1).alias("o")))))
    sums = ends.groupBy("graph_id", "idx").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))
    d = nodes.select("graph_id", "idx").join(sums, ["graph_id", "idx"], "left").na.fill(0, ["in_degree", "out_degree"])
    d = d.withColumn("degree", F.col("in_degree") + F.col("out_degree"))
    top = F.max("degree").over(Window.partitionBy("graph_id"))
    return d.withColumn("degree_share", F.col("degree") / F.when(top == 0, 1).otherwise(top))


def positional_features(nodes: DataFrame) -> DataFrame:
    """graph_id, idx, depth over the graph's depth, leaf and root flags, log1p of the subtree's size."""
    top = F.max("depth").over(Window.partitionBy("graph_id"))
    return nodes.select(
        "graph_id", "idx", (F.col("depth") / F.when(top == 0, 1).otherwise(top)).alias("depth_share"), (F.col("subtree") == 1).cast("double").alias("is_leaf"),
        (F.col("parent") < 0).cast("double").alias("is_root"), F.log1p(F.col("subtree").cast("double")).alias("log_subtree"),
    )


def depth_and_subtree(links: DataFrame) -> DataFrame:
    """For trees given as (node, parent; null at a root): each node's depth and the size of its subtree.

    Pointer doubling: in round k a node knows its ancestor 2^k steps up, if there
    is one, the steps to it or else to its root, and how many nodes of its subtree
    are fewer than 2^k steps below it. It learns its ancestor's ancestor by a join,
    and adds the counts of those whose ancestor it is, summed before they meet. So
    rounds are the logarithm of the depth, and a row has a fixed size. Each round
    is stored, and drops the table of the one before. A node that no root reaches
    (its parent is missing, or it is on a circle or below one) is in no tree and
    gives no row.
    """
    spark = links.sparkSession
    parents = links.select(F.col("node").alias("__n")).distinct()
    begun = links.join(parents, F.col("parent") == F.col("__n"), "left").select(
        "node", F.col("__n").alias("up"), (F.col("parent").isNotNull() & F.col("__n").isNull()).alias("lost"), F.col("__n").isNotNull().cast("long").alias("steps"), F.lit(1).cast("long").alias("below")
    )
    now, path = stored_at(begun, "doubling")
    most = now.count().bit_length() + 1  # more rounds only find circles
    for _ in range(most):
        going = now.where(F.col("up").isNotNull())
        if going.isEmpty():
            break
        added = going.groupBy(F.col("up").alias("__to")).agg(F.sum("below").alias("__added"))
        above = now.select(F.col("node").alias("__n"), F.col("up").alias("__up"), F.col("lost").alias("__lost"), F.col("steps").alias("__steps"))
        rows = now.join(above, F.col("up") == F.col("__n"), "left").join(added, F.col("node") == F.col("__to"), "left")
        rows = rows.select("node", F.col("__up").alias("up"), (F.col("lost") | F.coalesce("__lost", F.lit(False))).alias("lost"), (F.col("steps") + F.coalesce("__steps", F.lit(0))).alias("steps"), (F.col("below") + F.coalesce("__added", F.lit(0))).alias("below"))
        earlier, (now, path) = path, stored_at(rows, "doubling")
        drop_path(spark, earlier)
    return now.where(F.col("up").isNull() & ~F.col("lost")).select("node", F.col("steps").cast("int").alias("depth"), F.col("below").alias("subtree"))


def rule_label(tokens: Column) -> Column:
    """0 (clean) if a token is a payload tag or names a script, else -1 (no say). It never says 1."""
    return F.when(F.exists(tokens, lambda t: (t == "<payload>") | F.contains(t, F.lit(".ps"))), 0).otherwise(-1)


# Feature configurations by name: (semantic, token, positional).
CONFIGS = {
    "semantic_only": (True, False, False), "syntactic_only": (False, True, False), "positional_only": (False, False, True), "semantic_syntactic": (True, True, False),
    "semantic_positional": (True, False, True), "syntactic_positional": (False, True, True), "all": (True, True, True),
}


def config_name(name: str, ablation: str = "all") -> str:
    return name if ablation == "all" else f"{name}_edges_{ablation}"
