"""Graphs of token trees, made whole inside a row: an Arrow batch of trees is one pass of flat arrays over all their nodes.

A tree's graph hangs on its tree alone, so each distinct tree has one, under the
digest of its text; rows of equal trees share it. Edges, degrees and places come
from the nodes' numbers; what a token gives (its features, its embedding) is
worked out once per distinct token of a batch, and embeddings are remembered by
the worker, so an embedder sees a token once per worker while it is remembered.
No row per node leaves a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.chars import stats_of
from ..functions.shipping import ship
from . import embed, features, gnn, graph

GRAPH = "tree_id string, x array<float>, width int, src array<int>, dst array<int>, type array<int>, rule_label int"
REMEMBERED = 1 << 17  # tokens whose embeddings a worker keeps
BATCH_NODES = 1 << 15  # nodes that are worked on at once, or one tree

_vectors: dict[str, np.ndarray] = {}


def tree_id(tree: Column) -> Column:
    return F.md5(tree.cast("binary"))


def lexical(tokens: pa.Array) -> np.ndarray:
    """The 15 features of each token, as features.token_features gives them."""
    has = lambda x: pc.match_substring(tokens, x).to_numpy(zero_copy_only=False)
    some = lambda xs: np.logical_or.reduce([has(x) for x in xs])
    starts = lambda x: pc.starts_with(tokens, x).to_numpy(zero_copy_only=False)
    s = stats_of(tokens)
    number = lambda c: s.field(c).to_numpy(zero_copy_only=False).astype(float)
    less, more = has("<"), has(">")
    replaced = less & more
    columns = {
        "log_len": np.log1p(number("length")),
        "entropy": number("entropy"),
        "is_arg": starts("-") | starts("/"),
        "is_extension": starts(".") & (number("length") < 6),
        "is_exe": has(".exe"),
        "redirects": has("|") | (less != more) | has(">>") | has("<<") | has("&"),
        "log_hostile": np.log1p(number("hostile")),
        "log_quotes": np.log1p(number("quotes")),
        "was_replaced": replaced,
        "is_path": replaced & some(features.PATH_TAGS),
        "is_ip": replaced & has("_ip>"),
        "is_pid": replaced & has("<PID>"),
        "is_hash": replaced & some(features.SECRET_TAGS),
        "is_url": replaced & has("<url>"),
        "is_date": replaced & some(("<date>", "<timestamp>")),
    }
    return np.stack([np.asarray(c, float) for c in columns.values()], axis=1)


def embedded(tokens: list[str], embedder: embed.Embedder) -> np.ndarray:
    missing = [t for t in tokens if t not in _vectors]
    if len(_vectors) + len(missing) > REMEMBERED:
        _vectors.clear()
        missing = tokens
    if missing:
        _vectors.update(zip(missing, np.asarray(embedder(missing), np.float32)))
    return np.stack([_vectors[t] for t in tokens])


class Nodes:
    """The nodes of some trees, one tree's behind the other's; parent and the ends of edges count from their tree's first node."""

    def __init__(self, lists: pa.ListArray):
        flat = lists.flatten()
        self.size = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        self.first = np.cumsum(self.size) - self.size
        self.tree = np.repeat(np.arange(len(self.size)), self.size)
        self.base = self.first[self.tree]
        column = lambda c: flat.field(c).to_numpy(zero_copy_only=False).astype(np.int64)
        self.idx, self.parent, self.pos, self.depth, self.subtree = map(column, ("idx", "parent", "pos", "depth", "subtree"))
        self.values = flat.field("value")
        self.idx_at = self.base + self.idx

    def edges(self, ablation: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Tree, source, target and type of each edge that the ablation keeps, sorted by these; types numbered anew without gaps."""
        inner = np.flatnonzero(self.parent >= 0)
        order = inner[np.lexsort((self.idx[inner], self.pos[inner], self.parent[inner], self.tree[inner]))]
        same = np.zeros(len(order), bool)
        same[1:] = (self.tree[order][1:] == self.tree[order][:-1]) & (self.parent[order][1:] == self.parent[order][:-1])
        before = np.where(same, np.roll(self.idx[order], 1), self.parent[order])
        i, p, every = self.idx[order], self.parent[order], np.arange(len(self.idx))
        kinds = {graph.CHILD: (order, p, i), graph.NEXT: (order, before, i), graph.PARENT: (order, i, p), graph.PREVIOUS: (order, i, before), graph.SELF: (every, self.idx, self.idx)}
        rows = [(self.tree[at], src, dst, np.full(len(src), k)) for k, t in enumerate(graph.KEEP[ablation]) for at, src, dst in [kinds[t]]]
        tree, src, dst, kind = (np.concatenate(c) for c in zip(*rows))
        order = np.lexsort((kind, dst, src, tree))
        return tree[order], src[order], dst[order], kind[order]

    def most(self, values: np.ndarray) -> np.ndarray:
        """Of each node, the greatest value in its tree, 1 where that is 0."""
        top = np.maximum.reduceat(values, self.first)[self.tree] if len(values) else values
        return np.where(top == 0, 1, top)

    def positional(self, tree: np.ndarray, src: np.ndarray, dst: np.ndarray) -> np.ndarray:
        """Depth over the tree's, leaf, root, log of the subtree's size; degrees in, out, in all, and in all over the tree's greatest."""
        n = len(self.idx)
        into, out = np.bincount(self.first[tree] + dst, minlength=n), np.bincount(self.first[tree] + src, minlength=n)
        both = into + out
        return np.stack([self.depth / self.most(self.depth), self.subtree == 1, self.parent < 0, np.log1p(self.subtree), into, out, both, both / self.most(both)], axis=1).astype(float)


def _arrays(lists: pa.ListArray, parts: tuple[bool, bool, bool], ablation: str, embedder: embed.Embedder) -> tuple[np.ndarray, Nodes, tuple]:
    """Features of all nodes in order of idx, the nodes, and the edges."""
    nodes = Nodes(lists)
    edges = nodes.edges(ablation)
    semantic, token, positional = parts
    blocks = []
    if semantic or token:
        coded = nodes.values.dictionary_encode()
        code, known = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
        if semantic:
            blocks.append(embedded(known.to_pylist(), embedder)[code])
        if token:
            blocks.append(lexical(known)[code])
    if positional:
        blocks.append(nodes.positional(*edges[:3]))
    x = np.concatenate(blocks, axis=1) if blocks else np.ones((len(nodes.idx), 1))
    placed = np.empty_like(x, dtype=np.float32)
    placed[nodes.idx_at] = x
    return placed, nodes, edges


def batch_of(lists: pa.ListArray, parts: tuple[bool, bool, bool], ablation: str, embedder: embed.Embedder) -> gnn.Batch:
    """The graphs of some trees as a model takes them, without a table between."""
    x, nodes, (tree, src, dst, kind) = _arrays(lists, parts, ablation, embedder)
    return gnn.Batch(x.astype(float), nodes.first[tree] + src, nodes.first[tree] + dst, kind, nodes.tree, len(nodes.size))


def _slices(lists: pa.ListArray) -> Iterator[tuple[int, int]]:
    ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
    lo = 0
    while lo < len(ends):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + BATCH_NODES, "right")))
        yield lo, hi
        lo = hi


def build(parts: tuple[bool, bool, bool], ablation: str = "all", embedder: embed.Embedder | None = None):
    """A function from batches of (tree_id, nodes, rule_label) to batches of GRAPH."""
    make = embedder or embed.hashing_embedder()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in _slices(batch.column("nodes")):
                part = batch.slice(lo, hi - lo)
                x, nodes, (tree, src, dst, kind) = _arrays(part.column("nodes"), parts, ablation, make)
                n_edges = np.bincount(tree, minlength=hi - lo)
                lists = lambda values, sizes, k: pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), pa.array(values, k))
                width = pa.array(np.full(hi - lo, x.shape[1]), pa.int32())
                yield pa.RecordBatch.from_arrays([part.column("tree_id"), lists(x.reshape(-1), nodes.size * x.shape[1], pa.float32()), width, *(lists(c, n_edges, pa.int32()) for c in (src, dst, kind)), part.column("rule_label")], [c.split()[0] for c in GRAPH.split(", ")])

    return run


def distinct_trees(parsed: DataFrame) -> DataFrame:
    """tree_id, nodes and rule_label, a row per tree."""
    rows = parsed.where("nodes is not null").select(tree_id(F.col("tree")).alias("tree_id"), "nodes", graph.rule_label(F.col("tokens")).alias("rule_label"))
    return rows.groupBy("tree_id").agg(F.first("nodes").alias("nodes"), F.first("rule_label").alias("rule_label"))


def graphs_of(trees: DataFrame, parts: tuple[bool, bool, bool], ablation: str = "all", embedder: embed.Embedder | None = None) -> DataFrame:
    """A graph per row of distinct_trees."""
    ship(trees.sparkSession)
    return trees.select("tree_id", "nodes", "rule_label").mapInArrow(build(parts, ablation, embedder), GRAPH)
