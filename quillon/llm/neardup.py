"""Near-duplicate documents by a MinHash LSH forest, confirmed on full sets.

A document's set: the distinct 5-word shingles of its text (A-Z in lower case,
words between ASCII white space), the whole sequence if it has fewer words.
Equal sets fall together first (one node per set, whatever the number of
copies). Every node has a signature of 128 minima. A tree of the forest is one
order of the signature's places; nodes are sorted by the values in that order.

Candidates of a tree are linear in its nodes:
- neighbours in the sorted order with a common prefix of at least 3 values;
- regions, the nodes that share a prefix of 3 values. A region larger than SPLIT
  is cut by longer prefixes, step by step, as long as its parts stay that large,
  so depth adapts to each region. In every region of three or more each node is
  put forward with the region's leader, the node whose regions are the largest
  over all trees, which is the text that the others vary;
- in large regions: each node with the two whose signatures agree best with its
  own among 64 rows on either side, since many texts that share a passage can
  stand between two that are near.
Candidates whose signatures agree on eight standard deviations less than the
asked similarity are dropped; the others are confirmed on the full sets of both
texts. Links become components.

What the forest leaves out is looked for by an exact prefix filter: shingles have
one order, the rarest first; two sets of similarity t have one in common among the
first |s| - ceil(t |s|) + 1 of each. Let the first one that they share stand
behind p and q others in them. Then no more than |s| - p, or |r| - q, are in
common, and that must reach t / (1 + t) (|s| + |r|): each set has a greatest size
that a partner may have, its reach. Only nodes of different components are
paired, and only those in each other's reach. Of a shingle that at most LIST nodes
have in front all pairs are looked at. Where more have it, the smaller of two looks
for the larger one: only nodes that reach their own size look, in lists by shingle
and size band, a block of seekers at a time. Texts that share a passage and less
have it too late to reach anyone, so a hot passage makes no pairs, however many
texts have it; what is paired there is what might be near by all that is known of
both. The order is by counts of all texts' shingles in hash buckets. So every near
pair lies inside a component or is put forward (but for hashes, and for signatures
that agree on eight standard deviations too few places).

Nulls and odd rows: a text without words, or null, has an empty set and links
with nothing. A null id takes part with its text, but is no component's id
unless it is alone. Repeated rows are equal sets. An empty table gives an empty
result. Extra columns pass through; result columns replace those of their name.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vectext
from .common import body, ship, stored
from .components import components

SHINGLE, PLACES, TREES, ORDER = 5, 128, 16, 16
DEPTHS = (3, 4, 6, 8, 11, 16)
SPLIT, WINDOW, LIST, BLOCK = 16, 64, 16, 512
BUCKETS, SLICE = 1 << 20, 1 << 12
_rng = np.random.default_rng(20240101)
FACTORS = _rng.integers(1, 2**63, PLACES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
TERMS = _rng.integers(0, 2**63, PLACES, dtype=np.uint64)
#: Places in each tree's order. The first three of the 16 trees are 48 different places.
ORDERS = np.stack([np.roll(np.arange(PLACES), -8 * t)[np.r_[0:8, _rng.permutation(np.arange(8, PLACES))[: ORDER - 8]]] for t in range(TREES)])


def shingle_sets(texts: pa.Array | pa.ChunkedArray) -> Iterator[np.ndarray]:
    """Each text's set, as sorted 64-bit hashes."""
    for _, _, data, offsets in vectext.blocks(texts):
        hashes, first, _, _ = vectext.word_hashes(data, offsets)
        grams, _ = vectext.ngrams(hashes, first, SHINGLE)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
            if b - a >= SHINGLE:
                s = np.sort(grams[a : b - SHINGLE + 1])
                yield s[np.concatenate([[True], s[1:] != s[:-1]])]
            elif b > a:
                yield vectext.ngrams(hashes[a:b], np.array([0, b - a]), b - a)[0][:1] ^ np.uint64(b - a)
            else:
                yield grams[:0]


def signature(members: np.ndarray) -> np.ndarray:
    """16 bits of the least of each of the hash functions."""
    least = np.full(PLACES, np.iinfo(np.uint64).max, np.uint64)
    for lo in range(0, len(members), 256):
        least = np.minimum(least, (members[lo : lo + 256, None] * FACTORS + TERMS).min(axis=0))
    return (vectext.mix(least) >> np.uint64(48)).astype(np.uint16)


def agreement(percent: int, deviations: float) -> float:
    """The share of places on which signatures of sets of that similarity agree, less some standard deviations."""
    p = percent / 100
    return p - deviations * (p * (1 - p) / PLACES) ** 0.5


def node_id(members: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(members.tobytes(), digest_size=8).digest(), "little", signed=True)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        nodes, sizes, sigs = [], [], []
        for members in shingle_sets(batch.column("__text")):
            sizes.append(len(members))
            nodes.append(node_id(members) if len(members) else None)
            sigs.append(signature(members).tobytes() if len(members) else None)
        yield pa.RecordBatch.from_arrays([batch.column("__id"), batch.column("th"), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(sigs, pa.binary())], ["__id", "th", "node", "n_shingles", "sig"])


def _plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes to a row per tree, with the values in the tree's order, big-endian so that bytes sort alike."""
    for batch in batches:
        n = len(batch)
        if not n:
            continue
        sigs = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint16).reshape(n, PLACES)
        for t in range(TREES):
            keys = np.ascontiguousarray(sigs[:, ORDERS[t]].astype(">u2"))
            offsets = pa.py_buffer((np.arange(n + 1) * 2 * ORDER).astype(np.int32).tobytes())
            column = pa.Array.from_buffers(pa.binary(), n, [None, offsets, pa.py_buffer(keys.tobytes())])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, t), pa.int32()), column, batch.column("node")], ["tree", "key", "node"])


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs next to each other in sorted rows, if their common prefix is long enough."""
    last = None
    for batch in batches:
        n = len(batch)
        if not n:
            continue
        keys = np.frombuffer(b"".join(batch.column("key").to_pylist()), np.uint16).reshape(n, ORDER)[:, : DEPTHS[0]]
        trees, nodes = batch.column("tree").to_numpy(), batch.column("node").to_numpy()
        if last is not None:
            keys, trees, nodes = np.vstack([last[0], keys]), np.concatenate([last[1], trees]), np.concatenate([last[2], nodes])
        last = keys[-1:].copy(), trees[-1:].copy(), nodes[-1:].copy()
        near = (keys[1:] == keys[:-1]).all(axis=1) & (trees[1:] == trees[:-1])
        a, b = nodes[:-1][near], nodes[1:][near]
        both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["a", "b"])


def _best_of_window(likely: float):
    """In sorted rows of large regions: each node with the two that agree best among the WINDOW rows on either side."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            n = len(batch)
            if not n:
                continue
            sigs = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint16).reshape(n, PLACES)
            regions, nodes = batch.column("region").to_numpy(), batch.column("node").to_numpy()
            if last is not None:
                sigs, regions, nodes = np.vstack([last[0], sigs]), np.concatenate([last[1], regions]), np.concatenate([last[2], nodes])
            last = sigs[-WINDOW:].copy(), regions[-WINDOW:].copy(), nodes[-WINDOW:].copy()
            score, mate = np.zeros((2, len(nodes))), np.tile(np.arange(len(nodes)), (2, 1))
            for d in range(1, min(WINDOW, len(nodes) - 1) + 1):
                i = np.flatnonzero(regions[d:] == regions[:-d])
                agree = (sigs[i + d] == sigs[i]).mean(axis=1)
                for x, y in ((i, i + d), (i + d, i)):
                    first = agree > score[0, x]
                    score[1, x[first]], mate[1, x[first]] = score[0, x[first]], mate[0, x[first]]
                    score[0, x[first]], mate[0, x[first]] = agree[first], y[first]
                    second = ~first & (agree > score[1, x])
                    score[1, x[second]], mate[1, x[second]] = agree[second], y[second]
            me = np.tile(np.arange(len(nodes)), (2, 1))[score >= likely]
            a, b = nodes[me], nodes[mate[score >= likely]]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    return run


def _agree(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = len(batch)
            if not n:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(n, PLACES) for c in ("sa", "sb"))
            ok = pa.array((x == y).mean(axis=1) >= least)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(ok), batch.column("b").filter(ok)], ["a", "b"])

    return run


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            known: dict[int, np.ndarray] = {}
            for nodes, column in ((a, "ta"), (b, "tb")):
                new = {x: i for i, x in enumerate(nodes) if x not in known}
                known |= dict(zip(new, shingle_sets(batch.column(column).take(pa.array(list(new.values()), pa.int64())))))
            ok = []
            for x, y in zip(a, b):
                s, t = known[x], known[y]
                both = np.sort(np.concatenate([s, t]))
                common = int((both[1:] == both[:-1]).sum())
                ok.append(100 * common >= percent * (len(s) + len(t) - common))
            ok = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(ok), batch.column("b").filter(ok)], ["a", "b"])

    return run


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A stored row per document: __id, th (hash of the text), node (its set), n_shingles, sig."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("__id"), F.xxhash64(body(text_col)).alias("th"), body(text_col).alias("__text"))
    kind = docs.schema[id_col].dataType.simpleString()
    return stored(rows.mapInArrow(_sketch, f"__id {kind}, th long, node long, n_shingles long, sig binary"), "sketches")


def candidates(nodes: DataFrame, percent: int) -> DataFrame:
    """nodes: node, sig. Pairs (a, b), a < b, that the forest puts forward."""
    planted = stored(nodes.select("node", "sig").mapInArrow(_plant, "tree int, key binary, node long"), "forest")
    near = planted.repartitionByRange("tree", "key", "node").sortWithinPartitions("tree", "key", "node").mapInArrow(_neighbours, "a long, b long").distinct()

    def regions(rows: DataFrame, depth: int) -> DataFrame:
        """rows with their region at a depth, as a hash, and its number of nodes; regions of three and more."""
        rows = rows.select("node", "tree", "key", F.xxhash64("tree", F.substring("key", 1, 2 * depth)).alias("region"))
        large = rows.groupBy("region").agg(F.count(F.lit(1)).alias("size")).where("size > 2")
        return stored(rows.join(large, "region"), "regions")

    inside = regions(planted, DEPTHS[0])
    score = stored(inside.groupBy("node").agg(F.sum("size").alias("score")), "scores")
    pairs, at = near, inside
    for deeper in (*DEPTHS[1:], None):
        lead = at.select("node", "region").join(score, "node").groupBy("region").agg(F.max(F.struct("score", "node"))["node"].alias("lead"))
        lead = stored(lead, "leaders")  # tables on the small side of a join let Spark split a large region, set or text among tasks
        pairs = pairs.unionByName(at.select("node", "region").join(lead, "region").where("node <> lead").select(F.least("node", "lead").alias("a"), F.greatest("node", "lead").alias("b")))
        large = at.where(F.col("size") > SPLIT)
        if deeper is None or large.isEmpty():
            break
        at = regions(large, deeper)
    of_window = inside.where(F.col("size") > SPLIT).select("tree", "key", "node", "region").join(nodes.select("node", "sig"), "node").repartitionByRange("tree", "key", "node").sortWithinPartitions("tree", "key", "node")
    pairs = pairs.unionByName(of_window.select("region", "node", "sig").mapInArrow(_best_of_window(agreement(percent, 5.4)), "a long, b long").distinct())
    return _alike(pairs.distinct(), nodes, percent)


def _alike(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Stored: the pairs whose signatures agree well enough."""
    sig = [nodes.select(F.col("node").alias(x), F.col("sig").alias(f"s{x}")) for x in "ab"]
    return stored(pairs.join(sig[0], "a").join(sig[1], "b").select("a", "b", "sa", "sb").mapInArrow(_agree(agreement(percent, 8)), "a long, b long"), "candidates")


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's counts of texts by shingle bucket, in slices."""
    total = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for members in shingle_sets(batch.column("text")):
            total[members % np.uint64(BUCKETS)] += 1
    slices = total.reshape(-1, SLICE)
    used = np.flatnonzero(slices.any(axis=1))
    yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([zlib.compress(slices[i].tobytes(), 1) for i in used], pa.binary())], ["slice", "counts"])


def _sum_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the slices that a task gets, one at a time."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for i, counts in zip(batch.column("slice").to_pylist(), batch.column("counts").to_pylist()):
            total[i] = total.get(i, 0) + np.frombuffer(zlib.decompress(counts), np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([zlib.compress(x.tobytes(), 1) for x in total.values()], pa.binary())], ["slice", "counts"])


def bucket_counts(texts: DataFrame) -> np.ndarray:
    """How many texts have a shingle in each bucket, over all texts. A fixed number of counts reaches the driver."""
    kind = "slice int, counts binary"
    found = texts.mapInArrow(_buckets, kind).repartition("slice").mapInArrow(_sum_slices, kind).toArrow()
    out = np.zeros((BUCKETS // SLICE, SLICE), np.int64)
    for i, counts in zip(found.column("slice").to_pylist(), found.column("counts").to_pylist()):
        out[i] += np.frombuffer(zlib.decompress(counts), np.int64)
    return out.reshape(-1)


def _prefixes(percent: int, counts):
    """A row per node (once a task) and shingle of its prefix, the rarest first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, seen = counts.value, set()
        for batch in batches:
            nodes, sizes, heads = [], [], [np.zeros(0, np.uint64)]  # a shingle's place: how many of its set come before it in the common order
            for members in shingle_sets(batch.column("text")):
                if not len(members) or (node := node_id(members)) in seen:
                    continue
                seen.add(node)
                nodes.append(node)
                sizes.append(len(members))
                length = min(len(members), len(members) + percent * len(members) // -100 + 1)
                heads.append(members[np.argsort(often[members % np.uint64(BUCKETS)], kind="stable")[:length]])
            each = [len(h) for h in heads[1:]]
            places = np.concatenate([np.zeros(0, np.int64), *map(np.arange, each)])
            columns = [np.concatenate(heads).view(np.int64), np.repeat(np.array(nodes, np.int64), each), np.repeat(np.array(sizes, np.int64), each), places]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["shingle", "node", "size", "place"])

    return run


def _whole_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """The columns of rows sorted by the first one, cut where its value changes."""
    rest = None
    for batch in batches:
        if not len(batch):
            continue
        new = [c.to_numpy() for c in batch.columns]
        rest = new if rest is None else [np.concatenate(x) for x in zip(rest, new)]
        cut = int(np.searchsorted(rest[0], rest[0][-1]))
        if cut:
            yield [x[:cut] for x in rest]
            rest = [x[cut:] for x in rest]
    if rest is not None:
        yield rest


def _in_common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In rows sorted by shingle and node: each once, of shingles with two and more nodes. One row is held back between batches, whatever the number of nodes."""
    held, held_has_mate = None, False
    for batch in batches:
        if not len(batch):
            continue
        columns = [c.to_numpy() for c in batch.columns]
        if held is not None:
            columns = [np.concatenate(x) for x in zip(held, columns)]
        new = np.r_[True, (columns[0][1:] != columns[0][:-1]) | (columns[1][1:] != columns[1][:-1])]
        columns = [x[new] for x in columns]
        same = columns[0][1:] == columns[0][:-1]
        mate = np.r_[held_has_mate, same] | np.r_[same, False]
        held, held_has_mate = [x[-1:] for x in columns], bool(mate[-1])
        yield pa.RecordBatch.from_arrays([pa.array(x[:-1][mate[:-1]]) for x in columns], ["shingle", "node", "size", "place"])
    if held is not None and held_has_mate:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in held], ["shingle", "node", "size", "place"])


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In rows sorted by shingle and root, at most LIST of a shingle: pairs of a shingle's nodes with different roots whose sizes and places allow the similarity."""
    for shingle, root, node, size, reach in _whole_lists(batches):
        end = np.searchsorted(shingle, shingle, "right")
        change = np.flatnonzero((shingle[1:] != shingle[:-1]) | (root[1:] != root[:-1])) + 1
        other = np.r_[change, len(node)][np.searchsorted(change, np.arange(len(node)), "right")]
        many = end - other
        i = np.repeat(np.arange(len(node)), many)
        j = np.arange(len(i)) - np.repeat(np.cumsum(many) - many, many) + other[i]
        ok = (size[i] <= reach[j]) & (size[j] <= reach[i])
        a, b = node[i[ok]], node[j[ok]]
        both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["a", "b"])


def _probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In rows sorted by list (a shingle's nodes of a size band, and a block of those that look for partners) and size: pairs of one that looks and a larger one, with different roots, whose sizes and places allow the similarity."""
    for lists, size, root, node, reach, looks in _whole_lists(batches):
        change = np.r_[0, np.flatnonzero(lists[1:] != lists[:-1]) + 1, len(lists)]
        found = []
        for lo, hi in zip(change[:-1].tolist(), change[1:].tolist()):
            sizes = size[lo:hi]
            seek = np.flatnonzero(looks[lo:hi])
            begin, end = np.searchsorted(sizes, sizes[seek], "left"), np.searchsorted(sizes, reach[lo:hi][seek], "right")
            step = max(1, (1 << 20) // max(1, hi - lo))
            for k in range(0, len(seek), step):
                many = np.maximum(0, end[k : k + step] - begin[k : k + step])
                i = np.repeat(seek[k : k + step], many)
                j = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(begin[k : k + step], many)
                ok = (~looks[lo:hi][j].astype(bool) | (i != j)) & (root[lo:hi][i] != root[lo:hi][j]) & (sizes[i] <= reach[lo:hi][j])
                a, b = node[lo:hi][i[ok]], node[lo:hi][j[ok]]
                found.append(np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0))
        both = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["a", "b"])


def left_out(docs: DataFrame, nodes: DataFrame, roots: DataFrame, percent: int, text_col: str = "text") -> DataFrame:
    """Pairs (a, b) of nodes that roots does not connect, and that can have the similarity."""
    texts = docs.select(body(text_col).alias("text"))
    often = docs.sparkSession.sparkContext.broadcast(bucket_counts(texts))
    kind = "shingle long, node long, size long, place long"
    heads = texts.mapInArrow(_prefixes(percent, often), kind)
    rows = heads.repartition("shingle").sortWithinPartitions("shingle", "node").mapInArrow(_in_common, kind)
    # of two sets whose first common shingle this is, no more than size - place can be in common: the other's size is reach at most
    reach = F.floor((F.col("size") - F.col("place")) * (100 + percent) / percent).cast("long") - F.col("size")
    rows = stored(rows.join(roots, "node", "left").select("shingle", F.coalesce("root", "node").alias("root"), "node", "size", reach.alias("reach")), "prefixes")
    lists = rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("n"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi")
    lists = stored(lists.select("shingle", (F.col("n") > LIST).alias("common")), "mixed-shingles")
    rare = rows.join(lists.where("not common"), "shingle").select("shingle", "root", "node", "size", "reach").repartition("shingle").sortWithinPartitions("shingle", "root")
    common = rows.join(lists.where("common").select("shingle"), "shingle")
    pairs = rare.mapInArrow(_across, "a long, b long").unionByName(_of_common(common, percent))
    return _alike(pairs.distinct(), nodes, percent)


def _of_common(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs of nodes that have a common shingle in front: every one that sizes and places allow.

    The smaller of two looks for the larger, which its reach must include, so a node
    looks only where the shingle stands early enough in it. Nodes that share no more
    than a passage have it too late, and look for nothing, however many they are.
    """
    band = lambda size: F.floor(F.log(size.cast("double")) / F.log(F.lit(100 / percent)) + 1e-9)
    rows = rows.withColumn("band", band(F.col("size")))
    seekers = rows.where(F.col("reach") >= F.col("size"))
    seekers = seekers.withColumn("band", F.explode(F.sequence("band", F.greatest("band", band(F.col("reach"))))))
    wanted = seekers.groupBy("shingle", "band").agg(F.count(F.lit(1)).alias("n"), F.min("size").alias("least"), F.max("reach").alias("most"), F.min("root").alias("lo"), F.max("root").alias("hi"))
    wanted = stored(wanted.withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")), "seekers")
    # larger ones that some seeker reaches and that are not all of its component
    asked = rows.join(wanted, ["shingle", "band"]).where((F.col("size") >= F.col("least")) & (F.col("size") <= F.col("most")) & (F.col("reach") >= F.col("least")) & ((F.col("lo") < F.col("hi")) | (F.col("root") != F.col("lo"))))
    asked = asked.select("shingle", "band", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "size", "root", "node", "reach", F.lit(0).alias("looks"))
    met = stored(asked.select("shingle", "band", "block").distinct(), "asked-lists")
    seekers = seekers.join(wanted.select("shingle", "band", "blocks"), ["shingle", "band"]).select("shingle", "band", F.pmod(F.hash("node"), F.col("blocks")).alias("block"), "size", "root", "node", "reach", F.lit(1).alias("looks"))
    seekers = seekers.join(met, ["shingle", "band", "block"], "left_semi")
    both = asked.unionByName(seekers).select(F.xxhash64("shingle", "band", "block").alias("list"), "size", "root", "node", "reach", "looks")
    return both.repartition("list").sortWithinPartitions("list", "size", "node").mapInArrow(_probe, "a long, b long")


def _confirmed(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, percent: int, text_col: str) -> DataFrame:
    used = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct().join(nodes.select("node", "th"), "node")
    texts = docs.select(F.xxhash64(body(text_col)).alias("th"), body(text_col).alias("text")).join(used, "th").groupBy("node").agg(F.first("text").alias("text"))
    texts = stored(texts, "texts")
    side = [texts.select(F.col("node").alias(x), F.col("text").alias(f"t{x}")) for x in "ab"]
    return stored(pairs.join(side[0], "a").join(side[1], "b").select("a", "b", "ta", "tb").mapInArrow(_confirm(percent), "a long, b long"), "links")


def links(docs: DataFrame, sketch: DataFrame, percent: int, text_col: str = "text") -> DataFrame:
    """Pairs of nodes (a, b) whose full sets have at least that Jaccard similarity: enough to connect all that such pairs connect."""
    nodes = sketch.where("n_shingles > 0").groupBy("node").agg(F.min(F.struct("th", "sig")).alias("x")).select("node", "x.th", "x.sig")
    nodes = stored(nodes, "nodes")
    near = _confirmed(docs, nodes, candidates(nodes, percent), percent, text_col)
    rest = left_out(docs, nodes, components(near), percent, text_col)
    return near.unionByName(_confirmed(docs, nodes, rest, percent, text_col))


def near_duplicates(docs: DataFrame, percent: int = 80, keep: list[str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs (the columns in keep, or all) with n_shingles, component_id (the least id that links reach), kept (its own id is that) and group_id (of the component, whatever its ids; null for an empty set)."""
    sketch = sketches(docs, id_col, text_col)
    roots = components(links(docs, sketch, percent, text_col))
    placed = sketch.where("n_shingles > 0").select("__id", "node").join(roots, "node", "left").select("node", "__id", F.coalesce("root", "node").alias("root"))
    least = placed.groupBy("root").agg(F.min("__id").alias("component_id"))
    mine = sketch.where("n_shingles > 0").select("node").distinct().join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root")).join(least, "root").select("node", "root", "component_id")
    result = ["n_shingles", "component_id", "kept", "group_id"]
    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() not in result]
    if [c.lower() for c in kept] == [id_col.lower()]:
        out = sketch.select(F.col("__id").alias(id_col), F.col("node").alias("__node"), F.col("n_shingles").alias("__size"))
    else:
        of_text = stored(sketch.groupBy(F.col("th").alias("__th")).agg(F.first("node").alias("__node"), F.first("n_shingles").alias("__size")), "by-text")
        rows = docs.select(*kept, F.xxhash64(body(text_col)).alias("__th2"))
        out = rows.join(of_text, F.col("__th") == F.col("__th2")).select(*kept, "__node", "__size")
    mine = stored(mine.select(F.col("node").alias("__mine"), F.col("component_id").alias("__least"), F.col("root").alias("__root")), "least-ids")
    out = out.join(mine, F.col("__node") == F.col("__mine"), "left")
    component = F.when(F.col("__size") > 0, F.col("__least")).otherwise(F.col(id_col))
    return out.select(*kept, F.col("__size").alias("n_shingles"), component.alias("component_id"), F.col(id_col).eqNullSafe(component).alias("kept"), F.col("__root").alias("group_id"))
