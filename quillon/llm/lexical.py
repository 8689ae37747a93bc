"""Ranked lexical search: impact-ordered postings, scored score-at-a-time.

Terms are runs of ASCII letters and digits and of all beyond ASCII, A-Z in lower
case. N documents have a term, L is the number of all their terms. A term that df
documents hold weighs w = floor(1000 ln((2N+2) / (2df+1))); a posting's impact is
(10^9 tf) div (1000 tf + 12 m), m = 75 + (25 n N) div L for a document of n
terms; a document scores the sum of w times impact over the query's terms,
repeats included. Numbers are 64-bit integers (25 n N must fit), w comes from a
double's logarithm.

Index. Documents are cut into shards of at most ``shard_bytes`` of text, a row
of a table each: ids in ascending order, lengths, terms, and per term the
documents that hold it with their frequencies. It can be kept and searched again.
For a known batch of queries it need hold their terms alone.

Search. Shards go by tasks; the queries' terms and weights go to every task, in
blocks of at most ``block_bytes`` of query text, one after the other. In a shard a
term's postings are grouped by exact impact, greatest first, when a query first
asks for it. A query's groups of all its terms are merged by what they add to a
score, greatest first, and added to the documents' sums in rounds. After a round,
``rest`` is what the next groups of all terms add up to: no document can gain
more. Once rest is under the k-th best sum (of this shard, or of those before it
in the task), no document without a sum can get in, and those whose sum plus rest
stays under it are out; when completing the others costs less than going on,
their scores are completed from the postings. So no result hangs on where a query
stops. A task hands on its k best of each query, and the best k of those are
ranked; equal scores by ascending id, a null id last.

Nulls and odd rows: null text has no terms; such documents are in no result and
not in N. Queries without terms, or whose terms no document holds, have no rows.
Repeated document rows are documents of their own. Each row of queries is a query
of its own, even if ids repeat. Empty tables give empty results. Extra columns are
left out. Texts are used whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import terms
from .common import body, fresh_path, ship, stored
from .katz import pack, unpack

FOLDING = terms.folding(terms.DIGITS, terms.LETTERS)
SHARD_BYTES, BLOCK_BYTES = 16 << 20, 32 << 20
ROUND = 2048  # postings of the first round; each further one doubles


def _ids_kind(index: DataFrame) -> str:
    return index.schema["ids"].dataType.elementType.simpleString()


def _shard(ids: pa.Array, texts: pa.Array, only: pa.Array | None) -> dict:
    """The index row of some documents, whose ids are in ascending order."""
    code, first, known = terms.coded(terms.folded(texts, FOLDING))
    n = np.diff(first)
    doc = np.repeat(np.arange(len(texts)), n)
    if only is not None:
        kept = pc.is_in(known, value_set=only.cast(known.type)).to_numpy(zero_copy_only=False)
        at = np.flatnonzero(kept)
        number = np.full(len(known), -1, np.int64)
        number[at] = np.arange(len(at))
        code, known = number[code], known.take(pa.array(at))
        doc, code = doc[code >= 0], code[code >= 0]
    place, tf = np.unique(code * max(1, len(texts)) + doc, return_counts=True)
    term, doc = np.divmod(place, max(1, len(texts)))
    df = np.bincount(term, minlength=len(known))
    return {"n_docs": int((n > 0).sum()), "n_terms": int(n.sum()), "ids": ids, "lengths": pack(n), "terms": known.cast(pa.string()), "df": pa.array(df, pa.int64()), "docs": pack(doc.astype(np.uint32)), "tf": pack(tf.astype(np.uint32))}


def _row(row: dict, ids_kind: pa.DataType) -> pa.RecordBatch:
    lists = {c: pa.ListArray.from_arrays(pa.array([0, len(row[c])], pa.int32()), row[c]) for c in ("ids", "terms", "df")}
    kinds = {"n_docs": pa.int64(), "n_terms": pa.int64(), "lengths": pa.binary(), "docs": pa.binary(), "tf": pa.binary()}
    return pa.RecordBatch.from_arrays([lists[c] if c in lists else pa.array([row[c]], kinds[c]) for c in row], list(row))


def build_index(docs: DataFrame, path: str, only: list[str] | None = None, shard_bytes: int = SHARD_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the index of all documents to path, of all terms or of those in only (sent to every task), and reads it."""
    spark = docs.sparkSession
    ship(spark)
    shared = None if only is None else spark.sparkContext.broadcast(only)
    rows = docs.select(F.col(id_col).alias("id"), body(text_col).alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"n_docs long, n_terms long, ids array<{kind}>, lengths binary, terms array<string>, df array<bigint>, docs binary, tf binary"

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = None if shared is None else pa.array(shared.value, pa.large_string())
        for batch in batches:
            order = pc.sort_indices(batch.column("id"), null_placement="at_end")
            batch = batch.take(order)
            texts = terms.plain(batch.column("text"))
            for lo, hi in terms.slices(texts, shard_bytes):
                yield _row(_shard(batch.column("id").slice(lo, hi - lo), texts.slice(lo, hi - lo), wanted), batch.column("id").type)

    rows.mapInArrow(build, schema).write.parquet(path)
    return spark.read.schema(schema).parquet(path)


class Shard:
    """An index row, with the postings of each term grouped by exact impact once asked for."""

    def __init__(self, row: dict, ids: pa.Array, known: pa.Array, df: np.ndarray, wanted: pa.Array, n_docs: int, n_terms: int):
        self.ids, self.size = ids, len(ids)
        self.m = 75 + 25 * unpack(row["lengths"], np.int64) * n_docs // n_terms
        self.docs, self.tf = unpack(row["docs"], np.uint32).astype(np.int64), unpack(row["tf"], np.uint32).astype(np.int64)
        self.at = np.r_[0, np.cumsum(df)]
        self.number = pc.index_in(wanted, value_set=known).fill_null(-1).to_numpy(zero_copy_only=False)
        self._groups: dict[int, tuple] = {}

    def groups(self, term: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
        """Of a wanted term: documents in order, their impacts; impacts that occur, greatest first; where each one's documents begin, with the end; those documents. None if no document has it."""
        if term not in self._groups:
            number = self.number[term]
            found = None
            if number >= 0 and self.at[number] < self.at[number + 1]:
                part = slice(self.at[number], self.at[number + 1])
                docs, tf = self.docs[part], self.tf[part]
                impact = 1_000_000_000 * tf // (1000 * tf + 12 * self.m[docs])
                order = np.argsort(-impact, kind="stable")
                falling = impact[order]
                begins = np.flatnonzero(np.r_[True, falling[1:] != falling[:-1]])
                found = docs, impact, falling[begins], np.r_[begins, len(order)], docs[order]
            self._groups[term] = found
        return self._groups[term]


def search_shard(shard: Shard, query: list[tuple[int, int]], k: int, least: int, round_postings: int = ROUND) -> tuple[np.ndarray, np.ndarray, int]:
    """The k best (place, score), with score above 0 and not under least, of one shard for (term, weight) pairs; and how many postings were added up."""
    held = [(g, w) for t, w in query if w > 0 and (g := shard.groups(t)) is not None]
    none = np.zeros(0, np.int64)
    if not held:
        return none, none, 0
    adds = np.concatenate([g[2] * w for g, w in held])
    owner = np.repeat(np.arange(len(held)), [len(g[2]) for g, _ in held])
    size = np.concatenate([np.diff(g[3]) for g, _ in held])
    base = np.cumsum([0, *(len(g[4]) for g, _ in held)])
    begin = np.concatenate([g[3][:-1] + b for (g, _), b in zip(held, base)])
    docs = np.concatenate([g[4] for g, _ in held])
    order = np.argsort(-adds, kind="stable")  # a term's groups keep their order
    first_of = np.cumsum([0, *(len(g[2]) for g, _ in held)])
    total = np.cumsum(size[order])
    sums = np.zeros(shard.size, np.int64)
    done, step, taken = 0, round_postings, np.zeros(len(held), np.int64)
    while done < len(order):
        until = max(done + 1, int(np.searchsorted(total, (total[done - 1] if done else 0) + step, "right")))
        part = order[done:until]
        many = size[part]
        where = np.repeat(begin[part] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        np.add.at(sums, docs[where], np.repeat(adds[part], many))
        taken += np.bincount(owner[part], minlength=len(held))
        done, step = until, step * 2
        if done == len(order):
            break
        left = first_of[:-1] + taken
        rest = int(adds[left[left < first_of[1:]]].sum())
        bound = max(least, int(np.partition(sums, -k)[-k]) if shard.size >= k else 0)
        if rest < bound:
            places = np.flatnonzero(sums + rest >= bound)
            if len(places) * len(held) <= total[-1] - total[done - 1]:
                return *_best(places, _complete(held, places), k, least), int(total[done - 1])
    places = np.flatnonzero(sums)
    return *_best(places, sums[places], k, least), int(total[-1])


def _complete(held: list, places: np.ndarray) -> np.ndarray:
    """Whole scores of some documents."""
    scores = np.zeros(len(places), np.int64)
    for (docs, impact, *_), w in held:
        at = np.minimum(np.searchsorted(docs, places), len(docs) - 1)
        scores += np.where(docs[at] == places, impact[at] * w, 0)
    return scores


def _best(places: np.ndarray, scores: np.ndarray, k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    ok = (scores > 0) & (scores >= least)
    places, scores = places[ok], scores[ok]
    order = np.lexsort((places, -scores))[:k]  # places are in the order of ids
    return places[order], scores[order]


def _by_score(x: tuple) -> tuple:
    return -x[0], x[1] is None, x[1]


def _query_terms(texts: list[str | None]) -> list[dict[str, int]]:
    out = []
    code, first, known = terms.coded(terms.folded(terms.plain(pa.array(texts, pa.large_string())), FOLDING))
    words = known.to_pylist()
    for a, b in zip(first[:-1], first[1:]):
        number, times = np.unique(code[a:b], return_counts=True)
        out.append({words[i]: int(c) for i, c in zip(number.tolist(), times.tolist())})
    return out


def _search_block(index: DataFrame, queries: list[tuple[int, str]], k: int, n_docs: int, n_terms: int) -> DataFrame:
    """k best of each task for each query (number, text): number, id, score."""
    spark = index.sparkSession
    counts = _query_terms([t for _, t in queries])
    words = sorted({w for c in counts for w in c})
    asked = spark.createDataFrame(pa.table({"term": pa.array(words, pa.string())}))
    held = index.select(F.explode(F.arrays_zip("terms", "df")).alias("x")).select(F.col("x.terms").alias("term"), F.col("x.df").alias("df"))
    df = {r.term: r.df for r in held.join(F.broadcast(asked), "term").groupBy("term").agg(F.sum("df").alias("df")).collect()}  # a row per term of the block at most
    weight = {w: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for w, n in df.items()}
    number = {w: i for i, w in enumerate(weight)}
    shared = spark.sparkContext.broadcast((list(number), [(q, [(number[w], weight[w] * c) for w, c in cs.items() if w in number]) for (q, _), cs in zip(queries, counts)]))
    kind = _ids_kind(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, asked = shared.value
        wanted = pa.array(names, pa.string())
        best: dict[int, list[tuple]] = {}
        ids_kind = None
        for batch in batches:
            ids_kind = batch.column("ids").type.value_type
            for i in range(len(batch)):
                at = lambda c: batch.column(c)[i]
                if not at("n_docs").as_py():
                    continue
                shard = Shard({c: at(c).as_py() for c in ("lengths", "docs", "tf")}, at("ids").values, at("terms").values.cast(pa.string()), at("df").values.to_numpy(zero_copy_only=False), wanted, n_docs, n_terms)
                for q, query in asked:
                    mine = best.get(q, [])
                    places, scores, _ = search_shard(shard, query, k, mine[-1][0] if len(mine) == k else 0)
                    if len(places):
                        best[q] = sorted(mine + list(zip(scores.tolist(), shard.ids.take(pa.array(places)).to_pylist())), key=_by_score)[:k]
        rows = [(q, i, s) for q, found in best.items() for s, i in found]
        if rows:
            numbers, ids, scores = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), pa.array(ids, ids_kind), pa.array(scores, pa.int64())], ["__q", "doc_id", "score"])

    return index.mapInArrow(run, f"__q long, doc_id {kind}, score long")


def search(index: DataFrame, queries: DataFrame, k: int = 20, block_bytes: int = BLOCK_BYTES, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """For each row of queries its k best documents: the query's id, rank, doc_id and score."""
    spark = index.sparkSession
    ship(spark)
    asked = stored(queries.select(F.monotonically_increasing_id().alias("__q"), F.col(id_col).alias(id_col), body(text_col).alias("__text")), "search-queries")
    size = index.agg(F.sum("n_docs"), F.sum("n_terms")).first()
    n_blocks = -(-(asked.agg(F.sum(F.octet_length("__text"))).first()[0] or 0) // block_bytes)
    found = spark.createDataFrame([], f"__q long, doc_id {_ids_kind(index)}, score long")
    for i in range(n_blocks if size[1] else 0):
        block = asked.where(F.pmod(F.xxhash64("__q"), F.lit(n_blocks)) == i).select("__q", "__text").collect()
        found = found.unionByName(_search_block(index, [tuple(r) for r in block], k, *size))
    order = Window.partitionBy("__q").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    top = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return top.join(asked.drop("__text"), "__q").select(id_col, "rank", "doc_id", "score")


def search_documents(docs: DataFrame, queries: DataFrame, k: int = 20, vocabulary_bytes: int = 64 << 20, id_col: str = "item_id", text_col: str = "text", **options) -> DataFrame:
    """search over an index made for these queries: of their terms alone if their texts are at most so many bytes (measured first), else of all terms."""
    spark = docs.sparkSession
    texts = queries.select(body(text_col).alias("text"))
    only = None
    if (texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0) <= vocabulary_bytes:
        only = sorted({w for c in _query_terms([r.text for r in texts.collect()]) for w in c})
    return search(build_index(docs, fresh_path(spark, "search-index"), only, **options), queries, k, id_col=id_col, text_col=text_col)
