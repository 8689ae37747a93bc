"""Source divergence audit: which sources of a language differ, and by which terms.

Terms are runs of ASCII letters and of all beyond ASCII, A-Z in lower case. A
language keeps the V terms that at least ``min_docs`` of its documents hold. A
group, a source within a language or the language as a whole, with N occurrences
of kept terms gives each kept term p = 1 + (10^9 (n+1)) div (N + V), n its
occurrences there, none included. Two groups differ at a term by
f = ((p-q) (p-q)) div q. All of it is whole numbers: decimals where a product can
pass 64 bits, else 64-bit integers.

First pass: documents are read once, folded and cut into blocks of a language
and at most ``block_bytes`` of text (or one document), kept as compressed files
in the shared folder, a text per source; a block hands on its distinct terms with
their exact document frequencies. Sums over blocks give the kept terms.

Second pass: a block is sent the kept terms among its own, makes an automaton of
them, each between delimiters, and recounts their occurrences by source. So an
automaton is as large as a block's vocabulary, whatever the language's is, and
nothing is sent to all tasks.

The counts, none of which is zero, are sparse postings: a row per term with the
sources that have it. Pairs come from them without a row for each term and pair.
Where neither of two sources has a term, f is one number for all such terms;
where one has it, f hangs on that one's count alone, and a source has few different
counts; where both have it, f less what the former two would give is summed term
by term in arrays. Work on a term grows with the square of its sources at most,
as the result does.

Nulls and odd rows: null text, language and source are empty ones. Repeated rows
are documents of their own. A language without kept terms has pairs of value 0 and
no terms. An empty table gives an empty result. Extra columns are left out. Texts
are used whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import terms
from .common import body, fresh_path, ship, stored
from .katz import _Batches, _read_batch

MIN_DOCS, TOP_TERMS, BLOCK_BYTES = 3, 200, 16 << 20
SCALE = 1_000_000_000
FOLDING = terms.folding(terms.LETTERS)
BLOCK = pa.schema([("source", pa.string()), ("text", pa.binary())])
BLOCKS = "block long, file string, batch int, lang string, terms array<string>, df array<int>"
PAIRS_AT_ONCE = 1 << 18  # pairs of postings in an array, and sums that a task holds


class _Block:
    """Documents of one language, folded, that wait for their block to fill."""

    def __init__(self) -> None:
        self.texts: list[pa.Array] = []
        self.sources: list[np.ndarray] = []
        self.nbytes = 0

    def add(self, texts: pa.Array, sources: np.ndarray) -> None:
        self.texts.append(texts)
        self.sources.append(sources)
        self.nbytes += texts.nbytes

    def close(self) -> tuple[pa.RecordBatch, pa.Array, np.ndarray]:
        """The block's file rows, its distinct terms, and in how many of its documents each stands."""
        texts, sources = pa.concat_arrays(self.texts), np.concatenate(self.sources)
        code, first, known = terms.coded(texts)
        doc = np.repeat(np.arange(len(texts)), np.diff(first))
        # a document's term once: by a hash table, which is faster than sorting and needs less memory
        once = pc.unique(pa.array(doc * max(1, len(known)) + code)).to_numpy()
        df = np.bincount(once % max(1, len(known)), minlength=len(known))
        rows = []
        for source in np.unique(sources):
            joined = " ".join(["", *texts.take(pa.array(np.flatnonzero(sources == source))).to_pylist(), ""])
            rows.append({"source": source, "text": zstandard.compress(joined.encode(), 1)})
        self.__init__()
        return pa.RecordBatch.from_pylist(rows, BLOCK), known.cast(pa.string()), df


def _cut(folder: str, block_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, waiting, n = _Batches(folder, BLOCK), {}, 0

        def close(lang: str) -> pa.RecordBatch:
            nonlocal n
            rows, known, df = waiting[lang].close()
            n += 1
            row = [pa.array([(TaskContext.get().partitionId() << 24) + n], pa.int64()), pa.array([out.path]), pa.array([out.add(rows)], pa.int32()), pa.array([lang], pa.string())]
            ends = pa.array([0, len(known)], pa.int32())
            return pa.RecordBatch.from_arrays([*row, pa.ListArray.from_arrays(ends, known), pa.ListArray.from_arrays(ends, pa.array(df, pa.int32()))], [x.split()[0] for x in BLOCKS.split(", ")])

        for batch in batches:
            texts = terms.folded(terms.plain(batch.column("text")), FOLDING)
            langs, sources = (np.array(batch.column(c).to_pylist(), object) for c in ("lang", "source"))
            for lang in set(langs.tolist()):
                at = np.flatnonzero(langs == lang)
                mine, own = texts.take(pa.array(at)), sources[at]
                block = waiting.setdefault(lang, _Block())
                for lo, hi in terms.slices(mine, block_bytes):
                    block.add(mine.slice(lo, hi - lo), own[lo:hi])
                    if block.nbytes >= block_bytes:
                        yield close(lang)
            # a task with very many languages keeps no more text than some blocks'
            for lang in sorted(waiting, key=lambda x: -waiting[x].nbytes):
                if sum(b.nbytes for b in waiting.values()) <= 4 * block_bytes:
                    break
                yield close(lang)
        for lang, block in waiting.items():
            if block.texts:
                yield close(lang)
        out.close()

    return run


def _recount(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From blocks with their kept terms to a row per source and term: its occurrences."""
    import ahocorasick

    for batch in batches:
        for row in range(len(batch)):
            lang, known = batch.column("lang")[row].as_py(), batch.column("kept")[row].values
            automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
            for i, term in enumerate(known.to_pylist()):
                automaton.add_word(f" {term} ", i)
            automaton.make_automaton()
            for group in _read_batch(batch.column("file")[row].as_py(), batch.column("batch")[row].as_py()).to_pylist():
                count = np.zeros(len(known), np.int64)
                hits = automaton.iter(zstandard.decompress(group["text"]).decode())
                while found := [i for _, i in islice(hits, 1 << 16)]:
                    count += np.bincount(found, minlength=len(known))
                at = np.flatnonzero(count)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array([group["source"]] * len(at), pa.string()), known.take(pa.array(at)).cast(pa.string()), pa.array(count[at])], ["lang", "source", "term", "n"])


def _p(n: Column, total: Column, kept: Column) -> Column:
    """1 + (10^9 (n+1)) div (N + V); null where a language keeps no term."""
    share = F.lit(SCALE).cast("decimal(10,0)") * (n + 1).cast("decimal(19,0)")
    return F.call_function("div", share, F.nullif(total + kept, F.lit(0)).cast("decimal(20,0)")) + 1


def _f(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def _both(n_groups: int):
    """From a term's postings to what pairs of sources that both have it add: a row per pair and task, more only where a task meets very many pairs."""

    def f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        return (p - q) * (p - q) // q

    def summed(keys: list[np.ndarray], values: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        key, index = np.unique(np.concatenate(keys), return_inverse=True)
        out = np.zeros(len(key), np.int64)
        np.add.at(out, index, np.concatenate(values))
        return key, out

    def rows(key: np.ndarray, value: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(key // n_groups), pa.array(key % n_groups), pa.array(value)], ["a", "b", "value"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, values = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for batch in batches:
            held = batch.column("held")
            size = held.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            flat = held.flatten()
            g, p, zero = (flat.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("g", "p", "zero"))
            # the first posting of a pair, one after the other; its term's postings are the second ones
            many = np.repeat(size, size)
            begin = np.repeat(np.cumsum(size) - size, size)
            ends = np.cumsum(many)
            lo = 0
            while lo < len(g):
                hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + PAIRS_AT_ONCE, "right")))
                n = many[lo:hi]
                i = np.repeat(np.arange(lo, hi), n)
                j = np.repeat(begin[lo:hi] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                other = i != j
                i, j = i[other], j[other]
                keys.append(g[i] * n_groups + g[j])
                values.append(f(p[i], p[j]) - f(p[i], zero[j]) - f(zero[i], p[j]) + f(zero[i], zero[j]))
                key, value = summed(keys, values)
                keys, values = [key], [value]
                if len(key) > PAIRS_AT_ONCE:
                    yield rows(key, value)
                    keys, values = [key[:0]], [value[:0]]
                lo = hi
        yield rows(*summed(keys, values))

    return run


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top_terms: int = TOP_TERMS, block_bytes: int = BLOCK_BYTES, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value and rank of all groups."""
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(body(lang_col).alias("lang"), body(source_col).alias("source"), body(text_col).alias("text"))
    blocks = stored(rows.mapInArrow(_cut(fresh_path(spark, "audit-texts"), block_bytes), BLOCKS), "audit-blocks")
    own = blocks.select("block", "lang", F.explode(F.arrays_zip("terms", "df")).alias("x")).select("block", "lang", F.col("x.terms").alias("term"), F.col("x.df").alias("df"))
    kept = stored(own.groupBy("lang", "term").agg(F.sum("df").alias("docs")).where(F.col("docs") >= min_docs).select("lang", "term"), "audit-terms")
    wanted = own.join(kept, ["lang", "term"], "left_semi").groupBy("block").agg(F.collect_list("term").alias("kept"))  # at most a block's terms
    asked = wanted.join(blocks.select("block", "file", "batch", "lang"), "block")
    counts = asked.select("lang", "kept", "file", "batch").mapInArrow(_recount, "lang string, source string, term string, n long")
    postings = stored(counts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n")), "audit-postings")

    # a row per group; numbering them is one task's work
    n_kept = kept.groupBy("lang").agg(F.count("*").alias("v"))
    totals = postings.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    known = rows.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(n_kept, "lang", "left").fillna(0, ["total", "v"])
    zero = _p(F.lit(0).cast("long"), F.col("total"), F.col("v"))
    number = (F.row_number().over(Window.orderBy("lang", "source")) - 1).cast("long")
    groups = stored(known.select(number.alias("g"), "lang", "source", "total", "v", zero.alias("zero")), "audit-groups")
    n_groups = groups.count()
    by_term = postings.join(groups, ["lang", "source"]).select("lang", "term", "n", F.struct("g", _p(F.col("n"), F.col("total"), F.col("v")).alias("p"), "zero").alias("x"))
    by_term = stored(by_term.groupBy("lang", "term").agg(F.sum("n").alias("n"), F.collect_list("x").alias("held")), "audit-by-term")  # at most a language's sources
    return _term_part(by_term, groups, n_kept, top_terms).unionByName(_pair_part(by_term, groups, n_groups))


def _ranked(rows: DataFrame) -> DataFrame:
    order = Window.partitionBy("g").orderBy(F.col("value").desc(), F.col("item"))
    return rows.withColumn("rank", F.row_number().over(order))


def _term_part(by_term: DataFrame, groups: DataFrame, n_kept: DataFrame, top_terms: int) -> DataFrame:
    langs = stored(by_term.groupBy("lang").agg(F.sum("n").alias("total")).join(n_kept, "lang"), "audit-languages")
    own = by_term.join(langs, "lang").select("term", _p(F.col("n"), F.col("total"), F.col("v")).alias("q"), F.explode("held").alias("x"))
    over = own.where(F.col("x.p") > F.col("q")).select(F.col("x.g").alias("g"), F.col("term").alias("item"), _f(F.col("x.p"), F.col("q")).alias("value"))
    top = _ranked(over).where(F.col("rank") <= top_terms)
    return top.join(groups, "g").select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")


def _pair_part(by_term: DataFrame, groups: DataFrame, n_groups: int) -> DataFrame:
    both = by_term.select("held").mapInArrow(_both(max(1, n_groups)), "a long, b long, value long")
    # terms of a source by their p, against each other source as one that lacks them: both ways
    levels = by_term.select(F.explode("held").alias("x")).groupBy(F.col("x.g").alias("g"), F.col("x.p").alias("p")).agg(F.count("*").alias("times"))
    levels = stored(levels.join(groups.select("g", "lang", "zero"), "g"), "audit-levels")
    others = groups.select(F.col("g").alias("h"), "lang", F.col("zero").alias("other"))
    mine, lacking = F.col("zero"), F.col("other")
    alone = levels.join(others, "lang").where(F.col("g") != F.col("h")).select("g", "h", (F.col("times") * (_f(F.col("p"), lacking) - _f(mine, lacking))).alias("to"), (F.col("times") * (_f(lacking, F.col("p")) - _f(lacking, mine))).alias("fro")).groupBy("g", "h").agg(F.sum("to").alias("to"), F.sum("fro").alias("fro"))
    there, back = alone.select(F.col("g").alias("a"), F.col("h").alias("b"), F.col("to").alias("value")), alone.select(F.col("h").alias("a"), F.col("g").alias("b"), F.col("fro").alias("value"))
    one, two = groups.select(F.col("g").alias("a"), "lang", "source", "v", "zero"), groups.select(F.col("g").alias("b"), "lang", F.col("source").alias("item"), F.col("zero").alias("other"))
    neither = one.join(two, "lang").where(F.col("a") != F.col("b")).select("a", "b", F.coalesce(F.col("v") * _f(F.col("zero"), F.col("other")), F.lit(0)).cast("long").alias("value"))
    sums = neither.unionByName(there).unionByName(back).unionByName(both).groupBy("a", "b").agg(F.sum("value").alias("value"))
    named = sums.join(groups.select(F.col("g").alias("a"), "lang", "source"), "a").join(groups.select(F.col("g").alias("b"), F.col("source").alias("item")), "b")
    return _ranked(named.withColumnRenamed("a", "g")).select("lang", "source", F.lit("pair").alias("part"), "item", "value", "rank")
