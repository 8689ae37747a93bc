"""Toxicity scores: gradient-boosted trees over dense text features, with isotonic calibration.

Features of a whole text: densities and tops of lexicon scores, how near lexicon
words are to second-person words, shares of capitals, marks and digits, and
rates of obfuscation (letters replaced or split inside a word, long runs of one
letter). The lexicon is learned, too: words and word beginnings that labelled
toxic rows have far more often than clean ones. All features of a block of texts
come from passes over its bytes and word hashes, without Python per word.

Fitting takes at most ``max_rows`` labelled rows (those of the least id hash): a
bounded sample, whose rows are split in three for the lexicon, the trees and the
calibration, so that no part learns from what another was fitted on; the lexicon
has no bound but what that sample holds. Ids, labels, language and source are
never inputs of a score. Scoring reads every row once. A score is the isotonic
value of the trees' sum, and one part in a million of its logistic value, which
decides between texts of one isotonic step.

Nulls and odd rows: a null text is empty and gets a score as an empty text does.
Rows without a label of 0 or 1 are not learned from; of several labels of one id
the greatest counts. Repeated rows get equal scores. With no labelled rows, or
one class alone, all scores are the share of toxic rows (0 for none). An empty
table gives an empty result. Extra columns pass through, but for score and
predicted, which are replaced. Very long texts are a block of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import vectext
from .common import body, ship, stored

MAX_ROWS = 20_000
# Letters that digits and signs stand for, signs that only split a word, and second-person words of English, German, French and Spanish.
LEET, SPLITS = dict(zip(b"013457@$!", b"oieastasi")), b"*._-"
SECOND = "you your yours yourself u ya du dich dir dein deine deinen ihr euch euer sie ihnen tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros os su".split()
PREFIXES = range(3, 10)
NEAR, RARE = 5, 3

CLASSES = np.zeros(256, np.int64)  # of bytes: 1 capital, 2 small letter, 3 digit, 4 sentence mark, 5 shout mark, 6 other sign, 7 white space, 8 beyond ASCII
for _k, _bytes in enumerate((range(65, 91), range(97, 123), range(48, 58), b".,;:'\"()-?", b"!", b"#$%&*+/<=>@[\\]^_`{|}~", b" \t\n\r\x0b\x0c", range(128, 256)), 1):
    CLASSES[list(_bytes)] = _k
LETTERS = np.zeros(256, bool)
LETTERS[97:123] = True
MASKABLE = LETTERS.copy()
MASKABLE[[*LEET, *SPLITS, *range(48, 58)]] = True
UNMASK = np.where(MASKABLE, np.arange(256), 32).astype(np.uint8)
UNMASK[list(LEET)] = list(LEET.values())

NAMES = "log_words sum_density top1 top2 top3 hits2 hits3 hits4 hits5 density3 near_second second masked masked_hits masked_top capitals marks shouts signs digits beyond_ascii runs mean_word".split()


def _hashes_of(words: list[str]) -> np.ndarray:
    (block,) = vectext.blocks(pa.array([" ".join(words)]))
    return np.sort(vectext.word_hashes(block[2], block[3], vectext.ALNUM)[0])


SECOND_HASHES = _hashes_of(SECOND)


def units(data: np.ndarray, hashes: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Words as (their places, their hashes), then their beginnings of each length."""
    yield np.arange(len(hashes)), hashes
    yield from vectext.prefixes(data, starts, stops, PREFIXES)


class Lexicon:
    """Log odds of words and word beginnings, by hash."""

    def __init__(self, odds: dict[int, float]):
        self.keys = np.array(sorted(odds), np.uint64)
        self.odds = np.array([odds[k] for k in sorted(odds)], float)
        self.maybe = np.zeros(1 << 20, bool)  # a first look, since most words are in no lexicon
        self.maybe[(self.keys & np.uint64(len(self.maybe) - 1)).astype(np.int64)] = True

    def scores(self, data: np.ndarray, hashes: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        """Of each word the greatest log odds among itself and its beginnings, at least 0."""
        out = np.zeros(len(hashes))
        if not len(self.keys) or not len(hashes):
            return out
        for words, h in units(data, hashes, starts, stops):
            some = np.flatnonzero(self.maybe[(h & np.uint64(len(self.maybe) - 1)).astype(np.int64)])
            at = np.minimum(np.searchsorted(self.keys, h[some]), len(self.keys) - 1)
            some, at = some[self.keys[at] == h[some]], at[self.keys[at] == h[some]]
            np.maximum.at(out, words[some], self.odds[at])
        return out


def _masked(low: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Words with letters on both sides of digits or signs, as they would be without: their bytes, row offsets, hashes, rows' first words, starts and ends."""
    inside = MASKABLE[low]
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    new = np.r_[True, ~inside[:-1] | (row[1:] != row[:-1])] & inside
    run = np.cumsum(new)  # number of the run that a byte is in, if inside
    letter = LETTERS[low]
    begins = letter & np.r_[True, ~letter[:-1] | new[1:]]
    twice = np.bincount(run[begins], minlength=len(run) + 1)[run] >= 2
    plain = np.where(inside & twice, UNMASK[low], 32).astype(np.uint8)
    kept = ~np.isin(plain, np.frombuffer(SPLITS, np.uint8))
    shorter = np.r_[0, np.cumsum(kept)][offsets]
    plain = plain[kept]
    return plain, *vectext.word_hashes(plain, shorter, vectext.SPACED)


def _sums(rows: np.ndarray, n: int, values: np.ndarray | None = None) -> np.ndarray:
    return np.bincount(rows, values, n).astype(float)


def features(texts: pa.Array, lexicon: Lexicon) -> np.ndarray:
    """A row of NAMES for each text."""
    parts = [_block_features(data, offsets, lexicon) for _, _, data, offsets in vectext.blocks(texts)]
    return np.concatenate(parts) if parts else np.zeros((0, len(NAMES)))


def _block_features(data: np.ndarray, offsets: np.ndarray, lexicon: Lexicon) -> np.ndarray:
    m = len(offsets) - 1
    if not len(data):
        return np.zeros((m, len(NAMES)))
    low = vectext.LOWER[data]
    hashes, first, starts, stops = vectext.word_hashes(data, offsets, vectext.ALNUM)
    row = np.repeat(np.arange(m), np.diff(first))
    count = np.diff(first)
    n = np.maximum(1, count)
    scores = lexicon.scores(data, hashes, starts, stops)
    x = {"log_words": np.log1p(count), "sum_density": _sums(row, m, np.where(scores >= 2, scores, 0)) / n}
    some = np.flatnonzero(scores > 0)
    some = some[np.lexsort((-scores[some], row[some]))]
    place = np.arange(len(some)) - np.searchsorted(row[some], row[some])
    for k in range(3):
        x[f"top{k + 1}"] = np.zeros(m)
        x[f"top{k + 1}"][row[some[place == k]]] = scores[some[place == k]]
    for k in (2, 3, 4, 5):
        x[f"hits{k}"] = np.log1p(_sums(row[scores >= k], m))
    hot = np.flatnonzero(scores >= 3)
    hits = _sums(row[hot], m)
    x["density3"] = hits / n
    at = np.minimum(np.searchsorted(SECOND_HASHES, hashes), len(SECOND_HASHES) - 1)
    second = np.flatnonzero(SECOND_HASHES[at] == hashes)
    near = np.zeros(len(hot), bool)
    if len(second):
        at = np.searchsorted(second, hot)
        for other in (second[np.minimum(at, len(second) - 1)], second[np.maximum(at - 1, 0)]):
            near |= (np.abs(other - hot) <= NEAR) & (row[other] == row[hot])
    x["near_second"] = _sums(row[hot[near]], m) / np.maximum(1, hits)
    x["second"] = _sums(row[second], m) / n
    plain, masked, masked_first, masked_starts, masked_stops = _masked(low, offsets)
    masked_row = np.repeat(np.arange(m), np.diff(masked_first))
    masked_scores = lexicon.scores(plain, masked, masked_starts, masked_stops)
    x["masked"] = np.diff(masked_first) / n
    x["masked_hits"] = np.log1p(_sums(masked_row[masked_scores >= 3], m))
    x["masked_top"] = np.zeros(m)
    np.maximum.at(x["masked_top"], masked_row, masked_scores)
    byte_row = np.repeat(np.arange(m), np.diff(offsets))
    kinds = np.bincount(byte_row * 9 + CLASSES[data], minlength=m * 9).reshape(m, 9)
    size = np.maximum(1, np.diff(offsets))
    x["capitals"] = kinds[:, 1] / np.maximum(1, kinds[:, 1] + kinds[:, 2] + kinds[:, 8])
    for name, k in (("marks", 4), ("shouts", 5), ("signs", 6), ("digits", 3), ("beyond_ascii", 8)):
        x[name] = kinds[:, k] / size
    same = (data[1:] == data[:-1]) & (CLASSES[data[1:]] <= 2) & (CLASSES[data[1:]] > 0) & (byte_row[1:] == byte_row[:-1])
    x["runs"] = _sums(byte_row[2:][same[1:] & same[:-1]], m) / n
    x["mean_word"] = np.diff(offsets) / n
    return np.stack([x[name] for name in NAMES], axis=1)


class Trees:
    """Boosted regression trees on the logistic loss, over quantile bins. Depth and number are small; fitting is a matter of seconds for the bounded sample."""

    def __init__(self, n_trees: int = 120, depth: int = 3, rate: float = 0.1, bins: int = 64, least: int = 10, ridge: float = 1.0):
        self.n_trees, self.depth, self.rate, self.bins, self.least, self.ridge = n_trees, depth, rate, bins, least, ridge
        self.base, self.trees = 0.0, []

    def fit(self, x: np.ndarray, y: np.ndarray) -> "Trees":
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        b = self._bin(x)
        p = np.clip(y.mean(), 1e-6, 1 - 1e-6)
        self.base = float(np.log(p / (1 - p)))
        f = np.full(len(y), self.base)
        for _ in range(self.n_trees):
            p = 1 / (1 + np.exp(-f))
            tree, leaf = self._grow(b, y - p, p * (1 - p))
            self.trees.append(tree)
            f += tree[2][leaf]
        return self

    def _bin(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, c, "right") for e, c in zip(self.edges, x.T)], axis=1).astype(np.int64)

    def _grow(self, b: np.ndarray, g: np.ndarray, h: np.ndarray):
        node = np.zeros(len(b), np.int64)
        feature, cut = np.zeros(2**self.depth, np.int64), np.full(2**self.depth, self.bins, np.int64)
        for level in range(self.depth):
            width = 2**level
            size = width * self.bins
            best = np.full(width, 1e-9)
            for j in range(b.shape[1]):
                key = node * self.bins + b[:, j]
                sums = [np.bincount(key, w, size).reshape(width, self.bins).cumsum(axis=1) for w in (g, h, None)]
                total = [s[:, -1:] for s in sums]
                gain = sums[0] ** 2 / (sums[1] + self.ridge) + (total[0] - sums[0]) ** 2 / (total[1] - sums[1] + self.ridge) - total[0] ** 2 / (total[1] + self.ridge)
                gain[(sums[2] < self.least) | (total[2] - sums[2] < self.least)] = 0
                at = gain.argmax(axis=1)
                better = gain[np.arange(width), at] > best
                best[better] = gain[np.arange(width), at][better]
                feature[width - 1 : 2 * width - 1][better] = j
                cut[width - 1 : 2 * width - 1][better] = at[better]
            node = 2 * node + (b[np.arange(len(b)), feature[width - 1 + node]] > cut[width - 1 + node])
        leaves = 2**self.depth
        value = self.rate * np.bincount(node, g, leaves) / (np.bincount(node, h, leaves) + self.ridge)
        return (feature, cut, value), node

    def raw(self, x: np.ndarray) -> np.ndarray:
        b = self._bin(x)
        f = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, cut, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for level in range(self.depth):
                at = 2**level - 1 + node
                node = 2 * node + (b[rows, feature[at]] > cut[at])
            f += value[node]
        return f


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: increasing knots (x, y) to interpolate between."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []  # sum of y, of x, number
    for a, b in zip(x[order].tolist(), y[order].tolist()):
        blocks.append([b, a, 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][2] >= blocks[-1][0] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last)]
    return np.array([b[1] / b[2] for b in blocks]), np.array([b[0] / b[2] for b in blocks])


class Scorer:
    def __init__(self, lexicon: Lexicon, trees: Trees | None, knots: tuple[np.ndarray, np.ndarray], constant: float):
        self.lexicon, self.trees, self.knots, self.constant = lexicon, trees, knots, constant

    def __call__(self, texts: pa.Array) -> np.ndarray:
        if self.trees is None:
            return np.full(len(texts), self.constant)
        return self.calibrated(self.trees.raw(features(texts, self.lexicon)))

    def calibrated(self, raw: np.ndarray) -> np.ndarray:
        """The isotonic value; a millionth of the logistic one keeps order within a step."""
        return np.clip((1 - 1e-6) * np.interp(raw, *self.knots) + 1e-6 / (1 + np.exp(-raw)), 0, 1)


def _count_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many toxic (a) and clean (b) texts of a task's block each unit is."""
    for batch in batches:
        toxic = batch.column("__toxic").to_numpy()
        for lo, hi, data, offsets in vectext.blocks(batch.column("__text")):
            hashes, first, starts, stops = vectext.word_hashes(data, offsets, vectext.ALNUM)
            row = np.repeat(np.arange(hi - lo), np.diff(first))
            found = [np.stack([h, row[w].astype(np.uint64)], axis=1) for w, h in units(data, hashes, starts, stops)] if len(hashes) else []
            pairs = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.uint64)
            keys, index = np.unique(pairs[:, 0], return_inverse=True)
            mark = toxic[lo:hi][pairs[:, 1].astype(np.int64)] if len(pairs) else np.zeros(0)
            a = np.bincount(index, mark, len(keys)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(a), pa.array(np.bincount(index, minlength=len(keys)) - a, pa.int64())], ["unit", "a", "b"])


def fit(docs: DataFrame, labels: DataFrame, held_out: Column, max_rows: int = MAX_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Scorer:
    """A scorer, learned from at most max_rows labelled rows that are not held out (held_out: over the id column)."""
    spark = docs.sparkSession
    ship(spark)
    mine = labels.where(~F.coalesce(held_out, F.lit(False)) & F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(F.max(label_col).cast("int").alias("__toxic"))
    mine = mine.withColumn("__order", F.xxhash64("__id")).orderBy("__order", "__id").limit(max_rows)
    mine = mine.withColumn("__part", F.when(F.pmod("__order", F.lit(5)) < 2, 0).when(F.pmod("__order", F.lit(5)) < 4, 1).otherwise(2)).drop("__order")
    # max_rows bounds what is sent
    sample = docs.select(F.col(id_col).alias("__id2"), body(text_col).alias("__text")).join(F.broadcast(mine), F.col("__id2") == F.col("__id")).select("__text", "__toxic", "__part")
    sample = stored(sample, "labelled")
    n = {(r["__part"], r["__toxic"]): r["count"] for r in sample.groupBy("__part", "__toxic").count().collect()}
    total = sum(n.values())
    share = sum(v for k, v in n.items() if k[1] == 1) / total if total else 0.0
    if any(n.get((p, t), 0) < 2 for p in (0, 1, 2) for t in (0, 1)):
        return Scorer(Lexicon({}), None, (np.zeros(1), np.zeros(1)), share)
    a, b = float(n[0, 1]), float(n[0, 0])
    counted = sample.where("__part = 0").select("__text", "__toxic").mapInArrow(_count_units, "unit long, a long, b long").groupBy("unit").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    odds = F.log((F.col("a") + 0.5) / (a + 1)) - F.log((F.col("b") + 0.5) / (b + 1))
    counted = counted.where(F.col("a") >= RARE).withColumn("odds", odds).withColumn("z", F.col("odds") / F.sqrt(1 / (F.col("a") + 0.5) + 1 / (F.col("b") + 0.5))).where("z > 2.5 and odds > 1")
    lexicon = Lexicon({r.unit % (1 << 64): r.odds for r in counted.select("unit", "odds").collect()})  # bounded by the sample
    shared = spark.sparkContext.broadcast(lexicon)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = features(batch.column("__text"), shared.value)
            yield pa.RecordBatch.from_arrays([batch.column("__part"), batch.column("__toxic"), pa.array(list(x), pa.list_(pa.float64()))], ["part", "toxic", "x"])

    rows = sample.where("__part > 0").mapInArrow(measure, "part int, toxic int, x array<double>").collect()
    rows.sort(key=lambda r: (r.part, r.toxic, r.x))  # the order in which tasks end has no say
    x, y, part = np.array([r.x for r in rows]), np.array([r.toxic for r in rows], float), np.array([r.part for r in rows])
    trees = Trees().fit(x[part == 1], y[part == 1])
    return Scorer(lexicon, trees, isotonic(trees.raw(x[part == 2]), y[part == 2]), share)


def score(docs: DataFrame, scorer: Scorer, keep: list[str] | None = None, text_col: str = "text") -> DataFrame:
    """docs (the columns in keep, or all) with score and predicted."""
    ship(docs.sparkSession)
    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() not in ("score", "predicted")]
    schema = T.StructType([*(docs.schema[c] for c in kept), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    shared = docs.sparkSession.sparkContext.broadcast(scorer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = shared.value(batch.column(text_col))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32))], schema.names)

    return docs.select(*dict.fromkeys([*kept, text_col])).mapInArrow(run, schema)
