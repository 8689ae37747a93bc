"""The pipeline against plain Python on a small folder, stage by stage and as a whole."""

import re
from collections import Counter, defaultdict

import brute
import corpus_pipeline as pipeline
from quillon.llm import quality

SF = "/root/testdata/sf0.001"
SPACE = " \t\n\x0b\f\r"


def words(t):
    return brute.SPACED.findall(t)


def plain_quality(text):
    """The text that is left, or None if the document is rejected."""
    text = text or ""
    w = words(text)
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {i + k for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for k in range(5)}
    if not w or 100 * len(covered) > 20 * len(w):
        return None
    kept, lost, total = [], 0, sum(map(len, w))
    for line in text.split("\n"):
        lw = words(line)
        bad = lw and (
            len(re.findall(quality.MARK_RUN, line)) >= quality.RUN_SHARE * len(lw)
            or (len(lw) >= quality.LONG_LINE and not re.search(quality.SENTENCE_END, line))
            or (len(lw) > 3 and sum(a == b for a, b in zip(lw, lw[1:])) >= max(3, 0.3 * len(lw)))
            or len(re.findall(quality.NAV_CELL, line)) >= max(1, quality.NAV_SHARE * len(lw))
            or re.search(quality.BOILERPLATE, brute.lower(line))
        )
        if bad:
            lost += sum(map(len, lw))
        else:
            kept.append(line)
    return "\n".join(kept) if lost <= quality.MAX_LOST * total else None


def plain_line_dedup(docs):
    key = lambda line: brute.lower(line.strip(SPACE))
    found = Counter(k for t in docs.values() for k in {key(x) for x in t.split("\n")} if k)
    return {i: "\n".join(x for x in t.split("\n") if found[key(x)] < 10) for i, t in docs.items()}


def plain_clean(docs, items):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", brute.lower(t or ""))
    windows = defaultdict(set)
    for t in items:
        w = split(t)
        n = min(10, len(w))
        for k in range(len(w) - n + 1) if n else []:
            windows[n].add(tuple(w[k : k + n]))
    return {i: t for i, t in docs.items() if not any(tuple(w[k : k + n]) in s for w in [split(t)] for n, s in windows.items() for k in range(len(w) - n + 1))}


def test_pipeline_against_plain(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    source = {r.doc_id: r.source for r in rows}
    docs = {r.doc_id: t for r in rows if (t := plain_quality(r.text)) is not None}
    docs = plain_line_dedup(docs)
    groups = brute.near_duplicates(list(docs.items()), 80)
    docs = {i: t for i, t in docs.items() if groups[i][1] == i}
    docs = plain_clean(docs, [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()])
    got = pipeline.run(spark, SF).collect()
    size = {i: len(words(t)) for i, t in docs.items()}
    copies = Counter(r.doc_id for r in got)
    assert {(r.doc_id, r.text, r.source, r.n_chars, r["size"]) for r in got} == {(i, docs[i], source[i], len(docs[i]), size[i]) for i in copies}
    assert all(r.copies == copies[r.doc_id] <= 2 for r in got)
    totals, taken = Counter(), Counter()
    for i in docs:
        totals[source[i]] += size[i]
        taken[source[i]] += size[i] * copies[i]
    # sources in order weigh 5, 2, 1; those under twice their size get in proportion to the weight
    largest = max(size.values())
    assert abs(sum(taken.values()) - 1.5 * sum(totals.values())) <= largest * len(totals)
    assert all(taken[s] <= 2 * totals[s] for s in totals)


def test_odd_rows(spark):
    """Nulls in every column, repeated rows, empty and very long texts, through all stages."""
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    prose = [" ".join(f"w{i}x{k}" for i in range(30)) + "." for k in range(6)]
    rows = [(1, prose[0], "en", "a", 5), (1, prose[0], "en", "a", 5), (2, prose[0], None, None, None), (None, prose[1], "en", "a", 5), (None, prose[1], None, "b", 1), (3, None, "en", "a", 0), (4, "", "en", None, 0), (5, " \n\n ", "en", "a", 3)]
    rows += [(6, prose[2] + "\n" + "\n".join(f"line {k} of a very long text that ends." for k in range(20000)), "en", "b", 9), (7, prose[3], "en", "b", 1)]
    docs = spark.createDataFrame(rows, schema)
    for _, stage in pipeline.STAGES:
        out = stage(spark, docs, SF)
        docs = spark.createDataFrame(out.collect(), out.schema)
    kept = Counter(r.doc_id for r in docs.collect())
    assert set(kept) <= {1, None, 6, 7} and kept[3] == 0
    ones = spark.createDataFrame(rows[:3], schema)
    assert [r.doc_id for r in pipeline.near_duplicates(spark, ones, SF).collect()] == [1]  # equal rows: one stays
    nulls = spark.createDataFrame(rows[3:5], schema)
    assert pipeline.near_duplicates(spark, nulls, SF).count() == 1


def test_stages_keep_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    empty = docs.limit(0)
    assert 4 <= len(pipeline.STAGES) <= 5
    for name, stage in pipeline.STAGES[:-1]:
        assert stage(spark, empty, SF).columns == docs.columns, name
        assert stage(spark, empty, SF).count() == 0
    assert pipeline.STAGES[-1][1](spark, empty, SF).count() == 0
