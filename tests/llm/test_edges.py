"""Nulls, empty and long texts, ties, repeated rows, empty tables, clashing names: each operator's defined results."""

import hashlib
import random

import brute
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from quillon.llm import chat, components, decontaminate, line_dedup, mixing, neardup, quality, token_counts, toxicity, warc

DOCS = "doc_id long, text string, source string, size long, copies int, items string, node long, n_words long, kept string"


def frame(spark, rows):
    """Rows of (doc_id, text, source) with columns named as the operators' own."""
    return spark.createDataFrame([(*r, 7, 7, "x", 7, 7, "k") for r in rows], DOCS)


def odd_rows():
    r = random.Random(3)
    words = [f"w{i}" for i in range(60)]
    long_text = "\n".join(" ".join(r.choices(words, k=12)) for _ in range(4000))
    rows = [(1, None, "b"), (2, "", None), (3, "one two", "a"), (3, "one two", "a"), (None, "ÉCOLE one\ttwo three four FIVE", None), (4, long_text, "a"), (4, long_text, "b"), (5, " \n\t\n ", "a")]
    return rows + [(10 + i, " ".join(r.choices(words, k=r.randint(0, 40))), r.choice(["a", "b", None, ""])) for i in range(40)]


def test_decontaminate_plans_agree_and_match_brute(spark):
    r = random.Random(1)
    words = [f"t{i}" for i in range(25)] + ["é", "x1"]
    items = [(i, " ".join(r.choices(words, k=r.choice([0, 1, 3, 9, 10, 11, 30])))) for i in range(30)] + [(None, "t1 t2"), (7, "same id again T3 t4"), (40, None)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = odd_rows() + [(100 + i, " ".join(r.choices(words, k=120)) + ". " + (items[i % 30][1].upper() if i % 2 else ""), "a") for i in range(30)]
    docs = frame(spark, rows)

    def split(t):
        import re

        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", brute.lower(t or ""))

    windows = {}
    for i, t in items:
        w = split(t)
        n = min(10, len(w))
        for k in range(len(w) - n + 1) if n and i is not None else []:
            windows.setdefault(tuple(w[k : k + n]), set()).add(str(i))
    want = []
    for i, t, _ in rows:
        w = split(t)
        hit, found = set(), set()
        for n in range(1, 11):
            for k in range(len(w) - n + 1):
                if ids := windows.get(tuple(w[k : k + n])):
                    found |= ids
                    hit |= set(range(k, k + n))
        want.append((i, len(w), len(hit), tuple(sorted(found))))
    key = lambda x: (x[0] is None, x)
    for limit in (1 << 20, 0):
        out = decontaminate.decontaminate(docs, bench, broadcast_bytes=limit)
        assert out.columns[:3] == ["doc_id", "text", "source"]
        got = [(x.doc_id, x.n_words, x.n_hit, tuple(x["items"])) for x in out.collect()]
        assert sorted(got, key=key) == sorted(want, key=key)
    empty = frame(spark, [])
    assert decontaminate.decontaminate(empty, bench).count() == 0
    clean = decontaminate.decontaminate(docs, bench.limit(0))
    assert clean.where("contaminated").count() == 0 and clean.count() == len(rows)


def test_decontaminate_passage_of_all_items(spark):
    """A passage that every item shares is found in every document that has it, by both plans, with all items."""
    passage = " ".join(f"p{i}" for i in range(14))
    items = [(i, f"a{i} b{i} {passage} c{i}") for i in range(300)] + [(500, " ".join(f"p{i}" for i in range(2, 6)))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [(i, f"x{i} {passage} y{i}" if i % 2 else f"x{i} clean text of its own", "a") for i in range(60)]
    want = {i: (14, sorted(str(x) for x, _ in items)) if i % 2 else (0, []) for i, _, _ in rows}
    for limit in (1 << 20, 0):
        out = decontaminate.decontaminate(frame(spark, rows), bench, broadcast_bytes=limit).collect()
        assert {x.doc_id: (x.n_hit, x["items"]) for x in out} == want


@pytest.mark.parametrize("n", range(7))
def test_decontaminate_one_short_document(spark, n):
    """A block of one text of fewer words than a fingerprint's window."""
    words = ["one", "two", "three", "four", "five", "six"][:n]
    bench = spark.createDataFrame([(1, " ".join(f"b{i}" for i in range(12))), (2, "two three")], "item_id long, text string")
    for limit in (1 << 20, 0):
        out = decontaminate.decontaminate(frame(spark, [(1, " ".join(words), "a")]).coalesce(1), bench, broadcast_bytes=limit)
        assert [(x.n_words, x.n_hit, x["items"]) for x in out.collect()] == [(n, 2, ["2"]) if n >= 3 else (n, 0, [])]


def test_token_counts(spark, tmp_path):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    rows = odd_rows() + [(200, "a<|endoftext|>b <|startoftext|> x's I'LL 12 ", "a"), (201, "é ΣΑΣ İ   z\x1c\x85end", "a"), (202, "don't\nstop'S ﬁ", "b")]
    docs = frame(spark, rows)
    for name, by_words in (("word_bpe_49k.json", True), ("word_bpe_49k.json", False), ("byte_bpe_50k.json", False), ("piece_bpe_32k.model", False)):
        cache = str(tmp_path / f"{name}-{by_words}")
        got = token_counts.count_tokens(docs, P.path(name), cache, by_words=by_words).collect()
        if name.endswith(".json"):
            t = Tokenizer.from_file(P.path(name))
            count = lambda x, t=t: len(t.encode(x, add_special_tokens=False))
        else:
            import sentencepiece

            count = lambda x, s=sentencepiece.SentencePieceProcessor(model_file=P.path(name)): len(s.encode(x))
        assert len(got) == len(rows)
        for x in got:
            assert (x.n_tokens, x.n_bytes) == (count(x.text or ""), len((x.text or "").encode())), (name, x.doc_id)
        cached = spark.read.parquet(cache)
        assert cached.count() == cached.select("digest").distinct().count()
        again = token_counts.count_tokens(docs, P.path(name), cache, by_words=by_words, keep=["doc_id"])
        assert again.count() == len(rows) and spark.read.parquet(cache).count() == cached.count()  # nothing was encoded anew
    assert token_counts.count_tokens(frame(spark, []), P.path("word_bpe_49k.json"), str(tmp_path / "none")).count() == 0


def test_mixing(spark):
    r = random.Random(9)
    rows = odd_rows() + [(1000 + i, " ".join(["w"] * r.randint(1, 30)), r.choice("aaaaab")) for i in range(600)]
    out = mixing.mix_sources(frame(spark, rows)).cache()
    got = out.collect()
    assert len(got) == len(rows)
    totals, targets, taken = {}, {}, {}
    for x in got:
        assert x.size == len(brute.SPACED.findall(x.text or "")) and 0 <= x.copies <= 2
        totals[x.source] = totals.get(x.source, 0) + x.size
        taken[x.source] = taken.get(x.source, 0) + x.size * x.copies
        targets[x.source] = x.target
    assert all(x.source_size == totals[x.source] for x in got)
    order = sorted(totals, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    want, capped, total = {}, set(), 1.5 * sum(totals.values())
    while True:
        free = [s for s in order if s not in capped]
        rest = total - sum(2 * totals[s] for s in capped)
        want = {s: 2 * totals[s] for s in capped} | {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if want[s] > 2 * totals[s]}
        if not over:
            break
        capped |= over
    for s in order:
        assert targets[s] == pytest.approx(want[s])
        assert abs(taken[s] - targets[s]) <= max([x.size for x in got if x.source == s] + [1])
    assert sorted(map(str, mixing.mix_sources(frame(spark, rows[::-1])).select("doc_id", "copies").collect())) == sorted(map(str, out.select("doc_id", "copies").collect()))
    assert mixing.expand(out).count() == sum(x.copies for x in got)
    assert mixing.mix_sources(frame(spark, [])).count() == 0
    assert [x.copies for x in mixing.mix_sources(frame(spark, [(1, None, "a"), (2, "", None)])).collect()] == [0, 0]


def test_quality(spark):
    prose = "The quick brown fox ran over a low green hill. It stopped there for tea and rest."
    rows = odd_rows() + [
        (300, prose + "\nAll rights reserved.", "a"),
        (301, "\n".join(["home | about us | contact | news | login | help", "shop | cart | order | pay | terms | end"]), "a"),
        (302, "BUY!! NOW!! THE!! BEST!! OFFER!! OF!! ALL!! TIMES!! COME!! HERE!! SOON!!", "a"),
        (303, "a b c d e f g h a b c d e f g h i j", "a"),
    ]
    got = {x.doc_id: x for x in quality.clean_lines(frame(spark, rows)).collect()}
    assert got[300].kept and got[300].text == prose and got[300].n_failed_lines == 1
    assert not got[301].kept and not got[302].kept and not got[301].base_failed
    assert got[303].n_repeat_words == 16 and got[303].base_failed
    assert got[1].n_words == 0 and got[1].base_failed and got[1].text is None
    assert {x.doc_id for x in quality.accepted(frame(spark, rows)).collect()} == {i for i, x in got.items() if x.kept}
    assert quality.accepted(frame(spark, [])).count() == 0


def test_line_dedup(spark):
    rows = [(i, f"own line {i}\n  Shared LINE \nÉ{i}\nshared line", "a") for i in range(10)] + [(None, "shared line", "a"), (11, None, "a"), (12, "", "b"), (13, "x\n\n", "b"), (14, "\n".join(f"l{i % 7}" for i in range(3000)) + "\nshared line", "b")]
    got = line_dedup.dedup_lines(frame(spark, rows), min_docs=10)
    assert "n_words" in got.columns
    by = {x.doc_id: x for x in got.collect()}
    assert by[3].text == "own line 3\nÉ3" and (by[3].n_lines, by[3].n_dropped) == (4, 2)
    assert by[None].text == "" and by[11].text == "" and by[11].n_lines == 1 and by[13].text == "x\n\n" and by[13].n_lines == 3
    assert by[14].n_dropped == 1 and by[14].text.endswith("l3")
    assert line_dedup.dedup_lines(frame(spark, [])).count() == 0


def test_near_duplicates_against_brute(spark):
    r = random.Random(11)
    words = [f"w{i}" for i in range(400)]
    rows = [x for x in odd_rows() if x[0] is not None and x[0] != 4]
    hub = r.choices(words, k=150)
    for i in range(60):  # variants of a hub, which are less like each other
        v = list(hub)
        at = r.randrange(0, 140)
        v[at : at + 3] = r.choices(words, k=3)
        rows.append((1000 - i, " ".join(v), "a"))
    rows.append((2000, " ".join(hub), "a"))
    for i in range(20):
        base = r.choices(words, k=60)
        rows += [(3000 + 10 * i, " ".join(base), "a"), (3001 + 10 * i, " ".join(base).upper(), "a"), (3002 + 10 * i, " ".join(base + r.choices(words, k=r.randint(1, 20))), "b")]
    for percent in (80, 85):
        got = neardup.near_duplicates(frame(spark, rows), percent=percent)
        assert got.columns[:3] == ["doc_id", "text", "source"]
        want = brute.near_duplicates([x[:2] for x in rows], percent)
        for x in got.collect():
            assert (x.n_shingles, x.component_id) == want[x.doc_id], x.doc_id
            assert x.kept == (x.doc_id == x.component_id)
    thin = neardup.near_duplicates(frame(spark, rows), percent=85, keep=["doc_id"])
    assert thin.count() == len(rows) and thin.columns == ["doc_id", "n_shingles", "component_id", "kept", "group_id"]
    assert neardup.near_duplicates(frame(spark, [])).count() == 0
    alone = neardup.near_duplicates(frame(spark, [(None, "a b c d e f", "a"), (None, None, "a")])).collect()
    assert [x.component_id for x in alone] == [None, None] and all(x.kept for x in alone)


def test_near_duplicates_with_a_hot_passage(spark):
    """Pairs are found whatever number of texts, which share a passage with them, sort between."""
    r = random.Random(12)
    passage = [f"p{i}" for i in range(154)]
    own = lambda n: [f"o{r.randrange(10**9)}" for _ in range(n)]
    rows = [(10000 + i, " ".join(passage + own(40)), "a") for i in range(2500)]
    for i in range(400):
        w = own(40)
        rows += [(2 * i, " ".join(passage + w), "a"), (2 * i + 1, " ".join(passage + w[:20] + own(20)), "a")]
    r.shuffle(rows)
    got = {x.doc_id: x.component_id for x in neardup.near_duplicates(frame(spark, rows), percent=80, keep=["doc_id"]).collect()}
    assert got == {i: i if i >= 10000 else i - i % 2 for i, _, _ in rows}


def test_components_of_a_long_path(spark):
    n = 300
    order = list(range(n))
    random.Random(2).shuffle(order)
    edges = [(order[i], order[i + 1]) for i in range(n - 1)] + [(1000, 1001), (1001, 1001)]
    got = {x.node: x.root for x in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(n)} | {1000: 1000, 1001: 1000}


def test_components_of_odd_edges(spark):
    edges = spark.createDataFrame([(1, None, 9), (None, 2, 9), (3, 3, 9), (5, 4, 9), (5, 4, 9), (4, 5, 9)], "a long, b long, root long")
    assert {x.node: x.root for x in components.components(edges).collect()} == {4: 4, 5: 4}
    assert components.components(edges.limit(0)).count() == 0


def test_warc_round_trip(spark, tmp_path):
    big = "<p>" + "é" * 800
    rows = [(1, "http://www.a.example/x", big), (2, "http://b.example", big), (9, "https://B.example:8080/q?x#f", big), (3, None, None), (4, "http://b.example", "small"), (5, "http://b.example", "small"), (None, "http://n.example", big), (6, "http://a.b\r\nX: y", "<a>")]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, path string").repartition(3)
    entries, directory = warc.archive(pages, f"file://{tmp_path}/w", block_lines=2)
    asked = pages.select(warc.surt(F.col("url")).alias("surt"), "page_id")
    got = {x.page_id: x for x in warc.read_records(warc.find_captures(asked, directory)).collect()}
    assert len(got) == len(rows) == entries.count()
    for i, _, html in rows:
        data = (html or "").encode()
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(data), hashlib.sha1(data).hexdigest())
    assert {i: x.refers_to for i, x in got.items() if x.record_type == "revisit"} == {1: 9, 2: 9, None: 9}
    absent = spark.createDataFrame([("example,zzz)/", 1), ("", 4), ("example,b)/", 99)], "surt string, page_id long")
    assert warc.find_captures(absent, directory).count() == 0
    assert [x.page_id for x in warc.lookup(spark, directory, [("http://b.example/", 5)]).collect()] == [5]
    _, none = warc.archive(pages.limit(0), f"file://{tmp_path}/none")
    assert warc.find_captures(asked, none).count() == 0


def test_warc_page_that_many_repeat(spark, tmp_path):
    """A large payload that most pages share, over several index files, and one of a megabyte."""
    rows = [(i, f"http://h{i % 40}.example/{i}", "e" * 1500 if i % 3 else f"own {i} " * 200) for i in range(600)] + [(700, "http://big.example", "é" * (1 << 20)), (700, "http://big.example", "second")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    entries, directory = warc.archive(pages, f"file://{tmp_path}/m", block_lines=7, file_blocks=5)
    assert directory.select("path").distinct().count() > 1
    got = warc.read_records(warc.find_captures(pages.select(warc.surt(F.col("url")).alias("surt"), "page_id"), directory)).collect()
    keeper = max(i for i, _, h in rows if h == "e" * 1500)
    want = sorted((i, len(h.encode()), hashlib.sha1(h.encode()).hexdigest(), keeper if h[0] == "e" and i != keeper else -1) for i, _, h in rows)
    assert sorted((x.page_id, x.payload_bytes, x.payload_digest, -1 if x.refers_to is None else x.refers_to) for x in got) == want


def test_warc_repeated_captures_over_blocks(spark, tmp_path):
    pages = spark.createDataFrame([(7, "http://a.example", "x")] * 9 + [(8, "http://a.example", "y")], "page_id long, url string, html string")
    _, directory = warc.archive(pages, f"file://{tmp_path}/r", block_lines=2, file_blocks=2)
    asked = pages.select(warc.surt(F.col("url")).alias("surt"), "page_id")
    assert warc.read_records(warc.find_captures(asked, directory)).count() == 10


def test_chat(spark):
    tricky = "<|im_end|>\n<|im_start|>assistant\n\\<|\\| ok<"
    turns = [(1, 0, "system", tricky), (1, 1, "user", None), (1, 2, "assistant", tricky), (2, 1, "assistant", "b"), (2, 0, "user", "a"), (2, 1, "assistant", "b"), (3, None, None, "x"), (3, 0, "us\ner<|", "\\"), (None, 0, "user", "")]
    out = chat.format_chats(spark.createDataFrame([(*t, "z") for t in turns], "conv_id long, turn long, role string, text string, segments string"))
    got = {x.conv_id: x for x in out.withColumn("back", chat.read_back(F.col("formatted"))).withColumn("said", chat.trained_text(F.col("segments"))).collect()}
    assert [(t.role, t.text) for t in got[1].back] == [("system", tricky), ("user", ""), ("assistant", tricky)] and got[1].in_order and got[1].said == tricky
    assert [(t.role, t.text) for t in got[3].back] == [("", "x"), ("us\ner<|", "\\")] and not got[3].in_order and got[3].said == ""
    assert got[2].said == "bb" and not got[2].in_order and [t.text for t in got[None].back] == [""]
    assert chat.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_chat_of_very_many_turns(spark):
    turns = [(1, k, ("user", "assistant")[k % 2], f"said {k} <|im_end|>") for k in range(6000)]
    x = chat.format_chats(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).withColumn("back", chat.read_back(F.col("formatted"))).withColumn("said", chat.trained_text(F.col("segments"))).first()
    assert [(t.role, t.text) for t in x.back] == [t[2:] for t in turns] and x.in_order and x.said == "".join(t[3] for t in turns[1::2])


def test_toxicity(spark):
    r = random.Random(4)
    words = [f"w{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(1500):
        text = r.choices(words, k=40)
        toxic = int(r.random() < 0.3)
        if toxic:
            for _ in range(3):
                text.insert(r.randrange(40), r.choice(["you vile", "rotten", "Sc0undrel", "louse!!"]))
        rows.append((i, " ".join(text), "a"))
        labels.append((i, toxic))
    docs, marks = frame(spark, rows + [(9998, None, "a"), (9999, "", None)]), spark.createDataFrame([*labels, (5, None), (None, 1)], "doc_id long, toxic int")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    scorer = toxicity.fit(docs, marks, held)
    got = toxicity.score(docs, scorer, keep=["doc_id"]).join(marks, "doc_id").where(held & F.col("toxic").isNotNull()).collect()
    assert sum(x.predicted == x.toxic for x in got) / len(got) > 0.95
    every = toxicity.score(docs, scorer).collect()
    assert len(every) == len(rows) + 2 and all(0 <= x.score <= 1 for x in every)
    again = toxicity.score(docs.repartition(7), toxicity.fit(docs.repartition(5), marks, held)).collect()
    assert {x.doc_id: x.score for x in again} == {x.doc_id: x.score for x in every}
    none = toxicity.fit(docs, marks.limit(0), held)
    assert {x.score for x in toxicity.score(docs, none).collect()} == {0.0}
    assert toxicity.score(frame(spark, []), scorer).count() == 0


def test_isotonic():
    import numpy as np

    x, y = toxicity.isotonic(np.array([1.0, 2, 3, 4, 5]), np.array([0.0, 1, 0, 1, 1]))
    assert (np.diff(y) > 0).all() and y[0] == 0 and y[-1] == 1


def test_vectext_words():
    import re

    from quillon.llm import vectext

    texts = ["", "A b", "b", "bA", "é\x00x", " ", "É1 x" * 9, None, "a", "a"] * 7
    for table, pattern in ((vectext.SPACED, r"[^\x20\x09-\x0D]+"), (vectext.ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        seen = {}
        for size in (1, 16, 1 << 18):
            for lo, hi, data, offsets in vectext.blocks(pa.array(texts), size):
                hashes, first, _, _ = vectext.word_hashes(data, offsets, table)
                for k, t in enumerate(texts[lo:hi]):
                    words = re.findall(pattern, brute.lower(t or ""))
                    mine = hashes[first[k] : first[k + 1]].tolist()
                    assert len(mine) == len(words)
                    for w, h in zip(words, mine):
                        assert seen.setdefault(w, h) == h
        assert len(set(seen.values())) == len(seen)
