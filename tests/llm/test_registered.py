"""The registered queries that have no SQL, over a small folder, against plain versions of the whole contract."""

import zlib

import brute
import pytest
from pyspark.sql import functions as F
from quillon.llm import common, queries, token_counts
from test_katz import plain_katz

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


def held(doc_id, mod):
    return zlib.crc32(str(doc_id).encode()) % mod == 0


def counter():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    t.no_truncation()
    t.no_padding()
    return lambda text: len(t.encode(text, add_special_tokens=False))


def test_op2(spark, docs):
    count = counter()
    got = queries.op2_token_counts(spark, SF)
    assert got.columns[:4] == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    want = sorted((i, len((t or "").encode()), count(t or ""), count(t or "") > 2048) for i, t in docs)
    assert sorted(tuple(r)[:4] for r in got.collect()) == want


def test_op2_with_a_half_filled_cache(spark, docs):
    """Counts that the cache holds are taken as they are, even wrong ones, and only misses are appended."""
    import public_tokenizers

    path, cache = public_tokenizers.path("word_bpe_49k.json"), common.fresh_path(spark, "half-cache")
    table = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    half = table.where("doc_id % 2 = 0")
    token_counts.count_tokens(half, path, cache, by_words=True, keep=["doc_id"])
    marked = spark.read.parquet(cache).withColumn("n_tokens", F.col("n_tokens") + 1_000_000)
    other = common.fresh_path(spark, "marked-cache")
    marked.write.partitionBy("version").parquet(other)
    got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(table, path, other, by_words=True, keep=["doc_id"]).collect()}
    count = counter()
    cached = {" ".join(brute.SPACED.findall(t or "")) for i, t in docs if i % 2 == 0}
    for i, t in docs:
        hit = " ".join(brute.SPACED.findall(t or "")) in cached
        assert got[i] == count(t or "") + 1_000_000 * hit, i
    assert spark.read.parquet(other).count() == len({" ".join(brute.SPACED.findall(t or "")) for _, t in docs})


def test_op5(spark, docs):
    got = queries.op5_toxicity(spark, SF)
    assert got.columns[:4] == ["doc_id", "held_out", "score", "predicted"] and got.schema["predicted"].dataType.typeName() == "integer"
    rows = got.collect()
    assert sorted(r.doc_id for r in rows) == sorted(i for i, _ in docs)
    assert all(r.held_out == held(r.doc_id, 5) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)


def test_op5_quality_on_rows_not_learned_from(spark):
    folder = "/root/testdata/sf0.1"
    rows = queries.op5_toxicity(spark, folder).where("held_out").join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").select("score", "toxic").collect()
    toxic, clean = [r.score for r in rows if r.toxic == 1], [r.score for r in rows if r.toxic == 0]
    above = sum((a > b) + 0.5 * (a == b) for a in toxic for b in clean) / (len(toxic) * len(clean))
    assert above > 0.98 and sum(s >= 0.5 for s in toxic) / len(toxic) > 0.88 and sum(s >= 0.5 for s in clean) / len(clean) < 0.02


def test_op6(spark, docs):
    got = queries.op6_near_duplicates(spark, SF)
    assert got.columns[:4] == ["doc_id", "n_shingles", "component_id", "kept"]
    want = brute.near_duplicates(docs, 85)
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got.collect()} == {i: (n, c, i == c) for i, (n, c) in want.items()}


def test_op9(spark, docs):
    got = queries.op9_katz(spark, SF)
    assert got.columns[:7] == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    want, _, uni, _ = plain_katz([(i, t, held(i, 10)) for i, t in docs], 2)
    for r in got.collect():
        n, known, base, score = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(r.doc_id, 10), n, known, sum(uni.values()))
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score == pytest.approx(score, rel=1e-9)
