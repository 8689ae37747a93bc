"""Token records: checksums, frames, files in order, damaged files, shuffled reads, odd rows."""

import struct
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from quillon.llm import queries, terms
from quillon.llm import token_records as tr
from quillon.llm.common import fresh_path

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("word_bpe_49k.json")


def plain_crc32c(data):
    crc = 0xFFFFFFFF
    for byte in data:
        crc ^= byte
        for _ in range(8):
            crc = (crc >> 1) ^ (0x82F63B78 if crc & 1 else 0)
    return crc ^ 0xFFFFFFFF


def tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return lambda text: [*t.encode(text or "", add_special_tokens=False).ids, 1]


def test_checksums():
    assert plain_crc32c(b"123456789") == 0xE3069283
    rng = np.random.default_rng(1)
    data = rng.integers(0, 256, 9000).astype(np.uint8)
    starts, lengths = np.array([0, 3, 500, 501, 9, 100]), np.array([4, 63, 64, 65, 129, 8800])
    assert tr.crc32c(data, starts, lengths).tolist() == [plain_crc32c(data[a : a + n].tobytes()) for a, n in zip(starts, lengths)]


def test_frames_by_hand_and_back():
    ids = np.array([5, 6, 7, 40000, 1], "<u2")
    data, at = tr.frames(["12", None, "é"], ids, np.array([0, 3, 3, 5]))
    body = struct.pack("<HHI", 2, 1, 2) + b"12\0\0" + struct.pack("<3H", 5, 6, 7)
    mask = lambda c: ((c >> 15 | c << 17) + 0xA282EAD8) & 0xFFFFFFFF
    size = struct.pack("<Q", len(body))
    assert data[: at[1]].tobytes() == size + struct.pack("<I", mask(plain_crc32c(size))) + body + struct.pack("<I", mask(plain_crc32c(body)))
    assert [(k, x.tolist()) for k, x in tr.parse(data, at)] == [("12", [5, 6, 7]), (None, []), ("é", [40000, 1])]
    for i in range(len(data)):  # every damaged byte is noticed
        hurt = data.copy()
        hurt[i] ^= 0x10
        with pytest.raises(tr.Corrupt):
            tr.parse(hurt, at)


def test_words_as_codes():
    texts = terms.plain(pa.array([" A b", None, "", "b\tA  b ", "\n"]))
    code, first, known = terms.coded(texts)
    words = [known[i].as_py() for i in code]
    assert [words[a:b] for a, b in zip(first, first[1:])] == [["A", "b"], [], [], ["b", "A", "b"], []]
    assert terms.folded(texts, terms.folding(terms.LETTERS)).to_pylist() == [" a b", "", "", "b a  b ", " "]


def test_op13(spark):
    encode, start, want = tokenizer(), 0, {}
    for r in sorted(spark.read.parquet(f"{SF}/documents.parquet").collect(), key=lambda r: r.doc_id):
        ids = encode(r.text)
        want[r.doc_id] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    got = queries.op13_token_records(spark, SF)
    assert got.columns[:4] == ["doc_id", "start", "n_tokens", "ids_crc32"] and [t for _, t in got.dtypes[:4]] == ["bigint"] * 4
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in got.collect()} == want


@pytest.mark.parametrize("by_words", [True, False])
def test_odd_rows(spark, by_words):
    """Nulls, repeated ids and rows, a long text, special strings, ids of text, clashing extra columns; many small files; any order of reading gives the same records."""
    rows = [("b", "two words", 1), ("a", None, 2), (None, "no id", 3), ("b", "two words", 4), ("a", "", 5), ("c", "x<|endoftext|>y  é é ", 6), ("d", "long words. " * 20000, 7), ("", " ", 8)]
    docs = spark.createDataFrame(rows, "key string, body string, start int").repartition(3)
    index = tr.write_records(docs, PATH, fresh_path(spark, "odd-records"), 1, by_words=by_words, file_bytes=60, memo_words=4, id_col="key", text_col="body")
    full = tr.with_starts(index)
    got = tr.read_records(full, arrays=True, task_bytes=300).collect()
    encode = tokenizer()
    assert sorted((r.id is None, r.id or "", r.ids) for r in got) == sorted((k is None, k or "", encode(t)) for k, t, _ in rows)
    ordered = sorted(got, key=lambda r: r.start)
    assert [r.id for r in ordered] == ["", "a", "a", "b", "b", "c", "d", None]
    assert [r.start for r in ordered] == np.cumsum([0, *(r.n_tokens for r in ordered)])[:-1].tolist() and all(len(r.ids) == r.n_tokens for r in got)
    assert len({r.file for r in got}) > 3
    one, two = ([(r.id, r.ids) for r in tr.shuffled(full, seed, arrays=True).collect()] for seed in (1, 2))
    key = lambda r: (r[0] is None, r[0] or "", r[1])
    assert one != two and sorted(one, key=key) == sorted(two, key=key) == sorted(((r.id, r.ids) for r in got), key=key)


def test_damaged_file_ends_the_job(spark):
    docs = spark.createDataFrame([(i, f"some words {i}") for i in range(20)], "doc_id long, text string").coalesce(1)
    index = tr.write_records(docs, PATH, fresh_path(spark, "hurt-records"), 1)
    path = index.first().file.removeprefix("file:")
    data = bytearray(open(path, "rb").read())
    data[len(data) // 2] ^= 1
    open(path, "wb").write(data)
    with pytest.raises(Exception, match="checksum"):
        tr.read_records(index).collect()


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    index = tr.write_records(docs, PATH, fresh_path(spark, "no-records"), 1)
    assert tr.read_records(tr.with_starts(index)).count() == 0 and dict(index.dtypes)["id"] == "bigint"


def test_sentencepiece_and_wide_ids(spark):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    docs = spark.createDataFrame([(1, "some words"), (2, None)], "doc_id long, text string")
    index = tr.write_records(docs, path, fresh_path(spark, "wide-records"), 70000)
    got = {r.id: r.ids for r in tr.read_records(index, arrays=True).collect()}
    assert got == {1: [*sentencepiece.SentencePieceProcessor(model_file=path).encode("some words"), 70000], 2: [70000]}
    assert index.agg(F.sum("length")).first()[0] == sum(4 * len(x) + 8 + 4 + 16 for x in got.values())


def test_words_encoded_together_are_told_apart():
    """Letters that normalising joins, folds or lengthens, special strings, odd spaces inside a word, and single bytes of no letter."""
    words = ["and,", "İx", "e\u0301a", "it's", "<|endoftext|>", "a<|startoftext|>b", "a\u00a0b", "ﬁ", "\u2003", "ÀÉ", "日本", "...!", "x" * 300, "\u0301", "Ω≈ç", "don't'll"]
    t = tr.Encoder(".json", open(PATH, "rb").read(), True, 1000)
    encode = tokenizer()
    for group in (words, words[:6], ["plain", "words,"], words[::-1]):
        t.new, t.old = {}, {}
        assert [np.frombuffer(b, "<u2").tolist() for b in t._packed(group, np.dtype("<u2"))] == [encode(w)[:-1] for w in group]
    whole = t.ids_of
    calls = []
    t.ids_of = lambda texts: calls.append(len(texts)) or whole(texts)
    t._packed(["plain", "words,", "été", "new"], np.dtype("<u2"))
    assert calls == [1] and len(t.new["new"]) == 2
