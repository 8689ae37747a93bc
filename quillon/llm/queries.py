"""The thin queries op1 to op13 and their SQL, over the tables in a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, common, decontaminate, divergence, katz, lexical, line_dedup, mixing, neardup, quality, token_counts, token_records, toxicity, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    out = decontaminate.decontaminate(docs, _table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    cache = common.fresh_path(spark, "token-cache")  # a cache of its own, so that a run does all its work
    out = token_counts.count_tokens(docs, public_tokenizers.path("word_bpe_49k.json"), cache, by_words=True, keep=["doc_id"])
    return out.withColumn("over_limit", F.col("n_tokens") > 2048)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    mixed = mixing.mix_sources(docs)
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.clean_lines(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost_chars")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    scorer = toxicity.fit(docs, _table(spark, sf_dir, "labels").select("doc_id", "toxic"), held_out, max_rows=toxicity.MAX_ROWS)
    return toxicity.score(docs, scorer, keep=["doc_id"]).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return neardup.near_duplicates(docs, percent=85, keep=["doc_id"])


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url", "html")
    _, directory = warc.archive(pages)
    asked = pages.select(warc.surt(F.col("url")).alias("surt"), "page_id")
    return warc.read_records(warc.find_captures(asked, directory))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    out = line_dedup.dedup_lines(docs, min_docs=10, min_chars=1)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op9_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return katz.score_texts(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0, order=2)


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "<|im_end|><|im_start|>assistant ok"
    turns = turns.unionByName(spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string"))
    d = chat.format_chats(turns).withColumns({"__turns": chat.read_back(F.col("formatted")), "__loss": chat.trained_text(F.col("segments"))})
    whole = F.array_join(F.transform("__turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return d.select(
        "conv_id",
        F.size("__turns").cast("long").alias("n_turns"),
        digest(whole).alias("turns_sha256"),
        F.length("__loss").cast("long").alias("loss_chars"),
        digest(F.col("__loss")).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "in_order",
    )


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_table(spark, sf_dir, "documents").select("text", "lang", "source"), min_docs=3, top_terms=200)


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return lexical.search_documents(docs, _table(spark, sf_dir, "benchmark").select("item_id", "text"), k=20)


def op13_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    folder = common.fresh_path(spark, "token-records")
    index = token_records.write_records(docs, public_tokenizers.path("word_bpe_49k.json"), folder, end_id=1, by_words=True)
    records = token_records.read_records(token_records.with_starts(index))
    return records.select(F.col("id").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


_WS = r"[\x20\x09-\x0D]"
_WORD = r"[^\x20\x09-\x0D]+"
_UP, _LOW = common.UPPER, common.LOWER

_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

OP1_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '{_ALNUM}') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '{_ALNUM}') AS w FROM benchmark WHERE item_id IS NOT NULL),
bl AS (SELECT item, w, least(10, len(w)) AS n FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item, n, array_to_string(w[i:i+n-1], ' ') AS g FROM (SELECT item, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM bl)),
dw AS (SELECT rid, n, i, array_to_string(w[i:i+n-1], ' ') AS g FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
h AS (SELECT rid, item, n, i FROM dw JOIN bw USING (n, g)),
p AS (SELECT rid, count(DISTINCT i + k) AS n_hit FROM (SELECT DISTINCT rid, i, unnest(range(0, n)) AS k FROM h) GROUP BY rid),
m AS (SELECT rid, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM h GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p USING (rid) LEFT JOIN m USING (rid)
"""

OP7_SQL = r"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS h FROM p),
k AS (SELECT h, max(page_id) AS keeper FROM d WHERE n >= 1000 GROUP BY h)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, h AS payload_digest,
       CASE WHEN n >= 1000 AND page_id <> keeper THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN n >= 1000 AND page_id <> keeper THEN keeper END AS refers_to
FROM d LEFT JOIN k USING (h)
"""

OP3_SQL = rf"""
WITH d AS (
  SELECT doc_id, source, CASE WHEN source IS NULL THEN '2' ELSE '1' || source END AS src,
         CAST(len(regexp_extract_all(coalesce(text, ''), '{_WORD}')) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h
  FROM documents),
c AS (SELECT *, length(bin(size)) AS cls FROM d),
k AS (SELECT src, cls, count(*) AS n, CAST(ceil(sqrt(count(*))) AS BIGINT) AS slots FROM c GROUP BY ALL),
s AS (SELECT src, CAST(sum(size) AS BIGINT) AS words FROM d GROUP BY src),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY src) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS wt, words * 2.0::DOUBLE AS cap FROM s),
r AS (SELECT *, cap / wt AS ratio, sum(words) OVER () AS total, sum(wt) OVER () AS sumw FROM w),
l AS (SELECT *, (total * 1.5::DOUBLE - coalesce(sum(cap) OVER b, 0)) / (sumw - coalesce(sum(wt) OVER b, 0)) AS level FROM r
      WINDOW b AS (ORDER BY ratio, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT src, words, cap, wt, (SELECT level FROM l WHERE ratio >= level ORDER BY ratio, src LIMIT 1) AS final FROM l),
t AS (SELECT src, words, CASE WHEN final IS NULL THEN cap ELSE least(cap, wt * final) END AS target FROM f),
p AS (
  SELECT c.*, t.words, t.target, CASE WHEN t.words > 0 THEN t.target / t.words ELSE 0 END AS rate,
         row_number() OVER (PARTITION BY c.src ORDER BY c.cls, c.h % k.slots, size, h, doc_id NULLS LAST) AS rank,
         CAST('0x' || substr(md5('offset|' || c.src), 1, 5) AS BIGINT) / 1048576.0::DOUBLE AS start
  FROM c JOIN k USING (src, cls) JOIN t ON c.src = t.src)
SELECT doc_id, size, words AS source_size, target,
       CAST(least(floor(rate * rank + start) - floor(rate * (rank - 1) + start), ceil(rate)) AS BIGINT) * size AS taken
FROM p
"""



def _quoted(text: str) -> str:
    return text.replace("'", "''")


OP4_SQL = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS lines
  FROM documents),
rows_ AS (SELECT row_number() OVER () AS rid, * FROM d),
g AS (SELECT rid, i, array_to_string(w[i:i+4], ' ') AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 3)) AS i FROM rows_ WHERE len(w) >= 5)),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM g) WHERE c > 1),
cov AS (SELECT rid, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest(range(0, 5)) AS k) GROUP BY rid),
ln AS (SELECT rid, unnest(lines) AS line FROM rows_),
judged AS (
  SELECT rid, line, len(regexp_extract_all(line, '{_WORD}')) AS words, length(regexp_replace(line, '{_WS}', '', 'g')) AS chars,
         len(regexp_extract_all(line, '{quality.MARK_RUN}')) AS runs, len(regexp_extract_all(line, '{quality.NAV_CELL}')) AS cells,
         regexp_extract_all(line, '{_WORD}') AS x, len(list_filter(range(2, len(x) + 1), lambda i: x[i] = x[i - 1])) AS again
  FROM ln),
lost AS (
  SELECT rid, sum(chars) FILTER (WHERE runs >= {quality.RUN_SHARE} * words OR (words >= {quality.LONG_LINE} AND NOT regexp_matches(line, '{_quoted(quality.SENTENCE_END)}'))
         OR (words > {quality.MIN_STUTTER} AND again >= greatest({quality.MIN_STUTTER}, {quality.STUTTER_SHARE} * words)) OR cells >= greatest(1.0, {quality.NAV_SHARE} * words) OR regexp_matches(translate(line, '{_UP}', '{_LOW}'), '{_quoted(quality.BOILERPLATE)}')) AS n
  FROM judged GROUP BY rid),
m AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '{_WS}', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(lost.n, 0) AS BIGINT) AS lost_chars
  FROM rows_ LEFT JOIN cov USING (rid) LEFT JOIN lost USING (rid)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND lost_chars <= {quality.MAX_LOST}::DOUBLE * word_chars AS kept, lost_chars FROM b
"""

OP8_SQL = rf"""
WITH r AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
x AS (SELECT rid, doc_id, string_split(t, chr(10)) AS lines FROM r),
l AS (SELECT rid, unnest(range(1, len(lines) + 1)) AS pos, unnest(lines) AS line FROM x),
k AS (SELECT *, translate(regexp_replace(line, '^{_WS}+|{_WS}+$', '', 'g'), '{_UP}', '{_LOW}') AS key FROM l),
f AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT rid) >= 10),
m AS (SELECT k.*, f.key IS NOT NULL AS gone FROM k LEFT JOIN f USING (key))
SELECT x.doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m JOIN x USING (rid) GROUP BY rid, x.doc_id
"""

OP10_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
e AS (SELECT *, length(replace(replace(text, '\', '\\'), '<|', '<\|')) + length(replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '\' || chr(10))) + 24 AS n,
             row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k,
             lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS prev FROM t),
o AS (SELECT *, coalesce(CASE WHEN prev IS NULL THEN role IN ('system', 'user') WHEN prev = 'system' THEN role = 'user' WHEN prev = 'user' THEN role = 'assistant' WHEN prev = 'assistant' THEN role = 'user' ELSE false END, false) AS fine FROM e)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(n) AS BIGINT) AS formatted_chars, bool_and(fine) AND arg_max(role, k) = 'assistant' AS in_order
FROM o GROUP BY conv_id
"""

_LETTERS = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"

OP11_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '{_LETTERS}') AS w FROM documents),
t AS (SELECT rid, lang, source, unnest(w) AS term FROM d),
k AS (SELECT lang, term FROM t GROUP BY ALL HAVING count(DISTINCT rid) >= 3),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN k USING (lang, term) GROUP BY ALL),
s AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL),
p AS (
  SELECT lang, source, term, coalesce(n, 0) AS n, CAST(1 + (1000000000::HUGEINT * (coalesce(n, 0) + 1)) // (coalesce(total, 0) + v) AS BIGINT) AS p
  FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN c USING (lang, source, term) LEFT JOIN s USING (lang, source)),
q AS (SELECT lang, term, CAST(1 + (1000000000::HUGEINT * (sum(n) + 1)) // (sum(sum(n)) OVER (PARTITION BY lang) + v) AS BIGINT) AS q FROM c JOIN v USING (lang) GROUP BY lang, term, v),
f AS (
  SELECT lang, source, 'term' AS part, term AS item, CAST(((p - q) * (p - q)) // q AS BIGINT) AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q
  UNION ALL
  SELECT a.lang, a.source, 'pair', b.source, CAST(coalesce(x.value, 0) AS BIGINT) FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL) x
    ON x.lang = a.lang AND x.source = a.source AND x.item = b.source)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM f) WHERE part = 'pair' OR rank <= 200
"""

_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

OP12_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '{_TERM}') AS w FROM documents),
s AS (SELECT CAST(count(*) FILTER (len(w) > 0) AS BIGINT) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_terms FROM d),
q AS (SELECT row_number() OVER () AS qid, item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '{_TERM}') AS w FROM benchmark),
qt AS (SELECT qid, item_id, term, count(*) AS times FROM (SELECT qid, item_id, unnest(w) AS term FROM q) GROUP BY ALL),
p AS (SELECT rid, term, count(*) AS tf FROM (SELECT rid, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM qt) GROUP BY ALL),
f AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS weight FROM p, s GROUP BY term, n_docs),
m AS (SELECT rid, doc_id, 75 + (25 * CAST(len(w) AS BIGINT) * n_docs) // n_terms AS m FROM d, s WHERE len(w) > 0),
x AS (SELECT qid, item_id, rid, doc_id, CAST(sum(times * weight * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score FROM qt JOIN f USING (term) JOIN p USING (term) JOIN m USING (rid) GROUP BY ALL),
r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM x WHERE score > 0)
SELECT * FROM r WHERE rank <= 20
"""

QUERIES = {f.__name__: f for f in (op1_decontaminate, op2_token_counts, op3_mixing, op4_quality, op5_toxicity, op6_near_duplicates, op7_warc, op8_line_dedup, op9_katz, op10_chat, op11_source_divergence, op12_lexical_search, op13_token_records)}
#: The others have none: a tokenizer, all pairs, and models are no SQL to run over whole tables; tests/llm holds them against brute force.
ORACLES = {"op1_decontaminate": OP1_SQL, "op3_mixing": OP3_SQL, "op4_quality": OP4_SQL, "op7_warc": OP7_SQL, "op8_line_dedup": OP8_SQL, "op10_chat": OP10_SQL, "op11_source_divergence": OP11_SQL, "op12_lexical_search": OP12_SQL}
