"""Line dedup: drop lines that occur in many documents. DataFrame functions only.

A text is split at \\n. A line's key is the line without ASCII white space at its
ends and with A-Z in lower case. Keys found in at least ``min_docs`` documents
lose all their lines; the others stay in place and are joined again by \\n.

Two passes. The first counts documents per key hash with map-side sums, so a
line that every document has costs one row per task. The second joins line
positions (never line texts) with the frequent hashes and gathers each text's
dropped positions; a text meets its positions once, by its own row key.

Nulls and odd rows: a null or empty text is one empty line, whose key is empty
and shorter than ``min_chars``; it stays, as an empty text. Every row is a
document of its own, also if it repeats another. An empty table gives an empty
result. Extra columns pass through; the result's own columns (``text``,
``n_lines``, ``n_dropped``) replace those of the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, ascii_lower, body, stored


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _line_table(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A row per line: the document's row key, the line's position, its key's length and hashes."""
    keys = _lines(ascii_lower(body(text_col)))
    rows = docs.select(F.col(id_col).alias("__id"), F.xxhash64(body(text_col)).alias("__th"), F.posexplode(keys).alias("__pos", "__line"))
    key = F.btrim(F.col("__line"), F.lit(SPACE))
    return rows.select("__id", "__th", "__pos", F.length(key).alias("__n"), F.xxhash64(key).alias("__h"), F.hash(key).alias("__g"))


def frequent_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Hashes of the keys of at least min_chars code points that at least min_docs rows hold, with their number of documents.

    96 bits of hash stand for a key. A document counts once per key: its own
    repeats go before the shuffle, inside the row.
    """
    key = F.transform(_lines(ascii_lower(body(text_col))), lambda x: F.btrim(x, F.lit(SPACE)))
    one = F.array_distinct(key)
    rows = docs.select(F.explode(one).alias("__k")).where(F.length("__k") >= min_chars)
    rows = rows.select(F.xxhash64("__k").alias("__h"), F.hash("__k").alias("__g"))
    return rows.groupBy("__h", "__g").agg(F.count(F.lit(1)).alias("n_docs")).where(F.col("n_docs") >= min_docs)


def dedup_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the text that is left, n_lines (before dropping) and n_dropped. See the module's notes for nulls and ties."""
    # a table, so that its size is known and a line of very many documents can be split among tasks
    frequent = stored(frequent_lines(docs, min_docs, min_chars, id_col, text_col).drop("n_docs"), "frequent-lines")
    lines = _line_table(docs, id_col, text_col).where(F.col("__n") >= min_chars)
    # collect_set: repeated rows share a key and give the same positions
    dropped = lines.join(frequent, ["__h", "__g"]).groupBy("__id", "__th").agg(F.sort_array(F.collect_set("__pos")).alias("__drop"))
    dropped = dropped.withColumnsRenamed({"__id": "__id2", "__th": "__th2"})
    rows = docs.withColumns({"__id": F.col(id_col), "__th": F.xxhash64(body(text_col))})
    joined = rows.join(dropped, rows["__id"].eqNullSafe(dropped["__id2"]) & (rows["__th"] == dropped["__th2"]), "left")
    lines, drop = F.col("__lines"), F.col("__drop")
    # the stretches between dropped positions, in order
    stretch = F.transform(
        F.sequence(F.lit(0), F.size(drop)),
        lambda i: F.slice(
            lines,
            F.when(i == 0, 1).otherwise(F.get(drop, i - 1) + 2),
            F.when(i == F.size(drop), F.size(lines)).otherwise(F.get(drop, i)) - F.when(i == 0, 0).otherwise(F.get(drop, i - 1) + 1),
        ),
    )
    joined = joined.withColumn("__lines", _lines(body(text_col)))
    kept = F.when(drop.isNull(), body(text_col)).otherwise(F.array_join(F.flatten(stretch), "\n"))
    out = joined.withColumns({"__kept": kept, "n_lines": F.size(lines).cast("long"), "n_dropped": F.coalesce(F.size(drop), F.lit(0)).cast("long")})
    out = out.withColumn("n_dropped", F.when(drop.isNull(), F.lit(0).cast("long")).otherwise(F.col("n_dropped")))
    return out.withColumn(text_col, F.col("__kept")).drop("__id", "__th", "__id2", "__th2", "__drop", "__lines", "__kept")
