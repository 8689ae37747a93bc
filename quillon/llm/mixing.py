"""Mixing sources to target weights by systematic sampling. DataFrame functions only.

Every source gets a target number of words: its weight's share of the mix, at
most ``cap`` times its own size, the excess shared again by weight until no
target is above. A document's expected copies are its source's target over its
source's size. Within a source, the prefix sum of expected copies runs over the
documents by size, and a document is emitted once for each integer boundary that
the sum, moved by one offset of the source, crosses at it.

The prefix sum is split in three levels so that no task needs a whole source:
size classes of a source, about sqrt(n) hash slots of a class, about sqrt(n)
documents of a slot. Order and offset come from hashes, so reruns agree.

Nulls and odd rows: a null text has size 0; null sources are one source, the
last; null ids sort last. Repeated rows are documents of their own. Sources
without words have target 0 and give no copies. An empty table gives an empty
result. Extra columns pass through; result columns replace those of their name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACED_WORD, body, hash32, stored


def _offset(source_key: Column) -> Column:
    """In [0, 1), in steps of 2^-20."""
    return F.conv(F.substring(F.md5(F.concat(F.lit("offset|"), source_key)), 1, 5), 16, 10).cast("double") / F.lit(1048576.0)


def source_targets(sizes: DataFrame, weights: tuple[float, ...], share: float, cap: float) -> DataFrame:
    """sizes: __src, __words, a row per source. Adds __target. One row per source meets in one task; the caps are solved in closed form.

    Sources by cap over weight: the first whose level, once all before it are at
    their caps, is at or under its own ratio fixes the level for all after it.
    """
    n = len(weights)
    rank = F.row_number().over(Window.orderBy("__src")) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % n + 1).cast("int"))
    s = sizes.withColumn("__w", weight).withColumn("__cap", F.col("__words") * F.lit(float(cap)))
    everything = Window.partitionBy(F.lit(1))
    before = Window.orderBy("__ratio", "__src").rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumns({"__ratio": F.col("__cap") / F.col("__w"), "__total": F.sum("__words").over(everything), "__sumw": F.sum("__w").over(everything)})
    level = (F.col("__total") * F.lit(float(share)) - F.coalesce(F.sum("__cap").over(before), F.lit(0.0))) / (F.col("__sumw") - F.coalesce(F.sum("__w").over(before), F.lit(0.0)))
    s = s.withColumn("__level", level).withColumn("__final", F.min(F.when(F.col("__ratio") >= F.col("__level"), F.struct("__ratio", "__src", "__level"))).over(everything)["__level"])
    return s.select("__src", "__words", F.when(F.col("__final").isNull(), F.col("__cap")).otherwise(F.least(F.col("__cap"), F.col("__w") * F.col("__final"))).alias("__target"))


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """docs with size, source_size, target and copies (how often the mix takes the row). weights go to the sources in code point order, repeating."""
    src = F.when(F.col(source_col).isNull(), F.lit("2")).otherwise(F.concat(F.lit("1"), F.col(source_col).cast("string")))
    size = F.regexp_count(body(text_col), F.lit(SPACED_WORD)).cast("long")
    rows = docs.withColumns({"__src": src, "size": size, "__h": hash32(F.col(id_col)), "__t": F.xxhash64(body(text_col))}).withColumn("__cls", F.length(F.bin("size")))
    keys = docs.select(src.alias("__src"), size.alias("__size"), hash32(F.col(id_col)).alias("__h")).withColumn("__cls", F.length(F.bin("__size")))
    slots = F.ceil(F.sqrt("__n")).cast("long")

    classes = keys.groupBy("__src", "__cls").agg(F.count(F.lit(1)).alias("__n"), F.sum("__size").alias("__words"))
    targets = source_targets(classes.groupBy("__src").agg(F.sum("__words").alias("__words")), weights, share, cap)
    earlier = Window.partitionBy("__src").orderBy("__cls").rowsBetween(Window.unboundedPreceding, -1)
    classes = classes.withColumns({"__slots": slots, "__before_class": F.coalesce(F.sum("__n").over(earlier), F.lit(0))}).drop("__words", "__n")
    # a table of some rows per source: its size is known, and a large source can be split among tasks
    classes = stored(classes.join(targets, "__src"), "mix-classes")

    buckets = keys.join(classes.select("__src", "__cls", "__slots"), ["__src", "__cls"]).groupBy("__src", "__cls", (F.col("__h") % F.col("__slots")).alias("__slot")).agg(F.count(F.lit(1)).alias("__n"))
    earlier = Window.partitionBy("__src", "__cls").orderBy("__slot").rowsBetween(Window.unboundedPreceding, -1)
    # one key for a bucket, so that rows are dealt by the whole of it and only once
    bucket = F.concat_ws("|", "__cls", "__slot", "__src").alias("__bucket")
    buckets = buckets.select(bucket, F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before_slot"))

    rows = rows.join(classes, ["__src", "__cls"]).withColumn("__slot", F.col("__h") % F.col("__slots")).withColumn("__bucket", bucket)
    rows = rows.join(buckets, "__bucket")
    inside = Window.partitionBy("__bucket").orderBy("size", "__h", F.col(id_col).asc_nulls_last(), "__t")
    rank = F.col("__before_class") + F.col("__before_slot") + F.row_number().over(inside)
    rate = F.when(F.col("__words") > 0, F.col("__target") / F.col("__words")).otherwise(0.0)
    rows = rows.withColumns({"__rank": rank, "__rate": rate})
    start = _offset(F.col("__src"))
    copies = F.floor(F.col("__rate") * F.col("__rank") + start) - F.floor(F.col("__rate") * (F.col("__rank") - 1) + start)
    rows = rows.withColumns({"source_size": F.col("__words"), "target": F.col("__target"), "copies": F.least(copies, F.ceil("__rate")).cast("long")})
    return rows.drop("__src", "__cls", "__h", "__t", "__slots", "__slot", "__bucket", "__before_class", "__before_slot", "__words", "__target", "__rank", "__rate")


def expand(mixed: DataFrame) -> DataFrame:
    """The mix itself: each row as often as its copies say."""
    return mixed.where(F.col("copies") > 0).withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).drop("__copy")
