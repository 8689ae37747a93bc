"""Learning operators on columns: scaling, TF-IDF, logistic regression, pooling and message passing."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, CountVectorizer, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import vocabulary


def scale(train: DataFrame, others: list[DataFrame], columns: list[str]) -> list[DataFrame]:
    """Columns less their mean over their population deviation (1 where that is 0), both of the training rows."""
    stats = train.agg(*(F.struct(F.avg(c).alias("m"), F.stddev_pop(c).alias("s")).alias(c) for c in columns)).first()
    moved = [((F.col(c) - (stats[c].m or 0.0)) / (stats[c].s or 1.0)).alias(c) for c in columns]
    return [df.select(*(c for c in df.columns if c not in columns), *moved) for df in (train, *others)]


def logistic(train: DataFrame, columns: list[str], label: str = "label", max_iter: int = 1000, c: float = 1.0) -> PipelineModel:
    """L2-regularised logistic regression with classes weighted to balance."""
    counts = {r[label]: r["count"] for r in train.groupBy(label).count().collect()}
    n = sum(counts.values())
    weight = F.when(F.col(label) == 1, n / (2.0 * max(1, counts.get(1, 0)))).otherwise(n / (2.0 * max(1, counts.get(0, 0))))
    stages = [VectorAssembler(inputCols=columns, outputCol="features"), LogisticRegression(labelCol=label, weightCol="weight", maxIter=max_iter, regParam=1.0 / (c * max(1, n)), elasticNetParam=0.0, standardization=False)]
    return Pipeline(stages=stages).fit(train.withColumn("weight", weight))


def _bound(value: Column, use) -> Column:
    """use(value), an array, with value worked out once a row: inside a function of array elements an expression would be worked out for each."""
    return F.flatten(F.transform(F.array(value), use))


def _windows(n_items: Column, low: int, high: int, item) -> Column:
    """item(place, size) for every window of low to high items."""

    def of_size(n: int) -> Column:
        places = F.sequence(F.lit(1), n_items - n + 1)
        return F.when(n_items >= n, F.transform(places, lambda i: item(i, F.lit(n)))).otherwise(F.array().cast("array<string>"))

    return F.flatten(F.array(*map(of_size, range(low, high + 1))))


def char_grams(text: Column, low: int, high: int, inside_words: bool = False) -> Column:
    """All substrings of low to high characters; inside_words takes them of each word with a space on both sides."""
    sub = lambda t: _windows(F.length(t), low, high, lambda i, n: F.substr(t, i, n))
    text = F.lower(text)
    if not inside_words:
        return _bound(F.regexp_replace(text, r"\s+", " "), sub)
    return F.flatten(F.transform(F.filter(F.split(text, r"\s+"), lambda w: w != ""), lambda w: _bound(F.concat(F.lit(" "), w, F.lit(" ")), sub)))


def word_grams(text: Column, low: int = 1, high: int = 3) -> Column:
    """Runs of low to high words of two and more letters."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))
    return _bound(words, lambda w: _windows(F.size(w), low, high, lambda i, n: F.array_join(F.slice(w, i, n), " ")))


def tfidf_rows(docs: DataFrame, key: str, terms: Column, size: int = 50_000) -> DataFrame:
    """A row per document and term of the vocabulary (the most frequent terms of the corpus): weights tf (ln((1 + n) / (1 + df)) + 1), of length 1 per document. A row of docs is a document."""
    bag = vocabulary.bags(docs, key, terms)
    return vocabulary.weights(bag, key, vocabulary.most_frequent(bag, size), bag.count())


def matrix_stats(rows: DataFrame, key: str) -> DataFrame:
    """Of a sparse matrix, a row per entry: entries stored, rows and columns in use, density and entries per row."""
    n = rows.agg(F.count(F.lit(1)).alias("stored"), F.count_distinct(key).alias("rows_used"), F.count_distinct("term").alias("columns_used"))
    return n.withColumns({"density": F.col("stored") / (F.col("rows_used") * F.col("columns_used")), "per_row": F.col("stored") / F.col("rows_used")})


def tfidf_logistic(train: DataFrame, text: str, label: str = "label", analyzer: str = "word", size: int = 50_000, max_iter: int = 1000) -> tuple[PipelineModel, Column]:
    """A model on TF-IDF vectors, and the expression of the terms it reads (as column terms)."""
    terms = {"word": lambda t: word_grams(t, 1, 3), "char": lambda t: char_grams(t, 3, 5), "char_wb": lambda t: char_grams(t, 3, 5, True)}[analyzer](F.coalesce(F.col(text), F.lit("")))
    counts = {r[label]: r["count"] for r in train.groupBy(label).count().collect()}
    n = sum(counts.values())
    weight = F.when(F.col(label) == 1, n / (2.0 * max(1, counts.get(1, 0)))).otherwise(n / (2.0 * max(1, counts.get(0, 0))))
    stages = [CountVectorizer(inputCol="terms", outputCol="tf", vocabSize=size), IDF(inputCol="tf", outputCol="features"), LogisticRegression(labelCol=label, weightCol="weight", maxIter=max_iter, regParam=1.0 / max(1, n))]
    return Pipeline(stages=stages).fit(train.withColumn("terms", terms).withColumn("weight", weight)), terms


def pool(df: DataFrame, key: str, vector: str) -> DataFrame:
    """Mean, maximum and sum per key and dimension."""
    rows = df.select(F.col(key), F.posexplode(vector).alias("__p", "__v"))
    return rows.groupBy(key, (F.col("__p") + 1).cast("long").alias("dim")).agg(F.avg(F.col("__v").cast("double")).alias("mean"), F.max(F.col("__v").cast("double")).alias("max"), F.sum(F.col("__v").cast("double")).alias("total"))


BLOCK = 16  # dimensions that are summed in one row


def message_mean(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Mean of the source nodes' vectors per destination and dimension, of those that have a value there. Repeated edges count as often as they stand; they are summed up before the vectors join.

    A vector is summed in blocks of dimensions, a row each: a row per dimension would make groups, and a task's table of them, many times larger.
    """
    often = edges.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("__n"))
    joined = often.join(nodes.select(F.col("node").alias("src"), "x").where(F.size("x") > 0), "src")
    rows = joined.select("dst", "__n", "x", F.explode(F.sequence(F.lit(0), F.size("x") - 1, F.lit(BLOCK))).alias("__lo"))
    rows = rows.select("dst", "__n", "__lo", F.size("x").alias("__size"), *(F.get("x", F.col("__lo") + j).cast("double").alias(f"__{j}") for j in range(BLOCK)))
    sums = [x for j in range(BLOCK) for x in (F.sum(F.col(f"__{j}") * F.col("__n")).alias(f"__v{j}"), F.sum(F.when(F.col(f"__{j}").isNotNull(), F.col("__n"))).alias(f"__n{j}"))]
    blocks = rows.groupBy("dst", "__lo").agg(F.max("__size").alias("__size"), *sums)
    means = F.array(*(F.struct((F.col("__lo") + j + 1).cast("long").alias("dim"), (F.col(f"__v{j}") / F.col(f"__n{j}")).alias("mean")) for j in range(BLOCK)))
    return blocks.select("dst", F.inline(F.slice(means, F.lit(1), F.least(F.lit(BLOCK), F.col("__size") - F.col("__lo")))))
