"""Retrieval over documents with relational operators: chunks, BM25, selection under a budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: BM25's k1 and b, size and overlap of chunks in characters.
K1, B, CHUNK, OVERLAP = 1.5, 0.75, 900, 120


def tokens(c: Column) -> Column:
    """Lower-cased runs of letters, digits and underscores; for CJK runs their character bigrams."""
    words = F.regexp_extract_all(F.lower(c), F.lit(r"([a-z0-9_]+)"), 1)
    runs = F.regexp_extract_all(c, F.lit(r"([一-鿿]+)"), 1)
    pairs = F.flatten(F.transform(runs, lambda r: F.when(F.length(r) < 2, F.array(r)).otherwise(F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substr(r, i, F.lit(2))))))
    return F.concat(words, pairs)


def bigrams(c: Column) -> Column:
    """The distinct character bigrams of a text."""
    return F.when(F.length(c) < 2, F.array().cast("array<string>")).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - 1), lambda i: F.substr(c, i, F.lit(2)))))


def bigram_jaccard(a: Column, b: Column) -> Column:
    x, y = bigrams(a), bigrams(b)
    return F.round(F.coalesce(F.try_divide(F.size(F.array_intersect(x, y)), F.size(F.array_union(x, y))), F.lit(0.0)), 6)


def chunks(docs: DataFrame, key: str, text: str, size: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """key, chunk (from 0) and its text; consecutive chunks share ``overlap`` characters."""
    step = size - overlap
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(text) - overlap), F.lit(step))
    return docs.where(F.length(text) > 0).select(key, F.posexplode(starts).alias("chunk", "_at"), F.col(text)).select(key, "chunk", F.expr(f"substring(`{text}`, _at, {size})").alias("text"))


def bm25(docs: DataFrame, key: str, text: str, query: list[str], k: int = 10) -> DataFrame:
    """key and score of the k best documents, ties to the smaller key.

    Only query terms leave the scan: term counts are partial sums, and the statistics are one row."""
    base = docs.select(key, tokens(F.col(text)).alias("_t")).withColumn("_len", F.size("_t"))
    stats = base.agg(F.count(F.lit(1)).alias("_n"), F.avg("_len").alias("_avg"))
    tf = base.select(key, "_len", F.explode(F.filter("_t", lambda t: t.isin(*query))).alias("term")).groupBy(key, "_len", "term").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(1 + (F.col("_n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("_len") / F.col("_avg")))
    scored = tf.join(F.broadcast(df), "term").join(F.broadcast(stats)).groupBy(key).agg(F.round(F.sum(idf * weight), 6).alias("score"))
    return scored.orderBy(F.desc("score"), key).limit(k)


def within_budget(df: DataFrame, scope: str, order: list[Column], size: str, budget: int) -> DataFrame:
    """Of each scope the first rows, in order, whose sizes add up to no more than the budget."""
    w = Window.partitionBy(scope).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("_sum", F.sum(size).over(w)).where(F.col("_sum") <= budget).drop("_sum")


def quota(df: DataFrame, scope: str, order: list[Column], k: int) -> DataFrame:
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(scope).orderBy(*order))).where(F.col("_rn") <= k).drop("_rn")
