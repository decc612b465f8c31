"""Profiles of columns: counts, ranges, frequent values, catalogues of names and values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Characters of a value that is counted as it stands.
LONG = 100


def _long(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column_name, value as text, number) rows of several columns, from one scan."""
    numeric = lambda c: F.col(c).cast("double") if isinstance(df.schema[c].dataType, T.NumericType) else F.lit(None).cast("double")
    return df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value"), numeric(c).alias("number")) for c in columns))).alias("x")).select("x.*")


def columns_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column_name, n_rows, n_nulls, null_rate, n_distinct, distinct_rate, number range and mean, text length range and mean, class."""
    own = _long(df, columns).withColumn("size", F.length("value"))
    own = own.withColumn("value", F.when(F.col("size") > LONG, F.sha2("value", 256)).otherwise(F.col("value")))  # long texts are told apart by their hash, and are not sent
    values = own.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"), F.first("number").alias("number"), F.first("size").alias("size"))
    size = F.col("size")
    out = values.groupBy("column_name").agg(
        F.sum("n").alias("n_rows"), F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("n_nulls"), F.count("value").alias("n_distinct"),
        F.min("number").alias("min_number"), F.max("number").alias("max_number"), (F.sum(F.col("number") * F.col("n")) / F.sum(F.when(F.col("number").isNotNull(), F.col("n")))).alias("mean_number"),
        F.min(size).alias("min_length"), F.max(size).alias("max_length"), (F.sum(size * F.col("n")) / F.sum(F.when(F.col("value").isNotNull(), F.col("n")))).alias("mean_length"),
    )
    filled = F.col("n_rows") - F.col("n_nulls")
    rate = F.coalesce(F.try_divide("n_distinct", filled), F.lit(0.0))
    kind = F.when(filled == 0, "all_null").when(F.col("n_distinct") == 1, "constant").when(rate >= 0.95, "near_unique").when((F.col("n_distinct") <= 20) | (rate <= 0.01), "low_cardinality").otherwise("high_cardinality")
    return out.select("column_name", "n_rows", "n_nulls", F.round(F.col("n_nulls") / F.col("n_rows"), 4).alias("null_rate"), "n_distinct", F.round(rate, 4).alias("distinct_rate"), "min_number", "max_number", F.round("mean_number", 4).alias("mean_number"), "min_length", "max_length", F.round("mean_length", 4).alias("mean_length"), kind.alias("class"))


def top_values(df: DataFrame, columns: Sequence[str], k: int = 5) -> DataFrame:
    """column_name, rank, value, n, share: the k most frequent non-empty values of each column, ties to the smaller value."""
    counts = _long(df, columns).where("value is not null and value <> ''").groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))
    total = counts.groupBy("column_name").agg(F.sum("n").alias("total"))
    order = Window.partitionBy("column_name").orderBy(F.desc("n"), F.asc("value"))
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).join(total, "column_name").select("column_name", "rank", "value", "n", F.round(F.col("n") / F.col("total"), 4).alias("share"))


def name_catalogue(df: DataFrame, name: str, value: str, entity: str) -> DataFrame:
    """Of each name: rows, distinct entities, and the value's extremes and median."""
    return df.where(F.col(name).isNotNull()).groupBy(F.col(name).alias("name")).agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct(entity).alias("n_entities"), F.min(value).alias("min_value"), F.round(F.expr(f"median({value})"), 4).alias("median_value"), F.max(value).alias("max_value"))


def names_per_entity(df: DataFrame, name: str, entity: str) -> DataFrame:
    """Over entities: the least, median and largest number of distinct names, and the number of entities."""
    per = df.where(F.col(name).isNotNull()).groupBy(entity).agg(F.count_distinct(name).alias("k"))
    return per.agg(F.min("k").alias("min_names"), F.expr("cast(median(k) as double)").alias("median_names"), F.max("k").alias("max_names"), F.count(F.lit(1)).alias("n_entities"))


def blank_rates(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Share of null or blank values of each column, over all rows."""
    return _long(df, columns).groupBy("column_name").agg(F.round(F.avg(F.when(F.col("value").isNull() | (F.trim("value") == ""), 1.0).otherwise(0.0)), 4).alias("blank_rate"))


def value_index(df: DataFrame, columns: Sequence[str], low: int = 3, high: int = 60) -> DataFrame:
    """Lower-cased text values of ``low`` to ``high`` characters with the columns that have them."""
    return _long(df, columns).where((F.length("value") >= low) & (F.length("value") <= high)).select("column_name", F.lower("value").alias("value")).distinct()
