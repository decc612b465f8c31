"""Structured Streaming forms of batch operators: monitoring, latest rows, daily roll-ups, re-verification."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.rules import Rule, fired


def stream(spark: SparkSession, path: str, schema) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).parquet(path)


def daily(events: DataFrame, time: str, keys: Sequence[str], value: str, late: str = "1 day") -> DataFrame:
    """Tumbling days with counts and sums; days close when the watermark has passed them."""
    own = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    out = own.groupBy(F.window(time, "1 day"), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return out.select(F.to_date("window.start").alias("day"), *keys, "n", "total")


def alerts(events: DataFrame, time: str, key: str, rules: Sequence[Rule], late: str = "1 hour") -> DataFrame:
    """Rows that rules catch, each (key, rule) once within the watermark."""
    hits = fired(events.withColumn("_key", F.struct(key, F.col(time).cast("timestamp").alias("at"))), "_key", rules)
    return hits.select(F.col(f"_key.{key}").alias(key), F.col("_key.at").alias("at"), "rule", "decision", "severity").withWatermark("at", late).dropDuplicatesWithinWatermark([key, "rule"])


def newest(events: DataFrame, time: str, key: str, value: str) -> DataFrame:
    """The latest value of each key (complete or update mode). State holds one row a key, for as long as the stream runs: for keys of a bounded number."""
    return events.groupBy(key).agg(F.max_by(value, time).alias(value), F.max(time).alias(time))


def newest_per_day(events: DataFrame, time: str, key: str, value: str, late: str = "1 day") -> DataFrame:
    """The latest value of each key and day; a day's state goes when the watermark has passed it, so that state stays bounded for any keys."""
    own = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    out = own.groupBy(F.window(time, "1 day"), key).agg(F.max_by(value, time).alias(value), F.max(time).alias(time))
    return out.select(F.to_date("window.start").alias("day"), key, value, time)


def reverify(events: DataFrame, check: Callable[[DataFrame], None], checkpoint: str):
    """Runs ``check`` on every micro-batch, for bindings that new data may support or refute."""
    return events.writeStream.foreachBatch(lambda batch, _: check(batch)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def collected(df: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what there is now into an in-memory table; for tests and small folders."""
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)
