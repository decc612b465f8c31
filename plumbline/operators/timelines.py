"""Operators over ordered rows: running and trailing sums, recency, day spines, FIFO allocation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_sum(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, name: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(name, F.sum(value).over(w))


def trailing_sum(df: DataFrame, key: str, day: str, value: str, days: int, name: str) -> DataFrame:
    """Sum over the last ``days`` days, today included: strictly later than day - days."""
    number = F.datediff(F.col(day), F.lit("1970-01-01").cast("date"))
    return df.withColumn(name, F.sum(value).over(Window.partitionBy(key).orderBy(number).rangeBetween(-(days - 1), 0)))


def recency(last: Column, today: Column) -> Column:
    """new up to 90 days since the last event, dormant up to 180, lost beyond, never without one."""
    gap = F.datediff(today, last)
    return F.when(last.isNull(), "never").when(gap <= 90, "new").when(gap <= 180, "dormant").otherwise("lost")


def per_day(df: DataFrame, start: str, end: str, day: str = "day") -> DataFrame:
    """A row for each day from ``start`` to ``end``, both included; none if it ends before it starts."""
    days = F.when(F.col(end).cast("date") >= F.col(start).cast("date"), F.sequence(F.col(start).cast("date"), F.col(end).cast("date")))
    return df.withColumn(day, F.explode(days))


def overlap_seconds(start: Column, end: Column, day: Column) -> Column:
    """Seconds of [start, end) that fall on a day."""
    low, high = F.greatest(start.cast("timestamp_ntz"), day.cast("timestamp_ntz")), F.least(end.cast("timestamp_ntz"), F.date_add(day, 1).cast("timestamp_ntz"))
    return F.greatest(F.lit(0), F.timestamp_diff("SECOND", low, high))


def day_spine(days: DataFrame, members: DataFrame, facts: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Every active member on every day of its activity, with its fact or 0. members: keys without the day, since, until."""
    spine = members.select("*", F.explode(F.sequence(F.col("since"), F.col("until"))).alias("day")).drop("since", "until")
    return spine.join(days, "day", "left_semi").join(facts, list(keys), "left").fillna(0, [value])


def split_evenly(total: Column, n: Column, i: Column, decimals: int = 2) -> Column:
    """The i-th of n equal parts of a total (i from 1); the last takes the remainder."""
    part = F.floor(total / n * 10**decimals) / 10**decimals
    return F.when(i < n, part).otherwise(F.round(total - part * (n - 1), decimals))


def fifo(supply: DataFrame, demand: DataFrame, key: str, order: str, quantity: str) -> DataFrame:
    """(key, supply_no, demand_no, allocated): demands take from supplies in order, first in first out.

    The running totals of both sides cut a key's quantity into stretches; each belongs to the supply and the demand
    whose totals it does not go beyond. Both sides' cuts are sorted together and read from the end, so no rows are paired."""

    def cuts(df: DataFrame, side: str) -> DataFrame:
        w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        own = df.select(key, F.col(order).alias("_no"), F.col(quantity).alias("_q"), F.sum(quantity).over(w).alias("_upto"))
        return own.where("_q > 0").select(key, "_upto", *(F.col("_no").alias(f"{s}_no") if s == side else F.lit(None).cast(df.schema[order].dataType).alias(f"{s}_no") for s in ("supply", "demand")))

    back = Window.partitionBy(key).orderBy(F.desc("_upto"))
    so_far = back.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    size = F.col("_upto") - F.coalesce(F.lead("_upto").over(back), F.lit(0))
    met = cuts(supply, "supply").unionByName(cuts(demand, "demand"))
    met = met.select(key, *(F.last(c, ignorenulls=True).over(so_far).alias(c) for c in ("supply_no", "demand_no")), size.alias("allocated"))
    return met.where("allocated > 0 and supply_no is not null and demand_no is not null")


def month_end(df: DataFrame, key: str, day: str, value: str, tie: str) -> DataFrame:
    """The last value of each month."""
    return df.groupBy(key, F.date_format(day, "yyyy-MM").alias("month")).agg(F.max_by(value, F.struct(day, tie)).alias("last_value"))
