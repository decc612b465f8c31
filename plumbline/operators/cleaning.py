"""Kinds of cleaning rules, each found by aggregation over whole tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.keys import key_values

#: Share of dangling rows that one explanation must have, and of codes that a comment must list.
COHERENT, LISTED = 0.8, 1.0


def encoding_conflicts(df: DataFrame, code: str, name: str) -> DataFrame:
    """kind (code_with_names, name_with_codes), value and n: codes that have several names, names that have several codes."""
    pairs = df.where(F.col(code).isNotNull() & F.col(name).isNotNull()).groupBy(F.col(code).cast("string").alias("c"), F.trim(F.col(name).cast("string")).alias("m")).agg(F.lit(1).alias("_"))
    several = lambda kind, of, what: pairs.groupBy(F.col(of).alias("value")).agg(F.count(what).alias("n")).where("n > 1").select(F.lit(kind).alias("kind"), "value", "n")
    return several("code_with_names", "c", "m").unionByName(several("name_with_codes", "m", "c"))


def dangling(child: DataFrame, child_key: str, parent: DataFrame, parent_key: str, explained_by: Column, least: float = COHERENT) -> DataFrame:
    """n_dangling, explanation, n_explained and coherent: rows without a parent, and whether most of them share one explanation
    (a source, a period): then the relation's scope is narrower, and no row is wrong."""
    ck = F.col(child_key)
    counted = child.where(ck.isNotNull()).groupBy(ck.cast("string").alias("k0"), explained_by.cast("string").alias("why")).agg(F.count(F.lit(1)).alias("n"))
    lost = counted.join(key_values(parent, parent_key).select("k0").distinct(), "k0", "left_anti").groupBy("why").agg(F.sum("n").alias("n"))
    out = lost.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_dangling"), F.max_by("why", F.struct("n", "why")).alias("explanation"), F.coalesce(F.max("n"), F.lit(0)).alias("n_explained"))
    return out.withColumn("coherent", (F.col("n_dangling") > 0) & (F.col("n_explained") >= least * F.col("n_dangling")))


def empty_shells(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column_name and n_filled of columns in which no value tells anything: null, blank, zero or one value throughout."""
    text = lambda c: F.trim(F.col(c).cast("string"))
    filled = lambda c: F.col(c).isNotNull() & ~text(c).isin("", "0", "0.0")
    stats = df.agg(*(x for i, c in enumerate(columns) for x in (F.count_if(filled(c)).alias(f"n{i}"), F.min(F.when(filled(c), text(c))).alias(f"lo{i}"), F.max(F.when(filled(c), text(c))).alias(f"hi{i}"))))
    cells = F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(f"n{i}").alias("n_filled"), (F.col(f"n{i}") == 0).alias("blank"), F.coalesce(F.col(f"lo{i}") == F.col(f"hi{i}"), F.lit(False)).alias("constant")) for i, c in enumerate(columns)))
    return stats.select(F.explode(cells).alias("x")).select("x.*").where("blank or constant")


def comment_mismatch(df: DataFrame, column: str, meanings: dict[str, str]) -> DataFrame:
    """value, n and listed: of codes in the data that a column's comment does not list, and of listed ones that no row has (n = 0)."""
    listed = df.sparkSession.createDataFrame(sorted((c, True) for c in meanings), "value string, listed boolean")
    counted = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    both = counted.join(listed, "value", "full").select("value", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("listed", F.lit(False)).alias("listed"))
    return both.where("n = 0 or not listed")


def all_kinds(found: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """kind and n_findings of several kinds' findings."""
    return reduce(DataFrame.unionByName, (df.agg(F.count(F.lit(1)).alias("n_findings")).select(F.lit(kind).alias("kind"), "n_findings") for kind, df in found))
