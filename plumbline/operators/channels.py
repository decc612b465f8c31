"""Independent channels that speak for or against a relation, and what they say together.

Each channel reduces both sides to one row a key before they meet, and gives one row of counts a relation.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.keys import batched_signals, canonical, key_values

#: Shares from which a channel speaks against a relation.
COLLISION, DELETED, REVERSED = 0.95, 0.05, 0.05


def bidirectional(child: DataFrame, child_key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Shares (percent) of the child's keys that the parent has, and of the parent's that the child has."""
    left = key_values(child, child_key).groupBy("k0").agg(F.lit(1).alias("c"))
    right = key_values(parent, parent_key).groupBy("k0").agg(F.lit(1).alias("p"))
    n = left.join(right, "k0", "full").agg(F.count("c").alias("c"), F.count("p").alias("p"), F.count_if(F.col("c").isNotNull() & F.col("p").isNotNull()).alias("both"))
    share = lambda of: F.round(100.0 * F.try_divide("both", of), 4)
    return n.select(share("c").alias("forward"), share("p").alias("backward"))


def id_collision(tables: dict[str, DataFrame], child: str, child_key: str, parents: Sequence[tuple[str, str]], least: float = COLLISION) -> DataFrame:
    """parent, overlap and collides: whether dense ids make the child's keys fit other parents as well as their own."""
    e = batched_signals(tables, [(child, child_key, p, k) for p, k in parents]).select("parent", F.round("overlap", 4).alias("overlap"))
    others = e.agg(F.count_if(F.col("overlap") >= 100 * least)).first()[0]
    return e.withColumn("collides", (F.col("overlap") >= 100 * least) & F.lit(others > 1))


def refers_to_deleted(child: DataFrame, child_key: str, parent: DataFrame, parent_key: str, deleted: Column, most: float = DELETED) -> DataFrame:
    """n_rows that refer, n_deleted of them whose parent is deleted, and conflict: over ``most`` of them."""
    counted = child.where(F.col(child_key).isNotNull()).groupBy(canonical(child, child_key).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    gone = parent.select(canonical(parent, parent_key).alias("k"), deleted.cast("int").alias("gone")).groupBy("k").agg(F.min("gone").alias("gone"))
    n = counted.join(gone, "k").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.coalesce(F.sum(F.col("n") * F.col("gone")), F.lit(0)).alias("n_deleted"))
    return n.withColumn("conflict", F.coalesce(F.try_divide("n_deleted", "n_rows"), F.lit(0.0)) > most)


def temporal(child: DataFrame, child_key: str, child_time: str, parent: DataFrame, parent_key: str, parent_time: str, most: float = REVERSED) -> DataFrame:
    """n_rows that refer, n_early of them over a day before their parent, and conflict: over ``most`` of them."""
    p = parent.groupBy(F.col(parent_key).alias("_k")).agg(F.min(parent_time).alias("_t"))
    j = child.select(F.col(child_key).alias("_c"), F.col(child_time).alias("_u")).join(p, F.col("_c") == F.col("_k"))
    n = j.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.datediff("_t", "_u") > 1).alias("n_early"))
    return n.withColumn("conflict", F.coalesce(F.try_divide("n_early", "n_rows"), F.lit(0.0)) > most)


def verdicts(said: DataFrame) -> DataFrame:
    """relation, support, strong, weak and verdict; ``said`` has a row for each channel that speaks: relation, channel, says
    (for, against), strong (a conflict that refutes)."""
    n = said.groupBy("relation").agg(F.count_if(F.col("says") == "for").alias("support"), F.count_if((F.col("says") == "against") & F.col("strong")).alias("strong"), F.count_if((F.col("says") == "against") & ~F.col("strong")).alias("weak"))
    verdict = (
        F.when((F.col("strong") > 0) & (F.col("strong") >= F.col("support")), "refuted").when(F.col("strong") + F.col("weak") > 0, "review")
        .when(F.col("support") >= 2, "corroborated").otherwise("single_channel")
    )
    return n.withColumn("verdict", verdict)


def channel(relation: str, name: str, row: DataFrame, conflict: Column, strong: bool = True) -> DataFrame:
    """One row of ``verdicts``' input from a channel's row."""
    return row.select(F.lit(relation).alias("relation"), F.lit(name).alias("channel"), F.when(conflict, "against").otherwise("for").alias("says"), F.lit(strong).alias("strong"))


def together(rows: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, rows)
