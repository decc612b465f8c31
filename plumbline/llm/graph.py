"""Connected components of an edge list; only ids are moved.

Up to a checked number of edges, one task joins them by union-find; beyond it, alternating large and small
stars do the same in distributed rounds. Both give every node the smallest node that it reaches.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import drop, written


#: Edges (16 bytes each) that one task joins.
LOCAL_EDGES = 1_000_000


def union_find(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and their labels, by hooking larger roots to smaller ones and halving paths, all edges at a time."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low, high = np.minimum(root[x], root[y]), np.maximum(root[x], root[y])
        open_ = low != high
        if not open_.any():
            return nodes, nodes[root]
        x, y = x[open_], y[open_]
        np.minimum.at(root, high[open_], low[open_])
        while (root[root] != root).any():
            root = root[root]


def _in_one_task(edges: DataFrame) -> DataFrame:
    def run(batches):
        parts = [(t.column(0).to_numpy(), t.column(1).to_numpy()) for t in batches if t.num_rows]
        if parts:
            nodes, labels = union_find(*(np.concatenate(x) for x in zip(*parts, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(labels)], names=["node", "label"])

    return edges.select("a", "b").coalesce(1).mapInArrow(run, "node long, label long")


def components(edges: DataFrame, name: str = "components", local_edges: int = LOCAL_EDGES, most_rounds: int = 60) -> DataFrame:
    """node and label (the smallest node that it reaches) of every node of ``edges`` (a, b).

    In a round each node links its larger neighbours to its smallest one (large star), then its smaller
    ones and itself to its smallest (small star). Groups are aggregated, never collected; each round starts
    from a written table. It ends when a round changes no edge, as counts and sums of hashes tell.
    """
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    if now.count() <= local_edges:
        return written(_in_one_task(now), name)
    sign = lambda df: df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    seen = sign(now)
    for _ in range(most_rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        after = written(large, name)
        low = after.groupBy("a").agg(F.min("b").alias("m"))
        linked = after.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        new = written(linked.unionByName(low.select("a", F.col("m").alias("b"))).distinct(), name)
        drop(after, now)
        now, before, seen = new, seen, sign(new)
        if seen == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    nodes = now.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return nodes.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
