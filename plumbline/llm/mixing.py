"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Targets: sources share the total of all sizes by weight, none beyond ``limit`` times its own size; what is
over goes to the others by weight until none is above (solved in closed form over the sources in order of
limit per weight). A source's documents fall into blocks by hash. It is taken whole floor(target / size)
times, then once more in part: as many of its blocks as the rest has of the blocks' mean size.

These are the quotas: of each source the blocks of whole passes, those to take in the last pass and those to leave. A binary
tree over the output shards divides them: at each node the left half's share of every quota is drawn from the
multivariate hypergeometric distribution, so quotas stay exact at every level. A shard then draws its quotas as
disjoint ranges of the source's permuted blocks: which blocks are taken, and by which shard, is what the tree drew. Blocks
differ in size, so a source's last pass is settled at its end: in the shards' order blocks are given back, or left ones
taken, until the rest is met, and of the block at which it is met the documents that fit are taken: in a permuted
order, then bettered by single exchanges. A shard orders its documents by a hash of its own.
Every draw is seeded by node or hashed by id, so reruns agree.

Blocks hold ``block_words`` words or more, so many that there are at most MAX_BLOCKS and one a source: the
driver plans blocks, never documents. Sources of a mix are configured, so few. Shards grow with the words.

Null text: size 0. Documents of size 0 are taken as their block is. Null sources are one source, the last.
Repeated rows are units of their own, numbered among those of their id and source in order of size. An empty table
gives empty results. doc_id and source may be of any type that orders.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from plumbline.llm.common import count_words, written

BLOCK_WORDS, MAX_BLOCKS, SHARD_WORDS, LIMIT, SEED = 200_000, 200_000, 20_000_000, 3, 20_240
#: Fewest and most output shards.
SHARDS = (64, 65_536)


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def units(docs: DataFrame) -> DataFrame:
    """doc_id, source, size and i of each row; i numbers the rows that share an id and a source, in order of size."""
    sized = docs.select("doc_id", "source", count_words("text").alias("size"))
    found = sized.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("n"))  # equal rows meet as a count
    upto = F.sum("n").over(Window.partitionBy("doc_id", "source").orderBy("size"))
    found = found.withColumn("upto", upto)
    return found.select("doc_id", "source", "size", F.explode(F.sequence(F.col("upto") - F.col("n") + 1, F.col("upto"))).alias("i"))


def targets(rows: DataFrame, limit: int = LIMIT) -> DataFrame:
    """source, source_size, source_rows and target; one row per source."""
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("source_rows"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    sources = sources.select("source", "source_size", "source_rows", (rank % 3 + 1).cast("double").alias("w"), (F.col("source_size") * limit).cast("double").alias("most"))
    order = Window.orderBy(F.col("most") / F.col("w"), F.col("source").asc_nulls_last())
    before, all_ = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(all_) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / (F.sum("w").over(all_) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    open_ = F.col("most") >= F.col("w") * F.col("level")
    found = sources.withColumn("level", level).withColumn("level", F.max(F.when(open_, F.col("level"))).over(all_))  # levels fall beyond the first open one
    return found.select("source", "source_size", "source_rows", F.least("most", F.col("w") * F.col("level")).alias("target"))


def fitting(sizes: np.ndarray, room: float, rounds: int = 50) -> np.ndarray:
    """Which of a block's documents to take: in turn, those that fit; then single additions and exchanges of one
    taken for one left out, as long as they bring the sum nearer to the room."""
    taken = np.zeros(len(sizes), bool)
    for i, size in enumerate(sizes):
        if size <= room:
            taken[i], room = True, room - size
    for _ in range(rounds):
        inside, outside = np.flatnonzero(taken), np.flatnonzero(~taken)
        if not len(outside):
            break
        outside = outside[np.argsort(sizes[outside], kind="stable")]
        want = np.append(0.0, sizes[inside]) + room  # the size to add if nothing, or each taken one, is given back
        near = np.searchsorted(sizes[outside], want)
        near = np.stack([np.clip(near - 1, 0, len(outside) - 1), np.clip(near, 0, len(outside) - 1)])
        miss = np.abs(want - sizes[outside][near])
        side, best = np.unravel_index(miss.argmin(), miss.shape)
        if miss[side, best] >= abs(room):
            break
        new = outside[near[side, best]]
        taken[new], room = True, room - sizes[new]
        if best:
            taken[inside[best - 1]], room = False, room + sizes[inside[best - 1]]
    return taken


# -- the plan of blocks -------------------------------------------------------------------------------------


def split_quotas(counts: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """shards x quotas: the blocks of each shard. Columns sum to ``counts``, rows differ by 1 at most."""
    out = np.zeros((shards, len(counts)), np.int64)
    todo = [(0, shards, np.asarray(counts, np.int64))]
    while todo:
        low, high, own = todo.pop()
        if high - low == 1:
            out[low] = own
            continue
        middle = (low + high) // 2
        rng = np.random.Generator(np.random.Philox(key=[seed, low << 32 | high]))
        share = rng.multivariate_hypergeometric(own, int(own.sum()) * (middle - low) // (high - low), method="marginals")
        todo += [(low, middle, share), (middle, high, own - share)]
    return out


def plan(goal: list[tuple[int, float]], blocks: list[np.ndarray], shards: int, limit: int, seed: int) -> pd.DataFrame:
    """s, block, copy, shard, room and alone of each block copy that is taken; goal: (size, target) and blocks: words of
    each block, of every source s. room: what a block that is taken in part has to hold, else null; alone: it has no other copy."""
    passes, quotas = [], []
    for (size, target), words in zip(goal, blocks, strict=True):
        full = min(limit, int(target // size)) if size else 0
        rest = target - full * size if full < limit else 0.0
        take = min(len(words), max(1, round(rest * len(words) / size))) if rest > 0 and size else 0
        passes.append((full, rest))
        quotas += [full * len(words), take, len(words) - take]
    split = split_quotas(np.array(quotas, np.int64), shards, seed)
    out = []
    for s, ((full, rest), words) in enumerate(zip(passes, blocks, strict=True)):
        rng = np.random.Generator(np.random.Philox(key=[seed + 1, s]))
        whole, take, leave = split[:, 3 * s], split[:, 3 * s + 1], split[:, 3 * s + 2]
        order = rng.permutation(full * len(words))
        out.append(pd.DataFrame({"s": s, "block": order // max(1, full), "copy": order % max(1, full) + 1, "shard": np.repeat(np.arange(shards), whole), "room": np.nan, "alone": False}))
        if rest <= 0:
            continue
        order = rng.permutation(len(words))
        shard = np.repeat(np.arange(shards), take + leave)
        place = np.arange(len(words)) - np.repeat(np.cumsum(take + leave) - (take + leave), take + leave)
        turn = np.argsort(place >= np.repeat(take, take + leave), kind="stable")  # what shards take, in their order; then what they leave
        order, shard = order[turn], shard[turn]
        upto = np.cumsum(words[order])
        before = upto - words[order]
        used = (upto <= rest) | (before < rest)
        out.append(pd.DataFrame({"s": s, "block": order, "copy": full + 1, "shard": shard, "room": np.where(upto <= rest, np.nan, rest - before), "alone": full == 0})[used])
    return pd.concat(out, ignore_index=True) if out else pd.DataFrame({"s": [], "block": [], "copy": [], "shard": [], "room": [], "alone": []})


def _planned(rows: DataFrame, shards: int | None, limit: int, block_words: int, seed: int, name: str) -> tuple[DataFrame, DataFrame]:
    """The sources' table, with their numbers s and counts of blocks; and the table of block copies."""
    spark = rows.sparkSession
    goal = written(targets(rows, limit).withColumn("s", (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1).cast("int")), f"{name}-targets")
    size, n = goal.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("source_rows"), F.lit(0))).first()
    each = max(block_words, math.ceil((size + n) / MAX_BLOCKS))
    goal = goal.withColumn("n_blocks", F.greatest(F.lit(1), F.ceil((F.col("source_size") + F.col("source_rows")) / each)).cast("long"))  # empty documents fill blocks too
    found = _in_blocks(rows, goal, seed).groupBy("s", "block").agg(F.sum("size").alias("words")).toPandas()
    per = goal.select("s", "source_size", "target", "n_blocks").orderBy("s").collect()
    words = [np.zeros(int(r["n_blocks"]), np.int64) for r in per]
    for s, own in found.groupby("s"):
        words[s][own["block"].to_numpy()] = own["words"].to_numpy()
    shards = shards or min(SHARDS[1], max(SHARDS[0], -(-size // SHARD_WORDS)))
    p = plan([(int(r["source_size"]), float(r["target"])) for r in per], words, shards, limit, seed)
    schema = pa.schema([("s", pa.int32()), ("block", pa.int64()), ("copy", pa.int32()), ("shard", pa.int32()), ("room", pa.float64()), ("alone", pa.bool_())])
    return goal, spark.createDataFrame(pa.Table.from_arrays([pa.array(p[f.name].to_numpy(), f.type, from_pandas=True) for f in schema], schema=schema))


def _in_blocks(rows: DataFrame, goal: DataFrame, seed: int) -> DataFrame:
    """``rows`` with s, source_size, target and block of each; they have doc_id, source and i."""
    block = F.pmod(F.xxhash64(F.lit(seed), "doc_id", "i"), F.col("n_blocks"))
    own = goal.select(F.col("source").alias("_source"), "s", "source_size", "target", "n_blocks")
    return rows.join(own, _same("source", "_source")).withColumn("block", block).drop("_source", "n_blocks")


def _taken(rows: DataFrame, blocks: DataFrame, seed: int) -> DataFrame:
    """doc_id, source, i and copy of what is taken of blocks that are taken in part; none of other blocks' rows."""
    kinds = {f.name: f for f in rows.schema.fields}
    out = StructType([kinds["doc_id"], kinds["source"], StructField("i", LongType()), StructField("copy", IntegerType())])

    def fits(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["turn", "i"], kind="stable")
        return part[fitting(part["size"].to_numpy(), float(part["room"].iloc[0]))][["doc_id", "source", "i", "copy"]]

    cut = rows.join(blocks.where("room is not null"), ["s", "block"]).select("doc_id", "source", "i", "copy", "size", "room", "s", F.xxhash64(F.lit(seed + 2), "doc_id").alias("turn"))
    some = cut.where("size > 0").groupBy("s").applyInPandas(fits, out)
    return some.unionByName(cut.where("size = 0").select("doc_id", "source", "i", "copy"))


def _dealt(rows: DataFrame, blocks: DataFrame, cut: DataFrame, seed: int) -> DataFrame:
    """``rows``, which have s, block, doc_id, source and i, once for each copy with copy, shard and place; copy is null where none is taken."""
    joined = rows.join(blocks, ["s", "block"], "left")
    whole = joined.where("room is null").drop("room", "alone")
    part = joined.where("room is not null")
    own = cut.select(F.col("doc_id").alias("_d"), F.col("source").alias("_source"), F.col("i").alias("_i"), F.col("copy").alias("_c"))
    part = part.join(own, _same("doc_id", "_d") & _same("source", "_source") & (F.col("i") == F.col("_i")), "left").where("_c is not null or alone")
    part = part.withColumns({"copy": F.col("_c"), "shard": F.when(F.col("_c").isNotNull(), F.col("shard"))}).drop("_d", "_source", "_i", "_c", "room", "alone")
    place = F.when(F.col("copy").isNotNull(), F.xxhash64(F.lit(seed + 4), "shard", "doc_id", "i", "copy"))
    return whole.unionByName(part).withColumn("place", place)


def mix(docs: DataFrame, shards: int | None = None, limit: int = LIMIT, block_words: int = BLOCK_WORDS, seed: int = SEED) -> DataFrame:
    """One row for each document copy: doc_id, source, i, size, source_size, target, block, copy, shard, place; and rows
    with copy null for documents that the mix leaves out. shards: by the words if not given."""
    rows = written(units(docs), "mix-rows")
    goal, blocks = _planned(rows, shards, limit, block_words, seed, "mix")
    placed = _in_blocks(rows, goal, seed)
    return _dealt(placed, blocks, _taken(placed, blocks, seed), seed).drop("s")


def taken_words(mixed: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and taken of each row, from the copies that shards drew (``mix``); and n_shards, how many did."""
    per = mixed.groupBy("doc_id", "source", "i", "size", "source_size", "target").agg(F.count("copy").alias("n"), F.count_distinct("shard").alias("n_shards"))
    return per.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("n")).alias("taken"), "n_shards")


# -- documents ----------------------------------------------------------------------------------------------


def _numbered(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """``docs`` with i, as ``units`` numbers them. Only rows that share an id and a source are sorted for it."""
    shared = rows.where("i > 1").groupBy("doc_id", "source").agg(F.max("i")).select(F.col("doc_id").alias("_d"), F.col("source").alias("_source"))
    if not shared.limit(1).count():
        return docs.withColumn("i", F.lit(1).cast("long"))
    on = _same("doc_id", "_d") & _same("source", "_source")
    more = docs.join(shared, on, "left_semi").withColumns({"_size": count_words("text"), "_task": F.spark_partition_id()})
    keys = ["doc_id", "source", "_size", "_task"]
    local = F.row_number().over(Window.partitionBy(*keys).orderBy(F.lit(0)))
    start = more.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).withColumn("_upto", F.sum("_n").over(Window.partitionBy("doc_id", "source").orderBy("_size", "_task")))
    start = start.select(*(F.col(c).alias(f"{c}_") for c in keys), (F.col("_upto") - F.col("_n")).alias("_before"))
    found = more.withColumn("_local", local).join(start, _same("doc_id", "doc_id_") & _same("source", "source_") & (F.col("_size") == F.col("_size_")) & (F.col("_task") == F.col("_task_")))
    found = found.withColumn("i", F.col("_before") + F.col("_local")).select(*docs.columns, "i")
    return docs.join(shared, on, "left_anti").withColumn("i", F.lit(1).cast("long")).unionByName(found)


def mixed_documents(docs: DataFrame, shards: int | None = None, limit: int = LIMIT, block_words: int = BLOCK_WORDS, seed: int = SEED) -> DataFrame:
    """The documents of the mix with all their columns, each as often as it is taken, by shard and place.

    Documents find their block by hash and its copies in the plan's table of blocks; texts are shuffled once, to their
    shards. ``docs`` is read more than once, so it should be a table."""
    rows = written(units(docs), "mix-rows")
    goal, blocks = _planned(rows, shards, limit, block_words, seed, "mix")
    cut = written(_taken(_in_blocks(rows, goal, seed), blocks, seed), "mix-cut")
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row")  # its columns may have any names
    dealt = _dealt(_in_blocks(_numbered(docs.select("doc_id", "source", "text", whole), rows).drop("text"), goal, seed), blocks, cut, seed)
    dealt = dealt.where("copy is not null").repartition(blocks_shards(blocks), "shard").sortWithinPartitions("shard", "place")
    return dealt.select(*(F.col("_row").getField(c).alias(c) for c in docs.columns))


def blocks_shards(blocks: DataFrame) -> int:
    """How many shards the plan has."""
    return (blocks.agg(F.max("shard")).first()[0] or 0) + 1
