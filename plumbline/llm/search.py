"""Exact top-k by inner product with MaxScore.

Every dimension gives two terms, its positive and its negative values, each with a postings list of the
vectors that have it, in order of ids. For a query, the term of its component's own sign adds to a score, at most
|q| * (the list's largest |x|); the other sign's term can only take away. A shard is gone through in stretches of
ids. Before each one, and for each query, terms are parted by the k-th best score so far: those at the low end whose bounds add up to no
more than it are non-essential, for a vector in no other list cannot enter. The essential lists are traversed and
their contributions accumulated; then the other lists are probed for the vectors found, largest bound first, and a vector
drops out once its partial score plus the bounds still to come cannot reach the k-th best. What is found raises the k-th best
score, so that fewer terms are essential in the next stretch. Shards' best are merged, ties to smaller ids.

Components x become floor(256 * x) as integers. Sums of those within +-2^27 fit 64 bits; vectors with a larger
one go through the same lists in integers of any size, and a score among the best that 64 bits do not hold is an error
as in SQL. Vectors that are null or have a null or non-finite component take no part. Shorter vectors count as ended by
zeros. Every row is a vector of its own, also where rows share a vec_id or have none (these come last among
ties); a query leaves out its own row only. Fewer than k candidates: all of them.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import written

SHARD_ROWS, QUERY_ROWS, _LIMIT = 16_384, 4_096, float(1 << 27)
#: Rows of the first stretch, and how much longer each next one is.
_FIRST, _GROWS = 1024, 15
#: Queries that go through a shard together.
_TOGETHER = 64


def quantised(embeddings: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id and v, its integer components, of each row that takes part; if one is beyond the limit, v is null and
    wide has them times ``scale`` without the floor."""
    scaled = F.transform("embedding", lambda x: x.cast("double") * scale)
    beyond = F.exists(scaled, lambda x: F.abs(x) > _LIMIT)
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    rows = embeddings.where(F.col("embedding").isNotNull() & ~F.exists("embedding", bad))
    return rows.select("vec_id", F.when(~beyond, F.transform(scaled, lambda x: F.floor(x).cast("int"))).alias("v"), F.when(beyond, scaled).alias("wide"))


def _vectors(rows: pd.DataFrame, width: int, kind) -> np.ndarray:
    out = np.zeros((len(rows), width), kind)
    for i, (v, wide) in enumerate(zip(rows["v"], rows["wide"], strict=True)):
        own = v if v is not None else [int(x) for x in np.floor(wide)]
        out[i, : len(own)] = [int(x) for x in own] if kind is object else own
    return out


@dataclass
class Postings:
    """A term's list: positions of vectors, ascending, their values, where stretches begin, and the largest |value|."""

    at: np.ndarray
    value: np.ndarray
    cuts: np.ndarray
    top: int

    @staticmethod
    def of(column: np.ndarray, sign: int, edges: np.ndarray) -> Postings:
        at = np.flatnonzero(column * sign > 0)
        value = column[at]
        return Postings(at, value, np.searchsorted(at, edges), max(map(abs, (value.min(), value.max()))) if len(at) else 0)

    def stretch(self, s: int) -> tuple[np.ndarray, np.ndarray]:
        own = slice(self.cuts[s], self.cuts[s + 1])
        return self.at[own], self.value[own]


class Shard:
    """Postings lists of a shard's vectors, whose ids ascend."""

    def __init__(self, x: np.ndarray, first: int = _FIRST, grows: int = _GROWS):
        edges, step = [0], first
        while edges[-1] < len(x):
            edges.append(min(len(x), edges[-1] + step))
            step *= grows
        self.edges, self.kind = np.array(edges), x.dtype
        self.lists = {s: [Postings.of(x[:, d], s, self.edges) for d in range(x.shape[1])] for s in (1, -1)}

    def best(self, queries: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Positions and scores of each query's k best, best first, ties by position. Queries, some at a time, share the lists' traversal."""
        return [found for i in range(0, len(queries), _TOGETHER) for found in self._best(queries[i : i + _TOGETHER], k)]

    def _best(self, q: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        n, width = q.shape
        tops = np.array([[self.lists[s][d].top for d in range(width)] for s in (1, -1)], self.kind).reshape(2, width)
        bound = np.where(q > 0, q * tops[0], -q * tops[1])
        order = np.argsort(-bound, axis=1, kind="stable")
        bound = np.take_along_axis(bound, order, 1)
        rest = np.concatenate([np.cumsum(bound[:, ::-1], axis=1)[:, ::-1], np.zeros((n, 1), self.kind)], axis=1)  # bounds of a term and all after it
        found = [(np.empty(0, np.int64), np.empty(0, self.kind)) for _ in range(n)]
        for s in range(len(self.edges) - 1):
            low, high = int(self.edges[s]), int(self.edges[s + 1])
            # The k-th best so far, to which later positions lose ties. Without it, or with a negative one, vectors in no list may be among the best.
            least = [score[-1] if len(score) == k and score[-1] >= 0 else None for _, score in found]
            essential = np.array([width if x is None else int((rest[g] > x).sum()) for g, x in enumerate(least)])
            chosen = np.zeros((n, width), bool)
            np.put_along_axis(chosen, order, np.arange(width) < essential[:, None], 1)
            weight, partial = np.where(chosen, q, 0).astype(self.kind), np.zeros((high - low, n), self.kind)
            for d in np.flatnonzero(chosen.any(0)):
                for sign in (1, -1):  # a query's own sign adds to it, and the other, which never makes a candidate, takes away
                    own, value = self.lists[sign][d].stretch(s)
                    if len(own):
                        partial[own - low] += value[:, None] * weight[:, d]
            partial = np.ascontiguousarray(partial.T)
            for g in range(n):
                found[g] = self._settled(q[g], partial[g], order[g], rest[g], int(essential[g]), least[g], found[g], s, k)
        return found

    def _settled(self, q, partial, order, rest, essential, least, found, s, k):
        """The best so far and of a stretch, where ``partial`` has what the essential lists add up to."""
        low, at, score = int(self.edges[s]), *found
        # Who is in no essential list of the query's sign has nothing above zero here, and so falls short.
        live = np.arange(len(partial)) if least is None else np.flatnonzero(partial > least - rest[essential])
        if least is None and len(live) > k and self.kind != object:
            live = np.flatnonzero(partial >= np.partition(partial, len(partial) - k)[len(partial) - k])
        sums = partial[live]
        for i in range(essential, len(order)):
            d = order[i]
            for sign in (1, -1) if q[d] < 0 else (-1, 1):  # what takes away first
                if not len(live) or not q[d]:
                    break
                own, value = self.lists[sign][d].stretch(s)
                if len(own):
                    place = np.minimum(np.searchsorted(own, live + low), len(own) - 1)
                    sums = sums + np.where(own[place] == live + low, q[d] * value[place], 0)
                ok = sums > least - rest[i + ((sign > 0) == (q[d] > 0))]  # of this term's own list too once it is probed
                live, sums = live[ok], sums[ok]
        at, score = np.concatenate([at, live + low]), np.concatenate([score, sums])
        first = np.lexsort((at, -score))[:k] if self.kind != object else np.array(sorted(range(len(at)), key=lambda i: (-score[i], at[i]))[:k], np.int64)
        return at[first], score[first]


_MOST = 10**38 - 1  # what a decimal holds; beyond 64 bits a score among the best is an error anyway
_FOUND = "query long, query_id long, copies long, vec_id long, score decimal(38, 0), mine boolean"


def _search(asked: pd.DataFrame, rows: pd.DataFrame, k: int, kind) -> pd.DataFrame:
    """Each query's k best of the rows; mine: whether a row is like the query's own."""
    width = max(len(x) for df in (asked, rows) for c in ("v", "wide") for x in df[c] if x is not None)
    rows = rows.sort_values("vec_id", na_position="last", kind="stable")
    shard, ids, vectors = Shard(_vectors(rows, width, kind)), rows["vec_id"].array, _vectors(asked, width, kind)
    best = shard.best(vectors, k)
    own = [sum(int(x) * int(x) for x in q) for q in vectors]
    out = asked.loc[asked.index.repeat([len(at) for at, _ in best]), ["query", "vec_id", "copies"]].rename(columns={"vec_id": "query_id"}).reset_index(drop=True)
    out["vec_id"] = ids[np.concatenate([at for at, _ in best])]
    out["score"] = pd.Series([Decimal(max(-_MOST, min(_MOST, int(x)))) for _, score in best for x in score], dtype=object)
    like = [int(x) == mine for (_, score), mine in zip(best, own, strict=True) for x in score]
    out["mine"] = np.array(like, bool) & ((out["vec_id"] == out["query_id"]).fillna(False) | (out["vec_id"].isna() & out["query_id"].isna())).to_numpy(bool)
    return out


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """query_id, rank, vec_id and score; ``vectors`` and ``queries``, some of them, are of ``quantised``.

    A grid: vectors in shards and queries in blocks of bounded size, each cell a task's work. Vectors are
    sent once for each block of queries, queries once for each shard. Equal query rows are asked once. One more than k
    is sought, with the query's own row among the candidates, which then is taken out where it is found."""
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = queries.groupBy("vec_id", "v", "wide").agg(F.count(F.lit(1)).alias("copies")).withColumn("query", F.monotonically_increasing_id())
    asked = written(asked, "maxscore-queries")
    shards, blocks = (max(1, -(-df.count() // size)) for df, size in ((vectors, shard_rows), (asked, query_rows)))
    anywhere = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)).cast("int")  # ids and vectors may repeat
    left = vectors.select(anywhere.alias("s"), each(blocks).alias("b"), F.col("vec_id").cast("long"), "v", "wide")
    right = asked.select(each(shards).alias("s"), F.pmod(F.xxhash64("query"), F.lit(blocks)).cast("int").alias("b"), "query", F.col("vec_id").cast("long"), "copies", "v", "wide")

    def cell(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        rows["vec_id"], asked["vec_id"] = rows["vec_id"].astype("Int64"), asked["vec_id"].astype("Int64")
        plain, big, asked_plain, asked_big = (df[df["wide"].isna() == yes] for df in (rows, asked) for yes in (True, False))
        work = [(asked_plain, plain, np.int64), (asked_plain, big, object), (asked_big, rows, object)]
        found = [_search(a, b, k + 1, kind) for a, b, kind in work if len(a) and len(b)]
        return pd.concat(found) if found else pd.DataFrame({c: [] for c in ("query", "query_id", "copies", "vec_id", "score", "mine")})

    cells = left.groupBy("s", "b").cogroup(right.groupBy("s", "b")).applyInPandas(cell, _FOUND)
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last())
    found = cells.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k + 1)
    mine = F.sum(F.col("mine").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    found = found.withColumn("own", mine).where(~(F.col("mine") & (F.col("own") == 1)))  # rows like the query's own are alike: one of them goes
    found = found.withColumn("rank", F.col("rank") - F.least(F.col("own"), F.lit(1)).cast("int")).where(F.col("rank") <= k)
    return found.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("query_id", "rank", "vec_id", F.col("score").cast("long").alias("score"))
