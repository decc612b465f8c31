from __future__ import annotations

import math
import random
from collections import Counter

import duckdb
import numpy as np
import pytest

from plumbline.llm import entries, search


def brute(rows, k):
    """Every row is a candidate of every other row, whatever their ids."""
    vs = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = Counter()
    for n, (q, a) in enumerate(vs):
        scored = sorted((-sum(x * y for x, y in zip(a, v)), i is None, i or 0) for m, (i, v) in enumerate(vs) if m != n)[:k]
        out.update((q, r + 1, None if null else i, -s) for r, (s, null, i) in enumerate(scored))
    return out


def check(spark, rows, k=3, **sizes):
    v = search.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    assert Counter(tuple(r) for r in search.top_k(v, v, k, **sizes).collect()) == brute([r[:2] for r in rows], k)


def test_against_brute_force_over_a_grid(spark):
    r = random.Random(1)
    rows = [(i, [r.gauss(0, 0.2) for _ in range(12)], 0) for i in range(300)]
    check(spark, rows, shard_rows=70, query_rows=90)


def test_ties_signs_zeros_and_bad_vectors(spark):
    r = random.Random(2)
    rows = [(i, [r.choice([-0.5, 0.0, 0.25]) for _ in range(3)], 0) for i in range(120)]
    rows += [(500, None, 0), (501, [1.0, None, 0.0], 0), (502, [float("nan"), 0.0, 0.0], 0), (503, [float("inf"), 0.0, 0.0], 0), (504, [], 0), (505, [0.5], 0), (0, [9.0, 9.0, 9.0], 0), (506, [-1.0, -1.0, -1.0], 1)]
    check(spark, rows, shard_rows=40)
    check(spark, rows[:2], k=5)


def test_components_beyond_the_limit_are_not_held(spark):
    r = random.Random(3)
    rows = [(i, [r.gauss(0, 1) for _ in range(4)], 0) for i in range(60)]
    rows += [(100, [6e5, 0.0, 0.0, 1.0], 0), (101, [7e5, 0.5, 0.0, 0.0], 0), (102, [-9e5, 0.0, 2.0], 0), (103, [3e6, -3e6, 3e6, 3e6], 0), (104, [5e5, 1.0, 1.0, 1.0], 0)]
    check(spark, rows, shard_rows=20, query_rows=30)


def test_repeated_and_missing_ids_are_rows_of_their_own(spark):
    r = random.Random(5)
    vectors = [[r.choice([-0.5, 0.25, 1.0]) for _ in range(4)] for _ in range(25)]
    rows = [(r.choice([0, 0, 1, 2, 3, None]), r.choice(vectors), 0) for _ in range(150)] + [(7, [3e6, 1.0, 0.0, 0.0], 0)] * 3 + [(7, [2e6, 1.0, 0.0, 0.0], 0)]
    check(spark, rows, shard_rows=40, query_rows=20)
    check(spark, [(1, [1.0], 0)] * 4, k=5)


@pytest.mark.parametrize("kind", [np.int64, object])
def test_a_threshold_rises_and_lists_become_non_essential(kind):
    r = np.random.default_rng(6)
    x = (r.normal(0, 30, (3000, 24)) * (r.random((3000, 24)) < 0.3) * (r.random(24) ** 4)).astype(int).astype(kind)
    shard, essential = search.Shard(x, first=64, grows=4), []
    settled = search.Shard._settled
    search.Shard._settled = lambda self, q, partial, order, rest, n, *more: essential.append(n) or settled(self, q, partial, order, rest, n, *more)
    try:
        for q, (at, score) in zip(x[:90], shard.best(x[:90], 4), strict=True):
            want = sorted(range(len(x)), key=lambda i: (-int(sum(q * x[i])), i))[:4]
            assert list(at) == want and [int(s) for s in score] == [int(sum(q * x[i])) for i in want]
    finally:
        search.Shard._settled = settled
    first, last = essential[:64], essential[-26:]
    assert all(n == 24 for n in first) and np.mean(last) < 10  # the threshold has risen


def test_sql_and_query_agree_on_repeated_ids_and_large_components(spark, tmp_path):
    r = random.Random(8)
    rows = [(r.randrange(0, 200), [r.gauss(0, 1) for _ in range(6)]) for _ in range(300)] + [(50, [3e6, 1.0]), (51, [2e6, 1.0, 2.0]), (50, [3e6, 1.0]), (None, [1.0] * 6)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    c = duckdb.connect()
    c.execute(f"create view embeddings as select * from read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    want = Counter(c.execute(f"select query_id, rank, vec_id, score from ({entries.OP2_SQL})").fetchall())
    assert Counter(tuple(x) for x in entries.op2_maxscore(spark, str(tmp_path)).collect()) == want
    assert (50, 2, 51, 393216000000065536) in want


def test_nothing(spark):
    v = search.quantised(spark.createDataFrame([], "vec_id long, embedding array<double>"))
    assert search.top_k(v, v).count() == 0
