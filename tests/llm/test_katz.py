from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import katz


def tokens(t):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + ["\0end"]


def discounts(c):
    n = Counter(v for v in c.values() if v <= 6)
    for k in range(5, 0, -1):
        if any(not n[r] for r in range(1, k + 2)):
            continue
        common = (k + 1) * n[k + 1] / n[1]
        if common < 1:
            d = [0] + [((r + 1) * n[r + 1] / n[r] / r - common) / (1 - common) for r in range(1, k + 1)]
            if all(0 < x < 1 for x in d[1:]):
                return d
    return [0]


def brute(rows):
    learnt = [tokens(t) for _, t, train in rows if train]
    grams = [Counter(), Counter(), Counter()]  # tuples of one, two and three words
    follow = [defaultdict(Counter), defaultdict(Counter)]
    for x in learnt:
        y = ["\0begin", "\0begin", *x]
        for i in range(2, len(y)):
            for k in range(3):
                grams[k][tuple(y[i - k : i + 1])] += 1
            follow[0][y[i - 1 : i][0],][y[i]] += 1
            follow[1][y[i - 2], y[i - 1]][y[i]] += 1
    one, d = grams[0], [discounts(g) for g in grams]
    n = sum(one.values())
    kept = lambda c, d: (d[c] if c < len(d) else 1) * c
    left1 = sum(c - kept(c, d[0]) for c in one.values())

    def p(h, w):
        """P(w | h), recursively; h: a tuple of up to two words."""
        if not h:
            return (kept(one[w,], d[0]) if one[w,] else left1 or 1) / (n + (left1 <= 0)) if n else 1.0
        f = follow[len(h) - 1].get(h)
        if not f:
            return p(h[1:], w)
        left = sum(c - kept(c, d[len(h)]) for c in f.values())
        whole = sum(f.values()) + (left <= 0)
        return kept(f[w], d[len(h)]) / whole if f[w] else (left or 1) / whole / (1 - sum(p(h[1:], v) for v in f)) * p(h[1:], w)

    out = []
    for doc, t, train in rows:
        x = tokens(t)
        y = ["\0begin", "\0begin", *x]
        logs = sum(math.log10(p((y[i], y[i + 1]), y[i + 2])) for i in range(len(x)))
        out.append((doc, not train, len(x), sum(one[w,] > 0 for w in x), n, sum(math.log10((one[w,] + 1) / (n + len(one) + 1)) for w in x), logs))
    return out, (one, follow, p)


def sample(n=120):
    r = random.Random(4)
    words = [f"W{i}" for i in range(80)]
    rows = [(i, " ".join(r.choices(words, [1 / (k + 1) for k in range(80)], k=r.randint(0, 40))), i % 7 != 2) for i in range(n)]
    return rows + [(1000, None, True), (1001, "", False), (1002, "never seen words", False), (3, "w1 W1\tw1", True), (None, "w2", True)]


def same(got, rows):
    order = lambda r: (repr(r[0]), r[2], r[5])
    got, want = sorted(map(tuple, got), key=order), sorted(brute(rows)[0], key=order)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want):
        assert g[5:] == pytest.approx(w[5:])


@pytest.mark.parametrize("size, ranges", [(16 << 20, 32 << 20), (300, 500)])
def test_against_brute_force(spark, size, ranges):
    rows = sample()
    df = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, train boolean, score double").repartition(3)
    same(katz.score(df, F.col("train"), chunk_bytes=size, range_bytes=ranges).collect(), rows)


def test_long_counts_and_text_ids(spark):
    """Pairs and triples seen over five times, histories whose types are all so, and ids that are no numbers."""
    rows = sample(40) + [(5000 + i, "a b c d a b c e", i % 7 != 2) for i in range(30)] + [(6000, "a b d c", False), (6001, "c d e b", True)]
    rows = [(f"id {r[0]}", *r[1:]) for r in rows]
    same(katz.score(spark.createDataFrame(rows, "doc_id string, text string, train boolean"), F.col("train"), chunk_bytes=900).collect(), rows)


@pytest.mark.parametrize("hot", ["the", "the of"])
def test_hot_histories_are_dealt_out_and_add_up(spark, hot):
    rows = [(i, f"{hot} " + f" {hot} ".join(f"x{(i * 7 + k) % 50}" for k in range(70)), i % 7 != 2) for i in range(60)]
    rows += [(100 + i, f"y{i} {hot} x{i} {hot} never", i % 2 > 0) for i in range(8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, train boolean")
    same(katz.score(df, F.col("train"), chunk_bytes=2000, range_bytes=3000).collect(), rows)


@pytest.mark.parametrize("hot", [False, True])
def test_a_stored_model_scores_other_documents(spark, hot):
    rows = [(i, "the " + " the ".join(f"x{(i * 7 + k) % 50}" for k in range(70)), True) for i in range(60)] if hot else sample()
    new = [(i, t, False) for i, t in enumerate(["w1 w2 w3", "w1 unheard w2", "", None, "the x1 the x2 x3", "w0 w0 w1 w0 w0 w1"])]
    learnt, asked = (spark.createDataFrame([r[:2] for r in x], "doc_id long, text string") for x in ([r for r in rows if r[2]], new))
    model = katz.fit(learnt, chunk_bytes=2000, range_bytes=3000 if hot else 32 << 20)
    found = katz.apply(asked, model).collect()
    want = {w[0]: w for w in brute([*rows, *((1000 + i, t, train) for i, t, train in new)])[0]}
    assert {r.doc_id: (r.n_tokens, r.n_known) for r in found} == {i: want[1000 + i][2:4] for i, *_ in new}
    assert all(r.score == pytest.approx(want[1000 + r.doc_id][6]) for r in found)


def test_probabilities_of_a_history_add_up_to_one():
    rows = sample()
    _, (one, follow, p) = brute(rows)
    for h in [*list(follow[0])[:10], *list(follow[1])[:10]]:
        assert sum(p(h, w) for w, in one) + p(h, "\0unknown") == pytest.approx(1)


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "a b", False)], "doc_id long, text string, train boolean")
    assert katz.score(df, F.col("train")).first().score == 0
    assert katz.score(df.limit(0), F.col("train")).count() == 0


def test_discounts_fall_back():
    assert katz.Discounts.of(np.array([0, 10, 0, 0, 0, 0, 0])).d == ()
    d = katz.Discounts.of(np.array([0, 1000, 300, 120, 60, 35, 20]))
    assert len(d.d) == 5 and all(0 < x < 1 for x in d.d)
