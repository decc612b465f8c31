from __future__ import annotations

import random
import re
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import graph, jaccard, mixing
from plumbline.llm.common import deltas, pack, undeltas, unpack


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(rows):
    sets = []
    for _, t in rows:
        w = words(t)
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    have = defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            have[g].append(i)
    common = Counter((a, b) for own in have.values() for k, a in enumerate(own) for b in own[k + 1 :])
    for (a, b), n in common.items():
        if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    least = defaultdict(list)
    for i, (doc, _) in enumerate(rows):
        least[root(i)].append(doc)
    return sorted(((doc, len(sets[i]), min((d for d in least[root(i)] if d is not None), default=None)) for i, (doc, _) in enumerate(rows)), key=repr)


def near_copies(n=500, seed=3):
    r = random.Random(seed)
    vocabulary = [f"W{i}" for i in range(60)]
    bases = [[r.choice(vocabulary) for _ in range(r.randint(3, 120))] for _ in range(10)]
    rows = []
    for i in range(n):
        base = r.choice(bases)
        rows.append((i * 3, " ".join([r.choice(vocabulary) if r.random() < 0.02 else w for w in base][: len(base) - r.randint(0, 6)])))
    return rows + [(7, None), (8, ""), (10, " \n"), (None, rows[0][1]), (13, rows[0][1].upper()), (13, rows[1][1]), (16, "a b c"), (19, "A\tb  c")]


@pytest.mark.parametrize("sizes", [{}, {"cell_tokens": 2_000, "chunk_bytes": 5_000}, {"cell_tokens": 1_000, "parts": 3}, {"hot_sets": 2, "chunk_bytes": 4_000}, {"hot_sets": 1}])
def test_join_against_brute_force(spark, sizes):
    rows = near_copies()
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n long").repartition(3)
    assert sorted((tuple(r) for r in jaccard.join(df, **sizes).select("doc_id", "n_shingles", "component_id").collect()), key=repr) == brute(rows)


def test_representatives_and_nothing(spark):
    rows = near_copies(60)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted((d for d, _, c in brute(rows) if d == c), key=repr)
    assert sorted((r.doc_id for r in jaccard.representatives(df).collect()), key=repr) == want
    assert jaccard.join(df.limit(0)).count() == 0
    assert jaccard.join(df.where("doc_id in (7, 8)")).count() == 2


def test_of_rows_that_share_an_id_or_have_none_one_stays(spark):
    r = random.Random(8)
    a, b, c, d = (" ".join(r.choice("abcdefghij") * r.randint(1, 9) for _ in range(40)) for _ in range(4))
    rows = [(1, a, "x"), (1, a, "y"), (1, a + " z", "x"), (2, a, "x"), (1, b, "x"), (2, c, "x"), (3, b, "x"), (3, c, "x")]  # 1 and 2 stand first in two components, 3 in none
    rows += [(None, d, "x"), (None, d, "y"), (None, d + " z", "x"), (4, None, "x"), (4, None, "x"), (4, "", "x"), (5, None, "x"), (None, "", "x"), (None, "", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n string").repartition(3)
    want = [(1, a, "x"), (1, b, "x"), (2, c, "x"), (None, d, "x"), (4, None, "x"), (4, "", "x"), (5, None, "x"), (None, "", "x")]
    got = jaccard.representatives(df)
    assert got.columns == df.columns and sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    named = df.where("doc_id > 3")
    assert sorted(map(tuple, jaccard.representatives(named).collect()), key=repr) == sorted((w for w in want if w[0] and w[0] > 3), key=repr)


def in_order(sets):
    """Sets in their global order, rare ones first, and their counts."""
    tokens, df = np.unique(np.concatenate(sets), return_counts=True)
    df = dict(zip(tokens.tolist(), df.tolist()))
    sets = [np.array(sorted(s.tolist(), key=lambda t: (df[t], t)), np.uint64) for s in sets]
    return sets, [np.array([df[t] for t in s.tolist()], np.uint32) for s in sets]


@pytest.mark.parametrize("few", [64, 2])
def test_groups_of_many_sets_are_searched_by_postings(few, monkeypatch):
    monkeypatch.setattr(jaccard, "_FEW", few)
    r = np.random.default_rng(4)
    bases = [r.integers(0, 2**62, 50).astype(np.uint64) for _ in range(9)]
    sets = [np.unique(np.concatenate([bases[i % 9][r.random(50) < 0.93], bases[(i + 1) % 9][:2]])) for i in range(150)]
    n = np.array([len(s) for s in sets])
    links = jaccard.cell_links(np.arange(150), n, *in_order(sets), np.arange(150))
    alike = lambda a, b: 9 * len(np.intersect1d(sets[a], sets[b])) >= 4 * (n[a] + n[b])
    assert all(alike(a, b) for a, b in links)
    mine, all_ = (graph.union_find(*np.array(e).T) for e in (links, [(a, b) for a in range(150) for b in range(a) if alike(a, b)]))
    assert mine[0].tolist() == all_[0].tolist() and mine[1].tolist() == all_[1].tolist()


def test_a_long_chain_of_sets_that_share_little(spark):
    """Each text has one passage of the text before it and one of the next: a component of 10^5 sets, few of them alike."""
    n = 100_000
    df = spark.range(n).select(F.col("id").alias("doc_id"), F.concat_ws(" ", *(F.concat((F.col("id") + j).cast("string"), F.lit(f"w{k}")) for j in (0, 1) for k in range(26))).alias("text"))
    more = spark.createDataFrame([(n + 5, " ".join(f"{i}w{k}" for i in (500, 501) for k in range(26))[:-4])], "doc_id long, text string")
    out = jaccard.join(df.unionByName(more), cell_tokens=400_000)
    assert out.count() == n + 1
    assert [tuple(r) for r in out.where("doc_id <> component_id").collect()] == [(n + 5, 48, 500)]


def test_ids_are_integers(spark):
    with pytest.raises(TypeError, match="integers"):
        jaccard.join(spark.createDataFrame([("a", "b")], "doc_id string, text string"))
    out = jaccard.join(spark.createDataFrame([(2, "a b"), (1, "A b")], "doc_id int, text string"))
    assert out.schema["component_id"].dataType.simpleString() == "int" and {r.component_id for r in out.collect()} == {1}


def test_trie_finds_every_connection():
    r = np.random.default_rng(1)
    base = r.integers(0, 2**62, 80).astype(np.uint64)
    sets = [np.unique(np.where(r.random(80) < 0.06, r.integers(0, 2**62, 80).astype(np.uint64), base)) for _ in range(60)]
    n = np.array([len(s) for s in sets])
    links = jaccard.cell_links(np.arange(60), n, *in_order(sets), np.arange(60))
    alike = lambda a, b: 9 * len(np.intersect1d(sets[a], sets[b])) >= 4 * (n[a] + n[b])
    assert all(alike(a, b) for a, b in links)
    mine, all_ = (graph.union_find(*np.array(e).T) for e in (links, [(a, b) for a in range(60) for b in range(a) if alike(a, b)]))
    assert mine[0].tolist() == all_[0].tolist() and mine[1].tolist() == all_[1].tolist()


@pytest.mark.parametrize("local", [1_000_000, 0])
def test_components(spark, local):
    r = random.Random(5)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(500, 560)]
    nodes, labels = graph.union_find(*np.array([e for e in edges if e[0] != e[1]]).T)
    got = {tuple(x) for x in graph.components(spark.createDataFrame(edges, "a long, b long"), local_edges=local).collect()}
    assert got == set(zip(nodes.tolist(), labels.tolist()))


def test_packing():
    a, b = np.array([3, 9, 9, 2**63], np.uint64), np.array([], np.uint32)
    x, y = unpack(pack(deltas(a), b))
    assert undeltas(x).tolist() == a.tolist() and y.dtype == np.uint32 and not len(y)


# -- mixing -------------------------------------------------------------------------------------------------


def waterfill(sizes: dict, limit: int = 3) -> dict:
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    total, target, open_ = sum(sizes.values()), {}, set(order)
    while open_:
        rest = total - sum(target.values())
        level = rest / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level > limit * sizes[s]}
        if not full:
            return target | {s: weight[s] * level for s in open_}
        target |= {s: float(limit * sizes[s]) for s in full}
        open_ -= full
    return target


def corpus(n=600, seed=2):
    r = random.Random(seed)
    share = {"a": 30, "b": 2, "ç": 20, None: 5, "z": 10, "tiny": 1}
    return [(i, r.choices(list(share), list(share.values()))[0], " ".join("w" * r.randint(1, 5) for _ in range(r.randint(0, 60)))) for i in range(n)] + [(5000, "none", None), (5001, "none", "")]


def test_targets_and_taken_words(spark):
    rows = corpus()
    df = spark.createDataFrame([(a, c, b, "x") for a, b, c in rows], "doc_id long, text string, source string, target string")
    got = mixing.taken_words(mixing.mix(df, block_words=500, shards=8)).collect()
    size = {d: len(words(t)) for d, _, t in rows}
    sizes, by = Counter(), {d: s for d, s, _ in rows}
    for d, s, _ in rows:
        sizes[s] += size[d]
    want = waterfill(sizes)
    taken = Counter()
    assert sorted(r.doc_id for r in got) == sorted(size)
    for r in got:
        assert r["size"] == size[r.doc_id] and r.source_size == sizes[by[r.doc_id]] and r.target == pytest.approx(want[by[r.doc_id]]) and r.taken <= 3 * r["size"]
        taken[by[r.doc_id]] += r.taken
    assert all(abs(taken[s] - want[s]) <= 15 for s in want)
    again = mixing.taken_words(mixing.mix(df.repartition(5), block_words=500, shards=8)).collect()
    assert {(r.doc_id, r.taken) for r in got} == {(r.doc_id, r.taken) for r in again}


def test_splitting_tree():
    counts = np.array([1000, 37, 0, 5])
    quotas = mixing.split_quotas(counts, 16, 1)
    assert (quotas.sum(0) == counts).all() and (quotas >= 0).all() and quotas.sum(1).max() - quotas.sum(1).min() <= 1
    assert (quotas == mixing.split_quotas(counts, 16, 1)).all() and (quotas != mixing.split_quotas(counts, 16, 2)).any()


def test_the_tree_decides_what_is_taken(spark, monkeypatch):
    """Other draws of the tree take other documents; targets are met all the same, and shards' quotas are the tree's."""
    rows = corpus(3000)
    df = spark.createDataFrame([(a, c, b) for a, b, c in rows], "doc_id long, text string, source string")
    found, split, quotas = [], mixing.split_quotas, []
    draws = [split, lambda counts, shards, seed: split(counts, shards, seed + 77), lambda counts, shards, seed: np.vstack([counts, np.zeros((shards - 1, len(counts)), np.int64)])]
    for draw in draws:
        monkeypatch.setattr(mixing, "split_quotas", lambda *a, draw=draw: quotas.append(draw(*a)) or quotas[-1])
        mixed = mixing.mix(df, block_words=300, shards=8)
        found.append((Counter(), {r.doc_id: r.taken for r in mixing.taken_words(mixed).collect()}))
        sources = dict((d, s) for d, s, _ in rows)
        for d, n in found[-1][1].items():
            found[-1][0][sources[d]] += n
        whole = mixed.where("copy is not null").select("source", "block", "copy", "shard").distinct().groupBy("source", "shard").count().collect()
        order = sorted(set(sources.values()), key=lambda s: (s is None, s))
        for r in whole:  # a source's last pass is settled at its end, so a shard's blocks differ from the quota by those only
            s = order.index(r["source"])
            assert r["count"] <= quotas[-1][r["shard"], 3 * s : 3 * s + 3].sum()
    assert len({tuple(sorted(t.items())) for _, t in found}) == 3
    sizes = Counter()
    for d, s, t in rows:
        sizes[s] += len(words(t))
    want = waterfill(sizes)
    assert all(abs(taken[s] - want[s]) <= 15 for taken, _ in found for s in want)


@pytest.mark.parametrize("seed", range(40))
def test_a_plan_meets_targets_by_quotas(seed):
    """Brute force over random sources: whole passes are whole, shards draw disjoint blocks, the rest is met but for one block."""
    r = np.random.default_rng(seed)
    blocks = [r.integers(0, 50, r.integers(1, 30)) for _ in range(4)]
    goal = [(int(b.sum()), float(min(3.0, r.random() * 3.2) * b.sum())) for b in blocks]
    p = mixing.plan(goal, blocks, 8, 3, seed)
    assert not p.duplicated(["s", "block", "copy"]).any() and ((p["shard"] >= 0) & (p["shard"] < 8)).all()
    for s, ((size, target), words_) in enumerate(zip(goal, blocks)):
        own = p[p["s"] == s]
        full = min(3, int(target // size)) if size else 0
        assert sorted(own[own["copy"] <= full]["block"]) == sorted(list(range(len(words_))) * full)
        last = own[own["copy"] > full]
        cut = last[last["room"].notna()]
        have = words_[last[last["room"].isna()]["block"]].sum() + cut["room"].sum()
        assert len(cut) <= 1 and (own["copy"] <= full + 1).all() and (not size or have == pytest.approx(target - full * size if full < 3 else 0))


def test_shards_are_disjoint_draws(spark):
    df = spark.createDataFrame([(a, c, b) for a, b, c in corpus()], "doc_id long, text string, source string")
    mixed = mixing.mix(df, block_words=300, shards=6).where("copy is not null")
    assert mixed.count() == mixed.select("doc_id", "source", "copy").distinct().count() and mixed.where("shard is null").count() == 0
    whole = mixing.mixed_documents(df, block_words=300, shards=6)
    assert whole.columns == df.columns and whole.count() == mixed.count()


def test_documents_are_taken_as_often_as_their_words(spark):
    """Rows that share ids, sources of another type, and columns that clash with the operator's own."""
    r = random.Random(3)
    rows = [(r.choice([i, i % 7, None]), " ".join("w" * r.randint(1, 5) for _ in range(r.randint(0, 30))), r.choice([1, 1, 1, 2, None]), i, float(i)) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source int, block int, `i` double").repartition(5).cache()
    taken, got = Counter(), Counter()
    for x in mixing.mix(df, block_words=200, shards=5).where("copy is not null").collect():
        taken[x.doc_id, x.source, x["size"]] += 1
    whole = mixing.mixed_documents(df, block_words=200, shards=5)
    for x in whole.collect():
        got[x.doc_id, x.source, len(words(x.text))] += 1
    assert whole.columns == df.columns and got == taken and sum(got.values())
    per = mixing.taken_words(mixing.mix(df, block_words=200, shards=5)).collect()
    assert len(per) == 400 and all(x.taken <= 3 * x["size"] for x in per)
    assert max(Counter((x.block, x["i"]) for x in whole.collect()).values()) <= 3


def test_repeated_rows_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "a b c", "s"), (1, "a b c", "s"), (2, "d e", "t"), (None, "x", None)], "doc_id long, text string, source string")
    assert mixing.taken_words(mixing.mix(df)).count() == 4
    assert mixing.mixed_documents(df).count() == mixing.mix(df).where("copy is not null").count()
    assert mixing.taken_words(mixing.mix(df.limit(0))).count() == 0 and mixing.mixed_documents(df.limit(0)).count() == 0
    zero = spark.createDataFrame([(1, None, "s")], "doc_id long, text string, source string")
    assert [(r.target, r.taken) for r in mixing.taken_words(mixing.mix(zero)).collect()] == [(0.0, 0)]
