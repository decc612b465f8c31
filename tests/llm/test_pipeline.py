"""Every stage of the pipeline against brute force, on documents with planted copies, junk and repeats."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")

from test_bpe import library
from test_corpus import brute as components
from test_corpus import waterfill, words
from test_repetition import brute as measures

import corpus_pipeline
from plumbline.llm import cotraining, repetition
from plumbline.llm.common import written

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, block string"


def corpus(seed=1):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("aeioulnrst") for _ in range(r.randint(2, 7))) for _ in range(2000)]
    prose = lambda n: " ".join(r.choice(vocabulary) + (".\n" if k % 11 == 10 else "") for k in range(n))
    texts = [prose(r.randint(40, 160)) for _ in range(220)]
    texts += [t.replace(t.split()[5], "changed", 1) for t in texts[:30]] + texts[30:45] + [" ".join(w + "###" for w in prose(80).split()) for _ in range(60)]
    texts += [(prose(60) + "\n") * 3 for _ in range(10)] + [None, "", "  \n "]
    rows = [(i, t, r.choice(["en", "de"]), r.choice(["web", "web", "web", "books", "code"]), len(t or ""), f"b{i}") for i, t in enumerate(texts)]
    rows += [rows[3], (3, texts[7], "en", "books", 5, "z"), (None, texts[9], "de", None, None, None)]
    labels = [(i, int("###" not in (t or "")), 0) for i, t in enumerate(texts) if i % 2]
    return rows, labels


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    rows, labels = corpus()
    sf = str(tmp_path_factory.mktemp("sf"))
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    docs.write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    tables = [[tuple(x) for x in spark.read.parquet(f"{sf}/documents.parquet").collect()]]
    now = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        now = written(stage(spark, now, sf), f"test-{name}")
        if name != "bpe_encoding":
            assert now.columns == docs.columns
        tables.append([tuple(x) for x in now.collect()])
    return sf, tables


def test_the_classifier_rejects_what_its_model_scores_low(spark, stages):
    sf, (before, after, *_) = stages
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = cotraining.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    keep = []
    for row in before:
        x, m = cotraining.text_view(None if row[1] is None else row[1].encode()), cotraining.meta_view(*row[2:5])
        z = [v.logit(f[None])[0] * a[0] + b for v, f, (a, b) in zip(model.views, (x, m), model.platts)]
        if 1 / (1 + np.exp(-(np.dot(z, model.combined[0]) + model.combined[1]))) >= 0.5:
            keep.append(row)
    assert Counter(keep) == Counter(after) and not any("###" in (r[1] or "") for r in after)
    assert sum(r[1] is not None and "###" not in r[1] and len(r[1].split()) > 50 for r in before) == sum(r[1] is not None and len(r[1].split()) > 50 for r in after)


def test_the_rules_reject_what_repeats(stages):
    _, (_, before, after, *_) = stages
    limits, keep = repetition.Limits(), []
    for row in before:
        m = measures(row[1], limits.min_repeat)
        n = m["n_words"]
        long = m["longest_repeat"] > limits.max_longest and (100 * m["longest_repeat"] > limits.max_longest_percent * n or m["longest_repeat"] > limits.max_longest_anywhere)
        if n >= limits.min_words and 100 * m["n_repeat_words"] <= limits.max_repeat_percent * n and 100 * m["covered_words"] <= limits.max_covered_percent * n and not long:
            keep.append(row)
    assert Counter(keep) == Counter(after) and 0 < len(after) < len(before)


def test_of_near_duplicates_one_stays(stages):
    _, (_, _, before, after, *_) = stages
    least = {(d, n): c for d, n, c in components([(r[0], r[1]) for r in before])}
    found = components([(i, r[1]) for i, r in enumerate(before)])
    groups: dict[int, list] = {}
    for i, _, c in found:
        groups.setdefault(c, []).append(before[i])
    named = {d for d in (min((r[0] for r in g if r[0] is not None), default=None) for g in groups.values())}
    assert least and {r[0] for r in after} == named
    texts = Counter(next(c for i, _, c in found if before[i][1] == r[1]) for r in after)
    assert max(texts.values()) == 1 and len(after) == len(groups) < len(before)


def test_sources_meet_their_targets(stages):
    _, (_, _, _, before, after, _) = stages
    size = Counter()
    for r in before:
        size[r[3]] += len(words(r[1]))
    want, got = waterfill(size), Counter()
    for r in after:
        got[r[3]] += len(words(r[1]))
    assert max(Counter(after).values()) <= 3 and set(after) <= set(before)
    assert all(abs(got[s] - want[s]) <= 60 for s in want), (got, want)


def test_rows_of_the_mix_are_encoded_whole(stages):
    *_, before, after = stages[1]
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = Counter((r[0], len(ids := library(r[1])), sha(",".join(map(str, ids))), sha(r[1])) for r in before)
    assert Counter(after) == want


def test_run_and_edge_tables(spark, stages, tmp_path):
    sf, tables = stages
    out = corpus_pipeline.run(spark, sf)
    assert out.count() == len(tables[-1])
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    long = [(1, " ".join(f"w{i}" for i in range(120_000)), None, None, None, None), (2, None, None, None, None, None)]
    spark.createDataFrame(long, SCHEMA).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    assert [r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()] == [1]
