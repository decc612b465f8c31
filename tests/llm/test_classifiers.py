from __future__ import annotations

import math
import random
import re
import zlib

import numpy as np
import pytest

from plumbline.llm import cotraining as co
from plumbline.llm import toxicity as tox


def documents(n=400, seed=1):
    r = random.Random(seed)
    words = ["".join(r.choice("aeioulnrst") for _ in range(r.randint(2, 7))) for _ in range(3000)]
    for i in range(n):
        body = [r.choice(words) for _ in range(r.randint(8, 80))]
        bad, low = i % 4 == 0, i % 5 == 0
        if bad:
            body.insert(r.randrange(len(body)), r.choice(["scumbag", "dreadfully"]))
        if low:
            body = [w + "***" for w in body]
        text = "".join(w + (". " if k % 9 == 8 else " ") for k, w in enumerate(body))
        yield i, text, "en" if i % 3 else "de", f"src{i % 5}", len(text), int(not low), int(bad)


def frame(spark, rows):
    return spark.createDataFrame([r[:5] + ("extra",) for r in rows] + [(9001, None, None, None, None, None), (9002, "", "en", "s", 0, None)], "doc_id long, text string, lang string, source string, n_chars long, score string")


def test_toxicity_is_learnt_from_document_labels(spark):
    rows = list(documents())
    model = tox.train([r[1] for r in rows[:300]], [r[6] for r in rows[:300]], least_g=10)
    df = frame(spark, rows)
    got = {r.doc_id: r for r in tox.score(df, model).collect()}
    held = rows[300:]
    assert sum(got[r[0]].predicted == r[6] for r in held) >= 0.97 * len(held)
    assert got[9001].score == got[9002].score == 0 and got[9001].worst_sentence is None
    found = [r for r in tox.offending(df, model).collect() if r.doc_id in {x[0] for x in held if x[6]}]
    told = ["scumbag" in r.words or "dreadfully" in r.words for r in found]
    assert len({r.doc_id for r in found}) >= 0.95 * sum(r[6] for r in held) and sum(told) >= 0.9 * len(told)
    assert all(got[r.doc_id].worst_score >= r.score - 1e-12 for r in found)


def test_toxicity_fit_and_empty_labels(spark):
    rows = list(documents(200))
    df = frame(spark, rows)
    labels = spark.createDataFrame([(r[0], r[6]) for r in rows], "doc_id long, toxic int")
    assert tox.fit(df, labels).bias == tox.fit(df, labels).bias
    none = tox.fit(df, labels.limit(0))
    assert max(r.score for r in tox.score(df, none).collect()) < 1e-9
    assert tox.score(df.limit(0), none).count() == 0


def test_shared_and_repeated_sentences_are_evidence():
    r = random.Random(4)
    words = ["".join(r.choice("aeioulnrst") for _ in range(r.randint(2, 7))) for _ in range(3000)]
    text = lambda n: "".join(" ".join(r.choice(words) for _ in range(8)) + ". " for _ in range(n))
    clean, template = [text(6) for _ in range(200)], text(6)
    variants = [template + f"{text(1)} clean" for _ in range(40)]
    verbatim = [text(5) + "You dreadful scumbag." for _ in range(40)]  # one sentence in many different documents
    noted = [template + f"You dreadful scumbag. {text(1)}" for _ in range(40)]  # near copies that only that sentence tells apart
    varied = [template + " ".join(r.choice(words) for _ in range(4)) + f" scumbag {r.choice(words)}." for _ in range(40)]  # near copies, no two sentences alike
    for bad in (verbatim, noted, varied):
        model = tox.train(clean + variants + bad, [0] * 240 + [1] * 40)
        p = [tox.noisy_or(model.sentence_scores(t)) for t in (text(3) + "You scumbag.", template, text(6))]
        assert p[0] > 0.3 > max(p[1:]), p
    alone = tox.train(clean + varied, [0] * 200 + [1] * 40)  # the template's clean form is not labelled
    assert alone.word(b"scumbag") > 1 and not any(alone.word(w) for s in tox.sentences(template) for w in s)
    copied = tox.train(clean + [f"{template}{i}." for i in range(40)], [0] * 200 + [1] * 40)  # copies alone bear nothing out
    assert not copied.weights


def test_sentences_of_other_scripts():
    assert [b" ".join(x).decode() for x in tox.sentences("Eins zwei。三四！五 六？سبعة ثمانية؟ नौ। dix… onze")] == ["eins zwei", "三四", "五 六", "سبعة ثمانية", "नौ", "dix", "onze"]


def test_scores_against_brute_force(spark):
    """The noisy-or over all sentences of a text, word by word, and the worst sentence."""
    rows = list(documents(200))
    model = tox.train([r[1] for r in rows], [r[6] for r in rows], least_g=10)
    assert model.weights
    for r in tox.score(frame(spark, rows), model).collect():
        text = dict((x[0], x[1]) for x in rows).get(r.doc_id)
        parts = [p.split() for p in re.split(r"[.!?\n]+", (text or "").lower()) if p.split()]
        p = []
        for words in parts:
            names = {w.encode().strip(tox._EDGE) for w in words}
            z = model.bias + sum(model.weights.get(zlib.crc32(kind) >> 1, 0) for w in names if w for kind in [b"w" + w, *(b"p" + w[:k] for k in range(4, min(8, len(w)) + 1))])
            p.append(1 / (1 + math.exp(-z)))
        assert r.n_sentences == len(parts) and r.score == pytest.approx(1 - math.prod(1 - x for x in p), abs=1e-9) and r.predicted == (r.score >= 0.3)
        assert r.worst_sentence is None if not p else p[r.worst_sentence] == pytest.approx(max(p))


def test_gradient_against_finite_differences():
    """Descent ends where the penalised cross-entropy of the noisy-or is lowest."""
    rows = list(documents(300))
    texts, y = [r[1] for r in rows], np.array([r[6] for r in rows])
    model = tox.train(texts, list(y), least_g=10, steps=4000)

    def loss(bias, weights):
        m = tox.Model(bias, weights)
        p = np.clip([tox.noisy_or(m.sentence_scores(t)) for t in texts], 1e-6, 1 - 1e-9)
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).sum() + 0.005 * sum((w - tox._PRIOR) ** 2 for w in weights.values())

    here = loss(model.bias, model.weights)
    for f in list(model.weights)[:6]:
        for step in (-0.2, 0.2):
            assert loss(model.bias, model.weights | {f: model.weights[f] + step}) > here - 1e-3


def test_toxicity_edge_cases(spark):
    rows = list(documents(200))
    df = frame(spark, rows).unionByName(frame(spark, rows[:30])).withColumnsRenamed({"score": "turn", "lang": "own"})
    df = df.unionByName(spark.createDataFrame([(9003, "some words. " * 300_000, "en", "s", 5, None), (None, "x", "en", "s", 5, None)], df.schema)).unionByName(df.where("doc_id = 4"))
    labels = spark.createDataFrame([(r[0], r[6]) for r in rows] + [(0, 0), (9003, 0), (None, 1), (55, None)], "doc_id long, toxic int")
    model, alone = tox.fit(df, labels), tox.fit(df.dropDuplicates(["doc_id", "text"]), labels)
    assert model.bias == alone.bias and model.weights == alone.weights  # repeated rows tell nothing new
    got = tox.score(df, model).collect()
    assert len(got) == df.count() and len({(r.doc_id, r.score) for r in got}) == 204
    assert tox.fit(df, labels, most_bytes=10).weights == {} and tox.fit(df.limit(0), labels).weights == {}


def test_noisy_or():
    assert tox.noisy_or(np.array([0.5, 0.5])) == 0.75 and tox.noisy_or(np.array([])) == 0


def test_cotraining_keeps_clean_documents(spark):
    rows = list(documents(600))
    df = frame(spark, rows)
    labels = spark.createDataFrame([(r[0], r[5]) for r in rows if r[0] % 3], "doc_id long, quality int")
    model = co.fit(df, labels)
    got = {r.doc_id: r for r in co.score(df, model).collect()}
    held = [r for r in rows if r[0] % 3 == 0]
    assert all(got[r[0]].kept for r in held if r[5]) and sum(not got[r[0]].kept for r in held if not r[5]) >= 0.95 * sum(not r[5] for r in held)
    kept = co.keep(df, model)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {k for k, r in got.items() if r.kept}
    assert got[1].score == co.score(df, co.fit(df, labels)).where("doc_id = 1").first().score


def test_views_teach_each_other():
    r = np.random.default_rng(2)
    truth = r.integers(0, 2, 600)
    text, meta = truth[:, None] * 2.0 + r.normal(0, 0.5, (600, 3)), truth[:, None] * 2.0 + r.normal(0, 0.5, (600, 2))
    asked = []

    def confident(views):
        asked.append(views)
        p = [1 / (1 + np.exp(-v.logit(x[40:]))) for v, x in zip(views, (text, meta))]
        return tuple({i: (int(q[i] > 0.5), text[40 + i], meta[40 + i]) for i in range(560) if abs(q[i] - 0.5) > 0.45} for q in p)

    model = co.cotrain(text[:40], meta[:40], truth[:40], confident)
    p = model.scores(text, meta)
    assert ((p[:, 0] > 0.5) == truth).mean() > 0.97 and p.shape == (600, 3) and len(asked) == co.ROUNDS
    alone = co.cotrain(text[:40], meta[:40], truth[:40], lambda views: ({}, {}))
    assert any((v.w != w.w).any() for v, w in zip(model.views, alone.views))


def test_every_unlabelled_document_may_teach(spark):
    """Brute force over the whole pool: a view is taught documents that the other is sure of, from anywhere in the table."""
    rows = list(documents(500))
    df = frame(spark, rows)
    labels = spark.createDataFrame([(r[0], r[5]) for r in rows[:120]], "doc_id long, quality int")
    taught, cotrain = [], co.cotrain

    def spied(text, meta, y, confident, *more):
        def ask(views):
            found = confident(views)
            taught.append((views, found))
            return found

        return cotrain(text, meta, y, ask, *more)

    co.cotrain = spied
    try:
        co.fit(df, labels, rounds=2)
    finally:
        co.cotrain = cotrain
    texts = {co.text_view(r[1].encode()).tobytes() for r in rows[120:]} | {co.text_view(None).tobytes()}
    for views, found in taught:
        for k, own in enumerate(found):
            want = {}
            for r in rows[120:] + [(9001, None, None, None, None), (9002, "", "en", "s", 0)]:
                x = (co.text_view((r[1] or "").encode()), co.meta_view(*r[2:5]))
                p = 1 / (1 + np.exp(-float(views[k].logit(x[k][None])[0])))
                if p >= co.SURE or p <= 1 - co.SURE:
                    want[x[0].tobytes(), x[1].tobytes()] = int(p > 0.5)
            assert {(a.tobytes(), b.tobytes()): y for y, a, b in own.values()} == want
    assert len({x for _, found in taught for own in found for x in own}) > 200 and texts


def test_cotraining_edge_cases(spark):
    rows = list(documents(300))
    df = frame(spark, rows).unionByName(frame(spark, rows[:50])).withColumnsRenamed({"score": "y"})  # repeated rows, a clashing column
    df = df.unionByName(spark.createDataFrame([(9003, "long words " * 200_000, "en", "s", 5, None)], df.schema))
    labels = spark.createDataFrame([(r[0], r[5]) for r in rows[:200]] + [(0, 1), (1, 0), (None, 1), (77, None), (123456, 0)], "doc_id long, quality int")
    model = co.fit(df, labels)
    got = co.score(df, model).collect()
    assert len(got) == 355 and len({(r.doc_id, r.score) for r in got}) == 303
    assert co.keep(df, model).columns == df.columns and co.fit(df.limit(0), labels) is None and co.score(df.limit(0), model).count() == 0
    few = co.fit(df, labels.limit(6))
    assert few is None and {r.kept for r in co.score(df, few).collect()} == {True}


def test_cotraining_without_labels_or_columns(spark):
    df = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert co.fit(df, labels) is None
    assert [tuple(r) for r in co.score(df, None).collect()] == [(1, 1.0, 1.0, 1.0, True)]
