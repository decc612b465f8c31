from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np

from plumbline.llm import repetition as rep

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text: str | None, least: int = 6) -> dict:
    w = WORDS.findall(text or "")
    n = len(w)

    def covered(k):
        seen = Counter(tuple(w[i : i + k]) for i in range(n - k + 1))
        hit = [False] * n
        for i in range(n - k + 1):
            if seen[tuple(w[i : i + k])] > 1:
                hit[i : i + k] = [True] * k
        return sum(hit)

    longest = next((k for k in range(n - 1, 0, -1) if max(Counter(tuple(w[i : i + k]) for i in range(n - k + 1)).values()) > 1), 0)
    lines = [x for x in (text or "").split("\n") if WORDS.search(x)]
    return {"n_words": n, "word_chars": sum(map(len, w)), "n_symbols": sum(c in "#*$%&|<>" for c in text or ""), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": covered(3), "covered_words": covered(least), "longest_repeat": longest}


def sample(n=60):
    r = random.Random(3)
    for _ in range(n):
        words = [r.choice(["a", "bé", "c#", "漢字", "x\xa0y", "ddd"]) for _ in range(r.randint(0, 90))]
        yield "".join(x + r.choice([" ", "\n", "\t", "  ", " \x0b"]) for x in words)


def test_measures_against_brute_force():
    texts = [None, "", " \n ", "one", *sample(), "same line\nsame line\n same line"]
    m = rep.measure([None if t is None else t.encode() for t in texts])
    for i, t in enumerate(texts):
        assert {k: int(m[k][i]) for k in rep._MEASURES} == brute(t), t


def test_suffix_array():
    r = np.random.default_rng(1)
    for n in (1, 2, 50, 400):
        ids = r.integers(0, 3, n)
        sa, lcp = rep.suffix_array(ids)
        order = sorted(range(n), key=lambda i: ids[i:].tolist())
        assert sa.tolist() == order
        for k in range(1, n):
            a, b = ids[order[k - 1] :].tolist(), ids[order[k] :].tolist()
            assert lcp[k] == next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def test_limits_and_rows(spark):
    r = random.Random(5)
    clean = " ".join(f"w{r.randrange(10**6)}" for _ in range(300))
    passage = " ".join(f"p{i}" for i in range(120))
    texts = {1: clean, 2: f"{clean} {passage} {clean.upper()} {passage}", 3: f"{passage} q {passage}", 4: "short text", 5: None, 6: "go " * 200}
    df = spark.createDataFrame([(k, v, "x") for k, v in texts.items()], "doc_id long, text string, kept string")
    got = {x.doc_id: (x.base_failed, x.kept) for x in rep.judge(df).collect()}
    assert got == {1: (False, True), 2: (False, True), 3: (True, False), 4: (True, False), 5: (True, False), 6: (True, False)}
    kept = rep.keep(df)
    assert kept.columns == df.columns and {x.doc_id for x in kept.collect()} == {1, 2}
    assert rep.judge(df.limit(0)).count() == 0
    failed, ok = rep.verdicts({"n_words": np.array([200]), "n_repeat_words": np.array([90]), "covered_words": np.array([90]), "longest_repeat": np.array([45])}, rep.Limits())
    assert not failed[0] and not ok[0]


def test_a_separate_repeat_that_only_the_longest_limit_rejects():
    limits = rep.Limits()
    for passage, n, kept in ((70, 400, False), (500, 5000, False), (60, 420, True), (390, 5000, True), (40, 250, True)):
        rest = [f"w{i}" for i in range(n - 2 * passage)]
        twice = [f"p{i}" for i in range(passage)]
        text = " ".join(twice + rest[: len(rest) // 2] + twice + rest[len(rest) // 2 :]).encode()
        m = rep.measured([text], limits)
        assert m["n_words"][0] == n and m["longest_repeat"][0] == passage and m["covered_words"][0] == 2 * passage
        assert not m["base_failed"][0] and 100 * m["covered_words"][0] <= limits.max_covered_percent * n
        assert m["kept"][0] == kept, (passage, n)
