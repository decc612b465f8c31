from __future__ import annotations

import functools
import hashlib
import random

import pytest

tokenizers_files = pytest.importorskip("public_tokenizers")

from plumbline.llm import bpe

PATH = tokenizers_files.path("byte_bpe_50k.json")
PARTS = ["ab", "the", "é", "漢字", "😀", "'s", "!!", "123", " ", "\n\n", "  ", "<|endoftext|>", "　", "a", "aaaa", "ing", "ñ", "\t", "\x1c", " \n", "\xa0"]


@functools.cache
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def library(text: str) -> list[int]:
    return tokenizer().encode(text, add_special_tokens=False).ids


def texts(n: int, long: int = 300):
    r = random.Random(7)
    for _ in range(n):
        some = r.sample(PARTS, r.choice([2, 5, len(PARTS)]))
        x = "".join(r.choice(some) for _ in range(r.randint(0, long)))
        yield x.replace(" ", "").replace("\n", "") if r.random() < 0.3 else x


def test_pieces_concatenate_to_the_whole():
    for x in texts(150):
        for most in (7, 16, 50):
            got = bpe.concatenate([(bpe.encode_piece(parts, patterned, PATH), inner) for parts, patterned, inner in bpe.pieces(x, PATH, most)], PATH)
            assert got == library(x), (most, x)


def test_a_long_unsplit_run_is_halved_and_joined():
    x = "aé" * 3000
    cut = bpe.pieces(x, PATH, 500)
    assert sum(inner for *_, inner in cut) >= 10 and all(len(p) <= 500 for parts, *_ in cut for p in parts)
    assert bpe.concatenate([(bpe.encode_piece(a, b, PATH), c) for a, b, c in cut], PATH) == library(x)


def test_remembered_stretches_give_the_same_digests():
    memo = bpe.Memo(PATH)
    for x in texts(300, 60):
        assert [v[0] for v in memo.digests([x])] == [v[0] for v in bpe.digests([library(x)], PATH)], x


def test_texts_go_through_the_tree(monkeypatch):
    r = random.Random(9)
    runs = ["".join(r.choice(["a", "b", "the", "ing", "é", "漢", "😀", "-", "1"]) for _ in range(r.randint(20, 400))) for _ in range(120)]
    runs += ["".join(r.choice(["a", "b", "the", "ing", "é", "er"]) for _ in range(r.randint(20, 400))) for _ in range(60)]
    some = [f"Some {a} words,{' ' * r.randint(1, 90)}{b}.\nMore" for a, b in zip(runs[::2], runs[1::2])] + runs + ["short words only", "<|endoftext|>" * 9, ""]
    want = [library(x) for x in some]
    assert bpe.encode_texts(some, PATH) == want
    for most in (1, 3, 17, 1000):
        assert bpe.encode_texts(some, PATH, most) == want
    joined = []
    join = bpe.join
    monkeypatch.setattr(bpe, "join", lambda *a: joined.append(a) or join(*a))
    assert bpe.encode_texts(some, PATH) == want and len(joined) > 50
    monkeypatch.setattr(bpe, "join", lambda left, right, path: left + right)  # without re-encoded windows, joins show
    assert bpe.encode_texts(some, PATH) != want


def test_unsplit_runs_of_a_table_are_joined_by_the_query(spark, monkeypatch):
    """At production parameters: with joins left out, rows with unsplit runs, in texts of any length, are wrong; with them they are the library's."""
    r = random.Random(3)
    run = lambda n: "".join(r.choice(["a", "b", "the", "ing", "er", "é"]) for _ in range(n))
    rows = [(i, f"words before {run(40 + i)} and after") for i in range(30)] + [(100, run(60_000)), (101, "plain words only"), (102, "x " * 40_000 + run(300))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: (x.n_tokens, x.ids_sha256) for x in bpe.encode(df, PATH).collect()}
    sha = lambda ids: hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert got == {d: (len(x := library(t)), sha(x)) for d, t in rows}
    left_out = {d for d, t in rows if got[d][1] != sha(_without_joins(t, monkeypatch))}
    assert len(left_out) > 25 and 100 in left_out and 102 in left_out and 101 not in left_out


def _without_joins(text, monkeypatch):
    with monkeypatch.context() as m:
        m.setattr(bpe, "join", lambda left, right, path: left + right)
        return bpe.encode_texts([text], PATH)[0]


def test_on_a_table(spark):
    rows = [(1, "Hello world <|endoftext|> x"), (2, None), (3, ""), (4, "x" * 400 + " " + "yé" * 300), (4, "x" * 400 + " " + "yé" * 300), (None, "a b"), (5, "one\ttwo  three \n\n four")]
    df = spark.createDataFrame([(*r, "more") for r in rows], "doc_id long, text string, ids_sha256 string")
    got = sorted((tuple(r) for r in bpe.encode(df, PATH, piece_chars=64).collect()), key=repr)
    want = []
    for doc, text in rows:
        ids = library(text or "")
        want.append((doc, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert got == sorted(want, key=repr)
    assert bpe.encode(df.limit(0), PATH).count() == 0


def test_round_trip(spark):
    df = spark.createDataFrame([(1, "Grüße, 世界!"), (2, None)], "doc_id long, text string")
    assert {tuple(r) for r in bpe.decode(bpe.encode_ids(df, PATH), PATH).collect()} == {(1, "Grüße, 世界!"), (2, "")}
