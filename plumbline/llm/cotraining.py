"""Quality by co-training: a text-content view and a page-metadata view teach each other.

Two logistic classifiers start from the same labelled documents, one seeing what a text is made of, the
other its language, source and length. In each round each of them labels all unlabelled documents, and the other
learns from those that it is sure of. Each view is then calibrated (Platt) on labelled
documents kept aside, and the calibrated views' log-odds are combined by a logistic of the same fold, so that
a view which tells nothing gets no say. Every document is scored.

Features of all documents are written once. A round reads them, counts each view's sure documents of either label, and brings to
the driver about ``exchanged`` of each, those of the smallest hashes, equal documents once. So the documents learnt from are bounded, both those
that are labelled and those that a view labels; the documents that views label and choose from are not.

Null and empty texts, null metadata and missing columns are feature values of their own. With fewer than ``least_labels`` of either
label nothing is learned: all scores are 1 and every document is kept. Conflicting labels of an id count as
low quality. Repeated rows score alike. Columns other than doc_id, text, lang, source and n_chars are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from functools import reduce
from operator import eq, or_
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from plumbline.llm.common import drop, slices, written

LABELLED, EXCHANGED, ROUNDS, SURE = 8_000, 1_000, 4, 0.97
_SHAPES, _LANGS, _SOURCES = 128, 16, 64
_UPPER, _DIGITS = bytes(range(65, 91)), b"0123456789"
_SIGNS = [b"#*$%&", b"|", b"!", b"?", b".", b",", b"<>", b"{}[]()", b"\n", b"-_=+/\\", bytes(range(128, 256))]
_SHAPE = bytes(88 if 65 <= b < 91 else 120 if 97 <= b < 123 or b >= 128 else 48 if 48 <= b < 58 else b for b in range(256))
_RUN = re.compile(rb"(.)\1+", re.S)
_META = ("lang", "source", "n_chars")


def text_view(text: bytes | None) -> np.ndarray:
    """Shares of kinds of characters, word statistics, repeats, and a hashed histogram of word shapes."""
    out = np.zeros(24 + _SHAPES, np.float32)
    found = text.split() if text else []
    if not found:
        out[0] = 1
        return out
    size, n = len(text), len(found)
    share = lambda signs: (size - len(text.translate(None, signs))) / size
    out[1], out[2] = share(_UPPER), share(_DIGITS)
    out[3 : 3 + len(_SIGNS)] = [share(s) for s in _SIGNS]
    lines = [x for x in text.split(b"\n") if x]
    out[15:22] = [np.log1p(n), size / n / 10, len(set(found)) / n, sum(map(eq, found, found[1:])) / n, len(lines) / n * 10, 1 - len(set(lines)) / max(1, len(lines)), n < 50]
    for shape, k in Counter(_RUN.sub(rb"\1", text.translate(_SHAPE)).split()).items():
        out[24 + crc32(shape) % _SHAPES] += k / n
    return out


def meta_view(lang, source, n_chars) -> np.ndarray:
    out = np.zeros(_LANGS + _SOURCES + 4, np.float32)
    out[crc32(repr(lang).encode()) % _LANGS] = 1
    out[_LANGS + crc32(repr(source).encode()) % _SOURCES] = 1
    out[-4] = n_chars is None
    out[-3] = np.log1p(max(0, n_chars or 0)) / 10
    out[-2] = (n_chars or 0) < 300
    return out


@dataclass
class Linear:
    mean: np.ndarray
    scale: np.ndarray
    w: np.ndarray
    b: float

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip((((x - self.mean) / self.scale) * self.w).sum(1) + self.b, -30, 30)  # by rows: equal rows score alike in any batch


def _sigmoid(z):
    return 1 / (1 + np.exp(-z))


def logistic(x: np.ndarray, y: np.ndarray, l2: float = 1.0, steps: int = 25) -> Linear:
    """Ridge logistic regression by Newton's method; classes weigh the same."""
    x = x.astype(np.float64)
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-3)
    z = np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
    w, penalty = np.zeros(z.shape[1]), np.append(np.full(x.shape[1], l2), 1e-6)
    for _ in range(steps):
        p = _sigmoid(np.clip(z @ w, -30, 30))
        hessian = (z * (weight * np.maximum(p * (1 - p), 1e-4))[:, None]).T @ z + np.diag(penalty)
        move = np.linalg.solve(hessian, z.T @ (weight * (y - p)) - penalty * w)
        w = w + move
        if np.abs(move).max() < 1e-4:
            break
    return Linear(mean, scale, w[:-1], float(w[-1]))


def platt(z: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and offset of a logistic over columns of log-odds, with the classes' own frequencies."""
    z = np.hstack([z.reshape(len(y), -1), np.ones((len(y), 1))])
    t = np.where(y > 0, ((y > 0).sum() + 1) / ((y > 0).sum() + 2), 1 / ((y == 0).sum() + 2))
    w, penalty = np.zeros(z.shape[1]), np.append(np.full(z.shape[1] - 1, 0.1), 1e-6)
    for _ in range(50):
        p = _sigmoid(np.clip(z @ w, -30, 30))
        w = w + np.linalg.solve((z * np.maximum(p * (1 - p), 1e-4)[:, None]).T @ z + np.diag(penalty), z.T @ (t - p) - penalty * w)
    return w[:-1], float(w[-1])


@dataclass
class Model:
    views: tuple[Linear, Linear]
    platts: tuple[tuple[np.ndarray, float], tuple[np.ndarray, float]]
    combined: tuple[np.ndarray, float]

    def scores(self, text: np.ndarray, meta: np.ndarray) -> np.ndarray:
        """Columns: the combined probability of high quality, the text's and the metadata's own."""
        own = [v.logit(x) * a[0] + b for v, x, (a, b) in zip(self.views, (text, meta), self.platts, strict=True)]
        z = np.stack(own, 1)
        return np.stack([_sigmoid((z * self.combined[0]).sum(1) + self.combined[1]), *map(_sigmoid, own)], 1)


def cotrain(text: np.ndarray, meta: np.ndarray, y: np.ndarray, confident, rounds: int = ROUNDS, least_labels: int = 5) -> Model | None:
    """text, meta and y (1 high quality, 0 low) of labelled documents in a random order, of which every third calibrates.

    confident(views) gives, for each view, {name: (label, text row, metadata row)} of unlabelled documents that it is sure of."""
    fold = np.arange(len(y)) % 3 == 2
    aside, known = np.flatnonzero(fold), np.flatnonzero(~fold)
    if min((y[known] == 0).sum(), (y[known] == 1).sum(), (y[aside] == 0).sum() + 4, (y[aside] == 1).sum() + 4) < least_labels:
        return None
    given: tuple[dict, dict] = ({}, {})  # what each view has been taught by the other
    for turn in range(rounds + 1):
        views = []
        for k, (x, more) in enumerate(zip((text, meta), given, strict=True)):
            rows = np.vstack([x[known], *(r[1 + k][None] for r in more.values())])
            views.append(logistic(rows, np.concatenate([y[known], [r[0] for r in more.values()]])))
        if turn < rounds:
            for own, other in zip(confident(tuple(views)), reversed(given), strict=True):
                other.update(own)
    z = [v.logit(x[aside]) for v, x in zip(views, (text, meta), strict=True)]
    platts = tuple(platt(v, y[aside]) for v in z)
    return Model(tuple(views), platts, platt(np.stack([v * a[0] + b for v, (a, b) in zip(z, platts, strict=True)], 1), y[aside]))


def _with_meta(docs: DataFrame) -> DataFrame:
    have = [F.col(c) if c in docs.columns else F.lit(None).alias(c) for c in _META]
    return docs.select("doc_id", F.col("text").cast("binary").alias("text"), have[0].cast("string").alias("lang"), have[1].cast("string").alias("source"), have[2].cast("long").alias("n_chars"))


def _views(batch) -> tuple[np.ndarray, np.ndarray]:
    text, lang, source, n_chars = (c.to_pylist() for c in batch.columns[1:5])
    width = 24 + _SHAPES, _LANGS + _SOURCES + 4
    return np.stack([text_view(t) for t in text]) if text else np.zeros((0, width[0]), np.float32), np.stack([meta_view(*m) for m in zip(lang, source, n_chars, strict=True)]) if text else np.zeros((0, width[1]), np.float32)


_STORED = ["turn", "a", "b"]


def _rows(batch) -> tuple[np.ndarray, np.ndarray]:
    """The two views of stored features."""
    return tuple(np.frombuffer(b"".join(batch.column(c).to_pylist()), np.float32).reshape(batch.num_rows, -1) for c in (1, 2))


def fit(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, exchanged: int = EXCHANGED, rounds: int = ROUNDS, sure: float = SURE) -> Model | None:
    """labels: (doc_id, quality). At most ``labelled`` / 2 rows of either label are learnt from, and about ``exchanged`` of each view and label a round."""
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").cast("int").alias("_y")).withColumnRenamed("doc_id", "_id")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def views_of(batches):
        for batch in slices(batches):
            a, b = _views(batch)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(5), pa.array([x.tobytes() for x in a], pa.binary()), pa.array([x.tobytes() for x in b], pa.binary())], names=["doc_id", "turn", "a", "b"])

    named = _with_meta(docs).withColumn("_turn", F.xxhash64(F.lit("co-training"), "doc_id", "text"))
    found = named.mapInArrow(views_of, f"doc_id {kind}, turn long, a binary, b binary")
    found = written(found.join(known, F.col("doc_id") == F.col("_id"), "left").select(F.coalesce("_y", F.lit(-1)).alias("y"), *_STORED), "co-training")
    taught = [r for y in (0, 1) for r in found.where("y = 0" if not y else "y > 0").orderBy("turn", "a", "b").limit(labelled // 2).collect()]
    if not taught:
        drop(found)
        return None
    taught.sort(key=lambda r: (r["turn"], r["a"], r["b"]))
    pool = found.where("y < 0").select(*_STORED)

    def confident(views):
        def judged(batches):
            for batch in batches:
                if batch.num_rows:
                    p = [_sigmoid(v.logit(x)) for v, x in zip(views, _rows(batch), strict=True)]
                    yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(x) for x in p)], names=[*_STORED, "p0", "p1"])

        told = pool.mapInArrow(judged, "turn long, a binary, b binary, p0 double, p1 double")
        groups = [(v, y, F.col(f"p{v}") >= sure if y else F.col(f"p{v}") <= 1 - sure) for v in (0, 1) for y in (0, 1)]
        counts = told.agg(*(F.count(F.when(c, 1)) for *_, c in groups)).first()
        share = lambda n: F.pmod(F.xxhash64("turn"), F.lit(1 << 40)) < int((1 << 40) * min(1.0, exchanged / max(1, n)))
        picked = [c & share(n) for (*_, c), n in zip(groups, counts, strict=True)]
        some = told.where(reduce(or_, picked)).dropDuplicates(["turn"]).select(*_STORED, *(c.alias(f"c{i}") for i, c in enumerate(picked)))
        out: tuple[dict, dict] = ({}, {})
        for r in some.orderBy("turn").limit(8 * exchanged).collect():
            rows = tuple(np.frombuffer(r[c], np.float32) for c in ("a", "b"))
            for i, (v, y, _) in enumerate(groups):
                if r[f"c{i}"]:
                    out[v][r["turn"]] = (y, *rows)
        return out

    stack = lambda k: np.stack([np.frombuffer(r[k], np.float32) for r in taught])
    model = cotrain(stack("a"), stack("b"), np.array([min(1, r["y"]) for r in taught]), confident, rounds)
    drop(found)
    return model


def _scores(model: Model | None, batch) -> np.ndarray:
    return np.ones((batch.num_rows, 3)) if model is None or not batch.num_rows else model.scores(*_views(batch))


def score(docs: DataFrame, model: Model | None, least: float = 0.5) -> DataFrame:
    """doc_id, score (probability of high quality), text_score, meta_score and kept of every row. Map only."""
    kind = docs.schema["doc_id"].dataType
    out = pa.schema([("doc_id", to_arrow_type(kind)), ("score", pa.float64()), ("text_score", pa.float64()), ("meta_score", pa.float64()), ("kept", pa.bool_())])

    def run(batches):
        for batch in slices(batches):
            p = _scores(model, batch)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(p[:, k]) for k in range(3)), pa.array(p[:, 0] >= least)], schema=out)

    return _with_meta(docs).mapInArrow(run, f"doc_id {kind.simpleString()}, score double, text_score double, meta_score double, kept boolean")


def keep(docs: DataFrame, model: Model | None, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score ``least`` or more, with all their columns."""
    at = {c: docs.columns.index(c) for c in ("text", *_META) if c in docs.columns}

    def run(batches):
        for batch in slices(batches):
            none = pa.nulls(batch.num_rows)
            own = [batch.column(at["text"]).cast(pa.binary()), *(batch.column(at[c]) if c in at else none for c in _META)]
            yield batch.filter(pa.array(_scores(model, pa.RecordBatch.from_arrays([none, *own], names=["doc_id", "text", *_META]))[:, 0] >= least))

    return docs.mapInArrow(run, docs.schema)
