"""Toxicity by multiple-instance learning: documents have labels, sentences have scores.

A sentence's probability is logistic in the weights of its words; a document is toxic unless all its
sentences are harmless: p = 1 - prod(1 - p_s), the noisy-or. Weights are learned from document labels alone
by descent on the documents' cross-entropy, whose gradient reaches a sentence as p_s * (1 - y / p). Features
are lower-cased words and their beginnings of 4 to 8 bytes; those that labels do not bear out (G-test) get no
weight. The test counts a feature once for each distinct document; near copies that all have one label tell each
sentence once. Training reads a bounded sample of labelled rows, bounded in rows and in bytes of text, as the tasks make it: hashes of sentences
and features; texts do not come to the driver. Scoring reads every text whole.

Sentences end at line feeds and at the full stops, exclamation and question marks of Latin, Greek, Arabic, Indic and East Asian scripts.
Null and empty texts have no sentence and score 0. With no labelled row of either kind, or no
feature that labels bear out, all scores are 0.
Labels that disagree about an id count as toxic. Equal rows are learnt from once and score alike. Only text makes a score, and only doc_id and text are read.
"""

from __future__ import annotations

import re
from array import array
from dataclasses import dataclass
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from xxhash import xxh3_64_intdigest

from plumbline.llm.common import distinct, pack, slices, unpack

#: Labelled rows to learn from: at most so many harmless and so many toxic ones, in order of a hash of their ids, and of either kind
#: at most so many bytes of text; a text that would go beyond is passed over.
SAMPLE = (4_000, 2_500)
SAMPLE_BYTES = 24 << 20
#: Marks that end a sentence.
_END = re.compile("[.!?\n\u037e\u0589\u061f\u06d4\u0964\u0965\u104b\u1362\u1367\u203c\u203d\u2047\u2048\u2049\u2026\u3002\ufe52\ufe56\ufe57\uff01\uff0e\uff1f\uff61]+")
_EDGE = b".,;:!?()[]{}\"'*%$&#|<>-_"
_MEMO = 200_000
#: Mean of a weight before descent: a feature that the G-test bears out is taken for strong until documents speak against it.
_PRIOR = 4.5
#: How much likelier a feature must be in toxic documents.
_LIFT = 5.0


def sentences(text: str | None) -> list[list[bytes]]:
    """Words of the sentences that have any, lower-cased, without signs at their edges."""
    if not text:
        return []
    parts = (part.encode().split() for part in _END.split(text.lower()))
    return [[w.strip(_EDGE) for w in part] for part in parts if part]


@lru_cache(maxsize=_MEMO)
def features(word: bytes) -> list[int]:
    """Hashes (31 bits) of a word and of its beginnings."""
    return [crc32(b"w" + word) >> 1, *(crc32(b"p" + word[:k]) >> 1 for k in range(4, min(8, len(word)) + 1))] if word else []


@dataclass
class Model:
    bias: float
    weights: dict[int, float]

    def __post_init__(self):
        self.memo: dict[bytes, float] = {}

    def word(self, w: bytes) -> float:
        found = self.memo.get(w)
        if found is None:
            if len(self.memo) >= _MEMO:
                self.memo.clear()
            found = self.memo[w] = sum(self.weights.get(f, 0.0) for f in features(w)) if self.weights else 0.0
        return found

    def sentence_scores(self, text: str | None) -> np.ndarray:
        z = np.array([sum(map(self.word, set(s))) for s in sentences(text)], float) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def noisy_or(p: np.ndarray) -> float:
    return float(-np.expm1(np.log1p(-np.minimum(p, 1 - 1e-12)).sum()))


@dataclass
class Facts:
    """What a document tells: hashes of its sentences, and each one's features, those of its distinct words."""

    names: np.ndarray
    lengths: np.ndarray
    features: np.ndarray

    @staticmethod
    def of(text: str | None) -> Facts:
        found = sentences(text)
        own = [[f for w in set(s) for f in features(w)] for s in found]
        whole = np.fromiter((f for x in own for f in x), np.uint32)
        return Facts(np.array([xxh3_64_intdigest(b" ".join(s)) for s in found], np.uint64), np.array([len(x) for x in own], np.int64), whole)


def near_copies(docs: list[Facts], labels: list[int]) -> tuple[list[int], set[int]]:
    """Each document's group, and the groups with both labels. A group is named by the place of its first document, which has
    over half of the distinct sentences of every other."""
    where: dict[int, array] = {}
    group = []
    for d, doc in enumerate(docs):
        names = set(doc.names.tolist())
        held = [np.frombuffer(where[name], np.int32) for name in names if name in where]
        shared = np.bincount(np.concatenate(held)) if held else np.zeros(1, np.int64)
        del held
        g = int(shared.argmax())
        if 2 * shared[g] <= len(names):
            g = d
            for name in names:
                where.setdefault(name, array("i")).append(d)
        group.append(g)
    kinds = {(g, label > 0) for g, label in zip(group, labels, strict=True)}
    return group, {g for g, toxic in kinds if toxic and (g, False) in kinds}


def train(texts: list[str | None], labels: list[int], harmless: float = 1.0, least_g: float = 20.0, steps: int = 400) -> Model:
    return train_on([Facts.of(t) for t in texts], labels, harmless, least_g, steps)


def train_on(docs: list[Facts], labels: list[int], harmless: float = 1.0, least_g: float = 20.0, steps: int = 400) -> Model:
    """harmless: how many harmless documents one of the sample stands for, a toxic one being one."""
    first = dict(zip(((d.names.tobytes(), d.features.tobytes()) for d in reversed(docs)), range(len(docs) - 1, -1, -1), strict=True))  # of copies one is learnt from
    docs, labels = [docs[i] for i in sorted(first.values())], [labels[i] for i in sorted(first.values())]
    y = np.array(labels, float)
    if not len(y) or y.min() == y.max():
        return Model(-40.0, {})
    group, mixed = near_copies(docs, labels)
    found, told, units = [], {}, []
    for doc, label, g in zip(docs, labels, group, strict=True):  # a document's features once each, with its label in the last bit
        new = np.ones(len(doc.names), bool)
        if g not in mixed:  # copies of one label repeat each other: they tell a sentence once, and one that tells nothing is no unit
            seen = told.setdefault(g, set())
            new = np.array([name not in seen for name in doc.names.tolist()], bool)
            seen.update(doc.names.tolist())
            if len(doc.names) and not new.any():
                continue
        found.append(distinct(doc.features[np.repeat(new, doc.lengths)]) * np.uint32(2) + np.uint32(label > 0))
        units.append(label > 0)
    total, toxic = len(units), sum(units)
    del group, mixed, told
    found = np.concatenate(found)
    found.sort()
    start = np.flatnonzero(np.append(True, found[1:] >> np.uint32(1) != found[:-1] >> np.uint32(1))) if len(found) else np.empty(0, np.int64)
    n = np.diff(np.append(start, len(found))).astype(float)
    in_toxic = np.add.reduceat((found & np.uint32(1)).astype(np.uint16), start, dtype=np.int64).astype(float) if len(start) else n
    ids = found[start] >> np.uint32(1)
    xlog = lambda a, b: np.where(a > 0, a * np.log(np.maximum(a, 1e-9) / np.maximum(b, 1e-9)), 0)
    g = 2 * sum(xlog(a, e) for a, e in ((in_toxic, n * toxic / total), (n - in_toxic, n * (1 - toxic / total)), (toxic - in_toxic, (total - n) * toxic / total), (total - n - toxic + in_toxic, (total - n) * (1 - toxic / total))))
    good = (g >= least_g) & (in_toxic / toxic >= _LIFT * (n - in_toxic) / (total - toxic))  # not mere signs of a language
    place = ids[good]
    del found, ids, n, in_toxic, g, good
    if not len(place):
        return Model(-40.0, {})
    rows, cols, doc_of, plain = [], [], [], np.zeros(len(docs))
    sentences_so_far = 0
    for d, doc in enumerate(docs):  # sentences without features differ in nothing: they are counted, not listed
        at = np.minimum(np.searchsorted(place, doc.features), len(place) - 1)
        hit = place[at] == doc.features
        own = np.repeat(np.arange(len(doc.names)), doc.lengths)[hit]
        with_features, row = np.unique(own, return_inverse=True)
        rows.append(row + sentences_so_far)
        cols.append(at[hit])
        doc_of.append(np.full(len(with_features), d))
        sentences_so_far += len(with_features)
        plain[d] = len(doc.names) - len(with_features)
    rows, cols, doc_of = map(np.concatenate, (rows, cols, doc_of))
    w, bias = np.full(len(place), _PRIOR), -7.0
    weight = np.where(y > 0, 1.0, harmless)
    m, v = np.zeros(len(place) + 1), np.zeros(len(place) + 1)
    for step in range(1, steps + 1):
        z = bias + np.bincount(rows, w[cols], len(doc_of))
        p_s = np.clip(1 / (1 + np.exp(-z)), 1e-9, 1 - 1e-9)
        p_0 = 1 / (1 + np.exp(-bias))
        p = np.clip(-np.expm1(np.bincount(doc_of, np.log1p(-p_s), len(y)) + plain * np.log1p(-p_0)), 1e-6, 1 - 1e-9)
        pull = weight * (1 - y / p)
        each = p_s * pull[doc_of]
        grad = np.append(np.bincount(cols, each[rows], len(place)) + 0.01 * (w - _PRIOR), each.sum() + (p_0 * plain * pull).sum())
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        w, bias = w - move[:-1], min(-3.0, bias - move[-1])
    return Model(float(bias), {int(f): float(w[i]) for i, f in enumerate(place) if abs(w[i]) > 1e-3})


def fit(docs: DataFrame, labels: DataFrame, most: tuple[int, int] = SAMPLE, most_bytes: int = SAMPLE_BYTES) -> Model:
    """labels: (doc_id, toxic). At most ``most`` harmless and toxic rows, and ``most_bytes`` of either, are learnt from; weights make up for the shares."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("_toxic"))
    pick = lambda y: known.where(F.col("_toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most[y])
    sample = pick(0).unionByName(pick(1)).withColumnRenamed("doc_id", "_id")  # rows of bounded number: a broadcast of bounded size
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("_id")).select("_toxic", F.xxhash64("doc_id").alias("turn"), F.xxhash64("text").alias("own"), F.coalesce(F.octet_length("text"), F.lit(0)).alias("size"), "text")
    sizes = rows.groupBy("_toxic", "turn", "own").agg(F.first("size").alias("size"))  # rows that share an id and a text are one
    order = F.row_number().over(Window.partitionBy("_toxic").orderBy("turn", "own"))
    few = sizes.withColumn("at", order).where("at <= case _toxic when 0 then %d else %d end" % most).select("_toxic", "turn", "own", "size").collect()
    chosen, used = [], [0, 0]
    for r in sorted(few):
        if used[r["_toxic"]] + r["size"] <= most_bytes:
            used[r["_toxic"]] += r["size"]
            chosen.append((r["turn"], r["own"]))

    def facts(batches):
        for batch in slices(batches):
            found = [Facts.of(t) for t in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([pack(d.names, d.lengths.astype(np.uint32), d.features) for d in found], pa.binary())], names=["toxic", "turn", "own", "facts"])

    wanted = docs.sparkSession.createDataFrame(chosen, "turn long, own long")
    told = rows.join(F.broadcast(wanted), ["turn", "own"]).dropDuplicates(["_toxic", "turn", "own"]).select("_toxic", "turn", "own", "text")
    told = sorted(told.mapInArrow(facts, "toxic int, turn long, own long, facts binary").collect(), key=lambda r: (r["turn"], r["own"]))
    all_ = {r["_toxic"]: r["count"] for r in known.groupBy("_toxic").count().collect()}
    own = [sum(r["toxic"] == y for r in told) for y in (0, 1)]
    share = (all_.get(0, 0) / max(1, own[0])) / (all_.get(1, 0) / max(1, own[1])) if all_.get(1) else 1.0
    return train_on([Facts(names, lengths.astype(np.int64), f) for names, lengths, f in (unpack(r["facts"]) for r in told)], [r["toxic"] for r in told], share)


def score(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """doc_id, score, predicted, n_sentences, worst_sentence (its number from 0, or null) and its worst_score."""
    kind = docs.schema["doc_id"].dataType
    shared = docs.sparkSession.sparkContext.broadcast((model.bias, model.weights))
    out = pa.schema([("doc_id", to_arrow_type(kind)), ("score", pa.float64()), ("predicted", pa.int32()), ("n_sentences", pa.int64()), ("worst_sentence", pa.int64()), ("worst_score", pa.float64())])

    def run(batches):
        own = Model(*shared.value)
        for batch in slices(batches):
            found = [own.sentence_scores(t) for t in batch.column(1).to_pylist()]
            p = [noisy_or(s) if len(s) else 0.0 for s in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(p, pa.float64()), pa.array([int(x >= threshold) for x in p], pa.int32()), pa.array([len(s) for s in found], pa.int64()), pa.array([int(s.argmax()) if len(s) else None for s in found], pa.int64()), pa.array([float(s.max()) if len(s) else None for s in found], pa.float64())], schema=out
            )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind.simpleString()}, score double, predicted int, n_sentences long, worst_sentence long, worst_score double")


def offending(docs: DataFrame, model: Model, least: float = 0.3) -> DataFrame:
    """doc_id, sentence, score and words of each sentence that scores ``least`` or more."""
    kind = docs.schema["doc_id"].dataType
    shared = docs.sparkSession.sparkContext.broadcast((model.bias, model.weights))
    out = pa.schema([("doc_id", to_arrow_type(kind)), ("sentence", pa.int64()), ("score", pa.float64()), ("words", pa.string())])

    def run(batches):
        own = Model(*shared.value)
        for batch in slices(batches):
            for doc, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                p = own.sentence_scores(text)
                bad = np.flatnonzero(p >= least)
                if len(bad):
                    parts = sentences(text)
                    yield pa.RecordBatch.from_pylist([{"doc_id": doc, "sentence": int(i), "score": float(p[i]), "words": b" ".join(parts[i]).decode()} for i in bad], schema=out)

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind.simpleString()}, sentence long, score double, words string")
