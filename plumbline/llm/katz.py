"""Katz backoff language model of order three, fitted, stored and applied at any size.

P3(w | a b) = d3(r) r / c(a b) for a triple seen r times, else alpha(a b) P2(w | b); P2(w | b) = d2(r) r / c(b) for a
pair seen r times, else alpha(b) P1(w); P1(w) = d1(r) r / N, else what the discounts leave, for the one event
"unknown". Discounts are Good-Turing's up to r = 5. alpha(h) is what the n-grams of h leave, divided by the
lower order's mass of words not seen after h, summed exactly over h's types, so each history's probabilities
add up to 1 over known words and "unknown". The evaluation of a token recurs from the triple down.

Texts are read once, into chunks: numbered words and token sequences, packed. Distinct words go to ranges of word
hashes, distinct triples to the range of their middle word b: there every n-gram whose history ends in b is
found, so that the counts of pairs and the sums of both orders' histories come of one exchange. The mass that a
history (a b) takes from the lower order is told as counts of its pairs' counts, so the discounts need not be known
yet. Ranges are as many as the counted bytes ask for. A middle word with more than a range's share of tokens is
dealt out by the predicted word, and the sums of its histories, which then are partial, are added up in ranges
of their first word. What a chunk sends is distinct words and triples with counts: it grows with the corpus.

A model is two tables in the shared folder, words and n-grams by range, and a few numbers. It can be kept and
applied to other documents; fitting and scoring the same documents shares their exchanges.

Tokens: words, A-Z lower-cased, then one end. Null texts are empty: the end alone. Before the first token stand two
beginnings. Without training rows "unknown" has probability 1. Repeated rows count and score alike. doc_id may be of
any type. Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from xxhash import xxh3_64_intdigest

from plumbline.llm.common import deltas, distinct, drop, pack, ranges_of, release, slices, trim, undeltas, unpack, written_apart
from plumbline.llm.jaccard import _sliced

CHUNK_BYTES, RANGE_BYTES, LARGEST = 16 << 20, 16 << 20, 5
#: Hashes that stand for the beginning and the end of a text; words' hashes are larger.
_BEGIN, _END = 0, 1
#: The number of all words that training has not seen.
_UNKNOWN = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Chunk numbers of rows that answer no chunk: sums of counts, parts of stored tables, parts of histories' sums.
_STATS, _TABLE, _PARTIAL = -1, -2, -3
#: First part numbers of: answers about words (0), answers about n-grams, histories of hot words.
_NGRAMS, _HOT = 1 << 24, 1 << 25
_WIRE = pa.schema([("part", pa.int32()), ("chunk", pa.int64()), ("blob", pa.binary())])
_WIRE_SQL = "part int, chunk long, blob binary"


@dataclass(frozen=True)
class Discounts:
    """Good-Turing discounts d(1..k); k = 0 where the counts of counts allow none."""

    d: tuple[float, ...]

    @staticmethod
    def of(n: np.ndarray, largest: int = LARGEST) -> Discounts:
        """n[r]: how many types occur r times, for r up to largest + 1."""
        for k in range(min(largest, len(n) - 2), 0, -1):
            if (n[1 : k + 2] <= 0).any():
                continue
            common = (k + 1) * n[k + 1] / n[1]
            if common >= 1:
                continue
            r = np.arange(1, k + 1)
            d = ((r + 1) * n[2 : k + 2] / n[1 : k + 1] / r - common) / (1 - common)
            if (d > 0).all() and (d < 1).all():
                return Discounts(tuple(map(float, d)))
        return Discounts(())

    def kept(self, r: np.ndarray) -> np.ndarray:
        """Discounted counts."""
        r = np.asarray(r)
        return r * np.concatenate([[1.0], self.d, [1.0]])[np.where(r <= len(self.d), r, len(self.d) + 1)]

    def left(self, types: np.ndarray) -> np.ndarray:
        """What is taken away, by counts of types with r = 1..; first axis r."""
        return sum(((1 - d) * r * types[r - 1] for r, d in enumerate(self.d, 1)), np.zeros(types.shape[1:]))


@dataclass(frozen=True)
class Unigrams:
    total: int
    types: int
    discounts: Discounts
    left: float

    @staticmethod
    def of(total: int, types: int, n: np.ndarray) -> Unigrams:
        d = Discounts.of(n)
        return Unigrams(int(total), int(types), d, float(d.left(n[1:].astype(float))))

    @property
    def whole(self) -> float:
        """The denominator: one more where discounts leave nothing for unknown words."""
        return self.total + (self.left <= 0)

    @property
    def unknown(self) -> float:
        return (self.left if self.left > 0 else 1.0) / self.whole if self.total else 1.0

    def p(self, c: np.ndarray) -> np.ndarray:
        return np.where(c > 0, self.discounts.kept(c) / max(1.0, self.whole), self.unknown)


@dataclass
class Model:
    """Tables by range (part, blob) of words and of n-grams, and what is known of the whole of them."""

    words: DataFrame
    ngrams: DataFrame
    parts: int
    hot: float
    unigrams: Unigrams
    pairs: Discounts
    triples: Discounts


# -- chunks -------------------------------------------------------------------------------------------------


def _wire(rows: list[tuple[int, int, bytes]]) -> pa.Table:
    return pa.table({"part": pa.array([r[0] for r in rows], pa.int32()), "chunk": pa.array([r[1] for r in rows], pa.int64()), "blob": pa.array([r[2] for r in rows], pa.binary())}, schema=_WIRE)


def _ipc(ids: list, kind: pa.DataType) -> np.ndarray:
    batch, sink = pa.record_batch([pa.array(ids, kind)], ["id"]), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return np.frombuffer(sink.getvalue(), np.uint8)


def _chunk(key: int, ids: list, train: list, texts: list, kind: pa.DataType) -> pa.RecordBatch:
    """A chunk's payload, and its words with their counts in training rows; both with the size of its texts."""
    number: dict[bytes, int] = defaultdict(count().__next__)
    found = [np.fromiter(map(number.__getitem__, own), np.int64, len(own)) for own in ((t.lower().split() if t else []) for t in texts)]
    hashes = np.maximum(np.fromiter(map(xxh3_64_intdigest, number), np.uint64, len(number)), np.uint64(2))
    words, place = np.unique(np.concatenate([np.array([_BEGIN, _END], np.uint64), hashes]), return_inverse=True)
    end = np.full(1, -1, np.int64)
    at = place[np.concatenate(list(chain.from_iterable((x, end) for x in found))) + 2].astype(np.uint32)
    sizes, learn = np.array([len(x) + 1 for x in found], np.uint32), np.array(train, np.uint8)
    counts = np.bincount(at, np.repeat(learn, sizes), len(words)).astype(np.uint32)
    counts[0] = learn.sum()
    blobs = [pack(at, sizes, learn, _ipc(ids, kind)), pack(deltas(words), counts)]
    return pa.record_batch([pa.array([-1, 0], pa.int32()), pa.array([key] * 2, pa.int64()), pa.array(blobs, pa.binary()), pa.array([sum(len(t or b"") for t in texts)] * 2, pa.int64())], names=[*_WIRE.names, "size"])


def _counts_of_counts(c: np.ndarray) -> np.ndarray:
    return np.bincount(np.minimum(c, LARGEST + 2).astype(np.int64), minlength=LARGEST + 3)[: LARGEST + 2]


def _count_words(rows: pa.Table, store: bool) -> pa.Table:
    """Of one range of words: to each chunk its words' counts, and the numbers of those that training has seen."""
    trim()
    part, out, own = rows["part"][0].as_py(), [], []
    for chunk, blob in zip(rows["chunk"].to_pylist(), rows["blob"].to_pylist(), strict=True):
        w, c = unpack(blob)
        own.append((chunk, undeltas(w), c))
    all_, at = np.unique(np.concatenate([w for _, w, _ in own]), return_inverse=True)
    total = np.bincount(at, np.concatenate([c for *_, c in own]), len(all_)).astype(np.uint64)
    seen = total > 0
    number, known = np.zeros(len(all_), np.uint32), np.flatnonzero(seen)
    number[known[np.argsort(-total[known].astype(np.int64), kind="stable")]] = np.arange(len(known))  # frequent words have small numbers
    first = 0
    for chunk, w, _ in own:
        i = at[first : first + len(w)]
        first += len(w)
        if chunk >= 0:
            out.append((part, chunk, pack(number[i][seen[i]], total[i])))
    if store and seen.any():
        out.append((part, _TABLE, pack(deltas(all_[seen]), total[seen])))
    c = total[seen & (all_ != _BEGIN)].astype(np.int64)
    out.append((part, _STATS, pack(np.concatenate([[c.sum(), len(c)], _counts_of_counts(c)]).astype(np.int64))))
    return _wire(out)


def _runs(a: np.ndarray) -> np.ndarray:
    """True where a value begins that differs from the one before."""
    new = np.ones(len(a), bool)
    new[1:] = a[1:] != a[:-1]
    return new


def _steps(a: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Differences, but whole values where ``first``."""
    out = deltas(a)
    out[first] = a[first]
    return out


def _numbers(step: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Undoes ``_steps``, of runs of these lengths."""
    total = np.cumsum(step, dtype=np.uint64)
    start = np.cumsum(lengths, dtype=np.int64) - lengths
    return total - np.repeat(total[start] - step[start], lengths)


class _Chunk:
    """A chunk's distinct triples (b, w, a), pairs (b, w) and histories (b, a), each in order, with numbers and counts of words.

    A word's number is its rank in its range times ``parts`` plus the range. Words that training has not seen are one word,
    the last; ``known`` is how many others there are."""

    def __init__(self, rows: list[tuple[int, bytes]], parts: int):
        at, self.sizes, self.train, self.ids = unpack(next(b for p, b in rows if p == -1))
        numbers, counts, seen = [], [], []
        for part, blob in sorted(r for r in rows if 0 <= r[0] < _NGRAMS):
            n, c = unpack(blob)
            numbers.append(n.astype(np.uint64) * np.uint64(parts) + np.uint64(part))
            counts.append(c.astype(np.int64))
            seen.append(c > 0)
        seen, counts, numbers = map(np.concatenate, (seen, counts, numbers))
        self.known = known = len(numbers)
        order = np.argsort(numbers)
        self.numbers = np.append(numbers[order], _UNKNOWN)
        self.ranges = np.append((numbers[order] % np.uint64(parts)).astype(np.int32), np.int32(-1))
        self.counts = np.append(counts[seen][order], 0)
        local = np.full(len(seen), known, np.int32)
        local[np.flatnonzero(seen)[order]] = np.arange(known)
        self.words = w = local[at]  # of each token
        start, begin = np.cumsum(self.sizes, dtype=np.int64) - self.sizes, local[0]
        b, a = np.empty_like(w), np.empty_like(w)
        b[1:], a[2:] = w[:-1], w[:-2]
        a[1:2] = begin
        b[start] = begin
        a[start] = begin
        a[start[self.sizes > 1] + 1] = begin
        n = known + 1
        if n**3 < 1 << 63:
            code = (b.astype(np.int64) * n + w) * n + a
        else:
            code = np.unique(b.astype(np.int64) * n + w, return_inverse=True)[1] * n + a
        order = np.argsort(code)
        new = _runs(code[order])
        del code
        self.token = np.empty(len(w), np.int32)  # the triple of each token
        self.token[order] = np.cumsum(new, dtype=np.int32) - 1
        first = order[new]
        del order, new
        self.t_a, t_b, t_pair = a[first], b[first].astype(np.int64), w[first]
        del a, b, first
        t_pair = t_b * n + t_pair
        new = _runs(t_pair)
        self.t_pair = np.cumsum(new, dtype=np.int32) - 1
        self.p_b, self.p_w = (x.astype(np.int32) for x in np.divmod(t_pair[new], n))
        codes, history = np.unique(t_b * n + self.t_a, return_inverse=True)
        self.t_history = history.astype(np.int32)
        self.h_b, self.h_a = (x.astype(np.int32) for x in np.divmod(codes, n))

    def places(self, hot: float) -> tuple[np.ndarray, np.ndarray]:
        """The range of each pair, and the range of each history if its middle word is hot; -1: none."""
        part, is_hot = self.ranges, self.counts > hot
        return np.where(is_hot[self.p_b], part[self.p_w], part[self.p_b]), np.where(is_hot[self.h_b], part[self.h_a], -1)


def _ask(rows: list[tuple[int, bytes]], chunk: int, hot: float, parts: int) -> Iterator[tuple[int, int, bytes]]:
    trim()
    c = _Chunk(rows, parts)
    place, hot_place = c.places(hot)
    learnt = np.bincount(c.token, np.repeat(c.train, c.sizes), len(c.t_a)).astype(np.uint32)
    pairs = np.argsort(place, kind="stable")
    triples = np.argsort(place[c.t_pair], kind="stable")
    n_a = np.bincount(c.t_pair, minlength=len(place)).astype(np.uint32)[pairs]
    part, b, w = place[pairs], c.p_b[pairs], c.p_w[pairs]
    new_b = _runs(part) | _runs(b)
    w_step, c_w = _steps(c.numbers[w], new_b), c.counts[w].astype(np.uint64)
    a_step = _steps(c.numbers[c.t_a[triples]], _runs(np.repeat(np.arange(len(pairs)), n_a)))
    learnt = learnt[triples]
    ends = np.append(0, np.cumsum(n_a, dtype=np.int64))
    cuts = np.flatnonzero(np.append(_runs(part), True))
    for i, j in zip(cuts[:-1], cuts[1:], strict=True):
        if part[i] >= 0:
            heads = np.flatnonzero(new_b[i:j])
            own = b[i:j][heads]
            t = slice(ends[i], ends[j])
            yield int(part[i]), chunk, pack(deltas(c.numbers[own]), np.diff(np.append(heads, j - i)).astype(np.uint32), (c.counts[own] > hot).astype(np.uint8), w_step[i:j], c_w[i:j], n_a[i:j], a_step[t], learnt[t])
    for q in distinct(hot_place):
        if q >= 0:
            own = hot_place == q
            yield _HOT + int(q), chunk, pack(c.numbers[c.h_b[own]], c.numbers[c.h_a[own]])


# -- ranges of n-grams --------------------------------------------------------------------------------------


@dataclass
class _Sums:
    """Of histories: their counts, types seen 1..5 times, and of pairs: the mass of seen words in the lower order; of
    triples: how many seen ones have a pair seen 1..5 times, and the sum of larger pairs' counts."""

    c: np.ndarray
    types: np.ndarray
    mass: np.ndarray
    low: np.ndarray
    more: np.ndarray

    @staticmethod
    def none(n: int) -> _Sums:
        return _Sums(np.zeros(n, np.int64), np.zeros((LARGEST, n), np.uint32), np.zeros(n), np.zeros((LARGEST, n), np.uint32), np.zeros(n, np.int64))

    @staticmethod
    def of(n: int, history: np.ndarray, count: np.ndarray, mass=None, lower=None) -> _Sums:
        each = lambda r: np.stack([np.bincount(history[r == k], minlength=n) for k in range(1, LARGEST + 1)]).astype(np.uint32)
        out = _Sums.none(n)
        out.c, out.types = np.bincount(history, count, n).astype(np.int64), each(count)
        if mass is not None:
            out.mass = np.bincount(history, mass, n)
        if lower is not None:
            lower = np.where(count > 0, lower, 0)
            out.low, out.more = each(lower), np.bincount(history, np.where(lower > LARGEST, lower, 0), n).astype(np.int64)
        return out

    def take(self, i: np.ndarray, backs_off: np.ndarray | None = None) -> list[np.ndarray]:
        """Arrays of some histories. Of those that do not back off it is only told whether discounts leave them anything:
        one type, of the least count that is there."""
        types, low, yes = self.types[:, i], self.low[:, i], backs_off
        if yes is None:
            return [self.c[i].astype(np.uint64), types.ravel(), self.mass[i], low.ravel(), self.more[i].astype(np.uint64)]
        some, least = np.flatnonzero(types.any(0) & ~yes), (types > 0).argmax(0)
        types[:, ~yes] = 0
        types[least[some], some] = 1
        return [self.c[i].astype(np.uint64), types.ravel(), self.mass[i] * yes, (low * yes).astype(np.uint32).ravel(), (self.more[i] * yes).astype(np.uint64)]

    def put(self, i: np.ndarray, arrays: list[np.ndarray], add: bool = False) -> None:
        square = lambda a: a.reshape(LARGEST, len(i))
        for mine, new in zip((self.c, self.types, self.mass, self.low, self.more), (arrays[0].astype(np.int64), square(arrays[1]), arrays[2], square(arrays[3]), arrays[4].astype(np.int64)), strict=True):
            if add:
                np.add.at(mine.T, i, new.T)
            else:
                mine[..., i] = new


_WIDTH = 5  # arrays of a _Sums


def _count_ngrams(rows: pa.Table, parts: int, unigrams: Unigrams, store: bool) -> pa.Table:
    """Of one range: to each chunk the counts of its pairs and triples and the sums of its histories, in order; the
    range's part of the stored table; and partial sums of hot words' histories."""
    trim()
    part, out = rows["part"][0].as_py(), []
    if part >= _HOT:  # to be answered once the partial sums are there
        return rows.select(["part", "chunk", "blob"])
    own = [(c, unpack(b.as_buffer())) for c, b in zip(rows["chunk"].to_pylist(), rows["blob"], strict=True)]
    del rows
    joined = lambda k: np.concatenate([a[k] for _, a in own])
    b_all, b_at = np.unique(np.concatenate([undeltas(a[0]) for _, a in own]), return_inverse=True)
    w_all, w_at = np.unique(np.concatenate([_numbers(a[3], a[1]) for _, a in own]), return_inverse=True)
    p_code, p_at = np.unique(np.repeat(b_at, joined(1)) * len(w_all) + w_at, return_inverse=True)
    c_w, stored = np.zeros(len(p_code), np.int64), [a for chunk, a in own if chunk == _TABLE]
    c_w[p_at] = np.concatenate([np.zeros(len(a[3]), np.uint64) if chunk == _TABLE else a[4] for chunk, a in own])
    del w_at
    a_all, a_at = np.unique(np.concatenate([_numbers(a[6], a[5]) for _, a in own]), return_inverse=True)
    t_code, t_at = np.unique(np.repeat(p_at, joined(5)) * len(a_all) + a_at, return_inverse=True)
    del a_at
    for _, a in own:  # decoded: what is left of them is told by their lengths
        a[3], a[6] = np.empty(len(a[3]), bool), np.empty(len(a[6]), bool)
    triple = np.bincount(t_at, joined(7), len(t_code)).astype(np.int64)
    t_pair, t_a = np.divmod(t_code, len(a_all))
    del t_code
    pair = np.bincount(t_pair, triple, len(p_code)).astype(np.int64)
    p_b, p_w = np.divmod(p_code, len(w_all))
    h_code, t_h = np.unique(p_b[t_pair] * len(a_all) + t_a, return_inverse=True)
    h_b, h_a = np.divmod(h_code, len(a_all))
    words = _Sums.of(len(b_all), p_b, pair, mass=np.where(pair > 0, unigrams.p(c_w), 0.0))
    histories = _Sums.of(len(h_code), t_h, triple, lower=pair[t_pair])
    for a in stored:
        words.mass[np.searchsorted(b_all, undeltas(a[0]))] = a[4]
    hot = np.zeros(len(b_all), bool)
    hot[b_at] = joined(2) > 0
    first_b = first_p = first_t = 0
    for chunk, a in own:
        n_b, n_p, n_t = len(a[0]), len(a[3]), len(a[6])
        b, p, t = b_at[first_b : first_b + n_b], p_at[first_p : first_p + n_p], t_at[first_t : first_t + n_t]
        first_b, first_p, first_t = first_b + n_b, first_p + n_p, first_t + n_t
        if chunk < 0:
            continue
        b, h = b[~hot[b]], t_h[t]
        used = distinct(h[~hot[h_b[h]]])
        low_b, low_h = np.zeros(len(b_all), bool), np.zeros(len(h_code), bool)
        low_b[p_b[p[pair[p] == 0]]] = True
        low_h[h[triple[t] == 0]] = True
        out.append((_NGRAMS + part, chunk, pack(pair[p].astype(np.uint32), triple[t].astype(np.uint32), *words.take(b, low_b[b]), *histories.take(used, low_h[used]))))
    seen = triple > 0
    if store and seen.any():
        first_pair = _runs(t_pair[seen])
        pairs = t_pair[seen][first_pair]
        first_word = _runs(p_b[pairs])
        b = p_b[pairs[first_word]]
        length = lambda new: np.diff(np.append(np.flatnonzero(new), len(new))).astype(np.uint32)
        out.append((part, _TABLE, pack(deltas(b_all[b]), length(first_word), hot[b].astype(np.uint8), _steps(w_all[p_w[pairs]], first_word), words.mass[b], length(first_pair), _steps(a_all[t_a[seen]], first_pair), triple[seen].astype(np.uint32))))
    if hot.any():
        b = np.flatnonzero(hot)
        h = np.flatnonzero(hot[h_b] & (histories.c > 0))
        for to in distinct(at := b_all[b] % np.uint64(parts)):  # a word's own sums: a history without a first word
            i = b[at == to]
            out.append((_HOT + int(to), _PARTIAL, pack(b_all[i], np.full(len(i), _UNKNOWN), *words.take(i))))
        for to in distinct(at := a_all[h_a[h]] % np.uint64(parts)):
            i = h[at == to]
            out.append((_HOT + int(to), _PARTIAL, pack(b_all[h_b[i]], a_all[h_a[i]], *histories.take(i))))
    out.append((part, _STATS, pack(np.concatenate([_counts_of_counts(pair[pair > 0]), _counts_of_counts(triple[seen])]).astype(np.int64))))
    return _wire(out)


def _add_up(rows: pa.Table) -> pa.Table:
    """Of hot words' histories in one range: to each chunk the sums of those that it asked for."""
    trim()
    part, key = rows["part"][0].as_py(), np.dtype([("b", np.uint64), ("a", np.uint64)])
    own = [(c, unpack(b)) for c, b in zip(rows["chunk"].to_pylist(), rows["blob"].to_pylist(), strict=True)]

    def keys(a: list[np.ndarray]) -> np.ndarray:
        out = np.empty(len(a[0]), key)
        out["b"], out["a"] = a[0], a[1]
        return out

    all_, at = np.unique(np.concatenate([keys(a) for _, a in own]), return_inverse=True)
    sums, first, out = _Sums.none(len(all_)), 0, []
    for chunk, a in own:
        if chunk == _PARTIAL:
            sums.put(at[first : first + len(a[0])], a[2:], add=True)
        first += len(a[0])
    first = 0
    for chunk, a in own:
        if chunk >= 0:
            out.append((part, chunk, pack(*sums.take(at[first : first + len(a[0])]))))
        first += len(a[0])
    words = np.flatnonzero((all_["a"] == _UNKNOWN) & (sums.c > 0))
    if len(words):
        out.append((part, _PARTIAL, pack(all_["b"][words], *sums.take(words))))
    return _wire(out)


# -- evaluation ---------------------------------------------------------------------------------------------


def _alpha(sums: _Sums, d: Discounts, mass: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Denominators and backoff weights of histories; an unseen history backs off as it is. least: of 1 - mass, which
    holds at least what the lower order gives to unknown words."""
    left = d.left(sums.types)
    whole = np.maximum(1, sums.c + (left <= 0))
    return whole, np.where(sums.c > 0, np.where(left > 0, left, 1.0) / whole / np.maximum(1 - mass, least), 1.0)


def probabilities(c: _Chunk, pair: np.ndarray, triple: np.ndarray, words: _Sums, histories: _Sums, unigrams: Unigrams, d2: Discounts, d3: Discounts) -> np.ndarray:
    """P3 of each distinct triple of a chunk."""
    whole2, alpha2 = _alpha(words, d2, words.mass, np.full(len(words.c), unigrams.unknown))
    p2 = np.where(pair > 0, d2.kept(pair) / whole2[c.p_b], alpha2[c.p_b] * unigrams.p(c.counts[c.p_w]))
    mass = sum((kept * low for kept, low in zip(d2.kept(np.arange(1, LARGEST + 1)), histories.low, strict=True)), histories.more.astype(float)) / whole2[c.h_b]
    whole3, alpha3 = _alpha(histories, d3, mass, alpha2[c.h_b] * unigrams.unknown)
    return np.where(triple > 0, d3.kept(triple) / whole3[c.t_history], alpha3[c.t_history] * p2[c.t_pair])


def _evaluate(rows: list[tuple[int, bytes]], parts: int, hot: float, hot_words: dict[int, list[np.ndarray]], unigrams: Unigrams, d2: Discounts, d3: Discounts, schema: pa.Schema) -> pa.Table:
    trim()
    c = _Chunk(rows, parts)
    place, hot_place = c.places(hot)
    pair, triple = np.zeros(len(place), np.uint32), np.zeros(len(c.t_a), np.uint32)
    words, histories = _Sums.none(c.known + 1), _Sums.none(len(c.h_b))
    t_place, is_hot, p_place = place[c.t_pair], c.counts > hot, place
    h_place = np.where(is_hot[c.h_b], -1, c.ranges[c.h_b])
    answers = {p: b for p, b in rows if p >= _NGRAMS}
    by = lambda x: (np.argsort(x, kind="stable"), np.sort(x))
    (p_order, p_place), (t_order, t_place), (h_order, h_place), (s_order, s_place) = by(p_place), by(t_place), by(h_place), by(hot_place)
    of = lambda order, places, q: order[slice(*np.searchsorted(places, [q, q + 1]))]
    for p, blob in answers.items():
        a = unpack(blob)
        if p >= _HOT:
            histories.put(of(s_order, s_place, p - _HOT), a)
            continue
        own = of(p_order, p_place, p - _NGRAMS)
        pair[own], triple[of(t_order, t_place, p - _NGRAMS)] = a[0], a[1]
        b = c.p_b[own]
        b = b[_runs(b)]
        words.put(b[~is_hot[b]], a[2 : 2 + _WIDTH])
        histories.put(of(h_order, h_place, p - _NGRAMS), a[2 + _WIDTH :])
    del rows, answers, p_order, t_order, h_order, s_order
    for i in np.flatnonzero(is_hot):
        if (found := hot_words.get(int(c.numbers[i]))) is not None:
            words.put(np.array([i]), found)
    logs = np.log10(probabilities(c, pair, triple, words, histories, unigrams, d2, d3))[c.token]
    counts = c.counts[c.words]
    base = np.log10((counts + 1) / (unigrams.total + unigrams.types + 1))
    start = np.cumsum(c.sizes, dtype=np.int64) - c.sizes
    per = lambda x: pa.array(np.add.reduceat(x, start))
    ids = pa.ipc.open_stream(pa.py_buffer(c.ids.tobytes())).read_all()["id"].combine_chunks()
    total = pa.array(np.full(len(start), unigrams.total, np.int64))
    return pa.table([ids, pa.array(c.train == 0), pa.array(c.sizes.astype(np.int64)), per((counts > 0).astype(np.int64)), total, per(base), per(logs)], schema=schema)


# -- on a DataFrame -----------------------------------------------------------------------------------------


def _stats(table: DataFrame, width: int) -> np.ndarray:
    """Sums of the ranges' counts: one short row each."""
    found = [unpack(r["blob"])[0] for r in table.where(F.col("chunk") == _STATS).select("blob").collect()]
    return np.sum(found, axis=0) if found else np.zeros(width, np.int64)


def _run(docs: DataFrame, train, model: Model | None, answer: bool, chunk_bytes: int, range_bytes: int) -> tuple[Model, DataFrame | None]:
    """Fits a model to the rows of ``docs`` where ``train`` is true, or takes ``model``; and scores all rows if ``answer``."""
    spark, kind, fresh = docs.sparkSession, to_arrow_type(docs.schema["doc_id"].dataType), model is None
    if not answer:
        docs = docs.where(train)
    own = docs.select("doc_id", F.coalesce(train, F.lit(False)).alias("train"), F.col("text").cast("binary"))

    def chunks(batches):
        task, number = TaskContext.get().partitionId(), 0
        rows, size = ([], [], []), 0
        for batch in slices(batches):
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for all_, x in zip(rows, row, strict=True):
                    all_.append(x)
                size += len(row[2] or b"")
                if size >= chunk_bytes or len(rows[0]) >= 200_000:
                    yield _chunk(task << 32 | number, *rows, kind)
                    rows, size, number = ([], [], []), 0, number + 1
        if rows[0]:
            yield _chunk(task << 32 | number, *rows, kind)

    def send_words(batches):
        for batch in batches:
            for chunk, blob in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                words, counts = unpack(blob)
                words = undeltas(words)
                yield from _wire([(p, chunk, pack(deltas(words[a:b]), counts[a:b])) for p, (a, b) in enumerate(_sliced(words, parts)) if b > a]).to_batches()

    by = lambda df, key, n: df.repartition(n, key).groupBy(key)
    payload, asked = written_apart(own.mapInArrow(chunks, f"{_WIRE_SQL}, size long"), "katz-chunks", "part < 0")
    n_chunks, size = payload.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    parts, n_chunks = model.parts if model else ranges_of(spark, size, range_bytes), max(1, n_chunks)
    payload = payload.select(*_WIRE.names)
    words = asked.select(*_WIRE.names).mapInArrow(send_words, _WIRE_SQL)
    if model:
        words = words.unionByName(model.words)
    known, answers = written_apart(by(words, "part", parts).applyInArrow(lambda t: _count_words(t, fresh), _WIRE_SQL), "katz-words", "chunk < 0")
    drop(asked)
    unigrams = model.unigrams if model else Unigrams.of(*(s := _stats(known, LARGEST + 4))[:2], s[2:])
    hot = model.hot if model else max(1000.0, unigrams.total / parts)
    rows_of = lambda t: list(zip(t["part"].to_pylist(), t["blob"].to_pylist(), strict=True))
    asked = by(payload.unionByName(answers), "chunk", n_chunks).applyInArrow(lambda t: _wire(list(_ask(rows_of(t), t["chunk"][0].as_py(), hot, parts))), _WIRE_SQL)
    if model:
        asked = asked.unionByName(model.ngrams)
    counted = by(asked, "part", parts).applyInArrow(lambda t: _count_ngrams(t, parts, unigrams, fresh), _WIRE_SQL)
    if not answer:
        counted = counted.where(f"chunk < 0 and part < {_HOT}")
    counts, counted_answers = written_apart(counted, "katz-ngrams", f"chunk < 0 and part < {_HOT}")
    del asked, counted, words
    release(spark)  # the plan that was written is gone, and with it what it shuffled
    if not model:
        s = _stats(counts, 2 * (LARGEST + 2))
        model = Model(known.where(F.col("chunk") == _TABLE), counts.where(F.col("chunk") == _TABLE), parts, hot, unigrams, Discounts.of(s[: LARGEST + 2]), Discounts.of(s[LARGEST + 2 :]))
    if not answer:
        return model, None
    everything, hot_words = payload.unionByName(answers).unionByName(counted_answers.where(f"part < {_HOT}")), {}
    sums = counted_answers.where(f"part >= {_HOT}")
    if sums.limit(1).count():
        own_sums, summed = written_apart(by(sums, "part", parts).applyInArrow(_add_up, _WIRE_SQL), "katz-hot", "chunk < 0")
        everything = everything.unionByName(summed)
        for r in own_sums.select("blob").collect():  # hot words: fewer than there are ranges
            b, *found = unpack(r["blob"])
            hot_words |= {int(x): [y.reshape(-1, len(b))[:, i] for y in found] for i, x in enumerate(b)}
    names = [("doc_id", kind), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())]
    schema, d2, d3 = pa.schema(names), model.pairs, model.triples
    out = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return model, by(everything, "chunk", n_chunks).applyInArrow(lambda t: _evaluate(rows_of(t), parts, hot, hot_words, unigrams, d2, d3, schema), out)


def fit(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES, range_bytes: int = RANGE_BYTES) -> Model:
    """A model of all rows of ``docs``."""
    return _run(docs, F.lit(True), None, False, chunk_bytes, range_bytes)[0]


def apply(docs: DataFrame, model: Model, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """doc_id, held_out (true), n_tokens, n_known, train_tokens, base_score and score of every row under a stored model."""
    return _run(docs, F.lit(False), model, True, chunk_bytes, RANGE_BYTES)[1]


def score(docs: DataFrame, train, chunk_bytes: int = CHUNK_BYTES, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The same of every row, by a model of those rows where the boolean column ``train`` is true."""
    return _run(docs, train, None, True, chunk_bytes, range_bytes)[1]
