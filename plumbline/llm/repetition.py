"""Quality rules from a suffix array: how much of a text repeats, and how long its longest repeat is.

Texts of a batch are turned into word numbers that no two texts share, sorted by prefix doubling in one
suffix array, and measured by its longest common prefixes (LCP). The LCP intervals' labels are the text's
repeated substrings that cannot be prolonged to the right; a suffix's deepest interval has the larger of its two neighbouring LCPs, so
the spans [i, i + that) are their occurrences. Each of these lies within an occurrence of a repeat that cannot be prolonged to either
side, so that the spans' union is the union of the maximal repeats' spans, and the longest of both are the same.

Nulls and texts without words have no words and no repeats, and fail the base rule of 50 words. Rows are
judged one by one: repeated rows and ids get equal verdicts. Other columns are not read.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import slices

_SPACE, _CONTINUATION, _SYMBOLS = b" \t\n\x0b\x0c\r", bytes(range(0x80, 0xC0)), b"#*$%&|<>"
_MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_words", "longest_repeat")


@dataclass(frozen=True)
class Limits:
    """Rejected: under min_words; over max_repeat_percent of words in repeated 3-word windows; over
    max_covered_percent of words in repeats of min_repeat words or more; a repeat of over max_longest words
    that is also over max_longest_percent of the text (a long text may repeat a long passage once) or over
    max_longest_anywhere words. Two separate occurrences cover twice their share, so that max_longest_percent
    says something of its own only below half of max_covered_percent."""

    min_words: int = 50
    max_repeat_percent: int = 50
    min_repeat: int = 6
    max_covered_percent: int = 40
    max_longest: int = 40
    max_longest_percent: int = 15
    max_longest_anywhere: int = 400


def suffix_array(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array of ``ids`` and the LCP of each suffix with the one before it (0 for the first)."""
    n = len(ids)
    sa = np.argsort(ids, kind="stable")
    rank, levels, k = np.empty(n, np.int32), [], 1
    new = np.ones(n, bool)
    new[1:] = ids[sa[1:]] != ids[sa[:-1]]
    rank[sa] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    while True:
        levels.append(rank.copy())
        tied = ~new
        tied[:-1] |= ~new[1:]
        at = np.flatnonzero(tied)  # places in sa whose first k words another suffix shares
        if not len(at):
            break
        own = sa[at]
        after = np.zeros(len(own), np.int64)
        inside = own + k < n
        after[inside] = rank[own[inside] + k].astype(np.int64) + 1
        key = rank[own].astype(np.int64) * (n + 1) + after
        order = np.argsort(key, kind="stable")
        sa[at], key = own[order], key[order]
        fresh = np.ones(len(key), bool)
        fresh[1:] = key[1:] != key[:-1]
        new[at] = fresh
        rank[sa[at]] = np.maximum.accumulate(np.where(fresh, at, 0))
        k *= 2
    lcp = np.zeros(n, np.int64)
    a, b, live = sa[1:].copy(), sa[:-1].copy(), np.arange(1, n)
    live = live[levels[0][a] == levels[0][b]] if n > 1 else live[:0]
    a, b = sa[live].copy(), sa[live - 1].copy()
    for level in range(len(levels) - 1, -1, -1):
        ok = (a < n) & (b < n)
        ok[ok] = levels[level][a[ok]] == levels[level][b[ok]]
        step = ok * (1 << level)
        lcp[live] += step
        a += step
        b += step
    return sa, lcp


def _covered(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + lengths, -1)
    return np.cumsum(edge[:-1]) > 0


def measure(texts: list[bytes | None], min_repeat: int = Limits.min_repeat) -> dict[str, np.ndarray]:
    """The measures of each text, as arrays."""
    out = {k: np.zeros(len(texts), np.int64) for k in _MEASURES}
    ids, base, bounds = [], 0, [0]
    for i, text in enumerate(texts):
        if text:
            found = text.split()
            out["n_words"][i] = len(found)
            out["word_chars"][i] = len(text.translate(None, _SPACE + _CONTINUATION))
            out["n_symbols"][i] = len(text) - len(text.translate(None, _SYMBOLS))
            lines = [x for x in text.split(b"\n") if x and not x.isspace()]
            out["n_dup_lines"][i] = len(lines) - len(set(lines))
            number: dict[bytes, int] = defaultdict(count(base).__next__)
            ids.append(np.fromiter(map(number.__getitem__, found), np.int64, len(found)))
            base += len(number)
        bounds.append(bounds[-1] + int(out["n_words"][i]))
    n = bounds[-1]
    if not n:
        return out
    sa, lcp = suffix_array(np.concatenate(ids))
    longest = np.zeros(n, np.int64)  # of what starts here and occurs again in its text
    longest[sa] = np.maximum(lcp, np.append(lcp[1:], 0))
    three, long = np.flatnonzero(longest >= 3), np.flatnonzero(longest >= min_repeat)
    full = np.flatnonzero(out["n_words"])
    start = np.array(bounds)[full]
    out["n_repeat_words"][full] = np.add.reduceat(_covered(three, np.full(len(three), 3), n).astype(np.int64), start)
    out["covered_words"][full] = np.add.reduceat(_covered(long, longest[long], n).astype(np.int64), start)
    out["longest_repeat"][full] = np.maximum.reduceat(longest, start)
    return out


def verdicts(m: dict[str, np.ndarray], limits: Limits) -> tuple[np.ndarray, np.ndarray]:
    """base_failed and kept."""
    n = m["n_words"]
    failed = (n < limits.min_words) | (100 * m["n_repeat_words"] > limits.max_repeat_percent * n)
    covered = 100 * m["covered_words"] > limits.max_covered_percent * n
    long_here = (100 * m["longest_repeat"] > limits.max_longest_percent * n) | (m["longest_repeat"] > limits.max_longest_anywhere)
    longest = (m["longest_repeat"] > limits.max_longest) & long_here
    return failed, ~(failed | covered | longest)


def in_groups(texts: list[bytes | None], most: int = 2_000_000):
    """(from, to) of consecutive texts with about ``most`` bytes together; a longer text is alone."""
    at, size = 0, 0
    for i, text in enumerate(texts):
        here = len(text or b"")
        if i > at and size + here > most:
            yield at, i
            at, size = i, 0
        size += here
    if at < len(texts):
        yield at, len(texts)


def measured(texts: list[bytes | None], limits: Limits) -> dict[str, np.ndarray]:
    parts = [measure(texts[a:b], limits.min_repeat) for a, b in in_groups(texts)] or [measure([])]
    m = {k: np.concatenate([p[k] for p in parts]) for k in _MEASURES}
    m["base_failed"], m["kept"] = verdicts(m, limits)
    return m


def judge(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """doc_id and the measures, base_failed and kept of each row's text. Map only: nothing is shuffled."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in slices(batches):
            m = measured(batch.column(1).to_pylist(), limits)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(m[k]) for k in (*_MEASURES, "base_failed", "kept"))], names=["doc_id", *_MEASURES, "base_failed", "kept"])

    schema = f"doc_id {kind}, " + ", ".join(f"{k} long" for k in _MEASURES) + ", base_failed boolean, kept boolean"
    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, schema)


def keep(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The rows of ``docs`` whose text is kept, with all their columns."""
    at = docs.columns.index("text")

    def run(batches):
        for batch in slices(batches):
            texts = [None if x is None else x.encode() for x in batch.column(at).to_pylist()]
            yield batch.filter(pa.array(measured(texts, limits)["kept"]))

    return docs.mapInArrow(run, docs.schema)
