"""Results as values: digests, equality, derived numbers, statistics of evaluations."""

from __future__ import annotations

import hashlib
import itertools
import json
import random
import re
from collections import Counter
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Resamples and seed of the paired bootstrap, decimals of row equality, widest result for column search.
RESAMPLES, SEED, DECIMALS, WIDEST = 2000, 20261116, 6, 12


def digest(df: DataFrame, length: int = 16) -> DataFrame:
    """One row: a hash of the set of rows, whatever their order. Distinct rows' hashes are added and XORed, so
    tasks send on two numbers and a count, however large the result."""
    row = F.xxhash64(F.to_json(F.struct(*(F.col(c).cast("string").alias(c) for c in sorted(df.columns))), {"ignoreNullFields": "false"}))
    sums = df.select(row.alias("h")).distinct().agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.col("h").cast("decimal(20,0)")).alias("s"), F.bit_xor("h").alias("x"))
    return sums.select(F.substring(F.sha1(F.concat_ws(":", F.col("n_rows").cast("string"), F.col("s").cast("string"), F.col("x").cast("string"))), 1, length).alias("digest"), "n_rows")


def exact_digest(df: DataFrame, length: int = 16) -> DataFrame:
    """digest and n_rows of a fetched result: SHA-1 of its distinct rows as text, sorted. It gathers the rows, so it is for
    results that are shown; ``digest`` is for any size."""
    row = F.concat_ws("\x1f", *(F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) for c in sorted(df.columns)))
    rows = df.agg(F.sort_array(F.collect_set(row)).alias("r"))
    return rows.select(F.substring(F.sha1(F.array_join("r", "\n").cast("binary")), 1, length).alias("digest"), F.size("r").cast("long").alias("n_rows"))


def normal(v):
    """A cell for equality: booleans and numbers as rounded floats, numeric text as numbers, other text trimmed."""
    if v is None:
        return None
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, (int, float)):
        return round(float(v), DECIMALS) + 0.0
    text = str(v).strip()
    return normal(float(text)) if re.fullmatch(r"-?\d+(\.\d+)?", text) else text


def equality(gold: tuple[Sequence[str], Sequence[Sequence]], other: tuple[Sequence[str], Sequence[Sequence]]) -> dict[str, bool]:
    """strict: same width and set of rows; columns: some choice of the other's columns gives gold's set of rows."""
    g, o = ({tuple(map(normal, r)) for r in rows} for _, rows in (gold, other))
    wide_g, wide_o = len(gold[0]), len(other[0])
    strict = wide_g == wide_o and g == o
    if strict or not wide_g or not wide_g <= wide_o <= WIDEST:
        return {"strict": strict, "columns": strict}
    values = [{r[j] for r in o} for j in range(wide_o)]
    options = [[j for j in range(wide_o) if values[j] == {r[i] for r in g}] for i in range(wide_g)]
    found = any({tuple(r[j] for j in pick) for r in o} == g for pick in itertools.product(*options) if len({*pick}) == wide_g)
    return {"strict": False, "columns": found}


def equal_frames(a: DataFrame, b: DataFrame) -> bool:
    """The same rows with the same counts, without collecting either side."""
    columns = sorted(a.columns)
    if columns != sorted(b.columns):
        return False
    count = lambda df, n: df.groupBy(*columns).agg(F.count(F.lit(1)).alias(n))
    return not count(a, "n").exceptAll(count(b, "n")).limit(1).count() and not count(b, "n").exceptAll(count(a, "n")).limit(1).count()


def derived_numbers(df: DataFrame, order: str, value: str) -> DataFrame:
    """What a text may say about a column: per row its step, growth and share; and the column's sum, extremes, mean, range. For a
    fetched result: its rows are ordered in one task."""
    w = Window.orderBy(order)
    everything = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    v, before = F.col(value), F.lag(value).over(w)
    return df.select(
        order, v.alias("value"), F.round(v - before, 4).alias("step"), F.round(100 * F.try_divide(v - before, before), 4).alias("growth_percent"), F.round(100 * F.try_divide(v, F.sum(v).over(everything)), 4).alias("share_percent"),
        F.round(F.sum(v).over(everything), 4).alias("total"), F.max(v).over(everything).alias("largest"), F.min(v).over(everything).alias("smallest"), F.round(F.avg(v).over(everything), 4).alias("mean"),
        F.round(F.last(v).over(everything) - F.first(v).over(everything), 4).alias("first_to_last"),
    )


def result_id(sql: str, columns: Sequence[str], rows: Sequence[Sequence]) -> str:
    """Changes whenever the query or its data do."""
    return "r_" + hashlib.sha1(json.dumps([sql, list(columns), [list(r) for r in rows]], ensure_ascii=False, sort_keys=True, default=str).encode()).hexdigest()[:12]


def status(columns: Sequence[str], rows: Sequence[Sequence] | None, error: str | None = None, grouped: bool = False) -> str:
    """data, empty or failed; one row of nulls from an aggregate without GROUP BY is empty."""
    if error or rows is None:
        return "failed"
    if not rows or not grouped and len(rows) == 1 and all(v is None for v in rows[0]):
        return "empty"
    return "data"


def bootstrap(a: Sequence[float], b: Sequence[float], level: float = 0.95) -> dict:
    """Mean difference of paired scores and its percentile interval, the same in every run."""
    d = [float(x) - float(y) for x, y in zip(a, b, strict=False)]
    if not d:
        return {"n": 0, "diff": 0.0, "lo": 0.0, "hi": 0.0}
    draw = random.Random(SEED).randrange
    means = sorted(sum(d[draw(len(d))] for _ in d) / len(d) for _ in range(RESAMPLES))
    k = int((1 - level) / 2 * RESAMPLES)
    return {"n": len(d), "diff": sum(d) / len(d), "lo": means[k], "hi": means[-1 - k]}


def nearest_rank(values: Sequence[float], q: float) -> float | None:
    """The q-quantile by nearest rank."""
    ordered = sorted(values)
    return ordered[max(0, -(-int(q * 1000) * len(ordered) // 1000) - 1)] if ordered else None


def confusion(rows: DataFrame, truth: str, claim: str) -> DataFrame:
    """tp, fp, fn, tn, precision, recall, F1 and leak rate (false among the true negatives) of boolean columns."""
    t, c = F.col(truth), F.col(claim)
    n = rows.agg(F.count_if(t & c).alias("tp"), F.count_if(~t & c).alias("fp"), F.count_if(t & ~c).alias("fn"), F.count_if(~t & ~c).alias("tn"))
    ratio = lambda x, y: F.round(F.coalesce(F.try_divide(x, y), F.lit(0.0)), 4)
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    return n.select("tp", "fp", "fn", "tn", ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), ratio(fp, fp + tn).alias("leak_rate"))


def vote(results: Sequence[Sequence[Sequence]], chooser=None) -> int | None:
    """The index of the result that most agree on; empty results never outvote others; ``chooser`` settles ties."""
    keys = [frozenset(tuple(map(normal, r)) for r in rows) for rows in results]
    if not keys:
        return None
    counts = Counter(k for k in keys if k) or Counter(keys)
    best = max(counts.values())
    ties = [keys.index(k) for k in counts if counts[k] == best]
    return ties[0] if len(ties) == 1 or chooser is None else chooser(ties)


def jaccard(a: set, b: set) -> float:
    return len(a & b) / len(a | b) if a | b else 1.0


# -- numbers in a text --------------------------------------------------------------------------------------

_DATE = re.compile(r"\d{4}[-/年]\d{1,2}(?:[-/月]\d{1,2}日?)?|\d{1,2}月\d{1,2}[日号]?|\d{1,2}:\d{2}(?::\d{2})?")
_NUMBER = re.compile(r"(?<![\w.\-/])(-?\d[\d,]*(?:\.\d+)?)(%?)(?![A-Za-z0-9_/-])\s*([万亿]?)")
_FALL = ("下降", "减少", "降低", "下滑", "下跌", "回落", "亏损", "不足", "缺口", "负")


def numbers_in(text: str) -> list[dict]:
    """Numbers of a text that are worth checking: with decimals, percent or separators, or of 100 or more; dates apart."""
    out = []
    blank = _DATE.sub(lambda m: " " * len(m[0]), text)
    for m in _NUMBER.finditer(blank):
        body, percent, unit = m[1].replace(",", ""), m[2] == "%", {"万": 1e4, "亿": 1e8}.get(m[3], 1.0)
        if "." in body or percent or "," in m[1] or abs(float(body)) >= 100 or unit > 1:
            out.append({"token": m[1] + m[2], "value": float(body) * unit, "decimals": len(body.partition(".")[2]), "unit": unit, "percent": percent, "falls": any(w in blank[max(0, m.start() - 10) : m.end() + 5] for w in _FALL)})
    return out


def check_numbers(text: str, known: Sequence[float]) -> list[dict]:
    """Numbers of the text that no known value explains, at the text's own precision and unit; a fall may be written without its sign."""
    issues = []
    for n in numbers_in(text):
        room = 0.5 * 10 ** -n["decimals"] * n["unit"] + 1e-9 * abs(n["value"])
        if not any(abs(n["value"] - k) <= room or n["falls"] and abs(n["value"] + k) <= room for k in known):
            issues.append({"token": n["token"], "value": n["value"]})
    return issues
