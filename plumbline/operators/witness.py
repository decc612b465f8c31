"""Arithmetic identities between numeric columns: t = a + b, a - b, b - a, a * b, a / b or b / a.

A few rows drawn at random tell which tests are hopeless: an identity holds in 999 of 1,000 rows, so one that fails in half
of the drawn rows is none. What is left, a handful, is tested on every row in one aggregation of conditional sums,
so a table is scanned twice however many columns it has.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Least rows, most columns, share that must match, relative and absolute tolerance, informative share.
MIN_ROWS, MAX_COLUMNS, MATCH, RELATIVE, ABSOLUTE, INFORMATIVE = 20, 24, 0.999, 1e-6, 0.011, 0.2
#: Rows drawn to rule tests out, and tests of one aggregation.
PROBE, BLOCK = 2_000, 150
_OPS = {"+": "{a} + {b}", "-": "{a} - {b}", "*": "{a} * {b}", "/": "try_divide({a}, {b})"}


def tests(columns: Sequence[str]) -> list[tuple[str, str, str, str]]:
    """(target, a, op, b) of every triple; the target is the triple's last column."""
    out = []
    for a, b, t in combinations(columns, 3):
        out += [(t, a, "+", b), (t, a, "-", b), (t, b, "-", a), (t, a, "*", b), (t, a, "/", b), (t, b, "/", a)]
    return out


def _hopeful(rows: np.ndarray, columns: Sequence[str]) -> list[tuple[str, str, str, str]]:
    """Tests that hold in half of the drawn rows where all three columns are there, or that have too few of these to tell."""
    at = {c: rows[:, i] for i, c in enumerate(columns)}
    out = []
    with np.errstate(all="ignore"):
        for t, a, op, b in tests(columns):
            x, y, want = at[a], at[b], at[t]
            found = {"+": x + y, "-": x - y, "*": x * y, "/": np.where(y == 0, np.nan, x / y)}[op]
            usable = np.isfinite(want) & np.isfinite(found)
            hit = np.abs(want - found) <= np.maximum(RELATIVE * np.maximum(np.abs(want), np.abs(found)), ABSOLUTE)
            if usable.sum() < MIN_ROWS or 2 * hit[usable].sum() >= usable.sum():
                out.append((t, a, op, b))
    return out


def discover(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """target, formula, op, left_input, right_input, n_rows, n_matched of identities that hold; of equivalent ones that
    whose target is the last column.

    Informative rows are those that tell an identity from others: neither input is 0, they differ, and the result is well beyond
    the tolerance. An identity needs as many of them as rows at least, and a fifth of its rows."""
    if len(columns) > MAX_COLUMNS:
        raise ValueError(f"at most {MAX_COLUMNS} columns")
    base = df.select(*(F.col(c).cast("double").alias(c) for c in columns))
    drawn = base.orderBy(F.rand(7)).limit(PROBE).toPandas().to_numpy(float)
    hopeful, found = _hopeful(drawn, columns), []
    for at in range(0, len(hopeful), BLOCK):
        block = hopeful[at : at + BLOCK]
        sums = []
        for i, (t, a, op, b) in enumerate(block):
            q = lambda c: f"`{c}`"
            r = _OPS[op].format(a=q(a), b=q(b))
            ok = f"{q(t)} is not null and {r} is not null"
            hit = f"abs({q(t)} - ({r})) <= greatest({RELATIVE} * greatest(abs({q(t)}), abs({r})), {ABSOLUTE})"
            tells = f"{q(a)} <> 0 and {q(b)} <> 0 and {q(a)} <> {q(b)} and abs({q(t)}) >= {10 * ABSOLUTE}"
            sums += [F.expr(f"count_if({ok})").alias(f"n{i}"), F.expr(f"count_if({ok} and {hit})").alias(f"m{i}"), F.expr(f"count_if({ok} and {tells})").alias(f"i{i}")]
        one = base.agg(*sums)
        cells = [F.struct(F.lit(t).alias("target"), F.lit(f"{a} {op} {b}").alias("formula"), F.lit(op).alias("op"), F.lit(a).alias("left_input"), F.lit(b).alias("right_input"), F.col(f"n{i}").alias("n_rows"), F.col(f"m{i}").alias("n_matched"), F.col(f"i{i}").alias("_tells")) for i, (t, a, op, b) in enumerate(block)]
        found.append(one.select(F.explode(F.array(*cells)).alias("x")).select("x.*"))
    if not found:
        return df.sparkSession.createDataFrame([], "target string, formula string, op string, left_input string, right_input string, n_rows long, n_matched long")
    tells = F.col("_tells") >= F.greatest(F.lit(float(MIN_ROWS)), INFORMATIVE * F.col("n_rows"))
    out = reduce(DataFrame.unionByName, found)
    return out.where((F.col("n_rows") >= MIN_ROWS) & (F.col("n_matched") >= MATCH * F.col("n_rows")) & tells).drop("_tells")


def _said(target: str, op: str, a: str, b: str) -> tuple:
    """What an identity says, whichever of its columns it is solved for: of a sum or product the whole, and its two parts."""
    whole, parts = (target, (a, b)) if op in "+*" else (a, (target, b))
    return "+" if op in "+-" else "*", whole, tuple(sorted(parts))


def supports(formula: str, witnesses: Sequence[dict]) -> dict | None:
    """The witness that says the same as ``target = a op b``: operands in either order, or solved for another column."""
    target, _, expression = (x.strip() for x in formula.partition("="))
    parts = re.fullmatch(r"(\S+)\s*([-+*/])\s*(\S+)", expression)
    said = _said(target, parts[2], parts[1], parts[3]) if parts else None
    return next((w for w in witnesses if said and said == _said(w["target"], w["op"], w["left_input"], w["right_input"])), None)
