"""Business rules as predicates: all rules of a table are counted in one scan, and checked against each other."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPERATORS = (">=", "<=", ">", "<", "==", "!=", "in", "contains", "exists", "missing")
SEVERITIES = ("low", "medium", "high")


@dataclass(frozen=True)
class Condition:
    field: str
    op: str
    value: object = None


@dataclass(frozen=True)
class Rule:
    id: str
    on: str
    when: tuple[Condition, ...]
    decision: str
    action: str = ""
    severity: str = "medium"


def validated(r: Rule) -> Rule:
    if not re.fullmatch(r"[A-Za-z0-9_-]{1,40}", r.id) or not r.on or not r.when or not r.decision:
        raise ValueError(f"a rule has an id, an object, conditions and a decision: {r}")
    if r.severity not in SEVERITIES or any(c.op not in OPERATORS or not c.field for c in r.when):
        raise ValueError(f"unknown severity or operator: {r}")
    return r


def condition(c: Condition) -> Column:
    """Numbers compare as numbers when both sides are, else as text; what cannot be compared is a miss, not an error."""
    col = F.col(c.field)
    text = col.cast("string")
    if c.op == "exists":
        return F.coalesce(text != "", F.lit(False))
    if c.op == "missing":
        return F.coalesce(text == "", F.lit(True))
    if c.op == "contains":
        return F.coalesce(text.contains(str(c.value)), F.lit(False))
    if c.op == "in":
        if isinstance(c.value, str):
            return F.coalesce(F.lit(c.value).contains(text), F.lit(False))
        return F.coalesce(text.isin(*map(str, c.value)) if c.value else F.lit(False), F.lit(False))
    ops = {">=": lambda a, b: a >= b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, "<": lambda a, b: a < b, "==": lambda a, b: a == b, "!=": lambda a, b: a != b}
    compare = ops[c.op]
    try:
        want = float(c.value)
    except (TypeError, ValueError):
        return F.coalesce(compare(text, F.lit(str(c.value))), F.lit(c.op == "!="))
    number = text.try_cast("double")
    other = compare(text, F.lit(str(c.value))) if c.op in ("==", "!=") else F.lit(False)
    return F.coalesce(F.when(number.isNotNull(), compare(number, F.lit(want))).otherwise(other), F.lit(c.op == "!="))


def predicate(r: Rule) -> Column:
    out = F.lit(True)
    for c in validated(r).when:
        out = out & condition(c)
    return out


def hits(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """rule, decision, severity, n_rows and n_hits of every rule, from one scan."""
    sums = df.agg(F.count(F.lit(1)).alias("n_rows"), *(F.count_if(predicate(r)).alias(f"h{i}") for i, r in enumerate(rules)))
    return sums.select(F.explode(F.array(*(F.struct(F.lit(r.id).alias("rule"), F.lit(r.decision).alias("decision"), F.lit(r.severity).alias("severity"), F.col("n_rows"), F.col(f"h{i}").alias("n_hits")) for i, r in enumerate(rules)))).alias("x")).select("x.*")


def fired(df: DataFrame, key: str, rules: Sequence[Rule]) -> DataFrame:
    """(key, rule, decision, action, severity) of rows that a rule catches."""
    cells = [F.when(predicate(r), F.struct(F.lit(r.id).alias("rule"), F.lit(r.decision).alias("decision"), F.lit(r.action).alias("action"), F.lit(r.severity).alias("severity"))) for r in rules]
    return df.select(key, F.explode(F.filter(F.array(*cells), lambda x: x.isNotNull())).alias("x")).select(key, "x.*")


def conflicts(fired_rows: DataFrame, key: str) -> DataFrame:
    """Rows for which rules give one action different decisions; nobody chooses for the business."""
    return fired_rows.where("action <> ''").groupBy(key, "action").agg(F.array_sort(F.collect_set("decision")).alias("decisions"), F.array_sort(F.collect_set("rule")).alias("rules")).where(F.size("decisions") > 1)


def consistency(rules: Sequence[Rule]) -> list[dict]:
    """Repeated ids, and equal conditions with different decisions."""
    issues, by_id, by_condition = [], {}, {}
    for r in rules:
        if r.id in by_id:
            issues.append({"type": "duplicate_id", "rules": [r.id]})
        by_id[r.id] = r
        by_condition.setdefault((r.on, frozenset((c.field, c.op, str(c.value)) for c in r.when)), []).append(r)
    for same in by_condition.values():
        if len({r.decision for r in same}) > 1:
            issues.append({"type": "contradiction", "rules": [r.id for r in same]})
    return issues
