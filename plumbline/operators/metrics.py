"""Metric contracts: declared measures compiled to DataFrame plans, their algebra, comparison and lifecycle."""

from __future__ import annotations

import math
import re
from collections.abc import Sequence
from dataclasses import dataclass, field, replace
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Aggregates, operators, grains and the ranks of a metric's status.
AGGREGATES = ("sum", "count", "count_distinct", "avg", "min", "max")
OPERATORS = ("=", "!=", ">", ">=", "<", "<=", "in", "not_in", "is_null", "not_null")
GRAINS = ("day", "month", "quarter", "year")
STATUS_RANK = {"deprecated": -1, "candidate": 0, "verified": 1, "certified": 2}
PERIOD, MAX_IN, MAX_DIMENSIONS, MAX_TEXT, TOLERANCE = "期间", 50, 20, 200, 0.01
_IDENTIFIER = re.compile(r"[^\W\d]\w{0,127}", re.U)


@dataclass(frozen=True)
class Filter:
    column: str
    op: str = "="
    value: object = None


@dataclass(frozen=True)
class Contract:
    name: str
    table: str
    agg: str
    column: str | None = None
    filters: tuple[Filter, ...] = ()
    time: str | None = None
    grains: tuple[str, ...] = ()
    dimensions: tuple[str, ...] = ()
    status: str = "candidate"
    evidence: dict = field(default_factory=dict, hash=False)


def scalar(value):
    """A filter's value: booleans become 0 or 1, numbers must be finite, text has 200 characters at most."""
    if isinstance(value, bool):
        return int(value)
    if isinstance(value, (int, float)):
        if not math.isfinite(value):
            raise ValueError("a filter's number must be finite")
        return value
    if isinstance(value, str) and len(value) <= MAX_TEXT:
        return value
    raise ValueError(f"not a filter value: {value!r}")


def validated(c: Contract) -> Contract:
    """The contract with checked names, operators and values; ValueError tells what is wrong."""
    names = [c.table, *([c.column] if c.column else []), *(f.column for f in c.filters), *([c.time] if c.time else []), *c.dimensions]
    for n in names:
        if not _IDENTIFIER.fullmatch(n):
            raise ValueError(f"not an identifier: {n!r}")
    if c.agg not in AGGREGATES:
        raise ValueError(f"unknown aggregate: {c.agg}")
    if c.column is None and c.agg != "count":
        raise ValueError(f"{c.agg} needs a column")
    if set(c.grains) - set(GRAINS) or c.grains and not c.time:
        raise ValueError("grains are day, month, quarter or year of a time column")
    if len(c.dimensions) > MAX_DIMENSIONS or len(set(c.dimensions)) != len(c.dimensions):
        raise ValueError(f"at most {MAX_DIMENSIONS} different dimensions")
    if c.status not in STATUS_RANK:
        raise ValueError(f"unknown status: {c.status}")
    filters = []
    for f in c.filters:
        if f.op not in OPERATORS:
            raise ValueError(f"unknown operator: {f.op}")
        if f.op in ("is_null", "not_null"):
            filters.append(Filter(f.column, f.op))
        elif f.op in ("in", "not_in"):
            values = tuple(scalar(v) for v in f.value)
            if not 1 <= len(values) <= MAX_IN:
                raise ValueError(f"1 to {MAX_IN} values")
            filters.append(Filter(f.column, f.op, values))
        else:
            filters.append(Filter(f.column, f.op, scalar(f.value)))
    return replace(c, filters=tuple(filters))


def predicate(f: Filter) -> Column:
    c = F.col(f.column)
    return {
        "=": lambda: c == f.value, "!=": lambda: c != f.value, ">": lambda: c > f.value, ">=": lambda: c >= f.value, "<": lambda: c < f.value, "<=": lambda: c <= f.value,
        "in": lambda: c.isin(*f.value), "not_in": lambda: ~c.isin(*f.value), "is_null": c.isNull, "not_null": c.isNotNull,
    }[f.op]()


def period(time: str, grain: str) -> Column:
    """A bucket of an ISO date or timestamp as text: 2024-03-05, 2024-03, 2024-Q1 or 2024."""
    text = F.col(time).cast("string")
    if grain == "quarter":
        return F.concat(F.substring(text, 1, 4), F.lit("-Q"), F.expr(f"cast((cast(substring(cast(`{time}` as string), 6, 2) as int) + 2) div 3 as string)"))
    return F.substring(text, 1, {"day": 10, "month": 7, "year": 4}[grain])


def measure(agg: str, column: str | None, when: Column | None = None) -> Column:
    c = F.col(column) if column else F.lit(1)
    if when is not None:
        c = F.when(when, c)
    return {"sum": F.sum, "count": F.count, "count_distinct": F.count_distinct, "avg": F.avg, "min": F.min, "max": F.max}[agg](c)


def compiled(df: DataFrame, contract: Contract, grain: str | None = None, dimensions: Sequence[str] | None = None, order: bool = False) -> DataFrame:
    """Columns: the period (with a grain), the dimensions as given, the metric. Without both: one row.

    Filters stand before the aggregation, so that the scan gets them; only named columns are read."""
    c = validated(contract)
    if grain and grain not in c.grains:
        raise ValueError(f"{c.name} has no grain {grain}")
    dims = list(c.dimensions if dimensions is None else dimensions)
    if set(dims) - set(c.dimensions):
        raise ValueError(f"{c.name} has no dimension {set(dims) - set(c.dimensions)}")
    for f in c.filters:
        df = df.where(predicate(f))
    keys = ([period(c.time, grain).alias(PERIOD)] if grain else []) + [F.col(d) for d in dims]
    out = df.groupBy(*keys).agg(measure(c.agg, c.column).alias(c.name))
    return out.orderBy(*out.columns[:-1]) if order and keys else out


def _literal(v) -> str:
    return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else repr(v)


def _quoted(n: str) -> str:
    return '"' + n.replace('"', '""') + '"'


def to_sql(contract: Contract, grain: str | None = None, dimensions: Sequence[str] | None = None, folded: bool = False) -> str:
    """The contract as ANSI SQL; ``folded`` puts the filters into the aggregate instead of WHERE."""
    c = validated(contract)
    tests = []
    for f in c.filters:
        q = _quoted(f.column)
        tests.append(f"{q} IS {'NOT ' * (f.op == 'not_null')}NULL" if f.op in ("is_null", "not_null") else f"{q} {'NOT ' * (f.op == 'not_in')}IN ({', '.join(map(_literal, f.value))})" if f.op in ("in", "not_in") else f"{q} {'<>' if f.op == '!=' else f.op} {_literal(f.value)}")
    keys = []
    if grain:
        t = f"CAST({_quoted(c.time)} AS VARCHAR)"
        keys.append((f"substr({t}, 1, 4) || '-Q' || CAST((CAST(substr({t}, 6, 2) AS INTEGER) + 2) // 3 AS VARCHAR)" if grain == "quarter" else f"substr({t}, 1, {dict(day=10, month=7, year=4)[grain]})") + f" AS {_quoted(PERIOD)}")
    keys += [_quoted(d) for d in (c.dimensions if dimensions is None else dimensions)]
    arg = _quoted(c.column) if c.column else "1"
    if folded and tests:
        arg = f"CASE WHEN {' AND '.join(tests)} THEN {arg} END"
    agg = f"COUNT(DISTINCT {arg})" if c.agg == "count_distinct" else f"{c.agg.upper()}({arg if c.column or folded and tests else '*'})"
    sql = f"SELECT {', '.join([*keys, f'{agg} AS {_quoted(c.name)}'])} FROM {_quoted(c.table)}"
    if tests and not folded:
        sql += f" WHERE {' AND '.join(tests)}"
    return sql + (f" GROUP BY {', '.join(str(i + 1) for i in range(len(keys)))}" if keys else "")


def missing_columns(df: DataFrame, c: Contract) -> list[str]:
    real = {x.lower() for x in df.columns}
    return [n for n in dict.fromkeys([*([c.column] if c.column else []), *(f.column for f in c.filters), *([c.time] if c.time else []), *c.dimensions]) if n.lower() not in real]


# -- algebra ------------------------------------------------------------------------------------------------

ROLL_UP = {"sum": "additive", "count": "additive", "min": "extreme", "max": "extreme", "avg": "sum_over_count", "count_distinct": "detail_only"}


def cube(df: DataFrame, table_time: str, grain: str, dimensions: Sequence[str], column: str) -> DataFrame:
    """Parts from which all but distinct counts of ``column`` can be rolled up."""
    c = F.col(column)
    return df.groupBy(period(table_time, grain).alias(PERIOD), *dimensions).agg(F.sum(c).alias("part_sum"), F.count(c).alias("part_count"), F.min(c).alias("part_min"), F.max(c).alias("part_max"))


def rolled_up(parts: DataFrame, agg: str, dimensions: Sequence[str], name: str) -> DataFrame:
    """The metric by fewer dimensions, from a cube's parts; a distinct count cannot be had this way."""
    if ROLL_UP[agg] == "detail_only":
        raise ValueError("distinct counts are not additive: compute them from the rows")
    value = {"sum": F.sum("part_sum"), "count": F.sum("part_count"), "min": F.min("part_min"), "max": F.max("part_max"), "avg": F.sum("part_sum") / F.sum("part_count")}[agg]
    return parts.groupBy(*dimensions).agg(value.alias(name))


# -- comparison ---------------------------------------------------------------------------------------------


def _number(v) -> Decimal | None:
    return Decimal(str(v)) if isinstance(v, (int, float, Decimal)) and not isinstance(v, bool) and math.isfinite(v) else None


def same_results(left: dict, right: dict, agg: str = "sum", tolerance: float = TOLERANCE) -> tuple[bool, str]:
    """Do two results {columns, rows, truncated} agree? The last column is the measure, the others are exact.

    Rows are compared as multisets by dimensions; the tolerance is relative to the larger magnitude, absolute
    when the reference is 0; text measures are for min and max only."""
    if not 0 <= tolerance < 1:
        raise ValueError("0 <= tolerance < 1")
    if left.get("truncated") or right.get("truncated"):
        return False, "truncated"
    if not left["rows"] or not right["rows"]:
        return False, "empty"
    if len(left["rows"]) != len(right["rows"]) or len(left["rows"][0]) != len(right["rows"][0]):
        return False, "shape"
    by: list[dict] = []
    for result in (left, right):
        groups: dict = {}
        for row in result["rows"]:
            groups.setdefault(tuple((type(x).__name__, repr(x)) for x in row[:-1]), []).append(row[-1])
        by.append(groups)
    if by[0].keys() != by[1].keys():
        return False, "dimensions"
    for key, values in by[0].items():
        others = by[1][key]
        if len(values) != len(others):
            return False, "dimensions"
        if all(_number(x) is not None for x in (*values, *others)):
            for a, b in zip(sorted(map(_number, values)), sorted(map(_number, others)), strict=True):
                room = Decimal(str(tolerance)) * (max(abs(a), abs(b)) if b else 1)
                if abs(a - b) > room:
                    return False, "value"
        elif agg not in ("min", "max") or sorted(map(repr, values)) != sorted(map(repr, others)):
            return False, "value"
    return True, "equal"


def fetched(df: DataFrame, limit: int = 1000) -> dict:
    """{columns, rows, truncated} of a small result: one row more than the limit tells if it was cut."""
    if not 1 <= limit <= 10_000:
        raise ValueError("1 <= limit <= 10000")
    rows = [tuple(r) for r in df.limit(limit + 1).collect()]
    return {"columns": df.columns, "rows": rows[:limit], "truncated": len(rows) > limit}


def adjudicated(df: DataFrame, c: Contract, value_reference=None, sql_reference: DataFrame | None = None, grain: str | None = None, tolerance: float = TOLERANCE) -> Contract:
    """The contract with machine evidence: verified if it agrees with a reference. A stated value outranks SQL;
    what a person has certified or deprecated stays."""
    if c.status in ("certified", "deprecated"):
        return c
    missing = missing_columns(df, c)
    if missing:
        return replace(c, status="candidate", evidence={"reason": "missing_columns", "columns": missing})
    own = fetched(compiled(df, c, grain))
    if value_reference is not None:
        ok, why = same_results(own, {"rows": [(value_reference,)]}, c.agg, tolerance)
        kind = "value"
    elif sql_reference is not None:
        ok, why = same_results(own, fetched(sql_reference), c.agg, tolerance)
        kind = "sql"
    else:
        return replace(c, status="candidate", evidence={"reason": "no_reference"})
    return replace(c, status="verified" if ok else "candidate", evidence={"reference": kind, "reason": why})


def merged(old: dict[str, Contract], new: Sequence[Contract]) -> dict[str, Contract]:
    """Contracts by name; a person's status is never replaced, and another caliber under the same name stays apart."""
    out = dict(old)
    caliber = lambda c: (c.table, c.agg, c.column, frozenset(c.filters))
    for c in new:
        before = out.get(c.name)
        if before is None:
            out[c.name] = c
        elif caliber(before) != caliber(c):
            out[f"{c.name}#{sum(k.partition('#')[0] == c.name for k in out) + 1}"] = c
        elif before.status in ("certified", "deprecated"):
            out[c.name] = replace(before, evidence={**c.evidence, **before.evidence})
        else:
            out[c.name] = replace(c, evidence={**before.evidence, **c.evidence})
    return out


def audit(contracts: Sequence[Contract]) -> list[dict]:
    """Metrics that nobody should rely on yet, and why."""
    return [{"name": c.name, "status": c.status, "reason": c.evidence.get("reason", "no_evidence")} for c in contracts if STATUS_RANK[c.status] < STATUS_RANK["verified"]]
