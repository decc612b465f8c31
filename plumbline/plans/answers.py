"""From questions to checked answers: concepts, grounding on data, intent, replay, verdicts applied to relations."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Collection, Sequence
from dataclasses import dataclass, replace
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.wording import date_range, longest_aliases, question_kind
from plumbline.operators import metrics
from plumbline.plans.gates import real_tables
from plumbline.plans.graph import Edge
from plumbline.plans.structure import analyze


@dataclass(frozen=True)
class Concept:
    """Words of the business and the filter that they mean."""

    name: str
    table: str
    filter: metrics.Filter
    aliases: tuple[str, ...] = ()
    status: str = "candidate"
    decided_by: str = "machine"


def filters_for(question: str, concepts: Sequence[Concept], time: str | None, today: date) -> list[metrics.Filter]:
    """Filters of the concepts named in a question, longest alias first, and of its period on the time column."""
    by = {a: c for c in concepts for a in (c.name, *c.aliases)}
    out = list(dict.fromkeys(by[a].filter for a, _ in longest_aliases(question, dict.fromkeys(by, ""))))
    found = date_range(question, today)
    if found and time:
        out += [metrics.Filter(time, ">=", found[0].isoformat()), metrics.Filter(time, "<=", found[1].isoformat())]
    return out


def verified_concepts(tables: dict[str, DataFrame], concepts: Sequence[Concept]) -> list[Concept]:
    """Concepts with status supported (rows match), stale (none do) or unresolved (no such table or column).

    All concepts of a table are counted in one scan; what a person has decided stays."""
    out: dict[Concept, str] = {}
    for t in dict.fromkeys(c.table for c in concepts):
        own = [c for c in concepts if c.table == t]
        real = {x.lower() for x in tables[t].columns} if t in tables else set()
        known = [c for c in own if c.filter.column.lower() in real]
        counts = tables[t].agg(*(F.count_if(metrics.predicate(c.filter)).alias(f"n{i}") for i, c in enumerate(known))).first() if known else ()
        out |= {c: "unresolved" for c in own} | {c: "supported" if n else "stale" for c, n in zip(known, counts, strict=True)}
    return [c if c.decided_by == "human" else replace(c, status=out[c]) for c in concepts]


def merged_concepts(old: Sequence[Concept], new: Sequence[Concept]) -> list[Concept]:
    """By (name, table): later ones win unless a person decided the earlier one."""
    out = {(c.name, c.table): c for c in old}
    for c in new:
        if out.get((c.name, c.table), c).decided_by != "human" or c.decided_by == "human":
            out[c.name, c.table] = c
    return list(out.values())


def grounded_values(tables: dict[str, DataFrame], literals: Collection[str], columns: dict[str, Sequence[str]]) -> DataFrame:
    """(table_name, column_name, value, n): where the literals of a question occur as text values, case apart."""
    spark = next(iter(tables.values())).sparkSession
    wanted = spark.createDataFrame([(x.lower(),) for x in literals], "key string")
    parts = None
    for t, cols in columns.items():
        cells = tables[t].select(F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in cols))).alias("x")).select("x.*")
        part = cells.withColumn("key", F.lower("value")).join(wanted, "key").groupBy(F.lit(t).alias("table_name"), "column_name", "value").agg(F.count(F.lit(1)).alias("n"))
        parts = part if parts is None else parts.unionByName(part)
    return parts


def quoted_basis(statement: str, values: Collection[str]) -> bool:
    """Does a proposed name's reason quote a value that the data has?"""
    quoted = re.findall(r"[「『“\"'`]([^」』”\"'`]{1,60})[」』”\"'`]", statement)
    known = {v.lower() for v in values}
    return any(q.strip().lower() in known for q in quoted)


def intent(question_objects: dict[str, str], sql: str, dimensions: Collection[str] = ()) -> dict:
    """Objects of a question (object: table) that the SQL does not read, tables that it adds, dimensions that it lacks."""
    used = set(real_tables(sql))
    text = sql.lower()
    missing = sorted(o for o, t in question_objects.items() if t not in used)
    lacking = sorted(d for d in dimensions if not re.search(rf"\b{re.escape(d.lower())}\b", text))
    return {"missing": missing, "extra": sorted(used - set(question_objects.values())), "dimensions": lacking, "ok": not missing and not lacking}


def fallback(question: str, tables: dict[str, str]) -> str | None:
    """A count of the one table that a counting question names; None where it names none or several."""
    if not re.search(r"多少|几个|数量|总数|how many|count", question, re.I):
        return None
    found = sorted({t for word, t in tables.items() if word in question})
    return f'SELECT COUNT(*) AS n FROM "{found[0]}"' if len(found) == 1 else None


def parameters(question: str, values: dict[str, Collection[str]]) -> tuple[dict[str, str], list[str]]:
    """Values that a question names, by column; and columns for which it names more than one."""
    found = {c: sorted((v for v in vs if v and v in question), key=len, reverse=True) for c, vs in values.items()}
    found = {c: [v for i, v in enumerate(vs) if not any(v in w for w in vs[:i])] for c, vs in found.items()}
    return {c: vs[0] for c, vs in found.items() if len(vs) == 1}, sorted(c for c, vs in found.items() if len(vs) > 1)


def routed(question: str, solvers: dict[str, Callable[[str], object]]):
    """The deterministic solver of the question's kind, or None to go on to other means."""
    solver = solvers.get(question_kind(question))
    return solver(question) if solver else None


# -- replay and records -------------------------------------------------------------------------------------


def snapshot(spark: SparkSession, statements: dict[str, str]) -> dict[str, str]:
    """A digest of each statement's set of rows, or 'failed'."""
    from plumbline.operators.results import digest

    out = {}
    for name, sql in statements.items():
        try:
            out[name] = digest(spark.sql(sql)).first()["digest"]
        except Exception:  # a statement that fails is a result of a replay, not an error of it
            out[name] = "failed"
    return out


def replayed(before: dict[str, str], after: dict[str, str]) -> dict[str, list[str]]:
    names = sorted(before.keys() | after.keys())
    kind = lambda n: "added" if n not in before else "removed" if n not in after else "same" if before[n] == after[n] else "broken" if after[n] == "failed" else "changed"
    out: dict[str, list[str]] = {}
    for n in names:
        out.setdefault(kind(n), []).append(n)
    return out


def record(results: Sequence[dict], graphs: Sequence[str] = ()) -> dict:
    """Ids of an answer's results and of the answer; the same data and queries give the same ids."""
    from plumbline.operators.results import result_id

    ids = [result_id(r.get("sql", ""), r["columns"], r["rows"]) for r in results]
    return {"answer_id": "a_" + hashlib.sha1(("|".join(ids) + "|" + ",".join(graphs)).encode()).hexdigest()[:12], "results": ids}


def readjudicated(tables: dict[str, DataFrame], contracts: Sequence[metrics.Contract], references: dict[str, object]) -> list[metrics.Contract]:
    """Stored contracts judged again against their value references; unknown tables make them candidates."""
    return [metrics.adjudicated(tables[c.table], c, value_reference=references.get(c.name)) if c.table in tables else replace(c, status="candidate", evidence={"reason": "missing_table"}) for c in contracts]


# -- relations ----------------------------------------------------------------------------------------------


def apply_verdicts(edges: Sequence[Edge], verdicts: dict[tuple[str, str, str], str]) -> list[Edge]:
    """Refuted relations become candidates, relations that valid rows bear out are verified; a person's stay."""
    out = []
    for e in edges:
        v = verdicts.get((e.source, e.target, e.role))
        if e.status in ("asserted", "rejected") or v is None:
            out.append(e)
        elif v == "refuted":
            out.append(replace(e, status="candidate"))
        elif v in ("valid_rows_candidate", "corroborated"):
            out.append(replace(e, status="verified"))
        else:
            out.append(e)
    return out


def join_hints(edges: Sequence[Edge], tables: Sequence[str]) -> list[str]:
    """JOIN lines of strong relations between chosen tables, directly or over one table between them."""
    strong = [e for e in edges if e.strong]
    line = lambda e: f"{e.source} JOIN {e.target} ON {e.source}.{e.child_key} = {e.target}.{e.parent_key}"
    out = [line(e) for e in strong if e.source in tables and e.target in tables]
    for a in strong:
        for b in strong:
            middle = a.target if a.target in (b.source, b.target) else None
            other = b.target if middle == b.source else b.source
            if middle and middle not in tables and a.source in tables and other in tables and a.source < other:
                out += [line(a), line(b)]
    return list(dict.fromkeys(out))


def in_scope(sql: str, allowed: Collection[str]) -> list[str]:
    """Tables that a statement reads beyond the allowed ones, subqueries and CTEs included."""
    return sorted({t for b in analyze(sql) for t in b.tables.values() if t} - set(allowed))


def query_metric(df: DataFrame, contract: metrics.Contract, **how) -> dict:
    """A metric's rows with its status, for callers that ask by name."""
    return {"metric": contract.name, "status": contract.status, **metrics.fetched(metrics.compiled(df, contract, **how))}


