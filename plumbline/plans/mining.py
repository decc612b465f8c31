"""Metrics and joins mined from SQL texts, codes and comments; concepts checked against data."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators.metrics import Contract, Filter
from plumbline.plans.structure import ParseError, analyze

_AGG = re.compile(r"\b(sum|count|avg|min|max)\s*\(\s*(distinct\s+)?(\*|[\w.\"`]+)\s*\)(?:\s+as\s+([\w\"`]+|\"[^\"]+\"))?", re.I)
_SIMPLE = re.compile(r"([\w.\"`]+)\s*(=|!=|<>|>=|<=|>|<)\s*('(?:[^']|'')*'|-?\d+(?:\.\d+)?)$|([\w.\"`]+)\s+(not\s+)?in\s*\(([^()]*)\)$|([\w.\"`]+)\s+is\s+(not\s+)?null$", re.I)


def _name(x: str) -> str:
    return x.strip().rpartition(".")[2].strip('"`')


def _literal(x: str):
    x = x.strip()
    return x[1:-1].replace("''", "'") if x.startswith("'") else float(x) if "." in x else int(x)


def filters_of(where: str) -> tuple[Filter, ...] | None:
    """AND-ed simple predicates; None if there is anything else."""
    out = []
    if re.search(r"\bor\b|\bbetween\b|\blike\b|\bselect\b", where, re.I):
        return None
    for part in re.split(r"\s+and\s+", where.strip(), flags=re.I):
        m = _SIMPLE.match(part.strip())
        if not m:
            return None
        if m[1]:
            out.append(Filter(_name(m[1]), "!=" if m[2] == "<>" else m[2], _literal(m[3])))
        elif m[4]:
            out.append(Filter(_name(m[4]), "not_in" if m[5] else "in", tuple(_literal(v) for v in m[6].split(","))))
        else:
            out.append(Filter(_name(m[7]), "not_null" if m[8] else "is_null"))
    return tuple(out)


def mine(sql: str) -> list[Contract]:
    """Metric candidates of a single-table SELECT; joins, subqueries and filters that are not simple give none."""
    try:
        blocks = analyze(sql)
    except ParseError:
        return []
    if len(blocks) != 1 or len(blocks[0].tables) != 1 or not (table := next(iter(blocks[0].tables.values()))):
        return []
    where = re.search(r"\bwhere\b(.*?)(?=\bgroup\s+by\b|\border\s+by\b|\bhaving\b|\blimit\b|$)", sql, re.I | re.S)
    filters = filters_of(where[1]) if where else ()
    if filters is None:
        return []
    group = re.search(r"\bgroup\s+by\b(.*?)(?=\border\s+by\b|\bhaving\b|\blimit\b|$)", sql, re.I | re.S)
    dims = tuple(_name(g) for g in group[1].split(",") if re.fullmatch(r"\s*[\w.\"`]*[A-Za-z_][\w\"`]*\s*", g)) if group else ()
    out = []
    for agg, distinct, column, alias in _AGG.findall(sql):
        kind = "count_distinct" if distinct and agg.lower() == "count" else agg.lower()
        column = None if column == "*" else _name(column)
        out.append(Contract(_name(alias) if alias else f"{kind}_{column or 'rows'}", table, kind, column, filters, dimensions=dims))
    return out


def merged_candidates(found: Sequence[Contract]) -> list[tuple[Contract, int]]:
    """Distinct (table, aggregate, column, filters), with how often each was seen, the most frequent first."""
    groups: dict[tuple, list[Contract]] = {}
    for c in found:
        groups.setdefault((c.table, c.agg, c.column or "", tuple(sorted(map(repr, c.filters)))), []).append(c)
    return [(cs[0], len(cs)) for _, cs in sorted(groups.items(), key=lambda x: (-len(x[1]), x[0]))]


def join_contracts(sql_texts: Sequence[str]) -> list[tuple[str, str, str, str, int]]:
    """(table, column, table, column, times) of equi-joins between real tables in statements."""
    counts: dict[tuple[str, str, str, str], int] = {}
    for sql in sql_texts:
        try:
            blocks = analyze(sql)
        except ParseError:
            continue
        for b in blocks:
            for (qa, ca), (qb, cb) in b.pairs:
                ta, tb = b.tables.get(qa), b.tables.get(qb)
                if ta and tb and qa != qb:
                    (ta, ca), (tb, cb) = sorted([(ta, ca), (tb, cb)])
                    counts[ta, ca, tb, cb] = counts.get((ta, ca, tb, cb), 0) + 1
    return [(*k, n) for k, n in sorted(counts.items(), key=lambda x: (-x[1], x[0]))]


def code_meanings(comment: str) -> dict[str, str]:
    """Codes listed in a column's comment: 状态:0 正常 1 停用, or A=open;B=closed."""
    return {c: t.strip() for c, t in re.findall(r"(?<![\w.])([A-Za-z0-9]{1,8})\s*[:=\-、:]?\s*([一-鿿A-Za-z]{2,20})(?=[\s,;,;。)]|$)", re.sub(r"^[^:(0-9]*[:(:]", "", comment)) if not c.isalpha() or len(c) <= 2 or "=" in comment}


def labelled_confusion(candidates: DataFrame) -> DataFrame:
    """Of labelled relation candidates (truth, status): the confusion of what is called verified."""
    from plumbline.operators.results import confusion

    return confusion(candidates.withColumn("_claim", F.col("status") == "verified"), "truth", "_claim")


def triage(relations: DataFrame) -> DataFrame:
    """Adds decision (reject, defer, review) and priority to candidate relations.

    Columns: overlap, parent_unique, name_ok, child_distinct. Priority: overlap, less where a check fails."""
    factor = lambda c, low: F.when(F.col(c), 1.0).otherwise(low)
    priority = F.round(F.col("overlap") * factor("parent_unique", 0.6) * factor("name_ok", 0.7) * F.when(F.col("child_distinct") >= 3, 1.0).otherwise(0.5), 2)
    decision = F.when((F.col("overlap") < 20) | (~F.col("parent_unique") & ~F.col("name_ok")), "reject").when(F.col("child_distinct") < 3, "defer").otherwise("review")
    return relations.withColumn("decision", decision).withColumn("priority", priority)


def evidence_audit(relations: DataFrame) -> DataFrame:
    """(source, target, issue) of verified relations whose evidence does not bear them out."""
    issues = {
        "no_child_key": F.col("child_key").isNull() | (F.col("child_key") == ""), "no_parent_key": F.col("parent_key").isNull() | (F.col("parent_key") == ""), "no_overlap": F.col("overlap").isNull(), "invalid_overlap": F.isnan("overlap") | (F.col("overlap") < 0) | (F.col("overlap") > 100),
        "low_overlap": F.col("overlap") < 60, "parent_not_unique": ~F.coalesce("parent_unique", F.lit(False)), "incomplete": ~F.coalesce("evidence_complete", F.lit(False)), "single_value": F.col("child_distinct") == 1, "name_mismatch": ~F.coalesce("name_ok", F.lit(True)),
    }
    found = F.filter(F.array(*(F.when(test, F.lit(name)) for name, test in issues.items())), lambda x: x.isNotNull())
    return relations.where("status = 'verified'").select("source", "target", F.explode(found).alias("issue"))


def quality_gate(blocking: int, queue: int) -> str:
    return "fail" if blocking else "review" if queue else "pass"


def channel_verdict(strong_conflicts: int, weak_conflicts: int, support: int) -> str:
    """What cross-checks say of a relation: refuted, review, corroborated or single_channel."""
    if strong_conflicts and strong_conflicts >= support:
        return "refuted"
    if strong_conflicts or weak_conflicts:
        return "review"
    return "corroborated" if support >= 2 else "single_channel"
