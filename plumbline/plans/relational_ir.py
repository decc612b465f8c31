"""The ontology as tables: five DataFrames, two views, triples; merges that never overrule a person."""

from __future__ import annotations

import json
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.metrics import Contract, to_sql
from plumbline.plans.graph import Graph

SCHEMAS = {
    "ont_object": "object string, name string, table_name string, aliases string, description string",
    "ont_attribute": "object string, attribute string",
    "ont_relation": "relation_id int, source string, target string, role string, status string",
    "ont_evidence": "relation_id int, child_key string, parent_key string, detail string",
    "ont_metric": "metric string, table_name string, agg string, column_name string, filters string, status string, sql_text string",
}


def project(spark: SparkSession, g: Graph, metrics: Sequence[Contract] = (), evidence: dict[int, dict] | None = None) -> dict[str, DataFrame]:
    """The five tables; lists become comma-separated text and nested values JSON."""
    rows = {
        "ont_object": [(o, i.get("name", o), i.get("table"), ",".join(i.get("aliases", ())), i.get("description")) for o, i in g.objects.items()],
        "ont_attribute": [(o, a) for o, i in g.objects.items() for a in i.get("attributes", ())],
        "ont_relation": [(n, e.source, e.target, e.role, e.status) for n, e in enumerate(g.edges)],
        "ont_evidence": [(n, e.child_key, e.parent_key, json.dumps((evidence or {}).get(n, {}), ensure_ascii=False, sort_keys=True)) for n, e in enumerate(g.edges)],
        "ont_metric": [(c.name, c.table, c.agg, c.column, json.dumps([[f.column, f.op, f.value] for f in c.filters], ensure_ascii=False, default=list), c.status, to_sql(c)) for c in metrics],
    }
    return {name: spark.createDataFrame(rows[name], schema) for name, schema in SCHEMAS.items()}


def consumable_metrics(metrics: DataFrame) -> DataFrame:
    return metrics.where(F.col("status").isin("verified", "certified") & F.col("sql_text").isNotNull())


def verified_joins(relations: DataFrame, evidence: DataFrame, objects: DataFrame) -> DataFrame:
    """source and target tables with their keys, of verified relations."""
    t = lambda side: objects.select(F.col("object").alias(side), F.col("table_name").alias(f"{side}_table"))
    return relations.where("status = 'verified'").join(evidence, "relation_id").join(t("source"), "source", "left").join(t("target"), "target", "left").select("source_table", "child_key", "target_table", "parent_key", "role")


def triples(tables: dict[str, DataFrame], base: str = "urn:model:") -> DataFrame:
    """s, p, o of the ontology's tables: kinds and names of objects, attributes, and each relation with its ends, keys and status."""
    name = lambda kind, *c: F.concat_ws("", F.lit(f"{base}{kind}/"), *(F.col(x).cast("string") for x in c))
    one = lambda df, s, p, o: df.select(s.alias("s"), F.lit(p).alias("p"), o.alias("o")).where("o is not null")
    obj, att, rel = tables["ont_object"], tables["ont_attribute"], tables["ont_relation"].join(tables["ont_evidence"], "relation_id")
    parts = [
        one(obj, name("object", "object"), "type", F.lit("Object")), one(obj, name("object", "object"), "label", F.col("name")), one(att, name("object", "object"), "attribute", F.col("attribute")),
        one(rel, name("relation", "relation_id"), "type", F.lit("Relation")), one(rel, name("relation", "relation_id"), "from", name("object", "source")), one(rel, name("relation", "relation_id"), "to", name("object", "target")),
        *(one(rel, name("relation", "relation_id"), p, F.col(p)) for p in ("child_key", "parent_key", "status")),
    ]
    return reduce(DataFrame.unionByName, parts)


def n_triples(found: DataFrame, base: str = "urn:model:") -> DataFrame:
    """One line of N-Triples for each triple, as a column ``line``; ends that are no names of the model are literals."""
    plain = reduce(lambda c, x: F.replace(c, F.lit(x[0]), F.lit(x[1])), [("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r")], F.col("o"))
    quoted = F.concat(F.lit('"'), plain, F.lit('"'))
    o = F.when(F.startswith("o", F.lit(base)), F.concat(F.lit("<"), F.col("o"), F.lit(">"))).otherwise(quoted)
    return found.select(F.concat(F.lit("<"), "s", F.lit(f"> <{base}"), "p", F.lit("> "), o, F.lit(" .")).alias("line"))


def relation_view(found: DataFrame) -> DataFrame:
    """relation, source, target and status, from triples: a query over two patterns joined by their subject."""
    of = lambda p, name: found.where(F.col("p") == p).select(F.col("s").alias("relation"), F.col("o").alias(name))
    return of("from", "source").join(of("to", "target"), "relation").join(of("status", "status"), "relation")


def dumped(tables: dict[str, DataFrame]) -> str:
    """CREATE TABLE and INSERT statements, in a stable order."""
    lit = lambda v: "NULL" if v is None else str(v) if isinstance(v, (int, float)) else "'" + str(v).replace("'", "''") + "'"
    out = []
    for name, df in tables.items():
        columns = ", ".join(f"{f.name} {'INTEGER' if f.dataType.simpleString() == 'int' else 'TEXT'}" for f in df.schema.fields)
        out.append(f"CREATE TABLE {name} ({columns});")
        out += [f"INSERT INTO {name} VALUES ({', '.join(map(lit, r))});" for r in sorted(df.collect(), key=repr)]
    return "\n".join(out)


#: Datatypes of the semantic model by a part of the declared type, in the order in which they are tried.
DATATYPES = (("bool", "Boolean"), ("bit", "Boolean"), ("timestamp", "DateTime"), ("datetime", "DateTime"), ("date", "Date"), ("time", "Time"), ("int", "Integer"), ("decimal", "Decimal"), ("numeric", "Decimal"), ("double", "Float"), ("float", "Float"), ("real", "Float"))


def datatype(declared: str) -> str:
    return next((v for k, v in DATATYPES if k in (declared or "").lower()), "String")


def semantic_model(name: str, g: Graph, schema: dict[str, Sequence[tuple[str, str]]], metrics: Sequence[Contract] = ()) -> dict:
    """A plain document of entities with typed fields, strong relationships, and metrics with their filters folded in."""
    entities = [{"name": o, "table": i.get("table", o), "fields": [{"name": c, "datatype": datatype(t)} for c, t in schema.get(i.get("table", o), ())]} for o, i in sorted(g.objects.items())]
    relationships = [{"from": e.source, "to": e.target, "keys": [e.child_key, e.parent_key], "role": e.role} for e in g.edges if e.strong]
    return {"name": name, "entities": entities, "relationships": relationships, "metrics": [{"name": c.name, "sql": to_sql(c, folded=True)} for c in metrics if c.status in ("verified", "certified")]}


def merge_relations(old: DataFrame, new: DataFrame) -> DataFrame:
    """(source, target, role, status, decided_by): new rows replace old ones unless a person decided them."""
    key = ["source", "target", "role"]
    o = old.select(*key, F.col("status").alias("_os"), F.col("decided_by").alias("_od"))
    n = new.select(*key, F.col("status").alias("_ns"), F.col("decided_by").alias("_nd"))
    human = (F.col("_od") == "human") & (F.coalesce(F.col("_nd"), F.lit("")) != "human")
    pick = lambda a, b: F.when(human | F.col("_ns").isNull(), F.col(a)).otherwise(F.col(b))
    return o.join(n, key, "full").select(*key, pick("_os", "_ns").alias("status"), pick("_od", "_nd").alias("decided_by"))


def triple_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(s, p) whose sets of objects differ, with what was removed and added."""
    sets = lambda df, n: df.groupBy("s", "p").agg(F.array_sort(F.collect_set("o")).alias(n))
    none = F.array().cast("array<string>")
    both = sets(old, "a").join(sets(new, "b"), ["s", "p"], "full").select("s", "p", F.coalesce("a", none).alias("a"), F.coalesce("b", none).alias("b"))
    return both.where("a <> b").select("s", "p", F.array_except("a", "b").alias("removed"), F.array_except("b", "a").alias("added"))


def three_way(base: DataFrame, ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """(s, p, merged, conflict): one side's change wins over none; different changes of both are a conflict."""
    sets = lambda df, n: df.groupBy("s", "p").agg(F.array_sort(F.collect_set("o")).alias(n))
    none = F.array().cast("array<string>")
    x = sets(base, "b0").join(sets(ours, "o0"), ["s", "p"], "full").join(sets(theirs, "t0"), ["s", "p"], "full")
    x = x.select("s", "p", *(F.coalesce(f"{c}0", none).alias(c) for c in "bot"))
    return x.select("s", "p", F.when(F.col("o") == F.col("b"), F.col("t")).otherwise(F.col("o")).alias("merged"), ((F.col("o") != F.col("b")) & (F.col("t") != F.col("b")) & (F.col("o") != F.col("t"))).alias("conflict"))
