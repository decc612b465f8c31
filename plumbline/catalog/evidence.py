"""Relationship evidence, profiles, witnesses, dependencies, governance of SQL, metadata graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import names
from plumbline.operators import keys, profile, results, witness
from plumbline.plans import gates, mining
from plumbline.plans import graph as graphs
from plumbline.plans import relational_ir as ir
from plumbline.registry import query

# -- keys ---------------------------------------------------------------------------------------------------


def _uniques(table: str, columns: list[str]) -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) AS n_rows, count(DISTINCT {c}) AS n_distinct, count(DISTINCT {c}) = count(*) AS is_key FROM {table}" for c in columns)


for _table, _columns in {"orders": ["o_orderkey", "o_custkey", "o_orderstatus"], "lineitem": ["l_orderkey", "l_linenumber", "l_suppkey"], "part": ["p_partkey", "p_name", "p_brand"], "documents": ["doc_id", "source"], "conversations": ["conv_id", "turn"]}.items():
    query(f"A5_uniqueness_{_table}", _uniques(_table, _columns))(lambda t, n=_table, c=_columns: keys.uniqueness(t(n), c))


@query("A19_instance_split", "SELECT count(*) AS n_rows, count(DISTINCT l_orderkey) AS n_keys, count(DISTINCT (l_linenumber, l_orderkey)) AS n_scoped, count(DISTINCT l_orderkey) = count(*) AS key_unique, count(DISTINCT (l_linenumber, l_orderkey)) = count(*) AS scoped_unique FROM lineitem")
def _(t):
    return keys.scoped_uniqueness(t("lineitem"), "l_orderkey", "l_linenumber")


@query("A20_discriminators", "SELECT count(DISTINCT event_type) AS kinds, count(DISTINCT (event_type, user_id)) AS pairs, count(DISTINCT event_type) BETWEEN 2 AND 12 AS usable FROM events")
def _(t):
    return t("events").agg(F.count_distinct("event_type").alias("kinds"), F.count_distinct(F.struct("event_type", "user_id")).alias("pairs")).select("kinds", "pairs", F.col("kinds").between(2, 12).alias("usable"))


@query("A17_version_duplicates", "SELECT count(*) AS n_rows, count(DISTINCT k) AS n_keys, count(DISTINCT k) < count(*) AND count(DISTINCT k) >= 0.95 * count(*) AS versioned FROM (SELECT o_orderkey AS k FROM orders UNION ALL SELECT o_orderkey FROM orders WHERE o_totalprice > 480000)")
def _(t):
    o = t("orders").select(F.col("o_orderkey").alias("k"), "o_totalprice")
    return keys.version_duplicates(o.unionByName(o.where("o_totalprice > 480000")), "k")


@query("A18_name_stability", "SELECT round(avg(CASE WHEN n = 1 THEN 1.0 ELSE 0.0 END), 6) AS stable_share, count(*) AS n_keys FROM (SELECT p_name, count(DISTINCT p_brand) AS n FROM part GROUP BY p_name HAVING count(*) > 1)")
def _(t):
    per = t("part").groupBy("p_name").agg(F.count_distinct("p_brand").alias("n"), F.count(F.lit(1)).alias("rows")).where("rows > 1")
    return per.agg(F.round(F.avg(F.when(F.col("n") == 1, 1.0).otherwise(0.0)), 6).alias("stable_share"), F.count(F.lit(1)).alias("n_keys"))


_ALIASED = {
    "orders": {"o_orderkey": "order_id", "o_custkey": "customer_id", "o_orderstatus": "status"},
    "customer": {"c_custkey": "customer_id", "c_nationkey": "nation_id", "c_name": "name"},
    "lineitem": {"l_orderkey": "order_id", "l_partkey": "part_id", "l_suppkey": "supplier_id", "l_linenumber": "line_no"},
    "part": {"p_partkey": "part_id", "p_brand": "brand"},
    "supplier": {"s_suppkey": "supplier_id", "s_nationkey": "nation_id"},
    "nation": {"n_nationkey": "nation_id", "n_regionkey": "region_id"},
    "region": {"r_regionkey": "region_id", "r_name": "name"},
}


def _aliased(t):
    return {n: t(n).select(*(F.col(a).alias(b) for a, b in cols.items())) for n, cols in _ALIASED.items()}


_KEYS = {"orders": ["order_id"], "customer": ["customer_id"], "part": ["part_id"], "supplier": ["supplier_id"], "nation": ["nation_id"], "region": ["region_id"]}
CANDIDATES = sorted(names.candidates({n: list(c.values()) for n, c in _ALIASED.items()}, _KEYS)[0]) + [("customer", "customer_id", "part", "part_id"), ("region", "region_id", "supplier", "supplier_id")]


def _raw(table: str, alias: str) -> str:
    return next(a for a, b in _ALIASED[table].items() if b == alias)


def _evidence_sql() -> str:
    one = """SELECT '{ct}' AS child, '{ck}' AS child_key, '{pt}' AS parent, '{pk}' AS parent_key,
      100.0 * (SELECT count(*) FROM (SELECT {rc} FROM {ct} INTERSECT SELECT {rp} FROM {pt})) / (SELECT count(DISTINCT {rc}) FROM {ct}) AS overlap, (SELECT count(DISTINCT {rc}) FROM {ct}) AS child_distinct,
      (SELECT count(DISTINCT {rp}) FROM {pt}) = (SELECT count(*) FROM {pt}) AS parent_unique"""
    return " UNION ALL ".join(one.format(ct=ct, ck=ck, pt=pt, pk=pk, rc=_raw(ct, ck), rp=_raw(pt, pk)) for ct, ck, pt, pk in CANDIDATES)


def _judged(t):
    ok = F.create_map(*(F.lit(x) for ct, ck, pt, pk in CANDIDATES for x in (f"{ct}.{ck}>{pt}.{pk}", names.compatible(ck, pt, pk, ct))))
    own = F.concat_ws("", "child", F.lit("."), "child_key", F.lit(">"), "parent", F.lit("."), "parent_key")
    return keys.verdicts(keys.batched_signals(_aliased(t), CANDIDATES), ok[own])


@query("E1_E6_batched_evidence", f"SELECT child, child_key, parent, parent_key, round(overlap, 6) AS overlap, child_distinct, parent_unique FROM ({_evidence_sql()})")
def _(t):
    return keys.batched_signals(_aliased(t), CANDIDATES).select("child", "child_key", "parent", "parent_key", F.round("overlap", 6).alias("overlap"), "child_distinct", "parent_unique")


#: The name rule in SQL, for keys of one column and tables that no role or calendar word names: equal words before the key's end, or one the beginning of the
#: other, or the longer one ending in a name of several words or of six letters; never ids against numbers or codes, nor a table's own identifier.
NAMED_SQL = r"""SELECT child, child_key, parent, parent_key, child_key = parent_key OR cs = ps AND NOT unlike OR NOT unlike AND NOT own
    AND (length(least_) >= 3 AND starts_with(most_, least_) OR (contains(least_, '_') OR length(least_) >= 6) AND ends_with(most_, '_' || least_)) AS named
  FROM (SELECT *, CASE WHEN length(cs) <= length(ps) THEN cs ELSE ps END AS least_, CASE WHEN length(cs) <= length(ps) THEN ps ELSE cs END AS most_,
      ce <> pe AND 'id' IN (ce, pe) AND (ce IN ('no', 'code') OR pe IN ('no', 'code')) AS unlike, cs = child AND child <> parent AS own
    FROM (SELECT *, regexp_replace(child_key, '_(id|code|key|no|num)$', '') AS cs, regexp_replace(parent_key, '_(id|code|key|no|num)$', '') AS ps,
        regexp_extract(child_key, '_(id|code|key|no|num)$', 1) AS ce, regexp_extract(parent_key, '_(id|code|key|no|num)$', 1) AS pe
      FROM (VALUES {}) AS v(child, child_key, parent, parent_key)))"""


def named_sql(candidates) -> str:
    return NAMED_SQL.replace("{}", ", ".join(str(tuple(c)) for c in candidates))


@query("E2_verdicts", f"""WITH e AS ({_evidence_sql()}), n AS ({named_sql(CANDIDATES)})
  SELECT child, child_key, parent, parent_key, CASE WHEN child_distinct < 3 THEN 'drop' WHEN overlap >= 60 AND parent_unique AND named THEN 'verified' WHEN overlap >= 20 THEN 'candidate' ELSE 'drop' END AS status FROM e JOIN n USING (child, child_key, parent, parent_key)""")
def _(t):
    return _judged(t).select("child", "child_key", "parent", "parent_key", "status")


@query("E3_adaptive", f"WITH e AS ({_evidence_sql()}) SELECT child, child_key, parent, parent_key, overlap >= CASE WHEN child_distinct >= 50 THEN 50.0 ELSE 60.0 END AS passes FROM e")
def _(t):
    e = keys.batched_signals(_aliased(t), CANDIDATES)
    return e.select("child", "child_key", "parent", "parent_key", (F.col("overlap") >= keys.adaptive_threshold(F.col("child_distinct"))).alias("passes"))


@query("E4_direction", "SELECT a, b, CASE WHEN ua AND NOT ub THEN 'b->a' WHEN ub AND NOT ua THEN 'a->b' WHEN ua AND ub THEN 'ambiguous' ELSE 'none' END AS direction FROM (SELECT 'orders.o_custkey' AS a, 'customer.c_custkey' AS b, (SELECT count(DISTINCT o_custkey) = count(*) FROM orders) AS ua, (SELECT count(DISTINCT c_custkey) = count(*) FROM customer) AS ub UNION ALL SELECT 'customer.c_custkey', 'part.p_partkey', (SELECT count(DISTINCT c_custkey) = count(*) FROM customer), (SELECT count(DISTINCT p_partkey) = count(*) FROM part))")
def _(t):
    pairs = [("orders", "o_custkey", "customer", "c_custkey"), ("customer", "c_custkey", "part", "p_partkey")]
    e = keys.batched_signals({n: t(n) for n in ("orders", "customer", "part")}, pairs)
    return e.select(F.concat_ws(".", "child", "child_key").alias("a"), F.concat_ws(".", "parent", "parent_key").alias("b"), keys.direction(F.col("child_unique"), F.col("parent_unique")).alias("direction"))


@query("E9_name_channel", "SELECT count(*) AS n_pairs, round(avg(CASE WHEN lower(n_name) = lower(nation_name) THEN 1.0 ELSE 0.0 END), 4) AS agree FROM (SELECT DISTINCT c_nationkey, upper(n_name) AS nation_name FROM customer JOIN nation x ON x.n_nationkey = c_nationkey) JOIN nation ON n_nationkey = c_nationkey")
def _(t):
    n = t("nation")
    child = t("customer").join(n, F.col("n_nationkey") == F.col("c_nationkey")).select("c_nationkey", F.upper("n_name").alias("nation_name")).distinct()
    j = child.join(n, F.col("n_nationkey") == F.col("c_nationkey"))
    return j.agg(F.count(F.lit(1)).alias("n_pairs"), F.round(F.avg(F.when(F.lower("n_name") == F.lower("nation_name"), 1.0).otherwise(0.0)), 4).alias("agree"))


@query("E10_valid_rows", "SELECT count(*) AS n_rows, count(DISTINCT p_name) AS n_keys, count(DISTINCT p_name) = count(*) AS now_unique FROM (SELECT * FROM part QUALIFY row_number() OVER (PARTITION BY p_name ORDER BY p_size DESC, p_partkey DESC) = 1)")
def _(t):
    kept = keys.latest(t("part"), "p_name", "p_size", "p_partkey")
    return kept.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("p_name").alias("n_keys")).withColumn("now_unique", F.col("n_rows") == F.col("n_keys"))


@query("E13_triage", f"""WITH e AS ({_evidence_sql()}), n AS ({named_sql(CANDIDATES)})
  SELECT child, child_key, parent, parent_key, CASE WHEN overlap < 20 OR NOT parent_unique AND NOT named THEN 'reject' WHEN child_distinct < 3 THEN 'defer' ELSE 'review' END AS decision,
  round(overlap * CASE WHEN parent_unique THEN 1.0 ELSE 0.6 END * CASE WHEN named THEN 1.0 ELSE 0.7 END * CASE WHEN child_distinct >= 3 THEN 1.0 ELSE 0.5 END, 2) AS priority FROM e JOIN n USING (child, child_key, parent, parent_key)""")
def _(t):
    ok = F.create_map(*(F.lit(x) for ct, ck, pt, pk in CANDIDATES for x in (f"{ct}.{ck}>{pt}.{pk}", names.compatible(ck, pt, pk, ct))))
    own = F.concat_ws("", "child", F.lit("."), "child_key", F.lit(">"), "parent", F.lit("."), "parent_key")
    e = keys.batched_signals(_aliased(t), CANDIDATES).withColumn("name_ok", ok[own])
    return mining.triage(e).select("child", "child_key", "parent", "parent_key", "decision", "priority")


@query("E14_evidence_audit")
def _(t):
    """All candidates as if they were verified, with faults planted: a key, an overlap and a complete count are missing."""
    e = _judged(t).withColumn("name_ok", F.col("reason") != "name_mismatch").withColumns({"status": F.lit("verified"), "child_key": F.when(F.col("child") != "region", F.col("child_key")), "evidence_complete": F.col("child") != "supplier"})
    ok = F.create_map(*(F.lit(x) for ct, ck, pt, pk in CANDIDATES for x in (f"{ct}>{pt}.{pk}", names.compatible(ck, pt, pk, ct))))
    e = e.withColumns({"overlap": F.when(F.col("child") != "nation", F.col("overlap")), "name_ok": ok[F.concat_ws("", "child", F.lit(">"), "parent", F.lit("."), "parent_key")]})
    return mining.evidence_audit(e.withColumnRenamed("child", "source").withColumnRenamed("parent", "target"))


@query("E12_A13_outlier_codes", "WITH d AS (SELECT n_regionkey AS category, CASE WHEN c_custkey % 29 = 0 THEN 'ODD' ELSE r_name END AS v FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey), n AS (SELECT category, v, count(*) AS n FROM d GROUP BY ALL), e AS (SELECT category, min_by(v, (-n, v)) AS expected FROM n GROUP BY category HAVING sum(n) >= 10 AND max(n) >= 0.8 * sum(n)) SELECT category, expected, v AS outlier, n FROM n JOIN e USING (category) WHERE v <> expected")
def _(t):
    d = t("customer").join(t("nation"), F.col("n_nationkey") == F.col("c_nationkey")).join(t("region"), F.col("r_regionkey") == F.col("n_regionkey"))
    return keys.outliers(d.select("n_regionkey", F.when(F.col("c_custkey") % 29 == 0, "ODD").otherwise(F.col("r_name")).alias("v")), "n_regionkey", "v")


@query("A13_dependency", "WITH n AS (SELECT p_brand AS category, p_type AS v, count(*) AS n FROM part GROUP BY ALL) SELECT category, min_by(v, (-n, v)) AS expected, CAST(sum(n) AS BIGINT) AS n_rows, max(n) AS kept, round(max(n) / sum(n), 3) AS support, sum(n) >= 10 AND max(n) >= 0.8 * sum(n) AS dominant FROM n GROUP BY category")
def _(t):
    return keys.functional_dependency(t("part"), "p_brand", "p_type")


@query("A15_codebook_cover", "WITH v AS (SELECT trim(x) AS v FROM (SELECT unnest(string_split(lang || ',' || substr(source, 1, 4), ',')) AS x FROM documents) WHERE trim(x) <> '') SELECT count(*) AS n_values, count(DISTINCT v) AS n_distinct, count(*) FILTER (WHERE v IN ('en', 'de', 'fr', 'es', 'src1')) AS n_known, round(count(*) FILTER (WHERE v IN ('en', 'de', 'fr', 'es', 'src1')) / count(*), 3) AS cover FROM v")
def _(t):
    d = t("documents").select(F.concat_ws(",", "lang", F.substring("source", 1, 4)).alias("codes"))
    book = d.sparkSession.createDataFrame([(c,) for c in ("en", "de", "fr", "es", "src1")], "code string")
    return keys.codebook_cover(d, "codes", book, "code")


@query("A16_category_split", "SELECT round(count(*) FILTER (WHERE k IS NOT NULL) / count(*), 4) AS cover, max(rows_per_code) AS most_rows FROM customer LEFT JOIN (SELECT n_nationkey AS k, count(*) AS rows_per_code FROM nation GROUP BY 1) ON k = c_nationkey")
def _(t):
    n = t("nation").groupBy(F.col("n_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("rows_per_code"))
    return t("customer").join(n, F.col("k") == F.col("c_nationkey"), "left").agg(F.round(F.count("k") / F.count(F.lit(1)), 4).alias("cover"), F.max("rows_per_code").alias("most_rows"))


# -- profiles -----------------------------------------------------------------------------------------------


def _profile_sql(table: str, columns: dict[str, bool]) -> str:
    one = """SELECT '{c}' AS column_name, count(*) AS n_rows, count(*) - count({c}) AS n_nulls, round((count(*) - count({c})) / count(*), 4) AS null_rate, count(DISTINCT {c}) AS n_distinct, round(coalesce(count(DISTINCT {c}) / nullif(count({c}), 0), 0), 4) AS distinct_rate,
      {low} AS min_number, {high} AS max_number, {mean} AS mean_number, min(length(CAST({c} AS VARCHAR))) AS min_length, max(length(CAST({c} AS VARCHAR))) AS max_length, round(avg(length(CAST({c} AS VARCHAR))), 4) AS mean_length,
      CASE WHEN count({c}) = 0 THEN 'all_null' WHEN count(DISTINCT {c}) = 1 THEN 'constant' WHEN count(DISTINCT {c}) / count({c}) >= 0.95 THEN 'near_unique' WHEN count(DISTINCT {c}) <= 20 OR count(DISTINCT {c}) / count({c}) <= 0.01 THEN 'low_cardinality' ELSE 'high_cardinality' END AS class FROM {t}"""
    number = lambda c, n: {"low": f"CAST(min({c}) AS DOUBLE)", "high": f"CAST(max({c}) AS DOUBLE)", "mean": f"round(avg({c}), 4)"} if n else dict.fromkeys(("low", "high", "mean"), "CAST(NULL AS DOUBLE)")
    return " UNION ALL ".join(one.format(c=c, t=table, **number(c, n)) for c, n in columns.items())


for _table, _columns in {"part": {"p_partkey": True, "p_size": True, "p_brand": False, "p_name": False}, "customer": {"c_nationkey": True, "c_mktsegment": False, "c_name": False}, "documents": {"doc_id": True, "lang": False, "source": False, "n_chars": True}}.items():
    query(f"A9_A10_profile_{_table}", _profile_sql(_table, _columns))(lambda t, n=_table, c=tuple(_columns): profile.columns_profile(t(n), c))


@query("A9_top_values", " UNION ALL ".join(f"SELECT * FROM (SELECT '{c}' AS column_name, CAST(row_number() OVER (ORDER BY count(*) DESC, CAST({c} AS VARCHAR)) AS INTEGER) AS rank, CAST({c} AS VARCHAR) AS value, count(*) AS n, round(count(*) / (SELECT count(*) FROM part WHERE {c} IS NOT NULL), 4) AS share FROM part WHERE {c} IS NOT NULL GROUP BY {c}) WHERE rank <= 5" for c in ("p_brand", "p_type", "p_size")))
def _(t):
    return profile.top_values(t("part"), ["p_brand", "p_type", "p_size"])


@query("A8_blank_rates", " UNION ALL ".join(f"SELECT '{c}' AS column_name, round(avg(CASE WHEN {c} IS NULL OR trim({c}) = '' THEN 1.0 ELSE 0.0 END), 4) AS blank_rate FROM {t}" for t, c in (("documents", "lang"), ("documents", "text"))))
def _(t):
    return profile.blank_rates(t("documents"), ["lang", "text"])


@query("A7_name_catalogue", "SELECT event_type AS name, count(*) AS n_rows, count(DISTINCT user_id) AS n_entities, min(value) AS min_value, round(median(value), 4) AS median_value, max(value) AS max_value FROM events GROUP BY 1")
def _(t):
    return profile.name_catalogue(t("events"), "event_type", "value", "user_id")


@query("A7_names_per_entity", "SELECT min(k) AS min_names, CAST(median(k) AS DOUBLE) AS median_names, max(k) AS max_names, count(*) AS n_entities FROM (SELECT user_id, count(DISTINCT event_type) AS k FROM events GROUP BY 1)")
def _(t):
    return profile.names_per_entity(t("events"), "event_type", "user_id")


@query("E19_value_index", " UNION ".join(f"SELECT '{c}' AS column_name, lower({c}) AS value FROM part WHERE length({c}) BETWEEN 3 AND 60" for c in ("p_brand", "p_type", "p_name")))
def _(t):
    return profile.value_index(t("part"), ["p_brand", "p_type", "p_name"])


# -- witnesses ----------------------------------------------------------------------------------------------


@query("A11_witness")
def _(t):
    li = t("lineitem").select("l_extendedprice", (1 - F.col("l_discount")).alias("keep"), (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("disc_price"), (1 + F.col("l_tax")).alias("gross"), (F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))).alias("charge"))
    found = witness.discover(li, li.columns)
    return found.where("op = '*'").select("target", "formula", "op", "n_rows", "n_matched")


# -- governance ---------------------------------------------------------------------------------------------

RELATIONS = (
    gates.Relation("orders", "customer", "o_custkey", "c_custkey"), gates.Relation("lineitem", "orders", "l_orderkey", "o_orderkey"), gates.Relation("lineitem", "part", "l_partkey", "p_partkey"), gates.Relation("lineitem", "supplier", "l_suppkey", "s_suppkey"),
    gates.Relation("customer", "nation", "c_nationkey", "n_nationkey"), gates.Relation("supplier", "nation", "s_nationkey", "n_nationkey"), gates.Relation("nation", "region", "n_regionkey", "r_regionkey"),
)

#: (statement, accepted)
STATEMENTS = (
    ("SELECT c_mktsegment, SUM(o_totalprice) FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1", True),
    ("SELECT SUM(c.c_acctbal) FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey", False),
    ("SELECT SUM(o.o_totalprice) FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey", False),
    ("SELECT COUNT(DISTINCT o.o_orderkey), SUM(l.l_quantity) FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey", True),
    ("SELECT COUNT(*) FROM nation n JOIN customer c ON c.c_nationkey = n.n_nationkey JOIN supplier s ON s.s_nationkey = n.n_nationkey", False),
    ("SELECT 1 FROM orders o JOIN part p ON o.o_custkey = p.p_partkey", False),
    ("DELETE FROM orders", False),
    ("SELECT 1; SELECT 2", False),
    ("WITH s AS (SELECT o_custkey, SUM(o_totalprice) AS t FROM orders GROUP BY o_custkey) SELECT SUM(s.t), MAX(c.c_acctbal) FROM customer c JOIN s ON s.o_custkey = c.c_custkey", True),
)


@query("Q1_Q6_gates", "SELECT * FROM (VALUES " + ", ".join(f"({i}, {str(ok).lower()})" for i, (_, ok) in enumerate(STATEMENTS)) + ") v(statement, accepted)")
def _(t):
    schema = {n: [c.lower() for c in t(n).columns] for n in ("orders", "customer", "lineitem", "part", "supplier", "nation", "region")}
    rows = [(i, gates.check_sql(sql, RELATIONS, set(schema), schema).ok) for i, (sql, _) in enumerate(STATEMENTS)]
    return t("region").sparkSession.createDataFrame(rows, "statement int, accepted boolean")


@query("Q9_checked_answer", "SELECT c_mktsegment, round(SUM(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def _(t):
    sql = "SELECT c_mktsegment, round(SUM(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1"
    verdict = gates.check_sql(sql, RELATIONS)
    if not verdict.ok:
        raise ValueError("; ".join(verdict.reasons))
    return t("orders").sparkSession.sql(sql.replace("FROM orders", "FROM {orders}").replace("JOIN customer", "JOIN {customer}"), orders=t("orders"), customer=t("customer"))


@query("Q13_U10_mined_metrics")
def _(t):
    found = mining.merged_candidates([c for s in ("SELECT sum(o_totalprice) AS revenue FROM orders WHERE o_orderstatus = 'F'", "SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY o_orderpriority", "SELECT sum(o_totalprice) FROM orders WHERE o_orderstatus = 'F'") for c in mining.mine(s)])
    return t("region").sparkSession.createDataFrame([(c.table, c.agg, c.column, len(c.filters), n) for c, n in found], "table_name string, agg string, column_name string, n_filters int, seen int")


# -- metadata -----------------------------------------------------------------------------------------------


def ontology() -> graphs.Graph:
    g = graphs.Graph({n: {"table": n, "attributes": list(c.values())} for n, c in _ALIASED.items()})
    g.edges = [graphs.Edge(r.child, r.parent, "", r.status, r.child_key, r.parent_key) for r in RELATIONS]
    return g


@query("K1_K3_verified_joins")
def _(t):
    tables = ir.project(t("region").sparkSession, ontology())
    return ir.verified_joins(tables["ont_relation"], tables["ont_evidence"], tables["ont_object"])


@query("K2_consumable_metrics")
def _(t):
    from plumbline.operators.metrics import Contract

    metrics = [Contract("revenue", "orders", "sum", "o_totalprice", status="certified"), Contract("orders", "orders", "count", status="verified"), Contract("draft", "orders", "count")]
    return ir.consumable_metrics(ir.project(t("region").sparkSession, ontology(), metrics)["ont_metric"]).select("metric", "status")


@query("G1_path")
def _(t):
    edges, strong = graphs.path(ontology().edges, "lineitem", "region")
    return t("region").sparkSession.createDataFrame([(i, e.source, e.target, strong) for i, e in enumerate(edges)], "step int, source string, target string, strong boolean")


@query("G4_degrees", "SELECT o AS object, count(*) AS degree FROM (SELECT unnest([source, target]) AS o FROM (VALUES " + ", ".join(f"('{r.child}', '{r.parent}')" for r in RELATIONS) + ") v(source, target)) GROUP BY o")
def _(t):
    r = ir.project(t("region").sparkSession, ontology())["ont_relation"]
    return r.select(F.explode(F.array("source", "target")).alias("object")).groupBy("object").agg(F.count(F.lit(1)).alias("degree"))


@query("G5_modules")
def _(t):
    return t("region").sparkSession.createDataFrame([(m, o) for m, objects in graphs.modules(ontology()).items() for o in objects], "module string, object string")


@query("G6_dimensions")
def _(t):
    return t("region").sparkSession.createDataFrame([(d["object"], d["via"], d["fan_out"]) for d in graphs.dimensions(ontology(), "orders")], "object string, via string, fan_out boolean")


@query("U8_merge_relations")
def _(t):
    spark, s = t("region").sparkSession, "source string, target string, role string, status string, decided_by string"
    old = spark.createDataFrame([("a", "b", "", "rejected", "human"), ("c", "d", "", "candidate", "machine")], s)
    new = spark.createDataFrame([("a", "b", "", "verified", "machine"), ("c", "d", "", "verified", "machine"), ("e", "f", "", "candidate", "machine")], s)
    return ir.merge_relations(old, new)


@query("U7_triple_changes")
def _(t):
    spark, s = t("region").sparkSession, "s string, p string, o string"
    d = ir.triple_changes(spark.createDataFrame([("a", "p", "x"), ("a", "p", "y"), ("b", "p", "q")], s), spark.createDataFrame([("a", "p", "y"), ("a", "p", "z"), ("b", "p", "q")], s))
    return d.select("s", "p", F.array_join("removed", ",").alias("removed"), F.array_join("added", ",").alias("added"))


@query("A27_confusion", f"""WITH e AS ({_evidence_sql()}), n AS ({named_sql(CANDIDATES)}), l AS (SELECT child_key = parent_key AND child <> parent AS truth, child_distinct >= 3 AND overlap >= 60 AND parent_unique AND named AS claim FROM e JOIN n USING (child, child_key, parent, parent_key)),
  c AS (SELECT count(*) FILTER (WHERE truth AND claim) AS tp, count(*) FILTER (WHERE NOT truth AND claim) AS fp, count(*) FILTER (WHERE truth AND NOT claim) AS fn, count(*) FILTER (WHERE NOT truth AND NOT claim) AS tn FROM l)
  SELECT *, round(coalesce(tp / nullif(tp + fp, 0), 0), 4) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 4) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 4) AS f1, round(coalesce(fp / nullif(fp + tn, 0), 0), 4) AS leak_rate FROM c""")
def _(t):
    e = _judged(t).select(((F.col("child_key") == F.col("parent_key")) & (F.col("child") != F.col("parent"))).alias("truth"), (F.col("status") == "verified").alias("claim"))
    return results.confusion(e, "truth", "claim")
