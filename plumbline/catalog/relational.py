"""Scans, predicates, joins, set operations, orderings and scalar functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from plumbline.operators import keys, metrics, rules, text
from plumbline.registry import query
from plumbline.sources import tables as src
from plumbline.sources.headers import unpivoted

# -- scans and sources --------------------------------------------------------------------------------------


@query("S1_scan", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def _(t):
    return t("nation").select("n_nationkey", "n_name", "n_regionkey")


@query("S3_schema", "SELECT column_name, ordinal_position - 1 AS position FROM (DESCRIBE orders) d JOIN (SELECT column_name AS c, row_number() OVER () AS ordinal_position FROM (DESCRIBE orders)) p ON p.c = d.column_name")
def _(t):
    df = t("orders")
    return df.sparkSession.createDataFrame([(f.name, i) for i, f in enumerate(df.schema.fields)], "column_name string, position long")


@query("S6_import_newest", "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey DESC LIMIT 500")
def _(t):
    return src.imported(t("orders").select("o_orderkey", "o_custkey"), "o_orderkey", full=1_000, sample=500)[0]


@query("S6_import_full", "SELECT n_nationkey, n_name FROM nation")
def _(t):
    return src.imported(t("nation").select("n_nationkey", "n_name"), "n_nationkey")[0]


@query("S12_unpivot", "SELECT p_partkey, item, value FROM (SELECT p_partkey, CAST(p_size AS DOUBLE) AS p_size, p_retailprice FROM part) UNPIVOT (value FOR item IN (p_size, p_retailprice))")
def _(t):
    return unpivoted(t("part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"), "p_retailprice"), ["p_partkey"], ["p_size", "p_retailprice"])


@query("S16_bounded_fetch", "SELECT (SELECT count(*) FROM (SELECT 1 FROM customer LIMIT 101)) > 100 AS truncated, 100 AS n_rows")
def _(t):
    n = t("customer").select("c_custkey").limit(101).agg(F.count(F.lit(1)).alias("n"))
    return n.select((F.col("n") > 100).alias("truncated"), F.least(F.col("n").cast("int"), F.lit(100)).alias("n_rows"))


# -- predicates ---------------------------------------------------------------------------------------------

_FILTERS = {
    "eq": (metrics.Filter("o_orderstatus", "=", "F"), "o_orderstatus = 'F'"),
    "ne": (metrics.Filter("o_orderstatus", "!=", "F"), "o_orderstatus <> 'F'"),
    "gt": (metrics.Filter("o_totalprice", ">", 200000), "o_totalprice > 200000"),
    "ge": (metrics.Filter("o_totalprice", ">=", 200000), "o_totalprice >= 200000"),
    "lt": (metrics.Filter("o_totalprice", "<", 1500.5), "o_totalprice < 1500.5"),
    "le": (metrics.Filter("o_totalprice", "<=", 1500.5), "o_totalprice <= 1500.5"),
    "in": (metrics.Filter("o_orderpriority", "in", ("1-URGENT", "2-HIGH")), "o_orderpriority IN ('1-URGENT', '2-HIGH')"),
    "not_in": (metrics.Filter("o_orderpriority", "not_in", ("1-URGENT", "2-HIGH")), "o_orderpriority NOT IN ('1-URGENT', '2-HIGH')"),
    "is_null": (metrics.Filter("o_orderdate", "is_null"), "o_orderdate IS NULL"),
    "not_null": (metrics.Filter("o_orderdate", "not_null"), "o_orderdate IS NOT NULL"),
}
for _name, (_filter, _sql) in _FILTERS.items():
    query(f"F1_filter_{_name}", f"SELECT count(*) AS n, round(coalesce(sum(o_totalprice), 0), 2) AS total FROM orders WHERE {_sql}")(
        lambda t, f=_filter: t("orders").where(metrics.predicate(f)).agg(F.count(F.lit(1)).alias("n"), F.round(F.coalesce(F.sum("o_totalprice"), F.lit(0.0)), 2).alias("total"))
    )

_RULES = (
    rules.Rule("large", "orders", (rules.Condition("o_totalprice", ">=", 200000), rules.Condition("o_orderstatus", "==", "O")), "review", "escalate", "high"),
    rules.Rule("urgent", "orders", (rules.Condition("o_orderpriority", "in", ("1-URGENT",)),), "first", "queue"),
    rules.Rule("open", "orders", (rules.Condition("o_orderstatus", "!=", "F"), rules.Condition("o_orderdate", "exists")), "wait", "queue", "low"),
    rules.Rule("named", "orders", (rules.Condition("o_orderpriority", "contains", "LOW"),), "skip", "queue", "low"),
    rules.Rule("undated", "orders", (rules.Condition("o_orderdate", "missing"),), "fix"),
)
_RULE_SQL = {"large": "o_totalprice >= 200000 AND o_orderstatus = 'O'", "urgent": "o_orderpriority IN ('1-URGENT')", "open": "o_orderstatus <> 'F' AND o_orderdate IS NOT NULL", "named": "o_orderpriority LIKE '%LOW%'", "undated": "o_orderdate IS NULL"}


@query("F3_rule_predicates", "SELECT o_orderkey, " + ", ".join(f"coalesce({s}, false) AS r_{n}" for n, s in _RULE_SQL.items()) + " FROM orders")
def _(t):
    return t("orders").select("o_orderkey", *(rules.predicate(r).alias(f"r_{r.id}") for r in _RULES))


@query("F3_text_number", "SELECT o_orderkey, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) < 3 AS hit FROM orders")
def _(t):
    return t("orders").select("o_orderkey", F.substring("o_orderpriority", 1, 1).alias("p")).select("o_orderkey", rules.condition(rules.Condition("p", "<", 3)).alias("hit"))


@query("F4_A22_rule_hits", "SELECT rule, n_rows, n_hits FROM (" + " UNION ALL ".join(f"SELECT '{n}' AS rule, count(*) AS n_rows, count(*) FILTER (WHERE {s}) AS n_hits FROM orders" for n, s in _RULE_SQL.items()) + ")")
def _(t):
    return rules.hits(t("orders"), _RULES).select("rule", "n_rows", "n_hits")


@query("A22_monitor_fired", " UNION ALL ".join(f"SELECT o_orderkey, '{r.id}' AS rule, '{r.decision}' AS decision, '{r.severity}' AS severity FROM orders WHERE {_RULE_SQL[r.id]}" for r in _RULES))
def _(t):
    return rules.fired(t("orders"), "o_orderkey", _RULES).select("o_orderkey", "rule", "decision", "severity")


@query("Q19_rule_conflicts", "WITH f AS (" + " UNION ALL ".join(f"SELECT o_orderkey, '{r.id}' AS rule, '{r.decision}' AS decision, '{r.action}' AS action FROM orders WHERE {_RULE_SQL[r.id]}" for r in _RULES) + ") SELECT o_orderkey, action, string_agg(DISTINCT decision, ',' ORDER BY decision) AS decisions FROM f WHERE action <> '' GROUP BY ALL HAVING count(DISTINCT decision) > 1")
def _(t):
    c = rules.conflicts(rules.fired(t("orders"), "o_orderkey", _RULES), "o_orderkey")
    return c.select("o_orderkey", "action", F.array_join("decisions", ",").alias("decisions"))


@query("F5_present_keys", "SELECT count(*) AS n FROM documents WHERE lang IS NOT NULL AND lang <> '' AND source IS NOT NULL AND source <> ''")
def _(t):
    d = t("documents")
    return d.where(keys.present(d, ["lang", "source"])).agg(F.count(F.lit(1)).alias("n"))


@query("F6_canonical_keys", "SELECT p_partkey, CAST(p_size AS VARCHAR) AS k_int, CASE WHEN floor(p_retailprice) = p_retailprice THEN CAST(CAST(p_retailprice AS BIGINT) AS VARCHAR) ELSE 'fraction' END AS k_real, trim(p_brand) AS k_text FROM part")
def _(t):
    p = t("part")
    real = keys.canonical(p, "p_retailprice")
    return p.select("p_partkey", keys.canonical(p, "p_size").alias("k_int"), F.when(F.floor("p_retailprice") == F.col("p_retailprice"), real).otherwise("fraction").alias("k_real"), keys.canonical(p, "p_brand").alias("k_text"))


_FLAGGED = "SELECT c_custkey, c_nationkey, CASE WHEN c_custkey % 7 = 0 THEN 'Y' WHEN c_custkey % 7 = 1 THEN NULL WHEN c_custkey % 7 = 2 THEN '' ELSE 'N' END AS del_flag FROM customer"


def _flagged(t):
    k = F.col("c_custkey") % 7
    return t("customer").select("c_custkey", "c_nationkey", F.when(k == 0, "Y").when(k == 1, F.lit(None)).when(k == 2, "").otherwise("N").alias("del_flag"))


@query("F7_live_rows", f"SELECT c_custkey FROM ({_FLAGGED}) WHERE del_flag IS NULL OR del_flag IN ('0', 'N', 'n', 'false', '')")
def _(t):
    return _flagged(t).where(keys.live("del_flag")).select("c_custkey")


@query("F8_deleted_share", f"SELECT round(avg(CASE WHEN del_flag IS NULL OR del_flag IN ('0', 'N', 'n', 'false', '') THEN 0.0 ELSE 1.0 END), 4) AS deleted_share FROM ({_FLAGGED})")
def _(t):
    return src.deleted_share(_flagged(t), "del_flag")


_CODED = "SELECT c_custkey, c_nationkey, CASE WHEN c_custkey % 11 = 0 THEN 'X' ELSE substr(n_name, 1, 2) END AS code FROM customer JOIN nation ON n_nationkey = c_nationkey"


def _coded(t):
    return t("customer").join(t("nation"), F.col("n_nationkey") == F.col("c_nationkey")).select("c_custkey", "c_nationkey", F.when(F.col("c_custkey") % 11 == 0, "X").otherwise(F.substring("n_name", 1, 2)).alias("code"))


@query("F9_recode", f"WITH d AS ({_CODED}), n AS (SELECT c_nationkey AS category, code, count(*) AS n FROM d GROUP BY ALL), e AS (SELECT category, min_by(code, (-n, code)) AS expected FROM n GROUP BY category) SELECT c_custkey, c_nationkey, CASE WHEN code = 'X' THEN expected ELSE code END AS code FROM d JOIN e ON category = c_nationkey")
def _(t):
    d = _coded(t)
    return keys.recode(d, "c_nationkey", "code", keys.functional_dependency(d, "c_nationkey", "code"), F.col("code") == "X")


@query("F13_grounded_counts", "SELECT 'p_brand' AS column_name, p_brand AS value, count(*) AS n FROM part WHERE p_brand IN ('Brand#11', 'Brand#12') GROUP BY ALL UNION ALL SELECT 'p_type', p_type, count(*) FROM part WHERE p_type = 'PROMO' GROUP BY ALL")
def _(t):
    p = t("part")
    both = [p.where(F.col(c).isin(*v)).groupBy(F.lit(c).alias("column_name"), F.col(c).alias("value")).agg(F.count(F.lit(1)).alias("n")) for c, v in (("p_brand", ("Brand#11", "Brand#12")), ("p_type", ("PROMO",)))]
    return both[0].unionByName(both[1])


@query("F14_group_scope", "SELECT event_type, user_id, count(*) AS n FROM events WHERE event_type = 'click' GROUP BY ALL")
def _(t):
    return t("events").where("event_type = 'click'").groupBy("event_type", "user_id").agg(F.count(F.lit(1)).alias("n"))


@query("F17_pivot", "SELECT p_brand, count(*) FILTER (WHERE p_size <= 10) AS small, count(*) FILTER (WHERE p_size > 10 AND p_size <= 30) AS medium, count(*) FILTER (WHERE p_size > 30) AS large FROM part GROUP BY p_brand")
def _(t):
    kind = F.when(F.col("p_size") <= 10, "small").when(F.col("p_size") <= 30, "medium").otherwise("large")
    return t("part").withColumn("kind", kind).groupBy("p_brand").pivot("kind", ["small", "medium", "large"]).agg(F.count(F.lit(1))).fillna(0)


# -- joins --------------------------------------------------------------------------------------------------


@query("J1_inner", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def _(t):
    return t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", "r_name")


_SIGNALS = """
WITH c AS (SELECT DISTINCT {ck} AS k FROM {child} WHERE {present}), p AS (SELECT DISTINCT {pk} AS k FROM {parent})
SELECT CASE WHEN (SELECT count(*) FROM c) > 0 THEN 100.0 * (SELECT count(*) FROM (SELECT k FROM c INTERSECT SELECT k FROM p)) / (SELECT count(*) FROM c) ELSE -1.0 END AS overlap,
  (SELECT count(*) FROM c) AS child_distinct, (SELECT count(*) FROM p) AS parent_distinct, (SELECT count(*) FROM (SELECT k FROM c INTERSECT SELECT k FROM p)) AS matched_distinct,
  (SELECT count(*) FROM {child}) AS child_rows, (SELECT count(*) FROM {parent}) AS parent_rows,
  (SELECT count(*) FROM c) = (SELECT count(*) FROM {child}) AS child_unique, (SELECT count(*) FROM p) = (SELECT count(*) FROM {parent}) AS parent_unique, true AS evidence_complete, 'exact' AS evidence_method"""
_BUILDING = "(SELECT * FROM customer WHERE c_mktsegment = 'BUILDING')"
for _n, _child, _ck, _parent, _pk, _psql in (
    ("orders_customer", "orders", "o_custkey", "customer", "c_custkey", "customer"),
    ("orders_building", "orders", "o_custkey", "customer", "c_custkey", _BUILDING),
    ("lineitem_orders", "lineitem", "l_orderkey", "orders", "o_orderkey", "orders"),
    ("customer_part", "customer", "c_custkey", "part", "p_partkey", "part"),
    ("customer_orders_reverse", "customer", "c_custkey", "orders", "o_custkey", "orders"),
    ("nation_region", "nation", "n_regionkey", "region", "r_regionkey", "region"),
):
    query(f"J2_signals_{_n}", _SIGNALS.format(ck=_ck, child=_child, present=f"{_ck} IS NOT NULL", pk=_pk, parent=_psql))(
        lambda t, c=_child, ck=_ck, p=_parent, pk=_pk, cut=_psql == _BUILDING: keys.relation_signals(t(c), ck, t(p).where("c_mktsegment = 'BUILDING'") if cut else t(p), pk)
    )


@query("J3_semi_overlap", "SELECT round(100.0 * count(DISTINCT CASE WHEN o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) THEN o_custkey END) / count(DISTINCT o_custkey), 6) AS overlap FROM orders")
def _(t):
    child = t("orders").select(F.col("o_custkey").alias("k")).distinct()
    hit = child.join(t("customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("k")), "k", "left_semi").agg(F.count(F.lit(1)).alias("m"))
    return hit.join(child.agg(F.count(F.lit(1)).alias("n"))).select(F.round(100.0 * F.col("m") / F.col("n"), 6).alias("overlap"))


@query("J4_composite", "SELECT count(*) AS matched FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) a JOIN (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem WHERE l_linenumber = 1) b USING (l_orderkey, l_suppkey)")
def _(t):
    li = t("lineitem")
    return keys.relation_signals(li, "l_orderkey, l_suppkey", li.where("l_linenumber = 1"), "l_orderkey, l_suppkey").select(F.col("matched_distinct").alias("matched"))


@query("J5_orphans", "SELECT count(*) AS n_rows, count(*) FILTER (WHERE NOT ok) AS orphan_rows, round(count(*) FILTER (WHERE NOT ok) / count(*), 3) AS orphan_rate, CASE WHEN round(count(*) FILTER (WHERE NOT ok) / count(*), 3) > 0.3 THEN 'high' ELSE 'medium' END AS severity FROM (SELECT o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') AS ok FROM orders WHERE o_custkey IS NOT NULL)")
def _(t):
    return keys.orphans(t("orders"), "o_custkey", t("customer").where("c_mktsegment = 'BUILDING'"), "c_custkey")


@query("J6_declared_fk", "SELECT count(*) AS referencing_rows, count(*) FILTER (WHERE o_orderkey IS NULL) AS orphan_rows, 'declared_fk_valid' AS decision, 'verified' AS status FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey")
def _(t):
    return keys.foreign_key_evidence(t("lineitem"), "l_orderkey", t("orders"), "o_orderkey")


@query("J7_left", "SELECT doc_id, quality FROM documents LEFT JOIN labels USING (doc_id)")
def _(t):
    return t("documents").select("doc_id").join(t("labels").select("doc_id", "quality"), "doc_id", "left")


@query("J8_exists", "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 200000)")
def _(t):
    return t("customer").join(t("orders").where("o_totalprice > 200000"), F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("c_custkey")


@query("J8_not_exists", "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'F')")
def _(t):
    return t("customer").join(t("orders").where("o_orderstatus = 'F'"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey")


@query("J9_theta", "SELECT count(*) AS n_pairs, count(*) FILTER (WHERE date_diff('day', CAST(l_shipdate AS DATE), CAST(o_orderdate AS DATE)) > 1) AS n_late FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def _(t):
    j = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return j.agg(F.count(F.lit(1)).alias("n_pairs"), F.count_if(F.datediff("o_orderdate", "l_shipdate") > 1).alias("n_late"))


@query("J10_interval_semi", "SELECT event_id FROM events a WHERE event_type = 'purchase' AND EXISTS (SELECT 1 FROM events b WHERE b.user_id = a.user_id AND b.event_type = 'click' AND a.ts > b.ts AND a.ts <= b.ts + INTERVAL 1 DAY)")
def _(t):
    # The latest click before an event decides: a window instead of a range join, so a hot user's rows are sorted, not paired.
    e = t("events").where("event_type in ('purchase', 'click')").select("event_id", "user_id", "ts", "event_type")
    e = e.withColumn("click", F.when(F.col("event_type") == "click", F.col("ts")))
    before = Window.partitionBy("user_id").orderBy("ts", F.when(F.col("event_type") == "click", 1).otherwise(0)).rowsBetween(Window.unboundedPreceding, -1)
    return e.withColumn("last", F.max("click").over(before)).where((F.col("event_type") == "purchase") & (F.col("ts") > F.col("last")) & (F.col("ts") <= F.col("last") + F.expr("INTERVAL 1 DAY"))).select("event_id")


@query("J11_containment", "SELECT o_orderkey, count(*) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey AND l_shipdate >= o_orderdate AND l_shipdate <= o_orderdate + INTERVAL 30 DAY GROUP BY o_orderkey")
def _(t):
    j = t("orders").join(t("lineitem"), (F.col("l_orderkey") == F.col("o_orderkey")) & (F.col("l_shipdate") >= F.col("o_orderdate")) & (F.col("l_shipdate") <= F.col("o_orderdate") + F.expr("INTERVAL 30 DAY")))
    return j.groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("n"))


@query("J12_tenant_composite", "SELECT count(*) AS n_rows, count(DISTINCT turn) AS n_keys, count(DISTINCT (conv_id, turn)) AS n_scoped, count(DISTINCT turn) = count(*) AS key_unique, count(DISTINCT (conv_id, turn)) = count(*) AS scoped_unique FROM conversations")
def _(t):
    return keys.scoped_uniqueness(t("conversations"), "turn", "conv_id")


@query("J13_conditional", """WITH v AS (SELECT DISTINCT event_type AS kind, CAST(user_id AS VARCHAR) AS k FROM events), tot AS (SELECT kind, count(*) AS keys FROM v GROUP BY kind HAVING count(*) >= 5),
  h AS (SELECT kind, 'customer' AS parent, count(*) AS m FROM v WHERE k IN (SELECT CAST(c_custkey AS VARCHAR) FROM customer) GROUP BY kind UNION ALL SELECT kind, 'nation', count(*) FROM v WHERE k IN (SELECT CAST(n_nationkey AS VARCHAR) FROM nation) GROUP BY kind),
  r AS (SELECT h.kind, parent, keys, round(100.0 * m / keys, 2) AS rate FROM h JOIN tot USING (kind)) SELECT kind, parent, keys, rate FROM r QUALIFY row_number() OVER (PARTITION BY kind ORDER BY rate DESC, parent DESC) = 1""")
def _(t):
    return keys.conditional_overlap(t("events"), "event_type", "user_id", {"customer": (t("customer"), "c_custkey"), "nation": (t("nation"), "n_nationkey")})


@query("J14_scalar_lookup", "SELECT o_orderkey, (SELECT min(c_mktsegment) FROM customer WHERE c_custkey = o_custkey) AS segment FROM orders")
def _(t):
    c = t("customer").groupBy(F.col("c_custkey").alias("o_custkey")).agg(F.min("c_mktsegment").alias("segment"))
    return t("orders").select("o_orderkey", "o_custkey").join(c, "o_custkey", "left").select("o_orderkey", "segment")


@query("J15_A14_parent_dependency", "WITH n AS (SELECT c_mktsegment AS category, o_orderpriority AS v, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL) SELECT category, min_by(v, (-n, v)) AS expected, CAST(sum(n) AS BIGINT) AS n_rows, max(n) AS kept, round(max(n) / sum(n), 3) AS support, sum(n) >= 10 AND max(n) >= 0.8 * sum(n) AS dominant FROM n GROUP BY category")
def _(t):
    return keys.functional_dependency(t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")), "c_mktsegment", "o_orderpriority")


@query("J16_trace", "SELECT DISTINCT s_suppkey, n_name FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey LEFT JOIN nation ON n_nationkey = s_nationkey WHERE c_acctbal < 0")
def _(t):
    orders = t("orders").join(t("customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey")), "o_custkey", "left_semi")
    items = t("lineitem").join(orders.select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_semi")
    found = t("supplier").join(items.select(F.col("l_suppkey").alias("s_suppkey")), "s_suppkey", "left_semi")
    return found.join(t("nation"), F.col("n_nationkey") == F.col("s_nationkey"), "left").select("s_suppkey", "n_name").distinct()


@query("J17_self_join", "SELECT a.n_name AS left_nation, b.n_name AS right_nation FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def _(t):
    a, b = t("nation").alias("a"), t("nation").alias("b")
    return a.join(b, (F.col("a.n_regionkey") == F.col("b.n_regionkey")) & (F.col("a.n_nationkey") < F.col("b.n_nationkey"))).select(F.col("a.n_name").alias("left_nation"), F.col("b.n_name").alias("right_nation"))


@query("J18_using_natural_cross", "SELECT k, a, b, c FROM (SELECT n_regionkey AS k, n_name AS a FROM nation) JOIN (SELECT r_regionkey AS k, r_name AS b FROM region) USING (k) NATURAL JOIN (SELECT r_regionkey AS k, length(r_name) AS c FROM region)")
def _(t):
    spark = t("nation").sparkSession
    return spark.sql("SELECT k, a, b, c FROM (SELECT n_regionkey AS k, n_name AS a FROM {nation}) JOIN (SELECT r_regionkey AS k, r_name AS b FROM {region}) USING (k) NATURAL JOIN (SELECT r_regionkey AS k, length(r_name) AS c FROM {region})", nation=t("nation"), region=t("region"))


@query("J19_W12_latest", "SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC NULLS LAST, o_orderkey DESC) = 1")
def _(t):
    return keys.latest(t("orders"), "o_custkey", "o_orderdate", "o_orderkey").select("o_custkey", "o_orderkey", "o_totalprice")


@query("J22_full_outer", "SELECT coalesce(a.k, b.k) AS k, a.n AS customers, b.n AS suppliers FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer WHERE c_acctbal < 0 GROUP BY 1) a FULL JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier WHERE s_acctbal > 0 GROUP BY 1) b ON a.k = b.k")
def _(t):
    a = t("customer").where("c_acctbal < 0").groupBy(F.col("c_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("customers"))
    return a.join(t("supplier").where("s_acctbal > 0").groupBy(F.col("s_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("suppliers")), "k", "full")


# -- sets, orderings ----------------------------------------------------------------------------------------


@query("U1_intersect", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def _(t):
    return t("customer").select(F.col("c_nationkey").alias("k")).intersect(t("supplier").select("s_nationkey"))


@query("U2_union_all", "SELECT 'c' AS kind, c_custkey AS id, c_acctbal AS balance FROM customer UNION ALL SELECT 's', s_suppkey, s_acctbal FROM supplier")
def _(t):
    return t("customer").select(F.lit("c").alias("kind"), F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance")).union(t("supplier").select(F.lit("s"), "s_suppkey", "s_acctbal"))


@query("U3_except", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'")
def _(t):
    return t("customer").select(F.col("c_custkey").alias("k")).subtract(t("orders").where("o_orderstatus = 'O'").select("o_custkey"))


@query("U3_except_all", "SELECT l_returnflag AS f, l_linestatus AS s FROM lineitem EXCEPT ALL SELECT l_returnflag, l_linestatus FROM lineitem WHERE l_linenumber < 7")
def _(t):
    li = t("lineitem").select(F.col("l_returnflag").alias("f"), F.col("l_linestatus").alias("s"), "l_linenumber")
    return li.select("f", "s").exceptAll(li.where("l_linenumber < 7").select("f", "s"))


@query("U3_union_distinct", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def _(t):
    return t("customer").select(F.col("c_nationkey").alias("k")).union(t("supplier").select("s_nationkey")).distinct()


@query("U6_domain_difference", "SELECT lang AS value, count(*) AS n FROM documents WHERE lang NOT IN ('en', 'de') GROUP BY lang")
def _(t):
    d = t("documents")
    return keys.domain_difference(d, "lang", d.sparkSession.createDataFrame([("en",), ("de",)], "code string"), "code")


@query("O1_ordered_groups", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1 ORDER BY 1")
def _(t):
    return t("orders").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n")).orderBy("o_orderstatus")


@query("O2_top_frequency", "SELECT p_name AS value, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, value LIMIT 10")
def _(t):
    return t("part").groupBy(F.col("p_name").alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value").limit(10)


@query("O3_newest_by_key", "SELECT event_id, user_id FROM events ORDER BY event_id DESC LIMIT 200")
def _(t):
    return t("events").select("event_id", "user_id").orderBy(F.desc("event_id")).limit(200)


@query("O4_limit_probe", "SELECT count(*) AS n FROM (SELECT o_orderkey FROM orders WHERE o_totalprice > 1000 LIMIT 1001)")
def _(t):
    return t("orders").where("o_totalprice > 1000").select("o_orderkey").limit(1001).agg(F.count(F.lit(1)).alias("n"))


@query("O6_review_queue", "SELECT o_orderkey, round(o_totalprice * CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.6 END, 2) AS priority FROM orders ORDER BY priority DESC, o_orderkey LIMIT 50")
def _(t):
    return t("orders").select("o_orderkey", F.round(F.col("o_totalprice") * F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(0.6), 2).alias("priority")).orderBy(F.desc("priority"), "o_orderkey").limit(50)


@query("O7_budget", "SELECT doc_id, source FROM (SELECT doc_id, source, sum(n_chars) OVER (PARTITION BY source ORDER BY n_chars, doc_id ROWS UNBOUNDED PRECEDING) AS s FROM documents) WHERE s <= 20000")
def _(t):
    return text.within_budget(t("documents").select("doc_id", "source", "n_chars"), "source", [F.col("n_chars"), F.col("doc_id")], "n_chars", 20_000).select("doc_id", "source")


@query("O7_quota", "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) <= 3")
def _(t):
    return text.quota(t("events"), "user_id", [F.desc("value"), F.col("event_id")], 3).select("user_id", "event_id")


@query("O8_superlative", "SELECT l_suppkey, round(sum(l_extendedprice), 2) AS total FROM lineitem WHERE l_extendedprice IS NOT NULL GROUP BY 1 ORDER BY sum(l_extendedprice) DESC, 1 LIMIT 1")
def _(t):
    return t("lineitem").where("l_extendedprice is not null").groupBy("l_suppkey").agg(F.sum("l_extendedprice").alias("s")).orderBy(F.desc("s"), "l_suppkey").limit(1).select("l_suppkey", F.round("s", 2).alias("total"))


# -- scalar functions ---------------------------------------------------------------------------------------


@query("N1_N3_text", "SELECT p_partkey, substr(p_name, 1, 3) || '-' || p_brand AS a, length(p_type) AS b, trim(p_brand) AS c FROM part")
def _(t):
    return t("part").select("p_partkey", F.concat(F.substring("p_name", 1, 3), F.lit("-"), F.col("p_brand")).alias("a"), F.length("p_type").cast("long").alias("b"), F.trim("p_brand").alias("c"))


@query("N2_casts", "SELECT o_orderkey, TRY_CAST(o_orderpriority AS INTEGER) AS a, CAST(o_totalprice AS BIGINT) AS b, CAST(o_custkey AS VARCHAR) AS c FROM (SELECT o_orderkey, o_orderpriority, floor(o_totalprice) AS o_totalprice, o_custkey FROM orders)")
def _(t):
    return t("orders").select("o_orderkey", F.col("o_orderpriority").try_cast("int").alias("a"), F.floor("o_totalprice").cast("bigint").alias("b"), F.col("o_custkey").cast("string").alias("c"))


@query("N4_nulls", "SELECT doc_id, coalesce(quality, -1) AS a, nullif(lang, 'en') AS b, ifnull(toxic, 9) AS c FROM documents LEFT JOIN labels USING (doc_id)")
def _(t):
    j = t("documents").select("doc_id", "lang").join(t("labels"), "doc_id", "left")
    return j.select("doc_id", F.coalesce("quality", F.lit(-1)).alias("a"), F.nullif("lang", F.lit("en")).alias("b"), F.ifnull("toxic", F.lit(9)).alias("c"))


@query("N5_numbers", "SELECT c_custkey, round(c_acctbal, 1) AS a, abs(c_acctbal) AS b, CASE WHEN c_acctbal IS NULL THEN NULL ELSE greatest(c_acctbal, 0) END AS c FROM customer")
def _(t):
    b = F.col("c_acctbal")
    return t("customer").select("c_custkey", F.round(b, 1).alias("a"), F.abs(b).alias("b"), F.when(b.isNotNull(), F.greatest(b, F.lit(0.0))).alias("c"))


@query("N6_dates", "SELECT event_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS d, strftime(ts, '%Y-%m') AS m, strftime(ts + INTERVAL 1 MINUTE, '%H:%M') AS h FROM events")
def _(t):
    return t("events").select("event_id", F.to_date("ts").cast("string").alias("d"), F.date_format("ts", "yyyy-MM").alias("m"), F.date_format(F.col("ts") + F.expr("INTERVAL 1 MINUTE"), "HH:mm").alias("h"))


@query("N7_day_difference", "SELECT l_orderkey, l_linenumber, round(sum(date_diff('day', o_orderdate, l_shipdate)), 4) AS days FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL")
def _(t):
    j = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return j.groupBy("l_orderkey", "l_linenumber").agg(F.sum(F.datediff("l_shipdate", "o_orderdate")).alias("days"))


@query("N8_patterns", "SELECT p_partkey, p_name LIKE '%a%' AS a, regexp_matches(p_brand, '^Brand#1[0-9]$') AS b, instr(p_type, 'O') AS c, p_size BETWEEN 5 AND 15 AS d, p_type IS DISTINCT FROM 'PROMO' AS e FROM part")
def _(t):
    return t("part").select("p_partkey", F.col("p_name").like("%a%").alias("a"), F.col("p_brand").rlike("^Brand#1[0-9]$").alias("b"), F.instr("p_type", "O").cast("long").alias("c"), F.col("p_size").between(5, 15).alias("d"), (~F.col("p_type").eqNullSafe("PROMO")).alias("e"))


@query("N9_N10_format", "SELECT printf('E%04d', s_suppkey) AS code, count(DISTINCT (s_suppkey, s_nationkey)) AS n FROM supplier GROUP BY 1")
def _(t):
    return t("supplier").groupBy(F.format_string("E%04d", "s_suppkey").alias("code")).agg(F.count_distinct(F.struct("s_suppkey", "s_nationkey")).alias("n"))


@query("N11_json", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def _(t):
    return t("events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))


@query("N11_json_each", "SELECT key, count(*) AS n FROM (SELECT unnest(json_keys(props)) AS key FROM events) GROUP BY key")
def _(t):
    return t("events").select(F.explode(F.json_object_keys("props")).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n"))


@query("N12_left_right", "SELECT n_nationkey, left(n_name, 2) AS a, right(n_name, 2) AS b FROM nation")
def _(t):
    return t("nation").sparkSession.sql("SELECT n_nationkey, left(n_name, 2) AS a, right(n_name, 2) AS b FROM {n}", n=t("nation"))


@query("N13_boolean_sums", "SELECT CAST(sum(CAST(o_orderstatus = 'F' AS INTEGER)) AS BIGINT) AS f, CAST(sum(CAST((o_totalprice > 100000) <> (o_orderstatus = 'O') AS INTEGER)) AS BIGINT) AS x FROM orders")
def _(t):
    return t("orders").agg(F.sum((F.col("o_orderstatus") == "F").cast("int")).alias("f"), F.sum(((F.col("o_totalprice") > 100000) != (F.col("o_orderstatus") == "O")).cast("int")).alias("x"))
