"""Operators over names, contracts, relations and statements; their results are small tables made on the driver."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from plumbline.catalog.evidence import _ALIASED, CANDIDATES, RELATIONS, named_sql, ontology
from plumbline.functions import names, wording
from plumbline.operators import keys, metrics, profile, results, witness
from plumbline.plans import answers, gates, mining
from plumbline.plans import graph as graphs
from plumbline.plans import relational_ir as ir
from plumbline.plans.structure import analyze
from plumbline.registry import query
from plumbline.sources import headers
from plumbline.sources import tables as src


def _frame(t, rows, schema):
    return t("region").sparkSession.createDataFrame(rows, schema)


def _values(rows, columns: str) -> str:
    lit = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) v({columns})"


_TABLES = sorted(_ALIASED)
_SCHEMA = {n: [(c, "bigint") for c in cols.values()] for n, cols in _ALIASED.items()}


@query("S2_tables")
def _(t):
    return _frame(t, [(n,) for n in _TABLES if t(n).columns and not n.startswith(src.INTERNAL)], "table_name string")


@query("S4_folded_schema", "SELECT lower(column_name) AS folded, column_name AS real FROM (DESCRIBE lineitem)")
def _(t):
    return _frame(t, [(c.lower(), c) for c in t("lineitem").columns], "folded string, real string")


@query("S5_resolved_columns")
def _(t):
    return _frame(t, [tuple(keys.columns_of(t("lineitem"), "L_OrderKey, l_SUPPKEY"))], "a string, b string")


@query("S10_S11_documentation")
def _(t):
    spark = t("region").sparkSession
    spark.createDataFrame([("documents", "lang", "ISO language"), ("documents", "lang", None)], "table_name string, column_name string, description string").createOrReplaceTempView("docs_of_columns")
    return src.field_documentation(spark, ["docs_of_columns"]).select("column_name", "text")


@query("S12_S13_uploaded_long")
def _(t):
    return headers.uploaded(t("region").sparkSession, "up", "地区,2025年,,2026年,\n,收入,成本,收入,成本\n华东,10,6,12,7\n")["up_long"]


@query("S14_rest_records")
def _(t):
    return src.read_rest(t("region").sparkSession, '{"data": [{"a": 1, "b": [2]}, {"a": 3}]}')


@query("F2_validation")
def _(t):
    cases = {"good": metrics.Contract("m", "orders", "sum", "o_totalprice"), "bad_agg": metrics.Contract("m", "orders", "median", "x"), "no_column": metrics.Contract("m", "orders", "sum")}

    def valid(c):
        try:
            return bool(metrics.validated(c))
        except ValueError:
            return False

    return _frame(t, [(n, valid(c)) for n, c in cases.items()], "contract string, valid boolean")


@query("F10_cleaning_view", "SELECT count(*) AS n, count(*) FILTER (WHERE n_name = 'CLEANED') AS cleaned FROM (SELECT CASE WHEN n_nationkey = 0 THEN 'CLEANED' ELSE n_name END AS n_name FROM nation)")
def _(t):
    own = t("nation").sparkSession.newSession()
    t("nation").withColumn("n_name", F.when(F.col("n_nationkey") == 0, "CLEANED").otherwise(F.col("n_name"))).createOrReplaceGlobalTempView("clean_nation")
    own.table("global_temp.clean_nation").createOrReplaceTempView("nation")
    counted = own.sql("SELECT count(*) AS n, count_if(n_name = 'CLEANED') AS cleaned FROM nation").first()
    return _frame(t, [tuple(counted)], "n long, cleaned long")


_CONCEPTS = (answers.Concept("紧急订单", "orders", metrics.Filter("o_orderpriority", "=", "1-URGENT"), ("加急",)), answers.Concept("坏账", "customer", metrics.Filter("c_acctbal", "<", -1e12)), answers.Concept("幽灵", "ghosts", metrics.Filter("x", "=", 1)))


@query("F11_concept_filters")
def _(t):
    found = answers.filters_for("1996年2月的加急有多少", _CONCEPTS, "o_orderdate", date(2024, 1, 1))
    return _frame(t, [(f.column, f.op, f.value) for f in found], "column_name string, op string, value string")


@query("E18_T1_concepts", _values([("紧急订单", "supported"), ("坏账", "stale"), ("幽灵", "unresolved")], "concept, status"))
def _(t):
    done = answers.verified_concepts({n: t(n) for n in ("orders", "customer")}, _CONCEPTS)
    return _frame(t, [(c.name, c.status) for c in done], "concept string, status string")


@query("F12_filter_parser")
def _(t):
    rows = [(w, None if (f := mining.filters_of(w)) is None else len(f)) for w in ("a = 1 AND b IN ('x', 'y')", "a = 1 OR b = 2", "a IS NOT NULL")]
    return _frame(t, rows, "text string, n_filters int")


@query("F15_scope")
def _(t):
    return _frame(t, [(x,) for x in answers.in_scope("WITH a AS (SELECT * FROM nation) SELECT * FROM a, region", {"region"})], "beyond string")


@query("F16_literals")
def _(t):
    sql = metrics.to_sql(metrics.Contract("m", "orders", "count", None, (metrics.Filter("x", "=", "it's"),)))
    return _frame(t, [(sql.split("'", 1)[1].rsplit("'", 1)[0], metrics._quoted('a"b'))], "literal string, name string")


@query("J20_join_hints")
def _(t):
    return _frame(t, [(h,) for h in answers.join_hints(ontology().edges, ["orders", "customer", "supplier"])], "hint string")


@query("A12_supported_formulas")
def _(t):
    w = [{"target": "t", "left_input": "a", "op": "+", "right_input": "b"}]
    return _frame(t, [(f, witness.supports(f, w) is not None) for f in ("t = a + b", "t = b + a", "t = a - b")], "formula string, supported boolean")


@query("A25_paired_bootstrap")
def _(t):
    b = results.bootstrap([1, 0, 1, 1], [0, 0, 1, 0])
    return _frame(t, [(b["n"], b["diff"], b["lo"], b["hi"])], "n int, diff double, lo double, hi double")


@query("A35_A36_votes")
def _(t):
    return _frame(t, [(results.vote([[], [(1, "a")], [(1.0, "a")], []]), results.jaccard({"a", "b", "c"}, {"b", "c", "d"}))], "winner int, stability double")


_NAMES = [*CANDIDATES, ("orders", "billing_customer_id", "customer", "customer_id"), ("orders", "order_id", "customer", "customer_id"), ("invoice", "line_no", "production_line", "line_id"), ("invoice", "invoice_id", "payment", "payment_id"), ("account", "zone_code", "zone", "zone_id"), ("plan", "meta_zone_sn_code", "zone", "zone_sn_code")]


@query("E5_names", named_sql(_NAMES))
def _(t):
    return _frame(t, [(*c, names.compatible(c[1], c[2], c[3], c[0])) for c in _NAMES], "child string, child_key string, parent string, parent_key string, named boolean")


@query("E7_candidates")
def _(t):
    found = names.candidates({n: list(c.values()) for n, c in _ALIASED.items()}, {"customer": ["customer_id"], "nation": ["nation_id"], "region": ["region_id"], "part": ["part_id"]})[0]
    return _frame(t, found, "child string, child_key string, parent string, parent_key string")


@query("E8_declared_merge")
def _(t):
    s = "source string, target string, role string, status string, decided_by string"
    old = _frame(t, [("a", "b", "", "candidate", "machine"), ("a", "c", "", "rejected", "human")], s)
    new = _frame(t, [("a", "b", "", "verified", "machine"), ("a", "c", "", "verified", "machine"), ("a", "d", "", "candidate", "machine")], s)
    return ir.merge_relations(old, new).select("source", "target", "status")


@query("E11_applied_verdicts")
def _(t):
    done = answers.apply_verdicts(ontology().edges[:2], {("orders", "customer", ""): "refuted"})
    return _frame(t, [(e.source, e.target, e.status) for e in done], "source string, target string, status string")


@query("E15_gates")
def _(t):
    return _frame(t, [(b, q, mining.quality_gate(b, q)) for b, q in ((0, 0), (0, 2), (1, 0))], "blocking int, queue int, verdict string")


@query("E16_families")
def _(t):
    return _frame(t, [(k, len(v)) for k, v in names.families(["ods_order", "dwd_order", "dwd_order_bak", "dim_customer"]).items()], "family string, n int")


@query("E17_source_profile")
def _(t):
    p = src.source_profile({n: [(c, "") for c in t(n).columns] for n in ("orders", "customer", "documents", "labels", "pages")})
    return _frame(t, [(k, len(v)) for k, v in p.items()], "finding string, n int")


@query("E20_basis")
def _(t):
    values = [r.v for r in t("customer").select(F.col("c_mktsegment").alias("v")).distinct().collect()]
    return _frame(t, [(x, answers.quoted_basis(x, values)) for x in ("值「BUILDING」出现在列中", "没有引用")], "reason string, quoted boolean")


@query("E21_code_contracts")
def _(t):
    return _frame(t, mining.join_contracts(["SELECT 1 FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey"] * 2), "left_table string, left_column string, right_table string, right_column string, seen int")


@query("E19_literal_lookup", "SELECT 'part' AS table_name, 'p_brand' AS column_name, 'Brand#11' AS value, count(*) AS n FROM part WHERE p_brand = 'Brand#11' HAVING count(*) > 0")
def _(t):
    return answers.grounded_values({"part": t("part")}, ["brand#11", "nothing"], {"part": ["p_brand", "p_type"]})


@query("G2_G3_questions")
def _(t):
    g = ontology()
    rows = [("orders,region", graphs.answerable(g, ["orders", "region"]), ",".join(graphs.route(g, ["orders", "customer", "nation", "region"]))), ("orders,ghost", graphs.answerable(g, ["orders", "ghost"]), ",".join(graphs.route(g, ["orders", "ghost"])))]
    return _frame(t, rows, "anchors string, verdict string, route string")


@query("G7_O5_search")
def _(t):
    return _frame(t, graphs.search(ontology(), ["customer", "nation"]), "object string, points int")


@query("G8_U4_impact")
def _(t):
    new = ontology()
    del new.objects["part"]
    change = graphs.changes(ontology(), new)
    return _frame(t, [(change["verdict"], x) for x in graphs.impact(change, {"margin": ["part"], "sales": ["orders"]})], "verdict string, touched string")


@query("G9_chain")
def _(t):
    edges, _why = graphs.chain(ontology(), ["lineitem", "orders", "customer"])
    return _frame(t, [(i, e.source, e.target) for i, e in enumerate(edges)], "step int, source string, target string")


@query("U5_drift")
def _(t):
    found = graphs.drift({"ORDERS": ["O_ORDERKEY", "o_gone"], "ghosts": []}, {"orders": t("orders").columns})
    return _frame(t, [(d["type"], d["table"].lower(), d.get("column")) for d in found], "type string, table_name string, column_name string")


@query("U9_concept_merge")
def _(t):
    f = metrics.Filter("x", "=", 1)
    done = answers.merged_concepts([answers.Concept("a", "t", f, decided_by="human")], [answers.Concept("a", "t", f), answers.Concept("b", "t", f)])
    return _frame(t, [(c.name, c.decided_by) for c in done], "concept string, decided_by string")


@query("K4_dump")
def _(t):
    text = ir.dumped(ir.project(t("region").sparkSession, ontology()))
    return _frame(t, [(i, line) for i, line in enumerate(text.split("\n"))], "line int, sql_text string")


@query("K5_semantic_model")
def _(t):
    m = ir.semantic_model("sales", ontology(), {n: [(f.name, f.dataType.simpleString()) for f in t(n).schema.fields] for n in _TABLES})
    return _frame(t, [(e["name"], f["name"], f["datatype"]) for e in m["entities"] for f in e["fields"]], "entity string, field string, datatype string")


@query("Q3_structure", _values([(0, "orders"), (1, "customer"), (1, "nation")], "block, table_name"))
def _(t):
    blocks = analyze("WITH a AS (SELECT o_custkey FROM orders) SELECT * FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN a ON a.o_custkey = c_custkey")
    return _frame(t, [(i, x) for i, b in enumerate(blocks) for x in b.tables.values() if x], "block int, table_name string")


@query("Q5_tables_read")
def _(t):
    spark = t("region").sparkSession.newSession()
    for n in ("orders", "customer"):
        t(n).createOrReplaceGlobalTempView(f"read_{n}")
        spark.table(f"global_temp.read_{n}").createOrReplaceTempView(n)
    return _frame(t, [(x,) for x in gates.tables_read(spark, "SELECT count(*) FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer)")], "table_name string")


@query("Q7_valid_rows")
def _(t):
    base = "SELECT n_name, count(*) FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey"
    rule = [gates.ValidRows("nation", "soft_delete", "del_flag")]
    return _frame(t, [(i, gates.valid_rows(base + tail, RELATIONS, rule).ok) for i, tail in enumerate(("", " AND COALESCE(n.del_flag, 'N') = 'N'"))], "statement int, accepted boolean")


@query("Q10_intent")
def _(t):
    v = answers.intent({"order": "orders", "customer": "customer"}, "SELECT sum(o_totalprice) FROM orders")
    return _frame(t, [(",".join(v["missing"]), ",".join(v["extra"]))], "missing string, extra string")


@query("Q12_record")
def _(t):
    r = metrics.fetched(t("region").select("r_regionkey", "r_name").orderBy("r_regionkey"))
    return _frame(t, [(answers.record([{"sql": "x", **r}])["answer_id"],)], "answer_id string")


@query("Q15_Q16_audit")
def _(t):
    n = t("nation").count()
    done = answers.readjudicated({"nation": t("nation")}, [metrics.Contract("n", "nation", "count"), metrics.Contract("wrong", "nation", "count")], {"n": n, "wrong": n + 100})
    return _frame(t, [(c.name, c.status) for c in done], "metric string, status string")


@query("Q17_replay")
def _(t):
    found = answers.replayed({"a": "1", "b": "2", "c": "3"}, {"a": "1", "b": "failed", "c": "4"})
    return _frame(t, [(k, x) for k, xs in found.items() for x in xs], "outcome string, statement string")


@query("Q18_questions")
def _(t):
    return _frame(t, [(q, wording.question_kind(q)) for q in ("为什么利润下降", "是否合规", "如果涨价", "哪些订单超限", "追溯批次", "订单金额")], "question string, kind string")


@query("Q20_fallback", "SELECT count(*) AS n FROM customer")
def _(t):
    sql = answers.fallback("一共有多少客户", {"客户": "customer", "订单": "orders"})
    return t("customer").sparkSession.sql(sql.replace('"customer"', "{c}"), c=t("customer"))


@query("A10_field_classes")
def _(t):
    return profile.columns_profile(t("orders"), ["o_orderkey", "o_orderstatus"]).select("column_name", "class")
