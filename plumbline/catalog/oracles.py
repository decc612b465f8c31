"""SQL of queries over names, contracts, relations and statements: each takes the same inputs and derives the answer by the rule."""

from __future__ import annotations

from plumbline.catalog.evidence import _ALIASED, CANDIDATES, RELATIONS, _evidence_sql, named_sql
from plumbline.catalog.metadata import _TABLES
from plumbline.registry import ORACLES


def _rows(rows) -> str:
    lit = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"
    return "(VALUES " + ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows) + ")"


_EDGES = _rows([(i, r.child, r.parent, r.child_key, r.parent_key, r.status) for i, r in enumerate(RELATIONS)]) + " e(i, source, target, child_key, parent_key, status)"
_STRONG = f"(SELECT * FROM {_EDGES} WHERE status IN ('verified', 'asserted'))"
_OBJECTS = _rows([(n, c) for n, cs in _ALIASED.items() for c in cs.values()]) + " o(object, attribute)"
_REACH = f"RECURSIVE l AS (SELECT source AS a, target AS b FROM {_STRONG} UNION SELECT target, source FROM {_STRONG}), r AS (SELECT a AS f, a AS t FROM l UNION SELECT r.f, l.b FROM r JOIN l ON l.a = r.t)"
_STATEMENT = "SELECT 1 FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey"
_MINED = ("SELECT sum(o_totalprice) AS revenue FROM orders WHERE o_orderstatus = 'F'", "SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY o_orderpriority", "SELECT sum(o_totalprice) FROM orders WHERE o_orderstatus = 'F'")
_COLUMNS = " UNION ALL ".join(f"SELECT '{n}' AS entity, column_name AS field, column_type AS kind FROM (DESCRIBE {n})" for n in _TABLES)
_READ = "regexp_extract_all(lower(s), '(?:from|join|,)\\s+([a-z_]+)', 1)"

ORACLES.update({
    # -- sources ------------------------------------------------------------------------------------------
    "S2_tables": f"SELECT DISTINCT table_name FROM information_schema.tables WHERE table_name IN ({', '.join(repr(n) for n in _TABLES)}) AND NOT starts_with(table_name, '_')",
    "S5_resolved_columns": "SELECT (SELECT column_name FROM (DESCRIBE lineitem) WHERE lower(column_name) = lower('L_OrderKey')) AS a, (SELECT column_name FROM (DESCRIBE lineitem) WHERE lower(column_name) = lower('l_SUPPKEY')) AS b",
    "S10_S11_documentation": "SELECT column_name, min(text) AS text FROM (VALUES ('documents', 'lang', 'ISO language'), ('documents', 'lang', NULL)) d(table_name, column_name, text) WHERE text IS NOT NULL GROUP BY table_name, column_name",
    "S12_S13_uploaded_long": """WITH w("地区", "2025年_收入", "2025年_成本", "2026年_收入", "2026年_成本") AS (VALUES ('华东', 10.0::DOUBLE, 6.0::DOUBLE, 12.0::DOUBLE, 7.0::DOUBLE))
        SELECT "地区", split_part(k, '_', 1) AS "期间", split_part(k, '_', 2) AS "项目", v AS "值" FROM (UNPIVOT w ON COLUMNS(* EXCLUDE ("地区")) INTO NAME k VALUE v)""",
    "S14_rest_records": """SELECT r->>'a' AS a, CAST(r->'b' AS VARCHAR) AS b FROM (SELECT unnest(CAST('{"data": [{"a": 1, "b": [2]}, {"a": 3}]}'::JSON->'data' AS JSON[])) AS r)""",
    # -- predicates ---------------------------------------------------------------------------------------
    "F2_validation": "SELECT contract, agg IN ('sum', 'count', 'count_distinct', 'avg', 'min', 'max') AND (col IS NOT NULL OR agg = 'count') AS valid FROM (VALUES ('good', 'sum', 'o_totalprice'), ('bad_agg', 'median', 'x'), ('no_column', 'sum', NULL)) c(contract, agg, col)",
    "F11_concept_filters": """WITH q(t) AS (VALUES ('1996年2月的加急有多少')), c(word, col, op, value) AS (VALUES ('紧急订单', 'o_orderpriority', '=', '1-URGENT'), ('加急', 'o_orderpriority', '=', '1-URGENT'), ('坏账', 'c_acctbal', '<', '-1e12'), ('幽灵', 'x', '=', '1')),
        d AS (SELECT make_date(CAST(regexp_extract(t, '([0-9]+)年', 1) AS INTEGER), CAST(regexp_extract(t, '年([0-9]+)月', 1) AS INTEGER), 1) AS d FROM q)
        SELECT col AS column_name, op, value FROM (SELECT c.* FROM c, q WHERE contains(t, word) ORDER BY length(word) DESC LIMIT 1) UNION ALL SELECT 'o_orderdate', '>=', CAST(d AS VARCHAR) FROM d UNION ALL SELECT 'o_orderdate', '<=', CAST(last_day(d) AS VARCHAR) FROM d""",
    "F12_filter_parser": "SELECT text, CASE WHEN regexp_matches(text, '(?i)\\b(or|between|like|select)\\b') THEN NULL ELSE CAST(len(regexp_split_to_array(text, '(?i)\\s+and\\s+')) AS INTEGER) END AS n_filters FROM (VALUES ('a = 1 AND b IN (''x'', ''y'')'), ('a = 1 OR b = 2'), ('a IS NOT NULL')) v(text)",
    "F15_scope": f"WITH q(s) AS (VALUES ('WITH a AS (SELECT * FROM nation) SELECT * FROM a, region')) SELECT DISTINCT x AS beyond FROM (SELECT unnest({_READ}) AS x, regexp_extract_all(lower(s), '([a-z_]+) as \\(', 1) AS own FROM q) WHERE NOT list_contains(own, x) AND x <> 'region'",
    "F16_literals": """SELECT replace(v, '''', '''''') AS literal, '"' || replace(n, '"', '""') || '"' AS name FROM (VALUES ('it''s', 'a"b')) x(v, n)""",
    # -- joins, aggregates, sets --------------------------------------------------------------------------
    "J20_join_hints": f"""WITH s AS (SELECT *, source || ' JOIN ' || target || ' ON ' || source || '.' || child_key || ' = ' || target || '.' || parent_key AS hint FROM {_STRONG}), t(x) AS (VALUES ('orders'), ('customer'), ('supplier')),
        two AS (SELECT a.hint AS h1, b.hint AS h2 FROM s a JOIN s b ON a.target IN (b.source, b.target) JOIN t ON t.x = a.source JOIN t u ON u.x = CASE WHEN a.target = b.source THEN b.target ELSE b.source END WHERE a.target NOT IN (SELECT x FROM t) AND a.source < u.x)
        SELECT hint FROM s WHERE source IN (SELECT x FROM t) AND target IN (SELECT x FROM t) UNION SELECT h1 FROM two UNION SELECT h2 FROM two""",
    "A10_field_classes": "SELECT c AS column_name, CASE WHEN n = 0 THEN 'all_null' WHEN d = 1 THEN 'constant' WHEN d >= 0.95 * n THEN 'near_unique' WHEN d <= 20 OR d <= 0.01 * n THEN 'low_cardinality' ELSE 'high_cardinality' END AS class FROM (SELECT 'o_orderkey' AS c, count(o_orderkey) AS n, count(DISTINCT o_orderkey) AS d FROM orders UNION ALL SELECT 'o_orderstatus', count(o_orderstatus), count(DISTINCT o_orderstatus) FROM orders)",
    "A11_witness": """WITH l AS (SELECT l_extendedprice AS price, 1 - l_discount AS keep, l_extendedprice * (1 - l_discount) AS disc_price, 1 + l_tax AS gross, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS charge FROM lineitem),
        x AS (SELECT 'disc_price' AS target, 'l_extendedprice * keep' AS formula, disc_price AS t, price AS a, keep AS b FROM l UNION ALL SELECT 'charge', 'disc_price * gross', charge, disc_price, gross FROM l UNION ALL SELECT 'charge', 'l_extendedprice * gross', charge, price, gross FROM l UNION ALL SELECT 'charge', 'l_extendedprice * keep', charge, price, keep FROM l UNION ALL SELECT 'gross', 'l_extendedprice * keep', gross, price, keep FROM l),
        n AS (SELECT target, formula, count(*) AS n_rows, count(*) FILTER (WHERE abs(t - a * b) <= greatest(1e-6 * greatest(abs(t), abs(a * b)), 0.011)) AS n_matched, count(*) FILTER (WHERE a <> 0 AND b <> 0 AND a <> b AND abs(t) >= 0.11) AS tells FROM x GROUP BY ALL)
        SELECT target, formula, '*' AS op, n_rows, n_matched FROM n WHERE n_rows >= 20 AND n_matched >= 0.999 * n_rows AND tells >= greatest(20, 0.2 * n_rows)""",
    "A12_supported_formulas": "WITH f(formula, t, op, a, b) AS (VALUES ('t = a + b', 't', '+', 'a', 'b'), ('t = b + a', 't', '+', 'b', 'a'), ('t = a - b', 't', '-', 'a', 'b')), w(t, op, a, b) AS (VALUES ('t', '+', 'a', 'b')), n AS (SELECT formula, CASE WHEN op = '+' THEN t ELSE a END AS whole, list_sort(CASE WHEN op = '+' THEN [a, b] ELSE [t, b] END) AS parts FROM f) SELECT formula, EXISTS (SELECT 1 FROM w WHERE w.t = whole AND list_sort([w.a, w.b]) = parts) AS supported FROM n",
    "A23_A24_comparison": "WITH n AS (SELECT n_nationkey, n_name FROM nation), o AS (SELECT * FROM n WHERE n_nationkey > 0) SELECT NOT EXISTS (SELECT * FROM (SELECT * FROM n EXCEPT ALL SELECT * FROM n)) AS same, NOT EXISTS (SELECT * FROM (SELECT * FROM n EXCEPT ALL SELECT * FROM o)) AND NOT EXISTS (SELECT * FROM (SELECT * FROM o EXCEPT ALL SELECT * FROM n)) AS other",
    "A28_result_digest": "SELECT substr(sha1(string_agg(r, chr(10) ORDER BY r)), 1, 16) AS digest, count(*) AS n_rows FROM (SELECT DISTINCT concat_ws(chr(31), coalesce(n_name, ''), coalesce(CAST(n_nationkey AS VARCHAR), ''), coalesce(CAST(n_regionkey AS VARCHAR), '')) AS r FROM nation)",
    "A35_A36_votes": "WITH v(i, r) AS (VALUES (0, ''), (1, '1|a'), (2, '1|a'), (3, '')), g AS (SELECT r, min(i) AS i, count(*) AS n FROM v WHERE r <> '' GROUP BY r), s AS (SELECT ['a', 'b', 'c'] AS a, ['b', 'c', 'd'] AS b) SELECT CAST((SELECT arg_max(i, n) FROM g) AS INTEGER) AS winner, len(list_intersect(a, b))::DOUBLE / len(list_distinct(a || b)) AS stability FROM s",
    "U5_drift": "WITH b(t, c) AS (VALUES ('orders', 'o_orderkey'), ('orders', 'o_gone'), ('ghosts', NULL)) SELECT CASE WHEN t = 'orders' THEN 'missing_column' ELSE 'missing_table' END AS type, t AS table_name, c AS column_name FROM b WHERE NOT (t = 'orders' AND c IN (SELECT lower(column_name) FROM (DESCRIBE orders)))",
    "U7_triple_changes": "WITH a(s, p, o) AS (VALUES ('a', 'p', 'x'), ('a', 'p', 'y'), ('b', 'p', 'q')), b(s, p, o) AS (VALUES ('a', 'p', 'y'), ('a', 'p', 'z'), ('b', 'p', 'q')), g AS (SELECT s, p FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION SELECT s, p FROM (SELECT * FROM b EXCEPT SELECT * FROM a)) SELECT s, p, (SELECT coalesce(string_agg(o, ',' ORDER BY o), '') FROM (SELECT * FROM a EXCEPT SELECT * FROM b) x WHERE x.s = g.s AND x.p = g.p) AS removed, (SELECT coalesce(string_agg(o, ',' ORDER BY o), '') FROM (SELECT * FROM b EXCEPT SELECT * FROM a) x WHERE x.s = g.s AND x.p = g.p) AS added FROM g",
    "U8_merge_relations": "WITH o(source, target, role, status, decided_by) AS (VALUES ('a', 'b', '', 'rejected', 'human'), ('c', 'd', '', 'candidate', 'machine')), n(source, target, role, status, decided_by) AS (VALUES ('a', 'b', '', 'verified', 'machine'), ('c', 'd', '', 'verified', 'machine'), ('e', 'f', '', 'candidate', 'machine')) SELECT source, target, role, CASE WHEN o.decided_by = 'human' OR n.status IS NULL THEN o.status ELSE n.status END AS status, CASE WHEN o.decided_by = 'human' OR n.status IS NULL THEN o.decided_by ELSE n.decided_by END AS decided_by FROM o FULL JOIN n USING (source, target, role)",
    "U9_concept_merge": "WITH o(concept, decided_by) AS (VALUES ('a', 'human')), n(concept, decided_by) AS (VALUES ('a', 'machine'), ('b', 'machine')) SELECT concept, CASE WHEN o.decided_by = 'human' THEN 'human' ELSE n.decided_by END AS decided_by FROM o FULL JOIN n USING (concept)",
    "E8_declared_merge": "WITH o(source, target, status, by_) AS (VALUES ('a', 'b', 'candidate', 'machine'), ('a', 'c', 'rejected', 'human')), n(source, target, status) AS (VALUES ('a', 'b', 'verified'), ('a', 'c', 'verified'), ('a', 'd', 'candidate')) SELECT source, target, CASE WHEN o.by_ = 'human' OR n.status IS NULL THEN o.status ELSE n.status END AS status FROM o FULL JOIN n USING (source, target)",
    # -- evidence -----------------------------------------------------------------------------------------
    "E7_candidates": f"SELECT child, child_key, parent, parent_key FROM ({named_sql([(ct, c, pt, pk) for ct, cs in _ALIASED.items() for c in cs.values() for pt, pk in (('customer', 'customer_id'), ('nation', 'nation_id'), ('region', 'region_id'), ('part', 'part_id')) if (ct, c) != (pt, pk)])}) WHERE named",
    "E11_applied_verdicts": f"SELECT source, target, CASE WHEN v.verdict = 'refuted' THEN 'candidate' ELSE status END AS status FROM (SELECT * FROM {_EDGES} WHERE i < 2) LEFT JOIN (VALUES ('orders', 'customer', 'refuted')) v(s, t, verdict) ON v.s = source AND v.t = target",
    "E14_evidence_audit": f"""WITH e AS ({_evidence_sql()}), n AS ({named_sql(CANDIDATES)}), j AS (SELECT child AS source, parent AS target, named, CASE WHEN child = 'region' THEN NULL ELSE child_key END AS child_key, parent_key, CASE WHEN child = 'nation' THEN NULL ELSE overlap END AS overlap, child_distinct, parent_unique, child <> 'supplier' AS complete FROM e JOIN n USING (child, child_key, parent, parent_key))
        SELECT source, target, issue FROM (SELECT source, target, unnest([CASE WHEN child_key IS NULL THEN 'no_child_key' END, CASE WHEN overlap IS NULL THEN 'no_overlap' END, CASE WHEN overlap < 60 THEN 'low_overlap' END, CASE WHEN NOT parent_unique THEN 'parent_not_unique' END, CASE WHEN NOT complete THEN 'incomplete' END, CASE WHEN child_distinct = 1 THEN 'single_value' END, CASE WHEN NOT named THEN 'name_mismatch' END]) AS issue FROM j) WHERE issue IS NOT NULL""",
    "E15_gates": "SELECT blocking, queue, CASE WHEN blocking > 0 THEN 'fail' WHEN queue > 0 THEN 'review' ELSE 'pass' END AS verdict FROM (VALUES (0, 0), (0, 2), (1, 0)) v(blocking, queue)",
    "E16_families": "SELECT regexp_replace(regexp_replace(n, '^((fact|dim|dws|dwd|ods|ads|dm)_)+', ''), '(_(bak|backup|offline|tmp|old|copy|hist|[0-9]{4,8}))+$', '') AS family, CAST(count(*) AS INTEGER) AS n FROM (VALUES ('ods_order'), ('dwd_order'), ('dwd_order_bak'), ('dim_customer')) v(n) GROUP BY 1",
    "E17_source_profile": "WITH c AS (" + " UNION ALL ".join(f"SELECT '{n}' AS t, lower(column_name) AS c FROM (DESCRIBE {n})" for n in ("orders", "customer", "documents", "labels", "pages")) + """), k AS (SELECT c, count(DISTINCT t) AS n FROM c GROUP BY c)
        SELECT * FROM (SELECT 'soft_delete' AS finding, CAST(count(DISTINCT t) AS INTEGER) AS n FROM c WHERE regexp_full_match(c, '(is_?)?del(eted?)?(_?flag)?|del_?flag') UNION ALL SELECT 'audit', count(*) FROM k WHERE regexp_full_match(c, '(create|update|insert|modify)(d)?_(time|at|by|user|date)') UNION ALL SELECT 'polymorphic', count(*) FROM c a JOIN c b ON a.t = b.t AND ends_with(a.c, '_type') AND b.c IN (left(a.c, -5) || '_id', left(a.c, -5) || '_no', left(a.c, -5) || '_code')
        UNION ALL SELECT 'hubs', count(*) FROM k WHERE regexp_matches(c, '_(id|no|code)$') AND (SELECT count(DISTINCT t) FROM c) >= 10 UNION ALL SELECT 'envelope', count(*) FROM k WHERE (SELECT count(DISTINCT t) FROM c) >= 5 AND n >= 0.2 * (SELECT count(DISTINCT t) FROM c) AND NOT regexp_matches(c, '_(id|no|code)$') UNION ALL SELECT 'shards', count(DISTINCT t) FROM c WHERE regexp_matches(t, '_(19|20)[0-9]{2}([0-9]{2})?$') UNION ALL SELECT 'scratch', count(DISTINCT t) FROM c WHERE regexp_matches(t, '(^|_)(tmp|temp|bak|backup|test|copy)(_|$)'))""",
    "E20_basis": "SELECT reason, EXISTS (SELECT 1 FROM customer WHERE c_mktsegment = regexp_extract(reason, '「(.*)」', 1)) AS quoted FROM (VALUES ('值「BUILDING」出现在列中'), ('没有引用')) v(reason)",
    "E21_code_contracts": f"""WITH s(s) AS (VALUES ('{_STATEMENT}'), ('{_STATEMENT}')), p AS (SELECT regexp_extract(s, 'FROM (\\w+) (\\w+) JOIN (\\w+) (\\w+) ON (\\w+)\\.(\\w+) = (\\w+)\\.(\\w+)', ['t1', 'a1', 't2', 'a2', 'l', 'lc', 'r', 'rc']) AS m FROM s),
        k AS (SELECT CASE WHEN m.l = m.a1 THEN m.t1 ELSE m.t2 END AS x, m.lc AS xc, CASE WHEN m.r = m.a1 THEN m.t1 ELSE m.t2 END AS y, m.rc AS yc FROM p) SELECT CASE WHEN x < y THEN x ELSE y END AS left_table, CASE WHEN x < y THEN xc ELSE yc END AS left_column, CASE WHEN x < y THEN y ELSE x END AS right_table, CASE WHEN x < y THEN yc ELSE xc END AS right_column, CAST(count(*) AS INTEGER) AS seen FROM k GROUP BY ALL""",
    # -- metadata graph -----------------------------------------------------------------------------------
    "K1_K3_verified_joins": f"SELECT source AS source_table, child_key, target AS target_table, parent_key, '' AS role FROM {_EDGES} WHERE status = 'verified'",
    "K2_consumable_metrics": "SELECT metric, status FROM (VALUES ('revenue', 'certified'), ('orders', 'verified'), ('draft', 'candidate')) m(metric, status) WHERE status IN ('verified', 'certified')",
    "K5_semantic_model": f"SELECT entity, field, CASE WHEN kind LIKE '%INT%' THEN 'Integer' WHEN kind IN ('DOUBLE', 'FLOAT') THEN 'Float' WHEN kind LIKE 'DECIMAL%' THEN 'Decimal' WHEN kind = 'BOOLEAN' THEN 'Boolean' WHEN kind LIKE 'TIMESTAMP%' THEN 'DateTime' WHEN kind = 'DATE' THEN 'Date' ELSE 'String' END AS datatype FROM ({_COLUMNS})",
    "G1_path": f"""WITH RECURSIVE l AS (SELECT i, source AS a, target AS b FROM {_STRONG} UNION ALL SELECT i, target, source FROM {_STRONG}), p AS (SELECT 'lineitem' AS at_, []::INTEGER[] AS steps, ['lineitem'] AS seen UNION ALL SELECT l.b, list_append(steps, i), list_append(seen, l.b) FROM p JOIN l ON l.a = p.at_ WHERE NOT list_contains(seen, l.b)),
        best AS (SELECT steps FROM p WHERE at_ = 'region' ORDER BY len(steps) LIMIT 1) SELECT CAST(k - 1 AS INTEGER) AS step, source, target, true AS strong FROM (SELECT unnest(steps) AS i, unnest(range(1, len(steps) + 1)) AS k FROM best) s JOIN {_EDGES} ON e.i = s.i""",
    "G5_modules": f"WITH {_REACH}, c AS (SELECT o AS object, coalesce((SELECT min(t) FROM r WHERE f = o), o) AS label FROM (SELECT DISTINCT object AS o FROM {_OBJECTS})), w AS (SELECT label, split_part(lower(object), '_', 1) AS word, count(*) AS n FROM c GROUP BY ALL) SELECT (SELECT arg_min(word, (-n, word)) FROM w WHERE w.label = c.label) AS module, object FROM c",
    "G6_dimensions": f"SELECT target AS object, child_key AS via, false AS fan_out FROM {_STRONG} WHERE source = 'orders' UNION ALL SELECT source, child_key, true FROM {_STRONG} WHERE target = 'orders'",
    "G2_G3_questions": f"""WITH {_REACH}, q(anchors, a, b) AS (VALUES ('orders,region', 'orders', 'region'), ('orders,ghost', 'orders', 'ghost')), k AS (SELECT *, b IN (SELECT object FROM {_OBJECTS}) AS known FROM q),
        s(anchors, k, a, b) AS (VALUES ('orders,region', 0, 'orders', 'customer'), ('orders,region', 1, 'customer', 'nation'), ('orders,region', 2, 'nation', 'region'), ('orders,ghost', 0, 'orders', 'ghost'))
        SELECT anchors, CASE WHEN NOT known THEN 'partial' WHEN EXISTS (SELECT 1 FROM r WHERE f = a AND t = b) THEN 'answerable' ELSE 'unanswerable' END AS verdict, (SELECT string_agg(CASE WHEN EXISTS (SELECT 1 FROM {_STRONG} x WHERE x.source = s.a AND x.target = s.b) THEN 'ok' WHEN EXISTS (SELECT 1 FROM {_STRONG} x WHERE x.source = s.b AND x.target = s.a) THEN 'reversed' ELSE 'broken' END, ',' ORDER BY s.k) FROM s WHERE s.anchors = k.anchors) AS route FROM k""",
    "G7_O5_search": f"SELECT object, CAST(sum(p) AS INTEGER) AS points FROM (SELECT object, w, 5 * CAST(contains(object, w) AS INTEGER) + CAST(bool_or(contains(attribute, w)) AS INTEGER) AS p FROM {_OBJECTS}, (VALUES ('customer'), ('nation')) x(w) GROUP BY object, w) GROUP BY object HAVING sum(p) > 0 ORDER BY points DESC, object LIMIT 5",
    "G8_U4_impact": f"WITH o AS (SELECT DISTINCT object FROM {_OBJECTS}), n AS (SELECT * FROM o WHERE object <> 'part'), gone AS (SELECT * FROM o EXCEPT SELECT * FROM n), u(name, used) AS (VALUES ('margin', 'part'), ('sales', 'orders')) SELECT CASE WHEN (SELECT count(*) FROM gone) > 0 THEN 'breaking' ELSE 'safe' END AS verdict, name AS touched FROM u WHERE used IN (SELECT object FROM gone)",
    "G9_chain": f"WITH s(step, a, b) AS (VALUES (0, 'lineitem', 'orders'), (1, 'orders', 'customer')), m AS (SELECT step, source, target, count(*) OVER (PARTITION BY step) AS n FROM s JOIN {_STRONG} x ON (x.source, x.target) IN ((a, b), (b, a))) SELECT step, source, target FROM m WHERE n = 1",
    # -- governance ---------------------------------------------------------------------------------------
    "Q5_tables_read": f"WITH q(s) AS (VALUES ('SELECT count(*) FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer)')) SELECT DISTINCT unnest({_READ}) AS table_name FROM q",
    "Q7_valid_rows": "SELECT CAST(i AS INTEGER) AS statement, NOT contains(s, 'JOIN nation n') OR regexp_matches(s, '(?i)coalesce\\(n\\.del_flag, ''N''\\) = ''N''|n\\.del_flag IS NULL') AS accepted FROM (VALUES (0, 'FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey'), (1, 'FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey AND COALESCE(n.del_flag, ''N'') = ''N''')) v(i, s)",
    "Q10_intent": f"WITH o(object, t) AS (VALUES ('order', 'orders'), ('customer', 'customer')), r AS (SELECT unnest({_READ}) AS t FROM (VALUES ('SELECT sum(o_totalprice) FROM orders')) q(s)) SELECT (SELECT coalesce(string_agg(object, ',' ORDER BY object), '') FROM o WHERE t NOT IN (SELECT t FROM r)) AS missing, (SELECT coalesce(string_agg(t, ',' ORDER BY t), '') FROM r WHERE t NOT IN (SELECT t FROM o)) AS extra",
    "Q11_number_check": "WITH k AS (SELECT count(*)::DOUBLE AS v FROM nation), n AS (SELECT v AS x, 0.05 AS room FROM k UNION ALL SELECT 12.5, 0.05) SELECT CAST(count(*) FILTER (WHERE abs(x - v) <= room) AS INTEGER) AS known, CAST(count(*) FILTER (WHERE NOT abs(x - v) <= room) AS INTEGER) AS unknown FROM n, k",
    "Q13_U10_mined_metrics": f"""WITH s(s) AS {_rows([(x,) for x in _MINED]).replace('(VALUES', '(VALUES')}, p AS (SELECT regexp_extract(lower(s), 'from ([a-z_]+)', 1) AS t, regexp_extract(lower(s), '(sum|count|avg|min|max)\\(([a-z_*]+)\\)', ['agg', 'col']) AS m, CASE WHEN contains(lower(s), ' where ') THEN len(regexp_split_to_array(regexp_extract(lower(s), ' where (.*?)( group by .*)?$', 1), ' and ')) ELSE 0 END AS f, regexp_extract(s, 'WHERE (.*?)( GROUP BY .*)?$', 1) AS w FROM s)
        SELECT t AS table_name, m.agg AS agg, CASE WHEN m.col = '*' THEN NULL ELSE m.col END AS column_name, CAST(f AS INTEGER) AS n_filters, CAST(count(*) AS INTEGER) AS seen FROM p GROUP BY t, m, f, w""",
    "Q14_adjudicated": "WITH v AS (SELECT sum(o_totalprice) AS own FROM orders WHERE o_orderstatus = 'F'), r(metric, reference) AS (SELECT 'revenue', (SELECT sum(o_totalprice) FROM orders WHERE o_orderstatus = 'F') UNION ALL SELECT 'wrong', 1.0) SELECT metric, CASE WHEN abs(own - reference) <= 1e-6 * abs(reference) THEN 'verified' ELSE 'candidate' END AS status FROM r, v",
    "Q15_Q16_audit": "WITH n AS (SELECT count(*) AS n FROM nation), r AS (SELECT 'n' AS metric, n AS reference FROM n UNION ALL SELECT 'wrong', n + 100 FROM n) SELECT metric, CASE WHEN n = reference THEN 'verified' ELSE 'candidate' END AS status FROM r, n",
    "Q17_replay": "WITH a(s, d) AS (VALUES ('a', '1'), ('b', '2'), ('c', '3')), b(s, d) AS (VALUES ('a', '1'), ('b', 'failed'), ('c', '4')) SELECT CASE WHEN b.d = 'failed' THEN 'broken' WHEN a.d = b.d THEN 'same' ELSE 'changed' END AS outcome, s AS statement FROM a JOIN b USING (s)",
    "Q18_questions": "SELECT q AS question, CASE WHEN regexp_matches(q, '如果|假如|假设|若') THEN 'what_if' WHEN regexp_matches(q, '为什么|原因|为何') THEN 'explain' WHEN regexp_matches(q, '追溯|追踪|来源|上游|下游') THEN 'trace' WHEN regexp_matches(q, '哪些|多少个违反|监控|预警') THEN 'monitor' WHEN regexp_matches(q, '是否|能不能|可以吗|合规|需不需要') THEN 'judge' ELSE 'lookup' END AS kind FROM (VALUES ('为什么利润下降'), ('是否合规'), ('如果涨价'), ('哪些订单超限'), ('追溯批次'), ('订单金额')) v(q)",
})
