"""Edge cases of operators on small tables."""

from __future__ import annotations

import io
from datetime import date

import pytest

from plumbline.functions import names, wording
from plumbline.operators import keys, metrics, profile, results, rules, text, timelines, witness
from plumbline.plans import graph as graphs
from plumbline.plans import mining
from plumbline.plans import relational_ir as ir
from plumbline.sources import headers
from plumbline.sources import tables as src


def row(df):
    return df.first().asDict()


def test_signals_of_odd_keys(spark):
    child = spark.createDataFrame([("121",), (" 121 ",), ("x",), ("",), (None,)], "k string")
    parent = spark.createDataFrame([(121,), (7,), (None,)], "k long")
    s = row(keys.relation_signals(child, "K", parent, "k"))
    assert (s["overlap"], s["child_distinct"], s["matched_distinct"], s["child_unique"], s["parent_unique"]) == (50.0, 2, 1, False, False)
    none = row(keys.relation_signals(child.limit(0), "k", parent, "k"))
    assert none["overlap"] == -1.0 and none["child_unique"]
    with pytest.raises(ValueError):
        keys.relation_signals(child, "nope", parent, "k")


def test_batched_signals_agree_with_single_ones(spark):
    a = spark.createDataFrame([("1",), (" 2",), ("x",), (None,), ("",)], "k string")
    b = spark.createDataFrame([(1, 5), (2, 5), (3, None)], "id long, z int")
    none = b.limit(0)
    pairs = [("a", "k", "b", "id"), ("b", "z", "a", "k"), ("none", "id", "b", "id"), ("none", "id", "none", "z")]
    tables = {"a": a, "b": b, "none": none}
    got = {(r.child, r.child_key, r.parent, r.parent_key): r.asDict() for r in keys.batched_signals(tables, pairs).collect()}
    for ct, ck, pt, pk in pairs:
        want = row(keys.relation_signals(tables[ct], ck, tables[pt], pk))
        assert {k: got[ct, ck, pt, pk][k] for k in ("overlap", "child_distinct", "parent_distinct", "matched_distinct", "child_rows", "parent_rows", "child_unique", "parent_unique")} == {k: v for k, v in want.items() if not k.startswith("evidence")}


def test_composite_keys_are_compared_jointly(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "p int, q string")
    b = spark.createDataFrame([(1, "y"), (2, "x")], "p int, q string")
    assert row(keys.relation_signals(a, "p,q", b, "p,q"))["matched_distinct"] == 0


def test_verdicts(spark):
    e = spark.createDataFrame([("a", 100.0, True, 5, True), ("b", 100.0, True, 5, False), ("c", 100.0, False, 5, True), ("d", 10.0, True, 5, True), ("e", 100.0, True, 2, True), ("f", float("nan"), True, 5, True)], "n string, overlap double, parent_unique boolean, child_distinct int, named boolean")
    from pyspark.sql import functions as F

    got = {r.n: (r.status, r.reason) for r in keys.verdicts(e, F.col("named")).collect()}
    assert got == {"a": ("verified", "proven"), "b": ("candidate", "name_mismatch"), "c": ("candidate", "weak_overlap"), "d": ("drop", "low_overlap"), "e": ("drop", "few_values"), "f": ("drop", "invalid_overlap")}
    one = spark.createDataFrame([(100.0, True, 1)], "overlap double, parent_unique boolean, child_distinct int")
    assert row(keys.verdicts(one, min_distinct=1))["reason"] == "single_value"


def test_foreign_key_without_rows_is_not_proven(spark):
    p = spark.createDataFrame([(1,)], "id int")
    assert row(keys.foreign_key_evidence(spark.createDataFrame([(None,)], "id int"), "id", p, "id"))["decision"] == "declared_fk_no_referencing_rows"
    assert row(keys.foreign_key_evidence(spark.createDataFrame([(2,)], "id int"), "id", p, "id"))["status"] == "candidate"


def test_live_rows(spark):
    df = spark.createDataFrame([("N",), ("Y",), (None,), ("0",), ("1",), ("",)], "f string")
    assert df.where(keys.live("f")).count() == 4


def test_latest_and_versions(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", None, "z")], "k string, t int, v string")
    assert {(r.k, r.v) for r in keys.latest(df, "k", "t").collect()} == {("a", "y"), ("b", "z")}


def test_witness_needs_informative_rows(spark):
    good = spark.createDataFrame([(float(i), float(i + 1), float(2 * i + 1)) for i in range(1, 40)], "a double, b double, t double")
    assert [(r.target, r.formula) for r in witness.discover(good, ["a", "b", "t"]).collect()] == [("t", "a + b")]
    zeros = spark.createDataFrame([(float(i), 0.0, float(i)) for i in range(1, 40)], "a double, b double, t double")
    assert not witness.discover(zeros, ["a", "b", "t"]).collect()
    assert not witness.discover(good.limit(10), ["a", "b", "t"]).collect()
    assert witness.supports("t = b + a", [dict(target="t", left_input="a", op="+", right_input="b")])
    last = witness.discover(good, ["t", "a", "b"]).collect()
    assert [(r.target, r.formula) for r in last] == [("b", "t - a")]
    told = [r.asDict() for r in last]
    assert all(witness.supports(f, told) for f in ("t = a + b", "t = b + a", "a = t - b", "b = t - a")) and not any(witness.supports(f, told) for f in ("t = a - b", "a = t + b", "t = a * b", "t", "t = a + b + c"))


def test_contract_validation(spark):
    with pytest.raises(ValueError):
        metrics.validated(metrics.Contract("m", "t", "sum"))
    with pytest.raises(ValueError):
        metrics.validated(metrics.Contract("m", "t; drop", "count"))
    with pytest.raises(ValueError):
        metrics.scalar(float("nan"))
    c = metrics.Contract("m", "t", "sum", "v", (metrics.Filter("s", "in", ("a", "b'c")),), "d", ("quarter",), ("s",))
    assert metrics.to_sql(c, "quarter") == metrics.to_sql(c, "quarter") and "'b''c'" in metrics.to_sql(c)
    df = spark.createDataFrame([("a", 1.0, "2024-05-01"), ("z", 9.0, "2024-05-01")], "s string, v double, d string")
    assert [tuple(r) for r in metrics.compiled(df, c, "quarter").collect()] == [("2024-Q2", "a", 1.0)]
    assert metrics.missing_columns(df, metrics.Contract("m", "t", "sum", "w")) == ["w"]


def test_comparison():
    r = lambda *rows: {"rows": list(rows)}
    assert metrics.same_results(r(("a", 100.0)), r(("a", 100.5)))[0]
    assert metrics.same_results(r(("a", 100.0)), r(("a", 102.0))) == (False, "value")
    assert metrics.same_results(r(("1", 5)), r((1, 5))) == (False, "dimensions")
    assert metrics.same_results(r(), r((1,))) == (False, "empty")
    assert metrics.same_results(r((0.005,)), r((0,)))[0] and not metrics.same_results(r((1,)), r((2,)), tolerance=0)[0]
    assert metrics.same_results({"rows": [(1,)], "truncated": True}, r((1,))) == (False, "truncated")
    assert metrics.same_results(r(("x", "b")), r(("x", "b")), "max")[0] and not metrics.same_results(r(("x", "b")), r(("x", "b")), "sum")[0]


def test_people_are_never_overruled():
    old = {"m": metrics.Contract("m", "t", "sum", "v", status="certified")}
    new = metrics.merged(old, [metrics.Contract("m", "t", "sum", "v", status="candidate"), metrics.Contract("m", "t", "avg", "v", status="verified")])
    assert new["m"].status == "certified" and new["m#2"].agg == "avg"


def test_rules(spark):
    df = spark.createDataFrame([(1, "100", "a"), (2, "99", None), (3, "abc", "")], "id int, n string, s string")
    hit = lambda c: [r.id for r in df.where(rules.condition(c)).orderBy("id").collect()]
    assert hit(rules.Condition("n", ">=", 100)) == [1] and hit(rules.Condition("n", "!=", 99)) == [1, 3]
    assert hit(rules.Condition("s", "missing")) == [2, 3] and hit(rules.Condition("s", "exists")) == [1]
    assert hit(rules.Condition("s", "in", ("a", "b"))) == [1] and hit(rules.Condition("n", "contains", "9")) == [2]
    twice = [rules.Rule("a", "t", (rules.Condition("n", ">", 1),), "yes"), rules.Rule("a", "t", (rules.Condition("n", ">", 1),), "no")]
    assert {i["type"] for i in rules.consistency(twice)} == {"duplicate_id", "contradiction"}


def test_results(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (2, "y")], "a int, b string")
    assert row(results.digest(a)) == row(results.digest(a.orderBy("b", ascending=False)))
    assert not results.equal_frames(a, a.distinct())
    assert results.equality((["a"], [("1",), (2,)]), (["b", "a"], [("x", 2.0), ("y", 1)])) == {"strict": False, "columns": True}
    assert results.status(["n"], [(None,)]) == "empty" and results.status(["n"], None) == "failed" and results.status(["n"], [(0,)]) == "data"
    assert results.bootstrap([1, 0, 1], [0, 0, 1]) == results.bootstrap([1, 0, 1], [0, 0, 1])
    assert results.vote([[], [], [(1,)]]) == 2 and results.vote([[(1,)], [(2,)]], lambda t: t[-1]) == 1
    assert results.nearest_rank([1, 2, 3, 4], 0.5) == 2
    assert [i["token"] for i in results.check_numbers("2024年5月收入1.2万,下降5.0%,共 130 台", [12000, -5.0])] == ["130"]


def test_timelines(spark):
    s = spark.createDataFrame([("k", 1, 5.0), ("k", 2, 5.0)], "k string, no int, q double")
    d = spark.createDataFrame([("k", 1, 3.0), ("k", 2, 4.0)], "k string, no int, q double")
    assert {tuple(r)[1:] for r in timelines.fifo(s, d, "k", "no", "q").collect()} == {(1, 1, 3.0), (1, 2, 2.0), (2, 2, 2.0)}
    x = spark.sql("select date'2024-01-30' a, date'2024-02-01' b union all select date'2024-02-02', date'2024-02-01'")
    assert timelines.per_day(x, "a", "b").count() == 3


def test_text(spark):
    d = spark.createDataFrame([(1, "数据质量 check_sql"), (2, "数据"), (3, "")], "id int, t string")
    got = {r.id: r.t for r in d.select("id", text.tokens(d["t"]).alias("t")).collect()}
    assert got == {1: ["check_sql", "数据", "据质", "质量"], 2: ["数据"], 3: []}
    assert [r.id for r in text.bm25(d, "id", "t", ["数据"]).collect()] == [2, 1]
    assert [r.text for r in text.chunks(spark.createDataFrame([(1, "abcdefghij")], "id int, t string"), "id", "t", 4, 1).collect()] == ["abcd", "defg", "ghij"]
    assert wording.tokens("数据a_1") == ["数据", "a_1"] and wording.bigram_similarity("数据", "数据") == 1.0


def test_profile_classes(spark):
    df = spark.createDataFrame([(None, 1, i) for i in range(30)], "a string, b int, c int")
    assert {r.column_name: r["class"] for r in profile.columns_profile(df, ["a", "b", "c"]).collect()} == {"a": "all_null", "b": "constant", "c": "near_unique"}


def test_names():
    ok = names.compatible
    assert ok("customer_id", "customers", "id") and not ok("order_id", "customers", "id")
    assert ok("dev_type_code", "device_type", "device_type_code") and ok("mete_dev_type_code", "dev_type", "dev_type_code")
    assert not ok("line_no", "production_line", "line_id") and not ok("account_code", "account", "account_id")
    assert ok("manager_id", "employee", "id", "employee") and ok("ReportsTo", "Employee", "EmployeeId", "Employee")
    assert not ok("cycle_count_id", "invoice", "invoice_id", "cycle_count") and not ok("o_custkey", "customer", "c_custkey")
    assert ok("owner_user_id", "users", "id") and ok("sale_date", "dim_date", "date") and not ok("a,b", "t", "a")
    assert names.singular("categories") == "category" and names.families(["ods_order_bak", "dwd_order", "x_20240101"]) == {"order": ["ods_order_bak", "dwd_order"], "x": ["x_20240101"]}


def test_names_as_words():
    ok, same = names.compatible, names.same_things
    assert names.read("owner_entNo") == names.Name(("owner", "enterprise"), "no", ("owner", "ent", "no")) and names.read("orderid").words == ("order",)
    assert same("customer_id", "CustomerId") and same("prod_id", "product_id") and same("id", "ID") and same("owner_entNo", "ent_no") and same("pm_zone_sn", "zone_sn")
    for a, b in [("ReportsTo", "EmployeeId"), ("order_id", "customer_id"), ("order_id", "id"), ("alarm_type", "type_code"), ("x_status", "status"), ("type_code", "dev_type_code"), ("dev_no", "sys_no"), ("a,b", "a")]:
        assert not same(a, b), (a, b)
    assert same("prod_id,ver", "product_id,ver") and not same("order_id,qty", "order_id,customer_id")
    for c, p in [("customer_id,line_no", "id,unrelated"), ("customer_id,line_no", "id"), ("customer_id,", "customer_id,"), ("id,id", "id,id"), ("", "")]:
        assert not ok(c, "customers", p), (c, p)
    assert not ok("order_id", "", "customer_id") and ok("dev_group_id", "meta__meta_device_group", "id") and ok("business_date", "dim_calendar", "calendar_date", "fact_lead")
    assert not ok("line_id", "fact_cycle_count_line", "cycle_count_line_id", "dim_equipment") and not ok("cycle_count_id", "fact_cycle_count_line", "cycle_count_line_id", "fact_cycle_count")
    assert not ok("supplier_id", "fact_supplier_eval", "eval_id", "fact_x") and not ok("parent_id", "categories", "category_id", "products") and ok("parent_id", "categories", "category_id", "categories")
    assert ok("manager_id", "employees", "employee_id", "orders") and names.roles("ReportsTo")[0] and names.roles("parent_part") == (True, ()) and names.roles("amount") == (False, ())
    assert [names.score("customer_id", t, p) for t, p in (("customer", "id"), ("customers", "id"), ("unrelated", "other_id"))] == [2, 1, 0]


def test_name_candidates():
    schema, keys = {"orders": ["customer_id", "ref", "order_id"], "notes": ["owner_type", "owner_id"]}, {"customers": ["id", "customer_id"]}
    found, left = names.candidates(schema, keys, {("orders", "ref"): "see customers"}, most=2)
    assert found[0] == ("orders", "customer_id", "customers", "customer_id") and (len(found), left) == (2, 2)
    assert names.polymorphic(schema) == [("notes", "owner_id", "owner_type")]


def test_wording():
    assert wording.chinese_number("三万五千") == 35000 and wording.chinese_number("1.2亿") == 1.2e8 and wording.chinese_number("十二") == 12 and wording.chinese_number("abc") is None
    assert wording.date_range("2024年2月", date(2025, 1, 1)) == (date(2024, 2, 1), date(2024, 2, 29))
    assert wording.date_range("去年", date(2025, 1, 1)) == (date(2024, 1, 1), date(2024, 12, 31)) and wording.date_range("上月", date(2025, 1, 15))[0] == date(2024, 12, 1)
    assert wording.longest_aliases("大额订单的订单", {"订单": "order", "大额订单": "large"}) == [("大额订单", "large"), ("订单", "order")]
    assert wording.question_kind("为什么下降") == "explain"


def test_graph():
    E = graphs.Edge
    g = graphs.Graph({"a": {}, "b": {}, "c": {}, "lone": {}}, [E("a", "b", status="verified"), E("b", "c"), E("a", "a"), E("a", "gone", status="verified")])
    path, strong = graphs.path(g.edges, "a", "c")
    assert [e.target for e in path] == ["b", "c"] and not strong
    assert graphs.route(g, ["a", "b", "a", "c"]) == ["ok", "reversed", "broken"]
    h = graphs.health(g)
    assert {e["type"] for e in h["errors"]} == {"dangling", "self_loop"} and {s["type"] for s in h["signals"]} == {"isolated"}
    assert graphs.answerable(g, ["a", "b"]) == "answerable" and graphs.answerable(g, ["a", "c"]) == "partial" and graphs.answerable(g, ["a", "lone"]) == "unanswerable" and graphs.answerable(g, ["a"]) == "partial"
    change = graphs.changes(g, graphs.Graph({"a": {}, "b": {}, "lone": {}}, [E("a", "b")]))
    assert change["verdict"] == "breaking" and graphs.impact(change, {"rule": ["c"], "other": ["lone"]}) == ["rule"]
    assert graphs.drift({"T": ["A", "B"], "U": []}, {"t": ["a"]}) == [{"type": "missing_column", "table": "T", "column": "B"}, {"type": "missing_table", "table": "U"}]


def test_mining():
    (c,) = mining.mine("SELECT region, SUM(t.amount) AS revenue FROM sales t WHERE status = 'A' AND kind IN ('x','y') GROUP BY region")
    assert (c.name, c.table, c.column, c.dimensions, len(c.filters)) == ("revenue", "sales", "amount", ("region",), 2)
    assert not mining.mine("SELECT SUM(a) FROM t WHERE a = 1 OR b = 2") and not mining.mine("SELECT SUM(a.x) FROM a JOIN b ON a.id = b.id")
    assert mining.join_contracts(["SELECT 1 FROM a JOIN b ON a.bid = b.id"] * 2) == [("a", "bid", "b", "id", 2)]
    assert mining.code_meanings("状态:0 正常 1 停用") == {"0": "正常", "1": "停用"}


def test_sources(spark, tmp_path):
    out = headers.uploaded(spark, "up", "地区,2025年,,2026年,\n,收入,成本,收入,成本\n华东,10,6,12,7\n华北,8,5,9,5.5\n")
    assert out["up"].columns == ["地区", "2025年_收入", "2025年_成本", "2026年_收入", "2026年_成本"]
    assert {tuple(r) for r in out["up_long"].where("`地区` = '华北' and `项目` = '成本'").collect()} == {("华北", "2025年", "成本", 5.0), ("华北", "2026年", "成本", 5.5)}
    assert headers.uploaded(spark, "x", "a,b\n1,2\n")["x"].columns == ["a", "b"]
    assert src.local_type("BIGINT") == "bigint" and src.local_type("varchar(9)") == "string" and src.local_type("LONGBLOB") is None
    df = spark.range(30).withColumnRenamed("id", "k")
    cut, was = src.imported(df, "k", full=10, sample=5)
    assert was and [r.k for r in cut.collect()] == [29, 28, 27, 26, 25]
    src.save(df, str(tmp_path / "t"))
    src.save(df.limit(3), str(tmp_path / "t"))
    before = src.load(spark, str(tmp_path / "t"))
    assert before.count() == 3
    src.save(df, str(tmp_path / "t"))
    assert src.load(spark, str(tmp_path / "t")).count() == 30 and before.count() == 3  # who has begun reads on
    src.save(df.limit(1), str(tmp_path / "t"), "json")
    assert src.load(spark, str(tmp_path / "t")).count() == 1 and len([x for x in (tmp_path / "t").iterdir() if x.name.startswith("v-")]) == 2
    src.save_field_profile(df, ["k"], str(tmp_path / "profile"))
    assert spark.read.csv(str(tmp_path / "profile"), header=True).first()["class"] == "near_unique"
    s = src.Sources(spark)
    s.register(src.Source("here", str(tmp_path), ()))
    with pytest.raises(KeyError):
        s.resolve("nowhere")
    assert src.read_rest(spark, '{"data": [{"a": 1, "b": [2]}, {"a": null}]}').count() == 2
    assert "soft" in "".join(src.source_profile({"t": [("is_del", "int")]}))


def test_archives(spark, tmp_path):
    import zipfile

    from plumbline.sources import files

    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("q.sql", "select 1")
        z.writestr("../evil.sql", "x")
        z.writestr("image.png", "x")
    with zipfile.ZipFile(tmp_path / "b.docx", "w") as z:
        z.writestr("word/document.xml", '<w:p a="1"><w:t>one &amp; </w:t><w:t>two</w:t></w:p><w:p ><w:t>three</w:t></w:p>')
    found = {(r.member, r.text, r.left_out) for r in files.texts(spark, str(tmp_path)).collect()}
    assert found >= {("q.sql", "select 1", None), ("", "one & two\nthree", None)} and all(t is None and why for m, t, why in found if m not in ("q.sql", ""))
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("a.sql", "x" * 10)
        z.writestr("b.sql", "y" * 100)
        z.writestr("c.sql", "z" * 12)
    assert [(n, why) for n, _, why in files.members(data.getvalue(), most=15, largest=50)] == [("a.sql", None), ("b.sql", "too large"), ("c.sql", "archive too large")]


def test_workbooks(spark):
    import zipfile

    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>地区</t></si><si><r><t>2025</t></r><r><t>年</t></r></si><si><t>收入</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c></row><row><c r="B2" t="s"><v>2</v></c><c r="C2" t="inlineStr"><is><t>成本</t></is></c></row><row><c r="A3" t="str"><v>华东</v></c><c r="B3"><f>5+5</f><v>10</v></c><c r="C3"><v>6.5</v></c></row></sheetData></worksheet>')
    out = headers.uploaded(spark, "w", headers.workbook_text(data.getvalue()))
    assert out["w"].columns == ["地区", "2025年_收入", "2025年_成本"] and {tuple(r) for r in out["w_long"].collect()} == {("华东", "2025年", "收入", 10.0), ("华东", "2025年", "成本", 6.5)}


def test_external_sources_are_only_read():
    o = src.external_options("jdbc:mysql://h/db", "sales.orders", ["id", "amount"])
    assert o["query"] == "SELECT id, amount FROM sales.orders" and o["sessionInitStatement"].endswith("READ ONLY") and "sessionInitStatement" not in src.external_options("jdbc:h2:mem", "t", ["a"])
    assert src.checked_external("WITH a AS (SELECT 'drop; delete' AS x FROM t) SELECT * FROM a;")
    for bad in ("DELETE FROM t", "SELECT 1; SELECT 2", "SELECT * INTO x FROM t", "WITH a AS (DELETE FROM t RETURNING 1) SELECT * FROM a", "SELECT pg_sleep(9)", "SELECT load_file('/etc/passwd')", "", "EXPLAIN SELECT 1"):
        with pytest.raises(ValueError):
            src.checked_external(bad)
    for table, column in (("t; drop table x", "a"), ("t", "a, (select 1)")):
        with pytest.raises(ValueError):
            src.external_options("jdbc:h2:mem", table, [column])


def test_merges(spark):
    s = "source string, target string, role string, status string, decided_by string"
    old = spark.createDataFrame([("a", "b", "", "asserted", "human")], s)
    new = spark.createDataFrame([("a", "b", "", "rejected", "machine")], s)
    assert row(ir.merge_relations(old, new))["status"] == "asserted"
    t = "s string, p string, o string"
    base, ours, theirs = (spark.createDataFrame(x, t) for x in ([("a", "p", "x")], [("a", "p", "y")], [("a", "p", "z")]))
    assert row(ir.three_way(base, ours, theirs))["conflict"] and not row(ir.three_way(base, base, theirs))["conflict"]
    assert "INSERT INTO ont_object" in ir.dumped(ir.project(spark, graphs.Graph({"a": {}})))
    assert ir.datatype("DECIMAL(9,2)") == "Decimal" and ir.datatype("text") == "String"


def test_streams(spark, tmp_path):
    from plumbline.streaming import events as st

    spark.sql("select 1 as user_id, timestamp'2024-01-01 10:00:00' as ts, 5.0D as value union all select 1, timestamp'2024-01-02 11:00:00', 7.0D").write.parquet(str(tmp_path / "e"))
    schema = spark.read.parquet(str(tmp_path / "e")).schema
    got = st.collected(st.daily(st.stream(spark, str(tmp_path / "e"), schema), "ts", ["user_id"], "value"), "daily_test", "complete")
    assert {(str(r.day), r.n, r.total) for r in got.collect()} == {("2024-01-01", 1, 5.0), ("2024-01-02", 1, 7.0)}
    seen = []
    st.reverify(st.stream(spark, str(tmp_path / "e"), schema), lambda b: seen.append(b.count()), str(tmp_path / "c")).awaitTermination()
    assert seen == [2]
    hits = st.alerts(st.stream(spark, str(tmp_path / "e"), schema), "ts", "user_id", [rules.Rule("big", "e", (rules.Condition("value", ">", 1),), "look")])
    assert st.collected(hits, "alerts_test").count() == 1


def test_store(tmp_path):
    from plumbline.sources.store import Store, write_json

    path = tmp_path / "deep" / "s.json"
    write_json(path, {"relations": [1]})
    store = Store(path, [lambda v: {"links": v["relations"]}], {"links": []})
    assert store.load() == {"links": [1], "version": 1}
    store.save({"links": [2]})
    assert store.load()["links"] == [2] and Store(tmp_path / "none", empty={"a": 1}).load() == {"a": 1, "version": 0}
    assert [f.name for f in path.parent.iterdir()] == ["s.json"]
    with pytest.raises(ValueError):
        Store(path).load()


def test_registered_tables_and_event_logs(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "numbers.parquet"))
    sources = src.Sources(spark)
    one = src.Source("one", str(tmp_path), ("numbers",))
    assert sources.register(one, "p_") == ["p_numbers"] and sources.register(one, "p_") == []
    assert "p_numbers" in sources.user_tables() and sources.schema(["p_numbers"]) == {"p_numbers": [("id", "bigint")]}
    assert sources.same("one", "one") and sources.user_tables(["nothing"]) == []
    assert spark.table(sources.upload("my file", spark.range(2))).count() == 2
    cleaned = sources.with_cleaning({"p_numbers": spark.range(1)})
    assert cleaned.table("p_numbers").count() == 1 and spark.table("p_numbers").count() == 3
    for _ in range(2):
        src.append_events(spark.createDataFrame([("step", 1.5)], "name string, seconds double"), str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 2
    df = spark.createDataFrame([(bytearray(b"\x01\x00"),), (bytearray(b"123456789"),)], "b binary")
    assert [r[0] for r in df.select(src.bit_value(df["b"])).collect()] == ["256", "313233343536373839"]


def test_triples_escape_literals(spark):
    df = spark.createDataFrame([("urn:model:a", "p", 'say "x" \\ y\nz'), ("urn:model:a", "q", "urn:model:b")], "s string, p string, o string")
    assert [r.line for r in ir.n_triples(df).collect()] == ['<urn:model:a> <urn:model:p> "say \\"x\\" \\\\ y\\nz" .', "<urn:model:a> <urn:model:q> <urn:model:b> ."]
