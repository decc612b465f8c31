"""Summary layers beyond sales and risk, evidence channels and cleaning kinds, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from plumbline.catalog.evidence import _ALIASED, RELATIONS, ontology
from plumbline.functions import names
from plumbline.operators import channels, cleaning, keys, timelines
from plumbline.plans import gates, mining
from plumbline.plans import relational_ir as ir
from plumbline.registry import query
from plumbline.sources import tables as src

# -- summary layers -----------------------------------------------------------------------------------------


@query("D9_after_sales", "SELECT CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS day, p_brand, count(*) FILTER (WHERE l_returnflag = 'R') AS n_returned, round(sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END), 2) AS returned, round(sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) / sum(l_quantity), 6) AS return_rate FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL")
def _(t):
    back = F.when(F.col("l_returnflag") == "R", F.col("l_quantity")).otherwise(0.0)
    j = t("lineitem").join(t("part").select("p_partkey", "p_brand"), F.col("p_partkey") == F.col("l_partkey"))
    return j.groupBy(F.to_date("l_shipdate").cast("string").alias("day"), "p_brand").agg(F.count_if(F.col("l_returnflag") == "R").alias("n_returned"), F.round(F.sum(back), 2).alias("returned"), F.round(F.sum(back) / F.sum("l_quantity"), 6).alias("return_rate"))


@query("D10_cash_in_transit", """WITH o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS a, greatest(CAST(o_orderdate AS DATE), max(CAST(l_shipdate AS DATE))) AS b, round(o_totalprice * 100) AS v FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderdate, o_totalprice),
  m AS (SELECT a AS day, v FROM o UNION ALL SELECT b, -v FROM o), d AS (SELECT day, sum(v) AS v FROM m GROUP BY day) SELECT CAST(day AS VARCHAR) AS day, CAST(sum(v) OVER (ORDER BY day) AS BIGINT) AS in_transit_cents FROM d""")
def _(t):
    last = t("lineitem").groupBy("l_orderkey").agg(F.max(F.to_date("l_shipdate")).alias("shipped"))
    o = t("orders").join(last, F.col("l_orderkey") == F.col("o_orderkey")).select(F.to_date("o_orderdate").alias("a"), F.greatest(F.to_date("o_orderdate"), "shipped").alias("b"), F.round(F.col("o_totalprice") * 100).alias("v"))
    days = o.select(F.explode(F.array(F.struct(F.col("a").alias("day"), "v"), F.struct(F.col("b").alias("day"), (-F.col("v")).alias("v")))).alias("m")).select("m.*").groupBy("day").agg(F.sum("v").alias("v"))
    return days.select(F.col("day").cast("string").alias("day"), F.sum("v").over(Window.orderBy("day")).cast("long").alias("in_transit_cents"))  # a row for each day of the calendar


@query("D11_expense", """WITH m AS (SELECT s_nationkey, strftime(l_shipdate, '%Y-%m') AS month, sum(round(l_extendedprice * (1 - l_discount) * 100)) AS v FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY ALL)
  SELECT s_nationkey, month, CAST(v AS BIGINT) AS spend_cents, round(avg(v) OVER (PARTITION BY s_nationkey ORDER BY month ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), 2) AS budget_cents FROM m""")
def _(t):
    j = t("lineitem").join(t("supplier").select("s_suppkey", "s_nationkey"), F.col("s_suppkey") == F.col("l_suppkey"))
    m = j.groupBy("s_nationkey", F.date_format("l_shipdate", "yyyy-MM").alias("month")).agg(F.sum(F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")) * 100)).alias("v"))
    w = Window.partitionBy("s_nationkey").orderBy("month").rowsBetween(-3, -1)
    return m.select("s_nationkey", "month", F.col("v").cast("long").alias("spend_cents"), F.round(F.avg("v").over(w), 2).alias("budget_cents"))


@query("D12_performance", """WITH y AS (SELECT n_regionkey, n_nationkey, strftime(o_orderdate, '%Y') AS year, sum(o_totalprice) AS v FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY ALL)
  SELECT n_nationkey, year, round(100 * v / avg(v) OVER (PARTITION BY n_regionkey, year), 4) AS of_region, rank() OVER (PARTITION BY n_regionkey, year ORDER BY v DESC) AS place FROM y""")
def _(t):
    j = t("orders").join(t("customer"), F.col("c_custkey") == F.col("o_custkey")).join(t("nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    y = j.groupBy("n_regionkey", "n_nationkey", F.date_format("o_orderdate", "yyyy").alias("year")).agg(F.sum("o_totalprice").alias("v"))
    w = Window.partitionBy("n_regionkey", "year")
    return y.select("n_nationkey", "year", F.round(100 * F.col("v") / F.avg("v").over(w), 4).alias("of_region"), F.rank().over(w.orderBy(F.desc("v"))).cast("long").alias("place"))


@query("D13_presales", """SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(DISTINCT user_id) FILTER (WHERE event_type = 'view') AS viewers, count(DISTINCT user_id) FILTER (WHERE event_type = 'click') AS clickers, count(DISTINCT user_id) FILTER (WHERE event_type = 'purchase') AS buyers,
  round(count(*) FILTER (WHERE event_type = 'purchase') / nullif(count(*) FILTER (WHERE event_type = 'view'), 0), 6) AS conversion FROM events GROUP BY 1""")
def _(t):
    people = lambda kind: F.count_distinct(F.when(F.col("event_type") == kind, F.col("user_id")))
    n = lambda kind: F.count_if(F.col("event_type") == kind)
    return t("events").groupBy(F.to_date("ts").cast("string").alias("day")).agg(people("view").alias("viewers"), people("click").alias("clickers"), people("purchase").alias("buyers"), F.round(F.try_divide(n("purchase"), n("view")), 6).alias("conversion"))


@query("D14_equipment", """WITH e AS (SELECT user_id, event_type, date_trunc('second', ts) AS a, date_trunc('second', ts) + INTERVAL 5 HOUR AS b FROM events WHERE event_type = 'error'), d AS (SELECT e.*, CAST(a AS DATE) + CAST(i AS INTEGER) AS day FROM e, range(2) r(i) WHERE CAST(a AS DATE) + CAST(i AS INTEGER) <= CAST(b AS DATE)),
  down AS (SELECT user_id, day, sum(greatest(0, date_diff('second', greatest(a, CAST(day AS TIMESTAMP)), least(b, CAST(day AS TIMESTAMP) + INTERVAL 1 DAY)))) AS s FROM d GROUP BY ALL), run AS (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n_events, count(*) FILTER (WHERE event_type = 'error') AS n_alarms FROM events GROUP BY ALL)
  SELECT coalesce(run.user_id, down.user_id) AS user_id, CAST(coalesce(run.day, down.day) AS VARCHAR) AS day, coalesce(n_events, 0) AS n_events, coalesce(n_alarms, 0) AS n_alarms, CAST(least(86400, coalesce(s, 0)) AS BIGINT) AS down_seconds FROM run FULL JOIN down ON run.user_id = down.user_id AND run.day = down.day""")
def _(t):
    e = t("events").where("event_type = 'error'").select("user_id", F.date_trunc("second", "ts").cast("timestamp_ntz").alias("a"))
    e = timelines.per_day(e.withColumn("b", F.col("a") + F.expr("INTERVAL 5 HOUR")), "a", "b")
    down = e.groupBy("user_id", "day").agg(F.sum(timelines.overlap_seconds(F.col("a"), F.col("b"), F.col("day"))).alias("s"))
    run = t("events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n_events"), F.count_if(F.col("event_type") == "error").alias("n_alarms"))
    none = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return run.join(down, ["user_id", "day"], "full").select("user_id", F.col("day").cast("string").alias("day"), none("n_events"), none("n_alarms"), F.least(F.lit(86400), F.coalesce("s", F.lit(0))).cast("long").alias("down_seconds"))


@query("D15_safety", """WITH d AS (SELECT DISTINCT CAST(ts AS DATE) AS day FROM events), a AS (SELECT unnest(range(5)) AS area), f AS (SELECT CAST(ts AS DATE) AS day, user_id % 5 AS area, count(*) FILTER (WHERE event_type = 'error') AS incidents, count(*) FILTER (WHERE event_type = 'signup') AS trainings FROM events GROUP BY ALL)
  SELECT CAST(d.day AS VARCHAR) AS day, a.area, coalesce(incidents, 0) AS incidents, coalesce(trainings, 0) AS trainings FROM d, a LEFT JOIN f ON f.day = d.day AND f.area = a.area""")
def _(t):
    e = t("events").select(F.to_date("ts").alias("day"), (F.col("user_id") % 5).alias("area"), "event_type")
    spine = e.select("day").distinct().select("day", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long"))).alias("area"))  # every area on every day
    f = e.groupBy("day", "area").agg(F.count_if(F.col("event_type") == "error").alias("incidents"), F.count_if(F.col("event_type") == "signup").alias("trainings"))
    return spine.join(f, ["day", "area"], "left").fillna(0, ["incidents", "trainings"]).select(F.col("day").cast("string").alias("day"), "area", "incidents", "trainings")


@query("D16_finance_monthly", """WITH m AS (SELECT c_mktsegment, strftime(o_orderdate, '%Y-%m') AS month, sum(l_extendedprice) AS gross, sum(l_extendedprice * l_discount) AS discount, sum(l_extendedprice * (1 - l_discount) * l_tax) AS tax FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey GROUP BY ALL)
  SELECT c_mktsegment, month, round(gross, 2) AS gross, round(discount, 2) AS discount, round(tax, 2) AS tax, round(100 * (gross - lag(gross) OVER w) / lag(gross) OVER w, 4) AS growth FROM m WINDOW w AS (PARTITION BY c_mktsegment ORDER BY month)""")
def _(t):
    j = t("lineitem").join(t("orders"), F.col("o_orderkey") == F.col("l_orderkey")).join(t("customer"), F.col("c_custkey") == F.col("o_custkey"))
    price = F.col("l_extendedprice")
    m = j.groupBy("c_mktsegment", F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.sum(price).alias("gross"), F.sum(price * F.col("l_discount")).alias("discount"), F.sum(price * (1 - F.col("l_discount")) * F.col("l_tax")).alias("tax"))
    before = F.lag("gross").over(Window.partitionBy("c_mktsegment").orderBy("month"))
    return m.select("c_mktsegment", "month", *(F.round(c, 2).alias(c) for c in ("gross", "discount", "tax")), F.round(100 * F.try_divide(F.col("gross") - before, before), 4).alias("growth"))


@query("D17_monthly_aggregate", """WITH d AS (SELECT CAST(o_orderdate AS DATE) AS day, sum(round(o_totalprice * 100)) AS v, count(*) AS n FROM orders GROUP BY 1), r AS (SELECT day, v, n, sum(v) OVER (ORDER BY day) AS upto FROM d), c AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY 1)
  SELECT c.month, CAST(sum(v) AS BIGINT) AS cents, CAST(sum(n) AS BIGINT) AS n_orders, CAST(arg_max(upto, day) AS BIGINT) AS month_end_cents, any_value(customers) AS customers FROM r JOIN c ON c.month = strftime(day, '%Y-%m') GROUP BY c.month""")
def _(t):
    d = t("orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.sum(F.round(F.col("o_totalprice") * 100)).alias("v"), F.count(F.lit(1)).alias("n"))
    month = F.date_format("day", "yyyy-MM").alias("month")
    r = d.withColumn("upto", F.sum("v").over(Window.orderBy("day"))).groupBy(month).agg(F.sum("v").cast("long").alias("cents"), F.sum("n").alias("n_orders"), F.max_by("upto", "day").cast("long").alias("month_end_cents"))
    return r.join(t("orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.count_distinct("o_custkey").alias("customers")), "month")  # distinct counts from the detail, not from days


@query("D18_production_oee", """WITH m AS (SELECT p_brand, strftime(l_shipdate, '%Y-%m') AS month, count(DISTINCT CAST(l_shipdate AS DATE)) AS days_run, any_value(day(last_day(l_shipdate))) AS days, sum(l_quantity) AS made, sum(CASE WHEN l_returnflag = 'R' THEN 0 ELSE l_quantity END) AS good, sum(round(l_extendedprice * 100)) AS energy FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL)
  SELECT p_brand, month, round(100 * (days_run / days) * (made / max(made) OVER (PARTITION BY p_brand)) * (good / made), 4) AS oee, round(energy / made, 4) AS unit_energy FROM m""")
def _(t):
    j = t("lineitem").join(t("part").select("p_partkey", "p_brand"), F.col("p_partkey") == F.col("l_partkey"))
    m = j.groupBy("p_brand", F.date_format("l_shipdate", "yyyy-MM").alias("month")).agg(
        F.count_distinct(F.to_date("l_shipdate")).alias("days_run"), F.max(F.dayofmonth(F.last_day("l_shipdate"))).alias("days"), F.sum("l_quantity").alias("made"), F.sum(F.when(F.col("l_returnflag") == "R", 0.0).otherwise(F.col("l_quantity"))).alias("good"), F.sum(F.round(F.col("l_extendedprice") * 100)).alias("energy"),
    )
    pace = F.col("made") / F.max("made").over(Window.partitionBy("p_brand"))
    return m.select("p_brand", "month", F.round(100 * (F.col("days_run") / F.col("days")) * pace * (F.col("good") / F.col("made")), 4).alias("oee"), F.round(F.col("energy") / F.col("made"), 4).alias("unit_energy"))


# -- evidence channels --------------------------------------------------------------------------------------

_BOTH = "SELECT '{0}>{2}' AS relation, round(100.0 * b / c, 4) AS forward, round(100.0 * b / p, 4) AS backward FROM (SELECT (SELECT count(DISTINCT {1}) FROM {0}) AS c, (SELECT count(DISTINCT {3}) FROM {2}) AS p, (SELECT count(*) FROM (SELECT {1} FROM {0} INTERSECT SELECT {3} FROM {2})) AS b)"
_PAIRS = (("orders", "o_custkey", "customer", "c_custkey"), ("lineitem", "l_orderkey", "orders", "o_orderkey"), ("customer", "c_nationkey", "nation", "n_nationkey"))


@query("E9_bidirectional", " UNION ALL ".join(_BOTH.format(*p) for p in _PAIRS))
def _(t):
    return channels.together([channels.bidirectional(t(c), ck, t(p), pk).select(F.lit(f"{c}>{p}").alias("relation"), "forward", "backward") for c, ck, p, pk in _PAIRS])


_PARENTS = (("customer", "c_custkey"), ("part", "p_partkey"), ("supplier", "s_suppkey"), ("orders", "o_orderkey"))


@query("E9_id_collision", "WITH e AS (" + " UNION ALL ".join(f"SELECT '{p}' AS parent, round(100.0 * (SELECT count(*) FROM (SELECT o_custkey FROM orders INTERSECT SELECT {k} FROM {p})) / (SELECT count(DISTINCT o_custkey) FROM orders), 4) AS overlap" for p, k in _PARENTS) + ") SELECT parent, overlap, overlap >= 95 AND (SELECT count(*) FROM e WHERE overlap >= 95) > 1 AS collides FROM e")
def _(t):
    return channels.id_collision({n: t(n) for n in ("orders", "customer", "part", "supplier")}, "orders", "o_custkey", _PARENTS)


_DELETED = "SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(count(*) FILTER (WHERE c_acctbal < -500) AS BIGINT) AS n_deleted FROM orders JOIN customer ON c_custkey = o_custkey"
_EARLY = "SELECT count(*) AS n_rows, count(*) FILTER (WHERE date_diff('day', CAST(l_shipdate AS DATE), CAST(o_orderdate AS DATE)) > 1) AS n_early FROM lineitem JOIN orders ON o_orderkey = l_orderkey"


@query("E9_soft_delete", f"SELECT *, n_deleted > 0.05 * n_rows AS conflict FROM ({_DELETED})")
def _(t):
    return channels.refers_to_deleted(t("orders"), "o_custkey", t("customer"), "c_custkey", F.col("c_acctbal") < -500)


@query("E9_temporal", f"SELECT *, n_early > 0.05 * n_rows AS conflict FROM ({_EARLY})")
def _(t):
    return channels.temporal(t("lineitem"), "l_orderkey", "l_shipdate", t("orders"), "o_orderkey", "o_orderdate")


@query("E9_verdicts", f"""WITH s(relation, says, strong) AS (SELECT 'orders>customer', CASE WHEN n_deleted > 0.05 * n_rows THEN 'against' ELSE 'for' END, true FROM ({_DELETED}) UNION ALL SELECT 'lineitem>orders', CASE WHEN n_early > 0.05 * n_rows THEN 'against' ELSE 'for' END, true FROM ({_EARLY})
    UNION ALL SELECT relation, CASE WHEN forward < 60 THEN 'against' ELSE 'for' END, false FROM ({" UNION ALL ".join(_BOTH.format(*p) for p in _PAIRS)}) UNION ALL SELECT 'orders>customer', 'for', false),
  n AS (SELECT relation, count(*) FILTER (WHERE says = 'for') AS support, count(*) FILTER (WHERE says = 'against' AND strong) AS strong, count(*) FILTER (WHERE says = 'against' AND NOT strong) AS weak FROM s GROUP BY 1)
  SELECT *, CASE WHEN strong > 0 AND strong >= support THEN 'refuted' WHEN strong + weak > 0 THEN 'review' WHEN support >= 2 THEN 'corroborated' ELSE 'single_channel' END AS verdict FROM n""")
def _(t):
    said = [
        channels.channel("orders>customer", "soft_delete", channels.refers_to_deleted(t("orders"), "o_custkey", t("customer"), "c_custkey", F.col("c_acctbal") < -500), F.col("conflict")),
        channels.channel("lineitem>orders", "temporal", channels.temporal(t("lineitem"), "l_orderkey", "l_shipdate", t("orders"), "o_orderkey", "o_orderdate"), F.col("conflict")),
        *(channels.channel(f"{c}>{p}", "bidirectional", channels.bidirectional(t(c), ck, t(p), pk), F.col("forward") < 60, strong=False) for c, ck, p, pk in _PAIRS),
    ]
    declared = t("region").limit(1).select(F.lit("orders>customer").alias("relation"), F.lit("declared").alias("channel"), F.lit("for").alias("says"), F.lit(False).alias("strong"))
    return channels.verdicts(channels.together([*said, declared]))


# -- cleaning -----------------------------------------------------------------------------------------------


@query("E12_encoding_conflict", "WITH p AS (SELECT DISTINCT p_brand AS c, p_type AS m FROM part) SELECT 'code_with_names' AS kind, c AS value, count(*) AS n FROM p GROUP BY c HAVING count(*) > 1 UNION ALL SELECT 'name_with_codes', m, count(*) FROM p GROUP BY m HAVING count(*) > 1")
def _(t):
    return cleaning.encoding_conflicts(t("part"), "p_brand", "p_type")


@query("E12_dangling", """WITH l AS (SELECT CASE WHEN o_custkey IS NULL THEN NULL ELSE o_orderpriority END AS why FROM (SELECT CASE WHEN o_orderpriority = '5-LOW' AND o_orderkey % 3 = 0 OR o_orderkey % 97 = 0 THEN -o_custkey - 1 ELSE o_custkey END AS o_custkey, o_orderpriority FROM orders) WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)), g AS (SELECT why, count(*) AS n FROM l GROUP BY 1)
  SELECT CAST(coalesce(sum(n), 0) AS BIGINT) AS n_dangling, arg_max(why, (n, why)) AS explanation, coalesce(max(n), 0) AS n_explained, sum(n) > 0 AND max(n) >= 0.8 * sum(n) AS coherent FROM g""")
def _(t):
    key, low = F.col("o_custkey"), F.col("o_orderpriority") == "5-LOW"
    o = t("orders").withColumn("o_custkey", F.when((low & (F.col("o_orderkey") % 3 == 0)) | (F.col("o_orderkey") % 97 == 0), -key - 1).otherwise(key))  # planted: most lost keys are of one priority
    return cleaning.dangling(o, "o_custkey", t("customer"), "c_custkey", F.col("o_orderpriority"))


@query("E12_empty_shell", """WITH o AS (SELECT o_orderstatus AS a, NULL::VARCHAR AS b, 'x' AS c, CASE WHEN o_orderkey < 0 THEN 'y' ELSE ' ' END AS d, 0 AS e FROM orders)
  SELECT c AS column_name, n AS n_filled, n = 0 AS blank, coalesce(lo = hi, false) AS constant FROM (""" + " UNION ALL ".join(f"SELECT '{c}' AS c, count(*) FILTER (WHERE trim({c}::VARCHAR) NOT IN ('', '0', '0.0')) AS n, min(trim({c}::VARCHAR)) FILTER (WHERE trim({c}::VARCHAR) NOT IN ('', '0', '0.0')) AS lo, max(trim({c}::VARCHAR)) FILTER (WHERE trim({c}::VARCHAR) NOT IN ('', '0', '0.0')) AS hi FROM o" for c in "abcde") + ") WHERE n = 0 OR lo = hi")
def _(t):
    o = t("orders").select(F.col("o_orderstatus").alias("a"), F.lit(None).cast("string").alias("b"), F.lit("x").alias("c"), F.when(F.col("o_orderkey") < 0, "y").otherwise(" ").alias("d"), F.lit(0).alias("e"))
    return cleaning.empty_shells(o, list("abcde"))


@query("E12_comment_mismatch", "SELECT value, coalesce(n, 0) AS n, listed IS NOT NULL AS listed FROM (SELECT o_orderstatus AS value, count(*) AS n FROM orders GROUP BY 1) d FULL JOIN (SELECT unnest(['F', 'O', 'X']) AS value, true AS listed) c USING (value) WHERE n IS NULL OR listed IS NULL")
def _(t):
    return cleaning.comment_mismatch(t("orders"), "o_orderstatus", mining.code_meanings("status: F=finished; O=open; X=cancelled"))


@query("E12_kinds", "SELECT 'encoding_conflict' AS kind, (SELECT count(*) FROM (SELECT p_brand FROM part GROUP BY 1 HAVING count(DISTINCT p_type) > 1)) + (SELECT count(*) FROM (SELECT p_type FROM part GROUP BY 1 HAVING count(DISTINCT p_brand) > 1)) AS n_findings UNION ALL SELECT 'empty_shell', count(*) FROM (SELECT 1 FROM orders HAVING min(o_orderstatus) = max(o_orderstatus))")
def _(t):
    return cleaning.all_kinds([("encoding_conflict", cleaning.encoding_conflicts(t("part"), "p_brand", "p_type")), ("empty_shell", cleaning.empty_shells(t("orders"), ["o_orderstatus"]))])


# -- signals, candidates, profiles and preparation ----------------------------------------------------------


@query("A6_signals", """WITH c AS (SELECT CAST(o_custkey AS VARCHAR) AS k FROM orders WHERE o_custkey IS NOT NULL), p AS (SELECT CAST(c_custkey AS VARCHAR) AS k FROM customer WHERE c_custkey IS NOT NULL),
  n AS (SELECT (SELECT count(DISTINCT k) FROM c) AS cd, (SELECT count(DISTINCT k) FROM p) AS pd, (SELECT count(*) FROM (SELECT k FROM c INTERSECT SELECT k FROM p)) AS md, (SELECT count(*) FROM orders) AS cr, (SELECT count(*) FROM customer) AS pr)
  SELECT round(CASE WHEN cd > 0 THEN 100.0 * md / cd ELSE -1 END, 6) AS overlap, cd AS child_distinct, pd AS parent_distinct, md AS matched_distinct, cr AS child_rows, pr AS parent_rows, cd = cr AS child_unique, pd = pr AS parent_unique, true AS evidence_complete, 'exact' AS evidence_method FROM n""")
def _(t):
    found = keys.relation_signals(t("orders"), "o_custkey", t("customer"), "c_custkey")
    return found.withColumn("overlap", F.round("overlap", 6))


_NOTES = {"notes": ["owner_type", "owner_id", "buyer", "kind"], "orders": ["o_custkey"]}


@query("E7_by_comment", "WITH c(t, c, said) AS (VALUES ('notes', 'buyer', 'who bought, see customers'), ('notes', 'kind', 'free text')), p(parent, parent_key) AS (VALUES ('customer', 'c_custkey'), ('part', 'p_partkey')) SELECT t AS child, c AS child_key, parent, parent_key FROM c, p WHERE regexp_matches(said, '\\b' || parent || 's?\\b')")
def _(t):
    found, _left = names.candidates(_NOTES, {"customer": ["c_custkey"], "part": ["p_partkey"]}, {("notes", "buyer"): "who bought, see customers", ("notes", "kind"): "free text"})
    return t("region").sparkSession.createDataFrame(found, "child string, child_key string, parent string, parent_key string")


@query("E7_polymorphic", "WITH c(t, c) AS (VALUES ('notes', 'owner_type'), ('notes', 'owner_id'), ('notes', 'buyer'), ('notes', 'kind'), ('orders', 'o_custkey')) SELECT a.t AS table_name, a.c AS key_column, b.c AS discriminator FROM c a JOIN c b ON a.t = b.t AND regexp_matches(a.c, '_(id|no|code)$') AND b.c IN (regexp_replace(a.c, '_(id|no|code)$', '_type'), regexp_replace(a.c, '_(id|no|code)$', '_kind'))")
def _(t):
    return t("region").sparkSession.createDataFrame(names.polymorphic(_NOTES), "table_name string, key_column string, discriminator string")


@query("E17_data_profile", """SELECT 'customer' AS table_name, count(*) AS n_rows, count(DISTINCT c_custkey) = count(*) AS keyed, round(avg(CASE WHEN c_acctbal < 0 THEN 1.0 ELSE 0.0 END), 4) AS marked_share, CAST(NULL AS VARCHAR) AS first_day, CAST(NULL AS VARCHAR) AS last_day FROM customer
  UNION ALL SELECT 'orders', count(*), count(DISTINCT o_orderkey) = count(*), round(avg(CASE WHEN o_orderstatus = 'P' THEN 1.0 ELSE 0.0 END), 4), CAST(CAST(min(o_orderdate) AS DATE) AS VARCHAR), CAST(CAST(max(o_orderdate) AS DATE) AS VARCHAR) FROM orders""")
def _(t):
    return src.data_profile(t("customer"), "customer", "c_custkey", F.col("c_acctbal") < 0).unionByName(src.data_profile(t("orders"), "orders", "o_orderkey", F.col("o_orderstatus") == "P", "o_orderdate"))


_PREPARED = (("SELECT count(*) FROM prepared_nation", "prepared_nation", None), ("SELECT n_gone FROM prepared_nation", "prepared_nation", "n_gone"), ("SELECT 1 FROM prepared_ghosts", "prepared_ghosts", None), ("SELECT n_name FROM prepared_nation WHERE n_regionkey = 1", "prepared_nation", "n_name"))


@query("Q8_prepare", "WITH s(statement, t, c) AS (VALUES " + ", ".join(f"({i}, '{tab}', {'NULL' if c is None else repr(c)})" for i, (_, tab, c) in enumerate(_PREPARED)) + "), k AS (SELECT 'prepared_nation' AS t, column_name AS c FROM (DESCRIBE nation)) SELECT CAST(statement AS INTEGER) AS statement, CASE WHEN t NOT IN (SELECT t FROM k) THEN 'missing_table' WHEN c IS NOT NULL AND c NOT IN (SELECT c FROM k) THEN 'missing_column' ELSE 'ok' END AS status, CASE WHEN t NOT IN (SELECT t FROM k) THEN t WHEN c IS NOT NULL AND c NOT IN (SELECT c FROM k) THEN c END AS name FROM s")
def _(t):
    spark = t("nation").sparkSession
    t("nation").createOrReplaceTempView("prepared_nation")
    found = [gates.prepared(spark, sql) for sql, *_ in _PREPARED]
    return spark.createDataFrame([(i, f["status"], f["name"]) for i, f in enumerate(found)], "statement int, status string, name string")


# -- the ontology as triples --------------------------------------------------------------------------------

_E = "(VALUES " + ", ".join(f"({i}, '{r.child}', '{r.parent}', '{r.child_key}', '{r.parent_key}', '{r.status}')" for i, r in enumerate(RELATIONS)) + ") e(i, source, target, child_key, parent_key, status)"
_O = "(VALUES " + ", ".join(f"('{n}', '{c}')" for n, cs in _ALIASED.items() for c in cs.values()) + ") o(object, attribute)"
_TRIPLES = f"""SELECT DISTINCT 'urn:model:object/' || object AS s, 'type' AS p, 'Object' AS o FROM {_O} UNION ALL SELECT DISTINCT 'urn:model:object/' || object, 'label', object FROM {_O} UNION ALL SELECT 'urn:model:object/' || object, 'attribute', attribute FROM {_O}
  UNION ALL SELECT 'urn:model:relation/' || i, unnest(['type', 'from', 'to', 'child_key', 'parent_key', 'status']), unnest(['Relation', 'urn:model:object/' || source, 'urn:model:object/' || target, child_key, parent_key, status]) FROM {_E}"""


@query("K8_triples", _TRIPLES)
def _(t):
    return ir.triples(ir.project(t("region").sparkSession, ontology()))


@query("K8_n_triples", f"SELECT '<' || s || '> <urn:model:' || p || '> ' || CASE WHEN starts_with(o, 'urn:model:') THEN '<' || o || '>' ELSE '\"' || o || '\"' END || ' .' AS line FROM ({_TRIPLES})")
def _(t):
    return ir.n_triples(ir.triples(ir.project(t("region").sparkSession, ontology())))


@query("G10_relation_view", f"SELECT 'urn:model:relation/' || i AS relation, 'urn:model:object/' || source AS source, 'urn:model:object/' || target AS target, status FROM {_E}")
def _(t):
    return ir.relation_view(ir.triples(ir.project(t("region").sparkSession, ontology())))
