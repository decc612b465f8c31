"""Metrics and their algebra, windows, summary layers, reconciliation, text retrieval, digests."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from plumbline.operators import metrics, results, text, timelines
from plumbline.registry import query

# -- metrics ------------------------------------------------------------------------------------------------

REVENUE = metrics.Contract("revenue", "orders", "sum", "o_totalprice", (metrics.Filter("o_orderstatus", "=", "F"),), "o_orderdate", ("day", "month", "quarter", "year"), ("o_orderpriority",))
_MONTH = "substr(CAST(o_orderdate AS VARCHAR), 1, 7)"


def _rounded(df, name: str, digits: int = 2):
    return df.withColumn(name, F.round(name, digits))


@query("A1_metric_month", f"SELECT {_MONTH} AS \"期间\", o_orderpriority, round(sum(o_totalprice), 2) AS revenue FROM orders WHERE o_orderstatus = 'F' GROUP BY 1, 2")
def _(t):
    return _rounded(metrics.compiled(t("orders"), REVENUE, "month"), "revenue")


for _grain, _sql in {"day": "substr(CAST(o_orderdate AS VARCHAR), 1, 10)", "quarter": "year(o_orderdate) || '-Q' || quarter(o_orderdate)", "year": "CAST(year(o_orderdate) AS VARCHAR)"}.items():
    query(f"A2_metric_{_grain}", f"SELECT {_sql} AS \"期间\", round(sum(o_totalprice), 2) AS revenue FROM orders WHERE o_orderstatus = 'F' GROUP BY 1")(lambda t, g=_grain: _rounded(metrics.compiled(t("orders"), REVENUE, g, []), "revenue"))

for _agg, _sql in {"sum": "sum(l_quantity)", "count": "count(l_quantity)", "count_distinct": "count(DISTINCT l_quantity)", "avg": "avg(l_quantity)", "min": "min(l_quantity)", "max": "max(l_quantity)"}.items():
    query(f"A1_{_agg}", f"SELECT l_returnflag, l_linestatus, round({_sql}, 4) AS m FROM lineitem GROUP BY 1, 2")(
        lambda t, a=_agg: _rounded(metrics.compiled(t("lineitem"), metrics.Contract("m", "lineitem", a, "l_quantity", dimensions=("l_returnflag", "l_linestatus"))), "m", 4)
    )


@query("A1_scalar", "SELECT count(*) AS n FROM customer WHERE c_acctbal < 0 AND c_mktsegment IN ('BUILDING', 'MACHINERY')")
def _(t):
    c = metrics.Contract("n", "customer", "count", None, (metrics.Filter("c_acctbal", "<", 0), metrics.Filter("c_mktsegment", "in", ("BUILDING", "MACHINERY"))))
    return metrics.compiled(t("customer"), c)


@query("A3_conditional_aggregate", "SELECT o_orderstatus, round(sum(CASE WHEN o_orderpriority = '1-URGENT' THEN o_totalprice END), 2) AS urgent, count(CASE WHEN o_totalprice > 100000 THEN 1 END) AS large FROM orders GROUP BY 1")
def _(t):
    return t("orders").groupBy("o_orderstatus").agg(F.round(metrics.measure("sum", "o_totalprice", F.col("o_orderpriority") == "1-URGENT"), 2).alias("urgent"), metrics.measure("count", None, F.col("o_totalprice") > 100000).alias("large"))


@query("A4_roll_up", "SELECT o_orderpriority, round(sum(o_totalprice), 2) AS s, count(o_totalprice) AS c, min(o_totalprice) AS lo, max(o_totalprice) AS hi, round(avg(o_totalprice), 4) AS a FROM orders GROUP BY 1")
def _(t):
    parts = metrics.cube(t("orders"), "o_orderdate", "day", ["o_orderpriority", "o_orderstatus"], "o_totalprice")
    return parts.groupBy("o_orderpriority").agg(F.round(F.sum("part_sum"), 2).alias("s"), F.sum("part_count").alias("c"), F.min("part_min").alias("lo"), F.max("part_max").alias("hi"), F.round(F.sum("part_sum") / F.sum("part_count"), 4).alias("a"))


@query("Q14_adjudicated")
def _(t):
    o = t("orders").select("o_totalprice", "o_orderstatus", "o_orderdate", "o_orderpriority")
    ref = lambda col: o.where("o_orderstatus = 'F'").agg(F.sum(col).alias("x"))
    from dataclasses import replace

    scalar = replace(REVENUE, dimensions=())
    done = [metrics.adjudicated(o, scalar, sql_reference=ref("o_totalprice")), metrics.adjudicated(o, replace(scalar, name="wrong"), value_reference=1.0)]
    return o.sparkSession.createDataFrame([(c.name, c.status) for c in done], "metric string, status string")


@query("A21_data_as_of", "SELECT CAST(max(CAST(o_orderdate AS DATE)) AS VARCHAR) AS as_of FROM orders")
def _(t):
    return t("orders").agg(F.max(F.to_date("o_orderdate")).cast("string").alias("as_of"))


@query("A33_layers", "SELECT substr(CAST(l_shipdate AS VARCHAR), 1, 4) AS y, round(sum(l_extendedprice), 2) AS detail, true AS agrees FROM lineitem GROUP BY 1")
def _(t):
    y = F.substring(F.col("l_shipdate").cast("string"), 1, 4).alias("y")
    layer = t("lineitem").groupBy(y, F.substring(F.col("l_shipdate").cast("string"), 1, 7).alias("m")).agg(F.sum("l_extendedprice").alias("v")).groupBy("y").agg(F.sum("v").alias("layer"))
    detail = t("lineitem").groupBy(y).agg(F.sum("l_extendedprice").alias("d"))
    return detail.join(layer, "y").select("y", F.round("d", 2).alias("detail"), (F.abs(F.col("d") - F.col("layer")) <= 0.05 * F.greatest(F.abs("d"), F.abs("layer"))).alias("agrees"))


@query("A32_reconciliation", """WITH l AS (SELECT l_orderkey, sum(l_extendedprice) AS total, count(*) AS n, count(DISTINCT l_linenumber) AS d, min(l_shipdate) AS first FROM lineitem GROUP BY 1)
  SELECT count(*) FILTER (WHERE l_orderkey IS NULL) AS without_lines, count(*) FILTER (WHERE abs(o_totalprice - total) > 0.01 * o_totalprice) AS amount_differs, count(*) FILTER (WHERE first < o_orderdate) AS dates_reversed, count(*) FILTER (WHERE n <> d) AS lines_repeat FROM orders LEFT JOIN l ON l_orderkey = o_orderkey""")
def _(t):
    lines = t("lineitem").groupBy("l_orderkey").agg(F.sum("l_extendedprice").alias("total"), F.count(F.lit(1)).alias("n"), F.count_distinct("l_linenumber").alias("d"), F.min("l_shipdate").alias("first"))
    j = t("orders").join(lines, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    return j.agg(F.count_if(F.col("l_orderkey").isNull()).alias("without_lines"), F.count_if(F.abs(F.col("o_totalprice") - F.col("total")) > 0.01 * F.col("o_totalprice")).alias("amount_differs"), F.count_if(F.col("first") < F.col("o_orderdate")).alias("dates_reversed"), F.count_if(F.col("n") != F.col("d")).alias("lines_repeat"))


@query("A34_violations", "SELECT 'negative_price' AS check_name, count(*) AS violations FROM lineitem WHERE l_extendedprice < 0 UNION ALL SELECT 'discount_range', count(*) FROM lineitem WHERE l_discount NOT BETWEEN 0 AND 0.1 UNION ALL SELECT 'ships_early', count(*) FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate < o_orderdate")
def _(t):
    li = t("lineitem").join(t("orders").select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"), "left")
    checks = {"negative_price": F.col("l_extendedprice") < 0, "discount_range": ~F.col("l_discount").between(0, 0.1), "ships_early": F.col("l_shipdate") < F.col("o_orderdate")}
    one = li.agg(*(F.count_if(c).alias(n) for n, c in checks.items()))
    return one.select(F.explode(F.array(*(F.struct(F.lit(n).alias("check_name"), F.col(n).alias("violations")) for n in checks))).alias("x")).select("x.*")


@query("A29_W11_derived_numbers", "SELECT m AS month, round(v, 2) AS value, round(v - lag(v) OVER w, 4) AS step, round(100 * (v - lag(v) OVER w) / lag(v) OVER w, 4) AS growth_percent, round(100 * v / sum(v) OVER (), 4) AS share_percent, round(sum(v) OVER (), 4) AS total, round(max(v) OVER (), 2) AS largest, round(min(v) OVER (), 2) AS smallest, round(avg(v) OVER (), 4) AS mean, round(last_value(v) OVER (ORDER BY m ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) - first_value(v) OVER (ORDER BY m ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), 4) AS first_to_last FROM (SELECT strftime(o_orderdate, '%Y-%m') AS m, round(sum(o_totalprice), 2) AS v FROM orders GROUP BY 1) WINDOW w AS (ORDER BY m)")
def _(t):
    by = t("orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.round(F.sum("o_totalprice"), 2).alias("v"))
    return results.derived_numbers(by, "month", "v")


@query("A26_arm_summary", "SELECT event_type AS arm, count(*) AS n, round(avg(acc), 6) AS accuracy FROM (SELECT event_type, user_id, avg(CASE WHEN value > 50 THEN 1.0 ELSE 0.0 END) AS acc FROM events GROUP BY ALL) GROUP BY 1")
def _(t):
    per = t("events").groupBy("event_type", "user_id").agg(F.avg(F.when(F.col("value") > 50, 1.0).otherwise(0.0)).alias("acc"))
    return per.groupBy(F.col("event_type").alias("arm")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("acc"), 6).alias("accuracy"))


@query("A30_status_counts", "SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1")
def _(t):
    return t("orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query("A31_percentiles", "SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, max(value) AS top FROM events GROUP BY 1")
def _(t):
    p = lambda q: F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY value)")
    return t("events").groupBy("event_type").agg(p(0.5).alias("p50"), p(0.95).alias("p95"), F.max("value").alias("top"))


@query("A38_group_concat", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS nations FROM nation GROUP BY 1")
def _(t):
    return t("nation").groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_list("n_name")), ",").alias("nations"))


@query("A39_rollup", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def _(t):
    return t("lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"))


@query("A39_cube", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def _(t):
    return t("orders").cube("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


# -- windows ------------------------------------------------------------------------------------------------


@query("W1_lag_continuity", "SELECT user_id, count(*) AS breaks FROM (SELECT user_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) WHERE before IS NOT NULL AND value < before GROUP BY 1")
def _(t):
    before = F.lag("value").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return t("events").withColumn("before", before).where("before is not null and value < before").groupBy("user_id").agg(F.count(F.lit(1)).alias("breaks"))


@query("W2_lag_previous", "SELECT event_id, lag(event_id) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS previous FROM events")
def _(t):
    return t("events").select("event_id", F.lag("event_id").over(Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")).alias("previous"))


@query("W3_total_of_totals", "SELECT d, round(sum(v) OVER (ORDER BY d), 2) AS running FROM (SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS d, sum(value) AS v FROM events GROUP BY 1)")
def _(t):
    by = t("events").groupBy(F.to_date("ts").cast("string").alias("d")).agg(F.sum("value").alias("v"))
    return by.select("d", F.round(F.sum("v").over(Window.orderBy("d")), 2).alias("running"))


@query("W4_filter_and_window", "SELECT l_returnflag, count(*) FILTER (WHERE l_quantity > 25) AS big, round(sum(sum(l_tax)) OVER (ORDER BY l_returnflag), 4) AS running FROM lineitem GROUP BY 1")
def _(t):
    return t("lineitem").sparkSession.sql("SELECT l_returnflag, count(*) FILTER (WHERE l_quantity > 25) AS big, round(sum(sum(l_tax)) OVER (ORDER BY l_returnflag), 4) AS running FROM {l} GROUP BY l_returnflag", l=t("lineitem"))


@query("W5_month_to_date", "SELECT event_id, round(sum(value) OVER (PARTITION BY user_id, strftime(ts, '%Y-%m') ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 4) AS running FROM events")
def _(t):
    e = t("events").withColumn("month", F.date_format("ts", "yyyy-MM"))
    return timelines.running_sum(e, ["user_id", "month"], ["ts", "event_id"], "value", "running").select("event_id", F.round("running", 4).alias("running"))


@query("W6_trailing_year", "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY CAST(o_orderdate AS DATE) RANGE BETWEEN INTERVAL 364 DAY PRECEDING AND CURRENT ROW), 2) AS trailing FROM orders")
def _(t):
    return timelines.trailing_sum(t("orders"), "o_custkey", "o_orderdate", "o_totalprice", 365, "trailing").select("o_orderkey", F.round("trailing", 2).alias("trailing"))


@query("W7_recency", "SELECT c_custkey, CASE WHEN last IS NULL THEN 'never' WHEN date_diff('day', last, DATE '1998-08-02') <= 90 THEN 'new' WHEN date_diff('day', last, DATE '1998-08-02') <= 180 THEN 'dormant' ELSE 'lost' END AS state FROM customer LEFT JOIN (SELECT o_custkey, max(CAST(o_orderdate AS DATE)) AS last FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def _(t):
    last = t("orders").groupBy("o_custkey").agg(F.max(F.to_date("o_orderdate")).alias("last"))
    return t("customer").join(last, F.col("o_custkey") == F.col("c_custkey"), "left").select("c_custkey", timelines.recency(F.col("last"), F.lit("1998-08-02").cast("date")).alias("state"))


@query("W8_running_balance", """WITH o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, o_totalprice FROM orders), days AS (SELECT o_orderkey, d, o_totalprice, i, CAST(d + CAST(i AS INTEGER) AS VARCHAR) AS day FROM o, range(5) r(i))
  SELECT o_orderkey, day, round(o_totalprice - sum(CASE WHEN i > 0 THEN o_totalprice / 4 ELSE 0 END) OVER (PARTITION BY o_orderkey ORDER BY i ROWS UNBOUNDED PRECEDING), 0) AS balance FROM days""")
def _(t):
    o = t("orders").select("o_orderkey", F.to_date("o_orderdate").alias("d"), "o_totalprice")
    days = o.select("*", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("i"))
    paid = F.sum(F.when(F.col("i") > 0, F.col("o_totalprice") / 4).otherwise(0.0)).over(Window.partitionBy("o_orderkey").orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
    return days.select("o_orderkey", F.date_add("d", F.col("i")).cast("string").alias("day"), F.round(F.col("o_totalprice") - paid, 0).alias("balance"))


@query("W9_open_per_day", "SELECT CAST(o_date + CAST(i AS INTEGER) AS VARCHAR) AS day, count(*) AS open_lines FROM (SELECT CAST(o_orderdate AS DATE) AS o_date, date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_shipdate >= o_orderdate AND l_shipdate < o_orderdate + INTERVAL 30 DAY), range(31) r(i) WHERE i <= n GROUP BY 1")
def _(t):
    j = t("orders").join(t("lineitem"), F.col("l_orderkey") == F.col("o_orderkey")).where("l_shipdate >= o_orderdate and l_shipdate < o_orderdate + INTERVAL 30 DAY")
    return timelines.per_day(j.select("o_orderdate", "l_shipdate"), "o_orderdate", "l_shipdate").groupBy(F.col("day").cast("string").alias("day")).agg(F.count(F.lit(1)).alias("open_lines"))


@query("W10_month_end", "SELECT user_id, strftime(ts, '%Y-%m') AS month, arg_max(value, (ts, event_id)) AS last_value FROM events GROUP BY ALL")
def _(t):
    return timelines.month_end(t("events"), "user_id", "ts", "value", "event_id")


@query("W13_mode_share", "SELECT p_brand, max(n) AS n_mode, round(max(n) / sum(n), 4) AS share FROM (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY ALL) GROUP BY 1")
def _(t):
    n = t("part").groupBy("p_brand", "p_type").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("p_brand").agg(F.max("n").alias("n_mode"), F.round(F.max("n") / F.sum("n"), 4).alias("share"))


@query("W14_fifo", """WITH s AS (SELECT l_partkey AS k, l_orderkey * 8 + l_linenumber AS no, l_quantity AS q FROM lineitem WHERE l_linestatus = 'F'), d AS (SELECT l_partkey AS k, l_orderkey * 8 + l_linenumber AS no, l_quantity AS q FROM lineitem WHERE l_linestatus = 'O'),
  si AS (SELECT k, no, sum(q) OVER (PARTITION BY k ORDER BY no ROWS UNBOUNDED PRECEDING) AS hi, q FROM (SELECT k, no, sum(q) AS q FROM s GROUP BY ALL)), di AS (SELECT k, no, sum(q) OVER (PARTITION BY k ORDER BY no ROWS UNBOUNDED PRECEDING) AS hi, q FROM (SELECT k, no, sum(q) AS q FROM d GROUP BY ALL))
  SELECT si.k AS l_partkey, si.no AS supply_no, di.no AS demand_no, least(si.hi, di.hi) - greatest(si.hi - si.q, di.hi - di.q) AS allocated FROM si JOIN di ON si.k = di.k AND si.hi - si.q < di.hi AND di.hi - di.q < si.hi""")
def _(t):
    li = t("lineitem").select("l_partkey", "l_linestatus", (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("no"), "l_quantity")
    side = lambda s: li.where(F.col("l_linestatus") == s).groupBy("l_partkey", "no").agg(F.sum("l_quantity").alias("q"))
    return timelines.fifo(side("F"), side("O"), "l_partkey", "no", "q")


@query("W15_ranking", "SELECT o_orderkey, rank() OVER w AS r, dense_rank() OVER w AS d, ntile(4) OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC, o_orderkey) AS q, first_value(o_orderkey) OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC, o_orderkey) AS top FROM orders WINDOW w AS (PARTITION BY o_orderstatus ORDER BY o_orderpriority)")
def _(t):
    w, x = Window.partitionBy("o_orderstatus").orderBy("o_orderpriority"), Window.partitionBy("o_orderstatus").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return t("orders").select("o_orderkey", F.rank().over(w).alias("r"), F.dense_rank().over(w).alias("d"), F.ntile(4).over(x).alias("q"), F.first("o_orderkey").over(x).alias("top"))


# -- summary layers -----------------------------------------------------------------------------------------


@query("D1_sales_daily", "SELECT CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day, c_nationkey, count(DISTINCT o_orderkey) AS n_orders, round(sum(o_totalprice), 2) AS amount FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ALL")
def _(t):
    j = t("orders").join(t("customer"), F.col("c_custkey") == F.col("o_custkey"))
    return j.groupBy(F.to_date("o_orderdate").cast("string").alias("day"), "c_nationkey").agg(F.count_distinct("o_orderkey").alias("n_orders"), F.round(F.sum("o_totalprice"), 2).alias("amount"))


@query("D2_targets_per_day", "SELECT m, i, CASE WHEN i < n THEN floor(total / n * 100) / 100 ELSE round(total - floor(total / n * 100) / 100 * (n - 1), 2) END AS target FROM (SELECT m, round(sum(v), 2) AS total, 30 AS n FROM (SELECT strftime(o_orderdate, '%Y-%m') AS m, o_totalprice AS v FROM orders) GROUP BY m), range(1, 31) r(i)")
def _(t):
    by = t("orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("m")).agg(F.round(F.sum("o_totalprice"), 2).alias("total"))
    return by.select("m", "total", F.explode(F.sequence(F.lit(1), F.lit(30))).alias("i")).select("m", F.col("i").cast("long").alias("i"), timelines.split_evenly(F.col("total"), F.lit(30), F.col("i")).cast("double").alias("target"))


@query("D3_market_share", "WITH y AS (SELECT c_nationkey, strftime(o_orderdate, '%Y') AS year, sum(o_totalprice) AS v FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ALL) SELECT year, c_nationkey, round(100 * v / sum(v) OVER (PARTITION BY year), 4) AS share FROM y")
def _(t):
    y = t("orders").join(t("customer"), F.col("c_custkey") == F.col("o_custkey")).groupBy(F.date_format("o_orderdate", "yyyy").alias("year"), "c_nationkey").agg(F.sum("o_totalprice").alias("v"))
    return y.select("year", "c_nationkey", F.round(100 * F.col("v") / F.sum("v").over(Window.partitionBy("year")), 4).alias("share"))


@query("D4_active_spine", "WITH d AS (SELECT DISTINCT CAST(ts AS DATE) AS day FROM events), m AS (SELECT user_id, min(CAST(ts AS DATE)) AS since, max(CAST(ts AS DATE)) AS until FROM events GROUP BY 1), f AS (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY ALL) SELECT m.user_id, CAST(d.day AS VARCHAR) AS day, coalesce(n, 0) AS n FROM m JOIN d ON d.day BETWEEN since AND until LEFT JOIN f ON f.user_id = m.user_id AND f.day = d.day")
def _(t):
    e = t("events").select("user_id", F.to_date("ts").alias("day"))
    members = e.groupBy("user_id").agg(F.min("day").alias("since"), F.max("day").alias("until"))
    return timelines.day_spine(e.select("day").distinct(), members, e.groupBy("user_id", "day").agg(F.count(F.lit(1)).alias("n")), ["user_id", "day"], "n").select("user_id", F.col("day").cast("string").alias("day"), "n")


@query("D5_overdue_risk", "SELECT c_custkey, round(sum(CASE WHEN o_orderstatus = 'O' AND o_orderdate < TIMESTAMP '1998-05-01' THEN o_totalprice ELSE 0 END), 2) AS overdue, c_acctbal < 0 AS negative FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_acctbal")
def _(t):
    late = F.when((F.col("o_orderstatus") == "O") & (F.col("o_orderdate") < F.lit("1998-05-01").cast("timestamp_ntz")), F.col("o_totalprice")).otherwise(0.0)
    o = t("orders").groupBy("o_custkey").agg(F.sum(late).alias("overdue"))
    return t("customer").join(o, F.col("o_custkey") == F.col("c_custkey"), "left").select("c_custkey", F.round(F.coalesce("overdue", F.lit(0.0)), 2).alias("overdue"), (F.col("c_acctbal") < 0).alias("negative"))


@query("D6_procurement", "SELECT s_suppkey, count(*) AS n_lines, round(sum(l_extendedprice * (1 - l_discount)), 2) AS spend, round(avg(l_quantity), 4) AS mean_quantity FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1")
def _(t):
    return t("lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count(F.lit(1)).alias("n_lines"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("spend"), F.round(F.avg("l_quantity"), 4).alias("mean_quantity")).join(t("supplier").select("s_suppkey"), "s_suppkey", "left_semi")


@query("D7_yield_monthly", "SELECT strftime(l_shipdate, '%Y-%m') AS month, round(sum(l_quantity), 2) AS made, round(sum(CASE WHEN l_returnflag = 'R' THEN 0 ELSE l_quantity END) / sum(l_quantity), 6) AS yield FROM lineitem GROUP BY 1")
def _(t):
    good = F.sum(F.when(F.col("l_returnflag") == "R", 0.0).otherwise(F.col("l_quantity")))
    return t("lineitem").groupBy(F.date_format("l_shipdate", "yyyy-MM").alias("month")).agg(F.round(F.sum("l_quantity"), 2).alias("made"), F.round(good / F.sum("l_quantity"), 6).alias("yield"))


@query("D8_downtime_by_day", "WITH e AS (SELECT event_id, date_trunc('second', ts) AS a, date_trunc('second', ts) + INTERVAL 10 HOUR AS b FROM events), d AS (SELECT e.*, CAST(a AS DATE) + CAST(i AS INTEGER) AS day FROM e, range(2) r(i)) SELECT CAST(day AS VARCHAR) AS day, CAST(sum(greatest(0, date_diff('second', greatest(a, CAST(day AS TIMESTAMP)), least(b, CAST(day AS TIMESTAMP) + INTERVAL 1 DAY)))) AS BIGINT) AS seconds FROM d WHERE day <= CAST(b AS DATE) GROUP BY 1")
def _(t):
    e = t("events").select(F.date_trunc("second", "ts").cast("timestamp_ntz").alias("a"))
    e = e.withColumn("b", F.col("a") + F.expr("INTERVAL 10 HOUR"))
    return timelines.per_day(e, "a", "b").groupBy(F.col("day").cast("string").alias("day")).agg(F.sum(timelines.overlap_seconds(F.col("a"), F.col("b"), F.col("day"))).alias("seconds"))


@query("T4_daily_events", "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def _(t):
    own = t("events").withColumn("ts", F.col("ts").cast("timestamp"))
    return own.groupBy(F.window("ts", "1 day"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.to_date("window.start").cast("string").alias("day"), "event_type", "n", "total")


@query("T3_latest_state", "SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY 1")
def _(t):
    return t("events").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("event_type"))


# -- text ---------------------------------------------------------------------------------------------------

_TERMS = ["thing", "other", "and", "the"]


@query("Q21_bm25", "WITH d AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9_]+') AS t FROM benchmark), s AS (SELECT count(*) AS n, avg(len(t)) AS a FROM d), f AS (SELECT item_id, len(t) AS l, q AS term, len(list_filter(t, lambda x: x = q)) AS tf FROM d, unnest(['thing', 'other', 'and', 'the']) u(q) WHERE list_contains(t, q)), df AS (SELECT term, count(*) AS df FROM f GROUP BY 1) SELECT item_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * l / a))), 6) AS score FROM f JOIN df USING (term), s GROUP BY 1 ORDER BY score DESC, item_id LIMIT 10")
def _(t):
    return text.bm25(t("benchmark"), "item_id", "text", _TERMS)


@query("Q21_chunks", "SELECT doc_id, i AS chunk, substr(text, CAST(i * 780 + 1 AS BIGINT), 900) AS text FROM (SELECT doc_id, text, greatest(0, (length(text) - 121) // 780) AS last FROM documents WHERE length(text) > 0) d, range(200) r(i) WHERE i <= last")
def _(t):
    return text.chunks(t("documents"), "doc_id", "text").withColumn("chunk", F.col("chunk").cast("long"))


@query("A37_bigram_jaccard", "WITH p AS (SELECT a.n_name AS a, b.n_name AS b, list_distinct(list_transform(range(1, length(a.n_name)), lambda i: substr(a.n_name, i, 2))) AS x, list_distinct(list_transform(range(1, length(b.n_name)), lambda i: substr(b.n_name, i, 2))) AS y FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey) SELECT a, b, round(coalesce(len(list_intersect(x, y)) / nullif(len(list_distinct(list_concat(x, y))), 0), 0), 6) AS similarity FROM p")
def _(t):
    a, b = t("nation").select("n_regionkey", F.col("n_name").alias("a")), t("nation").select("n_regionkey", F.col("n_name").alias("b"))
    return a.join(b, "n_regionkey").select("a", "b", text.bigram_jaccard(F.col("a"), F.col("b")).alias("similarity"))


@query("Q22_definition_quality", "SELECT item_id, length(text) BETWEEN 20 AND 400 AS sized, NOT regexp_matches(text, '(?i)todo|tbd') AS finished FROM benchmark")
def _(t):
    return t("benchmark").select("item_id", F.length("text").between(20, 400).alias("sized"), (~F.col("text").rlike("(?i)todo|tbd")).alias("finished"))


@query("A28_exact_copies", "SELECT sha1(text) AS digest, count(*) AS copies, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def _(t):
    return t("documents").groupBy(F.sha1("text").alias("digest")).agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_id")).where("copies > 1")


@query("A28_result_digest")
def _(t):
    return results.exact_digest(t("nation"))


@query("A23_A24_comparison")
def _(t):
    n = t("nation").select("n_nationkey", "n_name")
    rows = [(results.equal_frames(n, n.orderBy("n_name")), results.equal_frames(n, n.where("n_nationkey > 0")))]
    return n.sparkSession.createDataFrame(rows, "same boolean, other boolean")


@query("Q11_number_check")
def _(t):
    total = t("nation").count()
    issues = results.check_numbers(f"共 {total}.0 个,增长 12.5%", [float(total)])
    return t("nation").sparkSession.createDataFrame([(2 - len(issues), len(issues))], "known int, unknown int")
