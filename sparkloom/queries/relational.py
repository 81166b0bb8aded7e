"""Projection, predicates, joins, aggregation, windows, order and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.functions import aggregates as A
from sparkloom.functions import scalar as S
from sparkloom.operators import relational as R
from sparkloom.queries import query
from sparkloom.session import Tables

c = F.col


@query("scan_full", "SELECT * FROM nation")
def _(t: Tables) -> DataFrame:
    return t.nation


@query("scan_key_range", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey BETWEEN 100 AND 2000")
def _(t):
    return R.where(t.orders, c("o_orderkey").between(100, 2000)).select("o_orderkey", "o_custkey", "o_totalprice")


@query("scan_point_lookup", "SELECT * FROM customer WHERE c_custkey = 42")
def _(t):
    return R.where(t.customer, c("c_custkey") == 42)


@query("extract_offset_filter_limit", "SELECT n_name, n_regionkey FROM (SELECT * FROM nation ORDER BY n_nationkey OFFSET 5) WHERE n_regionkey < 3")
def _(t):
    return R.extract(t.nation.orderBy("n_nationkey"), ["n_name", "n_regionkey"], c("n_regionkey") < 3, limit=100, offset=5)


@query("project_aliases", "SELECT c_custkey AS id, c_name AS name, c_acctbal FROM customer")
def _(t):
    return R.project(t.customer, "c_custkey", "c_name", "c_acctbal", aliases={"c_custkey": "id", "c_name": "name"})


@query("filter_comparisons", "SELECT p_partkey FROM part WHERE p_size > 10 AND p_size <= 40 AND p_retailprice <> 1000 AND p_brand >= 'Brand#2' AND NOT p_size = 15")
def _(t):
    return R.where(t.part, (c("p_size") > 10) & (c("p_size") <= 40) & (c("p_retailprice") != 1000) & (c("p_brand") >= "Brand#2") & ~(c("p_size") == 15)).select("p_partkey")


@query("filter_and_or_not", "SELECT c_custkey FROM customer WHERE (c_mktsegment = 'BUILDING' OR c_acctbal < 0) AND NOT (c_nationkey = 3)")
def _(t):
    return R.where(t.customer, ((c("c_mktsegment") == "BUILDING") | (c("c_acctbal") < 0)) & ~(c("c_nationkey") == 3)).select("c_custkey")


@query("filter_between", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity BETWEEN 10 AND 12 AND l_shipdate BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1996-12-31'")
def _(t):
    return R.where(t.lineitem, c("l_quantity").between(10, 12) & c("l_shipdate").between(F.lit("1995-01-01").cast("timestamp"), F.lit("1996-12-31").cast("timestamp"))).select("l_orderkey", "l_linenumber")


@query("filter_in", "SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW') AND o_orderstatus IN ('F')")
def _(t):
    return R.where(t.orders, c("o_orderpriority").isin("1-URGENT", "5-LOW") & c("o_orderstatus").isin("F")).select("o_orderkey")


@query("filter_like", "SELECT p_partkey, p_name FROM part WHERE p_name LIKE 'Part%1_' OR p_type LIKE '%A%'")
def _(t):
    return R.where(t.part, S.like(c("p_name"), "Part%1_") | S.like(c("p_type"), "%A%")).select("p_partkey", "p_name")


@query("filter_like_classes", "SELECT c_custkey FROM customer WHERE regexp_matches(c_name, '^.*[0-4][^5-9]$')")
def _(t):
    return R.where(t.customer, S.like(c("c_name"), "%[0-4][^5-9]")).select("c_custkey")


_SPARSE = "SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS v, CASE WHEN event_id % 5 = 0 THEN NULL ELSE value > 50 END AS big FROM events"


def sparse(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.when(c("event_id") % 7 != 0, c("value")).alias("v"), F.when(c("event_id") % 5 != 0, c("value") > 50).alias("big"))


@query("filter_is_null", f"SELECT event_id FROM ({_SPARSE}) WHERE v IS NULL")
def _(t):
    return sparse(t).filter(c("v").isNull()).select("event_id")


@query("filter_is_not_null", f"SELECT event_id, v FROM ({_SPARSE}) WHERE v IS NOT NULL")
def _(t):
    return sparse(t).filter(c("v").isNotNull()).select("event_id", "v")


@query("filter_is_true_false", f"SELECT event_id, big IS TRUE AS t, big IS FALSE AS f, big IS NOT TRUE AS nt, big IS NOT FALSE AS nf FROM ({_SPARSE})")
def _(t):
    b = c("big")
    return sparse(t).select("event_id", b.eqNullSafe(True).alias("t"), b.eqNullSafe(False).alias("f"), (~b.eqNullSafe(True)).alias("nt"), (~b.eqNullSafe(False)).alias("nf"))


@query("filter_is_distinct_from", f"SELECT a.event_id FROM ({_SPARSE}) a WHERE a.v IS NOT DISTINCT FROM CASE WHEN a.event_id % 14 = 0 THEN NULL ELSE a.v END")
def _(t):
    return sparse(t).filter(c("v").eqNullSafe(F.when(c("event_id") % 14 != 0, c("v")))).select("event_id")


@query("arithmetic", "SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount) * (1 + l_tax) - l_quantity / 2, 6) AS v, l_orderkey % 7 AS m FROM lineitem")
def _(t):
    v = c("l_extendedprice") * (1 - c("l_discount")) * (1 + c("l_tax")) - c("l_quantity") / 2
    return t.lineitem.select("l_orderkey", "l_linenumber", F.round(v, 6).alias("v"), (c("l_orderkey") % 7).alias("m"))


@query("case_searched", "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS band FROM orders")
def _(t):
    return t.orders.select("o_orderkey", F.when(c("o_totalprice") > 200000, "high").when(c("o_totalprice") > 100000, "mid").otherwise("low").alias("band"))


@query("case_simple", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 END AS code FROM orders")
def _(t):
    return t.orders.select("o_orderkey", F.when(c("o_orderstatus") == "F", 1).when(c("o_orderstatus") == "O", 2).alias("code"))


@query("literals", "SELECT n_nationkey, 'it''s' AS s, 1.5::DOUBLE AS d, TRUE AS b, 7::BIGINT AS n FROM nation")
def _(t):
    return t.nation.select("n_nationkey", F.lit("it's").alias("s"), F.lit(1.5).alias("d"), F.lit(True).alias("b"), F.lit(7).cast("long").alias("n"))


# --- joins ---


@query("join_inner", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def _(t):
    return R.join(t.nation, t.region, c("n_regionkey") == c("r_regionkey")).select("n_name", "r_name")


@query("join_left", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 300000")
def _(t):
    return R.join(t.customer, t.orders, (c("c_custkey") == c("o_custkey")) & (c("o_totalprice") > 300000), "left").select("c_custkey", "o_orderkey")


@query("join_right", "SELECT p_partkey, l_orderkey FROM (SELECT * FROM lineitem WHERE l_quantity > 49) RIGHT JOIN part ON l_partkey = p_partkey")
def _(t):
    return R.join(t.lineitem.filter(c("l_quantity") > 49), t.part, c("l_partkey") == c("p_partkey"), "right").select("p_partkey", "l_orderkey")


@query("join_full", "SELECT s_suppkey, c_custkey FROM (SELECT * FROM supplier WHERE s_nationkey < 12) FULL JOIN (SELECT * FROM customer WHERE c_nationkey > 8 AND c_custkey < 100) ON s_nationkey = c_nationkey")
def _(t):
    s, k = t.supplier.filter(c("s_nationkey") < 12), t.customer.filter((c("c_nationkey") > 8) & (c("c_custkey") < 100))
    return R.join(s, k, c("s_nationkey") == c("c_nationkey"), "full").select("s_suppkey", "c_custkey")


@query("join_theta", "SELECT a.n_nationkey AS a, b.s_suppkey AS b FROM nation a JOIN supplier b ON a.n_nationkey = b.s_nationkey AND b.s_acctbal > a.n_regionkey * 1000")
def _(t):
    return R.join(t.nation, t.supplier, (c("n_nationkey") == c("s_nationkey")) & (c("s_acctbal") > c("n_regionkey") * 1000)).select(c("n_nationkey").alias("a"), c("s_suppkey").alias("b"))


@query("join_semi", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def _(t):
    return R.join(t.customer, t.orders.filter(c("o_orderpriority") == "1-URGENT"), c("c_custkey") == c("o_custkey"), "semi").select("c_custkey")


@query("join_anti", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def _(t):
    return R.join(t.customer, t.orders, c("c_custkey") == c("o_custkey"), "anti").select("c_custkey")


@query("join_chain", "SELECT r_name, count(*) AS n, round(sum(l_extendedprice), 2) AS v FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def _(t):
    j = R.join_chain(t.lineitem, (t.orders, c("l_orderkey") == c("o_orderkey"), "inner"), (t.customer, c("o_custkey") == c("c_custkey"), "inner"), (t.nation, c("c_nationkey") == c("n_nationkey"), "inner"), (t.region, c("n_regionkey") == c("r_regionkey"), "inner"))
    return R.group(j, ["r_name"], {"n": F.count("*"), "v": F.round(F.sum("l_extendedprice"), 2)})


@query("join_then_filter", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey WHERE o_orderkey IS NULL OR o_totalprice > 400000")
def _(t):
    return R.where(R.join(t.customer, t.orders, c("c_custkey") == c("o_custkey"), "left"), c("o_orderkey").isNull() | (c("o_totalprice") > 400000)).select("c_custkey", "o_orderkey")


# --- aggregation ---


@query("group_by", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS q, round(avg(l_extendedprice), 4) AS p, min(l_discount) AS lo, max(l_tax) AS hi FROM lineitem GROUP BY ALL")
def _(t):
    return R.group(t.lineitem, ["l_returnflag", "l_linestatus"], {"n": F.count("*"), "q": F.round(F.sum("l_quantity"), 2), "p": F.round(F.avg("l_extendedprice"), 4), "lo": F.min("l_discount"), "hi": F.max("l_tax")})


@query("count_column", f"SELECT count(*) AS n, count(v) AS nv, count(CASE WHEN big THEN 1 END) AS nb FROM ({_SPARSE})")
def _(t):
    return R.group(sparse(t), [], {"n": F.count("*"), "nv": F.count("v"), "nb": F.count(F.when(c("big"), 1))})


@query("count_case", "SELECT o_orderstatus, count(*) FILTER (o_totalprice > 150000) AS n FROM orders GROUP BY ALL")
def _(t):
    return R.group(t.orders, ["o_orderstatus"], {"n": A.count_true(F.when(c("o_totalprice") > 150000, 1).otherwise(0))})


@query("sum_avg_of_nothing", "SELECT event_type, coalesce(sum(value) FILTER (value < -1e9), 0)::DOUBLE AS s, coalesce(avg(value) FILTER (value < -1e9), 0)::DOUBLE AS a, min(value) FILTER (value < -1e9) AS m FROM events GROUP BY ALL")
def _(t):
    v = F.when(c("value") < -1e9, c("value"))
    return R.group(t.events, ["event_type"], {"s": A.sum_or_zero(v).cast("double"), "a": A.avg_or_zero(v), "m": F.min(v)})


@query("aggregate_over_case", "SELECT c_mktsegment, round(sum(CASE WHEN c_acctbal > 0 THEN c_acctbal ELSE 0 END), 2) AS pos, round(avg(CASE WHEN c_acctbal < 0 THEN c_acctbal END), 4) AS neg FROM customer GROUP BY ALL")
def _(t):
    return R.group(t.customer, ["c_mktsegment"], {"pos": F.round(F.sum(F.when(c("c_acctbal") > 0, c("c_acctbal")).otherwise(0)), 2), "neg": F.round(F.avg(F.when(c("c_acctbal") < 0, c("c_acctbal"))), 4)})


@query("aggregate_over_expression", "SELECT l_returnflag, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(max(l_quantity * l_tax), 4) AS m FROM lineitem GROUP BY ALL")
def _(t):
    return R.group(t.lineitem, ["l_returnflag"], {"revenue": F.round(F.sum(c("l_extendedprice") * (1 - c("l_discount"))), 2), "m": F.round(F.max(c("l_quantity") * c("l_tax")), 4)})


@query("global_aggregate", "SELECT count(*) AS n, round(avg(o_totalprice), 4) AS a, min(o_orderdate) AS lo, max(o_orderdate) AS hi FROM orders")
def _(t):
    return R.group(t.orders, [], {"n": F.count("*"), "a": F.round(F.avg("o_totalprice"), 4), "lo": F.min("o_orderdate"), "hi": F.max("o_orderdate")})


@query("having", "SELECT c_mktsegment, count(*) AS cnt, round(avg(c_acctbal), 4) AS avg_bal FROM customer GROUP BY ALL HAVING count(*) > 5 ORDER BY avg_bal DESC LIMIT 10")
def _(t):
    g = R.group(t.customer, ["c_mktsegment"], {"cnt": F.count("*"), "avg_bal": F.round(F.avg("c_acctbal"), 4)}, having=c("cnt") > 5)
    return R.top_k(g, [F.desc("avg_bal")], 10)


@query("non_grouped_column", "SELECT c_nationkey, min(c_name) AS name, count(*) AS n FROM customer GROUP BY ALL")
def _(t):
    return R.group(t.customer, ["c_nationkey"], {"name": F.min("c_name"), "n": F.count("*")})


@query("stddev_variance", "SELECT l_returnflag, round(stddev_pop(l_quantity), 6) AS sd, round(var_pop(l_quantity), 6) AS v FROM lineitem GROUP BY ALL")
def _(t):
    return R.group(t.lineitem, ["l_returnflag"], {"sd": F.round(A.stddev(c("l_quantity")), 6), "v": F.round(A.variance(c("l_quantity")), 6)})


@query("stddev_below_two_values", "SELECT c_custkey, CASE WHEN count(c_acctbal) >= 2 THEN stddev_pop(c_acctbal) END AS sd FROM customer WHERE c_custkey < 20 GROUP BY ALL")
def _(t):
    return R.group(t.customer.filter(c("c_custkey") < 20), ["c_custkey"], {"sd": A.stddev(c("c_acctbal"))})


@query("percentile_cont", "SELECT c_mktsegment, round(quantile_cont(c_acctbal, 0.3), 6) AS p30, round(quantile_cont(c_acctbal, 0.5), 6) AS p50 FROM customer GROUP BY ALL")
def _(t):
    return R.group(t.customer, ["c_mktsegment"], {"p30": F.round(A.percentile_cont(c("c_acctbal"), 0.3), 6), "p50": F.round(A.percentile_cont(c("c_acctbal")), 6)})


@query("corr", "SELECT l_returnflag, round(corr(l_quantity, l_extendedprice), 8) AS r FROM lineitem GROUP BY ALL")
def _(t):
    return R.group(t.lineitem, ["l_returnflag"], {"r": F.round(A.corr(c("l_quantity"), c("l_extendedprice")), 8)})


@query("regr_slope", "SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 6) AS s FROM lineitem GROUP BY ALL")
def _(t):
    return R.group(t.lineitem, ["l_returnflag"], {"s": F.round(A.regr_slope(c("l_quantity"), c("l_extendedprice")), 6)})


@query("corr_without_variance", "SELECT n_regionkey, 0.0::DOUBLE AS r, 0.0::DOUBLE AS s FROM nation GROUP BY ALL")
def _(t):
    return R.group(t.nation, ["n_regionkey"], {"r": A.corr(c("n_regionkey"), c("n_nationkey")), "s": A.regr_slope(c("n_regionkey"), c("n_nationkey"))})


@query("count_distinct", "SELECT o_orderpriority, count(DISTINCT o_custkey) AS n FROM orders GROUP BY ALL")
def _(t):
    return R.group(t.orders, ["o_orderpriority"], {"n": F.countDistinct("o_custkey")})


@query("rollup", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def _(t):
    return R.grouping_sets(t.orders, "rollup", ["o_orderstatus", "o_orderpriority"], {"n": F.count("*")})


@query("cube", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def _(t):
    return R.grouping_sets(t.orders, "cube", ["o_orderstatus", "o_orderpriority"], {"n": F.count("*")})


@query("salted_group", "SELECT event_type, count(DISTINCT user_id) AS users, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def _(t):
    first = t.events.groupBy("event_type", "user_id").agg(F.sum("value").alias("v"))
    return R.salted_group(first, ["event_type"], {"u": F.count("*"), "v": F.sum("v")}, {"users": F.sum("u"), "total": F.round(F.sum("v"), 4)})


# --- windows ---

_WIN = "PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey"
_FULL = "ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING"


@query(
    "window_functions",
    f"SELECT o_orderkey, row_number() OVER ({_WIN}) AS row_number, rank() OVER ({_WIN}) AS rank, dense_rank() OVER ({_WIN}) AS dense_rank, ntile(4) OVER ({_WIN}) AS ntile, lag(o_totalprice) OVER ({_WIN}) AS lag, lead(o_totalprice) OVER ({_WIN}) AS lead, first_value(o_totalprice) OVER ({_WIN} {_FULL}) AS first_value, last_value(o_totalprice) OVER ({_WIN} {_FULL}) AS last_value FROM orders",
)
def _(t):
    w = R.window_functions(["o_custkey"], ["o_orderdate", "o_orderkey"], c("o_totalprice"))
    return t.orders.select("o_orderkey", *[(x.cast("long") if n in ("row_number", "rank", "dense_rank", "ntile") else x).alias(n) for n, x in w.items()])


@query("window_rank_ties", "SELECT p_partkey, rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS r, dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS d FROM part")
def _(t):
    w = R.over(["p_brand"], ["p_size"])
    return t.part.select("p_partkey", F.rank().over(w).cast("long").alias("r"), F.dense_rank().over(w).cast("long").alias("d"))


@query("window_aggregate", "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING), 2) AS running FROM orders")
def _(t):
    from pyspark.sql import Window

    w = R.over(["o_custkey"], ["o_orderdate", "o_orderkey"]).rowsBetween(Window.unboundedPreceding, 0)
    return t.orders.select("o_orderkey", F.round(F.sum("o_totalprice").over(w), 2).alias("running"))


@query("window_aggregate_mix", "SELECT c_custkey, round(c_acctbal - avg(c_acctbal) OVER (PARTITION BY c_mktsegment), 6) AS d, count(*) OVER (PARTITION BY c_mktsegment) AS n FROM customer")
def _(t):
    w = R.over(["c_mktsegment"])
    return t.customer.select("c_custkey", F.round(c("c_acctbal") - F.avg("c_acctbal").over(w), 6).alias("d"), F.count("*").over(w).alias("n"))


@query("top_k_per_group", "SELECT c_mktsegment, c_custkey, c_acctbal FROM customer QUALIFY row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) <= 3")
def _(t):
    return R.top_k_per_group(t.customer, ["c_mktsegment"], [F.desc("c_acctbal"), F.asc("c_custkey")], 3).select("c_mktsegment", "c_custkey", "c_acctbal")


# --- order, limit, sets, subqueries ---


@query("order_by", "SELECT s_suppkey, s_acctbal FROM supplier ORDER BY s_acctbal DESC, s_suppkey")
def _(t):
    return t.supplier.select("s_suppkey", "s_acctbal").orderBy(F.desc("s_acctbal"), "s_suppkey")


@query("limit_offset", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 10")
def _(t):
    return R.top_k(t.orders.select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.asc("o_orderkey")], 20, 10)


@query("top_k", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 15")
def _(t):
    return R.top_k(t.lineitem.select("l_orderkey", "l_linenumber", "l_extendedprice"), [F.desc("l_extendedprice"), F.asc("l_orderkey"), F.asc("l_linenumber")], 15)


@query("distinct", "SELECT DISTINCT l_shipdate::DATE AS d, l_returnflag FROM lineitem ORDER BY 1, 2")
def _(t):
    return R.distinct_sorted(t.lineitem.select(F.to_date("l_shipdate").alias("d"), "l_returnflag"), "d", "l_returnflag")


@query("cte", "WITH big AS (SELECT o_custkey, sum(o_totalprice) AS total FROM orders GROUP BY 1) SELECT c_name, round(total, 2) AS total FROM big JOIN customer ON c_custkey = o_custkey WHERE total > (SELECT avg(total) FROM big)")
def _(t):
    big = R.group(t.orders, ["o_custkey"], {"total": F.sum("o_totalprice")})
    mean = big.agg(F.avg("total").alias("mean"))
    return big.join(mean, c("total") > c("mean")).join(t.customer, c("c_custkey") == c("o_custkey")).select("c_name", F.round("total", 2).alias("total"))


@query("subquery_in", "SELECT s_suppkey FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
def _(t):
    return R.join(t.supplier, t.nation.filter(c("n_regionkey") == 1), c("s_nationkey") == c("n_nationkey"), "semi").select("s_suppkey")


@query("union_all", "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
def _(t):
    return t.customer.select(c("c_nationkey").alias("k")).unionAll(t.supplier.select("s_nationkey"))


@query("union", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def _(t):
    return t.customer.select(c("c_nationkey").alias("k")).union(t.supplier.select("s_nationkey")).distinct()


@query("intersect", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def _(t):
    return t.customer.select(c("c_nationkey").alias("k")).intersect(t.supplier.select("s_nationkey"))


@query("except", "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")
def _(t):
    return t.nation.select(c("n_nationkey").alias("k")).subtract(t.supplier.filter(c("s_acctbal") > 5000).select("s_nationkey"))


@query(
    "monthly_revenue",
    """
    WITH m AS (SELECT l_returnflag, date_trunc('month', o_orderdate)::DATE AS month, sum(l_extendedprice * (1 - l_discount)) AS revenue, stddev_pop(l_quantity) AS sd_quantity, count(*) AS n
               FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2),
    s AS (SELECT l_returnflag, avg(revenue) AS mean, stddev_pop(revenue) AS sd FROM m GROUP BY 1)
    SELECT m.l_returnflag, month, round(revenue, 2) AS revenue, n, round(sd_quantity, 4) AS sd_quantity,
           round(avg(revenue) OVER (PARTITION BY m.l_returnflag ORDER BY month ROWS 2 PRECEDING), 2) AS trailing,
           rank() OVER (PARTITION BY m.l_returnflag ORDER BY revenue DESC) AS position, coalesce(abs(revenue - mean) > 2 * sd, FALSE) AS outlier
    FROM m JOIN s ON m.l_returnflag = s.l_returnflag
    """,
)
def monthly_revenue(t):
    """Join, aggregation, trailing window, rank and a deviation flag in one plan."""
    j = R.join(t.lineitem, t.orders.select("o_orderkey", "o_orderdate"), c("l_orderkey") == c("o_orderkey"))
    m = R.group(j, ["l_returnflag", F.trunc("o_orderdate", "month").alias("month")], {"revenue": F.sum(c("l_extendedprice") * (1 - c("l_discount"))), "sd_quantity": F.stddev_pop("l_quantity"), "n": F.count("*")})
    flag, by_month = R.over(["l_returnflag"]), R.over(["l_returnflag"], ["month"])
    return m.select(
        "l_returnflag", "month", F.round("revenue", 2).alias("revenue"), "n", F.round("sd_quantity", 4).alias("sd_quantity"),
        F.round(F.avg("revenue").over(by_month.rowsBetween(-2, 0)), 2).alias("trailing"),
        F.rank().over(R.over(["l_returnflag"], [F.desc("revenue")])).cast("long").alias("position"),
        (F.abs(c("revenue") - F.avg("revenue").over(flag)) > 2 * F.stddev_pop("revenue").over(flag)).alias("outlier"),
    )


@query("scan_chunks", "SELECT count(*) AS n_rows, (count(*) + 9999) // 10000 AS n_chunks FROM lineitem")
def _(t):
    sizes = R.numbered_chunks(t.lineitem.select("l_orderkey")).groupBy("chunk").agg(F.count("*").alias("n"))
    return sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count("*").alias("n_chunks"))
