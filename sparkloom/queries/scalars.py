"""Scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.functions import scalar as S
from sparkloom.queries import query

c = F.col


@query("substr", "SELECT c_custkey, CASE WHEN length(c_name) < 3 THEN '' ELSE substr(c_name, 3, 5) END AS a, '' AS b, CASE WHEN length(c_name) < 10 THEN '' ELSE substr(c_name, 10) END AS d, '' AS e FROM customer")
def _(t):
    n = c("c_name")
    return t.customer.select("c_custkey", S.substr(n, 3, 5).alias("a"), S.substr(n, 0, 2).alias("b"), S.substr(n, 10).alias("d"), S.substr(n, 2, -1).alias("e"))


@query("concat", "SELECT n_nationkey, n_name || '-' || n_regionkey AS s, CASE WHEN n_regionkey = 2 THEN NULL ELSE 'x' || n_name END AS z FROM nation")
def _(t):
    return t.nation.select("n_nationkey", S.concat(c("n_name"), F.lit("-"), c("n_regionkey")).alias("s"), S.concat(F.when(c("n_regionkey") != 2, "x"), c("n_name")).alias("z"))


@query("length", "SELECT doc_id, strlen(text) AS n FROM documents")
def _(t):
    return t.documents.select("doc_id", S.length(c("text")).alias("n"))


@query("upper_lower", "SELECT p_partkey, upper(p_name) AS u, lower(p_type) AS l FROM part")
def _(t):
    return t.part.select("p_partkey", S.ascii_upper(c("p_name")).alias("u"), S.ascii_lower(c("p_type")).alias("l"))


@query("round", "SELECT o_orderkey, round(o_totalprice / 7, 2) AS a, round(o_totalprice)::DOUBLE AS b FROM orders")
def _(t):
    return t.orders.select("o_orderkey", F.round(c("o_totalprice") / 7, 2).alias("a"), F.round(c("o_totalprice")).alias("b"))


@query("year_month_day", "SELECT o_orderkey, year(o_orderdate)::INT AS y, month(o_orderdate)::INT AS m, day(o_orderdate)::INT AS d FROM orders")
def _(t):
    d = c("o_orderdate")
    return t.orders.select("o_orderkey", S.year(d).alias("y"), S.month(d).alias("m"), S.day(d).alias("d"))


@query("date_of_bad_text", "SELECT n_nationkey, NULL::INT AS y, 2024::INT AS z FROM nation")
def _(t):
    return t.nation.select("n_nationkey", S.year(c("n_name")).alias("y"), S.year(F.lit("2024-02-29 10:00:00")).alias("z"))


@query("julianday", "SELECT event_id, round(epoch(date_trunc('second', ts)) / 86400.0 + 2440587.5, 6) AS j FROM events")
def _(t):
    return t.events.select("event_id", F.round(S.julianday(c("ts")), 6).alias("j"))


@query("from_julianday", "SELECT o_orderkey, o_orderdate AS back FROM orders")
def _(t):
    return t.orders.select("o_orderkey", S.from_julianday(S.julianday(c("o_orderdate"))).cast("timestamp_ntz").alias("back"))


@query("datetime_arithmetic", "SELECT o_orderkey, o_orderdate + INTERVAL 10 DAY AS d, o_orderdate + INTERVAL 5 HOUR AS h, o_orderdate - INTERVAL 30 MINUTE AS m, o_orderdate + INTERVAL 1 MONTH AS mo FROM orders")
def _(t):
    d = c("o_orderdate").cast("timestamp_ntz")
    return t.orders.select("o_orderkey", S.add_days(d, 10).alias("d"), S.add_hours(d, 5).alias("h"), S.add_minutes(d, -30).alias("m"), S.add_months(d, 1).alias("mo"))


@query("now", "SELECT n_nationkey, TRUE AS ok FROM nation")
def _(t):
    return t.nation.select("n_nationkey", (F.current_timestamp() > F.lit("2020-01-01").cast("timestamp")).alias("ok"))


@query("nullif_coalesce", "SELECT o_orderkey, nullif(o_orderstatus, 'F') AS s, coalesce(nullif(o_orderstatus, 'F'), 'done') AS d FROM orders")
def _(t):
    s = F.nullif(c("o_orderstatus"), F.lit("F"))
    return t.orders.select("o_orderkey", s.alias("s"), F.coalesce(s, F.lit("done")).alias("d"))


@query("json_field", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def _(t):
    return t.events.select("event_id", F.get_json_object("props", "$.k").alias("k"))


@query("array_functions", "SELECT vec_id, len(embedding)::INT AS n, round(list_max(embedding)::DOUBLE, 5) AS hi, embedding[1] AS head FROM embeddings")
def _(t):
    return t.embeddings.select("vec_id", F.size("embedding").alias("n"), F.round(F.array_max("embedding").cast("double"), 5).alias("hi"), F.element_at("embedding", 1).alias("head"))


@query(
    "feature_transforms",
    "SELECT l_orderkey, l_linenumber, round((l_quantity - 1) / 49, 6) AS n, round((l_quantity - 25) / 14, 6) AS z, round(ln(l_quantity + 1), 6) AS l, CASE WHEN l_discount > 0.5 THEN 1.0 ELSE 0.0 END::DOUBLE AS b, round(1 / (1 + exp(-l_discount)), 6) AS s FROM lineitem",
)
def _(t):
    q, d = c("l_quantity"), c("l_discount")
    return t.lineitem.select("l_orderkey", "l_linenumber", F.round(S.transform_feature(q, "normalize", low=1, high=50), 6).alias("n"), F.round(S.transform_feature(q, "standardize", mean=25, sd=14), 6).alias("z"), F.round(S.transform_feature(q, "log"), 6).alias("l"), S.transform_feature(d, "binary").alias("b"), F.round(S.transform_feature(d, "sigmoid"), 6).alias("s"))


@query("string_hash", "SELECT count(*) AS n, TRUE AS within FROM customer")
def _(t):
    h = S.string_hash(c("c_name"))
    return t.customer.agg(F.count("*").alias("n"), F.every(h.between(0, 999)).alias("within"))


@query("string_encoding", "SELECT o_orderkey, (dense_rank() OVER (ORDER BY o_orderpriority) - 1)::DOUBLE AS code FROM orders")
def _(t):
    from pyspark.ml.feature import StringIndexer

    m = StringIndexer(inputCol="o_orderpriority", outputCol="code", stringOrderType="alphabetAsc").fit(t.orders)
    return m.transform(t.orders).select("o_orderkey", "code")


@query("coercion_text_to_number", "SELECT event_id, try_cast(replace(printf('%,d', (value * 1000)::BIGINT), ',', '') AS BIGINT) AS v FROM events")
def _(t):
    text = F.format_number((F.col("value") * 1000).cast("decimal(20,0)").cast("long"), 0)
    return t.events.select("event_id", F.regexp_replace(text, ",", "").try_cast("long").alias("v"))


@query("simple_filter", "SELECT p_partkey FROM part WHERE p_size >= 20 AND p_name LIKE 'Part%' AND p_brand <> 'Brand#11' AND p_type IS NOT NULL")
def _(t):
    d = t.part
    for f in ("p_size >= 20", "p_name LIKE 'Part%'", "p_brand != 'Brand#11'", "p_type IS NOT NULL"):
        d = d.filter(S.simple_filter(f))
    return d.select("p_partkey")
