"""Statements of the dialect, run through lexer, parser and catalog, beside the same query in standard SQL."""

from __future__ import annotations

import uuid

import pandas as pd

from sparkloom.plans.dialect import Engine
from sparkloom.plans.staging import shared_dir
from sparkloom.queries import query
from sparkloom.session import TABLES


def engine(t) -> Engine:
    e = Engine(t.spark, f"{shared_dir(t.spark)}/engine-{uuid.uuid4().hex}")
    for n in TABLES:
        e.register(n, getattr(t, n))
    return e


def both(name: str, text: str, sql: str | None = None) -> None:
    query(name, sql or text)(lambda t: engine(t).run(text))


both("dialect_select", "SELECT c_name AS name, c_acctbal FROM customer WHERE c_acctbal > 5000 AND c_mktsegment IN ('BUILDING', 'MACHINERY') ORDER BY c_acctbal DESC, name LIMIT 20")
both("dialect_group_having", "SELECT c_mktsegment, COUNT(*) AS cnt, ROUND(AVG(c_acctbal), 4) AS avg_bal FROM customer GROUP BY c_mktsegment HAVING COUNT(*) > 5 ORDER BY avg_bal DESC LIMIT 10")
both("dialect_join", "SELECT n_name, COUNT(*) AS n FROM customer c LEFT JOIN nation AS m ON c.c_nationkey = m.n_nationkey WHERE NOT (c.c_acctbal < 0) GROUP BY n_name")
both("dialect_cte", "WITH big AS (SELECT o_custkey, SUM(o_totalprice) AS total FROM orders GROUP BY o_custkey) SELECT o_custkey, ROUND(total, 2) AS total FROM big WHERE total > 500000")
both("dialect_case_between", "SELECT p_partkey, CASE WHEN p_size BETWEEN 1 AND 10 THEN 'small' WHEN p_size IS NULL THEN 'none' ELSE 'large' END AS band, CASE p_brand WHEN 'Brand#11' THEN 1 ELSE 0 END AS b FROM part")
both("dialect_window", "SELECT o_orderkey, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn, LAG(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS prev, LAST_VALUE(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS last FROM orders", "SELECT o_orderkey, row_number() OVER w AS rn, lag(o_totalprice) OVER w AS prev, last_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
both("dialect_statistics", "SELECT l_returnflag, ROUND(STDDEV(l_quantity), 6) AS sd, ROUND(PERCENTILE_CONT(l_quantity, 0.25), 6) AS q, ROUND(REGR_SLOPE(l_quantity, l_extendedprice), 6) AS slope, ROUND(CORR(l_quantity, l_extendedprice), 8) AS r FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, round(stddev_pop(l_quantity), 6) AS sd, round(quantile_cont(l_quantity, 0.25), 6) AS q, round(regr_slope(l_extendedprice, l_quantity), 6) AS slope, round(corr(l_quantity, l_extendedprice), 8) AS r FROM lineitem GROUP BY 1")
both("dialect_functions", "SELECT n_nationkey, SUBSTR(n_name, 2, 3) AS s, CONCAT(n_name, '/', n_regionkey) AS k, UPPER(n_name) AS u, LENGTH(n_name) AS n, SUBSTR(n_name, 0, 2) AS e, n_nationkey MOD 3 AS m FROM nation", "SELECT n_nationkey, substr(n_name, 2, 3) AS s, n_name || '/' || n_regionkey AS k, upper(n_name) AS u, strlen(n_name) AS n, '' AS e, n_nationkey % 3 AS m FROM nation")
both("dialect_like", "SELECT c_custkey FROM customer WHERE c_name LIKE '%[0-4][^5-9]' AND c_mktsegment NOT LIKE 'A%'", "SELECT c_custkey FROM customer WHERE regexp_matches(c_name, '^.*[0-4][^5-9]$') AND c_mktsegment NOT LIKE 'A%'")
both("dialect_set_operations", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey AS k FROM supplier EXCEPT SELECT n_nationkey AS k FROM nation WHERE n_regionkey = 1")
both("dialect_subquery", "SELECT s_suppkey FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1) AND s_acctbal > (SELECT AVG(s_acctbal) FROM supplier)")
both("dialect_distinct", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders ORDER BY o_orderpriority, o_orderstatus")


@query("dialect_tables", "SELECT * FROM (VALUES (2::BIGINT, 'bo', 41::BIGINT, TRUE, 'x'), (3, 'di', 7, FALSE, 'x')) v(id, name, age, active, note)")
def _(t):
    e = engine(t)
    for s in (
        "CREATE TABLE people (id INT PRIMARY_KEY AUTO_INCREAMENT, name TEXT NOT_NULL UNIQUE, age INT CHECK(age >= 0), active BOOL DEFAULT TRUE)",
        "INSERT INTO people (name, age) VALUES ('al', 30), ('bo', 40)",
        "BULK INSERT INTO people (name, age, active) VALUES ('di', 7, FALSE)",
        "UPDATE people SET age = age + 1 WHERE name = 'bo'",
        "DELETE FROM people WHERE age < 0",
        "ALTER TABLE people ADD memo TEXT DEFAULT 'x'",
        "ALTER TABLE people RENAME memo TO note",
        "BULK DELETE FROM people WHERE ROW IN (1)",
    ):
        e.run(s)
    return e.run("SELECT * FROM people")


@query("dialect_create_as", "SELECT r_name, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def _(t):
    e = engine(t)
    e.run("CREATE TABLE per_region AS SELECT r_name, COUNT(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
    return e.run("SELECT * FROM per_region")


@query("dialect_analyze", "SELECT 'o_totalprice' AS \"column\", count(*) AS n, round(avg(o_totalprice), 4) AS mean FROM orders")
def _(t):
    from pyspark.sql import functions as F

    return engine(t).run("ANALYZE DATA orders FEATURES (o_totalprice) TYPE SUMMARY").select("column", "n", F.round("mean", 4).alias("mean"))


@query(
    "dialect_prepare_and_forecast",
    """
    WITH t AS (SELECT o_orderdate::DATE AS d, sum(o_totalprice) AS v FROM orders GROUP BY 1), p AS (SELECT d, v, lag(v, 7) OVER (ORDER BY d) AS l, avg(v) OVER (ORDER BY d ROWS 2 PRECEDING) AS m, (row_number() OVER (ORDER BY d) - 1) / count(*) OVER () AS x FROM t)
    SELECT count(*) AS rows, round(sum(l), 2) AS lags, round(sum(m), 2) AS means, count(*) FILTER (x < 0.7) AS train, sum(month(d))::BIGINT AS months, round(arg_max(v, d), 2) AS last, 5::BIGINT AS steps FROM p
    """,
)
def _(t):
    from pyspark.sql import functions as F

    e = engine(t)
    e.register("daily", t.orders.groupBy(F.to_date("o_orderdate").alias("d")).agg(F.sum("o_totalprice").alias("v")))
    ready = e.run("PREPARE TIME SERIES ready FROM daily TIME COLUMN d TARGET v WITH LAGS (1, 7) ROLLING_WINDOWS (3) ADD_DATETIME_FEATURES NO_AUTO_DETECT SPLIT (TRAIN = 0.7, VALIDATION = 0.15)")
    told = ready.agg(F.count("*").alias("rows"), F.round(F.sum("v_lag_7"), 2).alias("lags"), F.round(F.sum("v_mean_3"), 2).alias("means"), F.count_if(F.col("part") == "train").alias("train"), F.sum(F.col("month").cast("long")).alias("months"))
    ahead = e.run("FORECAST USING persistence FROM daily TIME COLUMN d VALUE COLUMNS (v) HORIZON 5 WITH CONFIDENCE")
    return told.join(ahead.agg(F.round(F.max("value"), 2).alias("last"), F.count("*").alias("steps")))


@query("dialect_models", "SELECT count(*) AS n, round(avg(3.5 * p_size + 7), 4)::DOUBLE AS mean, round(min(3.5 * p_size + 7), 4)::DOUBLE AS low, round(max(3.5 * p_size + 7), 4)::DOUBLE AS high FROM part WHERE p_size > 10")
def _(t):
    from pyspark.sql import functions as F

    e = engine(t)
    e.register("priced", t.part.selectExpr("p_partkey", "p_size", "p_size * 3.5 + 7 AS price"))
    e.run("CREATE MODEL price USING LINEAR FEATURES (p_size) TARGET price FROM priced WITH (iterations = 30)")
    e.run("TRAIN MODEL again USING LIGHTGBM FEATURES (p_size) TARGET price FROM priced WITH HYPERPARAMETERS (num_iterations = 2) WHERE p_size > 3")
    out = e.run("PREDICT USING price ON priced WHERE p_size > 10 OUTPUT (p_partkey, prediction)")
    return out.agg(F.count("*").alias("n"), *[F.round(f("prediction"), 4).alias(n) for n, f in (("mean", F.avg), ("low", F.min), ("high", F.max))])


@query("dialect_plot", "SELECT c_mktsegment AS category, round(sum(c_acctbal), 2) AS value FROM customer GROUP BY 1")
def _(t):
    from pyspark.sql import functions as F

    return engine(t).run("PLOT BAR FOR SELECT c_mktsegment, c_acctbal FROM customer").select("category", F.round("value", 2).alias("value"))


@query("dialect_simulate", "SELECT unnest(range(1, 11))::BIGINT AS step, 20::BIGINT AS paths, TRUE AS distinct_paths, TRUE AS ordered")
def _(t):
    from pyspark.sql import functions as F

    out = engine(t).run("SIMULATE USING m FROM orders TIME COLUMN o_orderdate PRICE COLUMN o_totalprice STEPS 10 PATHS 20 INTERVAL 1d WITH_SCENARIO BULL")
    of = out.groupBy(F.col("step").cast("long").alias("step"))
    return of.agg(F.countDistinct("path").alias("paths"), (F.countDistinct("price") > 10).alias("distinct_paths"), F.every((F.col("bid") < F.col("price")) & (F.col("price") < F.col("ask"))).alias("ordered"))


@query("dialect_ai_functions", "SELECT p_partkey, y AS guess, y AS own, y AS direct, y AS ahead, 0.0::DOUBLE AS rest FROM (SELECT p_partkey, (3.5 * p_size + 7)::DOUBLE AS y FROM part WHERE p_size > 20)")
def _(t):
    from pyspark.sql import functions as F

    e = engine(t)
    e.register("priced", t.part.selectExpr("p_partkey", "p_size", "p_size * 3.5D + 7 AS price"))
    e.run("CREATE MODEL cost USING LINEAR FEATURES (p_size) TARGET price FROM priced WITH (iterations = 30)")
    out = e.run("SELECT p_partkey, AI_PREDICT('cost', p_size) AS guess, PREDICT_USING_cost(p_size) AS own, cost(p_size) AS direct, FORECAST('cost', p_size) AS ahead, RESIDUAL_USING_cost(p_size) AS rest FROM priced WHERE p_size > 20")
    return out.select("p_partkey", *[(F.round(c, 4) + 0.0).alias(c) for c in out.columns[1:]])


@query(
    "dialect_ai_anomaly_and_explain",
    "WITH z AS (SELECT p_partkey, p_size, abs(p_size - avg(p_size) OVER ()) / stddev_pop(p_size) OVER () AS z, avg(p_size) OVER () AS m FROM part) SELECT p_partkey, round(z / (z + 3), 6) AS score, 'p_size' AS feature, round(3.5 * (p_size - m), 6)::DOUBLE AS effect FROM z",
)
def _(t):
    from pyspark.sql import functions as F

    e = engine(t)
    e.register("priced", t.part.selectExpr("p_partkey", "p_size", "p_size * 3.5D + 7 AS price"))
    e.run("CREATE MODEL cost USING LINEAR FEATURES (p_size) TARGET price FROM priced WITH (iterations = 30)")
    out = e.run("SELECT p_partkey, AI_PREDICT_ANOMALY('cost', p_size) AS score, AI_EXPLAIN('cost', p_size) AS why FROM priced")
    return out.select("p_partkey", F.round("score", 6).alias("score"), F.col("why")[0]["feature"].alias("feature"), (F.round(F.col("why")[0]["effect"], 6) + 0.0).alias("effect"))


@query("dialect_transactions", "SELECT * FROM (VALUES (1, 'kept'), (2, 'kept'), (3, 'later')) v(k, v)")
def _(t):
    e = engine(t)
    e.run("CREATE TABLE notes (k INT PRIMARY_KEY, v TEXT)")
    for text in ("BEGIN", "INSERT INTO notes VALUES (1, 'kept')", "INSERT INTO notes VALUES (2, 'kept')", "COMMIT", "BEGIN TRANSACTION", "DELETE FROM notes", "INSERT INTO notes VALUES (9, 'gone')", "ROLLBACK", "INSERT INTO notes VALUES (3, 'later')"):
        e.run(text)
    return e.run("SELECT k, v FROM notes")


@query("dialect_database_stats", "SELECT 'default' AS database, 2::INT AS tables, 3::INT AS columns, (SELECT count(*) FROM region) + (SELECT count(*) FROM nation) AS rows, TRUE AS filled")
def _(t):
    from pyspark.sql import functions as F

    e = engine(t)
    e.run("CREATE TABLE r AS SELECT r_regionkey, r_name FROM region")
    e.run("CREATE TABLE n AS SELECT n_name FROM nation")
    return e.run("SHOW DATABASE STATS").select("database", "tables", "columns", "rows", ((F.col("bytes") > 0) & (F.col("files") >= 2)).alias("filled"))


@query("dialect_batch_and_pipeline", "SELECT (SELECT count(*) FROM nation) AS a, (SELECT count(*) FROM region) AS b, 3::BIGINT AS c")
def _(t):
    e = engine(t)
    a, b = (x.first()[0] for x in e.run_batch("BEGIN BATCH SELECT COUNT(*) AS n FROM nation; SELECT COUNT(*) AS n FROM region; END BATCH"))
    e.run("CREATE PIPELINE p AS ('CREATE TABLE r (k INT, v TEXT)', 'INSERT INTO r VALUES (1, \\'x\\'), (2, \\'y\\'), (3, \\'z\\')', 'SELECT COUNT(*) AS n FROM r')")
    return t.spark.createDataFrame([(a, b, e.run("RUN PIPELINE p").first()[0])], "a long, b long, c long")


@query("dialect_detect_anomaly", "WITH z AS (SELECT s_suppkey, abs(s_acctbal - avg(s_acctbal) OVER ()) / stddev_pop(s_acctbal) OVER () AS z FROM supplier), s AS (SELECT s_suppkey, z / (z + 3) AS score FROM z) SELECT s_suppkey, round(score, 6) AS score, score > (SELECT quantile_cont(score, 0.95) FROM s) AS anomaly FROM s")
def _(t):
    from pyspark.sql import functions as F

    out = engine(t).run("DETECT ANOMALY IN supplier FEATURES (s_acctbal) USING zscore")
    return out.select("s_suppkey", F.round("score", 6).alias("score"), "anomaly")


@query("dialect_user_function", "SELECT n_nationkey, n_regionkey * 2 + 1.0::DOUBLE AS d FROM nation")
def _(t):
    def twice_plus(x: pd.Series) -> pd.Series:
        return x * 2 + 1.0

    e = engine(t)
    e.register_function("twice_plus", twice_plus, "double")
    return e.run("SELECT n_nationkey, TWICE_PLUS(n_regionkey) AS d FROM nation")


@query("dialect_realtime_plot", "SELECT event_type, 'value' AS series, ts AS x, value FROM events")
def _(t):
    return engine(t).run("PLOT REALTIME LINE FOR SELECT ts, event_type, value FROM events")
