"""Models and anomaly detection."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.operators import anomaly as A
from sparkloom.operators import ml as M
from sparkloom.plans.staging import shared_dir
from sparkloom.queries import query
from sparkloom.queries.profiling import lof_sql
from sparkloom.queries.statistics import rounded

c = F.col


def toxic(t):
    """Labelled documents with a few numbers about their text."""
    d = t.documents.select("doc_id", "lang", F.length("text").cast("double").alias("chars"), (F.length("text") - F.length(F.translate("text", "#*$%&|!", ""))).cast("double").alias("marks"))
    return d.join(t.labels, "doc_id").orderBy("doc_id")


def items(t):
    return t.lineitem.select(c("l_orderkey").alias("k"), "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_extendedprice")


@query("ml_train_binary")
def _(t):
    m = M.train(toxic(t), "quality_model", ["chars", "marks"], "quality", "LIGHTGBM", iterations=5)
    return t.spark.createDataFrame([(k, float(v)) for k, v in m.card.metrics.items()], "metric string, value double")


@query("ml_train_regression")
def _(t):
    m = M.train(items(t), "price_model", ["l_quantity", "l_discount", "l_returnflag"], "l_extendedprice", "REGRESSION", iterations=5)
    return t.spark.createDataFrame([(k, float(v)) for k, v in m.card.metrics.items()], "metric string, value double")


@query("ml_train_multiclass")
def _(t):
    m = M.train(items(t), "flag_model", ["l_quantity", "l_discount"], "l_returnflag", "MULTICLASS", iterations=5)
    return t.spark.createDataFrame([(k, float(v)) for k, v in m.card.metrics.items()], "metric string, value double")


@query("ml_train_other_losses")
def _(t):
    rows = []
    for a in ("REGRESSION_L1", "HUBER", "POISSON", "GAMMA", "TWEEDIE", "LINEAR", "RANDOM_FOREST"):
        m = M.train(t.part.select("p_size", c("p_retailprice").alias("price"), "p_type"), "m", ["p_size", "p_type"], "price", a, iterations=3)
        rows.append((a, float(m.card.metrics["rmse"])))
    return t.spark.createDataFrame(rows, "algorithm string, rmse double")


@query("ml_predict")
def _(t):
    m = M.train(toxic(t), "quality_model", ["chars", "marks"], "quality", "BINARY", iterations=5)
    return M.predict(m, toxic(t)).select("doc_id", "prediction", "probability", "confidence")


@query("ml_importance")
def _(t):
    m = M.train(items(t), "price_model", ["l_quantity", "l_discount", "l_tax"], "l_extendedprice", "REGRESSION", iterations=5)
    return M.importance(m, t.spark)


@query("ml_explain")
def _(t):
    d = t.part.select("p_partkey", "p_size", c("p_retailprice").alias("price"))
    m = M.train(d, "part_model", ["p_size"], "price", "REGRESSION", iterations=3)
    return M.explain(m, d, "p_partkey")


@query("ml_cluster_assignment")
def _(t):
    m = M.train(t.customer, "seg", ["c_acctbal", "c_nationkey"], None, "KMEANS", clusters=3)
    return M.predict(m, t.customer).groupBy("prediction").agg(F.count("*").alias("n"))


@query("ml_registry", "SELECT 'price_model' AS name, 'REGRESSION' AS algorithm, 'regression' AS kind, 'price' AS target, 'p_size' AS features")
def _(t):
    import uuid

    r = M.Registry(t.spark, f"{shared_dir(t.spark)}/models-{uuid.uuid4().hex}")
    d = t.part.select("p_size", c("p_retailprice").alias("price"))
    r.save(M.train(d, "price_model", ["p_size"], "price", "REGRESSION", iterations=2))
    r.save(M.train(d, "other", ["p_size"], "price", "LINEAR", iterations=2))
    r.save(r.load("other"), replace=True)
    r.drop("other")
    return r.models().drop("metrics")


@query("ml_classification_metrics", "WITH p AS (SELECT CASE WHEN o_totalprice > 150000 THEN 1 ELSE 0 END AS p, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS y FROM orders), k AS (SELECT count(*) FILTER (p = 1 AND y = 1) AS tp, count(*) FILTER (p = 1 AND y = 0) AS fp, count(*) FILTER (p = 0 AND y = 1) AS fn, count(*) FILTER (p = y) AS ok, count(*) AS n FROM p) SELECT round(ok / n, 8) AS accuracy, round(tp / (tp + fp), 8) AS precision, round(tp / (tp + fn), 8) AS recall, round(2 * tp / (2 * tp + fp + fn), 8) AS f1 FROM k")
def _(t):
    d = t.orders.select(F.when(c("o_totalprice") > 150000, 1.0).otherwise(0.0).alias("p"), F.when(c("o_orderstatus") == "F", 1.0).otherwise(0.0).alias("y"))
    return rounded(M.classification_metrics(d, "y", "p"), 8)


@query("ml_regression_metrics", "WITH p AS (SELECT l_extendedprice AS y, l_quantity * 1500 AS p FROM lineitem) SELECT round(avg(abs(y - p)), 4) AS mae, round(avg((y - p) ** 2), 2) AS mse, round(sqrt(avg((y - p) ** 2)), 4) AS rmse, round(1 - avg((y - p) ** 2) / var_pop(y), 8) AS r2, round(avg(abs((y - p) / y)), 8) AS mape FROM p")
def _(t):
    m = M.regression_metrics(t.lineitem.select(c("l_extendedprice").alias("y"), (c("l_quantity") * 1500).alias("p")), "y", "p")
    return m.select(F.round("mae", 4).alias("mae"), F.round("mse", 2).alias("mse"), F.round("rmse", 4).alias("rmse"), F.round("r2", 8).alias("r2"), F.round("mape", 8).alias("mape"))


@query("ml_scaling", "SELECT c_custkey, round((c_acctbal - avg(c_acctbal) OVER ()) / stddev_pop(c_acctbal) OVER (), 6) AS z, round((c_acctbal - min(c_acctbal) OVER ()) / (max(c_acctbal) OVER () - min(c_acctbal) OVER ()), 6) AS u FROM customer")
def _(t):
    d = t.customer.select("c_custkey", c("c_acctbal").alias("z"), c("c_acctbal").alias("u"))
    return rounded(M.scale(M.scale(d, ["z"], "standard"), ["u"], "minmax"))


@query("ml_robust_scaling", "WITH q AS (SELECT median(c_acctbal) AS m, quantile_cont(c_acctbal, 0.75) - quantile_cont(c_acctbal, 0.25) AS r FROM customer) SELECT c_custkey, round((c_acctbal - m) / r, 6) AS c_acctbal FROM customer, q")
def _(t):
    return rounded(M.scale(t.customer.select("c_custkey", "c_acctbal"), ["c_acctbal"], "robust"))


@query("ml_stratified_sample", "SELECT o_orderpriority, ceil(count(*) * 0.1)::BIGINT AS n FROM orders GROUP BY 1")
def _(t):
    return M.sample(t.orders.select("o_orderkey", "o_orderpriority"), 0.1, by="o_orderpriority").groupBy("o_orderpriority").agg(F.count("*").alias("n"))


@query("ml_feature_selection", "SELECT 'l_extendedprice' AS feature, round(var_samp(l_extendedprice), 0) AS score FROM lineitem UNION ALL SELECT 'l_quantity', round(var_samp(l_quantity), 0) FROM lineitem")
def _(t):
    return rounded(M.select_features(t.lineitem, ["l_quantity", "l_extendedprice", "l_tax"], threshold=1.0), 0)


@query("ml_search")
def _(t):
    d = t.part.select(c("p_size").cast("double").alias("p_size"), c("p_retailprice").alias("price"))
    return M.search(d, ["p_size"], "price", {"maxDepth": [2, 4], "maxIter": [3]}, folds=2)


@query("ml_drift", "SELECT 1000::BIGINT AS n, round(avg(1 - 2 * abs(p - 0.5)), 6) AS drift FROM (SELECT (value - 0) / 1000.0 AS p FROM events ORDER BY event_id DESC LIMIT 1000)")
def _(t):
    return rounded(M.drift(t.events.select("event_id", (c("value") / 1000).alias("p")), "p", "event_id"))


@query("anomaly_isolation_forest")
def _(t):
    return A.detect(t.orders.select("o_orderkey", "o_totalprice", F.dayofyear("o_orderdate").cast("double").alias("day")), ["o_totalprice", "day"])


@query("anomaly_lof", "WITH " + lof_sql("SELECT s_suppkey, s_acctbal AS a FROM supplier", "s_suppkey", ("a",), 19) + ", s AS (SELECT s_suppkey, s_acctbal, 1 - 1 / greatest(lof, 1) AS score FROM lof JOIN supplier USING (s_suppkey)) SELECT s_suppkey, s_acctbal, round(score, 6) AS score, score > (SELECT quantile_cont(score, 0.95) FROM s) AS anomaly FROM s")
def _(t):
    return rounded(A.detect(t.supplier.select("s_suppkey", "s_acctbal"), ["s_acctbal"], "lof", key="s_suppkey"))


@query("anomaly_autoencoder")
def _(t):
    return A.detect(t.lineitem.select("l_orderkey", "l_quantity", "l_extendedprice", "l_discount"), ["l_quantity", "l_extendedprice", "l_discount"], "autoencoder")


@query("anomaly_zscore", "WITH s AS (SELECT event_id, abs(value - avg(value) OVER ()) / stddev_pop(value) OVER () AS z FROM events), r AS (SELECT event_id, z / (z + 3) AS score FROM s) SELECT event_id, round(score, 8) AS score, score > (SELECT quantile_cont(score, 0.95) FROM r) AS anomaly FROM r")
def _(t):
    return rounded(A.detect(t.events.select("event_id", "value"), ["value"], "zscore").drop("value"), 8)


@query(
    "anomaly_series",
    "WITH w AS (SELECT event_id, abs(value - avg(value) OVER (PARTITION BY event_type)) / nullif(stddev_samp(value) OVER (PARTITION BY event_type), 0) > 1.6 AS point, abs(value - avg(value) OVER (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)) / nullif(stddev_samp(value) OVER (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), 0) > 1.6 AS sliding FROM events) SELECT event_id, coalesce(point, FALSE) AS point, coalesce(sliding, FALSE) AS sliding FROM w",
)
def _(t):
    return A.series_anomalies(t.events, "event_id", "value", ("event_type",), z=1.6).select("event_id", "point", "sliding")


@query(
    "anomaly_collective",
    "WITH e AS (SELECT event_id, event_type, value AS v, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS i FROM events), w AS (SELECT event_type, count(*) AS n, sum(v) AS s, sum(v * v) AS q FROM e GROUP BY 1), g AS (SELECT e.event_type, i, count(*) OVER p AS k, sum(v) OVER p AS a, sum(v * v) OVER p AS b, n, s, q FROM e JOIN w USING (event_type) WINDOW p AS (PARTITION BY event_type ORDER BY i ROWS 2 PRECEDING)), f AS (SELECT event_type, i FROM g WHERE k = 3 AND abs(a / 3 - (s - a) / (n - 3)) / (sqrt((q - b) / (n - 3) - ((s - a) / (n - 3)) ** 2) + 1e-10) > 1.2) SELECT event_id, EXISTS (SELECT 1 FROM f WHERE f.event_type = e.event_type AND f.i BETWEEN e.i AND e.i + 2) AS collective FROM e",
)
def _(t):
    return A.collective(t.events, "event_id", "value", ("event_type",), z=1.2).select("event_id", "collective")


@query("anomaly_ensemble")
def _(t):
    return A.ensemble(t.orders.select("o_orderkey", "o_totalprice", F.dayofyear("o_orderdate").cast("double").alias("day")), "o_orderkey", ["o_totalprice", "day"])


@query("ml_discover_schema", "SELECT * FROM (VALUES ('c_custkey', 'standardize'), ('c_name', 'drop'), ('c_nationkey', 'standardize'), ('c_acctbal', 'target'), ('c_mktsegment', 'index')) v(\"column\", transform)")
def _(t):
    return M.discover_schema(t.customer, "c_acctbal").select("column", "transform")


@query("ml_schema_changes", "SELECT * FROM (VALUES ('r_regionkey', 'int to string'), ('extra', 'added'), ('r_name', 'removed')) v(\"column\", change)")
def _(t):
    return M.schema_changes(t.region, t.region.select(c("r_regionkey").cast("string").alias("r_regionkey"), F.lit(1).alias("extra")))
