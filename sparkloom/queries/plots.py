"""Plot-ready frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.operators import plotdata as P
from sparkloom.queries import query
from sparkloom.queries.statistics import rounded

c = F.col
#: A position derived from the key, so that both sides of the comparison have one.
_GEO = "(SELECT c_custkey, c_nationkey, c_acctbal, (c_custkey * 37 % 1801) / 10.0 - 90.0 AS lat, (c_custkey * 53 % 3601) / 10.0 - 180.0 AS lon FROM customer)"


def geo(t):
    return t.customer.select("c_custkey", "c_nationkey", "c_acctbal", ((c("c_custkey") * 37 % 1801) / 10.0 - 90.0).alias("lat"), ((c("c_custkey") * 53 % 3601) / 10.0 - 180.0).alias("lon"))


@query("plot_classify", "SELECT * FROM (VALUES ('o_orderkey', 'integer'), ('o_custkey', 'integer'), ('o_orderstatus', 'categorical'), ('o_totalprice', 'numeric'), ('o_orderdate', 'datetime'), ('o_orderpriority', 'categorical'), ('*', 'LINE')) v(\"column\", role)")
def _(t):
    return t.spark.createDataFrame([*P.classify(t.orders).items(), ("*", P.suggest(t.orders))], "column string, role string")


@query("plot_histogram", "WITH e AS (SELECT min(value) AS lo, max(value) AS hi, greatest(5, least(30, floor(sqrt(count(*)))))::INT AS b FROM events), h AS (SELECT least(floor((value - lo) / ((hi - lo) / b)), b - 1)::INT AS bin, count(*) AS n FROM events, e GROUP BY 1) SELECT bin, round(lo + bin * ((hi - lo) / b), 6) AS low, round(lo + (bin + 1) * ((hi - lo) / b), 6) AS high, n, (sum(n) OVER (ORDER BY bin))::BIGINT AS upto FROM h, e")
def _(t):
    return rounded(P.histogram(t.events, "value", running=True))


@query("plot_ecdf", "SELECT DISTINCT c_acctbal AS value, round(cume_dist() OVER (ORDER BY c_acctbal), 8) AS ecdf FROM customer")
def _(t):
    return P.ecdf(t.customer, "c_acctbal").select("value", F.round("ecdf", 8).alias("ecdf"))


@query(
    "plot_kde",
    "WITH s AS (SELECT count(*) AS n, min(c_acctbal) AS lo, max(c_acctbal) AS hi, greatest(0.1, 1.06 * stddev_samp(c_acctbal) * pow(count(*), -0.2)) AS h FROM customer), g AS (SELECT lo + i * ((hi - lo) / 19) AS x, n, h FROM s, (SELECT unnest(range(0, 20)) AS i)) SELECT round(x, 4) AS x, round(sum(exp(-0.5 * pow((x - c_acctbal) / h, 2))) / (n * h * sqrt(2 * pi())), 10) AS density FROM g, customer GROUP BY g.x, n, h",
)
def _(t):
    return P.kde(t.customer, "c_acctbal", 20).select(F.round("x", 4).alias("x"), F.round("density", 10).alias("density"))


@query("plot_histogram_2d", "WITH e AS (SELECT min(l_quantity) AS a, max(l_quantity) AS b, min(l_tax) AS c, max(l_tax) AS d FROM lineitem) SELECT least(floor((l_quantity - a) / ((b - a) / 5)), 4)::INT AS x_bin, least(floor((l_tax - c) / ((d - c) / 5)), 4)::INT AS y_bin, count(*) AS n FROM lineitem, e GROUP BY 1, 2")
def _(t):
    return P.histogram_2d(t.lineitem, "l_quantity", "l_tax", 5)


@query("plot_heatmap", "SELECT o_orderstatus AS \"row\", o_orderpriority AS \"column\", round(avg(o_totalprice), 4) AS value FROM orders GROUP BY 1, 2")
def _(t):
    return rounded(P.heatmap(t.orders, "o_orderstatus", "o_orderpriority", "o_totalprice"), 4)


_BOX = """SELECT '{0}' AS "column", round(a, 6) AS q1, round(m, 6) AS median, round(b, 6) AS q3, min({0}) FILTER ({0} BETWEEN a - 1.5 * (b - a) AND b + 1.5 * (b - a))::DOUBLE AS low, max({0}) FILTER ({0} BETWEEN a - 1.5 * (b - a) AND b + 1.5 * (b - a))::DOUBLE AS high, count(*) FILTER (NOT {0} BETWEEN a - 1.5 * (b - a) AND b + 1.5 * (b - a)) AS outliers FROM lineitem, (SELECT quantile_cont({0}, 0.25) AS a, median({0}) AS m, quantile_cont({0}, 0.75) AS b FROM lineitem) GROUP BY a, m, b"""


@query("plot_boxplot", " UNION ALL ".join(_BOX.format(x) for x in ("l_quantity", "l_extendedprice")))
def _(t):
    return rounded(P.boxplot(t.lineitem, ["l_quantity", "l_extendedprice"]))


_KDE = "(WITH s AS (SELECT count(*) AS n, min({0}) AS lo, max({0}) AS hi, greatest(0.1, 1.06 * stddev_samp({0}) * pow(count(*), -0.2)) AS h FROM lineitem), v AS (SELECT {0} AS v, count(*) AS c FROM lineitem GROUP BY 1), g AS (SELECT lo + i * ((hi - lo) / 29) AS x, n, h FROM s, (SELECT unnest(range(0, 30)) AS i)) SELECT '{0}' AS \"column\", round(x, 6) AS x, round(sum(c * exp(-0.5 * pow((x - v) / h, 2))) / (n * h * sqrt(2 * pi())), 8) AS density FROM g, v GROUP BY g.x, n, h)"


@query("plot_violin", " UNION ALL ".join(f"SELECT * FROM {_KDE.format(x)}" for x in ("l_quantity", "l_tax")))
def _(t):
    return P.violin(t.lineitem, ["l_quantity", "l_tax"]).select("column", F.round("x", 6).alias("x"), F.round("density", 8).alias("density"))


@query("plot_series", "SELECT p_partkey AS x, 'p_size' AS series, p_size::DOUBLE AS value FROM part UNION ALL SELECT p_partkey, 'p_retailprice', p_retailprice FROM part")
def _(t):
    return P.series(t.part, "p_partkey", ["p_size", "p_retailprice"])


@query("plot_bar", "SELECT p_brand AS category, round(sum(p_retailprice), 4) AS value FROM part GROUP BY 1")
def _(t):
    return rounded(P.bar(t.part, "p_brand", "p_retailprice"), 4)


@query("plot_pie", "WITH b AS (SELECT c_mktsegment AS category, sum(c_acctbal) AS value FROM customer GROUP BY 1) SELECT category, round(value, 4) AS value, round(value / sum(value) OVER (), 8) AS share FROM b WHERE value > 0")
def _(t):
    return P.pie(t.customer, "c_mktsegment", "c_acctbal").select("category", F.round("value", 4).alias("value"), F.round("share", 8).alias("share"))


@query("plot_correlation", "WITH m AS (SELECT round(corr(l_quantity, l_extendedprice), 8) AS r FROM lineitem) SELECT 'l_quantity' AS a, 'l_extendedprice' AS b, r FROM m UNION ALL SELECT 'l_extendedprice', 'l_quantity', r FROM m UNION ALL SELECT 'l_quantity', 'l_quantity', 1.0 UNION ALL SELECT 'l_extendedprice', 'l_extendedprice', 1.0")
def _(t):
    return rounded(P.correlation(t.lineitem, ["l_quantity", "l_extendedprice"]), 8)


@query("plot_trend", "SELECT round(regr_slope(l_extendedprice, l_quantity), 6) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 8) AS r2 FROM lineitem")
def _(t):
    r = P.trend(t.lineitem, "l_quantity", "l_extendedprice")
    return r.select(F.round("slope", 6).alias("slope"), F.round("intercept", 4).alias("intercept"), F.round("r2", 8).alias("r2"))


@query("plot_residuals", "WITH f AS (SELECT regr_slope(p_retailprice, p_size) AS s, regr_intercept(p_retailprice, p_size) AS i FROM part) SELECT p_size AS x, round(i + s * p_size, 6) AS fitted, round(p_retailprice - (i + s * p_size), 6) AS residual FROM part, f")
def _(t):
    return rounded(P.residuals(t.part, "p_size", "p_retailprice"))


@query("plot_qq")
def _(t):
    return P.qq(t.customer, "c_acctbal")


@query("plot_rescale", "SELECT c_custkey, round((c_acctbal - min(c_acctbal) OVER ()) / (max(c_acctbal) OVER () - min(c_acctbal) OVER ()), 8) AS n, round(CASE WHEN c_acctbal > 0 THEN ln(c_acctbal) END, 8) AS l FROM customer")
def _(t):
    d = P.rescale(t.customer, "c_acctbal", "normalize").withColumnRenamed("scaled", "n")
    return rounded(P.rescale(d, "c_acctbal", "log").select("c_custkey", "n", c("scaled").alias("l")), 8)


@query("plot_saved", "SELECT c_mktsegment AS category, round(sum(c_acctbal), 2) AS value, (SELECT count(DISTINCT c_mktsegment) FROM customer) AS bars FROM customer GROUP BY 1")
def _(t):
    """The frame saved as rows and read again, and the number of bars in its drawing."""
    import uuid

    from sparkloom.plans.staging import shared_dir

    frame, base = P.bar(t.customer, "c_mktsegment", "c_acctbal"), f"{shared_dir(t.spark)}/plot-{uuid.uuid4().hex}"
    P.save(frame, f"{base}/rows.parquet")
    P.save(frame, f"{base}/bars.svg", "BAR")
    drawn = t.spark.read.text(f"{base}/bars.svg", wholetext=True).select(F.expr("regexp_count(value, '<rect ')").cast("long").alias("bars"))
    return t.spark.read.parquet(f"{base}/rows.parquet").join(drawn).select("category", F.round("value", 2).alias("value"), "bars")


@query("plot_dashboard", "SELECT 6 AS frames")
def _(t):
    return t.spark.createDataFrame([(len(P.dashboard(t.lineitem.select("l_quantity", "l_extendedprice", "l_discount", "l_tax"))),)], "frames int")


@query("geo_points", f"SELECT lat::DOUBLE AS lat, lon::DOUBLE AS lon, c_custkey FROM {_GEO} WHERE lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180")
def _(t):
    d = geo(t)
    return P.geo_points(d.select(c("lat").cast("double").alias("lat"), c("lon").cast("double").alias("lon"), "c_custkey"), "lat", "lon", "c_custkey")


@query("geo_grid", f"SELECT (floor(lat / 15.0) * 15)::DOUBLE AS lat_cell, (floor(lon / 15.0) * 15)::DOUBLE AS lon_cell, count(*) AS n, round(avg(c_acctbal), 6) AS value FROM {_GEO} GROUP BY 1, 2")
def _(t):
    return rounded(P.geo_grid(geo(t), "lat", "lon", 15.0, "c_acctbal"))


@query("geo_bounds", f"SELECT min(lat)::DOUBLE AS south, max(lat)::DOUBLE AS north, min(lon)::DOUBLE AS west, max(lon)::DOUBLE AS east FROM {_GEO}")
def _(t):
    return P.geo_bounds(geo(t), "lat", "lon").select(*[c(x).cast("double").alias(x) for x in ("south", "north", "west", "east")])


@query("geo_flow", f"SELECT round(lat, 4)::DOUBLE AS from_lat, round(lon, 4)::DOUBLE AS from_lon, count(*) AS n, round(2 * 6371 * asin(least(1, sqrt(pow(sin(radians(0 - lat) / 2), 2) + cos(radians(lat)) * cos(0) * pow(sin(radians(0 - lon) / 2), 2)))), 4) AS km FROM {_GEO} GROUP BY lat, lon")
def _(t):
    f = P.geo_flow(geo(t).select(c("lat").cast("double").alias("a"), c("lon").cast("double").alias("b"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y")), "a", "b", "x", "y")
    return f.select(F.round("from_lat", 4).alias("from_lat"), F.round("from_lon", 4).alias("from_lon"), "n", F.round("km", 4).alias("km"))


@query("geo_regions", "SELECT c_nationkey AS region, count(*) AS n, round(sum(c_acctbal), 4) AS total, round(avg(c_acctbal), 4) AS mean FROM customer GROUP BY 1")
def _(t):
    return rounded(P.geo_regions(t.customer, "c_nationkey", "c_acctbal"), 4)


@query("geo_mercator", f"SELECT c_custkey, round(radians(lon), 8) AS x, round(ln(tan(pi() / 4 + radians(lat) / 2)), 6) AS y FROM {_GEO} WHERE abs(lat) < 90")
def _(t):
    return P.geo_mercator(geo(t), "lat", "lon").select("c_custkey", F.round("x", 8).alias("x"), F.round("y", 6).alias("y"))
