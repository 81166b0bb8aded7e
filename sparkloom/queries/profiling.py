"""ANALYZE DATA."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.operators import profile as P
from sparkloom.queries import query
from sparkloom.queries.statistics import rounded

c = F.col


def _summary_sql(table, col):
    return f"""
    SELECT '{col}' AS "column", count({col}) AS n, count(*) - count({col}) AS nulls, count(DISTINCT {col}) AS "distinct", round(avg({col}), 4) AS mean, round(stddev_samp({col}), 4) AS stddev, min({col})::DOUBLE AS min, max({col})::DOUBLE AS max,
    round(quantile_cont({col}, 0.1), 4) AS p10, round(quantile_cont({col}, 0.25), 4) AS q1, round(quantile_cont({col}, 0.5), 4) AS median, round(quantile_cont({col}, 0.99), 4) AS p99,
    count(*) FILTER ({col} < q.a - 1.5 * (q.b - q.a) OR {col} > q.b + 1.5 * (q.b - q.a)) AS outliers
    FROM {table}, (SELECT quantile_cont({col}, 0.25) AS a, quantile_cont({col}, 0.75) AS b FROM {table}) q"""


@query("analyze_summary", " UNION ALL ".join(_summary_sql("lineitem", x) for x in ("l_quantity", "l_extendedprice", "l_discount")))
def _(t):
    s = P.summary(t.lineitem, ["l_quantity", "l_extendedprice", "l_discount"])
    return rounded(s.select("column", "n", "nulls", "distinct", "mean", "stddev", "min", "max", "p10", "q1", "median", "p99", "outliers"), 4)


@query("analyze_types", "SELECT * FROM (VALUES ('c_custkey', 'integer', (SELECT count(DISTINCT c_custkey) FROM customer), (SELECT count(*) FROM customer)), ('c_name', 'string', (SELECT count(DISTINCT c_name) FROM customer), (SELECT count(*) FROM customer)), ('c_nationkey', 'integer', (SELECT count(DISTINCT c_nationkey) FROM customer), (SELECT count(*) FROM customer)), ('c_acctbal', 'float', (SELECT count(DISTINCT c_acctbal) FROM customer), (SELECT count(*) FROM customer)), ('c_mktsegment', 'categorical', (SELECT count(DISTINCT c_mktsegment) FROM customer), (SELECT count(*) FROM customer))) v(\"column\", type, \"distinct\", n)")
def _(t):
    return P.detect_types(t.customer)


@query("analyze_histogram", "WITH e AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders) SELECT least(floor((o_totalprice - lo) / ((hi - lo) / 12)), 11)::INT AS bin, round(lo + bin * ((hi - lo) / 12), 4) AS low, round(lo + (bin + 1) * ((hi - lo) / 12), 4) AS high, count(*) AS n FROM orders, e GROUP BY lo, hi, bin")
def _(t):
    return rounded(P.histogram(t.orders, "o_totalprice", 12), 4)


@query("analyze_categories", "SELECT p_brand AS category, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share, count(*) / sum(count(*)) OVER () < 0.01 AS rare, count(*) / sum(count(*)) OVER () > 0.1 AS dominant FROM part GROUP BY 1 ORDER BY n DESC, category LIMIT 10")
def _(t):
    return rounded(P.categories(t.part, "p_brand"))


_RANK = "(rank() OVER (ORDER BY {0}) + (count(*) OVER (PARTITION BY {0}) - 1) / 2.0)"
_STRENGTH = "CASE WHEN abs(r) >= 0.8 THEN 'very strong' WHEN abs(r) >= 0.6 THEN 'strong' WHEN abs(r) >= 0.4 THEN 'moderate' WHEN abs(r) >= 0.2 THEN 'weak' ELSE 'very weak' END"


@query("analyze_correlation", f"WITH k AS (SELECT {_RANK.format('l_quantity')} AS q, {_RANK.format('l_extendedprice')} AS e, {_RANK.format('l_tax')} AS t FROM lineitem), s AS (SELECT 'l_quantity' AS a, 'l_extendedprice' AS b, corr(q, e) AS s2 FROM k UNION ALL SELECT 'l_quantity', 'l_tax', corr(q, t) FROM k UNION ALL SELECT 'l_extendedprice', 'l_tax', corr(e, t) FROM k), p AS (SELECT 'l_quantity' AS a, 'l_extendedprice' AS b, corr(l_quantity, l_extendedprice) AS r, regr_slope(l_extendedprice, l_quantity) AS s, regr_intercept(l_extendedprice, l_quantity) AS i, count(*) AS n FROM lineitem UNION ALL SELECT 'l_quantity', 'l_tax', corr(l_quantity, l_tax), regr_slope(l_tax, l_quantity), regr_intercept(l_tax, l_quantity), count(*) FROM lineitem UNION ALL SELECT 'l_extendedprice', 'l_tax', corr(l_extendedprice, l_tax), regr_slope(l_tax, l_extendedprice), regr_intercept(l_tax, l_extendedprice), count(*) FROM lineitem) SELECT a, b, n, round(r, 6) AS pearson, round(s, 4) AS slope, round(i, 4) AS intercept, {_STRENGTH} AS strength, round(s2, 6) AS spearman, CASE WHEN abs(r) >= 0.6 THEN 'linear' WHEN abs(s2) >= 0.6 THEN 'monotonic' WHEN abs(r) < 0.2 AND abs(s2) < 0.2 THEN 'none' ELSE 'nonlinear' END AS relation FROM p JOIN s USING (a, b)")
def _(t):
    r = P.correlations(t.lineitem, ["l_quantity", "l_extendedprice", "l_tax"])
    return r.select("a", "b", "n", F.round("spearman", 6).alias("spearman"), "relation", F.round("pearson", 6).alias("pearson"), F.round("slope", 4).alias("slope"), F.round("intercept", 4).alias("intercept"), "strength")


def _scores_sql(target, features, few):
    """Every score from its definition, a feature at a time."""
    out = []
    for f in features:
        mi = f"(WITH e AS (SELECT min({f}) AS a, max({f}) AS b, min({target}) AS c, max({target}) AS d FROM lineitem), g AS (SELECT least(floor(({f} - a) / ((b - a) / 20)), 19) AS i, least(floor(({target} - c) / ((d - c) / 20)), 19) AS j, count(*) AS n FROM lineitem, e GROUP BY 1, 2), p AS (SELECT n / sum(n) OVER () AS p, sum(n) OVER (PARTITION BY i) / sum(n) OVER () AS pi, sum(n) OVER (PARTITION BY j) / sum(n) OVER () AS pj FROM g) SELECT sum(p * ln(p / (pi * pj))) FROM p)"
        rank = f"(SELECT abs(corr(a, b)) FROM (SELECT {_RANK.format(f)} AS a, {_RANK.format(target)} AS b FROM lineitem))"
        chi = anova = "NULL::DOUBLE"
        if f in few:
            part = f"WITH r AS (SELECT {target} AS v, row_number() OVER (ORDER BY {target}) - 1 AS i, count(*) OVER () AS n FROM lineitem), c AS (SELECT max(v) FILTER (i = n // 5) AS a, max(v) FILTER (i = 2 * n // 5) AS b, max(v) FILTER (i = 3 * n // 5) AS c, max(v) FILTER (i = 4 * n // 5) AS d FROM r), x AS (SELECT {f} AS x, CASE WHEN {target} > d THEN 4 WHEN {target} > c THEN 3 WHEN {target} > b THEN 2 WHEN {target} > a THEN 1 ELSE 0 END AS y FROM lineitem, c)"
            chi = f"({part}, o AS (SELECT x, y, count(*) AS o FROM x GROUP BY 1, 2), e AS (SELECT a.x, b.y, a.n * b.n / (SELECT count(*) FROM x) AS e FROM (SELECT x, count(*) AS n FROM x GROUP BY 1) a, (SELECT y, count(*) AS n FROM x GROUP BY 1) b) SELECT sum((coalesce(o, 0) - e) ** 2 / e) FROM e LEFT JOIN o USING (x, y))"
            anova = f"(WITH g AS (SELECT {f}, count(*) AS n, avg({target}) AS m, var_pop({target}) * count(*) AS w FROM lineitem GROUP BY 1) SELECT sum(n * (m - (SELECT avg({target}) FROM lineitem)) ** 2) / (count(*) - 1) / (sum(w) / (sum(n) - count(*))) FROM g)"
        out.append(f"SELECT '{f}' AS \"column\", (SELECT count(DISTINCT {f}) FROM lineitem) AS \"values\", (SELECT round(abs(corr({f}, {target})), 6) FROM lineitem) AS pearson, round({rank}, 6) AS spearman, round({mi}, 6) AS mutual_information, (SELECT round(abs(regr_slope({target}, {f})), 4) FROM lineitem) AS slope, round({chi}, 4) AS chi_square, round({anova}, 6) AS anova_f")
    return " UNION ALL ".join(out)


@query("analyze_importance_scores", _scores_sql("l_extendedprice", ("l_quantity", "l_tax"), ("l_tax",)))
def _(t):
    s = P.scores(t.lineitem, "l_extendedprice", ["l_quantity", "l_tax"])
    return s.select("column", "values", *[F.round(k, 4 if k in ("slope", "chi_square") else 6).alias(k) for k in ("pearson", "spearman", "mutual_information", "slope", "chi_square", "anova_f")])


@query("analyze_importance")
def _(t):
    return P.importance(t.lineitem, "l_extendedprice", ["l_quantity", "l_discount", "l_tax"])


@query("analyze_clustering")
def _(t):
    return P.clusters(t.customer.select("c_custkey", "c_acctbal", c("c_nationkey").cast("double").alias("nation")), ["c_acctbal", "nation"], 4)[1]


def lof_sql(source: str, key: str, columns: tuple[str, ...], k: int) -> str:
    """Common tables that end in lof (key, lof) and near (key, d): the local outlier factor from its definition."""
    square = " + ".join(f"(a.{x} - b.{x}) ** 2" for x in columns)
    return f"""z AS ({source}), n0 AS (SELECT a.{key} AS k, b.{key} AS o, sqrt({square}) AS d FROM z a JOIN z b ON a.{key} <> b.{key}),
    n1 AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY d, o) AS r FROM n0), near AS (SELECT k AS {key}, d FROM n1 WHERE r = 1), n2 AS (SELECT * FROM n1 WHERE r <= {k}),
    kd AS (SELECT k, max(d) AS kd FROM n2 GROUP BY 1), lrd AS (SELECT n2.k, count(*) / greatest(sum(greatest(d, kd)), 1e-12) AS lrd FROM n2 JOIN kd ON n2.o = kd.k GROUP BY 1),
    lof AS (SELECT n2.k AS {key}, avg(b.lrd) / any_value(a.lrd) AS lof FROM n2 JOIN lrd a ON n2.k = a.k JOIN lrd b ON n2.o = b.k GROUP BY 1)"""


_UNIT = "coalesce(({0} - min({0}) OVER ()) / nullif(max({0}) OVER () - min({0}) OVER (), 0), 0)"


@query(
    "analyze_outlier",
    "WITH " + lof_sql("SELECT s_suppkey, (s_acctbal - avg(s_acctbal) OVER ()) / stddev_pop(s_acctbal) OVER () AS a, (s_nationkey - avg(s_nationkey) OVER ()) / stddev_pop(s_nationkey) OVER () AS n FROM supplier", "s_suppkey", ("a", "n"), 10)
    + f", m AS (SELECT s_suppkey, sqrt(a * a + n * n) AS maha, d, lof FROM z JOIN near USING (s_suppkey) JOIN lof USING (s_suppkey)), s AS (SELECT s_suppkey, 0.4 * {_UNIT.format('maha')} + 0.3 * {_UNIT.format('d')} + 0.3 * {_UNIT.format('lof')} AS score FROM m) SELECT s_suppkey, round(score, 6) AS score, score > (SELECT quantile_cont(score, 0.95) FROM s) AS outlier FROM s",
)
def _(t):
    return rounded(P.outliers(t.supplier.select("s_suppkey", "s_acctbal", c("s_nationkey").cast("double").alias("nation")), "s_suppkey", ["s_acctbal", "nation"]))


@query(
    "analyze_nearest",
    "WITH p AS (SELECT a.s_suppkey, b.s_suppkey AS id, abs(a.s_acctbal - b.s_acctbal) AS d, row_number() OVER (PARTITION BY a.s_suppkey ORDER BY abs(a.s_acctbal - b.s_acctbal), b.s_suppkey) AS r FROM supplier a JOIN supplier b ON a.s_suppkey <> b.s_suppkey) SELECT s_suppkey, list(round(d, 4) ORDER BY r) AS d FROM p WHERE r <= 3 GROUP BY 1",
)
def _(t):
    n = P.nearest(t.supplier.select("s_suppkey", "s_acctbal"), "s_suppkey", ["s_acctbal"], 3)
    return n.select("s_suppkey", F.transform("neighbours", lambda x: F.round(x["d"], 4)).alias("d"))


@query("analyze_local_outlier_factor", "WITH " + lof_sql("SELECT c_custkey, c_acctbal AS a FROM customer", "c_custkey", ("a",), 10) + " SELECT c_custkey, round(lof, 6) AS lof FROM lof")
def _(t):
    return rounded(P.local_outlier_factor(t.customer.select("c_custkey", "c_acctbal"), "c_custkey", ["c_acctbal"], 10))


@query(
    "analyze_influence",
    "WITH a AS (SELECT count(*) AS n, avg(p_size) AS mx, regr_sxx(p_retailprice, p_size) AS sxx, regr_slope(p_retailprice, p_size) AS b, regr_intercept(p_retailprice, p_size) AS i, regr_syy(p_retailprice, p_size) AS syy, regr_sxy(p_retailprice, p_size) AS sxy FROM part), h AS (SELECT p_partkey, p_retailprice - i - b * p_size AS e, 1 / n + (p_size - mx) ** 2 / sxx AS h, (syy - b * sxy) / (n - 2) AS mse FROM part, a) SELECT p_partkey, round(h, 8) AS leverage, round(e * e / (2 * mse) * h / (1 - h) ** 2, 8) AS cook FROM h",
)
def _(t):
    return P.influence(t.part, "p_partkey", "p_size", "p_retailprice").select("p_partkey", F.round("leverage", 8).alias("leverage"), F.round("cook", 8).alias("cook"))


@query("analyze_distribution", "SELECT DISTINCT p_size::DOUBLE AS value, round(cume_dist() OVER (ORDER BY p_size), 8) AS ecdf FROM part")
def _(t):
    return P.distribution(t.part, "p_size").select("value", F.round("ecdf", 8).alias("ecdf"))


@query(
    "analyze_box_cox",
    "WITH l AS (SELECT i / 10.0::DOUBLE AS l FROM (SELECT unnest(range(-20, 21)) AS i)), v AS (SELECT l, count(*) AS n, sum(ln(o_totalprice)) AS s, var_pop(CASE WHEN l = 0 THEN ln(o_totalprice) ELSE (pow(o_totalprice, l) - 1) / l END) AS v FROM orders, l WHERE o_totalprice > 0 GROUP BY 1) SELECT l::DOUBLE AS lambda, round(-n / 2.0 * ln(v) + (l - 1) * s, 2) AS log_likelihood FROM v",
)
def _(t):
    return P.box_cox(t.orders, "o_totalprice").select("lambda", F.round("log_likelihood", 2).alias("log_likelihood"))


@query(
    "analyze_time_series",
    "WITH d AS (SELECT o_orderdate::DATE AS d, sum(o_totalprice) AS v FROM orders GROUP BY 1), i AS (SELECT d, v, row_number() OVER (ORDER BY d) - 1 AS i, avg(v) OVER (ORDER BY d ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS trend FROM d), s AS (SELECT i % 7 AS p, avg(v - trend) AS s FROM i GROUP BY 1) SELECT d, round(trend, 2) AS trend, round(s, 2) AS seasonal, round(v - trend - s, 2) AS residual FROM i JOIN s ON i % 7 = p",
)
def _(t):
    daily = t.orders.groupBy(F.to_date("o_orderdate").alias("d")).agg(F.sum("o_totalprice").alias("v"))
    return P.time_series(daily, "d", "v", 7).select("d", *[F.round(x, 2).alias(x) for x in ("trend", "seasonal", "residual")])


@query(
    "analyze_quality",
    """
    WITH q AS (SELECT count(*) AS n, (count(page_id) + count(url) + count(html)) / (3 * count(*)) AS completeness, count(*) FILTER (regexp_matches(url, '^(https?|ftp)://[^\\s/$.?#].[^\\s]*$')) / count(url) AS validity,
      (max(abs(page_id)) > 1000000)::BIGINT + (max(length(url)) > 1000)::BIGINT + (max(length(html)) > 1000)::BIGINT AS violations, count(*) - count(DISTINCT (page_id, url, html)) AS duplicates, count(DISTINCT page_id) AS a, count(DISTINCT url) AS b, count(DISTINCT html) AS c FROM pages)
    SELECT n, round(completeness, 6) AS completeness, round(1 - violations / 100, 6) AS consistency, 0.9::DOUBLE AS accuracy, 0.9::DOUBLE AS timeliness, round(validity, 6) AS validity, round(1 - duplicates / n, 6) AS uniqueness, violations, duplicates,
      list_filter([CASE WHEN a = n THEN 'page_id' END, CASE WHEN b = n THEN 'url' END, CASE WHEN c = n THEN 'html' END], lambda x: x IS NOT NULL) AS candidate_keys,
      round(0.2 * completeness + 0.15 * (1 - violations / 100) + 0.15 * 0.9 + 0.1 * 0.9 + 0.2 * validity + 0.2 * (1 - duplicates / n), 6) AS score FROM q
    """,
)
def _(t):
    return rounded(P.quality(t.pages))


@query(
    "analyze_timeseries",
    "WITH d AS (SELECT o_orderdate::DATE AS d, sum(o_totalprice) AS v FROM orders GROUP BY 1), i AS (SELECT d, v, row_number() OVER (ORDER BY d) - 1 AS i, avg(v) OVER (ORDER BY d ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS trend FROM d), s AS (SELECT i % 12 AS p, avg(v - trend) AS s FROM i GROUP BY 1) SELECT d, round(v, 2) AS v, round(trend, 2) AS trend, round(s, 2) AS seasonal, round(v - trend - s, 2) AS residual FROM i JOIN s ON i % 12 = p",
)
def _(t):
    daily = t.orders.groupBy(F.to_date("o_orderdate").alias("d")).agg(F.sum("o_totalprice").alias("v"))
    return rounded(P.analyze(daily, "TIMESERIES", time="d", period=12), 2)


@query(
    "analyze_comprehensive",
    """
    WITH m AS (SELECT count(*)::DOUBLE AS n, avg(p_size) AS ms, avg(p_retailprice) AS mr, corr(p_size, p_retailprice) AS r, median(p_size) AS qs, median(p_retailprice) AS qr, (count(*) - count(DISTINCT part))::DOUBLE AS d FROM part)
    SELECT 'summary' AS section, 'p_size' AS item, 'mean' AS measure, round(ms, 4) AS value FROM m UNION ALL SELECT 'summary', 'p_retailprice', 'mean', round(mr, 4) FROM m UNION ALL SELECT 'summary', 'p_size', 'median', round(qs, 4) FROM m
    UNION ALL SELECT 'summary', 'p_retailprice', 'median', round(qr, 4) FROM m UNION ALL SELECT 'correlation', 'p_size, p_retailprice', 'pearson', round(r, 4) FROM m UNION ALL SELECT 'quality', 'table', 'n', n FROM m UNION ALL SELECT 'quality', 'table', 'duplicates', d FROM m
    """,
)
def _(t):
    r = P.analyze(t.part, "COMPREHENSIVE", features=["p_size", "p_retailprice"])
    return rounded(r.where("measure IN ('mean', 'median', 'pearson', 'duplicates') OR section = 'quality' AND measure = 'n'"), 4)


@query("analyze_insights")
def _(t):
    o = t.lineitem.select("l_quantity", "l_extendedprice", "l_discount")
    lines = P.insights(P.summary(o).collect(), P.correlations(o).collect(), P.quality(o).first())
    return o.sparkSession.createDataFrame([(x,) for x in lines], "insight string")


@query(
    "analyze_report",
    """
    WITH s AS (SELECT p_brand, count(*) AS n, round(avg(p_retailprice), 2) AS mean FROM part GROUP BY 1), m AS (SELECT string_agg('| ' || p_brand || ' | ' || n || ' | ' || mean || ' |', chr(10) ORDER BY p_brand) AS t, string_agg(p_brand || ',' || n || ',' || mean, chr(10) ORDER BY p_brand) AS c FROM s)
    SELECT '| p_brand | n | mean |' || chr(10) || '|---|---|---|' || chr(10) || t AS markdown, 'p_brand,n,mean' || chr(10) || c || chr(10) AS csv FROM m
    """,
)
def _(t):
    brands = t.part.groupBy("p_brand").agg(F.count("*").alias("n"), F.round(F.avg("p_retailprice"), 2).alias("mean")).orderBy("p_brand")
    return t.part.sparkSession.createDataFrame([(P.report(brands), P.report(brands, "CSV"))], "markdown string, csv string")


@query("analyze_compare", "SELECT 'l_quantity' AS \"column\", count(*) FILTER (l_returnflag = 'A') AS a_n, round(avg(l_quantity) FILTER (l_returnflag = 'A'), 6) AS a_mean, count(*) FILTER (l_returnflag = 'R') AS b_n, round(avg(l_quantity) FILTER (l_returnflag = 'R'), 6) AS b_mean FROM lineitem")
def _(t):
    a, b = (t.lineitem.where(c("l_returnflag") == f).select("l_quantity") for f in "AR")
    return rounded(P.compare(a, b).select("column", "a_n", "a_mean", "b_n", "b_mean"))
