"""Statistics of columns, with closed-form SQL beside them wherever there is one."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.operators.stats import correlation as C
from sparkloom.operators.stats import descriptive as D
from sparkloom.operators.stats import distance as X
from sparkloom.operators.stats import distributions as P
from sparkloom.operators.stats import information as I
from sparkloom.operators.stats import outliers as O
from sparkloom.operators.stats import tests as H
from sparkloom.operators.stats import timeseries as S
from sparkloom.queries import query

c = F.col


def rounded(df, digits=6):
    return df.select(*[F.round(c(f.name), digits).alias(f.name) if f.dataType.typeName() == "double" else c(f.name) for f in df.schema.fields])


_SKEW = "avg((x - m) ** 3) / sd ** 3 * CASE WHEN n > 3 THEN sqrt(n * (n - 1.0)) / (n - 2) ELSE 1 END"


@query(
    "stat_summary",
    """
    WITH b AS (SELECT c_mktsegment, count(*) AS n, avg(c_acctbal) AS m, stddev_samp(c_acctbal) AS sd FROM customer GROUP BY 1),
    d AS (SELECT b.*, c_acctbal AS x FROM customer JOIN b USING (c_mktsegment))
    SELECT c_mktsegment, any_value(n) AS n, round(any_value(m), 6) AS mean, round(median(x), 6) AS median, round(var_samp(x), 4) AS variance, round(any_value(sd), 6) AS stddev,
           round(max(x) - min(x), 6) AS range, round(quantile_cont(x, 0.75) - quantile_cont(x, 0.25), 6) AS iqr, round(any_value(sd) / any_value(m), 6) AS cv,
           round(avg((x - m) ** 3) / any_value(sd) ** 3 * sqrt(any_value(n) * (any_value(n) - 1.0)) / (any_value(n) - 2), 6) AS skewness,
           round(avg((x - m) ** 4) / any_value(sd) ** 4 - 3, 6) AS kurtosis
    FROM d GROUP BY 1
    """,
)
def _(t):
    s = D.summary(t.customer, "c_acctbal", ("c_mktsegment",))
    return s.select("c_mktsegment", "n", *[F.round(k, 4 if k == "variance" else 6).alias(k) for k in s.columns[2:]])


@query("stat_quantiles", "SELECT l_returnflag, [round(quantile_cont(l_extendedprice, 0.1), 4), round(quantile_cont(l_extendedprice, 0.9), 4)] AS q FROM lineitem GROUP BY 1")
def _(t):
    return D.quantiles(t.lineitem, "l_extendedprice", (0.1, 0.9), ("l_returnflag",)).select("l_returnflag", F.transform("q", lambda v: F.round(v, 4)).alias("q"))


@query("stat_trimmed_mean", "WITH r AS (SELECT o_totalprice AS x, row_number() OVER (ORDER BY o_totalprice) - 1 AS i, count(*) OVER () AS n FROM orders) SELECT round(avg(x), 4) AS trimmed_mean FROM r WHERE i >= floor(0.1 * n) AND i < n - floor(0.1 * n)")
def _(t):
    return rounded(D.trimmed_mean(t.orders, "o_totalprice", 0.1), 4)


@query(
    "stat_winsorized_mean",
    "WITH r AS (SELECT o_totalprice AS x, row_number() OVER (ORDER BY o_totalprice) - 1 AS i, count(*) OVER () AS n FROM orders), e AS (SELECT max(x) FILTER (i = floor(0.05 * n)) AS lo, max(x) FILTER (i = n - 1 - floor(0.05 * n)) AS hi FROM r) SELECT round(avg(least(greatest(x, lo), hi)), 4) AS winsorized_mean FROM r, e",
)
def _(t):
    return rounded(D.winsorized_mean(t.orders, "o_totalprice", 0.05), 4)


@query("stat_modes", "WITH k AS (SELECT p_size::DOUBLE AS mode, count(*) AS n FROM part GROUP BY 1) SELECT * FROM k WHERE n = (SELECT max(n) FROM k)")
def _(t):
    return D.modes(t.part, "p_size")


@query("stat_mad", "SELECT o_orderpriority, round(mad(o_totalprice), 4) AS mad FROM orders GROUP BY 1")
def _(t):
    return rounded(D.mad(t.orders, "o_totalprice", ("o_orderpriority",)), 4)


@query("stat_moments", "WITH b AS (SELECT avg(l_quantity) AS m, stddev_pop(l_quantity) AS s FROM lineitem) SELECT round(avg(l_quantity ** 3), 2) AS raw, round(avg((l_quantity - m) ** 4), 2) AS central, round(avg(((l_quantity - m) / s) ** 4), 6) AS standardized FROM lineitem, b")
def _(t):
    li = t.lineitem
    raw = li.agg(F.round(D.raw_moment(c("l_quantity"), 3), 2).alias("raw"))
    central = D.central_moment(li, "l_quantity", 4).select(F.round("moment", 2).alias("central"))
    return raw.join(central).join(D.standardized_moment(li, "l_quantity", 4).select(F.round("moment", 6).alias("standardized")))


@query(
    "stat_l_moments",
    """
    WITH r AS (SELECT p_retailprice AS x, row_number() OVER (ORDER BY p_retailprice) - 1.0 AS j, count(*) OVER () + 0.0 AS n FROM part),
    b AS (SELECT avg(x) AS b0, avg(x * j / (n - 1)) AS b1, avg(x * j * (j - 1) / ((n - 1) * (n - 2))) AS b2, avg(x * j * (j - 1) * (j - 2) / ((n - 1) * (n - 2) * (n - 3))) AS b3 FROM r)
    SELECT round(b0, 4) AS l1, round(2 * b1 - b0, 4) AS l2, round(6 * b2 - 6 * b1 + b0, 4) AS l3, round(20 * b3 - 30 * b2 + 12 * b1 - b0, 4) AS l4 FROM b
    """,
)
def _(t):
    return rounded(D.l_moments(t.part, "p_retailprice"), 4)


#: The normal distribution function as a series: 1/2 + density * sum of z^(2k+1) / (2k+1)!!.
_PHI = "(0.5 + sign({0}) * exp(-{0} * {0} / 2) / sqrt(2 * pi()) * list_sum(list_transform(range(0, 300), lambda k: exp((2 * k + 1) * ln(greatest(abs({0}), 1e-300)) - (k + 1) * ln(2) - lgamma(k + 1.5) + 0.5 * ln(pi())))))"


@query(
    "stat_pearson",
    f"""WITH c AS (SELECT corr(l_tax, l_extendedprice) AS r, count(*) AS n FROM lineitem), t AS (SELECT *, abs(r) * sqrt((n - 2) / (1 - r * r)) AS t FROM c),
    z AS (SELECT *, t * (1 - 1 / (4.0 * (n - 2))) / sqrt(1 + t * t / (2.0 * (n - 2))) AS z FROM t)
    SELECT 'pearson' AS measure, round(r, 6) AS value, round(2 * (1 - {_PHI.format('z')}), 6) AS p_value, n, round(tanh(atanh(r) - 1.96 / sqrt(n - 3)), 6) AS low, round(tanh(atanh(r) + 1.96 / sqrt(n - 3)), 6) AS high FROM z""",
)
def _(t):
    return rounded(C.pearson(t.lineitem, "l_tax", "l_extendedprice"))


_RANKS = "(rank() OVER (ORDER BY {0}) + (count(*) OVER (PARTITION BY {0}) - 1) / 2.0)"


@query("stat_spearman", f"WITH r AS (SELECT {_RANKS.format('p_size')} AS a, {_RANKS.format('p_retailprice')} AS b FROM part) SELECT 'spearman' AS measure, round(corr(a, b), 8) AS value, count(*) AS n FROM r")
def _(t):
    return rounded(C.spearman(t.part, "p_size", "p_retailprice").select("measure", "value", "n"), 8)


@query(
    "stat_kendall",
    "WITH p AS (SELECT sign(a.c_acctbal - b.c_acctbal) * sign(a.c_nationkey - b.c_nationkey) AS s FROM customer a JOIN customer b ON a.c_custkey < b.c_custkey) SELECT round((count(*) FILTER (s > 0) - count(*) FILTER (s < 0)) / count(*) FILTER (s <> 0), 8) AS kendall, (count(*) FILTER (s > 0))::DOUBLE AS concordant, (count(*) FILTER (s < 0))::DOUBLE AS discordant FROM p",
)
def _(t):
    return rounded(C.kendall(t.customer, "c_acctbal", "c_nationkey"), 8)


@query(
    "stat_distance_correlation",
    """
    WITH p AS (SELECT a.s_suppkey AS i, b.s_suppkey AS j, abs(a.s_acctbal - b.s_acctbal) AS x, abs(a.s_nationkey - b.s_nationkey) AS y FROM supplier a, supplier b),
    q AS (SELECT x - avg(x) OVER (PARTITION BY i) - avg(x) OVER (PARTITION BY j) + avg(x) OVER () AS x, y - avg(y) OVER (PARTITION BY i) - avg(y) OVER (PARTITION BY j) + avg(y) OVER () AS y FROM p)
    SELECT round(sqrt(avg(x * y) / sqrt(avg(x * x) * avg(y * y))), 6) AS distance_correlation FROM q
    """,
)
def _(t):
    return rounded(C.distance_correlation(t.supplier, "s_acctbal", "s_nationkey"), 6)


@query(
    "stat_hoeffding_d",
    """
    WITH p AS (SELECT a.c_custkey AS k, CASE WHEN b.c_acctbal < a.c_acctbal THEN 1.0 WHEN b.c_acctbal = a.c_acctbal THEN 0.5 ELSE 0 END AS x, CASE WHEN b.c_nationkey < a.c_nationkey THEN 1.0 WHEN b.c_nationkey = a.c_nationkey THEN 0.5 ELSE 0 END AS y FROM customer a JOIN customer b ON a.c_custkey <> b.c_custkey),
    q AS (SELECT sum(x)::DOUBLE + 1 AS r, sum(y)::DOUBLE + 1 AS s, sum(x * y)::DOUBLE + 1 AS q FROM p GROUP BY k),
    d AS (SELECT count(*)::DOUBLE AS n, sum((q - 1) * (q - 2)) AS d1, sum((r - 1) * (r - 2) * (s - 1) * (s - 2)) AS d2, sum((r - 2) * (s - 2) * (q - 1)) AS d3 FROM q)
    SELECT round(30 * ((n - 2) * (n - 3) * d1 + d2 - 2 * (n - 2) * d3) / (n * (n - 1) * (n - 2) * (n - 3) * (n - 4)), 8) AS hoeffding_d FROM d
    """,
)
def _(t):
    return rounded(C.hoeffding_d(t.customer, "c_acctbal", "c_nationkey"), 8)


@query("stat_maximal_information")
def _(t):
    return C.maximal_information(t.part, "p_size", "p_retailprice")


@query("stat_entropy", "WITH e AS (SELECT min(value) AS lo, max(value) AS hi FROM events), b AS (SELECT least(floor((value - lo) / ((hi - lo) / 10)), 9) AS k, count(*) AS c FROM events, e GROUP BY 1), p AS (SELECT c / sum(c) OVER () AS p FROM b) SELECT round(sum(-p * ln(p)), 6) AS entropy FROM p")
def _(t):
    return rounded(I.entropy(t.events, "value", 10))


@query(
    "stat_mutual_information",
    """
    WITH e AS (SELECT min(l_quantity) AS a, max(l_quantity) AS b, min(l_extendedprice) AS c, max(l_extendedprice) AS d FROM lineitem),
    g AS (SELECT least(floor((l_quantity - a) / ((b - a) / 10)), 9) AS i, least(floor((l_extendedprice - c) / ((d - c) / 10)), 9) AS j, count(*) AS n FROM lineitem, e GROUP BY 1, 2),
    p AS (SELECT n / sum(n) OVER () AS p, sum(n) OVER (PARTITION BY i) / sum(n) OVER () AS pi, sum(n) OVER (PARTITION BY j) / sum(n) OVER () AS pj FROM g)
    SELECT round(sum(p * ln(p / (pi * pj))), 6) AS mutual_information, round(sum(-p * ln(p / pi)), 6) AS conditional_entropy FROM p
    """,
)
def _(t):
    return rounded(I.mutual_information(t.lineitem, "l_quantity", "l_extendedprice", 10))


@query(
    "stat_divergences",
    """
    WITH p AS (SELECT c_mktsegment AS k, count(*) / sum(count(*)) OVER () AS p FROM customer WHERE c_nationkey < 12 GROUP BY 1), q AS (SELECT c_mktsegment AS k, count(*) / sum(count(*)) OVER () AS q FROM customer WHERE c_nationkey >= 12 GROUP BY 1)
    SELECT round(sum(p * ln(p / q)), 8) AS kl, round(sum(p * ln(p / ((p + q) / 2))) / 2 + sum(q * ln(q / ((p + q) / 2))) / 2, 8) AS js FROM p JOIN q USING (k)
    """,
)
def _(t):
    n = t.customer.groupBy("c_mktsegment").agg(F.count_if(c("c_nationkey") < 12).alias("a"), F.count_if(c("c_nationkey") >= 12).alias("b"))
    return rounded(I.divergences(n.select("c_mktsegment", c("a").alias("w")), n.select("c_mktsegment", c("b").alias("w")), "c_mktsegment", "w"), 8)


@query(
    "stat_distances",
    """
    WITH q AS (SELECT embedding AS b FROM embeddings WHERE vec_id = 0), p AS (SELECT vec_id, embedding::DOUBLE[] AS a, b::DOUBLE[] AS b FROM embeddings, q)
    SELECT vec_id, round(list_distance(a, b), 6) AS euclidean, round(list_sum(list_transform(list_zip(a, b), lambda z: abs(z[1] - z[2]))), 6) AS manhattan, round(list_max(list_transform(list_zip(a, b), lambda z: abs(z[1] - z[2]))), 6) AS chebyshev,
           round(list_sum(list_transform(list_zip(a, b), lambda z: abs(z[1] - z[2]) ** 3)) ** (1 / 3.0), 6) AS minkowski, round(list_cosine_similarity(a, b), 6) AS cosine FROM p
    """,
)
def _(t):
    q = t.embeddings.where(c("vec_id") == 0).select(c("embedding").alias("b"))
    a, b = c("embedding"), c("b")
    return t.embeddings.join(q).select("vec_id", *[F.round(f, 6).alias(n) for n, f in (("euclidean", X.euclidean(a, b)), ("manhattan", X.manhattan(a, b)), ("chebyshev", X.chebyshev(a, b)), ("minkowski", X.minkowski(a, b, 3)), ("cosine", X.cosine_similarity(a, b)))])


@query("stat_mahalanobis", "SELECT vec_id, round(sqrt(list_sum(list_transform(range(1, len(embedding) + 1), lambda i: (embedding[i]::DOUBLE - 0.1) ** 2 * (1 + i / 8.0))) + 2 * list_sum(list_transform(range(1, len(embedding)), lambda i: 0.25 * (embedding[i]::DOUBLE - 0.1) * (embedding[i + 1]::DOUBLE - 0.1)))), 6) AS d FROM embeddings")
def _(t):
    n = 64  # all dimensions, with a band beside the diagonal
    inverse = [[1 + (i + 1) / 8 if i == j else 0.25 if abs(i - j) == 1 else 0.0 for j in range(n)] for i in range(n)]
    return t.embeddings.select("vec_id", F.round(X.mahalanobis(c("embedding"), [0.1] * n, inverse), 6).alias("d"))


@query(
    "stat_jaccard",
    "WITH w AS (SELECT doc_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '')) AS s FROM documents), q AS (SELECT s AS b FROM w WHERE doc_id = 1) SELECT doc_id, round(len(list_intersect(s, b)) / len(list_distinct(list_concat(s, b))), 6) AS jaccard FROM w, q WHERE len(s) > 0",
)
def _(t):
    w = t.documents.select("doc_id", F.array_distinct(F.filter(F.split(F.lower("text"), "\\s+"), lambda x: x != "")).alias("s")).where(F.size("s") > 0)
    return w.join(w.where(c("doc_id") == 1).select(c("s").alias("b"))).select("doc_id", F.round(X.jaccard_sets(c("s"), c("b")), 6).alias("jaccard"))


@query("stat_fit_distribution")
def _(t):
    return P.fit(t.orders, "o_totalprice")


@query("stat_density", "SELECT event_id, round(exp(-0.5 * pow((value - 50) / 20, 2)) / (20 * sqrt(2 * pi())), 8) AS d FROM events")
def _(t):
    return t.events.select("event_id", F.round(P.density_column("normal", "value", mu=50.0, sigma=20.0), 8).alias("d"))


@query(
    "stat_jarque_bera",
    "WITH b AS (SELECT count(*) AS n, avg(o_totalprice) AS m, stddev_samp(o_totalprice) AS sd FROM orders), k AS (SELECT any_value(n) AS n, avg((o_totalprice - m) ** 3) / any_value(sd) ** 3 * sqrt(any_value(n) * (any_value(n) - 1.0)) / (any_value(n) - 2) AS s, avg((o_totalprice - m) ** 4) / any_value(sd) ** 4 - 3 AS k FROM orders, b) SELECT round(n / 6.0 * (s * s + k * k / 4), 4) AS statistic, round(exp(-n / 6.0 * (s * s + k * k / 4) / 2), 8) AS p_value FROM k",
)
def _(t):
    return H.jarque_bera(t.orders, "o_totalprice").select(F.round("statistic", 4).alias("statistic"), F.round("p_value", 8).alias("p_value"))


@query(
    "stat_kolmogorov_smirnov",
    """
    WITH v AS (SELECT value AS v, count(*) AS c FROM events GROUP BY 1), e AS (SELECT v, sum(c) OVER (ORDER BY v) AS upto, c, sum(c) OVER () AS n, (v - min(v) OVER ()) / (max(v) OVER () - min(v) OVER ()) AS f FROM v),
    d AS (SELECT max(greatest(abs(upto / n - f), abs((upto - c) / n - f))) AS d, any_value(n) AS n FROM e), z AS (SELECT d, (sqrt(n) + 0.12 + 0.11 / sqrt(n)) * d AS z FROM d)
    SELECT round(d, 8) AS statistic, round(CASE WHEN z > 0.2 THEN least(1, greatest(0, 2 * list_sum(list_transform(range(1, 101), lambda j: (CASE WHEN j % 2 = 1 THEN 1 ELSE -1 END) * exp(-2 * j * j * z * z))))) ELSE 1 END, 8)::DOUBLE AS p_value FROM z
    """,
)
def _(t):
    return rounded(H.kolmogorov_smirnov(t.events, "value", "uniform"), 8)


_EDF = f"WITH b AS (SELECT avg(value) AS m, stddev_samp(value) AS s FROM events), r AS (SELECT (value - m) / s AS z, row_number() OVER (ORDER BY value) AS i, count(*) OVER () AS n FROM events, b), e AS (SELECT i, n, least(greatest({_PHI.format('z')}, 1e-15), 1 - 1e-15) AS f FROM r)"


@query("stat_anderson_darling", f"{_EDF} SELECT round(-max(n) - sum((2 * i - 1) / n * ln(f) + (2 * (n - i) + 1) / n * ln(1 - f)), 6) AS statistic FROM e")
def _(t):
    return rounded(H.anderson_darling(t.events, "value"))


@query("stat_cramer_von_mises", f"{_EDF} SELECT round(1 / (12.0 * max(n)) + sum(((2 * i - 1) / (2.0 * n) - f) ** 2), 6) AS statistic FROM e")
def _(t):
    return rounded(H.cramer_von_mises(t.events, "value"))


@query("stat_shapiro_wilk")
def _(t):
    return H.shapiro_wilk(t.customer, "c_acctbal")


@query(
    "stat_t_test",
    "WITH g AS (SELECT avg(c_acctbal) FILTER (c_mktsegment = 'BUILDING') AS ma, avg(c_acctbal) FILTER (c_mktsegment = 'MACHINERY') AS mb, var_samp(c_acctbal) FILTER (c_mktsegment = 'BUILDING') AS va, var_samp(c_acctbal) FILTER (c_mktsegment = 'MACHINERY') AS vb, count(*) FILTER (c_mktsegment = 'BUILDING') AS na, count(*) FILTER (c_mktsegment = 'MACHINERY') AS nb FROM customer) SELECT round((ma - mb) / sqrt(va / na + vb / nb), 6) AS statistic, round((va / na + vb / nb) ** 2 / ((va / na) ** 2 / (na - 1) + (vb / nb) ** 2 / (nb - 1)), 4) AS df FROM g",
)
def _(t):
    r = H.t_test(t.customer, "c_acctbal", "c_mktsegment", "BUILDING", "MACHINERY")
    return r.select(F.round("statistic", 6).alias("statistic"), F.round("df", 4).alias("df"))


@query("stat_paired_t_test", "SELECT round(avg(l_tax - l_discount) / (stddev_samp(l_tax - l_discount) / sqrt(count(*))), 5) AS statistic, (count(*) - 1)::DOUBLE AS df FROM lineitem")
def _(t):
    return H.paired_t_test(t.lineitem, "l_tax", "l_discount").select(F.round("statistic", 5).alias("statistic"), "df")


@query("stat_f_test", "SELECT round(var_samp(o_totalprice) FILTER (o_orderstatus = 'F') / var_samp(o_totalprice) FILTER (o_orderstatus = 'O'), 6) AS statistic, (count(*) FILTER (o_orderstatus = 'F') - 1)::DOUBLE AS df1, (count(*) FILTER (o_orderstatus = 'O') - 1)::DOUBLE AS df2 FROM orders")
def _(t):
    return rounded(H.f_test(t.orders, "o_totalprice", "o_orderstatus", "F", "O"))


@query(
    "stat_chi_square",
    "WITH o AS (SELECT o_orderstatus AS a, o_orderpriority AS b, count(*) AS o FROM orders GROUP BY 1, 2), a AS (SELECT a, sum(o) AS ra FROM o GROUP BY 1), b AS (SELECT b, sum(o) AS rb FROM o GROUP BY 1), e AS (SELECT coalesce(o, 0) AS o, ra * rb / (SELECT sum(o) FROM o) AS e FROM a CROSS JOIN b LEFT JOIN o USING (a, b)) SELECT round(sum((o - e) ** 2 / e), 6) AS statistic, ((SELECT count(*) FROM a) - 1.0) * ((SELECT count(*) FROM b) - 1.0)::DOUBLE AS df FROM e",
)
def _(t):
    return H.chi_square(t.orders, "o_orderstatus", "o_orderpriority").select(F.round("statistic", 6).alias("statistic"), "df")


@query(
    "stat_anova",
    "WITH g AS (SELECT c_mktsegment, count(*) AS n, avg(c_acctbal) AS m, var_pop(c_acctbal) * count(*) AS w FROM customer GROUP BY 1), s AS (SELECT sum(n) AS n, count(*) AS k, sum(w) AS w, sum(n * m) / sum(n) AS mm FROM g) SELECT round((sum(g.n * (m - mm) ** 2) / (any_value(k) - 1)) / (any_value(s.w) / (any_value(s.n) - any_value(k))), 6) AS statistic FROM g, s",
)
def _(t):
    return H.anova(t.customer, "c_acctbal", "c_mktsegment").select(F.round("statistic", 6).alias("statistic"))


@query("stat_mann_whitney", f"WITH r AS (SELECT o_orderstatus AS g, {_RANKS.format('o_totalprice')} AS r FROM orders WHERE o_orderstatus IN ('F', 'O')) SELECT round(sum(r) FILTER (g = 'F') - count(*) FILTER (g = 'F') * (count(*) FILTER (g = 'F') + 1) / 2.0, 4) AS statistic FROM r")
def _(t):
    return H.mann_whitney(t.orders, "o_totalprice", "o_orderstatus", "F", "O").select(F.round("statistic", 4).alias("statistic"))


@query(
    "stat_kruskal_wallis",
    f"WITH r AS (SELECT p_brand AS g, {_RANKS.format('p_size')} AS r, p_size FROM part), t AS (SELECT sum(c ** 3 - c) AS t FROM (SELECT count(*) AS c FROM r GROUP BY p_size)), g AS (SELECT count(*) AS n, sum(r) AS s FROM r GROUP BY g) SELECT round((12 / (sum(n) * (sum(n) + 1)) * sum(s ** 2 / n) - 3 * (sum(n) + 1)) / (1 - (SELECT t FROM t) / (sum(n) ** 3 - sum(n))), 6) AS statistic FROM g",
)
def _(t):
    return H.kruskal_wallis(t.part, "p_size", "p_brand").select(F.round("statistic", 6).alias("statistic"))


@query(
    "stat_adf",
    "WITH d AS (SELECT event_type, value AS v, lag(value) OVER (PARTITION BY event_type ORDER BY event_id) AS l FROM events), e AS (SELECT event_type, l, v - l AS d FROM d WHERE l IS NOT NULL) SELECT event_type, count(*) AS n, round(regr_slope(d, l) / sqrt((regr_syy(d, l) - regr_slope(d, l) * regr_sxy(d, l)) / (count(*) - 2) / regr_sxx(d, l)), 4) AS statistic FROM e GROUP BY 1",
)
def _(t):
    return H.adf(t.events, "event_id", "value", ("event_type",)).select("event_type", "n", F.round("statistic", 4).alias("statistic"))


@query(
    "stat_kpss",
    """
    WITH m AS (SELECT event_type, count(*) AS n, avg(value) AS m, floor(4 * pow(count(*) / 100.0, 2 / 9.0)) AS h FROM events GROUP BY 1),
    e AS (SELECT event_type, value - m AS e, n, h, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS i FROM events JOIN m USING (event_type)),
    s AS (SELECT *, sum(e) OVER (PARTITION BY event_type ORDER BY i) AS s FROM e),
    g AS (SELECT a.event_type, sum(2 * (1 - (a.i - b.i) / (a.h + 1)) * a.e * b.e / a.n) AS g FROM e a JOIN e b ON a.event_type = b.event_type AND a.i > b.i AND a.i <= b.i + a.h GROUP BY 1),
    v AS (SELECT event_type, any_value(n) AS n, sum(s * s) AS ss, sum(e * e) / any_value(n) AS v FROM s GROUP BY 1)
    SELECT event_type, round(ss / (n * n) / (v + coalesce(g, 0)), 6) AS statistic, ss / (n * n) / (v + coalesce(g, 0)) < 0.463 AS stationary FROM v LEFT JOIN g USING (event_type)
    """,
)
def _(t):
    return rounded(H.kpss(t.events, "event_id", "value", ("event_type",)))


@query("stat_grubbs", "SELECT 'low' AS side, min(c_acctbal) AS value, round((avg(c_acctbal) - min(c_acctbal)) / stddev_samp(c_acctbal), 6) AS g FROM customer UNION ALL SELECT 'high', max(c_acctbal), round((max(c_acctbal) - avg(c_acctbal)) / stddev_samp(c_acctbal), 6) FROM customer")
def _(t):
    return H.grubbs(t.customer, "c_acctbal").select("side", "value", F.round("g", 6).alias("g"))


@query(
    "stat_dixon",
    "WITH v AS (SELECT list(n_nationkey::DOUBLE ORDER BY n_nationkey) AS v FROM nation), q AS (SELECT 'low' AS side, v[1] AS value, (v[2] - v[1]) / (v[-1] - v[1]) AS q FROM v UNION ALL SELECT 'high', v[-1], (v[-1] - v[-2]) / (v[-1] - v[1]) FROM v) SELECT side, value, round(q, 8) AS q, 0.317::DOUBLE AS critical, q > 0.317 AS outlier FROM q",
)
def _(t):
    return rounded(H.dixon(t.nation, "n_nationkey"), 8)


@query("stat_iqr_outliers", "WITH b AS (SELECT event_type, quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM events GROUP BY 1) SELECT event_id, value FROM events JOIN b USING (event_type) WHERE value < a - 0.2 * (b - a) OR value > b + 0.2 * (b - a)")
def _(t):
    return O.iqr_outliers(t.events, "value", 0.2, ("event_type",)).select("event_id", "value")


@query("stat_zscore_outliers", "WITH b AS (SELECT avg(o_totalprice) AS m, stddev_samp(o_totalprice) AS s FROM orders) SELECT o_orderkey FROM orders, b WHERE abs(o_totalprice - m) > 1.5 * s")
def _(t):
    return O.zscore_outliers(t.orders, "o_totalprice", 1.5).select("o_orderkey")


@query("stat_mad_outliers", "WITH b AS (SELECT median(o_totalprice) AS m, mad(o_totalprice) AS d FROM orders) SELECT o_orderkey FROM orders, b WHERE 0.6745 * abs(o_totalprice - m) > 1.2 * d")
def _(t):
    return O.mad_outliers(t.orders, "o_totalprice", 1.2).select("o_orderkey")


_ACF = "WITH m AS (SELECT event_type, avg(value) AS m FROM events GROUP BY 1), e AS (SELECT event_type, event_id, value - m AS e FROM events JOIN m USING (event_type)), k AS (SELECT unnest(range(1, 6)) AS lag), p AS (SELECT event_type, lag, e, e * lead(e, lag::INT) OVER (PARTITION BY event_type, lag ORDER BY event_id) AS p FROM e, k) SELECT event_type, lag::INT AS lag, round(sum(p) / sum(e * e), 6) AS acf FROM p GROUP BY 1, 2"


@query("stat_acf", _ACF)
def _(t):
    return rounded(S.acf(t.events, "event_id", "value", 5, ("event_type",)))


def _pacf_sql(lags: int) -> str:
    """Partial autocorrelations by the Durbin-Levinson recursion, a common table a lag."""
    r = ", ".join(f"(SELECT sum(a.e * b.e) FROM e a JOIN e b ON a.i = b.i + {k}) / (SELECT sum(e * e) FROM e) AS r{k}" for k in range(1, lags + 1))
    parts = ["t AS (SELECT o_orderdate::DATE AS d, sum(o_totalprice) AS v FROM orders GROUP BY 1)", "e AS (SELECT v - avg(v) OVER () AS e, row_number() OVER (ORDER BY d) AS i FROM t)", f"k0 AS (SELECT {r})", "k1 AS (SELECT *, r1 AS f1_1 FROM k0)"]
    for k in range(2, lags + 1):
        top = f"r{k}" + "".join(f" - f{k - 1}_{j} * r{k - j}" for j in range(1, k))
        below = "1" + "".join(f" - f{k - 1}_{j} * r{j}" for j in range(1, k))
        parts.append(f"p{k} AS (SELECT *, ({top}) / ({below}) AS f{k}_{k} FROM k{k - 1})")
        parts.append(f"k{k} AS (SELECT *, " + ", ".join(f"f{k - 1}_{j} - f{k}_{k} * f{k - 1}_{k - j} AS f{k}_{j}" for j in range(1, k)) + f" FROM p{k})")
    return f"WITH {', '.join(parts)} " + " UNION ALL ".join(f"SELECT {k}::INT AS lag, round(f{k}_{k}, 6) AS pacf FROM k{lags}" for k in range(1, lags + 1))


@query("stat_pacf", _pacf_sql(7))
def _(t):
    daily = t.orders.groupBy(F.to_date("o_orderdate").alias("d")).agg(F.sum("o_totalprice").alias("v"))
    return rounded(S.pacf(daily, "d", "v", 7))


@query("stat_series_complexity")
def _(t):
    monthly = t.orders.groupBy("o_orderpriority", F.trunc("o_orderdate", "month").alias("d")).agg(F.sum("o_totalprice").alias("v"))
    return rounded(S.per_series(monthly, "d", "v", ("o_orderpriority",)))


@query("stat_spectrum")
def _(t):
    daily = t.orders.groupBy("o_orderstatus", F.to_date("o_orderdate").alias("d")).agg(F.sum("o_totalprice").alias("v"))
    return rounded(S.spectrum(daily, "d", "v", ("o_orderstatus",)), 2)


@query("stat_correlation_matrix", "SELECT 'l_quantity' AS a, 'l_extendedprice' AS b, round(corr(l_quantity, l_extendedprice), 8) AS r FROM lineitem UNION ALL SELECT 'l_quantity', 'l_discount', round(corr(l_quantity, l_discount), 8) FROM lineitem UNION ALL SELECT 'l_extendedprice', 'l_discount', round(corr(l_extendedprice, l_discount), 8) FROM lineitem")
def _(t):
    return rounded(C.matrix(t.lineitem, ["l_quantity", "l_extendedprice", "l_discount"]), 8)
