"""Quality rules with a robust multivariate outlier test, in DataFrame and SQL functions only.

Documents get word statistics; a few fixed rules fail some at once. The others form groups by language and source.
Each group's location and scatter come from a minimum-covariance-determinant estimate of its transformed statistic
vectors, and a document is rejected if its robust Mahalanobis distance from its group is beyond a cutoff.

The estimate, for all groups at once and in a fixed number of passes over one narrow table:
 1. two deterministic starts: coordinate-wise medians with MAD scales, and the group's mean and covariance;
 2. concentration steps: the half of the group that is nearest under the present estimate gives the next one;
 3. the start with the smaller determinant wins; one reweighting step by the chi-square 0.975 distance.
Which half is nearest is read off a histogram of distances (buckets of 1/32 in log(1 + d2)), so no group is ever
sorted or gathered, a hot group is pre-aggregated like any other, and the half is at least half, ties included.
Statistics are rounded to 1/4096 and summed as integers: every sum is exact, hence independent of the partitioning.
The statistics are the log word length, log(1 + symbols per word), and the shares of repeated lines and words, shrunk
by LINES and WORDS: in a short text one repeated line is a large share but one event. Most documents share exact values
(no symbol, no repeated line), so the scatter is regularised: FLOOR squared, about one event in a text of usual length,
is added on its diagonal. The cutoff is a chi-square quantile.

A group under MIN_GROUP documents joins the pooled small groups of its language, these the pooled rest of all
languages; what stays under MIN_GROUP is judged by the fixed rules alone.

Defined results: null text has no words (fails by length); null language or source is a value of its own; null,
repeated or tied identifiers are judged row by row alike; extra input columns are carried only by `filter_documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import stage

#: A group needs so many documents for an estimate of its own.
MIN_GROUP = 50
#: Rounding unit of the transformed statistics.
UNIT = 4096
#: Lines and words that every text is taken to have besides its own when shares are formed.
LINES, WORDS = 5, 100
#: Regularisation in transformed units: a word length 5 % off, 2 symbols in 100 words, one repeated line in 20, six
#: repeated words in 50.
FLOOR = (0.05, 0.02, 0.04, 0.04)
#: Chi-square quantiles (4 degrees of freedom) at 0.5 and 0.975, and the scatter's consistency factors there.
HALF_FACTOR, REWEIGHT_D2, REWEIGHT_FACTOR = 2.11, 11.143, 1.106
#: Squared distance beyond which a document is rejected: the chi-square quantile at 1 - 1e-6.
CUTOFF_D2 = 33.377
STEPS = 3
#: A group's rows meet its parameters in so many parts.
SALTS = 16
DIM = 4
_PAIRS = [(i, j) for i in range(1, DIM + 1) for j in range(1, i + 1)]
_SPACE = r"[\\x20\\x09-\\x0D]+"


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", carry: bool = False) -> DataFrame:
    """id, lang, source (with carry also doc, the whole row) and the word statistics of every whole text; one narrow pass.

    Repeated windows are found by sorting the text's window hashes with their places, so a text of n words costs
    n log n whatever repeats in it.
    """
    d = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"), F.coalesce(F.col(text_col), F.lit("")).alias("t"), *([F.struct(*docs.columns).alias("doc")] if carry else []))
    more = ["doc"] if carry else []
    d = d.selectExpr(
        "id", "lang", "source", *more,
        f"filter(split(t, '{_SPACE}'), w -> w <> '') AS words",
        f"filter(split(t, '\\n'), l -> l rlike '[^\\\\x20\\\\x09-\\\\x0D]') AS lines",
        f"length(regexp_replace(t, '{_SPACE}', '')) AS word_chars",
        "length(t) - length(translate(t, '#*$%&|<>', '')) AS n_symbols",
    )
    d = d.selectExpr(
        "id", "lang", "source", *more, "word_chars", "n_symbols", "size(words) AS n_words", "size(lines) AS n_lines",
        "size(lines) - size(array_distinct(lines)) AS n_dup_lines",
        "transform(words, w -> xxhash64(w)) AS h",
    )
    d = d.withColumn("win", F.expr("IF(n_words < 3, NULL, sort_array(transform(sequence(0, n_words - 3), i -> struct(xxhash64(h[i], h[i + 1], h[i + 2]) AS h, i AS p))))")).drop("h")
    d = d.withColumn("at", F.expr("sort_array(transform(filter(sequence(0, n_words - 3), i -> (i > 0 AND win[i].h = win[i - 1].h) OR (i < n_words - 3 AND win[i].h = win[i + 1].h)), i -> win[i].p))"))
    d = d.withColumn("at", F.expr("IF(n_words < 3, NULL, at)")).drop("win")
    covered = "coalesce(aggregate(at, struct(0 AS c, -3 AS last), (a, p) -> struct(a.c + least(3, p - a.last) AS c, p AS last), a -> a.c), 0)"
    return d.select("id", "lang", "source", *more, *[F.col(c).cast("long").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines")], F.expr(covered).cast("long").alias("n_repeat_words"))


def _base_failed() -> str:
    return "n_words < 50 OR 100 * n_repeat_words > 50 * n_words"


def vectors(stats: DataFrame) -> DataFrame:
    """x1 .. x4: the transformed statistics in units of 1/UNIT; null where the text has no word."""
    tf = ["ln(word_chars / n_words)", "ln(1 + n_symbols / n_words)", f"n_dup_lines / (n_lines + {LINES})", f"n_repeat_words / (n_words + {WORDS})"]
    return stats.withColumn("base_failed", F.expr(_base_failed())).select("*", *[F.expr(f"CAST(IF(n_words = 0, NULL, round({t} * {UNIT})) AS BIGINT)").alias(f"x{i}") for i, t in enumerate(tf, 1)])


def _grouped(v: DataFrame, min_group: int) -> DataFrame:
    """The rows to estimate from and to judge, with their group g; no rule is judged where g is null."""
    key = lambda c: f"coalesce(concat(length({c}), ':', {c}), '-')"
    rows = v.withColumn("ls", F.expr(f"concat({key('lang')}, ' ', {key('source')})")).withColumn("l", F.expr(key("lang")))
    per = rows.where("NOT base_failed").groupBy("l", "ls").agg(F.count("*").alias("n"))
    small = per.where(F.col("n") < min_group).groupBy("l").agg(F.sum("n").alias("n_small"))
    per = per.join(small, "l", "left").withColumn("g", F.expr(f"CASE WHEN n >= {min_group} THEN concat('source ', ls) WHEN n_small >= {min_group} THEN concat('language ', l) ELSE 'rest' END"))
    # a row per language and source: staged, so that its size is known before the join with the rows is planned
    per = stage(per.select(F.col("ls").alias("k"), "g", "n"), "quality-keys")
    n_rest = per.where("g = 'rest'").agg(F.sum("n")).first()[0] or 0
    per = per.select("k", F.col("g") if n_rest >= min_group else F.expr("nullif(g, 'rest')").alias("g"))
    return rows.join(per, rows.ls == per.k, "left").drop("k", "ls", "l")


def _residuals() -> list[str]:
    """z1 .. z4, the deviation from the location solved by the unit lower factor."""
    z = [f"(x1 / {UNIT}D - m1)"]
    for i in range(2, DIM + 1):
        z.append("(" + f"x{i} / {UNIT}D - m{i}" + "".join(f" - l{i}{j} * z{j}" for j in range(1, i)) + ")")
    return z


def _attach(x: DataFrame, params: DataFrame) -> DataFrame:
    """x joined with its group's row or rows of params on (g, salt): a hot group is spread over SALTS tasks.

    params is staged, so that its size is known; small, it's broadcast by that size.
    """
    return x.join(params.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["g", "salt"])


def _with_d2(rows: DataFrame) -> DataFrame:
    """d2 by the LDL factors of the scatter: additions, multiplications and divisions only."""
    for i, z in enumerate(_residuals(), 1):
        rows = rows.withColumn(f"z{i}", F.expr(z))
    return rows.withColumn("d2", F.expr(" + ".join(f"z{i} * z{i} / v{i}" for i in range(1, DIM + 1)))).drop(*[f"z{i}" for i in range(1, DIM + 1)])


def _moments(rows: DataFrame, *keys: str) -> DataFrame:
    sums = [F.expr(f"sum(CAST(x{i} AS DECIMAL(19, 0)))").alias(f"s{i}") for i in range(1, DIM + 1)]
    sums += [F.expr(f"sum(CAST(x{i} * x{j} AS DECIMAL(19, 0)))").alias(f"s{i}{j}") for i, j in _PAIRS]
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), *sums)


def _factors(m: DataFrame, factor: float, *keys: str) -> DataFrame:
    """Location, LDL factors and determinant of the regularised scatter."""
    m = m.select(*keys, F.col("n").cast("double").alias("n"), *[(F.col(f"s{i}").cast("double") / F.lit(float(UNIT))).alias(f"s{i}") for i in range(1, DIM + 1)], *[(F.col(f"s{i}{j}").cast("double") / F.lit(float(UNIT * UNIT))).alias(f"s{i}{j}") for i, j in _PAIRS])
    m = m.select(*keys, "n", *[F.expr(f"s{i} / n").alias(f"m{i}") for i in range(1, DIM + 1)], *[f"s{i}{j}" for i, j in _PAIRS])
    cov = [F.expr(f"{factor}D * (s{i}{j} / n - m{i} * m{j})" + (f" + {FLOOR[i - 1]}D * {FLOOR[i - 1]}D" if i == j else "")).alias(f"k{i}{j}") for i, j in _PAIRS]
    return _ldl(m.select(*keys, *[f"m{i}" for i in range(1, DIM + 1)], *cov), *keys)


def _ldl(k: DataFrame, *keys: str) -> DataFrame:
    for j in range(1, DIM + 1):
        k = k.withColumn(f"v{j}", F.expr(f"k{j}{j}" + "".join(f" - l{j}{r} * l{j}{r} * v{r}" for r in range(1, j))))
        for i in range(j + 1, DIM + 1):
            k = k.withColumn(f"l{i}{j}", F.expr("(" + f"k{i}{j}" + "".join(f" - l{i}{r} * l{j}{r} * v{r}" for r in range(1, j)) + f") / v{j}"))
    det = " * ".join(f"v{j}" for j in range(1, DIM + 1))
    return k.select(*keys, *_params(), F.expr(det).alias("det"))


def _params() -> list[str]:
    return [f"m{i}" for i in range(1, DIM + 1)] + [f"v{i}" for i in range(1, DIM + 1)] + [f"l{i}{j}" for i, j in _PAIRS if i != j]


def _median_start(x: DataFrame) -> DataFrame:
    """Medians and MADs by histograms of width 1/64, as a diagonal scatter."""
    step = UNIT // 64
    long = x.select("g", F.posexplode(F.array(*[f"x{i}" for i in range(1, DIM + 1)])).alias("i", "x"))

    def middle(rows: DataFrame) -> DataFrame:
        h = rows.groupBy("g", "i", "b").agg(F.count("*").alias("c"))
        h = h.selectExpr("g", "i", "b", "sum(c) OVER (PARTITION BY g, i ORDER BY b) AS upto", "sum(c) OVER (PARTITION BY g, i) AS n")
        return h.where("2 * upto >= n").groupBy("g", "i").agg(F.min("b").alias("b"))

    med = stage(middle(long.selectExpr("g", "i", f"x DIV {step} AS b")).withColumnRenamed("b", "med").groupBy("g").agg(*[F.max(F.expr(f"IF(i = {i - 1}, med, NULL)")).alias(f"b{i}") for i in range(1, DIM + 1)]), "medians")
    dev = _attach(x, med).select("g", F.posexplode(F.array(*[F.expr(f"abs(x{i} DIV {step} - b{i})") for i in range(1, DIM + 1)])).alias("i", "b"))
    mad = middle(dev).groupBy("g").agg(*[F.max(F.expr(f"IF(i = {i - 1}, b, NULL)")).alias(f"a{i}") for i in range(1, DIM + 1)])
    both = med.join(mad, "g")
    both = both.select("g", *[F.expr(f"b{i} / 64D").alias(f"m{i}") for i in range(1, DIM + 1)], *[F.expr(f"(1.4826D * a{i} / 64D) * (1.4826D * a{i} / 64D) + {FLOOR[i - 1]}D * {FLOOR[i - 1]}D" if i == j else "0D").alias(f"k{i}{j}") for i, j in _PAIRS])
    return _ldl(both, "g")


def estimates(rows: DataFrame, steps: int = STEPS) -> DataFrame:
    """g, location and LDL factors of each group's reweighted MCD scatter; rows have g and x1 .. x4."""
    xs = [f"x{i}" for i in range(1, DIM + 1)]
    x = rows.where("g IS NOT NULL AND NOT base_failed").select("g", F.expr(f"CAST(pmod(xxhash64(id, word_chars, n_words, {', '.join(xs)}), {SALTS}) AS INT)").alias("salt"), *xs)
    cols = ["g", "start", *_params(), "det"]
    par = _median_start(x).withColumn("start", F.lit(1)).select(*cols).union(_factors(_moments(x, "g"), 1.0, "g").withColumn("start", F.lit(2)).select(*cols))
    par = stage(par, "mcd")
    for _ in range(steps):
        d = _with_d2(_attach(x, par)).select("g", "salt", "start", *[f"x{i}" for i in range(1, DIM + 1)], F.expr("CAST(floor(32 * ln(1 + d2)) AS INT)").alias("b"))
        h = d.groupBy("g", "start", "b").agg(F.count("*").alias("c"))
        h = h.selectExpr("g", "start", "b", "sum(c) OVER (PARTITION BY g, start ORDER BY b) AS upto", "sum(c) OVER (PARTITION BY g, start) AS n")
        near = stage(h.where(f"2 * upto >= n + {DIM + 1} OR upto = n").groupBy("g", "start").agg(F.min("b").alias("most")), "mcd-half")
        near = near.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        half = d.join(near, ["g", "salt", "start"]).where("b <= most")
        par = stage(_factors(_moments(half, "g", "start"), HALF_FACTOR, "g", "start").select(*cols), "mcd")
    best = par.selectExpr("*", "row_number() OVER (PARTITION BY g ORDER BY det, start) AS r").where("r = 1").drop("r", "start", "det")
    inner = _with_d2(_attach(x, stage(best, "mcd"))).where(f"d2 <= {REWEIGHT_D2}")
    return stage(_factors(_moments(inner, "g"), REWEIGHT_FACTOR, "g").drop("det"), "mcd")


def judge(docs: DataFrame, cutoff_d2: float = CUTOFF_D2, min_group: int = MIN_GROUP, **cols: str) -> DataFrame:
    """Every row's statistics, base_failed, d2 (null without a verdict) and kept."""
    stats = stage(vectors(statistics(docs, **cols)), "quality-stats")
    rows = stage(_grouped(stats, min_group), "quality-groups")
    return _verdict(rows, estimates(rows), cutoff_d2)


def filter_documents(docs: DataFrame, cutoff_d2: float = CUTOFF_D2, min_group: int = MIN_GROUP, **cols: str) -> DataFrame:
    """The rows of docs that are kept, with their columns as they are.

    Rows are written once beside their statistics; the estimates read the statistics alone, and the verdict joins
    the rows with tables of a row per language and source, so texts are never shuffled.
    """
    stats = stage(vectors(statistics(docs, carry=True, **cols)), "quality-rows", compression="zstd")
    est = estimates(stage(_grouped(stats.drop("doc"), min_group), "quality-groups"))
    kept = _verdict(_grouped(stats, min_group), est, cutoff_d2).where("kept")
    return kept.select(*[F.col("doc").getField(c).alias(c) for c in docs.columns])


def _verdict(rows: DataFrame, est: DataFrame, cutoff_d2: float) -> DataFrame:
    est = est.withColumnRenamed("g", "eg")
    out = _with_d2(rows.join(est, rows.g == est.eg, "left").drop("eg"))
    out = out.withColumn("d2", F.expr("IF(base_failed, NULL, d2)"))
    return out.withColumn("kept", F.expr(f"NOT base_failed AND coalesce(d2 <= {cutoff_d2}D, TRUE)"))


def report(judged: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return judged.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
