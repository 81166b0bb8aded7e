"""Models on Spark ML: training, prediction, metrics, importance, search, and a registry of saved pipelines."""

from __future__ import annotations

import json
import re
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field

from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import Imputer, MinMaxScaler, RobustScaler, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, GeneralizedLinearRegression, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

REGRESSION = {
    "REGRESSION": lambda **k: GBTRegressor(lossType="squared", **k),
    "REGRESSION_L1": lambda **k: GBTRegressor(lossType="absolute", **k),
    "MAPE": lambda **k: Reweighted("mape", **_reweighted(k)),
    "HUBER": lambda **k: LinearRegression(loss="huber", **_no_trees(k)),
    "FAIR": lambda **k: Reweighted("fair", **_reweighted(k)),
    "QUANTILE": lambda **k: Reweighted("quantile", **_reweighted(k)),
    "POISSON": lambda **k: GeneralizedLinearRegression(family="poisson", **_no_trees(k)),
    "GAMMA": lambda **k: GeneralizedLinearRegression(family="gamma", link="log", **_no_trees(k)),
    "TWEEDIE": lambda **k: GeneralizedLinearRegression(family="tweedie", variancePower=1.5, linkPower=0.0, **_no_trees(k)),
    "RANDOM_FOREST": lambda **k: RandomForestRegressor(**_no_iter(k)),
    "LINEAR": lambda **k: LinearRegression(**_no_trees(k)),
}
CLASSIFICATION = {
    "BINARY": lambda **k: GBTClassifier(**k),
    "CROSS_ENTROPY": lambda **k: LogisticRegression(**_no_trees(k)),
    "MULTICLASS": lambda **k: RandomForestClassifier(**_no_iter(k)),
    "MULTICLASS_OVA": lambda **k: LogisticRegression(**_no_trees(k)),
    "LIGHTGBM": lambda **k: GBTClassifier(**k),
}


#: rows of a partition that a model is trained on
ROWS = 250_000


def spread(df: DataFrame, rows: int) -> DataFrame:
    """df, of that many rows, in partitions of ROWS at most or so: a training task keeps its partition in memory and
    reads it in every round, and a file's splits or row groups may be any size. Smaller tables stay as they are."""
    if rows <= ROWS:
        return df
    return df.repartition(max(-(-rows // ROWS), df.sparkSession.sparkContext.defaultParallelism))


class Reweighted(Estimator):
    """A linear model of a loss that Spark has none for, by iteratively reweighted least squares.

    quantile: tau * r above the fit, (1 - tau) * -r below; mape: |r| / |y|; fair: c^2 (|r| / c - log(1 + |r| / c)).
    Every step is one weighted regression over all rows; the fitted stage is Spark's own linear model.
    """

    def __init__(self, loss: str, labelCol: str, featuresCol: str, maxIter: int = 20, alpha: float = 0.9):
        super().__init__()
        self.loss, self.label, self.features, self.steps, self.alpha = loss, labelCol, featuresCol, maxIter, alpha

    def _fit(self, dataset: DataFrame):
        y, spread = F.col(self.label), dataset.agg(F.stddev_pop(self.label)).first()[0] or 1.0
        small = F.lit(1e-6 * spread)
        plain = {"labelCol": self.label, "featuresCol": self.features, "solver": "normal"}
        model = LinearRegression(**plain).fit(dataset)
        for _ in range(self.steps):
            r = y - F.col("__fit")
            if self.loss == "quantile":
                weight = F.when(r >= 0, self.alpha).otherwise(1 - self.alpha) / F.greatest(F.abs(r), small)
            elif self.loss == "mape":
                weight = 1 / (F.greatest(F.abs(r), small) * F.greatest(F.abs(y), F.lit(1e-10)))
            else:
                weight = 1 / (1 + F.abs(r) / spread)
            scored = model.setPredictionCol("__fit").transform(dataset).withColumn("__weight", weight)
            step = LinearRegression(weightCol="__weight", **plain).fit(scored)
            moved = max([abs(a - b) for a, b in zip(step.coefficients, model.coefficients)] + [abs(step.intercept - model.intercept)])
            model = step
            if moved <= 1e-9 * spread:
                break
        return model.setPredictionCol("prediction")


def _reweighted(k: dict) -> dict:
    return {a: b for a, b in k.items() if a in ("labelCol", "featuresCol", "maxIter", "alpha")}


def _no_trees(k: dict) -> dict:
    return {a: b for a, b in k.items() if a not in ("maxDepth", "seed", "stepSize", "alpha")}


def _no_iter(k: dict) -> dict:
    return {a: b for a, b in k.items() if a not in ("maxIter", "stepSize")} | ({"numTrees": k["maxIter"]} if "maxIter" in k else {})


@dataclass
class Card:
    """What the registry keeps beside a saved pipeline."""

    name: str
    algorithm: str
    kind: str  # regression | binary | multiclass | clustering
    features: list[str]
    target: str | None
    labels: list[str] = field(default_factory=list)
    metrics: dict[str, float] = field(default_factory=dict)


@dataclass
class Model:
    card: Card
    pipeline: PipelineModel


def check_options(algorithm: str, features: Sequence[str], target: str | None, train_share: float = 0.8, iterations: int = 20) -> None:
    if not features:
        raise ValueError("a model needs features")
    if algorithm.upper() not in REGRESSION | CLASSIFICATION and algorithm.upper() != "KMEANS":
        raise ValueError(f"unknown algorithm {algorithm}")
    if not 0 < train_share < 1:
        raise ValueError("the split is between 0 and 1")
    if not 1 <= iterations <= 10_000:
        raise ValueError("1 to 10000 iterations")
    if target in features:
        raise ValueError("the target is no feature")


def _features(df: DataFrame, features: Sequence[str]) -> tuple[list, list[str]]:
    """Stages that turn columns into numbers: text by frequency order, missing numbers by their mean."""
    stages, ready, numbers = [], [], []
    for f in features:
        if isinstance(df.schema[f].dataType, T.StringType):
            stages.append(StringIndexer(inputCol=f, outputCol=f"__{f}", handleInvalid="keep", stringOrderType="frequencyDesc"))
            ready.append(f"__{f}")
        elif isinstance(df.schema[f].dataType, T.NumericType | T.BooleanType):
            numbers.append(f)
        else:
            raise ValueError(f"{f} isn't a number, a truth value or text")
    if numbers:
        stages.append(Imputer(inputCols=numbers, outputCols=[f"__{f}" for f in numbers], strategy="mean"))
        ready += [f"__{f}" for f in numbers]
    return stages, ready


def _numeric(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return df.select("*", *[]) if not any(isinstance(df.schema[f].dataType, T.BooleanType | T.LongType | T.IntegerType | T.DecimalType) for f in features) else df.withColumns({f: F.col(f).cast("double") for f in features if not isinstance(df.schema[f].dataType, T.StringType)})


def train(df: DataFrame, name: str, features: Sequence[str], target: str | None, algorithm: str = "LIGHTGBM", iterations: int = 20, depth: int = 5, rate: float = 0.1, seed: int = 1, test_share: float = 0.2, where: Column | None = None, clusters: int = 4, alpha: float = 0.9) -> Model:
    """Fit a pipeline and measure it on a held-out share; binary iff all labels are 0 or 1."""
    algorithm = algorithm.upper()
    check_options(algorithm, features, target, 1 - test_share, iterations)
    d = df if where is None else df.filter(where)
    d = _numeric(d, features)
    stages, ready = _features(d, features)
    stages.append(VectorAssembler(inputCols=ready, outputCol="__features", handleInvalid="keep"))
    if algorithm == "KMEANS":
        stages += [StandardScaler(inputCol="__features", outputCol="__scaled"), KMeans(k=clusters, seed=seed, featuresCol="__scaled", predictionCol="prediction")]
        return Model(Card(name, algorithm, "clustering", list(features), None), Pipeline(stages=stages).fit(d))
    check = d.agg(F.count("*").alias("n"), F.count(target).alias("k"), F.countDistinct(target).alias("u"), F.every(F.col(target).isNull() | F.col(target).cast("string").isin("0", "1", "0.0", "1.0", "true", "false")).alias("binary")).first()
    if check.n < 10:
        raise ValueError("training takes 10 rows or more")
    if check.k < 0.5 * check.n:
        raise ValueError("more than half of the target is missing")
    d = d.where(F.col(target).isNotNull())
    text = isinstance(df.schema[target].dataType, T.StringType)
    kind = "binary" if check.binary and algorithm not in REGRESSION else "regression" if algorithm in REGRESSION or algorithm == "LIGHTGBM" and not text and check.u > 20 else "multiclass"
    common = {"labelCol": "__label", "featuresCol": "__features", "maxIter": iterations, "maxDepth": depth, "seed": seed}
    labels: list[str] = []
    if kind == "regression":
        d = d.withColumn("__label", F.col(target).cast("double"))
        make = REGRESSION.get(algorithm, REGRESSION["REGRESSION"])
    elif kind == "binary" and not text:
        d = d.withColumn("__label", F.col(target).cast("double"))
        make = CLASSIFICATION[algorithm if algorithm not in ("MULTICLASS", "MULTICLASS_OVA") else "BINARY"]
    else:
        index = StringIndexer(inputCol=target, outputCol="__label", stringOrderType="alphabetAsc").fit(d)
        d, labels = index.transform(d), list(index.labels)
        make = CLASSIFICATION["MULTICLASS" if algorithm in ("LIGHTGBM", "BINARY") else algorithm]
    if make in (CLASSIFICATION["BINARY"], REGRESSION["REGRESSION"], CLASSIFICATION["LIGHTGBM"]):
        common["stepSize"] = rate
    if algorithm == "QUANTILE":
        common["alpha"] = alpha
    fit, held = d.randomSplit([1 - test_share, test_share], seed=seed)
    ready = Pipeline(stages=stages).fit(fit)
    learned = make(**common).fit(spread(ready.transform(fit).select("__features", "__label"), check.k))
    pipeline = PipelineModel([*ready.stages, learned])
    model = Model(Card(name, algorithm, kind, list(features), target, labels), pipeline)
    scored = pipeline.transform(held)
    model.card.metrics = regression_metrics(scored, "__label", "prediction").first().asDict() if kind == "regression" else classification_metrics(scored, "__label", "prediction").first().asDict()
    return model


def predict(model: Model, df: DataFrame, where: Column | None = None, limit: int | None = None) -> DataFrame:
    """The rows with prediction; for classes also probability and confidence (binary: 2 |p - 0.5|)."""
    if limit is not None and limit > 1_000_000:
        raise ValueError("a limit of 1000000 at most")
    d = df if where is None else df.filter(where)
    out = model.pipeline.transform(_numeric(d, model.card.features))
    keep = [F.col(c) for c in df.columns]
    if model.card.kind in ("binary", "multiclass"):
        p = vector_to_array("probability")
        if model.card.kind == "binary" and not model.card.labels:
            keep += [F.when(p[1] > 0.5, 1.0).otherwise(0.0).alias("prediction"), p[1].alias("probability"), (2 * F.abs(p[1] - 0.5)).alias("confidence")]
        else:
            names = F.array(*[F.lit(x) for x in model.card.labels])
            keep += [F.element_at(names, (F.col("prediction") + 1).cast("int")).alias("prediction"), F.array_max(p).alias("probability"), F.array_max(p).alias("confidence")]
    else:
        keep.append(F.col("prediction"))
    out = out.select(*keep)
    return out if limit is None else out.limit(limit)


def classification_metrics(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """Accuracy, and precision, recall and F1 (macro over the classes; of class 1 where the labels are 0 and 1)."""
    c = df.groupBy(F.col(label).alias("l"), F.col(prediction).alias("p")).agg(F.count("*").alias("n"))
    total = c.agg(F.sum("n").alias("t"), F.sum(F.when(F.col("l") == F.col("p"), F.col("n")).otherwise(0)).alias("ok"))
    side = lambda k: c.groupBy(F.col(k).alias("c")).agg(F.sum("n").alias(f"n_{k}"), F.sum(F.when(F.col("l") == F.col("p"), F.col("n")).otherwise(0)).alias(f"tp_{k}"))
    per = side("l").join(side("p"), "c", "full").na.fill(0)
    prec, rec = (F.coalesce(F.col(f"tp_{k}") / F.nullif(F.col(f"n_{k}"), F.lit(0)), F.lit(0.0)) for k in ("p", "l"))
    per = per.select("c", prec.alias("p"), rec.alias("r"))
    f1 = F.coalesce(2 * F.col("p") * F.col("r") / F.nullif(F.col("p") + F.col("r"), F.lit(0.0)), F.lit(0.0))
    positive = F.max(F.col("c").cast("double")) <= 1
    one = lambda x: F.when(positive, F.max(F.when(F.col("c").cast("double") == 1, x))).otherwise(F.avg(x))
    agg = per.agg(*[F.coalesce(one(x), F.lit(0.0)).alias(n) for n, x in (("precision", F.col("p")), ("recall", F.col("r")), ("f1", f1))])
    return total.select((F.col("ok") / F.greatest(F.col("t"), F.lit(1))).alias("accuracy")).join(agg)


def regression_metrics(df: DataFrame, label: str, prediction: str) -> DataFrame:
    y, p = F.col(label).cast("double"), F.col(prediction).cast("double")
    e = y - p
    return df.agg(F.avg(F.abs(e)).alias("mae"), F.avg(e * e).alias("mse"), F.sqrt(F.avg(e * e)).alias("rmse"), F.coalesce(1 - F.avg(e * e) / F.nullif(F.var_pop(y), F.lit(0.0)), F.lit(0.0)).alias("r2"), F.avg(F.when(F.abs(y) > 1e-10, F.abs(e / F.nullif(y, F.lit(0.0))))).alias("mape"))


def importance(model: Model, spark: SparkSession) -> DataFrame:
    """feature, importance: trees' own, or absolute coefficients; for others nothing."""
    last = model.pipeline.stages[-1]
    values = last.featureImportances.toArray() if hasattr(last, "featureImportances") else abs(last.coefficients.toArray()) if hasattr(last, "coefficients") else []
    order = next(s for s in model.pipeline.stages if isinstance(s, VectorAssembler)).getInputCols()
    rows = [(c[2:] if c.startswith("__") else c, float(v)) for c, v in zip(order, values)]
    return spark.createDataFrame(sorted(rows, key=lambda r: (-r[1], r[0])), "feature string, importance double")


def explain(model: Model, df: DataFrame, key: str, top: int = 3) -> DataFrame:
    """key, feature, effect: how the prediction moves when a feature is set to its mean, largest first."""
    feats = [f for f in model.card.features if not isinstance(df.schema[f].dataType, T.StringType)]
    d = _numeric(df, feats)
    means = d.agg(*[F.avg(f).alias(f) for f in feats]).first()
    score = lambda x: vector_to_array("probability")[1] if model.card.kind == "binary" else F.col("prediction").cast("double")
    base = model.pipeline.transform(d).select(F.col(key).alias("k"), score(0).alias("b"))
    out = None
    for f in feats:
        one = model.pipeline.transform(d.withColumn(f, F.lit(float(means[f])))).select(F.col(key).alias("k"), F.lit(f).alias("feature"), score(0).alias("s"))
        out = one if out is None else out.union(one)
    from pyspark.sql import Window

    e = out.join(base, "k").select(F.col("k").alias(key), "feature", (F.col("b") - F.col("s")).alias("effect"))
    w = Window.partitionBy(key).orderBy(F.desc(F.abs("effect")), "feature")
    return e.withColumn("r", F.row_number().over(w)).where(F.col("r") <= top).drop("r")


def explained(model: Model, df: DataFrame, out: str, top: int = 3) -> DataFrame:
    """df with an array of (feature, effect): how the prediction moves when a feature is set to its mean, largest first.

    The rows pass once through the model as they are and once with each numeric feature at its mean; nothing is joined.
    """
    feats = [f for f in model.card.features if isinstance(df.schema[f].dataType, T.NumericType | T.BooleanType)]
    if not feats:
        return df.withColumn(out, F.array().cast("array<struct<feature:string,effect:double>>"))
    means = df.agg(*[F.avg(F.col(f).cast("double")).alias(f) for f in feats]).first()
    score = vector_to_array("probability")[1] if model.card.kind == "binary" else F.col("prediction").cast("double")
    kept = [F.col(f"__in.{c}").alias(c) for c in df.columns]
    d = df.select(F.struct(*df.columns).alias("__in"))

    def pass_through(d: DataFrame, name: str, change: dict) -> DataFrame:
        done = [c for c in d.columns if c != "__in"]
        rows = d.select("__in", *done, *[change.get(f, F.col(f"__in.{f}").cast("double") if f in feats else F.col(f"__in.{f}")).alias(f) for f in model.card.features])
        return model.pipeline.transform(rows).select("__in", *done, score.alias(name))

    d = pass_through(d, "__base", {})
    for i, f in enumerate(feats):
        d = pass_through(d, f"__s{i}", {f: F.lit(float(means[f] or 0.0))})
    effects = F.array(*[F.struct((-F.abs(F.col("__base") - F.col(f"__s{i}"))).alias("o"), F.lit(f).alias("feature"), (F.col("__base") - F.col(f"__s{i}")).alias("effect")) for i, f in enumerate(feats)])
    return d.select(*kept, F.transform(F.slice(F.sort_array(effects), 1, top), lambda x: F.struct(x["feature"].alias("feature"), x["effect"].alias("effect"))).alias(out))


def drift(scored: DataFrame, probability: str, order: str, recent: int = 1000) -> DataFrame:
    """1 - mean confidence over the most recent scored rows (a window of the report)."""
    return scored.orderBy(F.desc(order)).limit(recent).agg(F.count("*").alias("n"), F.avg(1 - 2 * F.abs(F.col(probability) - 0.5)).alias("drift"))


def scale(df: DataFrame, columns: Sequence[str], kind: str = "standard") -> DataFrame:
    """Columns scaled in place: standard (population deviation), minmax, robust (median and IQR)."""
    if kind == "standard":
        s = df.agg(*[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"s_{c}") for c in columns])
    elif kind == "minmax":
        s = df.agg(*[F.min(c).alias(f"m_{c}") for c in columns], *[(F.max(c) - F.min(c)).alias(f"s_{c}") for c in columns])
    elif kind == "robust":
        from sparkloom.operators.profile import counted, quantiles

        found = {r.column: r for r in quantiles(counted(df, list(columns)), {"low": 0.25, "mid": 0.5, "high": 0.75}).collect()}  # a row a column
        middle = {c: (found[c].mid, found[c].high - found[c].low) if c in found else (0.0, 0.0) for c in columns}
        s = df.sparkSession.range(1).select(*[F.lit(float(v)).alias(f"{n}_{c}") for c, ms in middle.items() for n, v in zip("ms", ms)])
    else:
        raise ValueError(f"unknown scaling {kind}")
    return df.join(s).select(*[F.coalesce((F.col(c) - F.col(f"m_{c}")) / F.nullif(F.col(f"s_{c}").cast("double"), F.lit(0.0)), F.lit(0.0)).alias(c) if c in columns else F.col(c) for c in df.columns])


def scaler(kind: str, source: str, out: str):
    """The Spark ML stage of a scaling, for pipelines."""
    return {"standard": lambda: StandardScaler(inputCol=source, outputCol=out, withMean=True), "minmax": lambda: MinMaxScaler(inputCol=source, outputCol=out), "robust": lambda: RobustScaler(inputCol=source, outputCol=out, withCentering=True)}[kind]()


def discover_schema(df: DataFrame, target: str | None = None) -> DataFrame:
    """column, type, transform: what a model of this table would do with each column."""
    from sparkloom.operators.profile import detect_types, numeric_columns

    numbers = numeric_columns(df)
    skew = df.agg(*[F.skewness(c).alias(c) for c in numbers]).first().asDict() if numbers else {}
    t = F.col("type")
    heavy = F.col("column").isin([c for c in numbers if abs(skew[c] or 0) > 1] or [""])
    kind = F.when(F.col("column") == F.lit(target or ""), "target").when(F.col("distinct") <= 1, "drop").when(t == "categorical", "index").when((t == "string") & (F.col("distinct") == F.col("n")), "drop").when(t == "string", "hash").when(t == "datetime", "calendar").when(t == "boolean", "binary").when(heavy, "log").otherwise("standardize")
    return detect_types(df).select("column", "type", "distinct", kind.alias("transform"))


def schema_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """column, change: added, removed or retyped between two tables."""
    a, b = dict(old.dtypes), dict(new.dtypes)
    rows = [(c, "added") for c in b if c not in a] + [(c, "removed") for c in a if c not in b] + [(c, f"{a[c]} to {b[c]}") for c in a if c in b and a[c] != b[c]]
    return old.sparkSession.createDataFrame(rows, "column string, change string")


def sample(df: DataFrame, ratio: float, by: str | None = None, seed: int = 1) -> DataFrame:
    """Random or stratified sample; which rows depends on their content alone."""
    h = F.pmod(F.xxhash64(*df.columns, F.lit(seed)), F.lit(1_000_000)) < int(ratio * 1_000_000)
    if by is None:
        return df.filter(h)
    from sparkloom.plans.ordering import running

    # places by ranges of hash within each stratum: a hot stratum is spread like any other rows
    d = df.withColumn("__h", F.xxhash64(*df.columns, F.lit(seed)))
    return running(d, ["__h", *df.columns], before="__b", total="__t", keys=(by,)).where(F.col("__b") < F.ceil(F.col("__t") * ratio)).drop("__h", "__b", "__t")


def select_features(df: DataFrame, features: Sequence[str], target: str | None = None, method: str = "variance", threshold: float = 0.0, top: int | None = None) -> DataFrame:
    """feature, score of those that pass: variance above the threshold, or |correlation| with the target."""
    from sparkloom.functions.aggregates import corr

    score = {"variance": lambda f: F.var_samp(f), "correlation": lambda f: F.abs(corr(F.col(f), F.col(target)))}[method]
    one = df.agg(*[score(f).alias(f) for f in features])
    rows = one.select(F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("score")) for f in features])).alias("r")).select("r.*")
    out = rows.where(F.col("score") > threshold).orderBy(F.desc("score"), "feature")
    return out if top is None else out.limit(top)


def search(df: DataFrame, features: Sequence[str], target: str, grid: dict[str, Sequence], folds: int = 3, seed: int = 1, draws: int | None = None) -> DataFrame:
    """Grid search (or `draws` random points of it) of boosted trees by k-fold RMSE: a row per point, best first."""
    import itertools
    import random

    from pyspark.ml.evaluation import RegressionEvaluator
    from pyspark.ml.tuning import CrossValidator

    points = [dict(zip(grid, v)) for v in itertools.product(*grid.values())]
    if draws is not None:
        points = random.Random(seed).sample(points, min(draws, len(points)))
    d = _numeric(df.na.drop(subset=[*features, target]), features)
    d = VectorAssembler(inputCols=list(features), outputCol="__f").transform(d).select("__f", target)
    d = spread(d, d.count())
    est = GBTRegressor(labelCol=target, featuresCol="__f", seed=seed)
    maps = [{est.getParam(k): v for k, v in p.items()} for p in points]
    cv = CrossValidator(estimator=est, estimatorParamMaps=maps, evaluator=RegressionEvaluator(labelCol=target), numFolds=folds, seed=seed, parallelism=2).fit(d)
    rows = sorted(((json.dumps(p, sort_keys=True), float(m)) for p, m in zip(points, cv.avgMetrics)), key=lambda r: (r[1], r[0]))
    return df.sparkSession.createDataFrame(rows, "parameters string, rmse double")


class Registry:
    """Saved pipelines with JSON cards under one folder (any file system that Spark writes to)."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _dir(self, name: str) -> str:
        if not re.fullmatch(r"\w+", name):
            raise ValueError(f"bad model name {name!r}")
        return f"{self.path}/{name}"

    def _fs(self, path: str):
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def save(self, model: Model, replace: bool = False) -> None:
        d = self._dir(model.card.name)
        if self.exists(model.card.name):
            if not replace:
                raise ValueError(f"model {model.card.name} exists")
            self.drop(model.card.name)
        model.pipeline.write().overwrite().save(f"{d}/pipeline")
        self.spark.createDataFrame([(json.dumps(asdict(model.card)),)], "value string").coalesce(1).write.mode("overwrite").text(f"{d}/card")

    def exists(self, name: str) -> bool:
        fs, p = self._fs(f"{self._dir(name)}/card")
        return fs.exists(p)

    def load(self, name: str) -> Model:
        if not self.exists(name):
            raise ValueError(f"no model {name}")
        d = self._dir(name)
        return Model(Card(**json.loads(self.spark.read.text(f"{d}/card").first().value)), PipelineModel.load(f"{d}/pipeline"))

    def drop(self, name: str, if_exists: bool = False) -> None:
        if not self.exists(name) and not if_exists:
            raise ValueError(f"no model {name}")
        fs, p = self._fs(self._dir(name))
        fs.delete(p, True)

    def names(self) -> list[str]:
        fs, p = self._fs(self.path)
        names = sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []
        return [n for n in names if self.exists(n)]

    def models(self) -> DataFrame:
        """name, algorithm, kind, target, features, metrics."""
        cards = [self.load(n).card for n in self.names()]
        rows = [(c.name, c.algorithm, c.kind, c.target, ",".join(c.features), json.dumps(c.metrics)) for c in cards]
        return self.spark.createDataFrame(rows, "name string, algorithm string, kind string, target string, features string, metrics string")
