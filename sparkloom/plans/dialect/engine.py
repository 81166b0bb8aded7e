"""Runs statements of the dialect against a catalog and the session's views; every result is a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators import forecast as Y
from sparkloom.operators import ml as M
from sparkloom.operators import plotdata as P
from sparkloom.operators import profile as A
from sparkloom.operators import simulate as S
from sparkloom.operators import tsprep as Z
from sparkloom.operators.anomaly import detect
from sparkloom.plans.dialect.lexer import DialectError
from sparkloom.plans.dialect.parser import Parser
from sparkloom.plans.shipping import ship
from sparkloom.sources.catalog import Catalog
from sparkloom.streaming.streams import realtime_plot
from sparkloom.types import ColumnDef


class Engine:
    def __init__(self, spark: SparkSession, root: str):
        ship(spark)
        self.spark, self.catalog = spark, Catalog(spark, f"{root}/tables")
        self.models = M.Registry(spark, f"{root}/models")
        self.views: dict[str, DataFrame] = {}
        self.pipelines: dict[str, list[str]] = {}

    def register(self, name: str, df: DataFrame) -> None:
        """Make a DataFrame readable by name; a catalog table of the name is hidden by it."""
        self.views[name] = df

    def register_function(self, name: str, function, returns: str) -> None:
        """A Python function over pandas Series, callable in SELECT by its name."""
        self.spark.udf.register(name.lower(), F.pandas_udf(function, returns))

    def relation(self, name: str) -> DataFrame:
        return self.views[name] if name in self.views else self.catalog.table(name)

    def _say(self, text: str, n: int | None = None) -> DataFrame:
        return self.spark.createDataFrame([(text, n)], "status string, rows long")

    def query(self, sql: str, models: dict[str, set[str]] | None = None) -> DataFrame:
        """Spark SQL text over the known relations, each bound under its own name.

        A relation with all features of a model that the query's AI functions use is scored once; the functions read
        the score columns, so a model in SELECT costs one vectorised pass and not a call per row.
        """
        known = dict.fromkeys([*self.catalog.table_names(), *self.views])
        for n in known:
            if f"`{n}`" in sql:
                df = self.relation(n)
                for m, wanted in sorted((models or {}).items()):
                    df = self._scored(df, m, wanted)
                df.createOrReplaceTempView(n)
        return self.spark.sql(sql)

    def _scored(self, df: DataFrame, name: str, wanted: set[str]) -> DataFrame:
        """df with what the query's functions read of a model; unchanged if it lacks the model's features.

        anomaly is the z-score detector's score over the model's features, residual the target less its prediction,
        explanation the three features whose mean would move the prediction most.
        """
        m = self.models.load(name)
        if not set(m.card.features) <= set(df.columns):
            return df
        out = df
        if wanted & {"prediction", "probability", "confidence", "residual"}:
            columns = {c: f"__own_{c}" for c in ("prediction", "probability", "confidence") if c in df.columns}
            out = M.predict(m, df.withColumnsRenamed(columns))
            out = out.withColumnsRenamed({c: f"__ai_{name}_{c}" for c in ("prediction", "probability", "confidence") if c in out.columns} | {v: k for k, v in columns.items()})
            if "residual" in wanted and m.card.target in df.columns:
                out = out.withColumn(f"__ai_{name}_residual", F.col(m.card.target).cast("double") - F.col(f"__ai_{name}_prediction"))
        if "anomaly" in wanted:
            numbers = [f for f in m.card.features if f in A.numeric_columns(df)]
            columns = {c: f"__own_{c}" for c in ("score", "anomaly") if c in out.columns}
            out = detect(out.withColumnsRenamed(columns), numbers, "zscore").drop("anomaly").withColumnRenamed("score", f"__ai_{name}_anomaly").withColumnsRenamed({v: k for k, v in columns.items()})
        if "explanation" in wanted:
            out = M.explained(m, out, f"__ai_{name}_explanation")
        return out

    def _known(self) -> set[str]:
        return set(self.models.names())

    def run_batch(self, text: str, workers: int = 4) -> list[DataFrame]:
        """BEGIN BATCH s; s; ... END BATCH: the statements as concurrent Spark jobs, results in order."""
        from concurrent.futures import ThreadPoolExecutor

        p = Parser(text)
        p.need("BEGIN", "BATCH")
        parts, start = [], p.now.at
        while not p.at("END", "BATCH"):
            if p.now.kind == "end":
                raise DialectError("BEGIN BATCH without END BATCH")
            t = p.next()
            if t.text == ";":
                parts.append(text[start : t.at])
                start = t.at + 1
        parts.append(text[start : p.now.at])
        with ThreadPoolExecutor(workers) as pool:
            return list(pool.map(self.run, [x for x in parts if x.strip()]))

    def _create_pipeline(self, p: Parser) -> DataFrame:
        """CREATE PIPELINE n AS ('statement', 'statement', ...)."""
        n = p.ident()
        p.need("AS", "(")
        steps = p.list(p.string)
        p.need(")")
        self.pipelines[n] = steps
        return self._say(f"pipeline {n} created", len(steps))

    def _run_pipeline(self, p: Parser) -> DataFrame:
        n = p.ident()
        if n not in self.pipelines:
            raise DialectError(f"no pipeline {n}")
        out = None
        for s in self.pipelines[n]:
            out = self.run(s)
        return out

    def run(self, text: str) -> DataFrame:
        p = Parser(text, self._known())
        for words, f in self._statements():
            if p.at(*words):
                for _ in words:
                    p.next()
                out = f(p)
                p.end()
                return out
        if p.at("SELECT") or p.at("WITH") or p.at("("):
            sql = p.select()
            p.end()
            return self.query(sql, p.models)
        raise DialectError(f"unknown statement {p.now.text!r}")

    def _statements(self):
        return (
            (("CREATE", "DATABASE"), self._create_database), (("USE",), self._use), (("SHOW", "DATABASES"), lambda p: self.catalog.databases()), (("SHOW", "TABLES"), lambda p: self.catalog.tables()),
            (("SHOW", "TABLE", "STRUCTURE"), lambda p: self.catalog.structure(p.ident())), (("SHOW", "TABLE", "STATS"), lambda p: self.catalog.stats(p.ident())), (("SHOW", "DATABASE", "STRUCTURE"), self._database_structure), (("SHOW", "DATABASE", "STATS"), self._database_stats),
            (("BEGIN",), self._begin), (("COMMIT",), self._commit), (("ROLLBACK",), self._rollback),
            (("SHOW", "MODELS"), lambda p: self.models.models()), (("SHOW_MODELS",), lambda p: self.models.models()), (("CREATE", "OR", "REPLACE", "MODEL"), lambda p: self._create_model(p, True)), (("CREATE", "MODEL"), self._create_model),
            (("CREATE_MODEL",), self._create_model), (("CREATE", "TABLE"), self._create_table), (("DROP", "TABLE"), self._drop_table), (("DROP", "MODEL"), self._drop_model), (("ALTER", "TABLE"), self._alter), (("INSERT", "INTO"), self._insert),
            (("BULK", "INSERT", "INTO"), self._insert), (("BULK", "UPDATE"), self._bulk_update), (("BULK", "DELETE", "FROM"), self._bulk_delete), (("UPDATE",), self._update), (("DELETE", "FROM"), self._delete), (("LOAD", "DATA"), self._load),
            (("ANALYZE", "DATA"), self._analyze), (("PREPARE", "TIME", "SERIES"), self._prepare), (("DETECT", "SEASONALITY", "IN"), self._seasonality), (("FORECAST", "USING"), self._forecast), (("TRAIN", "MODEL"), self._train),
            (("PREDICT", "USING"), self._predict), (("SIMULATE", "MARKET"), self._simulate), (("SIMULATE",), self._simulate), (("PLOT",), self._plot), (("CREATE", "PIPELINE"), self._create_pipeline), (("RUN", "PIPELINE"), self._run_pipeline), (("MODEL", "METRICS"), self._metrics), (("EXPLAIN", "MODEL"), self._explain), (("DETECT", "ANOMALY", "IN"), self._anomaly), (("DESCRIBE", "MODEL"), self._describe), (("FEATURE", "IMPORTANCE"), lambda p: M.importance(self.models.load(p.ident()), self.spark)),
        )

    # --- tables ---

    def _create_database(self, p: Parser) -> DataFrame:
        self.catalog.create_database(n := p.ident())
        return self._say(f"database {n} created")

    def _use(self, p: Parser) -> DataFrame:
        self.catalog.use(n := p.ident())
        return self._say(f"using {n}")

    def _begin(self, p: Parser) -> DataFrame:
        p.take("TRANSACTION")
        self.catalog.begin()
        return self._say("transaction open")

    def _commit(self, p: Parser) -> DataFrame:
        p.take("TRANSACTION")
        self.catalog.commit()
        return self._say("transaction committed")

    def _rollback(self, p: Parser) -> DataFrame:
        p.take("TRANSACTION")
        self.catalog.rollback()
        return self._say("transaction rolled back")

    def _database_stats(self, p: Parser) -> DataFrame:
        if p.now.kind == "name":
            self.catalog.use(p.ident())
        return self.catalog.database_stats()

    def _database_structure(self, p: Parser) -> DataFrame:
        if p.now.kind == "name":
            self.catalog.use(p.ident())
        return self.catalog.database_structure()

    def _column(self, p: Parser) -> ColumnDef:
        c = ColumnDef(p.ident(), p.ident())
        if p.take("("):
            p.number()
            p.need(")")
        while True:
            if p.take("PRIMARY_KEY") or p.take("PRIMARY", "KEY"):
                c.primary_key = True
            elif p.take("NOT_NULL") or p.take("NOT", "NULL"):
                c.not_null = True
            elif p.take("UNIQUE"):
                c.unique = True
            elif p.take("AUTO_INCREAMENT") or p.take("AUTO_INCREMENT"):
                c.auto_increment = True
            elif p.take("GENERATE_DATE_TIME"):
                c.generate = "datetime"
            elif p.take("GENERATE_DATE"):
                c.generate = "date"
            elif p.take("GENERATE_UUID"):
                c.generate = "uuid"
            elif p.take("DEFAULT"):
                c.default = p.value()
            elif p.take("CHECK"):
                p.need("(")
                c.check = p.expr()
                p.need(")")
            else:
                return c

    def _create_table(self, p: Parser) -> DataFrame:
        n = p.ident()
        if p.take("AS"):
            self.catalog.create_table_as(n, self.query(p.select()))
            return self._say(f"table {n} created")
        p.need("(")
        cols = [self._column(p)]
        while p.take(","):
            cols.append(self._column(p))
        p.need(")")
        self.catalog.create_table(n, cols)
        return self._say(f"table {n} created")

    def _drop_table(self, p: Parser) -> DataFrame:
        self.catalog.drop_table(n := p.ident())
        return self._say(f"table {n} dropped")

    def _alter(self, p: Parser) -> DataFrame:
        n = p.ident()
        if p.take("ADD"):
            p.take("COLUMN")
            self.catalog.add_column(n, self._column(p))
        elif p.take("DROP"):
            p.take("COLUMN")
            self.catalog.drop_column(n, p.ident())
        else:
            p.need("RENAME")
            p.take("COLUMN")
            a = p.ident()
            p.need("TO")
            self.catalog.rename_column(n, a, p.ident())
        return self._say(f"table {n} altered")

    def _insert(self, p: Parser) -> DataFrame:
        n = p.ident()
        columns = p.names() if p.at("(") else None
        if p.at("SELECT") or p.at("WITH"):
            df = self.query(p.select())
            return self._say("inserted", self.catalog.insert(n, df.toDF(*columns) if columns else df))
        p.need("VALUES")
        rows = []
        while True:
            p.need("(")
            row = [p.value()]
            while p.take(","):
                row.append(p.value())
            p.need(")")
            rows.append(row)
            if not p.take(","):
                break
        return self._say("inserted", self.catalog.insert(n, rows, columns))

    def _update(self, p: Parser) -> DataFrame:
        n = p.ident()
        p.need("SET")
        values = {}
        while True:
            k = p.ident()
            p.need("=")
            values[k] = F.expr(p.sum())
            if not p.take(","):
                break
        where = F.expr(p.expr()) if p.take("WHERE") else None
        return self._say("updated", self.catalog.update(n, values, where))

    def _delete(self, p: Parser) -> DataFrame:
        n = p.ident()
        return self._say("deleted", self.catalog.delete(n, F.expr(p.expr()) if p.take("WHERE") else None))

    def _bulk_update(self, p: Parser) -> DataFrame:
        n = p.ident()
        p.need("SET")
        patches: dict[int, dict] = {}
        while p.take("ROW"):
            row = patches.setdefault(int(p.number()), {})
            p.need("SET")
            while True:
                k = p.ident()
                p.need("=")
                row[k] = p.value()
                if not p.at(",") or p.at(",", "ROW"):
                    break
                p.next()
            p.take(",")
        return self._say("updated", self.catalog.bulk_update(n, patches))

    def _bulk_delete(self, p: Parser) -> DataFrame:
        n = p.ident()
        p.need("WHERE", "ROW", "IN")
        return self._say("deleted", self.catalog.bulk_delete(n, [int(x) for x in p.numbers()]))

    def _load(self, p: Parser) -> DataFrame:
        p.take("LOCAL")
        p.need("INFILE")
        path = p.string()
        p.need("INTO", "TABLE")
        n = p.ident()
        columns = p.names() if p.at("(") else None
        header, delimiter = False, ","
        while p.now.kind == "name":
            if p.take("HEADER"):
                header = True
            elif p.take("DELIMITER"):
                p.need("=")
                delimiter = p.string()
            else:
                p.need("TYPE")
                p.need("=")
                p.value()
        good, bad, lost = self.catalog.load_csv(path, n, header, delimiter, columns)
        return self._say(f"{bad} lines left out, {lost} values of another type are NULL", good)

    # --- analysis and series ---

    def _analyze(self, p: Parser) -> DataFrame:
        df, kind, target, features, opts = self.relation(p.ident()), "SUMMARY", None, None, {}
        while p.now.kind == "name":
            if p.take("TARGET"):
                target = p.ident()
            elif p.take("FEATURES"):
                features = p.names()
            elif p.take("TYPE"):
                kind = p.ident()
            else:
                p.need("WITH")
                opts = p.options()
        out = A.analyze(df, kind, target, features, opts.pop("key", None), **opts)
        if "save_report" in opts:
            A.save_report(out, str(opts["save_report"]))
        return out

    def _prepare(self, p: Parser) -> DataFrame:
        out = p.ident()
        p.need("FROM")
        df = self.relation(p.ident())
        p.need("TIME", "COLUMN")
        time = p.ident()
        p.need("TARGET")
        y = p.ident()
        k: dict = {}
        if p.take("FEATURES"):
            keep = p.names()
            df = df.select(*dict.fromkeys([time, y, *keep]))
        if p.take("WITH"):
            while p.now.kind == "name":
                if p.take("LAGS"):
                    k["lags"] = [int(x) for x in p.numbers()]
                elif p.take("ROLLING_WINDOWS"):
                    k["windows"] = [int(x) for x in p.numbers()]
                elif p.take("ADD_DATETIME_FEATURES"):
                    k["datetime"] = True
                elif p.take("ADD_SEASONAL_FEATURES"):
                    k["seasonal"] = 7
                elif p.take("MAKE_STATIONARY"):
                    k["make_stationary"] = True
                elif p.take("NO_AUTO_DETECT"):
                    k["auto"] = False
                elif p.take("SPLIT"):
                    o = p.options()
                    k["parts"] = (float(o["train"]), float(o.get("validation", 0)))
                else:
                    p.need("CHECK_STATIONARITY")
                p.take(",")
        result = Z.prepare(df, time, y, **k)
        self.catalog.create_table_as(out, result)
        return self.catalog.table(out)

    def _seasonality(self, p: Parser) -> DataFrame:
        df = self.relation(p.ident())
        p.need("TIME", "COLUMN")
        time = p.ident()
        p.need("VALUE", "COLUMN")
        v = p.ident()
        o = p.options() if p.take("WITH") else {}
        return Z.detect_seasonality(df, time, v, int(o.get("max_lag", 40)))

    def _forecast(self, p: Parser) -> DataFrame:
        strategy = p.ident().lower()
        p.need("FROM")
        df = self.relation(p.ident())
        time = values = into = None
        horizon = 10
        while p.now.kind == "name":
            if p.take("TIME", "COLUMN"):
                time = p.ident()
            elif p.take("VALUE", "COLUMNS") or p.take("VALUE", "COLUMN"):
                values = p.names()
            elif p.take("HORIZON"):
                horizon = int(p.number())
            elif p.take("INTO"):
                into = p.ident()
            elif p.take("WITH", "CONFIDENCE"):
                continue
            else:
                p.need("WITH")
                p.options()
        if time is None or not values:
            raise DialectError("FORECAST needs TIME COLUMN and VALUE COLUMNS")
        out = None
        for v in values:
            one = Y.forecast(df, time, v, horizon, strategy=strategy if strategy in Y.STRATEGIES else "ensemble").select(F.lit(v).alias("series"), "*")
            out = one if out is None else out.union(one)
        if into:
            self.catalog.create_table_as(into, out)
        return out

    # --- models ---

    def _create_model(self, p: Parser, replace: bool = False) -> DataFrame:
        n = p.ident()
        p.need("USING")
        algorithm, drop, features, target, df, opts = p.ident(), [], None, None, None, {}
        while p.now.kind == "name":
            if p.take("EXCLUDE", "FEATURES"):
                drop = p.names()
            elif p.take("FEATURES"):
                features = p.names()
            elif p.take("TARGET"):
                target = p.ident()
                if p.take("AS"):
                    p.ident()
            elif p.take("FROM"):
                df = self.relation(p.ident())
            else:
                p.need("WITH")
                opts = p.options()
        if df is None:
            raise DialectError("CREATE MODEL needs FROM")
        features = [f for f in features or df.columns if f not in (*drop, target)]
        return self._fit(n, df, features, target, algorithm, opts, replace)

    def _fit(self, n: str, df: DataFrame, features: list[str], target: str | None, algorithm: str, opts: dict, replace: bool, where=None) -> DataFrame:
        m = M.train(df, n, features, target, algorithm, iterations=int(opts.get("iterations", opts.get("num_iterations", 20))), depth=int(opts.get("max_depth", 5)), rate=float(opts.get("learning_rate", 0.1)), test_share=1 - float(opts.get("split", 0.8)), where=where, clusters=int(opts.get("clusters", 4)), alpha=float(opts.get("alpha", 0.9)))
        self.models.save(m, replace=replace)
        return self.spark.createDataFrame([(n, m.card.kind, k, float(v)) for k, v in (m.card.metrics or {"trained": 1.0}).items()], "model string, kind string, metric string, value double")

    def _train(self, p: Parser) -> DataFrame:
        n = p.ident()
        p.need("USING")
        algorithm = p.ident()
        p.need("FEATURES")
        features = p.names()
        p.need("TARGET")
        target = p.ident()
        p.need("FROM")
        df, opts, where = self.relation(p.ident()), {}, None
        while p.now.kind == "name":
            if p.take("WITH", "HYPERPARAMETERS"):
                opts = p.options()
            elif p.take("INTO"):
                n = p.ident()
            else:
                p.need("WHERE")
                where = F.expr(p.expr())
        return self._fit(n, df, features, target, algorithm, opts, True, where)

    def _predict(self, p: Parser) -> DataFrame:
        m = self.models.load(p.ident())
        p.need("ON")
        df = self.relation(p.ident())
        where = keep = into = limit = None
        while p.now.kind == "name":
            if p.take("WHERE"):
                where = F.expr(p.expr())
            elif p.take("OUTPUT"):
                keep = p.names()
            elif p.take("INTO"):
                into = p.ident()
            elif p.take("LIMIT"):
                limit = int(p.number())
            else:
                p.need("WITH")
                p.options() if p.at("(") else p.ident()
        out = M.predict(m, df, where, limit)
        out = out.select(*keep) if keep else out
        if into:
            self.catalog.create_table_as(into, out)
        return out

    def _drop_model(self, p: Parser) -> DataFrame:
        maybe = p.take("IF", "EXISTS")
        self.models.drop(n := p.ident(), maybe)
        return self._say(f"model {n} dropped")

    def _describe(self, p: Parser) -> DataFrame:
        return self.models.models().where(F.col("name") == p.ident())

    def _metrics(self, p: Parser) -> DataFrame:
        c = self.models.load(p.ident()).card
        return self.spark.createDataFrame([(c.name, k, float(v)) for k, v in c.metrics.items()], "model string, metric string, value double")

    def _explain(self, p: Parser) -> DataFrame:
        """EXPLAIN MODEL m ON t KEY k."""
        m = self.models.load(p.ident())
        p.need("ON")
        df = self.relation(p.ident())
        p.need("KEY")
        return M.explain(m, df, p.ident())

    def _anomaly(self, p: Parser) -> DataFrame:
        """DETECT ANOMALY IN t [FEATURES (...)] [USING algorithm] [KEY k]."""
        df, features, algorithm, key = self.relation(p.ident()), None, "isolation_forest", None
        while p.now.kind == "name":
            if p.take("FEATURES"):
                features = p.names()
            elif p.take("KEY"):
                key = p.ident()
            else:
                p.need("USING")
                algorithm = p.ident().lower()
        return detect(df, features, algorithm, key=key)

    # --- simulation and plots ---

    def _simulate(self, p: Parser) -> DataFrame:
        p.need("USING")
        n = p.ident()
        p.need("FROM")
        df, steps, paths, interval, noise, scenario, into, time, price = self.relation(p.ident()), 30, 100, "1d", 1.0, "BASE", None, "timestamp", "close"
        while p.now.kind == "name":
            if p.take("STEPS"):
                steps = int(p.number())
            elif p.take("PATHS"):
                paths = int(p.number())
            elif p.take("INTERVAL"):
                interval = p.string() if p.now.kind == "string" else f"{int(p.number())}{p.ident()}"
            elif p.take("NOISE"):
                noise = 1.0 if p.ident().upper() == "GAUSSIAN" else 0.0
            elif p.take("WITH_SCENARIO"):
                scenario = p.ident()
                if p.at("("):
                    p.options()
            elif p.take("TIME", "COLUMN"):
                time = p.ident()
            elif p.take("PRICE", "COLUMN"):
                price = p.ident()
            else:
                p.need("INTO")
                into = p.ident()
        out = S.simulate(self.spark, S.calibrate(df, time, price), steps, paths, interval, noise, scenario, name=n)
        if into:
            self.catalog.create_table_as(into, out)
        return out

    def _plot(self, p: Parser) -> DataFrame:
        if p.take("REALTIME"):
            p.ident()
            opts = p.options() if p.at("(") else {}
            p.need("FOR")
            return realtime_plot(self.query(p.select()), opts.get("window"), str(opts.get("method", "AVERAGE")), int(opts.get("n", 1)))
        kind = p.ident().upper()
        opts = p.options() if p.at("(") else {}
        p.need("FOR")
        out = self._frame(kind, opts, self.query(p.select()))
        if "save" in opts:
            P.save(out, str(opts["save"]), kind)
        return out

    def _frame(self, kind: str, opts: dict, df: DataFrame) -> DataFrame:
        roles = P.classify(df)
        numbers = [c for c, r in roles.items() if r in ("numeric", "integer")]
        other = [c for c in df.columns if c not in numbers]
        if kind in ("AUTO", "SMART"):
            kind = P.suggest(df)
        lat, lon = (next((c for c, r in roles.items() if r == k), None) for k in ("latitude", "longitude"))
        if kind.startswith("GEO") and lat and lon:
            return P.geo_points(df, lat, lon, *[c for c in df.columns if c not in (lat, lon)]) if kind in ("GEO_SCATTER", "GEO_BUBBLE", "GEO_LINE", "GEO_POLYGON", "GEO_MAP") else P.geo_grid(df, lat, lon, float(opts.get("size", 1.0)), numbers[0] if numbers else None)
        if kind == "HISTOGRAM":
            return P.histogram(df, numbers[0], int(opts["bins"]) if "bins" in opts else None)
        if kind in ("HISTOGRAM_2D", "CONTOUR", "SURFACE", "WIREFRAME"):
            return P.histogram_2d(df, numbers[0], numbers[1], int(opts.get("bins", 10)))
        if kind == "HEATMAP":
            return P.heatmap(df, df.columns[0], df.columns[1], numbers[-1] if len(df.columns) > 2 else None)
        if kind in ("BOXPLOT", "VIOLIN"):
            return P.boxplot(df, numbers) if kind == "BOXPLOT" else P.violin(df, numbers)
        if kind in ("BAR", "STACKED_BAR", "PIE"):
            return (P.pie if kind == "PIE" else P.bar)(df, (other or numbers)[0], numbers[-1] if numbers else None)
        if kind == "CORRELATION":
            return P.correlation(df, numbers)
        if kind in ("TREND", "RESIDUALS"):
            return (P.trend if kind == "TREND" else P.residuals)(df, numbers[0], numbers[1])
        if kind in ("QQ", "QQPLOT", "DISTRIBUTION"):
            return P.qq(df, numbers[0])
        if kind in ("LINE", "MULTI_LINE", "AREA", "SCATTER", "TIME_SERIES"):
            x = (other or df.columns)[0]
            return P.series(df, x, [c for c in numbers if c != x])
        raise DialectError(f"unknown plot {kind}")
