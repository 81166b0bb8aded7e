"""Databases and tables as versioned Parquet folders, with constraints checked before a version is published.

Readers see the table before a statement or after it, and a failed statement leaves nothing visible (see `Catalog`).
Rows carry a dense `_row_id` that BULK statements refer to; it is given once and never recomputed.
"""

from __future__ import annotations

import functools
import json
import threading
import time
import uuid
from collections.abc import Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.plans.staging import stage
from sparkloom.sources import csv
from sparkloom.types import UUID_PATTERN, ColumnDef, schema

ROW = "_row_id"


class ConstraintError(ValueError):
    """A row breaks a constraint; nothing was written."""


def dense_ids(df: DataFrame, start: int, name: str = ROW) -> DataFrame:
    """start, start + 1, ... without a global window: places inside partitions plus running partition counts."""
    d = stage(df.withColumn("__m", F.monotonically_increasing_id()), "ids")
    part, place = F.shiftright("__m", 33), F.col("__m").bitwiseAND(F.lit((1 << 33) - 1))
    counts = sorted((r.p, r.n) for r in d.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())
    offsets, at = {}, start
    for p, n in counts:
        offsets[p] = at
        at += n
    if not offsets:
        return d.drop("__m").withColumn(name, F.lit(None).cast("long"))
    table = d.sparkSession.createDataFrame(list(offsets.items()), "__p long, __o long")
    return d.withColumn("__p", part.cast("long")).join(table, "__p").withColumn(name, F.col("__o") + place).drop("__p", "__o", "__m")


class ConflictError(RuntimeError):
    """Another writer changed the table first."""


#: Data folders of a table beyond which an insert rewrites it into one; tries of a statement that meets other writers.
MOST_PARTS, TRIES = 64, 20


def _again(statement):
    """Run a statement anew where another writer was first; within a transaction that's for the whole of it to decide."""

    @functools.wraps(statement)
    def run(self, table, *args, **kwargs):
        for i in range(TRIES):
            try:
                with self.locks.setdefault((self.database, table), threading.RLock()):
                    return statement(self, table, *args, **kwargs)
            except ConflictError:
                if self.pending is not None or i == TRIES - 1:
                    raise
                time.sleep(0.05 * (i + 1))

    return run


class Catalog:
    """A table is a chain of numbered states, each a small file that names the table's data folders and its schema.

    A writer puts its data into folders of its own, claims the next number by creating a file that must not exist, and
    publishes the state by a rename: readers see the state before or the one after, and of two writers of one state the
    second has to begin again. An insert adds a folder; other statements write the table anew.
    """

    def __init__(self, spark: SparkSession, root: str, database: str = "default"):
        self.spark, self.root = spark, root.rstrip("/")
        self.database = database
        self.locks: dict[tuple[str, str], threading.RLock] = {}
        self.pending: dict[tuple[str, str], dict | None] | None = None  # states of the open transaction; None: dropped
        self.base: dict[tuple[str, str], int] = {}
        self.create_database(database, exist_ok=True)
        self._finish_commits()

    # --- files ---

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _read(self, path: str) -> str:
        fs, p = self._fs(path)
        s = fs.open(p)
        try:
            return bytes(s.readAllBytes()).decode()
        finally:
            s.close()

    def _write(self, path: str, text: str) -> None:
        """Whole or not at all: written beside and renamed."""
        fs, p = self._fs(f"{path}.{uuid.uuid4().hex}.new")
        s = fs.create(p, False)
        s.write(bytearray(text.encode()))
        s.close()
        fs.rename(p, self._fs(path)[1])

    def _claim(self, path: str) -> None:
        fs, p = self._fs(path)
        try:
            fs.create(p, False).close()
        except Py4JJavaError as e:
            raise ConflictError(f"{path} is taken: another writer is at work, or has failed there (then delete the file)") from e

    def _exists(self, path: str) -> bool:
        fs, p = self._fs(path)
        return fs.exists(p)

    def _names(self, path: str, folders: bool = True) -> list[str]:
        fs, p = self._fs(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory() == folders) if fs.exists(p) else []

    def _dir(self, table: str, database: str | None = None) -> str:
        return f"{self.root}/{database or self.database}/{table}"

    # --- transactions ---

    def begin(self) -> None:
        """Statements until commit see each other's changes; nobody else does."""
        if self.pending is not None:
            raise ValueError("a transaction is open")
        self.pending, self.base = {}, {}

    def rollback(self) -> None:
        if self.pending is None:
            raise ValueError("no transaction is open")
        self.pending = None

    def commit(self) -> None:
        """All tables or none: a record of the new states is the commit; whoever opens the catalog after a crash applies it."""
        if self.pending is None:
            raise ValueError("no transaction is open")
        pending, self.pending = self.pending, None
        for (database, table), version in sorted(self.base.items()):
            if self._version(table, database) != version:
                raise ConflictError(f"{table} was changed since the transaction read it")
        claimed = []
        try:
            for (database, table), state in sorted(pending.items()):
                if state is not None:
                    path = f"{self._dir(table, database)}/claim-{state['version']:012d}"
                    self._claim(path)
                    claimed.append(path)
        except ConflictError:
            for path in claimed:
                fs, p = self._fs(path)
                fs.delete(p, False)
            raise
        record = f"{self.root}/commit-{uuid.uuid4().hex}"
        self._write(record, json.dumps([[d, t, s] for (d, t), s in sorted(pending.items())]))
        self._apply(record)

    def _apply(self, record: str) -> None:
        for database, table, state in json.loads(self._read(record)):
            folder = self._dir(table, database)
            if state is None:
                fs, p = self._fs(folder)
                fs.delete(p, True)
            elif not self._exists(f"{folder}/state-{state['version']:012d}"):
                self._write(f"{folder}/state-{state['version']:012d}", json.dumps(state))
        fs, p = self._fs(record)
        fs.delete(p, False)

    def _finish_commits(self) -> None:
        for name in self._names(self.root, folders=False):
            if name.startswith("commit-") and not name.endswith(".new"):
                self._apply(f"{self.root}/{name}")

    # --- databases ---

    def create_database(self, name: str, exist_ok: bool = False) -> None:
        fs, p = self._fs(f"{self.root}/{name}")
        if fs.exists(p) and not exist_ok:
            raise ValueError(f"database {name} exists")
        fs.mkdirs(p)

    def use(self, name: str) -> None:
        if name not in self._names(self.root):
            raise ValueError(f"no database {name}")
        self.database = name

    def databases(self) -> DataFrame:
        return self.spark.createDataFrame([(n,) for n in self._names(self.root)], "database string")

    def table_names(self) -> list[str]:
        own = self.pending or {}
        named = {n for n in self._names(f"{self.root}/{self.database}") if self._version(n)} | {t for d, t in own if d == self.database}
        return sorted(n for n in named if own.get((self.database, n), True) is not None)

    def tables(self) -> DataFrame:
        return self.spark.createDataFrame([(n,) for n in self.table_names()], "table string")

    # --- schema ---

    def _version(self, table: str, database: str | None = None) -> int:
        """The number of the newest state on file, 0 for none."""
        found = [n for n in self._names(self._dir(table, database), folders=False) if n.startswith("state-") and not n.endswith(".new")]
        return int(found[-1][6:]) if found else 0

    def _state(self, table: str) -> dict:
        key = (self.database, table)
        if self.pending is not None and key in self.pending:
            state = self.pending[key]
        else:
            version = self._version(table)
            if self.pending is not None:
                self.base.setdefault(key, version)
            state = json.loads(self._read(f"{self._dir(table)}/state-{version:012d}")) if version else None
        if state is None:
            raise ValueError(f"no table {table}")
        return state

    def columns(self, table: str) -> list[ColumnDef]:
        return [ColumnDef.of(f) for f in T.StructType.fromJson(self._state(table)["schema"]).fields]

    def rows(self, table: str) -> DataFrame:
        """With row ids."""
        s = self._state(table)
        full = T.StructType([*T.StructType.fromJson(s["schema"]).fields, T.StructField(ROW, T.LongType())])
        return self.spark.read.schema(full).parquet(*[f"{self._dir(table)}/{p}" for p in s["parts"]])

    def table(self, table: str) -> DataFrame:
        return self.rows(table).drop(ROW)

    def _publish(self, table: str, rows: DataFrame, columns: list[ColumnDef], next_row: int, version: int, before: Sequence[str] = ()) -> None:
        """Write the rows into a folder of their own and make them, behind the folders before, the table's next state."""
        fields = schema(columns)
        part = f"d-{uuid.uuid4().hex}"
        rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in fields.fields], F.col(ROW).cast("long").alias(ROW)).write.parquet(f"{self._dir(table)}/{part}")
        state = {"version": version, "schema": fields.jsonValue(), "next_row": next_row, "parts": [*before, part]}
        if self.pending is not None:
            self.base.setdefault((self.database, table), version - 1)
            self.pending[self.database, table] = state
            return
        self._claim(f"{self._dir(table)}/claim-{version:012d}")
        self._write(f"{self._dir(table)}/state-{version:012d}", json.dumps(state))

    def create_table(self, table: str, columns: Sequence[ColumnDef]) -> None:
        if not columns:
            raise ValueError("a table has columns")
        if table in self.table_names():
            raise ValueError(f"table {table} exists")
        s = schema(list(columns))
        empty = self.spark.createDataFrame([], T.StructType([*s.fields, T.StructField(ROW, T.LongType())]))
        self._publish(table, empty, list(columns), 1, self._version(table) + 1)

    def create_table_as(self, table: str, df: DataFrame) -> None:
        self.create_table(table, [ColumnDef.of(f) for f in df.schema.fields])
        self.insert(table, df)

    def drop_table(self, table: str) -> None:
        self._state(table)
        if self.pending is not None:
            self.pending[self.database, table] = None
            return
        fs, p = self._fs(self._dir(table))
        fs.delete(p, True)

    # --- checks ---

    def _filled(self, table: str, df: DataFrame, cols: list[ColumnDef], first_row: int) -> DataFrame:
        """Incoming rows with all columns: defaults, generated values, automatic numbers."""
        unknown = set(df.columns) - {c.name for c in cols}
        if unknown:
            raise ValueError(f"no column {', '.join(sorted(unknown))} in {table}")
        for c in cols:
            if c.auto_increment:
                if c.name in df.columns and not df.where(F.col(c.name).isNotNull()).isEmpty():
                    raise ConstraintError(f"{c.name} is numbered automatically")
                continue
            v = F.col(c.name) if c.name in df.columns else F.lit(None)
            v = v.cast(c.spark_type)
            if c.default is not None:
                v = F.coalesce(v, F.lit(c.default).cast(c.spark_type))
            if c.generate == "date":
                v = F.coalesce(v, F.current_date().cast(c.spark_type))
            elif c.generate == "datetime":
                v = F.coalesce(v, F.current_timestamp().cast(c.spark_type))
            elif c.generate == "uuid":
                v = F.coalesce(v, F.uuid())
            df = df.withColumn(c.name, v)
        df = dense_ids(df, first_row)
        for c in cols:
            if c.auto_increment:
                top = self.rows(table).agg(F.max(c.name)).first()[0] or 0
                df = df.withColumn(c.name, (F.col(ROW) - F.lit(first_row) + F.lit(top + 1)).cast(c.spark_type))
        return df.select(*[c.name for c in cols], ROW)

    def check(self, new: DataFrame, old: DataFrame | None, cols: list[ColumnDef]) -> None:
        """Raise on the first constraint that a new row breaks: one pass for the row rules; unique columns are counted
        among the new rows and looked up in the old ones, which are read for their keys alone."""
        rules = []
        for c in cols:
            if c.not_null or c.primary_key:
                rules.append((f"{c.name} is NULL", F.col(c.name).isNull()))
            if c.check:
                rules.append((f"{c.name} fails CHECK ({c.check})", ~F.coalesce(F.expr(c.check), F.lit(False))))
            if c.type.upper() == "UUID":
                rules.append((f"{c.name} is no UUID", F.col(c.name).isNotNull() & ~F.col(c.name).rlike(UUID_PATTERN)))
        if rules:
            found = new.agg(*[F.count_if(p).alias(f"r{i}") for i, (_, p) in enumerate(rules)]).first()
            for i, (what, _) in enumerate(rules):
                if found[i]:
                    raise ConstraintError(f"{found[i]} rows: {what}")
        for c in cols:
            if c.primary_key or c.unique:
                keys = new.where(F.col(c.name).isNotNull()).select(c.name)
                first = keys.groupBy(c.name).agg(F.count("*").alias("n")).where("n > 1").first()
                if first is not None:
                    raise ConstraintError(f"{c.name} = {first[0]!r} occurs {first[1]} times")
                again = keys.join(old.select(c.name), c.name, "left_semi").first() if old is not None else None
                if again is not None:
                    raise ConstraintError(f"{c.name} = {again[0]!r} occurs 2 times")

    # --- statements ---

    @_again
    def insert(self, table: str, data: DataFrame | Sequence[Sequence] | Sequence[dict], columns: Sequence[str] | None = None) -> int:
        """Append rows; without a column list, values go by position to the columns that aren't automatic."""
        s, cols = self._state(table), self.columns(table)
        if not isinstance(data, DataFrame):
            names = list(columns or [c.name for c in cols if not c.auto_increment and not c.generate])
            by = {c.name: c for c in cols}
            if data and isinstance(data[0], dict):
                names = sorted({k for r in data for k in r})
                data = [[r.get(k) for k in names] for r in data]
            if any(len(r) != len(names) for r in data):
                raise ValueError(f"rows need {len(names)} values")
            if bad := [n for n in names if n not in by]:
                raise ValueError(f"no column {', '.join(bad)} in {table}")
            text = [[None if v is None else str(v).lower() if isinstance(v, bool) else str(v) for v in r] for r in data]
            df = self.spark.createDataFrame(text, T.StructType([T.StructField(n, T.StringType()) for n in names]))
            data = df.select(*[F.col(n).cast(by[n].spark_type).alias(n) for n in names])
        new = stage(self._filled(table, data, cols, s["next_row"]), "insert")
        n = new.count()
        old = self.rows(table)
        self.check(new, old, cols)
        if len(s["parts"]) < MOST_PARTS:
            self._publish(table, new, cols, s["next_row"] + n, s["version"] + 1, s["parts"])
        else:
            self._publish(table, old.unionByName(new), cols, s["next_row"] + n, s["version"] + 1)
        return n

    @_again
    def update(self, table: str, values: dict[str, Column | object], where: Column | None = None) -> int:
        s, cols = self._state(table), self.columns(table)
        by = {c.name: c for c in cols}
        for k in values:
            if k not in by:
                raise ValueError(f"no column {k} in {table}")
            if by[k].primary_key:
                raise ConstraintError("a primary key isn't updated")
        hit = F.lit(True) if where is None else F.coalesce(where, F.lit(False))
        old = self.rows(table)
        new = old.select(*[F.when(hit, (values[c] if isinstance(values[c], Column) else F.lit(values[c])).cast(by[c].spark_type)).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in old.columns])
        n = old.where(hit).count()
        self.check(new, None, cols)
        self._publish(table, new, cols, s["next_row"], s["version"] + 1)
        return n

    @_again
    def bulk_update(self, table: str, patches: dict[int, dict[str, object]]) -> int:
        """Values by row id."""
        s, cols = self._state(table), self.columns(table)
        by = {c.name: c for c in cols}
        touched = sorted({k for p in patches.values() for k in p})
        if any(by[k].primary_key for k in touched):
            raise ConstraintError("a primary key isn't updated")
        rows = [(i, *[None if p.get(k) is None else str(p[k]) for k in touched], *[k in p for k in touched]) for i, p in patches.items()]
        patch = self.spark.createDataFrame(rows, T.StructType([T.StructField("__id", T.LongType()), *[T.StructField(f"__v_{k}", T.StringType()) for k in touched], *[T.StructField(f"__s_{k}", T.BooleanType()) for k in touched]]))
        old = self.rows(table)
        new = old.join(patch, old[ROW] == patch["__id"], "left")
        new = new.select(*[F.when(F.col(f"__s_{c}"), F.col(f"__v_{c}").cast(by[c].spark_type)).otherwise(F.col(c)).alias(c) if c in touched else F.col(c) for c in old.columns])
        n = old.where(F.col(ROW).isin(list(patches))).count()
        self.check(new, None, cols)
        self._publish(table, new, cols, s["next_row"], s["version"] + 1)
        return n

    @_again
    def delete(self, table: str, where: Column | None = None) -> int:
        s, cols = self._state(table), self.columns(table)
        hit = F.lit(True) if where is None else F.coalesce(where, F.lit(False))
        old = self.rows(table)
        n = old.where(hit).count()
        self._publish(table, old.where(~hit), cols, s["next_row"], s["version"] + 1)
        return n

    @_again
    def bulk_delete(self, table: str, ids: Sequence[int]) -> int:
        s, cols = self._state(table), self.columns(table)
        gone = self.spark.createDataFrame([(int(i),) for i in ids], f"{ROW} long")
        old = self.rows(table)
        n = old.join(gone, ROW, "left_semi").count()
        self._publish(table, old.join(gone, ROW, "left_anti").select(*old.columns), cols, s["next_row"], s["version"] + 1)
        return n

    @_again
    def add_column(self, table: str, column: ColumnDef) -> None:
        s, cols = self._state(table), self.columns(table)
        if column.name in {c.name for c in cols}:
            raise ValueError(f"column {column.name} exists")
        fill = F.lit(column.default).cast(column.spark_type)
        new = self.rows(table).withColumn(column.name, fill)
        self.check(new, None, [*cols, column])
        self._publish(table, new, [*cols, column], s["next_row"], s["version"] + 1)

    @_again
    def drop_column(self, table: str, name: str) -> None:
        s, cols = self._state(table), self.columns(table)
        c = next((c for c in cols if c.name == name), None)
        if c is None:
            raise ValueError(f"no column {name} in {table}")
        if c.primary_key:
            raise ConstraintError("a primary key isn't dropped")
        self._publish(table, self.rows(table).drop(name), [x for x in cols if x.name != name], s["next_row"], s["version"] + 1)

    @_again
    def rename_column(self, table: str, old: str, new: str) -> None:
        s, cols = self._state(table), self.columns(table)
        c = next((c for c in cols if c.name == old), None)
        if c is None or new in {x.name for x in cols}:
            raise ValueError(f"can't rename {old} to {new}")
        if c.primary_key:
            raise ConstraintError("a primary key isn't renamed")
        rows = self.rows(table).withColumnRenamed(old, new)
        c.name = new
        self._publish(table, rows, cols, s["next_row"], s["version"] + 1)

    def load_csv(self, path: str, table: str, header: bool = True, delimiter: str = ",", columns: Sequence[str] | None = None) -> tuple[int, int, int]:
        """LOAD DATA: rows loaded, lines left out, values lost to the table's types; a missing table is made from the header and all values."""
        if table in self.table_names():
            cols = self.columns(table)
            names = list(columns) if columns else None if header else [c.name for c in cols]
            types = {c.name: c.type.upper() for c in cols}
            good, bad, lost = csv.load(self.spark, path, header, delimiter, types, names)
        else:
            good, bad, lost = csv.load(self.spark, path, header, delimiter, columns=list(columns) if columns else None)
            self.create_table(table, [ColumnDef.of(f) for f in good.schema.fields])
        return self.insert(table, good), bad.count(), lost

    # --- reports ---

    def structure(self, table: str) -> DataFrame:
        rows = [(c.name, c.type.upper(), not (c.not_null or c.primary_key), "PRIMARY" if c.primary_key else "UNIQUE" if c.unique else None, None if c.default is None else str(c.default)) for c in self.columns(table)]
        return self.spark.createDataFrame(rows, "column string, type string, nullable boolean, key string, default string")

    def database_structure(self) -> DataFrame:
        rows = [(t, c.name, c.type.upper()) for t in self.table_names() for c in self.columns(t)]
        return self.spark.createDataFrame(rows, "table string, column string, type string")

    def _sizes(self, table: str) -> tuple[int, int]:
        """Bytes and files of the data of a table's present state."""
        found = [fs.getContentSummary(p) for fs, p in (self._fs(f"{self._dir(table)}/{part}") for part in self._state(table)["parts"])]
        return sum(x.getLength() for x in found), sum(x.getFileCount() for x in found)

    def stats(self, table: str) -> DataFrame:
        size, files = self._sizes(table)
        return self.rows(table).agg(F.count("*").alias("rows")).select(F.lit(table).alias("table"), "rows", F.lit(len(self.columns(table))).alias("columns"), F.lit(size).cast("long").alias("bytes"), F.lit(files).cast("long").alias("files"))

    def database_stats(self) -> DataFrame:
        """One row: the database's tables, columns, rows, bytes and files."""
        names = self.table_names()
        sizes = [self._sizes(t) for t in names]
        rows = sum(self.rows(t).count() for t in names)
        values = (self.database, len(names), sum(len(self.columns(t)) for t in names), rows, sum(x[0] for x in sizes), sum(x[1] for x in sizes))
        return self.spark.createDataFrame([values], "database string, tables int, columns int, rows long, bytes long, files long")
