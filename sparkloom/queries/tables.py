"""Tables, statements that change them, constraints and CSV loading, in a fresh catalog per query."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from sparkloom.plans.staging import shared_dir
from sparkloom.queries import query
from sparkloom.sources.catalog import ROW, Catalog, ConstraintError
from sparkloom.types import ColumnDef

c = F.col


def catalog(t) -> Catalog:
    return Catalog(t.spark, f"{shared_dir(t.spark)}/catalog-{uuid.uuid4().hex}")


def suppliers(t) -> Catalog:
    k = catalog(t)
    k.create_table("s", [ColumnDef("id", "INT", primary_key=True), ColumnDef("name", "TEXT", not_null=True), ColumnDef("balance", "FLOAT"), ColumnDef("nation", "INT", default=0)])
    k.insert("s", t.supplier.select(c("s_suppkey").alias("id"), c("s_name").alias("name"), c("s_acctbal").alias("balance"), c("s_nationkey").cast("long").alias("nation")).orderBy("id"))
    return k


_S = "SELECT s_suppkey AS id, s_name AS name, s_acctbal AS balance, s_nationkey::BIGINT AS nation FROM supplier"


@query("table_create_insert", _S)
def _(t):
    return suppliers(t).table("s")


@query("table_insert_values", f"{_S} UNION ALL SELECT 900001, 'new one', 1.5, 0 UNION ALL SELECT 900002, 'other', NULL, 0")
def _(t):
    k = suppliers(t)
    k.insert("s", [(900001, "new one", 1.5), (900002, "other", None)], ["id", "name", "balance"])
    return k.table("s")


@query("table_update", "SELECT s_suppkey AS id, s_name AS name, CASE WHEN s_nationkey = 3 THEN s_acctbal + 100 ELSE s_acctbal END AS balance, s_nationkey::BIGINT AS nation FROM supplier")
def _(t):
    k = suppliers(t)
    k.update("s", {"balance": c("balance") + 100}, c("nation") == 3)
    return k.table("s")


@query("table_delete", f"{_S} WHERE NOT s_acctbal < 0")
def _(t):
    k = suppliers(t)
    k.delete("s", c("balance") < 0)
    return k.table("s")


@query("table_bulk_update_delete", "SELECT s_suppkey AS id, CASE WHEN i = 2 THEN 'second' ELSE s_name END AS name FROM (SELECT *, row_number() OVER (ORDER BY s_suppkey) AS i FROM supplier) WHERE i NOT IN (1, 4)")
def _(t):
    k = suppliers(t)
    k.bulk_update("s", {2: {"name": "second"}})
    k.bulk_delete("s", [1, 4])
    return k.table("s").select("id", "name")


@query("table_row_ids", "SELECT s_suppkey AS id, row_number() OVER (ORDER BY s_suppkey) AS row_id FROM supplier")
def _(t):
    return suppliers(t).rows("s").select("id", c(ROW).alias("row_id"))


@query("table_alter", "SELECT s_suppkey AS id, s_name AS title, s_nationkey::BIGINT AS nation, 'eu' AS region FROM supplier")
def _(t):
    k = suppliers(t)
    k.add_column("s", ColumnDef("region", "TEXT", default="eu"))
    k.drop_column("s", "balance")
    k.rename_column("s", "name", "title")
    return k.table("s")


@query("table_create_as_drop", "SELECT 'kept' AS \"table\"")
def _(t):
    k = catalog(t)
    k.create_table_as("kept", t.region)
    k.create_table_as("gone", t.nation)
    k.drop_table("gone")
    return k.tables()


@query("table_auto_increment", "SELECT i::BIGINT AS id, n_name AS name FROM (SELECT row_number() OVER (ORDER BY n_nationkey) AS i, n_name FROM nation)")
def _(t):
    k = catalog(t)
    k.create_table("n", [ColumnDef("id", "INT", primary_key=True, auto_increment=True), ColumnDef("name", "TEXT")])
    rows = [r.n_name for r in t.nation.orderBy("n_nationkey").collect()]
    k.insert("n", [(r,) for r in rows[:10]])
    k.insert("n", [(r,) for r in rows[10:]])
    return k.table("n")


@query("table_generated", "SELECT 2::BIGINT AS n, 2::BIGINT AS uuids, TRUE AS dated")
def _(t):
    k = catalog(t)
    k.create_table("g", [ColumnDef("name", "TEXT"), ColumnDef("u", "UUID", generate="uuid"), ColumnDef("d", "DATE", generate="date"), ColumnDef("t", "DATETIME", generate="datetime")])
    k.insert("g", [("a",), ("b",)])
    return k.table("g").agg(F.count("*").alias("n"), F.countDistinct("u").alias("uuids"), F.every(c("d").isNotNull() & c("t").isNotNull()).alias("dated"))


@query("table_constraints", "SELECT * FROM (VALUES ('check'), ('not null'), ('primary key'), ('unique'), ('uuid')) v(refused)")
def _(t):
    k = catalog(t)
    k.create_table("p", [ColumnDef("id", "INT", primary_key=True), ColumnDef("mail", "TEXT", unique=True), ColumnDef("age", "INT", check="age >= 0"), ColumnDef("name", "TEXT", not_null=True, default=None), ColumnDef("u", "UUID")])
    k.insert("p", [(1, "a@b.c", 3, "x", None), (2, None, 0, "y", None), (3, None, 1, "z", None)], ["id", "mail", "age", "name", "u"])
    out = []
    for what, row in (("primary key", (1, "n@b.c", 1, "x", None)), ("unique", (4, "a@b.c", 1, "x", None)), ("check", (4, "m@b.c", -1, "x", None)), ("not null", (4, "m@b.c", 1, None, None)), ("uuid", (4, "m@b.c", 1, "x", "no"))):
        try:
            k.insert("p", [row], ["id", "mail", "age", "name", "u"])
        except ConstraintError:
            out.append((what,))
    return t.spark.createDataFrame(out, "refused string")


@query("table_databases", "SELECT * FROM (VALUES ('default', 0), ('sales', 1)) v(database, tables)")
def _(t):
    k = catalog(t)
    k.create_database("sales")
    k.use("sales")
    k.create_table_as("r", t.region)
    out = []
    for r in k.databases().collect():
        k.use(r.database)
        out.append((r.database, len(k.table_names())))
    return t.spark.createDataFrame(out, "database string, tables int")


@query("table_structure", "SELECT * FROM (VALUES ('id', 'INT', FALSE, 'PRIMARY', NULL), ('name', 'TEXT', FALSE, NULL, NULL), ('balance', 'FLOAT', TRUE, NULL, NULL), ('nation', 'INT', TRUE, NULL, '0')) v(\"column\", type, nullable, key, \"default\")")
def _(t):
    return suppliers(t).structure("s")


@query("table_stats", "SELECT 's' AS \"table\", count(*) AS \"rows\", 4 AS \"columns\" FROM supplier")
def _(t):
    return suppliers(t).stats("s").select("table", "rows", "columns")


@query("csv_load", "SELECT * FROM (VALUES (1::BIGINT, 1234.5::DOUBLE, TRUE, DATE '2024-01-02', TIMESTAMP '2024-01-02 03:04:05', 'a, \"b\"'), (2, 7.0, FALSE, NULL, TIMESTAMP '2024-02-02 00:00:00', NULL)) v(n, price, ok, day, \"at\", note)")
def _(t):
    path = f"{shared_dir(t.spark)}/csv-{uuid.uuid4().hex}"
    lines = ["n,price,ok,day,at,note", '1,"1,234.5",yes,2024-01-02,2024-01-02 03:04:05,"a, ""b"""', "2,7,no,NULL,2024-02-02 00:00:00,", "3,only three"]
    t.spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(path)
    k = catalog(t)
    k.load_csv(path, "c")
    return k.table("c")


@query("csv_bad_lines", "SELECT 2 AS loaded, 1 AS bad")
def _(t):
    path = f"{shared_dir(t.spark)}/csv-{uuid.uuid4().hex}"
    t.spark.createDataFrame([("a;b",), ("1;x",), ("2;y;z",), ("3;w",)], "value string").coalesce(1).write.text(path)
    good, bad, _ = catalog(t).load_csv(path, "c", delimiter=";")
    return t.spark.createDataFrame([(good, bad)], "loaded int, bad int")
