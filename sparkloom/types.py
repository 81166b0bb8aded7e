"""Types of the SQL dialect and table schemas with constraints kept in field metadata."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

#: Dialect type name to Spark type.
TYPES: dict[str, T.DataType] = {
    "INT": T.LongType(), "INTEGER": T.LongType(), "BIGINT": T.LongType(),
    "FLOAT": T.DoubleType(), "DOUBLE": T.DoubleType(), "REAL": T.DoubleType(),
    "STRING": T.StringType(), "TEXT": T.StringType(), "VARCHAR": T.StringType(), "UUID": T.StringType(),
    "BOOL": T.BooleanType(), "BOOLEAN": T.BooleanType(),
    "DATE": T.DateType(), "DATETIME": T.TimestampNTZType(), "TIMESTAMP": T.TimestampNTZType(),
}

UUID_PATTERN = "^[0-9a-fA-F]{8}-([0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$"


@dataclass
class ColumnDef:
    """One column of CREATE TABLE with its constraints."""

    name: str
    type: str
    not_null: bool = False
    unique: bool = False
    primary_key: bool = False
    auto_increment: bool = False
    default: object = None
    check: str | None = None
    generate: str | None = None  # date | datetime | uuid
    extra: dict = field(default_factory=dict)

    @property
    def spark_type(self) -> T.DataType:
        try:
            return TYPES[self.type.upper()]
        except KeyError:
            raise ValueError(f"unknown type {self.type}") from None

    def field(self) -> T.StructField:
        meta = {k: getattr(self, k) for k in ("not_null", "unique", "primary_key", "auto_increment", "default", "check", "generate") if getattr(self, k) is not None and getattr(self, k) is not False}
        return T.StructField(self.name, self.spark_type, True, {"dialect_type": self.type.upper(), **meta})

    @staticmethod
    def of(f: T.StructField) -> ColumnDef:
        m = f.metadata or {}
        back = {T.LongType: "INT", T.IntegerType: "INT", T.DoubleType: "FLOAT", T.FloatType: "FLOAT", T.StringType: "TEXT", T.BooleanType: "BOOL", T.DateType: "DATE"}
        kind = m.get("dialect_type") or back.get(type(f.dataType), "DATETIME" if "timestamp" in f.dataType.simpleString() else "TEXT")
        return ColumnDef(f.name, kind, **{k: m[k] for k in ("not_null", "unique", "primary_key", "auto_increment", "default", "check", "generate") if k in m})


def schema(columns: list[ColumnDef]) -> T.StructType:
    if len({c.name.lower() for c in columns}) != len(columns):
        raise ValueError("column names must differ")
    if sum(c.primary_key for c in columns) > 1:
        raise ValueError("one primary key column at most")
    return T.StructType([c.field() for c in columns])
