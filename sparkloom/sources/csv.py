"""CSV loading with the dialect's type inference and value coercion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.plans.staging import stage
from sparkloom.types import TYPES

BAD = "_bad_line"
# --- fixed values: what counts as no value, a number, a truth value, a date ---
_NULLS = ("", "null", "NULL", "Null")
_INT, _FLOAT = r"^[+-]?\d{1,3}(,\d{3})+$|^[+-]?\d+$", r"^[+-]?(\d{1,3}(,\d{3})+|\d+)?(\.\d+)?([eE][+-]?\d+)?$"
_TRUE, _FALSE = ("true", "yes", "t", "1"), ("false", "no", "f", "0")
_DATETIME, _DATE = r"^\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}(:\d{2}(\.\d+)?)?$", r"^\d{4}-\d{2}-\d{2}$"


def read_text(spark: SparkSession, path: str, header: bool = True, delimiter: str = ",", columns: list[str] | None = None) -> DataFrame:
    """All columns as text, plus the raw line where a line doesn't fit."""
    if len(delimiter) != 1:
        raise ValueError("the delimiter is one character")
    opts = {"sep": delimiter, "quote": '"', "escape": '"', "mode": "PERMISSIVE", "header": str(header).lower(), "columnNameOfCorruptRecord": BAD, "enforceSchema": "true"}
    names = columns or spark.read.options(**opts).csv(path).columns
    schema = T.StructType([*[T.StructField(n, T.StringType()) for n in names], T.StructField(BAD, T.StringType())])
    return spark.read.options(**opts).schema(schema).csv(path)


def _value(c: str) -> Column:
    v = F.trim(F.col(c))
    return F.when(~v.isin(*_NULLS), v)


def infer(text: DataFrame) -> dict[str, str]:
    """INT, FLOAT, BOOL, DATETIME, DATE or TEXT for each column; datetimes before dates.

    One aggregation over all lines that fit: no later value can be of another type than the first ones.
    """
    cols = [c for c in text.columns if c != BAD]
    head = text.where(F.col(BAD).isNull())
    kinds = (("INT", lambda v: v.rlike(_INT)), ("FLOAT", lambda v: v.rlike(_FLOAT) & v.rlike(r"\d")), ("BOOL", lambda v: F.lower(v).isin(*_TRUE, *_FALSE)), ("DATETIME", lambda v: v.rlike(_DATETIME)), ("DATE", lambda v: v.rlike(_DATE)))
    r = head.agg(*[F.every(f(_value(c)) | _value(c).isNull()).alias(f"{i}_{k}") for i, c in enumerate(cols) for k, f in kinds], *[F.count(_value(c)).alias(f"{i}_n") for i, c in enumerate(cols)]).first()
    return {c: next((k for k, _ in kinds if r[f"{i}_n"] and r[f"{i}_{k}"]), "TEXT") for i, c in enumerate(cols)}


def coerce(c: str, kind: str) -> Column:
    """Text to a typed value; what doesn't parse is NULL."""
    v = _value(c)
    if kind in ("INT", "FLOAT"):
        return F.regexp_replace(v, ",", "").try_cast(TYPES[kind]).alias(c)
    if kind == "BOOL":
        return F.when(F.lower(v).isin(*_TRUE), True).when(F.lower(v).isin(*_FALSE), False).alias(c)
    if kind == "DATETIME":
        return F.try_to_timestamp(F.regexp_replace(v, "T", " ")).cast("timestamp_ntz").alias(c)
    if kind == "DATE":
        return v.try_cast("date").alias(c)
    return v.cast(TYPES[kind.upper()]).alias(c)


def load(spark: SparkSession, path: str, header: bool = True, delimiter: str = ",", types: dict[str, str] | None = None, columns: list[str] | None = None) -> tuple[DataFrame, DataFrame, int]:
    """Typed rows, the lines left out because they don't fit, and how many values are NULL because they aren't of the given types."""
    # staged: a query of the raw lines alone isn't allowed on the source itself, and inference would read it again
    text = stage(read_text(spark, path, header, delimiter, columns), "csv")
    kinds = types or infer(text)
    bad = text.select(*text.columns).where(F.col(BAD).isNotNull()).select(BAD)
    fits, names = text.where(F.col(BAD).isNull()), [c for c in text.columns if c != BAD]
    good = fits.select(*[coerce(c, kinds[c]) for c in names])
    lost = [F.count_if(_value(c).isNotNull() & coerce(c, kinds[c]).isNull()) for c in names]
    return good, bad, int(fits.agg(sum(lost[1:], lost[0])).first()[0]) if types else 0
