"""Scalar functions of the dialect as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0


def substr(s: Column, start: Column | int, length: Column | int | None = None) -> Column:
    """1-based; a start before 1 or behind the text and a negative length give ''."""
    st = F.lit(start) if isinstance(start, int) else start
    n = F.length(s) if length is None else F.lit(length) if isinstance(length, int) else length
    return F.when(s.isNull() | st.isNull() | n.isNull(), None).when((st < 1) | (st > F.length(s)) | (n < 0), "").otherwise(F.substring(s, st, n))


def concat(*parts: Column) -> Column:
    """NULL if any part is NULL."""
    return F.concat(*[p.cast("string") for p in parts])


def length(s: Column) -> Column:
    """Bytes."""
    return F.octet_length(s).cast("long")


def ascii_upper(s: Column) -> Column:
    return F.translate(s, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def ascii_lower(s: Column) -> Column:
    return F.translate(s, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def moment_of(d: Column) -> Column:
    """A timestamp from a date, a timestamp, or text in YYYY-MM-DD [HH:MM:SS]; NULL for other text."""
    return F.try_to_timestamp(d.cast("string"))


def year(d: Column) -> Column:
    return F.year(moment_of(d))


def month(d: Column) -> Column:
    return F.month(moment_of(d))


def day(d: Column) -> Column:
    return F.dayofmonth(moment_of(d))


def julianday(d: Column) -> Column:
    """Days since noon on 24 November 4714 BC (Gregorian), as a double."""
    t = moment_of(d)
    seconds = F.hour(t) * 3600 + F.minute(t) * 60 + F.second(t)
    return F.unix_date(t.cast("date")) + F.lit(2440587.5) + seconds / F.lit(86400.0)


def from_julianday(j: Column) -> Column:
    return F.timestamp_seconds(F.round((j - F.lit(2440587.5)) * 86400))


def add_days(t: Column, n: int) -> Column:
    return t + F.make_interval(days=F.lit(n))


def add_hours(t: Column, n: int) -> Column:
    return t + F.make_interval(hours=F.lit(n))


def add_minutes(t: Column, n: int) -> Column:
    return t + F.make_interval(mins=F.lit(n))


def add_months(t: Column, n: int) -> Column:
    """The end of a shorter month is kept."""
    return t + F.make_interval(months=F.lit(n))


def like_pattern(p: str) -> str:
    r"""A regular expression for LIKE with %, _, [a-z], [^...] and \ escapes, anchored."""
    out, i = ["(?s)^"], 0
    while i < len(p):
        c = p[i]
        if c == "%":
            out.append(".*")
        elif c == "_":
            out.append(".")
        elif c == "\\" and i + 1 < len(p):
            i += 1
            out.append("\\" + p[i] if not p[i].isalnum() else p[i])
        elif c == "[" and (end := p.find("]", i + 2)) > 0:
            body = p[i + 1 : end].replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&")
            out.append(f"[{body}]")
            i = end
        else:
            out.append("\\" + c if not c.isalnum() and ord(c) < 128 and not c.isspace() else c)
        i += 1
    return "".join(out) + "$"


def like(s: Column, p: str) -> Column:
    """Plain patterns stay LIKE, so that a scan can use their prefix; classes become a regular expression."""
    return s.rlike(like_pattern(p)) if "[" in p else s.like(p)


def string_hash(s: Column, buckets: int = 1000) -> Column:
    """A stable category number for text."""
    return F.pmod(F.xxhash64(s), F.lit(buckets))


def transform_feature(x: Column, kind: str, mean: float = 0.0, sd: float = 1.0, low: float = 0.0, high: float = 1.0) -> Column:
    """direct, normalize, standardize, log, binary, sigmoid."""
    x = x.cast("double")
    return {
        "direct": x,
        "normalize": (x - low) / (high - low) if high != low else F.lit(0.0),
        "standardize": (x - mean) / sd if sd else F.lit(0.0),
        "log": F.log(x + 1),
        "binary": F.when(x > 0.5, 1.0).otherwise(0.0),
        "sigmoid": 1 / (1 + F.exp(-x)),
    }[kind]


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle kilometres."""
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin((F.radians(lon2) - F.radians(lon1)) / 2), 2)
    return F.lit(2 * EARTH_KM) * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def mercator(lat: Column, lon: Column) -> tuple[Column, Column]:
    """x and y on the unit sphere's Mercator plane, in radians."""
    return F.radians(lon), F.log(F.tan(F.lit(0.7853981633974483) + F.radians(lat) / 2))


def valid_position(lat: Column, lon: Column) -> Column:
    return lat.between(-90, 90) & lon.between(-180, 180)


_FILTER = re.compile(r"""^\s*`?(\w+)`?\s+(IS\s+NOT\s+NULL|IS\s+NULL)\s*$|^\s*`?(\w+)`?\s*(==|=|!=|<>|<=|>=|<|>|LIKE)\s*(.+?)\s*$""", re.I | re.S)


def simple_filter(text: str) -> Column:
    """The one-condition filter language: column, operator, value; LIKE with % at the ends only."""
    m = _FILTER.match(text)
    if m is None:
        raise ValueError(f"bad filter {text!r}")
    if m[1]:
        return F.col(m[1]).isNotNull() if "NOT" in m[2].upper() else F.col(m[1]).isNull()
    c, op, raw = F.col(m[3]), m[4].upper(), m[5]
    value: object = raw
    if raw[:1] in "'\"" and raw[-1:] == raw[:1] and len(raw) > 1:
        value = raw[1:-1]
    elif re.fullmatch(r"[+-]?\d+", raw):
        value = int(raw)
    elif re.fullmatch(r"[+-]?(\d+\.\d*|\.\d+|\d+)([eE][+-]?\d+)?", raw):
        value = float(raw)
    if op == "LIKE":
        s = str(value)
        core = s.strip("%")
        if s.startswith("%") and s.endswith("%") and len(s) > 1:
            return c.contains(core)
        return c.startswith(core) if s.endswith("%") else c.endswith(core) if s.startswith("%") else c == core
    return {"=": c == value, "==": c == value, "!=": c != value, "<>": c != value, "<": c < value, "<=": c <= value, ">": c > value, ">=": c >= value}[op]
