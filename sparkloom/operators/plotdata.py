"""Plot-ready frames: what a renderer needs for each plot type, computed where the data are."""

from __future__ import annotations

import html
import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.functions.scalar import haversine, mercator, valid_position
from sparkloom.operators.profile import counted, numeric_columns, quantiles
from sparkloom.operators.stats.correlation import matrix
from sparkloom.operators.stats.information import binned
from sparkloom.plans.ordering import cumulative
from sparkloom.plans.staging import write_text


def classify(df: DataFrame) -> dict[str, str]:
    """Column roles by type and name: latitude, longitude, datetime, boolean, integer, numeric, categorical."""
    out = {}
    for f in df.schema.fields:
        n = f.name.lower()
        if isinstance(f.dataType, T.NumericType) and n in ("lat", "latitude"):
            out[f.name] = "latitude"
        elif isinstance(f.dataType, T.NumericType) and n in ("lon", "lng", "longitude"):
            out[f.name] = "longitude"
        elif isinstance(f.dataType, T.DateType | T.TimestampType | T.TimestampNTZType):
            out[f.name] = "datetime"
        elif isinstance(f.dataType, T.BooleanType):
            out[f.name] = "boolean"
        elif isinstance(f.dataType, T.IntegralType):
            out[f.name] = "integer"
        elif isinstance(f.dataType, T.NumericType):
            out[f.name] = "numeric"
        else:
            out[f.name] = "categorical"
    return out


def suggest(df: DataFrame) -> str:
    """A plot type from the columns' roles alone."""
    roles = list(classify(df).values())
    numbers = sum(r in ("numeric", "integer") for r in roles)
    if "latitude" in roles and "longitude" in roles:
        return "GEO_SCATTER"
    if "datetime" in roles and numbers:
        return "LINE"
    if "categorical" in roles and numbers:
        return "BAR"
    return {0: "PIE", 1: "HISTOGRAM", 2: "SCATTER"}.get(numbers, "CORRELATION")


def default_bins(n: int) -> int:
    return max(5, min(30, int(math.sqrt(n))))


def histogram(df: DataFrame, x: str, bins: int | None = None, running: bool = False) -> DataFrame:
    """bin, low, high, n; with running also the cumulated n."""
    d = df.where(F.col(x).isNotNull())
    bins = bins or default_bins(d.count())
    ends = d.agg(F.min(x).cast("double").alias("lo"), F.max(x).cast("double").alias("hi"))
    w = (F.col("hi") - F.col("lo")) / bins
    out = binned(d, x, bins, "bin").groupBy("bin").agg(F.count("*").alias("n")).join(ends).select("bin", (F.col("lo") + F.col("bin") * w).alias("low"), (F.col("lo") + (F.col("bin") + 1) * w).alias("high"), "n")
    if running:
        from pyspark.sql import Window

        out = out.withColumn("upto", F.sum("n").over(Window.partitionBy().orderBy("bin")))
    return out


def ecdf(df: DataFrame, x: str) -> DataFrame:
    return cumulative(df, x).select(F.col("v").alias("value"), ((F.col("before") + F.col("n")) / F.col("total")).alias("ecdf"))


def kde(df: DataFrame, x: str, points: int = 50) -> DataFrame:
    """Gaussian kernel density on a grid; distinct values are weighted by their counts."""
    c = F.col(x).cast("double")
    s = df.agg(F.count(c).alias("n"), F.stddev_samp(c).alias("s"), F.min(c).alias("lo"), F.max(c).alias("hi")).first()
    h = max(0.1, 1.06 * (s.s or 0.0) * s.n**-0.2) if s.n else 0.1
    step = ((s.hi or 0.0) - (s.lo or 0.0)) / max(points - 1, 1)
    values = df.where(c.isNotNull()).groupBy(c.alias("v")).agg(F.count("*").alias("k"))
    one = values.agg(*[F.sum(F.col("k") * F.exp(-0.5 * F.pow((F.lit((s.lo or 0.0) + i * step) - F.col("v")) / h, 2))).alias(f"d{i}") for i in range(points)])
    scale = max(s.n, 1) * h * math.sqrt(2 * math.pi)
    return one.select(F.explode(F.array(*[F.struct(F.lit((s.lo or 0.0) + i * step).alias("x"), (F.coalesce(F.col(f"d{i}"), F.lit(0.0)) / scale).alias("density")) for i in range(points)])).alias("p")).select("p.*")


def histogram_2d(df: DataFrame, x: str, y: str, bins: int = 10) -> DataFrame:
    """x_bin, y_bin, n: also for contour, surface and wireframe plots."""
    return binned(binned(df.where(F.col(x).isNotNull() & F.col(y).isNotNull()), x, bins, "x_bin"), y, bins, "y_bin").groupBy("x_bin", "y_bin").agg(F.count("*").alias("n"))


def heatmap(df: DataFrame, row: str, column: str, value: str | None = None) -> DataFrame:
    """row, column, value: the mean of value, or counts; long form, so wide tables don't blow up."""
    v = F.avg(value) if value else F.count("*").cast("double")
    return df.groupBy(F.col(row).alias("row"), F.col(column).alias("column")).agg(v.alias("value"))


def boxplot(df: DataFrame, columns: Sequence[str] | None = None, k: float = 1.5) -> DataFrame:
    """column, whisker ends, quartiles, median, number of outliers; all numeric columns by default."""
    columns = list(columns or numeric_columns(df))
    values = counted(df, columns)
    r = k * (F.col("q3") - F.col("q1"))
    inside = F.col("v").between(F.col("q1") - r, F.col("q3") + r)
    both = values.join(quantiles(values, {"q1": 0.25, "median": 0.5, "q3": 0.75}), "column")
    return both.groupBy("column", "q1", "median", "q3").agg(F.min(F.when(inside, F.col("v"))).alias("low"), F.max(F.when(inside, F.col("v"))).alias("high"), F.sum(F.when(inside, 0).otherwise(F.col("n"))).alias("outliers"))


def violin(df: DataFrame, columns: Sequence[str], points: int = 30) -> DataFrame:
    out = None
    for c in columns:
        one = kde(df, c, points).select(F.lit(c).alias("column"), "x", "density")
        out = one if out is None else out.union(one)
    return out


def series(df: DataFrame, x: str, ys: Sequence[str], order: bool = True) -> DataFrame:
    """x, series, value in long form: line, multi-line, area, scatter and stacked bars."""
    out = df.select(F.col(x).alias("x"), F.explode(F.array(*[F.struct(F.lit(y).alias("series"), F.col(y).cast("double").alias("value")) for y in ys])).alias("p")).select("x", "p.*")
    return out.orderBy("x", "series") if order else out


def bar(df: DataFrame, category: str, value: str | None = None) -> DataFrame:
    v = F.sum(value) if value else F.count("*").cast("double")
    return df.groupBy(F.col(category).alias("category")).agg(v.alias("value"))


def pie(df: DataFrame, category: str, value: str | None = None) -> DataFrame:
    """Positive slices with their share."""
    from pyspark.sql import Window

    return bar(df, category, value).where("value > 0").withColumn("share", F.col("value") / F.sum("value").over(Window.partitionBy()))


def correlation(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """a, b, r of the full matrix with its diagonal."""
    cols = list(columns or numeric_columns(df))
    m = matrix(df, cols)
    diagonal = df.sparkSession.createDataFrame([(c, c, 1.0) for c in cols], "a string, b string, r double")
    return m.union(m.select("b", "a", "r")).union(diagonal)


def trend(df: DataFrame, x: str, y: str) -> DataFrame:
    """slope, intercept, r2 of the least-squares line."""
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    return df.agg(F.regr_slope(b, a).alias("slope"), F.regr_intercept(b, a).alias("intercept"), F.regr_r2(b, a).alias("r2"))


def residuals(df: DataFrame, x: str, y: str) -> DataFrame:
    t = trend(df, x, y)
    fit = F.col("intercept") + F.col("slope") * F.col(x)
    return df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).join(t).select(F.col(x).alias("x"), fit.alias("fitted"), (F.col(y) - fit).alias("residual"))


def qq(df: DataFrame, x: str) -> DataFrame:
    """value, theoretical: against the normal distribution at (i - 1/2) / n."""
    from sparkloom.operators.profile import distribution

    return distribution(df, x).select("value", F.col("normal_quantile").alias("theoretical"))


def rescale(df: DataFrame, x: str, kind: str) -> DataFrame:
    """normalize to [0, 1], standardize, or log of positives, in column scaled."""
    c = F.col(x).cast("double")
    if kind == "log":
        return df.withColumn("scaled", F.when(c > 0, F.log(F.when(c > 0, c))))
    s = df.agg(F.min(c).alias("__lo"), F.max(c).alias("__hi"), F.avg(c).alias("__m"), F.stddev_pop(c).alias("__s"))
    top, by = {"normalize": (c - F.col("__lo"), F.col("__hi") - F.col("__lo")), "standardize": (c - F.col("__m"), F.col("__s"))}[kind]
    return df.join(s).withColumn("scaled", F.coalesce(top / F.nullif(by, F.lit(0.0)), F.lit(0.0))).drop("__lo", "__hi", "__m", "__s")


def dashboard(df: DataFrame) -> dict[str, DataFrame]:
    """Named frames for all numeric columns: histogram, box plot, correlation."""
    cols = numeric_columns(df)
    out = {f"histogram_{c}": histogram(df, c) for c in cols}
    if cols:
        out["boxplot"] = boxplot(df, cols)
    if len(cols) > 1:
        out["correlation"] = correlation(df, cols)
    return out


# --- files ---


def svg(rows: list[dict], kind: str, width: int = 640, height: int = 400) -> str:
    """A frame of a few rows as a drawing: bars over categories or bins, else a line or points for each series."""
    names = list(rows[0]) if rows else []
    numbers = [n for n in names if all(isinstance(r[n], (int, float)) and not isinstance(r[n], bool) for r in rows)]
    value = next((n for n in ("value", "n", "density", "residual", "ecdf") if n in numbers), numbers[-1] if numbers else None)
    at = next((n for n in ("x", "category", "low", "bin", "column") if n in names and n != value), names[0] if names else None)
    of = next((n for n in ("series",) if n in names), None)
    if value is None or at is None:
        raise ValueError("nothing to draw: a plot takes a number")
    groups: dict = {}
    for r in rows:
        groups.setdefault(r[of] if of else "", []).append((r[at], float(r[value])))
    places = sorted({x for g in groups.values() for x, _ in g}, key=lambda x: (str(type(x)), x))
    scale = isinstance(places[0], (int, float)) and kind not in ("BAR", "STACKED_BAR", "PIE", "HISTOGRAM")
    lo, hi = (min(places), max(places)) if scale else (0, max(len(places) - 1, 1))
    ys = [y for g in groups.values() for _, y in g]
    low, high = min(0.0, *ys), max(0.0, *ys)
    px = lambda x: 40 + (width - 60) * ((x if scale else places.index(x)) - lo) / ((hi - lo) or 1)
    py = lambda y: height - 30 - (height - 50) * (y - low) / ((high - low) or 1)
    colours = ("#1f77b4", "#ff7f0e", "#2ca02c", "#d62728", "#9467bd", "#8c564b")
    out = [f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}">', f'<line x1="40" y1="{py(0):.1f}" x2="{width - 20}" y2="{py(0):.1f}" stroke="#888"/>']
    for i, (name, points) in enumerate(sorted(groups.items(), key=lambda g: str(g[0]))):
        c = colours[i % len(colours)]
        points.sort(key=lambda p: px(p[0]))
        if kind in ("BAR", "STACKED_BAR", "PIE", "HISTOGRAM", "DISTRIBUTION"):
            wide = max(1.0, (width - 60) / (len(places) + 1) * 0.8)
            out += [f'<rect x="{px(x) - wide / 2:.1f}" y="{min(py(y), py(0)):.1f}" width="{wide:.1f}" height="{abs(py(y) - py(0)):.1f}" fill="{c}"/>' for x, y in points]
        elif kind in ("SCATTER", "QQ", "RESIDUALS"):
            out += [f'<circle cx="{px(x):.1f}" cy="{py(y):.1f}" r="2" fill="{c}"/>' for x, y in points]
        else:
            out.append(f'<polyline fill="none" stroke="{c}" points="' + " ".join(f"{px(x):.1f},{py(y):.1f}" for x, y in points) + '"/>')
        if name:
            out.append(f'<text x="50" y="{20 + 14 * i}" font-size="12" fill="{c}">{html.escape(str(name))}</text>')
    return "\n".join([*out, "</svg>"])


#: Rows of a frame that a drawing takes; larger frames are saved as data.
DRAWN = 100_000


def save(df: DataFrame, path: str, kind: str = "LINE") -> None:
    """By the path's ending: .svg a drawing of the frame, .parquet, .csv and .json its rows, written by the executors."""
    ending = path.rsplit(".", 1)[-1].lower()
    if ending == "svg":
        rows = df.limit(DRAWN + 1).collect()
        if len(rows) > DRAWN:
            raise ValueError(f"a drawing takes {DRAWN} rows; aggregate the plot or save its rows")
        write_text(df.sparkSession, path, svg([r.asDict() for r in rows], kind.upper()))
    elif ending in ("parquet", "csv", "json"):
        df.write.mode("overwrite").option("header", True).format(ending).save(path)
    else:
        raise ValueError("a plot is saved as .svg, .parquet, .csv or .json")


# --- geographic frames ---


def geo_points(df: DataFrame, lat: str, lon: str, *values: str) -> DataFrame:
    """Valid positions with their values: scatter, bubble, line and polygon."""
    return df.where(valid_position(F.col(lat), F.col(lon))).select(F.col(lat).alias("lat"), F.col(lon).alias("lon"), *values)


def geo_grid(df: DataFrame, lat: str, lon: str, size: float, value: str | None = None) -> DataFrame:
    """Cells of size degrees: lat_cell, lon_cell, n, value (mean): heat map, contour and grid."""
    cell = lambda c: (F.floor(F.col(c) / size) * size).cast("double")
    return df.where(valid_position(F.col(lat), F.col(lon))).groupBy(cell(lat).alias("lat_cell"), cell(lon).alias("lon_cell")).agg(F.count("*").alias("n"), (F.avg(value) if value else F.count("*").cast("double")).alias("value"))


def geo_bounds(df: DataFrame, lat: str, lon: str) -> DataFrame:
    return df.where(valid_position(F.col(lat), F.col(lon))).agg(F.min(lat).alias("south"), F.max(lat).alias("north"), F.min(lon).alias("west"), F.max(lon).alias("east"))


def geo_flow(df: DataFrame, from_lat: str, from_lon: str, to_lat: str, to_lon: str) -> DataFrame:
    """Distinct flows with count and great-circle kilometres."""
    a, b, c, d = (F.col(x) for x in (from_lat, from_lon, to_lat, to_lon))
    return df.where(valid_position(a, b) & valid_position(c, d)).groupBy(a.alias("from_lat"), b.alias("from_lon"), c.alias("to_lat"), d.alias("to_lon")).agg(F.count("*").alias("n")).withColumn("km", haversine(F.col("from_lat"), F.col("from_lon"), F.col("to_lat"), F.col("to_lon")))


def geo_regions(df: DataFrame, region: str, value: str) -> DataFrame:
    """Choropleth: region, n, total, mean."""
    return df.groupBy(F.col(region).alias("region")).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.avg(value).alias("mean"))


def geo_mercator(df: DataFrame, lat: str, lon: str) -> DataFrame:
    x, y = mercator(F.col(lat), F.col(lon))
    return df.where(valid_position(F.col(lat), F.col(lon)) & (F.abs(lat) < 90)).withColumn("x", x).withColumn("y", y)
