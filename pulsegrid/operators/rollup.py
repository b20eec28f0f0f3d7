"""Rollups by second, minute and hour, and the operations on rolled-up series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.timegrid import Grid, bucket, on_grid
from .samples import keyed

SIZES = {"s": 1000, "m": 60_000, "h": 3_600_000}
SKETCH_K = 200


def statistics() -> list[Column]:
    """Count, sum, extremes, population variance and a quantile sketch of a bucket's values."""
    v = F.col("value")
    return [F.count(v).alias("n"), F.sum(v).alias("sum"), F.min(v).alias("min"), F.max(v).alias("max"), F.var_pop(v).alias("var"), F.kll_sketch_agg_double(v, F.lit(SKETCH_K)).alias("sketch")]


def rollup(samples: DataFrame, resolutions: str = "smh") -> DataFrame:
    """One row per series, resolution and bucket. Samples are combined by second first; coarser levels come from the finer."""
    rows = keyed(samples)
    fine = rows.groupBy("series_key", F.lit("s").alias("resolution"), bucket(F.col("ts_ms"), 1000).alias("bucket")).agg(*statistics())
    levels = {"s": fine}
    for name, below in (("m", "s"), ("h", "m")):
        levels[name] = merge(levels[below], SIZES[name], name)
    out = None
    for r in resolutions:
        out = levels[r] if out is None else out.unionByName(levels[r])
    return out


def merge(stats: DataFrame, size: int, resolution: str) -> DataFrame:
    """Coarser buckets from finer ones: sums add, sketches merge, variances combine about the joint mean."""
    by = stats.groupBy("series_key", F.lit(resolution).alias("resolution"), bucket(F.col("bucket"), size).alias("bucket"))
    # total sum of squares: n * var + sum^2 / n of each part
    squares = F.sum(F.col("n") * F.col("var") + F.col("sum") * F.col("sum") / F.col("n"))
    n, s = F.sum("n"), F.sum("sum")
    var = F.greatest(F.lit(0.0), squares / n - (s / n) * (s / n))
    return by.agg(n.alias("n"), s.alias("sum"), F.min("min").alias("min"), F.max("max").alias("max"), var.alias("var"), F.kll_merge_agg_double("sketch").alias("sketch"))


def read(stats: DataFrame, agg: str) -> DataFrame:
    """Values of a rollup: AVG SUM MIN MAX COUNT VAR, and P50 to P99 from the sketch."""
    quantiles = {"P50": 0.5, "P75": 0.75, "P90": 0.9, "P95": 0.95, "P99": 0.99}
    if agg in quantiles:
        value = F.kll_sketch_get_quantile_double("sketch", F.lit(quantiles[agg]))
    else:
        value = {"AVG": F.col("sum") / F.col("n"), "SUM": F.col("sum"), "MIN": F.col("min"), "MAX": F.col("max"), "COUNT": F.col("n").cast("double"), "VAR": F.col("var")}[agg]
    return stats.select("series_key", "resolution", F.col("bucket").alias("ts_ms"), value.alias("value"))


# -- operations on (series_key, ts_ms, value) --------------------------------------------------------------------------


def scan(samples: DataFrame, start: int, end: int, size: int, agg: Column) -> DataFrame:
    rows = keyed(samples).where(F.col("ts_ms").between(start, end))
    return rows.groupBy("series_key", bucket(F.col("ts_ms"), size).alias("ts_ms")).agg(agg.alias("value"))


def scale(series: DataFrame, factor: float) -> DataFrame:
    return series.withColumn("value", F.col("value") * factor)


def add(left: DataFrame, right: DataFrame, keys: tuple[str, ...] = ("ts_ms",)) -> DataFrame:
    """The sum of two series by time; where one has no point it counts as 0."""
    a, b = left.select(*keys, F.col("value").alias("a")), right.select(*keys, F.col("value").alias("b"))
    return a.join(b, list(keys), "full_outer").select(*keys, (F.coalesce("a", F.lit(0.0)) + F.coalesce("b", F.lit(0.0))).alias("value"))


def transform(series: DataFrame, function: str) -> DataFrame:
    """LOG: natural logarithm (-infinity of zero, NaN where there is none); SIGMOID."""
    v = F.col("value")
    out = {"LOG": F.coalesce(F.ln(v), F.when(v == 0, F.lit(float("-inf"))), F.lit(float("nan"))), "SIGMOID": 1 / (1 + F.exp(-v))}[function]
    return series.withColumn("value", out)


def moving(series: DataFrame, window_ms: int, size: int, function: str) -> DataFrame:
    """Moving average or sum at each step of size from a series' first to its last bucket, over [t - window, t]."""
    w = Window.partitionBy("series_key").orderBy("ts_ms").rangeBetween(-window_ms, 0)
    ends = series.groupBy("series_key").agg(F.min("ts_ms").alias("a"), F.max("ts_ms").alias("b"))
    steps = ends.select("series_key", F.explode(F.sequence("a", "b", F.lit(size).cast("long"))).alias("ts_ms"))
    rows = steps.join(series, ["series_key", "ts_ms"], "left")
    agg = {"AVG": F.avg, "SUM": F.sum}[function]
    return rows.withColumn("value", agg("value").over(w)).where("value is not null")


def derivative(series: DataFrame) -> DataFrame:
    """Change a millisecond, from each series' second point on."""
    w = Window.partitionBy("series_key").orderBy("ts_ms")
    out = series.withColumn("d", (F.col("value") - F.lag("value").over(w)) / (F.col("ts_ms") - F.lag("ts_ms").over(w)))
    return out.where("d is not null").select("series_key", "ts_ms", F.col("d").alias("value"))


def total(series: DataFrame) -> DataFrame:
    return series.groupBy("series_key").agg(F.sum("value").alias("value"))


def matrix(series: DataFrame, grid: Grid) -> DataFrame:
    """Every series at every step of the grid, missing points as NULL."""
    return on_grid(series.select("series_key").distinct(), grid).join(series, ["series_key", "ts_ms"], "left")
