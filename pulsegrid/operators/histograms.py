"""Explicit-bound histograms: differences, merging, quantiles and their range function.

A histogram has n ascending bounds and n + 1 counts; the last bucket is open. Merging histograms of equal bounds is a sum by
bucket. Unequal bounds are merged on the union of bounds by interpolated cumulative counts, in a grouped function that gets
one group's few distinct layouts, already summed.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.series import drop_labels, label_text, series_key
from ..functions.timegrid import Grid

NAN = float("nan")


def total(counts: Column | str) -> Column:
    return F.aggregate(counts, F.lit(0).cast("long"), lambda a, c: a + c)


def overlapping(histograms: DataFrame, start: int, end: int, temporality: str | None = None) -> DataFrame:
    """Points whose interval overlaps (start, end), bounds excluded."""
    rows = histograms.where((F.col("ts_start") < end) & (F.col("ts_end") > start))
    return rows if temporality is None else rows.where(F.col("temporality") == temporality)


def to_deltas(histograms: DataFrame) -> DataFrame:
    """Cumulative points as deltas, bucket by bucket; a bucket that fell was reset and keeps its count. The first point and
    points with another number of buckets than the one before pass as they are."""
    w = Window.partitionBy(series_key("metric", "labels")).orderBy("ts_end", "ts_start")
    before = F.lag("counts").over(w)
    change = F.zip_with("counts", before, lambda c, p: F.when(c - p < 0, c).otherwise(c - p))
    same = F.coalesce(F.size(before) == F.size("counts"), F.lit(False))
    return histograms.withColumn("before", before).withColumn("counts", F.when(same, change).otherwise(F.col("counts"))).drop("before").withColumn("temporality", F.lit("DELTA"))


def sum_by(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: bounds and counts of all histograms merged, with ts_start and ts_end. Every row needs bounds and counts."""
    layout = F.to_json("bounds")
    flat = rows.select(*keys, "bounds", layout.alias("layout"), "ts_start", "ts_end", F.posexplode("counts").alias("place", "n"))
    cells = flat.groupBy(*keys, "layout", "place").agg(F.first("bounds").alias("bounds"), F.sum("n").alias("n"), F.min("ts_start").alias("ts_start"), F.max("ts_end").alias("ts_end"))
    counts = F.transform(F.array_sort(F.collect_list(F.struct("place", "n"))), lambda c: c["n"])
    per_layout = cells.groupBy(*keys, "layout").agg(F.first("bounds").alias("bounds"), counts.alias("counts"), F.min("ts_start").alias("ts_start"), F.max("ts_end").alias("ts_end"))
    by = per_layout.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("layout", "bounds", "counts"))).alias("parts"), F.min("ts_start").alias("ts_start"), F.max("ts_end").alias("ts_end"))
    fields = [*keys, "bounds", "counts", "ts_start", "ts_end"]
    same = by.where(F.size("parts") == 1).select(*keys, F.col("parts")[0]["bounds"].alias("bounds"), F.col("parts")[0]["counts"].alias("counts"), "ts_start", "ts_end")
    mixed = by.where(F.size("parts") > 1).withColumn("m", F.pandas_udf(_merge_all, "bounds array<double>, counts array<bigint>")("parts"))
    return same.unionByName(mixed.withColumn("bounds", F.col("m.bounds")).withColumn("counts", F.col("m.counts")).select(*fields))


def merge_layouts(bounds: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """One histogram on the union of bounds. Mass is spread evenly within a finite bucket; below the first bound it lies at
    that bound, above the last one it stays open. Counts are rounded so that the total is kept and none is negative."""
    union = np.unique(np.concatenate(bounds))
    below, open_mass = np.zeros(len(union)), 0.0
    for b, c in zip(bounds, counts, strict=True):
        steps = np.cumsum(c[:-1]).astype(float)
        below += np.interp(union, b, steps, left=0.0, right=steps[-1]) if len(b) else 0
        open_mass += float(c[-1])
    mass = np.diff(np.concatenate([[0.0], below]))
    cells = np.append(np.maximum(mass, 0), open_mass)
    whole, goal = np.floor(cells).astype(np.int64), int(round(sum(float(np.sum(c)) for c in counts)))
    spare = goal - int(whole.sum())
    for i in np.argsort(-(cells - whole), kind="stable")[: max(0, spare)]:
        whole[i] += 1
    return union, whole


def _merge_all(parts: pd.Series) -> pd.DataFrame:
    out = [merge_layouts([np.asarray(x["bounds"], float) for x in p], [np.asarray(x["counts"]) for x in p]) for p in parts]
    return pd.DataFrame({"bounds": [x for x, _ in out], "counts": [x for _, x in out]})


def quantile(q: float, bounds: Column, counts: Column) -> Column:
    """The value at rank q times total: within the first bucket its bound, within the open one the last bound, else by linear
    interpolation in the bucket. No counts give NaN."""
    n = total(counts)
    rank = F.lit(float(q)) * n
    start = F.struct(F.lit(0).alias("i"), F.lit(0).cast("long").alias("before"), F.lit(-1).alias("hit"), F.lit(0).cast("long").alias("at"))
    step = lambda a, c: F.struct((a["i"] + 1).alias("i"), (a["before"] + c).alias("before"), F.when((a["hit"] < 0) & (a["before"] + c >= rank), a["i"]).otherwise(a["hit"]).alias("hit"), F.when((a["hit"] < 0) & (a["before"] + c >= rank), a["before"]).otherwise(a["at"]).alias("at"))
    found = F.aggregate(counts, start, step)
    i, before = found["hit"], found["at"]
    last = F.size(bounds) - 1
    low, high = F.get(bounds, i - 1), F.get(bounds, i)
    inside = F.when(F.get(counts, i) == 0, high).otherwise(low + (high - low) * (rank - before) / F.get(counts, i))
    value = F.when(i <= 0, F.get(bounds, F.lit(0))).when(i > last, F.get(bounds, last)).otherwise(inside)
    return F.when((n == 0) | (F.size(bounds) == 0), F.lit(NAN)).otherwise(value.cast("double"))


def below(x: float, bounds: Column, counts: Column) -> Column:
    """How many observations are at most x: the first bucket lies at its bound, the open one beyond any x, the others are spread
    evenly."""
    n = F.size(bounds)
    cells = F.transform(F.slice(counts, F.lit(1), n), lambda c, i: F.struct(c.alias("c"), F.get(bounds, i).alias("high"), F.get(bounds, i - 1).alias("low")))
    share = lambda b: F.when(b["high"] <= x, 1.0).when(b["low"].isNull() | (b["low"] >= x), 0.0).otherwise((F.lit(float(x)) - b["low"]) / (b["high"] - b["low"]))
    return F.aggregate(cells, F.lit(0.0), lambda a, b: a + b["c"] * share(b))


def fraction(low: float, high: float, bounds: Column, counts: Column) -> Column:
    """The share of observations above low and up to high; no counts give NaN."""
    n = total(counts)
    return F.when((n == 0) | (F.size(bounds) == 0), F.lit(NAN)).otherwise((below(high, bounds, counts) - below(low, bounds, counts)) / n)


def histogram_quantile(q: float, deltas: DataFrame, grid: Grid, range_ms: int) -> DataFrame:
    """At each step: the quantile of all histograms that touch [t - range, t], merged over series that differ in the label
    instance alone. Steps without any give no row."""
    near = deltas.where((F.col("ts_start") <= grid.end) & (F.col("ts_end") >= grid.start - range_ms))
    rows = near.withColumn("group", drop_labels(F.col("labels"), ["instance"])).withColumn("group_key", label_text("group"))
    rows = rows.withColumn("t", F.explode(grid.reached(F.col("ts_start"), F.col("ts_end") + range_ms)))
    merged = sum_by(rows, ["metric", "group_key", "t"])
    names = rows.groupBy("metric", "group_key").agg(F.first("group").alias("labels"))
    out = merged.withColumn("value", quantile(q, F.col("bounds"), F.col("counts"))).join(names, ["metric", "group_key"])
    return out.select("metric", "labels", series_key("metric", "labels").alias("series_key"), F.col("t").alias("ts_ms"), "value")


def counts_of(deltas: DataFrame) -> DataFrame:
    """histogram_count and histogram_sum need no merge: total counts and the mass at bucket bounds, per point."""
    mass = F.aggregate(F.arrays_zip(F.slice("counts", 1, F.size("bounds")).alias("c"), F.col("bounds").alias("b")), F.lit(0.0), lambda a, x: a + x["c"] * x["b"])
    return deltas.select("metric", "labels", "ts_start", "ts_end", total("counts").alias("count"), mass.alias("bounded_sum"))
