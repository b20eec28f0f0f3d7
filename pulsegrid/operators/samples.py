"""Selectors and range functions: from raw samples to values on a step grid.

Samples are frames (metric, labels, ts_ms, value); results add series_key and hold one row per series and step. A window of
step t is (t - range, t]. Instead of joining each step to its samples, each sample is sent to the steps whose window holds
it, and one grouping by (series, step) does the rest: work grows with samples times range / step, with a single shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.series import all_match, series_key
from ..functions.timegrid import Grid, bucket, on_grid

NAN = float("nan")
LOOKBACK = 300_000
#: From this many steps to a window on, samples are first combined by step.
WIDE = 50
RESULT = ["metric", "labels", "series_key", "ts_ms", "value"]


def keyed(samples: DataFrame) -> DataFrame:
    return samples if "series_key" in samples.columns else samples.withColumn("series_key", series_key("metric", "labels"))


def select(samples: DataFrame, metric: str | None = None, matchers: list[tuple[str, str, str]] = ()) -> DataFrame:
    """Samples of the series that a selector names: name{matcher, ...}."""
    ok = all_match(F.col("metric"), F.col("labels"), list(matchers))
    return samples.where(ok if metric is None else (F.col("metric") == metric) & ok)


def union_of(samples: DataFrame, selectors: list[tuple[str | None, list[tuple[str, str, str]]]]) -> DataFrame:
    """Samples that any of several selectors names, each once."""
    conditions = [all_match(F.col("metric"), F.col("labels"), ([("__name__", "=", m)] if m else []) + list(ms)) for m, ms in selectors]
    return samples.where(reduce(lambda a, b: a | b, conditions, F.lit(False)))


def discover(catalogue: DataFrame, start: int, end: int, metric: str | None = None, matchers: list[tuple[str, str, str]] = ()) -> DataFrame:
    """Distinct series (series_key, metric, labels) seen in [start, end]."""
    rows = select(catalogue, metric, matchers).where((F.col("ts_start") <= end) & (F.col("ts_end") >= start))
    return keyed(rows).groupBy("series_key").agg(F.first("metric").alias("metric"), F.first("labels").alias("labels"))


def with_kind(samples: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Samples with event_type from the catalogue, GAUGE where it has no entry: one join, not a query a series."""
    kinds = keyed(catalogue).groupBy("series_key").agg(F.min("event_type").alias("event_type"))
    return keyed(samples).join(kinds, "series_key", "left").withColumn("event_type", F.coalesce("event_type", F.lit("GAUGE")))


def offset(samples: DataFrame, by_ms: int, ts: str = "ts_ms") -> DataFrame:
    """Samples as an offset modifier sees them: those of by_ms ago count as of now."""
    return samples.withColumn(ts, F.col(ts) + by_ms)


def raw_range(samples: DataFrame, grid: Grid, range_ms: int) -> DataFrame:
    """The samples that a bare range selector returns: [start - range, end], in order of time."""
    return keyed(samples).where(F.col("ts_ms").between(grid.start - range_ms, grid.end))


def instant(samples: DataFrame, grid: Grid, lookback: int = LOOKBACK) -> DataFrame:
    """At each step the last sample no older than the look-back, of samples at one time the larger; steps without one have no
    row."""
    return _by_step(samples, grid, lookback).groupBy("series_key", "t").agg(F.first("metric").alias("metric"), F.first("labels").alias("labels"), F.max_by("value", F.struct("ts_ms", "value")).alias("value")).select("metric", "labels", "series_key", F.col("t").alias("ts_ms"), "value")


def _by_step(samples: DataFrame, grid: Grid, range_ms: int) -> DataFrame:
    near = keyed(samples).where((F.col("ts_ms") > grid.start - range_ms) & (F.col("ts_ms") <= grid.end))
    return near.withColumn("t", F.explode(grid.reached(F.col("ts_ms"), F.col("ts_ms") + range_ms - 1)))


def _with_before(samples: DataFrame) -> DataFrame:
    """Samples with before_ms and before, the sample before in their series (by time, then value). So two neighbours are one
    row, and a window's last two samples are a maximum that is combined before the shuffle, not a list."""
    w = Window.partitionBy("series_key").orderBy("ts_ms", "value")
    return keyed(samples).withColumn("before_ms", F.lag("ts_ms").over(w)).withColumn("before", F.lag("value").over(w))


def _last_with_before(range_ms: int) -> tuple[Column, Column]:
    """The last sample of a group by step t, and whether the one before it is in the window, too."""
    last = F.max(F.struct("ts_ms", "value", "before_ms", "before"))
    return last, last["before_ms"] > F.max("t") - range_ms


def of_kind(samples: DataFrame, kind: str) -> DataFrame:
    """samples; if they have an event_type (with_kind), one of another kind fails the query."""
    if "event_type" not in samples.columns:
        return samples
    wrong = F.raise_error(F.concat(F.lit(f"not a {kind} but a "), F.col("event_type"), F.lit(": "), F.col("metric"))).cast("boolean")
    return samples.where(F.when(F.col("event_type") == kind, F.lit(True)).otherwise(wrong))


def _gap(a: Column, b: Column) -> Column:
    """Seconds between two points, one at least."""
    return F.greatest((a - b) / 1000, F.lit(1.0))


def _exact_parts(v: Column) -> dict[str, Column]:
    """Aggregates of v that _exact makes a sum of: d is its sum in decimals, x tells whether that is exact (every value equals
    its decimal of 18 digits before the point and 20 after it, and the sum fits), a the sum in floating point."""
    d = v.try_cast("decimal(38,20)")
    fits = F.bool_and(F.coalesce(d.cast("double") == v, v.isNull()))
    return {"d": F.try_sum(d), "x": F.when(F.count(v) > 0, fits & F.try_sum(d).isNotNull()), "a": F.sum(v)}


def _exact(over) -> Column:
    """The sum that does not depend on the order of its values, which floor, comparisons and rest would make visible; in
    floating point where there is no exact one. over combines a part by name."""
    return F.coalesce(F.when(over(F.bool_and, "x"), over(F.try_sum, "d").cast("double")), over(F.sum, "a"))


def _functions(q: float | None) -> dict[str, tuple[Column, float]]:
    """Aggregate and the value of an empty window, for gauges."""
    v, ts, n = F.col("value"), F.col("ts_ms"), F.count("value")
    parts = _exact_parts(v)
    total = _exact(lambda _, part: parts[part])
    last, first = F.max_by(v, F.struct(ts, v)), F.min_by(v, F.struct(ts, v))
    # a line by least squares over seconds from the step; a window of one time has none
    x = (ts - F.col("t")) / 1000
    ahead = F.regr_intercept(v, x) + F.regr_slope(v, x) * F.lit(0.0 if q is None else float(q))
    return {
        "avg_over_time": (F.try_divide(total, n), NAN), "min_over_time": (F.min(v), NAN), "max_over_time": (F.max(v), NAN),
        "sum_over_time": (total, 0.0), "count_over_time": (n.cast("double"), 0.0), "last_over_time": (last, NAN),
        "present_over_time": (F.lit(1.0), 0.0), "quantile_over_time": (F.percentile(v, F.lit(0.5 if q is None else q)), NAN),
        "stddev_over_time": (F.stddev_pop(v), NAN), "stdvar_over_time": (F.var_pop(v), NAN),
        "delta": (last - first, NAN), "deriv": (F.when(n > 1, (last - first) / _gap(F.max(ts), F.min(ts))), NAN),
        "predict_linear": (F.when(F.max(ts) > F.min(ts), ahead), NAN),
    }


def _combined(function: str, range_ms: int):
    """For functions that parts of a window can be combined for: parts by name, the whole from a function that combines a part
    over the window, and the value of an empty window; else None."""
    v, n = F.col("value"), {"n": F.count("value").cast("double")}
    total, points, exact = {"a": F.sum("value")}, {"a": F.max(F.struct("ts_ms", "value"))}, _exact_parts(v)
    return {
        "sum_over_time": (exact, _exact, 0.0), "increase": (total, lambda over: over(F.sum, "a"), 0.0),
        "rate": (total, lambda over: over(F.sum, "a") / (range_ms / 1000), 0.0), "count_over_time": (n, lambda over: over(F.sum, "n"), 0.0),
        "min_over_time": ({"a": F.min(v)}, lambda over: over(F.min, "a"), NAN), "max_over_time": ({"a": F.max(v)}, lambda over: over(F.max, "a"), NAN),
        "avg_over_time": (exact | n, lambda over: F.try_divide(_exact(over), over(F.sum, "n")), NAN), "last_over_time": (points, lambda over: over(F.max, "a")["value"], NAN),
        "present_over_time": (n, lambda over: F.when(over(F.sum, "n") > 0, 1.0), 0.0),
    }.get(function)


def over_time(samples: DataFrame, grid: Grid, range_ms: int, function: str, q: float | None = None) -> DataFrame:
    """A range function of gauges at every step, for every series that has a sample in [start - range, end].

    q is the rank of quantile_over_time, or the seconds from the step on of predict_linear. An empty window gives 0 for sums,
    counts and presence, NaN for the rest. Values that are NaN count as values. Samples that with_kind shows to be no gauges
    fail the query.
    """
    near = raw_range(of_kind(samples, "GAUGE"), grid, range_ms)
    series = near.groupBy("series_key").agg(F.first("metric").alias("metric"), F.first("labels").alias("labels"))
    if _is_wide(grid, range_ms, function):
        return _wide(near, series, grid, range_ms, function)
    if function in ("changes", "resets"):
        hit = F.col("value") != F.col("before") if function == "changes" else F.col("value") < F.col("before")
        inside = F.col("before_ms") > F.col("t") - range_ms
        by = _by_step(_with_before(near), grid, range_ms).groupBy("series_key", "t").agg(F.sum(F.when(inside & hit, 1.0).otherwise(0.0)).alias("value"))
        return _complete(by, series, grid, NAN)
    if function == "idelta":
        last, both = _last_with_before(range_ms)
        by = _by_step(_with_before(near), grid, range_ms).groupBy("series_key", "t").agg(F.when(both, last["value"] - last["before"]).alias("value"))
        return _complete(by, series, grid, NAN)
    aggregate, empty = _functions(q)[function]
    by = _by_step(near, grid, range_ms).groupBy("series_key", "t").agg(aggregate.alias("value"))
    return _complete(by, series, grid, empty)


def _complete(by: DataFrame, series: DataFrame, grid: Grid, empty: float) -> DataFrame:
    """One row for each series and step. Both sides are by series, and the steps a side has are few next to its samples."""
    full = on_grid(series, grid)
    joined = full.join(by.withColumnRenamed("t", "ts_ms"), ["series_key", "ts_ms"], "left")
    return joined.select("metric", "labels", "series_key", "ts_ms", F.coalesce("value", F.lit(empty)).alias("value"))


def _is_wide(grid: Grid, range_ms: int, function: str) -> bool:
    return _combined(function, range_ms) is not None and range_ms % grid.step == 0 and range_ms // grid.step >= WIDE


def _wide(near: DataFrame, series: DataFrame, grid: Grid, range_ms: int, function: str) -> DataFrame:
    """Windows of very many steps: samples are combined by step, then a frame runs over the steps."""
    parts, whole, empty = _combined(function, range_ms)
    cell = (F.ceil((F.col("ts_ms") - grid.start) / grid.step) * grid.step + grid.start).cast("long")
    by = near.withColumn("t", cell).groupBy("series_key", "t").agg(*[part.alias(name) for name, part in parts.items()])
    # steps before the grid feed its first windows
    early = Grid(grid.start - range_ms + grid.step, grid.end, grid.step)
    rows = on_grid(series, early).join(by.withColumnRenamed("t", "ts_ms"), ["series_key", "ts_ms"], "left")
    w = Window.partitionBy("series_key").orderBy("ts_ms").rangeBetween(-(range_ms - grid.step), 0)
    out = rows.withColumn("value", F.coalesce(whole(lambda f, part: f(part).over(w)), F.lit(empty)))
    return out.where(F.col("ts_ms") >= grid.start).select(*RESULT)


# -- counters ----------------------------------------------------------------------------------------------------------


def to_deltas(sums: DataFrame) -> DataFrame:
    """Cumulative sums as deltas: the difference to the point before, or the whole value after a reset and at the start."""
    w = Window.partitionBy(series_key("metric", "labels")).orderBy("ts_end", "ts_start")
    change = F.col("value") - F.lag("value").over(w)
    return sums.withColumn("value", F.when(change >= 0, change).otherwise(F.col("value"))).withColumn("temporality", F.lit("DELTA"))


def delta_samples(sums: DataFrame) -> DataFrame:
    """Samples from sums: delta series as they are; of series that have only cumulative points, their differences."""
    rows = keyed(sums)
    w = Window.partitionBy("series_key")
    rows = rows.withColumn("has_delta", F.max(F.col("temporality") == "DELTA").over(w))
    delta = rows.where("temporality = 'DELTA'")
    rest = to_deltas(rows.where("not has_delta"))
    return delta.unionByName(rest).select("metric", "labels", "series_key", F.col("ts_end").alias("ts_ms"), F.col("value").cast("double").alias("value"))


def counter_function(deltas: DataFrame, grid: Grid, range_ms: int, function: str) -> DataFrame:
    """increase, rate and irate over per-interval deltas; no extrapolation. Empty: 0, 0, NaN. Samples that with_kind shows to be
    no sums fail the query."""
    near = raw_range(of_kind(deltas, "SUM"), grid, range_ms)
    series = near.groupBy("series_key").agg(F.first("metric").alias("metric"), F.first("labels").alias("labels"))
    if _is_wide(grid, range_ms, function) and function in ("increase", "rate"):
        return _wide(near, series, grid, range_ms, function)
    if function in ("increase", "rate"):
        seconds = range_ms / 1000 if function == "rate" else 1.0
        by = _by_step(near, grid, range_ms).groupBy("series_key", "t").agg((F.sum("value") / seconds).alias("value"))
        return _complete(by, series, grid, 0.0)
    if function != "irate":
        raise ValueError(f"not a function of counters: {function}")
    last, both = _last_with_before(range_ms)
    by = _by_step(_with_before(near), grid, range_ms).groupBy("series_key", "t").agg(F.when(both, last["value"] / _gap(last["ts_ms"], last["before_ms"])).alias("value"))
    return _complete(by, series, grid, NAN)


def subquery(inner: DataFrame, by_ms: int = 0) -> DataFrame:
    """The result of an inner evaluation on its own finer grid, as samples for a range function; offset as asked."""
    return offset(inner, by_ms) if by_ms else inner


def inner_grid(grid: Grid, range_ms: int, step_ms: int, by_ms: int = 0) -> Grid:
    """The grid that a subquery's inner expression is evaluated on: steps are multiples of step_ms."""
    start = grid.start - range_ms - by_ms
    return Grid(start - start % step_ms, grid.end - by_ms, step_ms)


# -- functions of instant vectors --------------------------------------------------------------------------------------

_ONE: dict[str, object] = {
    "abs": F.abs, "ceil": lambda v: F.ceil(v).cast("double"), "floor": lambda v: F.floor(v).cast("double"), "round": F.rint,
    "exp": F.exp, "ln": F.ln, "log2": F.log2, "log10": F.log10, "sqrt": F.sqrt, "sgn": F.signum, "sin": F.sin, "cos": F.cos,
    "tan": F.tan, "asin": F.asin, "acos": F.acos, "atan": F.atan, "sinh": F.sinh, "cosh": F.cosh, "tanh": F.tanh,
    "acosh": F.acosh, "asinh": F.asinh, "atanh": F.atanh, "deg": F.degrees, "rad": F.radians,
}
_LOGS = ("ln", "log2", "log10")
_DATES: dict[str, object] = {
    "minute": F.minute, "hour": F.hour, "day_of_month": F.dayofmonth, "day_of_week": lambda t: F.dayofweek(t) - 1,
    "day_of_year": F.dayofyear, "month": F.month, "year": F.year, "days_in_month": lambda t: F.dayofmonth(F.last_day(t)),
}


def map_values(vector: DataFrame, function: str, *bounds: float) -> DataFrame:
    """A function of each value: those of one argument, clamp, clamp_min, clamp_max, and the parts of a date in seconds."""
    v = F.col("value")
    if function in _ONE:
        # logarithms and roots outside their domain are NaN here and NULL in Spark, logarithms of zero are -infinity
        out = F.coalesce(_ONE[function](v), F.when(v == 0, F.lit(float("-inf"))) if function in _LOGS else F.lit(NAN), F.lit(NAN))
    elif function in _DATES:
        out = _DATES[function](F.timestamp_seconds(v)).cast("double")
    elif function == "clamp":
        out = F.least(F.greatest(v, F.lit(bounds[0])), F.lit(bounds[1]))
    elif function == "clamp_min":
        out = F.greatest(v, F.lit(bounds[0]))
    elif function == "clamp_max":
        out = F.least(v, F.lit(bounds[0]))
    else:
        raise ValueError(f"unknown function {function}")
    return vector.withColumn("value", F.when(F.isnan(v), v).otherwise(out))


def timestamps(vector: DataFrame) -> DataFrame:
    """timestamp(v): each step's time in seconds."""
    return vector.withColumn("value", F.col("ts_ms") / 1000.0)


def times(samples: DataFrame, grid: Grid) -> DataFrame:
    """time(): a scalar a step, (ts_ms, value)."""
    return samples.sparkSession.range(1).select(F.explode(grid.times()).alias("ts_ms")).withColumn("value", F.col("ts_ms") / 1000.0)


def constant(samples: DataFrame, grid: Grid, value: float) -> DataFrame:
    """A fixed scalar as a series without labels: vector(2)."""
    return vector(times(samples, grid).withColumn("value", F.lit(float(value))))


def vector(scalars: DataFrame) -> DataFrame:
    """vector(s): a scalar (ts_ms, value) as a series without labels."""
    return scalars.select(F.lit("").alias("metric"), F.create_map().cast("map<string,string>").alias("labels"), F.lit("{}").alias("series_key"), "ts_ms", "value")


def scalar(vector: DataFrame, grid: Grid) -> DataFrame:
    """scalar(v): the value of the only series at each step, NaN where there is none or more than one."""
    by = vector.groupBy("ts_ms").agg(F.when(F.count("*") == 1, F.first("value")).otherwise(NAN).alias("value"))
    steps = vector.sparkSession.range(1).select(F.explode(grid.times()).alias("ts_ms"))
    return steps.join(by, "ts_ms", "left").select("ts_ms", F.coalesce("value", F.lit(NAN)).alias("value"))


def absent(vector: DataFrame, grid: Grid, labels: dict[str, str] | None = None) -> DataFrame:
    """absent(v): 1 at each step at which no series has a value."""
    steps = vector.sparkSession.range(1).select(F.explode(grid.times()).alias("ts_ms"))
    out = steps.join(vector.select("ts_ms").distinct(), "ts_ms", "left_anti")
    pairs = [F.lit(x) for kv in (labels or {}).items() for x in kv]
    named = (F.create_map(*pairs) if pairs else F.create_map()).cast("map<string,string>")
    return out.select(F.lit("absent").alias("metric"), named.alias("labels"), series_key(F.lit("absent"), named).alias("series_key"), "ts_ms", F.lit(1.0).alias("value"))


def absent_over_time(samples: DataFrame, grid: Grid, range_ms: int, labels: dict[str, str] | None = None) -> DataFrame:
    """absent_over_time(v[range]): 1 at each step whose window holds no sample of any series."""
    return absent(_by_step(samples, grid, range_ms).select(F.col("t").alias("ts_ms")), grid, labels)


def sort(vector: DataFrame, descending: bool = False) -> DataFrame:
    """sort and sort_desc: by value, then series and time."""
    return vector.orderBy(F.desc("value") if descending else F.asc("value"), "series_key", "ts_ms")


def to_matrix(vector: DataFrame) -> DataFrame:
    """One row per series, with its points in order of time."""
    return vector.groupBy("series_key").agg(F.first("metric").alias("metric"), F.first("labels").alias("labels"), F.array_sort(F.collect_list(F.struct("ts_ms", "value"))).alias("points"))


def points_between(vector: DataFrame, start: int, end: int) -> DataFrame:
    """The slice [start, end) of every series."""
    return vector.where((F.col("ts_ms") >= start) & (F.col("ts_ms") < end))


def points_at(vector: DataFrame, ts: int) -> DataFrame:
    return vector.where(F.col("ts_ms") == ts)


def tumbling(samples: DataFrame, size: int, aggregate: Column) -> DataFrame:
    """An aggregate per series and tumbling bucket."""
    return keyed(samples).groupBy("series_key", bucket(F.col("ts_ms"), size).alias("ts_ms")).agg(aggregate.alias("value"))
