"""Structured metric requests: gauges, sums, histograms, hints, search, exemplars and metadata.

Time ranges follow the request kinds: gauges [start, end), sums and histograms strict overlap, exemplars [start, end].
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.series import any_value_filter, has_tags, label_text, path_filter, series_key, wildcard_search
from ..functions.timegrid import RESOLUTIONS, bucket
from . import histograms as H

HINTS_MOST, PATHS_MOST, METADATA_MOST = 500, 10_000, 1000
_PERCENTILES = {"P50": 0.5, "P75": 0.75, "P90": 0.9, "P95": 0.95, "P99": 0.99}


def aggregation(name: str, value: Column) -> Column:
    """AVG SUM MIN MAX COUNT P50 P75 P90 P95 P99, exactly."""
    if name in _PERCENTILES:
        return F.percentile(value, F.lit(_PERCENTILES[name]))
    return {"AVG": F.avg, "SUM": F.sum, "MIN": F.min, "MAX": F.max, "COUNT": F.count}[name](value)


@dataclass(frozen=True)
class MetricRequest:
    metric: str
    start: int
    end: int
    tags: dict[str, str] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if not self.metric or self.end < self.start:
            raise ValueError("a request needs a metric and a range of time")


def gauge(samples: DataFrame, request: MetricRequest, resolution: str, agg: str) -> DataFrame:
    """An aggregate per series and bucket; series are those whose tags include the request's."""
    if resolution not in RESOLUTIONS:
        raise ValueError(f"unknown resolution {resolution}")
    rows = samples.where((F.col("metric") == request.metric) & (F.col("ts_ms") >= request.start) & (F.col("ts_ms") < request.end) & has_tags(F.col("labels"), request.tags))
    by = rows.groupBy("metric", label_text("labels").alias("tags"), bucket(F.col("ts_ms"), RESOLUTIONS[resolution]).alias("ts_ms"))
    return by.agg(aggregation(agg, F.col("value")).alias("value"))


def gauges_of(samples: DataFrame, requests: dict[str, MetricRequest], resolution: str, agg: str) -> DataFrame:
    """Many requests in one scan: gauge's rows of each, with its name as request. A sample counts for every request it meets."""
    if resolution not in RESOLUTIONS:
        raise ValueError(f"unknown resolution {resolution}")
    meets = lambda r: (F.col("metric") == r.metric) & (F.col("ts_ms") >= r.start) & (F.col("ts_ms") < r.end) & has_tags(F.col("labels"), r.tags)
    names = F.array_compact(F.array(*[F.when(meets(r), F.lit(name)) for name, r in requests.items()]))
    rows = samples.withColumn("request", F.explode(names))
    by = rows.groupBy("request", "metric", label_text("labels").alias("tags"), bucket(F.col("ts_ms"), RESOLUTIONS[resolution]).alias("ts_ms"))
    return by.agg(aggregation(agg, F.col("value")).alias("value"))


def sum_points(sums: DataFrame, request: MetricRequest, temporality: str) -> DataFrame:
    """Points of the series with exactly the request's tags that overlap the range."""
    overlap = (F.col("ts_start") < request.end) & (F.col("ts_end") > request.start)
    return sums.where((F.col("metric") == request.metric) & overlap & (F.col("temporality") == temporality) & has_tags(F.col("labels"), request.tags, exact=True))


def sum_delta_aggregate(sums: DataFrame, request: MetricRequest) -> DataFrame:
    """The delta points' total, from the first start to the last end; no points give no row."""
    out = sum_points(sums, request, "DELTA").agg(F.min("ts_start").alias("ts_start"), F.max("ts_end").alias("ts_end"), F.sum("value").alias("value"))
    return out.where("value is not null")


def sum_cumulative(sums: DataFrame, request: MetricRequest) -> DataFrame:
    """The cumulative point with the largest value."""
    points = sum_points(sums, request, "CUMULATIVE").agg(F.max(F.struct("value", "ts_end", "ts_start")).alias("p"))
    return points.where("p is not null").select("p.ts_start", "p.ts_end", "p.value")


def histogram(histograms: DataFrame, request: MetricRequest, temporality: str) -> DataFrame:
    """Per tag set: CUMULATIVE the point with the largest total; DELTA or MERGED all delta points merged."""
    kind = "CUMULATIVE" if temporality == "CUMULATIVE" else "DELTA"
    rows = H.overlapping(histograms, request.start, request.end, kind).where((F.col("metric") == request.metric) & has_tags(F.col("labels"), request.tags)).withColumn("tags", label_text("labels"))
    if kind == "CUMULATIVE":
        best = rows.groupBy("tags").agg(F.max_by(F.struct("bounds", "counts", "ts_start", "ts_end"), F.struct(H.total("counts"), "ts_end", "ts_start")).alias("h"))
        return best.select("tags", "h.bounds", "h.counts", "h.ts_start", "h.ts_end")
    return H.sum_by(rows, ["tags"])


# -- catalogue ---------------------------------------------------------------------------------------------------------


def seen(catalogue: DataFrame, start: int, end: int, event_type: str | None = None) -> DataFrame:
    rows = catalogue.where((F.col("ts_start") < end) & (F.col("ts_end") > start))
    return rows if event_type is None else rows.where(F.col("event_type") == event_type)


def name_hints(catalogue: DataFrame, start: int, end: int, prefix: str = "", event_type: str | None = None, limit: int = HINTS_MOST) -> DataFrame:
    return seen(catalogue, start, end, event_type).where(F.col("metric").startswith(prefix)).select("metric").distinct().orderBy("metric").limit(limit)


def tag_hints(catalogue: DataFrame, start: int, end: int, metric: str, prefix: str = "", tags: dict[str, str] | None = None, limit: int = HINTS_MOST) -> DataFrame:
    rows = seen(catalogue, start, end).where((F.col("metric") == metric) & has_tags(F.col("labels"), tags or {}))
    return rows.select(F.explode(F.map_keys("labels")).alias("tag")).where(F.col("tag").startswith(prefix)).distinct().orderBy("tag").limit(limit)


def tag_value_hints(catalogue: DataFrame, start: int, end: int, metric: str, tag: str, prefix: str = "", limit: int = HINTS_MOST) -> DataFrame:
    rows = seen(catalogue, start, end).where(F.col("metric") == metric).select(F.col("labels")[tag].alias("tag_value"))
    return rows.where(F.col("tag_value").isNotNull() & F.col("tag_value").startswith(prefix)).distinct().orderBy("tag_value").limit(limit)


def paths(catalogue: DataFrame, start: int, end: int, limit: int | None = PATHS_MOST) -> DataFrame:
    """Distinct (metric, tags, event_type, temporality) with the map itself, at most `limit` in order; all of them if None."""
    rows = seen(catalogue, start, end).withColumn("tags", label_text("labels"))
    by = rows.groupBy("metric", "tags", "event_type", "temporality").agg(F.first("labels").alias("labels"))
    return by if limit is None else by.orderBy("metric", "tags", "event_type", "temporality").limit(limit)


def search(catalogue: DataFrame, start: int, end: int, any_value: str | None = None, any_pattern: str | None = None, **path: object) -> DataFrame:
    """All paths that pass the path filter and, if asked for, hold a value in the metric or in any tag."""
    rows = seen(catalogue, start, end).where(path_filter(F.col("metric"), F.col("labels"), **path))
    if any_value or any_pattern:
        rows = rows.where(any_value_filter(F.col("metric"), F.col("labels"), any_value, any_pattern))
    return paths(rows, start, end, None).select("metric", "tags", "event_type")


def glob_search(catalogue: DataFrame, start: int, end: int, query: str) -> DataFrame:
    rows = seen(catalogue, start, end).where(wildcard_search(F.col("metric"), F.col("labels"), query))
    return rows.select(series_key("metric", "labels").alias("path")).distinct()


def exemplars(rows: DataFrame, metric: str, start_ns: int, end_ns: int, tags: dict[str, str] | None = None, schema: str = "k int") -> DataFrame:
    """Exemplars in [start, end] of the series with exactly these tags (of any if None), with their attributes read."""
    out = rows.where((F.col("metric") == metric) & F.col("ts_ns").between(start_ns, end_ns))
    out = out if tags is None else out.where(has_tags(F.col("labels"), tags, exact=True))
    return out.withColumn("attributes", F.from_json("attributes", schema))


def label_names(catalogue: DataFrame, start: int, end: int) -> DataFrame:
    """All label names, __name__ among them."""
    rows = seen(catalogue, start, end)
    names = rows.select(F.explode(F.map_keys("labels")).alias("label"))
    return names.unionByName(rows.select(F.lit("__name__").alias("label"))).distinct()


def label_values(catalogue: DataFrame, start: int, end: int, name: str) -> DataFrame:
    rows = seen(catalogue, start, end)
    value = F.col("metric") if name == "__name__" else F.col("labels")[name]
    return rows.select(value.alias("label_value")).where("label_value is not null").distinct()


def metadata(catalogue: DataFrame, now_ms: int, window_ms: int = 900_000, limit: int = METADATA_MOST) -> DataFrame:
    """Types of the metrics seen lately: gauge, counter, histogram."""
    kind = F.when(F.col("event_type") == "GAUGE", "gauge").when(F.col("event_type") == "SUM", "counter").otherwise("histogram")
    rows = seen(catalogue, now_ms - window_ms, now_ms).select("metric", kind.alias("type")).distinct()
    return rows.orderBy("metric", "type").limit(limit)
