"""The observability tables, as views over the given star schema and as readers and writers of their own.

gauges      metric, labels, ts_ms, value
sums        metric, labels, ts_start, ts_end, value, temporality
histograms  metric, labels, ts_start, ts_end, bounds, counts, temporality
spans       trace_id, span_id, parent_id, service, peer, name, kind, status, start_ns, end_ns, ..., attrs_str, attrs_num
red_events  ts_start_ns, ts_end_ns, service, name, peer, kind, status
logs        ts_ms, trace_id, level, body, service, doc_id
exemplars   ts_ns, metric, labels, trace_id, span_id, value, attributes (JSON)
catalogue   event_type, metric, labels, temporality, ts_start, ts_end
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.series import series_key
from ..functions.timegrid import epoch_ms

DAY = 86_400_000
#: Upper bounds of the price histogram; the last bucket is open.
PRICE_BOUNDS = [10_000.0, 20_000.0, 30_000.0, 40_000.0, 50_000.0]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def labels(**columns: Column | str) -> Column:
    parts = [x for k, c in columns.items() for x in (F.lit(k), (F.col(c) if isinstance(c, str) else c).cast("string"))]
    return F.create_map(*parts)


def gauges(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_type").alias("metric"), labels(user="user_id").alias("labels"), epoch_ms(F.col("ts")).alias("ts_ms"), F.col("value").cast("double").alias("value"))


def sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delta sums: orders a day, by status and priority."""
    o = table(spark, sf_dir, "orders")
    day = epoch_ms(F.col("o_orderdate")) - F.pmod(epoch_ms(F.col("o_orderdate")), F.lit(DAY))
    by = o.groupBy("o_orderstatus", "o_orderpriority", day.alias("ts_start")).agg(F.count("*").alias("value"))
    return by.select(F.lit("orders").alias("metric"), labels(status="o_orderstatus", priority="o_orderpriority").alias("labels"), "ts_start", (F.col("ts_start") + DAY).alias("ts_end"), "value", F.lit("DELTA").alias("temporality"))


def cumulative_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same counters as running totals."""
    s = sums(spark, sf_dir)
    w = Window.partitionBy(series_key("metric", "labels")).orderBy("ts_start").rowsBetween(Window.unboundedPreceding, 0)
    return s.withColumn("value", F.sum("value").over(w)).withColumn("temporality", F.lit("CUMULATIVE"))


def histograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices a day, by return flag: bounds, and counts with one more bucket than bounds."""
    li = table(spark, sf_dir, "lineitem")
    ms = epoch_ms(F.col("l_shipdate"))
    day = ms - F.pmod(ms, F.lit(DAY))
    price, low = F.col("l_extendedprice"), [None, *PRICE_BOUNDS]
    inside = [(price <= hi if lo is None else (price > lo) & (price <= hi)) for lo, hi in zip(low, PRICE_BOUNDS, strict=False)] + [price > PRICE_BOUNDS[-1]]
    by = li.groupBy("l_returnflag", day.alias("ts_start")).agg(*[F.count_if(c).alias(f"c{i}") for i, c in enumerate(inside)])
    counts = F.array(*[F.col(f"c{i}").cast("int") for i in range(len(inside))])
    return by.select(F.lit("price").alias("metric"), labels(flag="l_returnflag").alias("labels"), "ts_start", (F.col("ts_start") + DAY).alias("ts_end"), F.array(*map(F.lit, PRICE_BOUNDS)).alias("bounds"), counts.alias("counts"), F.lit("DELTA").alias("temporality"))


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A trace per order, a span per line, each line the child of the one before it."""
    li = table(spark, sf_dir, "lineitem")
    start = (epoch_ms(F.col("l_shipdate")) + F.col("l_linenumber") * 1000) * 1_000_000
    span = lambda n: F.concat(F.col("l_orderkey").cast("string"), F.lit("-"), n.cast("string"))
    status = F.when(F.col("l_returnflag") == "R", "ERROR").when(F.col("l_returnflag") == "A", "OK").otherwise("UNK")
    return li.select(
        F.col("l_orderkey").cast("string").alias("trace_id"), span(F.col("l_linenumber")).alias("span_id"),
        F.when(F.col("l_linenumber") > 1, span(F.col("l_linenumber") - 1)).alias("parent_id"),
        F.concat(F.lit("svc-"), F.col("l_suppkey") % 10).alias("service"), F.concat(F.lit("peer-"), F.col("l_partkey") % 4).alias("peer"),
        F.concat(F.lit("op-"), F.lpad((F.col("l_partkey") % 25).cast("string"), 2, "0")).alias("name"),
        F.when(F.col("l_linestatus") == "O", "SERVER").otherwise("CLIENT").alias("kind"), status.alias("status"),
        start.alias("start_ns"), (start + F.col("l_quantity").cast("long") * 10_000_000).alias("end_ns"),
        F.when(F.col("l_linenumber") % 2 == 0, "GET").otherwise("POST").alias("http_method"), (200 + (F.col("l_suppkey") % 4) * 100).cast("int").alias("http_status"),
        F.when(F.col("l_partkey") % 3 == 0, "postgres").alias("db_system"),
        labels(flag="l_returnflag", line="l_linenumber").alias("attrs_str"),
        F.create_map(F.lit("price"), F.col("l_extendedprice"), F.lit("tax"), F.col("l_tax")).alias("attrs_num"),
    )


def red_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One event per span that names its service."""
    s = spans(spark, sf_dir).where("service is not null")
    return s.select(F.col("start_ns").alias("ts_start_ns"), F.col("end_ns").alias("ts_end_ns"), "service", "name", "peer", "kind", "status")


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record per conversation turn; the level follows the role."""
    c = table(spark, sf_dir, "conversations")
    level = F.when(F.col("role") == "system", 10).when(F.col("role") == "user", 20).otherwise(30)
    return c.select((F.col("conv_id") * 60_000 + F.col("turn") * 1000).alias("ts_ms"), F.col("conv_id").cast("string").alias("trace_id"), level.alias("level"), F.col("text").alias("body"), F.concat(F.lit("svc-"), F.col("conv_id") % 5).alias("service"), F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("doc_id"))


def exemplars(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select((epoch_ms(F.col("ts")) * 1_000_000).alias("ts_ns"), F.col("event_type").alias("metric"), labels(user="user_id").alias("labels"), F.col("user_id").cast("string").alias("trace_id"), F.col("event_id").cast("string").alias("span_id"), F.col("value"), F.col("props").alias("attributes"))


def catalogue_of(samples: DataFrame, event_type: str, start: str = "ts_ms", end: str = "ts_ms", temporality: str | None = None) -> DataFrame:
    """The series in some samples with the time they span."""
    rows = samples.withColumn("key", series_key("metric", "labels"))
    by = rows.groupBy("key").agg(F.first("metric").alias("metric"), F.first("labels").alias("labels"), F.min(start).alias("ts_start"), F.max(end).alias("ts_end"))
    return by.select(F.lit(event_type).alias("event_type"), "metric", "labels", F.lit(temporality).cast("string").alias("temporality"), "ts_start", "ts_end")


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = catalogue_of(gauges(spark, sf_dir), "GAUGE")
    s = catalogue_of(sums(spark, sf_dir), "SUM", "ts_start", "ts_end", "DELTA")
    h = catalogue_of(histograms(spark, sf_dir), "HISTO", "ts_start", "ts_end", "DELTA")
    return g.unionByName(s).unionByName(h)


# -- files -------------------------------------------------------------------------------------------------------------

_tags = T.MapType(T.StringType(), T.StringType())
_field = lambda n, t: T.StructField(n, t)
#: An export request: one of gauge, sum and histo is set.
EXPORT_SCHEMA = T.StructType([
    _field("metricName", T.StringType()), _field("tags", _tags), _field("type", T.StringType()),
    _field("gauge", T.StructType([_field("ts", T.ArrayType(T.LongType())), _field("value", T.ArrayType(T.FloatType()))])),
    _field("sum", T.StructType([_field("temporality", T.StringType()), _field("sumPoints", T.ArrayType(T.StructType([_field("start", T.LongType()), _field("end", T.LongType()), _field("sum", T.LongType())])))])),
    _field("histo", T.StructType([_field("histoPoints", T.ArrayType(T.StructType([_field("start", T.LongType()), _field("end", T.LongType()), _field("buckets", T.ArrayType(T.DoubleType())), _field("bucketCounts", T.ArrayType(T.LongType())), _field("temporality", T.StringType())])))])),
])


def read_exports(spark: SparkSession, path: str) -> DataFrame:
    """Export requests, one JSON object to a line; malformed lines come as rows of nulls and are left out."""
    return spark.read.schema(EXPORT_SCHEMA).json(path).where("metricName is not null")


def export_gauges(requests: DataFrame) -> DataFrame:
    points = F.explode(F.arrays_zip("gauge.ts", "gauge.value"))
    rows = requests.where("gauge is not null").select(F.col("metricName").alias("metric"), F.col("tags").alias("labels"), points.alias("p"))
    return rows.select("metric", F.coalesce("labels", F.create_map().cast("map<string,string>")).alias("labels"), F.col("p.ts").alias("ts_ms"), F.col("p.value").cast("double").alias("value")).where("ts_ms is not null")


def export_sums(requests: DataFrame) -> DataFrame:
    rows = requests.where("sum is not null").select(F.col("metricName").alias("metric"), F.col("tags").alias("labels"), F.coalesce("sum.temporality", F.lit("DELTA")).alias("temporality"), F.explode("sum.sumPoints").alias("p"))
    return rows.select("metric", "labels", F.col("p.start").alias("ts_start"), F.col("p.end").alias("ts_end"), F.col("p.sum").alias("value"), "temporality")


def export_histograms(requests: DataFrame) -> DataFrame:
    """Counts are clamped to 32 bits; points without exactly one more count than bounds, or with a negative one, are left out."""
    rows = requests.where("histo is not null").select(F.col("metricName").alias("metric"), F.col("tags").alias("labels"), F.explode("histo.histoPoints").alias("p"))
    counts = F.transform("p.bucketCounts", lambda c: F.least(c, F.lit(2147483647)).cast("int"))
    rows = rows.select("metric", "labels", F.col("p.start").alias("ts_start"), F.col("p.end").alias("ts_end"), F.col("p.buckets").alias("bounds"), counts.alias("counts"), F.coalesce("p.temporality", F.lit("DELTA")).alias("temporality"))
    return rows.where((F.size("counts") == F.size("bounds") + 1) & ~F.exists("counts", lambda c: c < 0))


def valid_gauges(samples: DataFrame) -> DataFrame:
    """Samples with a name, a time and a value."""
    return samples.where("metric is not null and metric <> '' and ts_ms is not null and value is not null")


def write_samples(samples: DataFrame, path: str, ts: str = "ts_ms") -> None:
    """Samples as Parquet by month, sorted within each file by metric and time, so that time and metric filters skip data."""
    month = F.date_format(F.timestamp_millis(F.col(ts)), "yyyy-MM")
    samples.withColumn("month", month).repartition("month", "metric").sortWithinPartitions("metric", ts).write.mode("append").partitionBy("month").parquet(path)


def write_spans(rows: DataFrame, path: str) -> None:
    """Spans by hour, sorted by service, trace and start, with Bloom filters on the ids."""
    hour = F.floor(F.col("start_ns") / 3_600_000_000_000)
    out = rows.withColumn("hour", hour).repartition("hour", "service").sortWithinPartitions("service", "trace_id", "span_id", "start_ns").write.mode("append")
    for c in ("trace_id", "span_id"):
        out = out.option(f"parquet.bloom.filter.enabled#{c}", "true")
    out.partitionBy("hour").parquet(path)


def read_samples(spark: SparkSession, path: str, start_ms: int, end_ms: int, ts: str = "ts_ms") -> DataFrame:
    """Written samples of a closed time range; whole months outside it are not read."""
    month = lambda ms: F.date_format(F.timestamp_millis(F.lit(ms)), "yyyy-MM")
    return spark.read.parquet(path).where(F.col("month").between(month(start_ms), month(end_ms)) & F.col(ts).between(start_ms, end_ms)).drop("month")
