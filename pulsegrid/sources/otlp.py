"""Telemetry exports in OTLP JSON, one request to a line, as the library's tables.

Numbers written as text (64-bit integers) are read as such. Of attributes with one key the first counts. Only gauges, sums and
histograms become metrics, and resource attributes do not become labels; spans take their service from the resource.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.requests import first_present
from ..functions.timegrid import ns_to_ms

_VALUE = "struct<stringValue: string, intValue: string, doubleValue: double, boolValue: boolean, arrayValue: string, kvlistValue: string>"
_ATTRIBUTES = f"array<struct<key: string, value: {_VALUE}>>"
_RESOURCE = f"resource: struct<attributes: {_ATTRIBUTES}>"
_EXEMPLARS = f"exemplars: array<struct<timeUnixNano: string, asDouble: double, asInt: string, spanId: string, traceId: string, filteredAttributes: {_ATTRIBUTES}>>"
_NUMBER = f"array<struct<attributes: {_ATTRIBUTES}, startTimeUnixNano: string, timeUnixNano: string, asDouble: double, asInt: string, {_EXEMPLARS}>>"
_HISTOGRAM = f"array<struct<attributes: {_ATTRIBUTES}, startTimeUnixNano: string, timeUnixNano: string, explicitBounds: array<double>, bucketCounts: array<string>, {_EXEMPLARS}>>"
_METRIC = f"struct<name: string, gauge: struct<dataPoints: {_NUMBER}>, sum: struct<aggregationTemporality: string, dataPoints: {_NUMBER}>, histogram: struct<aggregationTemporality: string, dataPoints: {_HISTOGRAM}>>"
METRICS = f"resourceMetrics array<struct<{_RESOURCE}, scopeMetrics: array<struct<metrics: array<{_METRIC}>>>>>"
_SPAN = f"struct<traceId: string, spanId: string, parentSpanId: string, name: string, kind: string, startTimeUnixNano: string, endTimeUnixNano: string, attributes: {_ATTRIBUTES}, status: struct<code: string>>"
TRACES = f"resourceSpans array<struct<{_RESOURCE}, scopeSpans: array<struct<spans: array<{_SPAN}>>>>>"
_LOG = f"struct<timeUnixNano: string, traceId: string, severityNumber: int, body: {_VALUE}>"
LOGS = f"resourceLogs array<struct<{_RESOURCE}, scopeLogs: array<struct<logRecords: array<{_LOG}>>>>>"

#: The attributes that fill each span column, in order of preference.
STRING_COLUMNS = {
    "peer": ["peer.service", "service.peer.name"],
    "http_method": ["http.request.method", "http.method"],
    "http_origin": ["http.request.header.origin", "http.origin"],
    "http_host": ["http.request.header.host", "http.host"],
    "server_address": ["server.address"],
    "client_address": ["client.address"],
    "source_address": ["source.address"],
    "network_protocol_type": ["network.protocol.name", "network.type"],
    "network_protocol_version": ["network.protocol.version"],
    "db_system": ["db.system", "db.system.name"],
    "db_collection_name": ["db.collection.name"],
    "db_namespace": ["db.namespace", "db.name"],
    "db_operation_name": ["db.operation", "db.operation.name"],
    "db_query_text": ["db.query.text", "db.statement"],
    "db_query_summary": ["db.query.summary"],
    "db_stored_procedure_name": ["db.stored_procedure.name"],
    "rpc_method": ["rpc.method"],
    "rpc_method_original": ["rpc.method.original", "rpc.method"],
}
NUMBER_COLUMNS = {
    "http_status": ["http.response.status_code", "http.status_code"],
    "http_request_size": ["http.request.body.size", "http.request_content_length"],
    "http_response_size": ["http.response.body.size", "http.response_content_length"],
    "server_port": ["server.port"],
    "client_port": ["client.port"],
    "source_port": ["source.port"],
    "db_response_status_code": ["db.response.status_code"],
    "db_response_returned_rows": ["db.response.returned_rows"],
    "rpc_response_status_code": ["rpc.response.status_code"],
}


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def parse(lines: DataFrame, schema: str, column: str = "value") -> DataFrame:
    """Requests from a column of JSON texts, such as a stream's; a text that is no request gives a row of nulls."""
    return lines.select(F.from_json(column, schema).alias("r")).select("r.*")


def _attributes(labels: Column | str) -> Column:
    return F.transform(F.map_entries(labels), lambda e: F.struct(e["key"].alias("key"), F.struct(e["value"].alias("stringValue")).alias("value")))


def _nanos(ms: str) -> Column:
    return (F.col(ms) * 1_000_000).cast("string")


def _request(metric: Column) -> Column:
    scopes = F.array(F.struct(F.array(metric).alias("metrics")))
    return F.to_json(F.struct(F.array(F.struct(scopes.alias("scopeMetrics"))).alias("resourceMetrics"))).alias("value")


def gauge_requests(samples: DataFrame) -> DataFrame:
    """Gauges as export requests, a JSON text (value) for each sample."""
    point = F.struct(_attributes("labels").alias("attributes"), _nanos("ts_ms").alias("timeUnixNano"), F.col("value").alias("asDouble"))
    return samples.select(_request(F.struct(F.col("metric").alias("name"), F.struct(F.array(point).alias("dataPoints")).alias("gauge"))))


def sum_requests(points: DataFrame) -> DataFrame:
    """Sums as export requests, a JSON text (value) for each point."""
    point = F.struct(_attributes("labels").alias("attributes"), _nanos("ts_start").alias("startTimeUnixNano"), _nanos("ts_end").alias("timeUnixNano"), F.col("value").cast("string").alias("asInt"))
    kind = F.when(F.col("temporality") == "CUMULATIVE", "2").otherwise("1").alias("aggregationTemporality")
    return points.select(_request(F.struct(F.col("metric").alias("name"), F.struct(kind, F.array(point).alias("dataPoints")).alias("sum"))))


def histogram_requests(points: DataFrame) -> DataFrame:
    """Histograms as export requests, a JSON text (value) for each point."""
    point = F.struct(_attributes("labels").alias("attributes"), _nanos("ts_start").alias("startTimeUnixNano"), _nanos("ts_end").alias("timeUnixNano"), F.col("bounds").alias("explicitBounds"), F.col("counts").cast("array<string>").alias("bucketCounts"))
    kind = F.when(F.col("temporality") == "CUMULATIVE", "2").otherwise("1").alias("aggregationTemporality")
    return points.select(_request(F.struct(F.col("metric").alias("name"), F.struct(kind, F.array(point).alias("dataPoints")).alias("histogram"))))


def _firsts(attributes: Column) -> Column:
    keys = F.transform(attributes, lambda a: a["key"])
    return F.filter(attributes, lambda a, i: F.array_position(keys, a["key"]) == i + 1)


def _text(value: Column) -> Column:
    some = [value["stringValue"], value["boolValue"].cast("string"), value["intValue"], value["doubleValue"].cast("string")]
    return F.coalesce(*some, F.when(value["arrayValue"].isNotNull(), "unrecognized_arr"), F.when(value["kvlistValue"].isNotNull(), "unrecognized_kvlist"))


def tags(attributes: Column) -> Column:
    """Attributes as text; no attributes give an empty map."""
    pairs = F.transform(_firsts(attributes), lambda a: F.struct(a["key"], F.coalesce(_text(a["value"]), F.lit(""))))
    return F.coalesce(F.map_from_entries(pairs), F.create_map().cast("map<string,string>"))


def _ms(nanos: Column) -> Column:
    return ns_to_ms(nanos.cast("long"))


def _points(requests: DataFrame, kind: str) -> DataFrame:
    metrics = requests.select(F.explode("resourceMetrics").alias("r")).select(F.explode("r.scopeMetrics").alias("s")).select(F.explode("s.metrics").alias("m"))
    rows = metrics.where(F.col(f"m.{kind}").isNotNull())
    temporality = F.lit(None).cast("string") if kind == "gauge" else F.when(F.col(f"m.{kind}.aggregationTemporality").isin("2", "AGGREGATION_TEMPORALITY_CUMULATIVE"), "CUMULATIVE").otherwise("DELTA")
    rows = rows.select(F.col("m.name").alias("metric"), temporality.alias("temporality"), F.explode(f"m.{kind}.dataPoints").alias("p"))
    return rows.withColumn("labels", tags(F.col("p.attributes")))


def _value() -> Column:
    return F.coalesce(F.col("p.asDouble"), F.col("p.asInt").cast("double"), F.lit(0.0))


def gauges(requests: DataFrame) -> DataFrame:
    return _points(requests, "gauge").select("metric", "labels", _ms(F.col("p.timeUnixNano")).alias("ts_ms"), _value().alias("value"))


def sums(requests: DataFrame) -> DataFrame:
    value = F.coalesce(F.col("p.asInt").try_cast("long"), F.round(F.col("p.asDouble")).try_cast("long"), F.lit(0))
    return _points(requests, "sum").select("metric", "labels", _ms(F.col("p.startTimeUnixNano")).alias("ts_start"), _ms(F.col("p.timeUnixNano")).alias("ts_end"), value.alias("value"), "temporality")


def histograms(requests: DataFrame) -> DataFrame:
    """Counts are clamped to 32 bits; points without exactly one more count than bounds are left out."""
    counts = F.transform("p.bucketCounts", lambda c: F.least(c.cast("long"), F.lit(2147483647)).cast("int"))
    rows = _points(requests, "histogram").select("metric", "labels", _ms(F.col("p.startTimeUnixNano")).alias("ts_start"), _ms(F.col("p.timeUnixNano")).alias("ts_end"), F.col("p.explicitBounds").alias("bounds"), counts.alias("counts"), "temporality")
    return rows.where(F.size("counts") == F.size("bounds") + 1)


def exemplars(requests: DataFrame) -> DataFrame:
    """Exemplars of gauges and histograms; sums have none."""
    one = lambda kind: _points(requests, kind).select("metric", "labels", F.explode("p.exemplars").alias("e"))
    rows = one("gauge").unionByName(one("histogram"))
    return rows.select(F.col("e.timeUnixNano").cast("long").alias("ts_ns"), "metric", "labels", F.lower("e.traceId").alias("trace_id"), F.lower("e.spanId").alias("span_id"), F.coalesce("e.asDouble", F.col("e.asInt").cast("double")).alias("value"), F.to_json(tags(F.col("e.filteredAttributes"))).alias("attributes"))


def spans(requests: DataFrame, default_service: str = "unknown") -> DataFrame:
    """Spans with their well-known columns, and the other attributes in two maps: texts, and numbers. Values of other types
    are left out. has_service tells whether the resource named its service: only such spans count as request events."""
    r = requests.select(F.explode("resourceSpans").alias("r")).select(tags(F.col("r.resource.attributes")).alias("res"), F.explode("r.scopeSpans").alias("s"))
    rows = r.select("res", F.explode("s.spans").alias("p")).withColumn("all", tags(F.col("p.attributes")))
    taken = [a for names in [*STRING_COLUMNS.values(), *NUMBER_COLUMNS.values()] for a in names]
    own = F.filter(_firsts(F.col("p.attributes")), lambda a: ~a["key"].isin(*taken))
    number = lambda v: F.coalesce(v["doubleValue"], v["intValue"].try_cast("double"))
    texts = F.map_from_entries(F.transform(F.filter(own, lambda a: a["value"]["stringValue"].isNotNull()), lambda a: F.struct(a["key"], a["value"]["stringValue"])))
    numbers = F.map_from_entries(F.transform(F.filter(own, lambda a: number(a["value"]).isNotNull()), lambda a: F.struct(a["key"], number(a["value"]))))
    status = F.when(F.col("p.status.code").isin("1", "STATUS_CODE_OK"), "OK").when(F.col("p.status.code").isin("2", "STATUS_CODE_ERROR"), "ERROR").otherwise("UNK")
    return rows.select(
        F.lower("p.traceId").alias("trace_id"), F.lower("p.spanId").alias("span_id"), F.nullif(F.lower("p.parentSpanId"), F.lit("")).alias("parent_id"),
        F.coalesce(F.col("res")["service.name"], F.lit(default_service)).alias("service"), F.col("res")["service.name"].isNotNull().alias("has_service"),
        "p.name", "p.kind", status.alias("status"), F.col("p.startTimeUnixNano").cast("long").alias("start_ns"), F.col("p.endTimeUnixNano").cast("long").alias("end_ns"),
        *[first_present(F.col("all"), names).alias(c) for c, names in STRING_COLUMNS.items()], *[first_present(F.col("all"), names, "int").alias(c) for c, names in NUMBER_COLUMNS.items()],
        F.coalesce(texts, F.create_map().cast("map<string,string>")).alias("attrs_str"), F.coalesce(numbers, F.create_map().cast("map<string,double>")).alias("attrs_num"),
    )


def logs(requests: DataFrame) -> DataFrame:
    """Records with a text body; the document id depends on the content alone."""
    r = requests.select(F.explode("resourceLogs").alias("r")).select(tags(F.col("r.resource.attributes")).alias("res"), F.explode("r.scopeLogs").alias("s"))
    rows = r.select("res", F.explode("s.logRecords").alias("p")).where("p.body.stringValue is not null")
    ids = F.sha2(F.concat_ws("|", "p.timeUnixNano", F.lower("p.traceId"), F.col("p.severityNumber").cast("string"), "p.body.stringValue"), 256)
    return rows.select(_ms(F.col("p.timeUnixNano")).alias("ts_ms"), F.lower("p.traceId").alias("trace_id"), F.col("p.severityNumber").alias("level"), F.col("p.body.stringValue").alias("body"), F.coalesce(F.col("res")["service.name"], F.lit("unknown")).alias("service"), ids.alias("doc_id"))
