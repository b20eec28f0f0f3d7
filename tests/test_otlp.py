import json

import pytest

from pulsegrid.operators import spans as X
from pulsegrid.sources import otlp as O


def attrs(**values):
    kinds = {str: "stringValue", int: "intValue", float: "doubleValue", bool: "boolValue", list: "arrayValue"}
    return [{"key": k.replace("_", "."), "value": {kinds[type(v)]: str(v) if type(v) is int else {"values": v} if type(v) is list else v}} for k, v in values.items()]


@pytest.fixture
def write(tmp_path):
    def put(name, *requests):
        (tmp_path / name).write_text("\n".join(map(json.dumps, requests)))
        return str(tmp_path / name)

    return put


def test_metrics(spark, write):
    point = {"attributes": attrs(a="1", b=2, c=[1]), "timeUnixNano": "2500000", "asDouble": 1.5, "exemplars": [{"timeUnixNano": "2400000", "asInt": "7", "traceId": "AB", "spanId": "CD", "filteredAttributes": attrs(k=1)}]}
    histogram = {"attributes": [], "startTimeUnixNano": "0", "timeUnixNano": "9000000", "explicitBounds": [1.0], "bucketCounts": ["1", "5000000000"]}
    broken = histogram | {"bucketCounts": ["1"]}
    metrics = [
        {"name": "g", "gauge": {"dataPoints": [point]}}, {"name": "s", "sum": {"aggregationTemporality": 2, "dataPoints": [{"startTimeUnixNano": "0", "timeUnixNano": "3000000", "asInt": "4"}]}},
        {"name": "h", "histogram": {"dataPoints": [histogram, broken]}}, {"name": "x", "summary": {"dataPoints": []}},
    ]
    r = O.read(spark, write("m.json", {"resourceMetrics": [{"resource": {"attributes": attrs(service_name="s")}, "scopeMetrics": [{"metrics": metrics}]}]}), O.METRICS)
    (g,) = O.gauges(r).collect()
    assert (g["metric"], g["labels"], g["ts_ms"], g["value"]) == ("g", {"a": "1", "b": "2", "c": "unrecognized_arr"}, 2, 1.5)
    (s,) = O.sums(r).collect()
    assert (s["labels"], s["ts_end"], s["value"], s["temporality"]) == ({}, 3, 4, "CUMULATIVE")
    (h,) = O.histograms(r).collect()
    assert (h["counts"], h["temporality"]) == ([1, 2147483647], "DELTA")
    (e,) = O.exemplars(r).collect()
    assert (e["ts_ns"], e["trace_id"], e["value"], json.loads(e["attributes"])) == (2400000, "ab", 7.0, {"k": "1"})


def test_spans_and_logs(spark, write):
    span = {"traceId": "AA", "spanId": "01", "parentSpanId": "", "name": "n", "kind": 2, "startTimeUnixNano": "10", "endTimeUnixNano": "30", "status": {"code": 2}}
    span["attributes"] = [*attrs(http_method="GET", custom="x", size=3, flag=True), *attrs(custom="again"), {"key": "http.response.status_code", "value": {"stringValue": "404.2"}}]
    r = O.read(spark, write("t.json", {"resourceSpans": [{"resource": {"attributes": attrs(service_name="svc")}, "scopeSpans": [{"spans": [span]}]}, {"scopeSpans": [{"spans": [span | {"spanId": "02", "parentSpanId": "01", "attributes": None, "status": {}}]}]}]}), O.TRACES)
    a, b = O.spans(r).orderBy("span_id").collect()
    assert (a["service"], a["has_service"], a["http_method"], a["http_status"], a["status"], a["parent_id"]) == ("svc", True, "GET", 404, "ERROR", None)
    assert (a["attrs_str"], a["attrs_num"]) == ({"custom": "x"}, {"size": 3.0})
    assert (b["service"], b["has_service"], b["status"], b["attrs_str"], b["http_status"]) == ("unknown", False, "UNK", {}, None)
    assert X.search(O.spans(r), X.SpanFilter({"service": "svc"})).count() == 1
    log = {"timeUnixNano": "5000000", "traceId": "AA", "severityNumber": 9, "body": {"stringValue": "hello"}}
    r = O.read(spark, write("l.json", {"resourceLogs": [{"scopeLogs": [{"logRecords": [log, log | {"body": {"intValue": "1"}}]}]}]}), O.LOGS)
    (x,) = O.logs(r).collect()
    assert (x["ts_ms"], x["trace_id"], x["level"], x["body"], x["service"]) == (5, "aa", 9, "hello", "unknown")


def test_statistics_requests(spark, small):
    from pulsegrid.sources import tables as T

    s = T.spans(spark, small)
    out = X.stats(s, X.SpanFilter(), ["price", " ", "flag", "price"], {"price": "number"}, "COUNT", "HOURLY")
    assert list(out) == ["price", "flag"] and out["price"].columns == ["ts_ms", "value"] and out["flag"].columns == ["attribute", "attr_value", "n"]
    with pytest.raises(ValueError):
        X.stats(s, X.SpanFilter(), ["flag"], {}, "AVG")
