import pytest
from pyspark.sql import functions as F

from pulsegrid.functions import requests as Q
from pulsegrid.functions import series as S
from pulsegrid.functions.timegrid import Grid, duration_ms, instant_ms, ns_to_ms, resolution_for
from pulsegrid.operators.vectors import scalar_op
from pulsegrid.sources import tables as T


def test_durations_and_instants():
    assert [duration_ms(x) for x in ("5m", "1h30m", "250ms", "90", 2)] == [300_000, 5_400_000, 250, 90_000, 2000]
    assert instant_ms("1.5") == 1500 and instant_ms("1970-01-01T00:01:00Z") == 60_000
    for bad in ("", "5x", "m5"):
        with pytest.raises(ValueError):
            duration_ms(bad)
    assert [resolution_for(x) for x in (1000, 60_000, 60_001)] == ["SECONDLY", "MINUTELY", "HOURLY"]


def test_grid_is_bounded():
    with pytest.raises(ValueError):
        Grid(0, 10**15, 1)
    with pytest.raises(ValueError):
        Grid(10, 0, 1)


def test_scalars():
    assert scalar_op("+", 2, scalar_op("*", 3, 4)) == 14 and scalar_op("%", -7, 3) == -1
    assert scalar_op(">", 2, 1, True) == 1 and scalar_op("/", 1, 0) != scalar_op("/", 1, 0)


def test_variables():
    assert Q.substitute("a{x=$__{v}}$__{none}", {"v": "1"}) == "a{x=1}"
    with pytest.raises(ValueError):
        Q.substitute("$__{open", {})
    assert Q.hydrate("x {{a}}", {"a": 3}) == "x 3"
    with pytest.raises(ValueError):
        Q.hydrate("{{b}}", {})
    assert Q.unescape_label("U__a_2e_b__c") == "a.b_c"


@pytest.mark.parametrize("query, want", [("cpu*", {"cpu.load"}), ("*{host=a}", {"cpu.load"}), ("*{ho*=*}", {"cpu.load", "mem"}), ("mem{host=b*}", {"mem"}), ("*{host=*}", {"cpu.load", "mem"}), ("disk", set())])
def test_wildcards(spark, query, want):
    df = spark.createDataFrame([("cpu.load", {"host": "a"}), ("mem", {"host": "bb"}), ("net", {})], "metric string, tags map<string,string>")
    assert {r[0] for r in df.where(S.wildcard_search(F.col("metric"), F.col("tags"), query)).select("metric").collect()} == want


def test_wildcard_errors(spark):
    with pytest.raises(ValueError):
        S.wildcard_search(F.col("m"), F.col("t"), "x{a*=b*}")


def test_exports(spark, tmp_path):
    f = tmp_path / "in.json"
    f.write_text("\n".join([
        '{"metricName": "g", "tags": {"a": "1"}, "gauge": {"ts": [1, 2], "value": [0.5, 1.5]}}',
        '{"metricName": "s", "tags": {}, "sum": {"temporality": "DELTA", "sumPoints": [{"start": 0, "end": 1, "sum": 4}]}}',
        '{"metricName": "h", "tags": {}, "histo": {"histoPoints": [{"start": 0, "end": 1, "buckets": [1.0], "bucketCounts": [1, 9999999999]}, {"start": 0, "end": 1, "buckets": [1.0], "bucketCounts": [1]}]}}',
        "not json",
    ]))
    r = T.read_exports(spark, str(f))
    assert r.count() == 3
    assert sorted((x["ts_ms"], x["value"]) for x in T.export_gauges(r).collect()) == [(1, 0.5), (2, 1.5)]
    assert T.export_sums(r).first()["value"] == 4
    assert [x["counts"] for x in T.export_histograms(r).collect()] == [[1, 2147483647]]


def test_payloads(spark):
    a = spark.createDataFrame([('{"data": {"resultType": "matrix", "result": [{"metric": {"__name__": "m", "x": "1"}, "values": [[1.5, "2"], [2, "NaN?"]]}]}}',)], "payload string")
    out = Q.matrix_payload(a).orderBy("ts_ms").collect()
    assert [(r["metric"], r["labels"], r["ts_ms"], r["value"]) for r in out] == [("m", {"x": "1"}, 1500, 2.0), ("m", {"x": "1"}, 2000, None)]
    b = spark.createDataFrame([('{"series": [{"metric": "m", "tag_set": ["host:a:b"], "pointlist": [[1000, 2.5], [2000, null]]}]}',)], "payload string")
    assert [(r["labels"], r["ts_ms"], r["value"]) for r in Q.point_list_payload(b).collect()] == [({"host": "a:b"}, 1000, 2.5)]


def test_first_present(spark):
    df = spark.createDataFrame([({"b": "7.6"},), ({"a": "x", "b": "1"},), ({},)], "m map<string,string>")
    assert [r[0] for r in df.select(Q.first_present(F.col("m"), ["a", "b"], "int")).collect()] == [8, None, None]


def test_writing_prunes_months(spark, small, tmp_path):
    path = str(tmp_path / "samples")
    T.write_samples(T.gauges(spark, small), path)
    lo, hi = instant_ms("2024-01-05"), instant_ms("2024-01-06")
    back = T.read_samples(spark, path, lo, hi)
    assert back.count() == T.gauges(spark, small).where(F.col("ts_ms").between(lo, hi)).count() > 0
    assert "PartitionFilters: [isnotnull(month" in back._jdf.queryExecution().toString()
    T.write_spans(T.spans(spark, small), str(tmp_path / "spans"))
    assert spark.read.parquet(str(tmp_path / "spans")).count() == T.spans(spark, small).count()


def test_nanoseconds_are_whole_numbers(spark):
    ns = [1706554792970 * 1_000_000, 1706554792970 * 1_000_000 + 999_999, 1706554792970 * 1_000_000 - 1, -1, 0]
    rows = spark.createDataFrame([(n,) for n in ns], "ns long").select(ns_to_ms(F.col("ns")).alias("ms")).collect()
    assert [r["ms"] for r in rows] == [n // 1_000_000 for n in ns]
