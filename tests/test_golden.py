"""Golden values: small inputs with results worked out by hand."""

import math

import pytest
from pyspark.sql import functions as F

from pulsegrid.functions.series import label_text
from pulsegrid.functions.timegrid import Grid
from pulsegrid.operators import histograms as H
from pulsegrid.operators import logs as L
from pulsegrid.operators import metrics as M
from pulsegrid.operators import red as R
from pulsegrid.operators import rollup as U
from pulsegrid.operators import samples as P
from pulsegrid.operators import spans as X
from pulsegrid.operators import vectors as V

T0, STEP = 1_700_000_000_000, 60_000
TS = [T0 + i * STEP for i in range(4)]
GRID = Grid(TS[1], TS[3], STEP)
SCHEMA = "metric string, labels map<string,string>, ts_ms long, value double"


@pytest.fixture(scope="module")
def data(spark):
    series = [
        ("cpu_usage", {"job": "api", "instance": "i1"}, [10, 20, 30, 40]), ("cpu_usage", {"job": "api", "instance": "i2"}, [40, 60, 80, 100]),
        ("mem_usage", {"job": "api", "instance": "i1"}, [50, 60, 70, 80]), ("pod_replicas", {"job": "api"}, [3, 3, 3, 3]),
        ("requests", {"job": "api", "instance": "i1"}, [100, 200, 300, 400]), ("requests", {"job": "api", "instance": "i2"}, [10, 20, 30, 40]),
        ("http_requests_counter", {"job": "api"}, [60, 120, 180, 240]),
    ]
    return spark.createDataFrame([(m, l, t, float(v)) for m, l, vs in series for t, v in zip(TS, vs)], SCHEMA).cache()


def values(df):
    return {(r["labels"].get("instance"), r["ts_ms"]): r["value"] for r in df.collect()}


def over(data, metric, f="avg_over_time", grid=GRID, range_ms=120_000):
    return P.over_time(P.select(data, metric), grid, range_ms, f)


def test_rate(data):
    out = values(P.counter_function(P.select(data, "http_requests_counter"), GRID, 120_000, "rate"))
    assert [out[None, t] for t in TS[1:]] == [1.5, 2.5, 3.5]


def test_compare_bool(data):
    out = values(V.with_scalar(V.with_scalar(over(data, "cpu_usage"), "*", 2, scalar_left=True), ">", 60, as_bool=True))
    assert [out["i1", t] for t in TS[1:]] == [0, 0, 1] and [out["i2", t] for t in TS[1:]] == [1, 1, 1]


def test_group_left(data):
    how = V.Matching(on=["job"], group="left", include=["instance"])
    out = V.binary(over(data, "requests"), over(data, "pod_replicas"), "+", V.Matching(on=["job"], group="left"))
    got = values(out)
    assert (got["i1", TS[2]], got["i2", TS[2]]) == (253, 28)
    assert how.group == "left"


@pytest.mark.parametrize("op, want", [("and", {"i1"}), ("unless", {"i2"})])
def test_set_operators(data, op, want):
    out = V.set_op(over(data, "cpu_usage"), over(data, "mem_usage"), op, V.Matching(on=["instance"]))
    assert {k for k, _ in values(out)} == want


def test_division_by_zero_is_nan(data):
    assert all(math.isnan(v) for v in values(V.with_scalar(over(data, "cpu_usage"), "/", 0)).values())


def test_empty_window(data):
    late = Grid(TS[3] + 100_000, TS[3] + 100_000, STEP)
    assert values(over(data, "cpu_usage", grid=late, range_ms=90_000)) == {}
    out = over(data, "cpu_usage", grid=Grid(TS[0] - STEP, TS[3], STEP), range_ms=STEP)
    assert math.isnan(values(out)["i1", TS[0] - STEP])


def test_missing_label_matches_nothing(data):
    assert V.binary(over(data, "cpu_usage"), over(data, "cpu_usage"), "+", V.Matching(on=["service"])).count() == 0


def test_many_to_many_fails(data):
    with pytest.raises(Exception, match="many-to-many"):
        V.binary(over(data, "cpu_usage"), over(data, "cpu_usage"), "+", V.Matching(on=["job"])).collect()


def test_both_groups_fail(data):
    with pytest.raises(ValueError):
        V.binary(over(data, "cpu_usage"), over(data, "cpu_usage"), "+", V.Matching(group="both"))


def test_range_selector(data):
    out = P.raw_range(P.select(data, "cpu_usage", [("instance", "=~", "i.*")]), GRID, 60_000)
    assert out.count() == 8


HISTO = "metric string, labels map<string,string>, ts_start long, ts_end long, bounds array<double>, counts array<int>, temporality string"


@pytest.mark.parametrize("q, want", [(0.5, 400), (0.0, 100), (1.0, 500)])
def test_histogram_quantile(spark, q, want):
    h = spark.createDataFrame([("latency", {"job": "api", "instance": "i1"}, TS[0], TS[3], [100.0, 200.0, 500.0], [10, 20, 30, 40], "DELTA")], HISTO)
    out = H.histogram_quantile(q, h, GRID, 120_000).collect()
    assert len(out) == 3 and all(abs(r["value"] - want) <= 2 and r["labels"] == {"job": "api"} for r in out)


def test_histogram_windows(spark):
    h = spark.createDataFrame([("latency", {}, 0, 1000, [10.0, 20.0], [1, 0, 0], "DELTA"), ("latency", {}, 1000, 2000, [10.0, 20.0], [0, 1, 0], "DELTA")], HISTO)
    assert [r["value"] for r in H.histogram_quantile(0.5, h, Grid(1000, 2000, 1000), 1000).orderBy("ts_ms").collect()] == [10, 10]


def test_histogram_merge(spark):
    same = [("x", {}, 0, 5, [100.0, 200.0, 500.0], [1, 2, 3, 4], "DELTA"), ("x", {}, 5, 12, [100.0, 200.0, 500.0], [5, 6, 7, 8], "DELTA")]
    r = H.sum_by(spark.createDataFrame(same, HISTO), ["metric"]).first()
    assert (r["counts"], r["ts_start"], r["ts_end"]) == ([6, 8, 10, 12], 0, 12)
    mixed = [("x", {}, 0, 5, [100.0, 200.0], [10, 10, 0], "DELTA"), ("x", {}, 0, 5, [150.0, 250.0], [0, 10, 10], "DELTA")]
    r = H.sum_by(spark.createDataFrame(mixed, HISTO), ["metric"]).first()
    assert r["bounds"] == [100, 150, 200, 250] and sum(r["counts"]) == 40 and min(r["counts"]) >= 0
    assert H.sum_by(spark.createDataFrame([], HISTO), ["metric"]).count() == 0


def test_gauge_requests(spark):
    rows = [("m", {"a": "1"}, 1000, 1.0), ("m", {"a": "1"}, 1050, 3.0), ("n", {}, 1000, 2.0), ("n", {}, 30000, 5.0)]
    g = spark.createDataFrame(rows, SCHEMA)
    assert [(r["ts_ms"], r["value"]) for r in M.gauge(g, M.MetricRequest("m", 0, 5000), "SECONDLY", "AVG").collect()] == [(1000, 2.0)]
    assert [r["value"] for r in M.gauge(g, M.MetricRequest("n", 0, 60_000), "MINUTELY", "SUM").collect()] == [7.0]


def test_sums(spark):
    schema = "metric string, labels map<string,string>, ts_start long, ts_end long, value long, temporality string"
    s = spark.createDataFrame([("c", {}, 1000, 2000, 3, "DELTA"), ("c", {}, 2000, 3000, 4, "DELTA")], schema)
    r = M.MetricRequest("c", 0, 10_000)
    assert M.sum_delta_aggregate(s, r).first()["value"] == 7 and M.sum_cumulative(s, r).count() == 0
    c = spark.createDataFrame([("c", {}, 0, 1000, 10, "CUMULATIVE"), ("c", {}, 0, 2000, 15, "CUMULATIVE"), ("c", {}, 0, 3000, 4, "CUMULATIVE")], schema)
    assert M.sum_cumulative(c, r).first()["value"] == 15
    assert [x["value"] for x in P.to_deltas(c).orderBy("ts_end").collect()] == [10, 5, 4]


def span(t, i, parent, a, b):
    return (t, i, parent, a, b)


def test_flame_graph(spark):
    s = spark.createDataFrame([("t", "root", None, 1000, 3000), ("t", "child", "root", 1100, 2000), ("t", "grand", "child", 1200, 1500), ("t", "orphan", "gone", 500, 800)], "trace_id string, span_id string, parent_id string, start_ns long, end_ns long")
    out = {r["span_id"]: r for r in X.with_depth(X.trace_tree(s)).collect()}
    assert {k for k, r in out.items() if r["is_root"]} == {"root", "orphan"}
    assert [out[k]["offset_ns"] for k in ("orphan", "root", "child", "grand")] == [0, 500, 600, 700]
    assert (out["grand"]["depth"], out["grand"]["root_id"], out["grand"]["duration_ns"]) == (2, "root", 300)


def test_trace_cycles_have_no_root(spark):
    s = spark.createDataFrame([("t", "a", "b", 0, 1), ("t", "b", "a", 0, 1)], "trace_id string, span_id string, parent_id string, start_ns long, end_ns long")
    assert [r["root_id"] for r in X.with_depth(X.trace_tree(s)).collect()] == [None, None]


def test_red(spark):
    rows = [(1_000_000_000, 1_100_000_000, "svc", "op", "p", "SERVER", "OK"), (1_200_000_000, 1_300_000_000, "svc", "op", "", "SERVER", "ERROR"), (61_000_000_000, 61_400_000_000, "svc", "op2", "p", "SERVER", "OK")]
    e = spark.createDataFrame(rows, "ts_start_ns long, ts_end_ns long, service string, name string, peer string, kind string, status string")
    out = {(r["grouping"], r["group_name"], r["ts_ms"]): (r["total"], r["errors"], r["p50"]) for r in R.series(e, 0, 10**12, "svc", "MINUTELY").collect()}
    assert out["service", "svc", 0] == (2, 1, 100.0) and out["service", "svc", 60_000] == (1, 0, 400.0)
    assert out["peer", "p", 0] == (1, 0, 100.0) and ("peer", "", 0) not in out and out["op", "op2", 60_000] == (1, 0, 400.0)


def test_logs(spark):
    rows = [(i, "ab"[i % 2], 10 * (i % 3), f"body {i} " + ("failed" if i in (3, 7) else "ok"), "s", str(i)) for i in range(10)]
    logs = spark.createDataFrame(rows, "ts_ms long, trace_id string, level int, body string, service string, doc_id string")
    count = lambda tree: L.query(logs, 0, 100, tree).count()
    assert count({"kind": "BODY", "pattern": "failed"}) == 2 and count({"kind": "TRACE", "value": "a"}) == 5
    assert count({"kind": "OR", "children": [{"kind": "LEVEL", "value": 20}, {"kind": "TRACE", "value": "a"}]}) == 6
    assert L.union_of_sources([logs, logs]).count() == 10
    with pytest.raises(ValueError):
        L.condition({"kind": "BODY", "pattern": "(?=x)"})


def test_rollup_merges_like_one_pass(spark, data):
    out = {(r["resolution"], r["series_key"]): r for r in U.rollup(P.select(data, "cpu_usage")).groupBy("resolution", "series_key").agg(F.sum("n").alias("n"), F.sum("sum").alias("sum"), F.max("var").alias("var")).collect()}
    assert {k[0] for k in out} == {"s", "m", "h"} and all(r["n"] == 4 for r in out.values())
    hour = U.read(U.rollup(P.select(data, "cpu_usage"), "h"), "P50").orderBy("value").collect()
    assert [r["value"] for r in hour] == [20.0, 60.0]


def test_topk_names_and_ties(data):
    out = V.aggregate(over(data, "cpu_usage"), "topk", parameter=1).select("metric", label_text("labels").alias("l"), "value").distinct().collect()
    assert {r["metric"] for r in out} == {"topk"} and all("i2" in r["l"] for r in out)


def test_label_sets_are_not_merged_and_patterns_match_whole_values(spark):
    """Labels whose text would look alike stay apart; a value with a line feed at its end is no match."""
    rows = [("m", {"a": "1,b=2"}, 1000, 5.0), ("m", {"a": "1", "b": "2"}, 1000, 6.0), ("m{", {}, 1000, 1.0), ("m", {"a": "ok\n"}, 1000, 7.0), ("m", {"a": "1\\"}, 1000, 8.0)]
    samples = spark.createDataFrame(rows, "metric string, labels map<string,string>, ts_ms long, value double")
    out = P.over_time(samples, Grid(1000, 1000, 1000), 1000, "sum_over_time")
    assert sorted(r["value"] for r in out.collect()) == [1.0, 5.0, 6.0, 7.0, 8.0]
    assert P.select(samples, "m", [("a", "=~", "ok")]).count() == 0 and P.select(samples, "m", [("a", "=~", "(?s)ok.")]).count() == 1


def test_wrong_kind_fails(spark):
    rows = [("m", {"a": "1"}, 1000, 5.0, "SUM")]
    samples = spark.createDataFrame(rows, "metric string, labels map<string,string>, ts_ms long, value double, event_type string")
    with pytest.raises(Exception, match="not a GAUGE but a SUM"):
        P.over_time(samples, Grid(1000, 1000, 1000), 1000, "avg_over_time").collect()
    assert P.counter_function(samples, Grid(1000, 1000, 1000), 1000, "increase").first()["value"] == 5.0
    with pytest.raises(Exception, match="not a SUM but a GAUGE"):
        P.counter_function(samples.withColumn("event_type", F.lit("GAUGE")), Grid(1000, 1000, 1000), 1000, "rate").collect()


def test_ties_and_last_two(spark):
    """Of samples at one time the larger counts as the last; the last two of a window are those inside it."""
    rows = [("m", {}, t, v) for t, v in ((1000, 1.0), (2000, 5.0), (2000, 9.0), (3000, 2.0))]
    samples = spark.createDataFrame(rows, "metric string, labels map<string,string>, ts_ms long, value double")
    grid = Grid(2000, 4000, 1000)
    got = {(f, r["ts_ms"]): r["value"] for f in ("last_over_time", "idelta", "changes", "resets") for r in P.over_time(samples, grid, 2000, f).collect()}
    assert got["last_over_time", 2000] == 9.0 and got["idelta", 2000] == 4.0 and got["idelta", 3000] == -7.0
    assert math.isnan(got["idelta", 4000]) and got["changes", 2000] == 2.0 and got["resets", 3000] == 1.0


def test_combined_windows_equal_plain_ones(spark, monkeypatch):
    rows = [("m", {"a": str(i % 3)}, 137 * i % 9000, float(i % 17)) for i in range(300)]
    samples = spark.createDataFrame(rows, "metric string, labels map<string,string>, ts_ms long, value double")
    grid = Grid(500, 9000, 100)
    for f in ("avg_over_time", "last_over_time", "present_over_time", "count_over_time"):
        out = []
        for wide in (5, 10_000):
            monkeypatch.setattr(P, "WIDE", wide)
            out.append({(r["series_key"], r["ts_ms"]): round(r["value"], 9) for r in P.over_time(samples, grid, 1000, f).collect() if not math.isnan(r["value"])})
        assert out[0] == out[1] and out[0]


def test_fraction_of_a_histogram(spark):
    h = spark.createDataFrame([([10.0, 20.0, 40.0], [2, 4, 8, 6])], "bounds array<double>, counts array<int>")
    get = lambda low, high: h.select(H.fraction(low, high, F.col("bounds"), F.col("counts")).alias("x")).first()["x"]
    assert get(0.0, 10.0) == pytest.approx(2 / 20)
    assert get(15.0, 30.0) == pytest.approx((2 + 4) / 20)
    assert get(0.0, 1e9) == pytest.approx(14 / 20)
    empty = spark.createDataFrame([([1.0], [0, 0])], "bounds array<double>, counts array<int>")
    assert math.isnan(empty.select(H.fraction(0.0, 1.0, F.col("bounds"), F.col("counts")).alias("x")).first()["x"])


def test_predict_linear_and_absence(spark):
    rows = [("m", {"a": "1"}, TS[0], 1.0), ("m", {"a": "1"}, TS[1], 3.0), ("m", {"a": "1"}, TS[2], 5.0)]
    s = spark.createDataFrame(rows, SCHEMA)
    out = {r["ts_ms"]: r["value"] for r in P.over_time(s, GRID, 2 * STEP, "predict_linear", 60.0).collect()}
    assert out[TS[1]] == pytest.approx(5.0) and out[TS[2]] == pytest.approx(7.0)
    assert math.isnan(out[TS[3]])  # one sample has no slope
    late = Grid(TS[3], TS[3] + 3 * STEP, STEP)
    assert sorted(r["ts_ms"] for r in P.absent_over_time(s, late, 2 * STEP).collect()) == [TS[3] + STEP, TS[3] + 2 * STEP, TS[3] + 3 * STEP]


def test_many_gauge_requests_in_one_scan(spark):
    s = spark.createDataFrame([("m", {"a": "1"}, T0, 1.0), ("m", {"a": "1"}, T0, 3.0), ("m", {"a": "2"}, T0, 5.0)], SCHEMA)
    r = M.MetricRequest("m", T0, T0 + 1)
    rows = M.gauges_of(s, {"all": r, "one": M.MetricRequest("m", T0, T0 + 1, {"a": "1"}), "none": M.MetricRequest("x", T0, T0 + 1)}, "SECONDLY", "AVG").collect()
    assert sorted((x["request"], x["tags"], x["value"]) for x in rows) == [("all", "a=1", 2.0), ("all", "a=2", 5.0), ("one", "a=1", 2.0)]


@pytest.mark.parametrize("function, eight", [("ln", math.log(8)), ("log2", 3.0), ("log10", math.log10(8))])
def test_logarithms_at_the_edge_of_their_domain(spark, function, eight):
    v = spark.createDataFrame([("m", {}, i, x) for i, x in enumerate([8.0, 0.0, -0.0, -1.0, math.nan])], SCHEMA)
    got = [r["value"] for r in P.map_values(v, function).orderBy("ts_ms").collect()]
    assert got[0] == pytest.approx(eight) and got[1:3] == [-math.inf, -math.inf] and all(map(math.isnan, got[3:]))


def test_depth_does_not_compute_offsets_and_parents_again(spark):
    s = spark.createDataFrame([("t", "root", None, 1000, 3000), ("t", "child", "root", 1100, 2000)], "trace_id string, span_id string, parent_id string, start_ns long, end_ns long")
    plan = lambda *c: X.trace_tree(s).select(*c)._jdf.queryExecution().optimizedPlan().toString()
    assert plan("trace_id", "span_id").count("Join") == 0 and plan("trace_id", "span_id", "parent_id", "is_root").count("Join") == 1
    assert plan("offset_ns", "is_root").count("Join") == 2
