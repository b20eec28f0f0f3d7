"""Single queries over tables made for them: values at the edge of a rounding, sums whose order must not matter."""

import datetime
import math
import random

from pyspark.sql import functions as F

from pulsegrid.functions.timegrid import Grid
from pulsegrid.operators import metrics as M
from pulsegrid.operators import rollup as U
from pulsegrid.operators import samples as P
from pulsegrid.plans.catalog import QUERIES


def mean(values):
    total = 0.0
    for v in values:
        total += v
    return total / len(values)


def events(spark, tmp_path, values):
    """A folder with an events table of clicks, one user a row."""
    rows = [(i, datetime.datetime(2024, 1, 1, 23), i, "click", v, "{}") for i, v in enumerate(values)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    return str(tmp_path)


def test_products_with_pi_are_rounded_once(spark, tmp_path):
    values = [v / 100 for v in range(1, 60_000) if round(round(v / 100 * math.pi, 6), 4) != round(v / 100 * math.pi, 4)][:50]
    got = QUERIES["promql_pi"](spark, events(spark, tmp_path, values)).where("value is not null").collect()
    of = {r["labels"]: r["value"] for r in got}
    assert len(values) == 50 and of == {f"user={i}": round(v * math.pi, 4) for i, v in enumerate(values)}


def test_averages_do_not_depend_on_the_order_of_their_samples(spark):
    values = [10.15, 62.72, 50.19, 21.91, 41.05, 66.23, 40.01, 12.47, 45.55, 28.21, 28.33, 73.18]
    orders = [random.Random(i).sample(values, 12) for i in range(30)]
    # in floating point their average, 40, comes out on either side
    assert min(map(mean, orders)) < 40 < max(map(mean, orders))
    rows = [(f"m{i}", {}, 1000 * k, v) for i, order in enumerate(orders) for k, v in enumerate(order)]
    samples = spark.createDataFrame(rows, "metric string, labels map<string,string>, ts_ms long, value double").coalesce(1)
    for grid in (Grid(12_000, 12_000, 20_000), Grid(12_000, 12_000, 200)):
        average = P.over_time(samples, grid, 20_000, "avg_over_time")
        for function in ("floor", "ceil"):
            assert [r["value"] for r in P.map_values(average, function).collect()] == [40.0] * 30


def test_exact_sums_of_windows(spark):
    """Narrow and wide windows: exact in decimals, floating point for what has no such decimal, nulls apart, NaN kept."""
    cases = {"tenths": [0.1] * 10, "large": [1e300, 1.0], "small": [1e-30, 1e-30], "null": [0.1, None, 0.2], "nan": [1.0, math.nan], "over": [9e17] * 5, "inf": [math.inf, 1.0]}
    rows = [(name, {}, 1000 * i, v) for name, vs in cases.items() for i, v in enumerate(vs)]
    samples = spark.createDataFrame(rows, "metric string, labels map<string,string>, ts_ms long, value double")
    sums = {"tenths": 1.0, "large": 1e300, "small": 2e-30, "null": 0.3, "nan": math.nan, "over": 4.5e18, "inf": math.inf}
    for grid in (Grid(10_000, 10_000, 20_000), Grid(10_000, 10_000, 200)):
        for function in ("sum_over_time", "avg_over_time"):
            for r in P.over_time(samples, grid, 20_000, function).collect():
                n = len([v for v in cases[r["metric"]] if v is not None]) if function == "avg_over_time" else 1
                want = sums[r["metric"]] / n
                assert r["value"] == want or math.isnan(r["value"]) and math.isnan(want), (r["metric"], function, r["value"])


def test_a_search_finds_more_paths_than_a_listing_shows(spark):
    n = M.PATHS_MOST + 500
    user = F.col("id").cast("string")
    catalogue = spark.range(n).select(F.lit("view").alias("metric"), F.create_map(F.lit("user"), user).alias("labels"), F.lit("GAUGE").alias("event_type"), F.lit(None).cast("string").alias("temporality"), F.lit(1).alias("ts_start"), F.lit(2).alias("ts_end"))
    assert M.search(catalogue, 0, 10, any_pattern="view").count() == n
    assert M.search(catalogue, 0, 10, any_value="view").count() == n
    assert M.search(catalogue, 0, 10, name_pattern="v.*").count() == n
    assert M.paths(catalogue, 0, 10).count() == M.PATHS_MOST


def test_the_logarithm_of_an_hour_of_zeros(spark, tmp_path):
    values = [0.0, -0.0, 1.0, -1.0]
    got = {r["series_key"]: r["value"] for r in QUERIES["rollup_log"](spark, events(spark, tmp_path, values)).collect()}
    # a negative number has none, shown as null
    assert got == {"click{user=0}": -math.inf, "click{user=1}": -math.inf, "click{user=2}": 0.0, "click{user=3}": None}
    series = spark.createDataFrame([("s", i, v) for i, v in enumerate([0.0, None, math.nan])], "series_key string, ts_ms long, value double")
    logs = [r["value"] for r in U.transform(series, "LOG").orderBy("ts_ms").collect()]
    assert logs[0] == -math.inf and math.isnan(logs[2])
