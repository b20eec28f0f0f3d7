"""The registered queries, each with the SQL that gives the same rows.

Every query runs over its whole tables. Labels are shown as text, derived numbers are rounded to six digits, NaN is shown as
NULL. Limits are those of the request kinds, always under a total order.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import requests as Q
from ..functions import series as S
from ..functions.timegrid import Grid, duration_ms, instant_ms
from ..operators import histograms as H
from ..operators import logs as L
from ..operators import metrics as M
from ..operators import red as R
from ..operators import rollup as U
from ..operators import samples as P
from ..operators import spans as X
from ..operators import vectors as V
from ..sources import otlp as O
from ..sources import tables as T

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def add(name: str, sql: str, build: Query) -> None:
    QUERIES[name], SQL[name] = build, sql


T0, DAY, HOUR = instant_ms("2024-01-01T00:00:00Z"), duration_ms("1d"), duration_ms("1h")
#: The grid of the gauge queries, and that of the yearly tables: both span all of their tables' days.
GRID = Grid(T0, T0 + 30 * DAY, duration_ms("12h"))
O0 = instant_ms("1995-01-01")
ORDERS = Grid(O0, O0 + 2520 * DAY, duration_ms("30d"))


def shown(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """metric, labels as text, ts_ms and the value, rounded once: a second rounding to fewer digits would move what the first
    made a tie."""
    v = F.col("value").cast("double")
    return df.select(*(columns or ("metric",)), S.label_text("labels").alias("labels"), "ts_ms", F.round(F.nanvl(v, F.lit(None).cast("double")), digits).alias("value"))


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(F.nanvl(F.col(c), F.lit(None).cast("double")), 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


# -- the sources in SQL ------------------------------------------------------------------------------------------------

GAUGES = "gauges AS (SELECT event_type AS metric, 'user=' || CAST(user_id AS VARCHAR) AS labels, CAST(user_id AS VARCHAR) AS usr, CAST(epoch_us(ts) // 1000 AS BIGINT) AS ts_ms, value FROM events)"
SUMS = f"""days AS (SELECT o_orderstatus AS status, o_orderpriority AS priority, CAST(epoch_ms(o_orderdate) - epoch_ms(o_orderdate) % {DAY} AS BIGINT) AS ts_start, count(*) AS value FROM orders GROUP BY ALL),
sums AS (SELECT 'orders' AS metric, 'priority=' || priority || ',status=' || status AS labels, status, priority, ts_start, ts_start + {DAY} AS ts_end, ts_start + {DAY} AS ts_ms, CAST(value AS DOUBLE) AS value FROM days)"""
_BUCKETS = ", ".join(
    f"CAST(count(*) FILTER ({cond}) AS BIGINT) AS c{i}"
    for i, cond in enumerate(["l_extendedprice <= 10000", *[f"l_extendedprice > {k}0000 AND l_extendedprice <= {k + 1}0000" for k in range(1, 5)], "l_extendedprice > 50000"])
)
HISTOS = f"histos AS (SELECT 'flag=' || l_returnflag AS labels, CAST(epoch_ms(l_shipdate) - epoch_ms(l_shipdate) % {DAY} AS BIGINT) AS ts_start, CAST(epoch_ms(l_shipdate) - epoch_ms(l_shipdate) % {DAY} AS BIGINT) + {DAY} AS ts_end, {_BUCKETS} FROM lineitem GROUP BY ALL)"
SPANS = """spans AS (SELECT CAST(l_orderkey AS VARCHAR) AS trace_id, CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS span_id,
CASE WHEN l_linenumber > 1 THEN CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber - 1 AS VARCHAR) END AS parent_id,
'svc-' || CAST(l_suppkey % 10 AS VARCHAR) AS service, 'peer-' || CAST(l_partkey % 4 AS VARCHAR) AS peer, 'op-' || lpad(CAST(l_partkey % 25 AS VARCHAR), 2, '0') AS name,
CASE WHEN l_linestatus = 'O' THEN 'SERVER' ELSE 'CLIENT' END AS kind, CASE l_returnflag WHEN 'R' THEN 'ERROR' WHEN 'A' THEN 'OK' ELSE 'UNK' END AS status,
CAST((epoch_ms(l_shipdate) + l_linenumber * 1000) * 1000000 AS BIGINT) AS start_ns, CAST((epoch_ms(l_shipdate) + l_linenumber * 1000) * 1000000 + CAST(l_quantity AS BIGINT) * 10000000 AS BIGINT) AS end_ns,
CASE WHEN l_linenumber % 2 = 0 THEN 'GET' ELSE 'POST' END AS http_method, CAST(200 + (l_suppkey % 4) * 100 AS INTEGER) AS http_status, CASE WHEN l_partkey % 3 = 0 THEN 'postgres' END AS db_system,
l_returnflag AS flag, CAST(l_linenumber AS VARCHAR) AS line, l_extendedprice AS price, l_tax AS tax FROM lineitem)"""
LOGS = "logs AS (SELECT conv_id * 60000 + turn * 1000 AS ts_ms, CAST(conv_id AS VARCHAR) AS trace_id, CAST(CASE role WHEN 'system' THEN 10 WHEN 'user' THEN 20 ELSE 30 END AS INTEGER) AS level, text AS body, 'svc-' || CAST(conv_id % 5 AS VARCHAR) AS service, CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS doc_id FROM conversations)"


def _r(expr: str) -> str:
    return f"round(CASE WHEN isnan({expr}) THEN NULL ELSE {expr} END, 6)"


def _grid(g: Grid, name: str = "grid") -> str:
    return f"{name} AS (SELECT unnest(generate_series(CAST({g.start} AS BIGINT), CAST({g.start + g.last * g.step} AS BIGINT), CAST({g.step} AS BIGINT))) AS t)"


def _window(agg: str, metric: str = "click", g: Grid = GRID, r: int = DAY, source: str = "gauges", empty: str = "NULL", name: str = "w") -> str:
    """CTEs for a range function: agg over x in (t - r, t], for all series with a sample in range; columns metric, labels, t, v."""
    near = f"{name}n AS (SELECT * FROM {source} WHERE metric = '{metric}' AND ts_ms BETWEEN {g.start - r} AND {g.end})"
    return f"""{near}, {name}s AS (SELECT DISTINCT metric, labels FROM {name}n), {_grid(g, name + "g")},
{name} AS (SELECT s.metric, s.labels, g.t, coalesce({agg}, {empty}) AS v FROM {name}s s CROSS JOIN {name}g g LEFT JOIN {name}n x ON x.metric = s.metric AND x.labels = s.labels AND x.ts_ms > g.t - {r} AND x.ts_ms <= g.t GROUP BY ALL)"""


def _show(select: str = "metric, labels, t AS ts_ms, " + _r("v") + " AS value FROM w") -> str:
    return f" SELECT {select}"


def g(spark: SparkSession, d: str, metric: str = "click") -> DataFrame:
    return P.select(T.gauges(spark, d), metric)


def avg(spark: SparkSession, d: str, metric: str = "click") -> DataFrame:
    return P.over_time(g(spark, d, metric), GRID, DAY, "avg_over_time")


# -- selectors ---------------------------------------------------------------------------------------------------------

_look = f"near AS (SELECT * FROM gauges WHERE metric = 'click'), {_grid(GRID)}, w AS (SELECT x.metric, x.labels, g.t, arg_max(x.value, x.ts_ms) AS v FROM grid g JOIN near x ON x.ts_ms > g.t - {{look}} AND x.ts_ms <= g.t GROUP BY ALL)"
add("promql_instant_selector", f"WITH {GAUGES}, {_look.format(look=6 * HOUR)}" + _show(), lambda s, d: shown(P.instant(g(s, d), GRID, 6 * HOUR)))
add("promql_offset", f"WITH {GAUGES.replace('CAST(epoch_us(ts) // 1000 AS BIGINT)', f'CAST(epoch_us(ts) // 1000 + {2 * DAY} AS BIGINT)')}, {_look.format(look=6 * HOUR)}" + _show(), lambda s, d: shown(P.instant(P.offset(g(s, d), 2 * DAY), GRID, 6 * HOUR)))
_AT = (T0 + 10 * DAY) / 1000
add("promql_at", f"WITH {GAUGES}, {_window('avg(x.value)', g=GRID.pinned(_AT))}" + _show(), lambda s, d: shown(P.over_time(g(s, d), GRID.pinned(_AT), DAY, "avg_over_time")))
add("promql_range_selector", f"WITH {GAUGES} SELECT metric, labels, ts_ms, round(value, 6) AS value FROM gauges WHERE metric = 'view' AND ts_ms BETWEEN {GRID.start - DAY} AND {GRID.end}", lambda s, d: shown(P.raw_range(g(s, d, "view"), GRID, DAY)))
for _name, _op, _value, _cond in (("eq", "=", "7", "usr = '7'"), ("ne", "!=", "7", "usr <> '7'"), ("regex", "=~", "1[0-4].*", "regexp_full_match(usr, '1[0-4].*')"), ("not_regex", "!~", "1.*|2", "NOT regexp_full_match(usr, '1.*|2')")):
    add(f"promql_match_{_name}", f"WITH {GAUGES} SELECT metric, labels, ts_ms, round(value, 6) AS value FROM gauges WHERE metric = 'error' AND {_cond}", lambda s, d, m=("user", _op, _value): shown(P.select(T.gauges(s, d), "error", [m])))
add("promql_match_name", f"WITH {GAUGES} SELECT metric, labels, ts_ms, round(value, 6) AS value FROM gauges WHERE regexp_full_match(metric, 'c.*|error')", lambda s, d: shown(P.select(T.gauges(s, d), None, [("__name__", "=~", "c.*|error")])))
add("promql_match_absent_label", f"WITH {GAUGES} SELECT metric, 'host=' || usr || ',' || labels AS labels, ts_ms, round(value, 6) AS value FROM gauges WHERE metric = 'click' AND starts_with(usr, '1') AND usr <> '12'", lambda s, d: shown(P.select(T.gauges(s, d).withColumn("labels", F.when(F.col("labels")["user"].startswith("1"), F.map_concat("labels", F.create_map(F.lit("host"), F.col("labels")["user"]))).otherwise(F.col("labels"))), "click", [("host", "!=", "12")])))
add("promql_union_of_selectors", f"WITH {GAUGES} SELECT metric, count(*) AS n FROM gauges WHERE metric = 'view' OR usr = '7' GROUP BY metric", lambda s, d: P.union_of(T.gauges(s, d), [("view", []), (None, [("user", "=", "7")])]).groupBy("metric").agg(F.count("*").alias("n")))
add("promql_series_discovery", f"WITH {GAUGES}, c AS (SELECT metric, labels, min(ts_ms) AS a, max(ts_ms) AS b FROM gauges GROUP BY ALL) SELECT metric || '{{' || labels || '}}' AS series_key, metric FROM c WHERE a <= {T0 + 9 * DAY} AND b >= {T0 + 5 * DAY} AND regexp_full_match(replace(labels, 'user=', ''), '.*3')", lambda s, d: P.discover(T.catalogue_of(T.gauges(s, d), "GAUGE"), T0 + 5 * DAY, T0 + 9 * DAY, None, [("user", "=~", ".*3")]).select("series_key", "metric"))
add("promql_metric_kind", f"WITH {GAUGES} SELECT metric, 'GAUGE' AS event_type, count(*) AS n FROM gauges GROUP BY metric", lambda s, d: P.with_kind(T.gauges(s, d), T.catalogue(s, d)).groupBy("metric", "event_type").agg(F.count("*").alias("n")))

# -- range functions ---------------------------------------------------------------------------------------------------

_last_two = "list(x.value ORDER BY x.ts_ms DESC)"
_OVER = {
    "avg_over_time": ("avg(x.value)", "NULL"), "min_over_time": ("min(x.value)", "NULL"), "max_over_time": ("max(x.value)", "NULL"), "sum_over_time": ("sum(x.value)", "0"),
    "count_over_time": ("CAST(count(x.value) AS DOUBLE)", "0"), "last_over_time": ("arg_max(x.value, x.ts_ms)", "NULL"), "present_over_time": ("CASE WHEN count(x.value) > 0 THEN 1.0::DOUBLE END", "0"),
    "quantile_over_time": ("quantile_cont(x.value, 0.9)", "NULL"), "stddev_over_time": ("stddev_pop(x.value)", "NULL"), "stdvar_over_time": ("var_pop(x.value)", "NULL"),
    "delta": ("arg_max(x.value, x.ts_ms) - arg_min(x.value, x.ts_ms)", "NULL"), "idelta": (f"CASE WHEN count(x.value) > 1 THEN {_last_two}[1] - {_last_two}[2] END", "NULL"),
    "deriv": ("CASE WHEN count(x.value) > 1 THEN (arg_max(x.value, x.ts_ms) - arg_min(x.value, x.ts_ms)) / greatest((max(x.ts_ms) - min(x.ts_ms)) / 1000.0::DOUBLE, 1.0::DOUBLE) END", "NULL"),
}
for _f, (_agg, _empty) in _OVER.items():
    add(f"promql_{_f}", f"WITH {GAUGES}, {_window(_agg, empty=_empty)}" + _show(), lambda s, d, f=_f: shown(P.over_time(g(s, d), GRID, DAY, f, 0.9)))
for _f, _cond in (("changes", "x.value <> x.p"), ("resets", "x.value < x.p")):
    _src = f"{GAUGES}, near AS (SELECT * FROM gauges WHERE metric = 'view'), {_grid(GRID)}, j AS (SELECT x.metric, x.labels, g.t, x.value, lag(x.value) OVER (PARTITION BY x.labels, g.t ORDER BY x.ts_ms) AS p FROM grid g JOIN near x ON x.ts_ms > g.t - {2 * DAY} AND x.ts_ms <= g.t), w AS (SELECT metric, labels, t, CAST(count(*) FILTER ({_cond}) AS DOUBLE) AS v FROM j x GROUP BY ALL)"
    add(f"promql_{_f}", f"WITH {_src}" + _show(), lambda s, d, f=_f: shown(P.over_time(g(s, d, "view"), GRID, 2 * DAY, f).where(~F.isnan("value"))))
# sums of averages may end in a five at the fifth digit, so they are rounded beyond it
_WIDE = Grid(T0, T0 + 30 * DAY, 2 * HOUR)
for _f, (_agg, _empty) in {k: _OVER[k] for k in ("sum_over_time", "count_over_time", "min_over_time", "max_over_time", "avg_over_time", "last_over_time", "present_over_time")}.items():
    add(f"promql_wide_{_f}", f"WITH {GAUGES}, {_window(_agg, 'error', _WIDE, 7 * DAY, empty=_empty)} SELECT metric, t AS ts_ms, round(sum(v), {9 if _f == "avg_over_time" else 4}) AS value, count(v) AS n FROM w WHERE v IS NOT NULL GROUP BY ALL", lambda s, d, f=_f: P.over_time(g(s, d, "error"), _WIDE, 7 * DAY, f).where(~F.isnan("value")).groupBy("metric", "ts_ms").agg(F.round(F.sum("value"), 9 if f == "avg_over_time" else 4).alias("value"), F.count("value").alias("n")))
for _f, _agg, _empty in (("increase", "sum(x.value)", "0"), ("rate", f"sum(x.value) / {60 * DAY / 1000}", "0"), ("irate", f"CASE WHEN count(x.value) > 1 THEN {_last_two}[1] / greatest((list(x.ts_ms ORDER BY x.ts_ms DESC)[1] - list(x.ts_ms ORDER BY x.ts_ms DESC)[2]) / 1000.0::DOUBLE, 1.0::DOUBLE) END", "NULL")):
    _sql = f"WITH {SUMS}, {_window(_agg, 'orders', ORDERS, 60 * DAY, 'sums', _empty)} SELECT metric, labels, t AS ts_ms, round(v, 9) AS value FROM w"
    _show9 = lambda df: df.select("metric", S.label_text("labels").alias("labels"), "ts_ms", F.round(F.nanvl("value", F.lit(None).cast("double")), 9).alias("value"))
    add(f"promql_{_f}", _sql, lambda s, d, f=_f, w=_show9: w(P.counter_function(P.delta_samples(T.sums(s, d)), ORDERS, 60 * DAY, f)))
    add(f"promql_{_f}_of_cumulative", _sql, lambda s, d, f=_f, w=_show9: w(P.counter_function(P.delta_samples(T.cumulative_sums(s, d)), ORDERS, 60 * DAY, f)))
_ahead = "CASE WHEN max(x.ts_ms) > min(x.ts_ms) THEN regr_intercept(x.value, (x.ts_ms - g.t) / 1000.0::DOUBLE) + regr_slope(x.value, (x.ts_ms - g.t) / 1000.0::DOUBLE) * 3600 END"
add("promql_predict_linear", f"WITH {GAUGES}, {_window(_ahead, r=2 * DAY)} SELECT metric, labels, t AS ts_ms, round(v, 4) AS value FROM w", lambda s, d: P.over_time(g(s, d), GRID, 2 * DAY, "predict_linear", 3600.0).select("metric", S.label_text("labels").alias("labels"), "ts_ms", F.round(F.nanvl("value", F.lit(None).cast("double")), 4).alias("value")))
add("promql_absent_over_time", f"WITH {GAUGES}, {_look.format(look=DAY).replace("metric = 'click'", "metric = 'click' AND usr = '3'")}, g2 AS (SELECT t FROM grid EXCEPT SELECT t FROM w) SELECT 'absent' AS metric, 'user=3' AS labels, t AS ts_ms, 1.0::DOUBLE AS value FROM g2", lambda s, d: shown(P.absent_over_time(P.select(T.gauges(s, d), "click", [("user", "=", "3")]), GRID, DAY, {"user": "3"})))
add("promql_offset_of_sums", f"WITH {SUMS} SELECT labels, ts_end + {7 * DAY} AS ts_end, CAST(value AS BIGINT) AS value FROM sums", lambda s, d: P.offset(T.sums(s, d), 7 * DAY, "ts_end").select(S.label_text("labels").alias("labels"), "ts_end", "value"))
add("promql_match_variable", f"WITH {GAUGES} SELECT metric, labels, ts_ms, round(value, 6) AS value FROM gauges WHERE metric = 'error' AND regexp_full_match(usr, '2.*')", lambda s, d: shown(P.select(T.gauges(s, d), Q.hydrate("{{metric}}", {"metric": "error"}), [("user", "=~", Q.substitute("$__{first}.*$__{unknown}", {"first": "2"}))])))
_inner = Grid(GRID.start - 2 * DAY, GRID.end, 6 * HOUR)
add("promql_subquery", f"WITH {GAUGES}, {_window('avg(x.value)', g=_inner)}, fine AS (SELECT metric, labels, t AS ts_ms, v AS value FROM w), {_window('max(x.value)', g=GRID, r=2 * DAY, source='fine', name='p')} SELECT metric, labels, t AS ts_ms, round(v, 6) AS value FROM p", lambda s, d: shown(P.over_time(P.subquery(P.over_time(g(s, d), P.inner_grid(GRID, 2 * DAY, 6 * HOUR), DAY, "avg_over_time").where(~F.isnan("value"))), GRID, 2 * DAY, "max_over_time")))

# -- functions of vectors ----------------------------------------------------------------------------------------------

_AVG = f"WITH {GAUGES}, {_window('avg(x.value)')}"
for _f, _expr in {"abs": "abs(v)", "ceil": "ceil(v)", "floor": "floor(v)", "exp": "exp(v / 100)", "ln": "ln(v)", "log2": "log2(v)", "log10": "log10(v)", "sqrt": "sqrt(v)", "sgn": "CAST(sign(v) AS DOUBLE)", "sin": "sin(v)", "cos": "cos(v)", "atan": "atan(v)", "tanh": "1 - 2 / (exp(2 * v / 100) + 1)", "deg": "degrees(v)", "rad": "radians(v)"}.items():
    add(f"promql_{_f}", _AVG + f" SELECT metric, labels, t AS ts_ms, round({_expr}, 6) AS value FROM w", lambda s, d, f=_f: shown(P.map_values(V.with_scalar(avg(s, d), "/", 100.0) if f in ("exp", "tanh") else avg(s, d), f)))
for _f in ("tan", "asin", "acos", "sinh", "cosh", "asinh", "atanh"):
    add(f"promql_{_f}", _AVG + f" SELECT metric, labels, t AS ts_ms, round({_f}(v / 1000), 6) AS value FROM w", lambda s, d, f=_f: shown(P.map_values(V.with_scalar(avg(s, d), "/", 1000.0), f)))
add("promql_acosh", _AVG + " SELECT metric, labels, t AS ts_ms, round(CASE WHEN v >= 1 THEN acosh(v) END, 6) AS value FROM w", lambda s, d: shown(P.map_values(avg(s, d), "acosh")))
add("promql_pi", _AVG + " SELECT metric, labels, t AS ts_ms, round(v * pi(), 4) AS value FROM w", lambda s, d: shown(V.with_scalar(avg(s, d), "*", math.pi), digits=4))
add("promql_scalar_with_scalar", _AVG + " SELECT metric, labels, t AS ts_ms, round(v + 2.5::DOUBLE * (7 % 4) - 1, 4) AS value FROM w", lambda s, d: shown(V.with_scalar(avg(s, d), "+", V.scalar_op("-", V.scalar_op("*", 2.5, V.scalar_op("%", 7.0, 4.0)), V.scalar_op(">", 3.0, 2.0, as_bool=True))), digits=4))
add("promql_points_between", _AVG + f" SELECT metric, labels, t AS ts_ms, round(v, 6) AS value FROM w WHERE t >= {T0 + 3 * DAY} AND t < {T0 + 5 * DAY} OR t = {T0 + 9 * DAY}", lambda s, d: shown(P.points_between(avg(s, d), T0 + 3 * DAY, T0 + 5 * DAY).unionByName(P.points_at(avg(s, d), T0 + 9 * DAY))))
add("promql_round", _AVG + " SELECT metric, labels, t AS ts_ms, round_even(v, 0) AS value FROM w", lambda s, d: shown(P.map_values(avg(s, d), "round")))
for _f, _args, _expr in (("clamp", (20.0, 60.0), "least(greatest(v, 20.0), 60.0)"), ("clamp_min", (20.0,), "greatest(v, 20.0)"), ("clamp_max", (60.0,), "least(v, 60.0)")):
    add(f"promql_{_f}", _AVG + f" SELECT metric, labels, t AS ts_ms, round(CASE WHEN v IS NULL THEN NULL ELSE CAST({_expr} AS DOUBLE) END, 6) AS value FROM w", lambda s, d, f=_f, a=_args: shown(P.map_values(avg(s, d), f, *a)))
for _f, _expr in {"hour": "hour", "minute": "minute", "day_of_month": "day", "day_of_week": "dayofweek", "day_of_year": "dayofyear", "month": "month", "year": "year", "days_in_month": "last"}.items():
    _part = f"CAST({_expr}(make_timestamp(t * 1000)) AS DOUBLE)" if _expr != "last" else "CAST(day(last_day(make_timestamp(t * 1000))) AS DOUBLE)"
    add(f"promql_{_f}", _AVG + f" SELECT metric, labels, t AS ts_ms, {_part} AS value FROM w", lambda s, d, f=_f: shown(P.map_values(P.timestamps(avg(s, d)), f)))
add("promql_timestamp", _AVG + " SELECT metric, labels, t AS ts_ms, t / 1000.0::DOUBLE AS value FROM w", lambda s, d: shown(P.timestamps(avg(s, d))))
add("promql_time", _AVG + " SELECT metric, labels, t AS ts_ms, round(t / 1000.0::DOUBLE - v, 4) AS value FROM w", lambda s, d: shown(V.with_scalars(avg(s, d), "-", P.times(T.gauges(s, d), GRID), scalar_left=True), digits=4))
add("promql_scalar", f"WITH {GAUGES}, {_grid(GRID)}, {_window('sum(x.value)', empty='0')}, a AS (SELECT t, sum(v) AS v FROM w GROUP BY t) SELECT t AS ts_ms, round(a.v, 6) AS value FROM grid LEFT JOIN a USING (t)", lambda s, d: rounded(P.scalar(V.aggregate(P.over_time(g(s, d), GRID, DAY, "sum_over_time"), "sum"), GRID)))
add("promql_absent", f"WITH {GAUGES}, {_look.format(look=4 * HOUR).replace("metric = 'click'", "metric = 'click' AND usr = '3'")}, g2 AS (SELECT t FROM grid EXCEPT SELECT t FROM w) SELECT 'absent' AS metric, 'user=3' AS labels, t AS ts_ms, 1.0::DOUBLE AS value FROM g2", lambda s, d: shown(P.absent(P.instant(P.select(T.gauges(s, d), "click", [("user", "=", "3")]), GRID, 4 * HOUR), GRID, {"user": "3"})))
add("promql_vector", f"WITH {GAUGES}, {_window('sum(x.value)', empty='0')}, a AS (SELECT t, sum(v) AS v FROM w GROUP BY t) SELECT '' AS metric, '' AS labels, t AS ts_ms, round(v, 6) AS value FROM a", lambda s, d: shown(P.vector(P.scalar(V.aggregate(P.over_time(g(s, d), GRID, DAY, "sum_over_time"), "sum"), GRID))))
for _f, _dir in (("sort", "ASC"), ("sort_desc", "DESC")):
    add(f"promql_{_f}_first", _AVG + f" SELECT metric, labels, t AS ts_ms, round(v, 6) AS value FROM w WHERE v IS NOT NULL ORDER BY v {_dir}, 'click{{' || labels || '}}', t LIMIT 50", lambda s, d, x=_dir == "DESC": shown(P.sort(avg(s, d).where(~F.isnan("value")), x).limit(50)))
add("promql_sort_desc", _AVG + " SELECT metric, labels, t AS ts_ms, round(v, 6) AS value FROM w WHERE v IS NOT NULL ORDER BY v DESC", lambda s, d: shown(P.sort(avg(s, d).where(~F.isnan("value")), True)))
add("promql_matrix", _AVG + " SELECT labels, count(*) AS points, min(t) AS first_ms, max(t) AS last_ms FROM w GROUP BY labels", lambda s, d: P.to_matrix(avg(s, d)).select(S.label_text("labels").alias("labels"), F.size("points").cast("long").alias("points"), F.col("points")[0]["ts_ms"].alias("first_ms"), F.element_at("points", -1)["ts_ms"].alias("last_ms")))
add("promql_label_replace", f"WITH {GAUGES} SELECT CASE WHEN regexp_full_match(usr, '(.).*') THEN 'digit=' || substr(usr, 1, 1) ELSE '' END AS digit, count(*) AS n FROM gauges GROUP BY ALL", lambda s, d: T.gauges(s, d).select(S.label_text(S.keep_labels(S.label_replace(F.col("labels"), "digit", "$1", "user", "(.).*"), ["digit"])).alias("digit")).groupBy("digit").agg(F.count("*").alias("n")))
add("promql_label_join", f"WITH {SUMS} SELECT status || '-' || priority AS both_labels, count(*) AS n FROM sums GROUP BY ALL", lambda s, d: T.sums(s, d).select(S.label_join(F.col("labels"), "both", "-", ["status", "priority"])["both"].alias("both_labels")).groupBy("both_labels").agg(F.count("*").alias("n")))

# -- aggregations ------------------------------------------------------------------------------------------------------

_INC = f"WITH {SUMS}, {_window('sum(x.value)', 'orders', ORDERS, 30 * DAY, 'sums', '0')}, l AS (SELECT *, split_part(split_part(labels, ',', 1), '=', 2) AS priority, split_part(labels, 'status=', 2) AS status FROM w)"


def inc(s: SparkSession, d: str) -> DataFrame:
    return P.counter_function(P.delta_samples(T.sums(s, d)), ORDERS, 30 * DAY, "increase")


for _op, _expr in {"sum": "sum(v)", "avg": "avg(v)", "min": "min(v)", "max": "max(v)", "count": "CAST(count(v) AS DOUBLE)", "group": "1.0::DOUBLE", "stddev": "stddev_pop(v)", "stdvar": "var_pop(v)", "quantile": "quantile_cont(v, 0.75)"}.items():
    add(f"promql_{_op}_by", _INC + f" SELECT '{_op}' AS metric, 'status=' || status AS labels, t AS ts_ms, round({_expr}, 6) AS value FROM l GROUP BY status, t", lambda s, d, o=_op: shown(V.aggregate(inc(s, d), o, by=["status"], parameter=0.75)))
add("promql_sum_without", _INC + " SELECT 'sum' AS metric, 'priority=' || priority AS labels, t AS ts_ms, round(sum(v), 6) AS value FROM l GROUP BY priority, t", lambda s, d: shown(V.aggregate(inc(s, d), "sum", without=["status"])))
add("promql_sum_all", _INC + " SELECT 'sum' AS metric, '' AS labels, t AS ts_ms, round(sum(v), 6) AS value FROM l GROUP BY t", lambda s, d: shown(V.aggregate(inc(s, d), "sum")))
for _op, _dir in (("topk", "DESC"), ("bottomk", "ASC")):
    add(f"promql_{_op}", _INC + f", p AS (SELECT *, row_number() OVER (PARTITION BY status, t ORDER BY v {_dir}, 'orders{{' || labels || '}}') AS k FROM l) SELECT '{_op}' AS metric, labels, t AS ts_ms, round(v, 6) AS value FROM p WHERE k <= 2", lambda s, d, o=_op: shown(V.aggregate(inc(s, d), o, by=["status"], parameter=2)))
add("promql_count_values", _INC + " SELECT status, t AS ts_ms, v AS amount, CAST(count(*) AS DOUBLE) AS value FROM l GROUP BY ALL", lambda s, d: V.aggregate(inc(s, d), "count_values", by=["status"], parameter="v").select(F.col("labels")["status"].alias("status"), "ts_ms", F.col("labels")["v"].cast("double").alias("amount"), "value"))

# -- binary operators --------------------------------------------------------------------------------------------------

_TWO = f"WITH {GAUGES}, {_window('avg(x.value)')}, {_window('avg(x.value)', 'view', name='p')}"
for _name, _op, _expr in (("add", "+", "v + 2.5"), ("subtract", "-", "v - 2.5"), ("multiply", "*", "v * 2.5"), ("divide", "/", "v / 2.5"), ("modulo", "%", "v % 2.5"), ("power", "^", "pow(v / 100, 2.5)")):
    add(f"promql_{_name}_scalar", _AVG + f" SELECT metric, labels, t AS ts_ms, round(round({_expr.replace('2.5', '2.5::DOUBLE')}, 6), 4) AS value FROM w WHERE v IS NOT NULL", lambda s, d, o=_op: shown(V.with_scalar(V.with_scalar(avg(s, d), "/", 100.0 if o == "^" else 1.0).where(~F.isnan("value")), o, 2.5)).withColumn("value", F.round("value", 4)))
add("promql_scalar_minus_vector", _AVG + " SELECT metric, labels, t AS ts_ms, round(100 - v, 6) AS value FROM w", lambda s, d: shown(V.with_scalar(avg(s, d), "-", 100.0, scalar_left=True)))
add("promql_negate", _AVG + " SELECT metric, labels, t AS ts_ms, round(-v, 6) AS value FROM w", lambda s, d: shown(V.negated(avg(s, d))))
add("promql_divide_by_zero", _AVG + " SELECT metric, labels, t AS ts_ms, CAST(NULL AS DOUBLE) AS value FROM w", lambda s, d: shown(V.with_scalar(avg(s, d), "/", 0.0)))
for _name, _op in (("eq", "=="), ("ne", "!="), ("gt", ">"), ("lt", "<"), ("ge", ">="), ("le", "<=")):
    _sqlop = {"==": "=", "!=": "<>"}.get(_op, _op)
    _keeps = f"coalesce(floor(v) {_sqlop} 40, {str(_op == '!=').lower()})"
    add(f"promql_filter_{_name}", _AVG + f" SELECT metric, labels, t AS ts_ms, round(floor(v), 6) AS value FROM w WHERE {_keeps}", lambda s, d, o=_op: shown(V.with_scalar(P.map_values(avg(s, d), "floor"), o, 40.0)))
    add(f"promql_bool_{_name}", _AVG + f" SELECT metric, labels, t AS ts_ms, CASE WHEN {_keeps} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS value FROM w", lambda s, d, o=_op: shown(V.with_scalar(P.map_values(avg(s, d), "floor"), o, 40.0, as_bool=True)))
for _name, _op, _expr in (("add", "+", "w.v + p.v"), ("divide", "/", "CASE WHEN p.v <> 0 THEN w.v / p.v END"), ("subtract", "-", "w.v - p.v")):
    add(f"promql_vectors_{_name}_on", _TWO + f" SELECT w.metric, w.labels, w.t AS ts_ms, round({_expr}, 6) AS value FROM w JOIN p ON p.labels = w.labels AND p.t = w.t", lambda s, d, o=_op: shown(V.binary(avg(s, d), avg(s, d, "view"), o, V.Matching(on=["user"]))))
add("promql_vectors_ignoring", _TWO + " SELECT w.metric, w.labels, w.t AS ts_ms, round(w.v * p.v, 6) AS value FROM w JOIN p ON p.labels = w.labels AND p.t = w.t", lambda s, d: shown(V.binary(avg(s, d), avg(s, d, "view"), "*", V.Matching(ignoring=["host"]))))
add("promql_vectors_compare", _TWO + " SELECT w.metric, w.labels, w.t AS ts_ms, round(w.v, 6) AS value FROM w JOIN p ON p.labels = w.labels AND p.t = w.t WHERE w.v > p.v", lambda s, d: shown(V.binary(avg(s, d), avg(s, d, "view"), ">")))
add("promql_group_left", _INC + ", a AS (SELECT status, t, sum(v) AS s FROM l GROUP BY ALL) SELECT l.metric, l.labels, l.t AS ts_ms, round(CASE WHEN a.s <> 0 THEN l.v / a.s END, 6) AS value FROM l JOIN a USING (status, t)", lambda s, d: shown(V.binary(inc(s, d), V.aggregate(inc(s, d), "sum", by=["status"]), "/", V.Matching(on=["status"], group="left"))))
add("promql_group_right", _INC + ", a AS (SELECT status, t, sum(v) AS s FROM l GROUP BY ALL) SELECT l.metric, l.labels, l.t AS ts_ms, round(a.s - l.v, 6) AS value FROM l JOIN a USING (status, t)", lambda s, d: shown(V.binary(V.aggregate(inc(s, d), "sum", by=["status"]), inc(s, d), "-", V.Matching(on=["status"], group="right"))))
_HALF = _TWO.replace("metric = 'view' AND", "metric = 'view' AND length(usr) = 1 AND")
_few = lambda s, d: P.over_time(P.select(T.gauges(s, d), "view", [("user", "=~", ".")]), GRID, DAY, "avg_over_time")
for _op, _cond in (("and", "EXISTS (SELECT 1 FROM p WHERE p.labels = w.labels AND p.t = w.t)"), ("unless", "NOT EXISTS (SELECT 1 FROM p WHERE p.labels = w.labels AND p.t = w.t)")):
    add(f"promql_{_op}", _HALF + f" SELECT metric, labels, t AS ts_ms, round(v, 6) AS value FROM w WHERE {_cond}", lambda s, d, o=_op: shown(V.set_op(avg(s, d), _few(s, d), o, V.Matching(on=["user"]))))
add("promql_or", _HALF + " SELECT metric, labels, t AS ts_ms, round(v, 6) AS value FROM p UNION ALL SELECT metric, labels, t, round(v, 6) FROM w WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.labels = w.labels AND p.t = w.t)", lambda s, d: shown(V.set_op(_few(s, d), avg(s, d), "or", V.Matching(on=["user"]))))

# -- metric requests ---------------------------------------------------------------------------------------------------

_G = M.MetricRequest("click", T0, T0 + 30 * DAY)
for _agg, _expr in {"AVG": "avg(value)", "SUM": "sum(value)", "MIN": "min(value)", "MAX": "max(value)", "COUNT": "count(value)", "P50": "quantile_cont(value, 0.5)", "P75": "quantile_cont(value, 0.75)", "P90": "quantile_cont(value, 0.9)", "P95": "quantile_cont(value, 0.95)", "P99": "quantile_cont(value, 0.99)"}.items():
    for _res, _size in (("HOURLY", HOUR), *((("SECONDLY", 1000), ("MINUTELY", 60_000)) if _agg in ("AVG", "P95") else ())):
        add(f"gauge_{_agg.lower()}_{_res.lower()}", f"WITH {GAUGES} SELECT metric, labels AS tags, ts_ms - ts_ms % {_size} AS ts_ms, {_expr if _agg == 'COUNT' else f'round({_expr}, 6)'} AS value FROM gauges WHERE metric = 'click' AND ts_ms >= {_G.start} AND ts_ms < {_G.end} GROUP BY ALL", lambda s, d, a=_agg, r=_res: rounded(M.gauge(T.gauges(s, d), _G, r, a)))
_many = {"all": _G, "week": Q.within(_G, T0 + 7 * DAY, T0 + 14 * DAY), "seven": M.MetricRequest("view", T0, T0 + 30 * DAY, {"user": "7"}), "none": M.MetricRequest("no such", T0, T0 + 30 * DAY)}
_batch = " UNION ALL ".join(f"SELECT '{n}' AS request, metric, labels AS tags, ts_ms - ts_ms % {HOUR} AS ts_ms, round(avg(value), 6) AS value FROM gauges WHERE metric = '{r.metric}' AND ts_ms >= {r.start} AND ts_ms < {r.end}{''.join(f" AND usr = '{v}'" for v in r.tags.values())} GROUP BY ALL" for n, r in _many.items())
add("gauge_batch", f"WITH {GAUGES} {_batch}", lambda s, d: rounded(M.gauges_of(T.gauges(s, d), _many, "HOURLY", "AVG")))
add("gauge_within", f"WITH {GAUGES} SELECT metric, labels AS tags, ts_ms - ts_ms % {HOUR} AS ts_ms, round(sum(value), 6) AS value FROM gauges WHERE metric = 'click' AND ts_ms >= {T0 + 7 * DAY} AND ts_ms < {T0 + 14 * DAY} GROUP BY ALL", lambda s, d: rounded(M.gauge(T.gauges(s, d), Q.within(_G, T0 + 7 * DAY, T0 + 14 * DAY), "HOURLY", "SUM")))
add("sum_tag_subset", f"WITH {SUMS} SELECT labels, ts_start, CAST(value AS BIGINT) AS value FROM sums WHERE status = 'F'", lambda s, d: T.sums(s, d).where(S.has_tags(F.col("labels"), {"status": "F"})).select(S.label_text("labels").alias("labels"), "ts_start", "value"))
_one = M.MetricRequest("orders", O0, O0 + 2520 * DAY, {"status": "F", "priority": "1-URGENT"})
_own = f"metric = 'orders' AND status = 'F' AND priority = '1-URGENT' AND ts_start < {_one.end} AND ts_end > {_one.start}"
add("sum_delta_aggregate", f"WITH {SUMS} SELECT min(ts_start) AS ts_start, max(ts_end) AS ts_end, CAST(sum(value) AS BIGINT) AS value FROM sums WHERE {_own} HAVING count(*) > 0", lambda s, d: M.sum_delta_aggregate(T.sums(s, d), _one))
add("sum_cumulative", f"WITH {SUMS}, c AS (SELECT * REPLACE (sum(value) OVER (PARTITION BY labels ORDER BY ts_start) AS value) FROM sums) SELECT ts_start, ts_end, CAST(value AS BIGINT) AS value FROM c WHERE {_own} ORDER BY value DESC, ts_end DESC LIMIT 1", lambda s, d: M.sum_cumulative(T.cumulative_sums(s, d), _one))
add("sum_exact_tags_only", f"WITH {SUMS} SELECT ts_start, ts_end, CAST(value AS BIGINT) AS value FROM sums WHERE status = 'F' AND priority = '2-HIGH'", lambda s, d: M.sum_points(T.sums(s, d), M.MetricRequest("orders", O0, O0 + 2520 * DAY, {"status": "F"}), "DELTA").unionByName(M.sum_points(T.sums(s, d), M.MetricRequest("orders", O0, O0 + 2520 * DAY, {"status": "F", "priority": "2-HIGH"}), "DELTA")).select("ts_start", "ts_end", "value"))
add("sum_to_deltas", f"WITH {SUMS} SELECT labels, ts_end, CAST(value AS BIGINT) AS value FROM sums", lambda s, d: P.to_deltas(T.cumulative_sums(s, d)).select(S.label_text("labels").alias("labels"), "ts_end", "value"))
_hr = M.MetricRequest("price", O0, O0 + 2520 * DAY)
_cells = lambda df, *k: df.select(*k, F.posexplode("counts").alias("place", "n")).withColumn("n", F.col("n").cast("long"))
_unpivot = " UNION ALL ".join(f"SELECT {{k}}, {i} AS place, c{i} AS n FROM h" for i in range(6))
add("histogram_merged", f"WITH {HISTOS}, h AS (SELECT labels AS tags, {', '.join(f'CAST(sum(c{i}) AS BIGINT) AS c{i}' for i in range(6))} FROM histos WHERE ts_start < {_hr.end} AND ts_end > {_hr.start} GROUP BY ALL) {_unpivot.format(k='tags')}", lambda s, d: _cells(M.histogram(T.histograms(s, d), _hr, "MERGED"), "tags"))
add("histogram_cumulative", f"WITH {HISTOS}, r AS (SELECT *, labels AS tags, row_number() OVER (PARTITION BY labels ORDER BY c0 + c1 + c2 + c3 + c4 + c5 DESC, ts_end DESC, ts_start DESC) AS k FROM histos WHERE ts_start < {_hr.end} AND ts_end > {_hr.start}), h AS (SELECT * FROM r WHERE k = 1) {_unpivot.format(k='tags, ts_start')}", lambda s, d: _cells(M.histogram(T.histograms(s, d).withColumn("temporality", F.lit("CUMULATIVE")), _hr, "CUMULATIVE"), "tags", "ts_start"))
add("histogram_to_deltas", f"WITH {HISTOS}, h AS (SELECT labels, ts_end, {', '.join(f'CASE WHEN c{i} >= coalesce(lag(c{i}) OVER w, 0) THEN c{i} - coalesce(lag(c{i}) OVER w, 0) ELSE c{i} END AS c{i}' for i in range(6))} FROM histos WINDOW w AS (PARTITION BY labels ORDER BY ts_end, ts_start)) {_unpivot.format(k='labels, ts_end')}", lambda s, d: _cells(H.to_deltas(T.histograms(s, d)).withColumn("labels", S.label_text("labels")), "labels", "ts_end"))
_hq = f"""{HISTOS}, {_grid(ORDERS)}, m AS (SELECT labels, t, {', '.join(f'sum(c{i}) AS c{i}' for i in range(6))} FROM histos JOIN grid ON ts_start <= t AND ts_end >= t - {60 * DAY} GROUP BY ALL),
q AS (SELECT *, c0 + c1 + c2 + c3 + c4 + c5 AS n, 0.7::DOUBLE * (c0 + c1 + c2 + c3 + c4 + c5) AS r FROM m)"""
_hcase = "CASE WHEN n = 0 THEN NULL WHEN c0 >= r THEN 10000.0::DOUBLE " + " ".join(f"WHEN {'+'.join(f'c{j}' for j in range(i + 1))} >= r THEN CASE WHEN c{i} = 0 THEN {i + 1}0000.0::DOUBLE ELSE {i}0000 + 10000.0::DOUBLE * (r - ({'+'.join(f'c{j}' for j in range(i))})) / c{i} END" for i in range(1, 5)) + " ELSE 50000.0::DOUBLE END"
add("promql_histogram_quantile", f"WITH {_hq} SELECT 'price' AS metric, labels, t AS ts_ms, round({_hcase}, 6) AS value FROM q", lambda s, d: shown(H.histogram_quantile(0.7, T.histograms(s, d), ORDERS, 60 * DAY)))
def layouts(s: SparkSession, d: str) -> DataFrame:
    """The histograms, and twice their counts in buckets twice as wide."""
    fine = T.histograms(s, d)
    c = F.col("counts")
    wide = F.array(*[(2 * (c[i] + c[i + 1])).cast("int") for i in (0, 2, 4)])
    return fine.unionByName(fine.withColumn("counts", wide).withColumn("bounds", F.array(F.lit(20_000.0), F.lit(40_000.0))))


_mixed = "CAST(sum(c0) AS BIGINT) AS c0, CAST(sum(c1 + 2 * (c0 + c1)) AS BIGINT) AS c1, CAST(sum(c2 + c2 + c3) AS BIGINT) AS c2, CAST(sum(c3 + c2 + c3) AS BIGINT) AS c3, CAST(sum(c4) AS BIGINT) AS c4, CAST(sum(c5 + 2 * (c4 + c5)) AS BIGINT) AS c5"
add("histogram_merged_unequal", f"WITH {HISTOS}, h AS (SELECT labels AS tags, {_mixed} FROM histos GROUP BY ALL) {_unpivot.format(k='tags')}", lambda s, d: _cells(M.histogram(layouts(s, d), _hr, "MERGED"), "tags"))
add("promql_histogram_fraction", f"WITH {HISTOS} SELECT labels, ts_start, round((c1 * 0.5::DOUBLE + c2 + c3 + c4 * 0.2::DOUBLE) / nullif(c0 + c1 + c2 + c3 + c4 + c5, 0), 6) AS value FROM histos", lambda s, d: rounded(T.histograms(s, d).select(S.label_text("labels").alias("labels"), "ts_start", H.fraction(15_000.0, 42_000.0, F.col("bounds"), F.col("counts")).alias("value"))))
add("histogram_bounded_sum", f"WITH {HISTOS} SELECT labels, ts_start, CAST(c0 + 2 * c1 + 3 * c2 + 4 * c3 + 5 * c4 AS DOUBLE) * 10000 AS value FROM histos", lambda s, d: H.counts_of(T.histograms(s, d)).select(S.label_text("labels").alias("labels"), "ts_start", F.col("bounded_sum").alias("value")))
add("histogram_counts", f"WITH {HISTOS} SELECT labels, ts_start, CAST(c0+c1+c2+c3+c4+c5 AS BIGINT) AS n FROM histos", lambda s, d: H.counts_of(T.histograms(s, d)).select(S.label_text("labels").alias("labels"), "ts_start", F.col("count").alias("n")))

# -- catalogue ---------------------------------------------------------------------------------------------------------

_CAT = f"WITH {GAUGES}, {SUMS}, {HISTOS}, cat AS (SELECT 'GAUGE' AS event_type, metric, labels, min(ts_ms) AS a, max(ts_ms) AS b FROM gauges GROUP BY ALL UNION ALL SELECT 'SUM', metric, labels, min(ts_start), max(ts_end) FROM sums GROUP BY ALL UNION ALL SELECT 'HISTO', 'price', labels, min(ts_start), max(ts_end) FROM histos GROUP BY ALL), seen AS (SELECT * FROM cat WHERE a < {T0 + 30 * DAY} AND b > 0)"
_span = (0, T0 + 30 * DAY)
add("hints_metric_names", _CAT + " SELECT DISTINCT metric FROM seen WHERE event_type = 'GAUGE' ORDER BY metric LIMIT 500", lambda s, d: M.name_hints(T.catalogue(s, d), *_span, event_type="GAUGE"))
add("hints_metric_prefix", _CAT + " SELECT DISTINCT metric FROM seen WHERE starts_with(metric, 'p') ORDER BY metric LIMIT 500", lambda s, d: M.name_hints(T.catalogue(s, d), *_span, prefix="p"))
add("hints_tags", _CAT + ", t AS (SELECT 'status' AS tag UNION ALL SELECT 'priority') SELECT tag FROM t WHERE EXISTS (SELECT 1 FROM seen WHERE metric = 'orders') ORDER BY tag LIMIT 500", lambda s, d: M.tag_hints(T.catalogue(s, d), *_span, "orders"))
add("hints_tag_values", _CAT + " SELECT DISTINCT split_part(labels, 'status=', 2) AS tag_value FROM seen WHERE metric = 'orders' ORDER BY 1 LIMIT 500", lambda s, d: M.tag_value_hints(T.catalogue(s, d), *_span, "orders", "status"))
add("metric_paths", _CAT + " SELECT metric, labels AS tags, event_type, CASE event_type WHEN 'GAUGE' THEN NULL ELSE 'DELTA' END AS temporality FROM seen ORDER BY ALL LIMIT 10000", lambda s, d: M.paths(T.catalogue(s, d), *_span).drop("labels"))
add("search_paths", _CAT + " SELECT metric, labels AS tags, event_type FROM seen WHERE regexp_full_match(metric, 'c.*') AND regexp_full_match(replace(labels, 'user=', ''), '1.')", lambda s, d: M.search(T.catalogue(s, d), *_span, name_pattern="c.*", label_patterns={"user": "1."}))
add("search_any_value", _CAT + " SELECT metric, labels AS tags, event_type FROM seen WHERE metric = 'F' OR labels LIKE '%=F' OR labels LIKE '%=F,%'", lambda s, d: M.search(T.catalogue(s, d), *_span, any_value="F"))
add("search_any_pattern", _CAT + " SELECT metric, labels AS tags, event_type FROM seen WHERE regexp_full_match(metric, '[1-3]-.*|view') OR regexp_full_match(split_part(split_part(labels, ',', 1), '=', 2), '[1-3]-.*|view')", lambda s, d: M.search(T.catalogue(s, d), *_span, any_pattern="[1-3]-.*|view"))
add("search_glob", _CAT + " SELECT DISTINCT metric || '{' || labels || '}' AS path FROM seen WHERE metric LIKE 'c%' AND labels LIKE 'user=1%'", lambda s, d: M.glob_search(T.catalogue(s, d), *_span, "c*{user=1*,us*=*}"))
add("promql_labels", _CAT + " SELECT DISTINCT unnest(CASE event_type WHEN 'GAUGE' THEN ['user', '__name__'] WHEN 'SUM' THEN ['status', 'priority', '__name__'] ELSE ['flag', '__name__'] END) AS label FROM seen", lambda s, d: M.label_names(T.catalogue(s, d), *_span))
add("promql_label_values", _CAT + " SELECT DISTINCT replace(labels, 'user=', '') AS label_value FROM seen WHERE event_type = 'GAUGE'", lambda s, d: M.label_values(T.catalogue(s, d), *_span, "user"))
add("promql_label_values_name", _CAT + " SELECT DISTINCT metric AS label_value FROM seen", lambda s, d: M.label_values(T.catalogue(s, d), *_span, "__name__"))
add("promql_metadata", f"WITH {GAUGES}, c AS (SELECT metric, labels, min(ts_ms) AS a, max(ts_ms) AS b FROM gauges GROUP BY ALL) SELECT DISTINCT metric, 'gauge' AS type FROM c WHERE a < {T0 + 9 * DAY} AND b > {T0 + 9 * DAY - 900_000} ORDER BY metric LIMIT 1000", lambda s, d: M.metadata(T.catalogue(s, d), T0 + 9 * DAY))
add("exemplars", f"WITH {GAUGES} SELECT CAST(epoch_us(ts) // 1000 * 1000000 AS BIGINT) AS ts_ns, CAST(event_id AS VARCHAR) AS span_id, value, CAST(props->>'k' AS INTEGER) AS k FROM events WHERE event_type = 'purchase' AND CAST(epoch_us(ts) // 1000 * 1000000 AS BIGINT) BETWEEN {T0 * 1_000_000} AND {(T0 + 9 * DAY) * 1_000_000}", lambda s, d: M.exemplars(T.exemplars(s, d), "purchase", T0 * 1_000_000, (T0 + 9 * DAY) * 1_000_000).select("ts_ns", "span_id", "value", F.col("attributes.k").alias("k")))

# -- spans -------------------------------------------------------------------------------------------------------------

_cols = ["trace_id", "span_id", "service", "name", "start_ns", "end_ns"]
for _name, _where, _cond in (
    ("newest", X.SpanFilter(), "true"), ("by_service_peer", X.SpanFilter({"service": "svc-3", "peer": "peer-1"}), "service = 'svc-3' AND peer = 'peer-1'"),
    ("by_trace", X.SpanFilter({"trace_id": "7"}), "trace_id = '7'"), ("by_http", X.SpanFilter({"http_method": "GET", "kind": "*"}, http_status=300), "http_method = 'GET' AND http_status = 300"),
    ("by_db_duration", X.SpanFilter({"db_system": "postgres"}, least_ns=100_000_000, most_ns=300_000_000), "db_system = 'postgres' AND end_ns - start_ns BETWEEN 100000000 AND 300000000"),
    ("by_time", X.SpanFilter(start_ns=O0 * 1_000_000, end_ns=(O0 + 90 * DAY) * 1_000_000), f"start_ns >= {O0 * 1_000_000} AND end_ns <= {(O0 + 90 * DAY) * 1_000_000}"),
    ("by_attributes", X.SpanFilter(strings={"flag": "R", "line": "2"}, numbers={"tax": 0.04}), "flag = 'R' AND line = '2' AND tax = 0.04"),
):
    add(f"span_search_{_name}", f"WITH {SPANS} SELECT {', '.join(_cols)} FROM spans WHERE {_cond} ORDER BY start_ns DESC, trace_id, span_id LIMIT 1000", lambda s, d, w=_where: X.search(T.spans(s, d), w).select(*_cols))
    add(f"span_count_{_name}", f"WITH {SPANS} SELECT count(*) AS n FROM spans WHERE {_cond}", lambda s, d, w=_where: X.count(T.spans(s, d), w))
_svc = X.SpanFilter({"service": "svc-3"})
add("span_numeric_series", f"WITH {SPANS} SELECT CAST(start_ns // 1000000 - (start_ns // 1000000) % {HOUR} AS BIGINT) AS ts_ms, round(avg(price), 6) AS value FROM spans WHERE service = 'svc-3' GROUP BY 1", lambda s, d: rounded(X.numeric_series(T.spans(s, d), _svc, "price", "HOURLY", "AVG")))
add("span_numeric_series_default", f"WITH {SPANS} SELECT CAST(start_ns // 1000000 - (start_ns // 1000000) % 1000 AS BIGINT) AS ts_ms, round(quantile_cont(CAST(http_status AS DOUBLE), 0.9), 6) AS value FROM spans WHERE service = 'svc-3' GROUP BY 1", lambda s, d: rounded(X.numeric_series(T.spans(s, d), _svc, "http_status", None, "P90")))
add("span_numeric_summary", f"WITH {SPANS} SELECT round(avg(price), 6) AS avg, round(quantile_cont(price, 0.25), 6) AS p25, round(quantile_cont(price, 0.5), 6) AS p50, round(quantile_cont(price, 0.75), 6) AS p75, round(quantile_cont(price, 0.9), 6) AS p90 FROM spans WHERE service = 'svc-3'", lambda s, d: rounded(X.numeric_summary(T.spans(s, d), _svc, "price")))
add("span_distribution", f"WITH {SPANS}, p AS (SELECT 'db_system' AS attribute, db_system AS attr_value FROM spans UNION ALL SELECT 'name', name FROM spans UNION ALL SELECT 'flag', flag FROM spans), c AS (SELECT attribute, attr_value, count(*) AS n FROM p WHERE attr_value IS NOT NULL GROUP BY ALL) SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY attribute ORDER BY n DESC, attr_value) <= 100", lambda s, d: X.distribution(T.spans(s, d), X.SpanFilter(), ["db_system", "name", "flag"]))
add("span_attribute_types", f"WITH {SPANS} SELECT a AS attribute, t AS type FROM (VALUES ('flag', 'string'), ('line', 'string'), ('price', 'number'), ('tax', 'number')) x(a, t) WHERE EXISTS (SELECT 1 FROM spans)", lambda s, d: X.attribute_types(T.spans(s, d)))
add("span_attribute_hints", "SELECT a AS attribute, t AS type, c AS custom FROM (VALUES " + ", ".join(f"('{k}', '{v}', false)" for k, v in X.DEFAULT_ATTRIBUTES.items()) + ", ('flag', 'string', true), ('line', 'string', true), ('price', 'number', true), ('tax', 'number', true)) x(a, t, c) WHERE (SELECT count(*) FROM lineitem) > 0", lambda s, d: X.attribute_hints(T.spans(s, d), 0, 1 << 62))
add("span_value_hints", f"WITH {SPANS} SELECT DISTINCT name AS attr_value FROM spans WHERE name IS NOT NULL ORDER BY 1 LIMIT 100", lambda s, d: X.value_hints(T.spans(s, d), "name", 0, 1 << 62))
add("span_filter_without_values", f"WITH {SPANS} SELECT count(*) AS n FROM spans WHERE service = 'svc-3' AND flag = 'R'", lambda s, d: X.count(T.spans(s, d), X.SpanFilter({"service": "svc-3", "peer": None, "kind": "*"}, http_status=0, strings={"flag": "R", "line": None}, numbers={"tax": None})))
add("span_page_filter", f"WITH {SPANS} SELECT trace_id, span_id, start_ns FROM spans WHERE (service = 'svc-3' AND trace_id <> '7') OR span_id = '7-1'", lambda s, d: T.spans(s, d).where(L.condition({"kind": "OR", "children": [{"kind": "AND", "children": [{"kind": "SERVICE", "value": "svc-3"}, {"kind": "NOT", "children": [{"kind": "TRACE", "value": "7"}]}]}, {"kind": "SPAN", "value": "7-1"}]})).select("trace_id", "span_id", "start_ns"))
_stats = lambda s, d, n: X.stats(T.spans(s, d), _svc, [" price ", "", "flag", "flag"], {"price": "number", "flag": "string"}, "COUNT", "HOURLY")[n]
add("span_stats_numeric", f"WITH {SPANS} SELECT CAST(start_ns // 1000000 - (start_ns // 1000000) % {HOUR} AS BIGINT) AS ts_ms, count(price) AS value FROM spans WHERE service = 'svc-3' GROUP BY 1", lambda s, d: _stats(s, d, "price"))
add("span_stats_text", f"WITH {SPANS} SELECT 'flag' AS attribute, flag AS attr_value, count(*) AS n FROM spans WHERE service = 'svc-3' GROUP BY ALL", lambda s, d: _stats(s, d, "flag"))
_TREE = f"{SPANS}, one AS (SELECT trace_id, span_id, first(parent_id) AS parent_id, min(start_ns) AS s, max(end_ns) AS e FROM spans GROUP BY ALL), tree AS (SELECT o.trace_id, o.span_id, p.span_id AS parent_id, greatest(0, o.e - o.s) AS duration_ns, o.s - min(o.s) OVER (PARTITION BY o.trace_id) AS offset_ns FROM one o LEFT JOIN one p ON p.trace_id = o.trace_id AND p.span_id = o.parent_id)"
add("flame_graph", f"WITH {_TREE} SELECT * FROM tree", lambda s, d: X.trace_tree(T.spans(s, d)).select("trace_id", "span_id", "parent_id", "duration_ns", "offset_ns"))
add("flame_graph_depth", f"WITH RECURSIVE {_TREE}, down AS (SELECT trace_id, span_id, span_id AS root_id, 0 AS depth FROM tree WHERE parent_id IS NULL UNION ALL SELECT t.trace_id, t.span_id, d.root_id, d.depth + 1 FROM tree t JOIN down d ON d.trace_id = t.trace_id AND d.span_id = t.parent_id) SELECT * FROM down", lambda s, d: X.with_depth(X.trace_tree(T.spans(s, d))).select("trace_id", "span_id", "root_id", "depth"))

# -- request, error and duration series --------------------------------------------------------------------------------

_ms = "(end_ns - start_ns) / 1e6"
_good = f"FILTER (status = 'OK' AND {_ms} > 0)"
_red = "count(*) AS total, count(*) FILTER (status = 'ERROR') AS errors, " + ", ".join(f"round(quantile_cont({_ms}, {q}) {_good}, 6) AS p{round(q * 100)}" for q in R.QUANTILES)
_all = (0, 1 << 62)
add("red_services", f"WITH {SPANS} SELECT DISTINCT service FROM spans ORDER BY 1", lambda s, d: R.services(T.red_events(s, d), *_all))
add("red_peers", f"WITH {SPANS} SELECT DISTINCT peer FROM spans WHERE service = 'svc-3' ORDER BY 1", lambda s, d: R.peers(T.red_events(s, d), *_all, "svc-3"))
add("red_operations", f"WITH {SPANS} SELECT DISTINCT name FROM spans WHERE service = 'svc-3' ORDER BY 1 LIMIT 20", lambda s, d: R.operations(T.red_events(s, d), *_all, "svc-3"))
add("red_operation_count", f"WITH {SPANS} SELECT count(DISTINCT name) AS n FROM spans WHERE service = 'svc-3'", lambda s, d: R.operation_count(T.red_events(s, d), *_all, "svc-3"))
for _res, _size in (("SECONDLY", 1000), ("MINUTELY", 60_000), ("HOURLY", HOUR)):
    _sql = f"WITH {SPANS}, e AS (SELECT *, CAST(start_ns // 1000000 - (start_ns // 1000000) % {_size} AS BIGINT) AS ts_ms FROM spans WHERE service = 'svc-3'), ops AS (SELECT DISTINCT name FROM e ORDER BY 1 LIMIT 20)"
    _sql += f" SELECT ts_ms, 'service' AS grouping, 'svc-3' AS group_name, {_red} FROM e GROUP BY ts_ms UNION ALL SELECT ts_ms, 'peer', peer, {_red} FROM e GROUP BY ts_ms, peer UNION ALL SELECT ts_ms, 'op', name, {_red} FROM e WHERE name IN (FROM ops) GROUP BY ts_ms, name"
    add(f"red_series_{_res.lower()}", _sql, lambda s, d, r=_res: rounded(R.series(T.red_events(s, d), *_all, "svc-3", r)))

# -- logs --------------------------------------------------------------------------------------------------------------

_log = ["ts_ms", "trace_id", "level", "service", "doc_id"]
for _name, _tree, _cond in (
    ("level", {"kind": "LEVEL", "value": 30}, "level = 30"), ("trace", {"kind": "TRACE", "value": "12"}, "trace_id = '12'"),
    ("body", {"kind": "BODY", "pattern": "th[ae]t? .*ing\\b"}, "regexp_matches(body, 'th[ae]t? .*ing\\b')"),
    ("and_or", {"kind": "AND", "children": [{"kind": "OR", "children": [{"kind": "LEVEL", "value": 10}, {"kind": "BODY", "pattern": "ung"}]}, {"kind": "SERVICE", "value": "svc-2"}]}, "(level = 10 OR regexp_matches(body, 'ung')) AND service = 'svc-2'"),
    ("not", {"kind": "NOT", "children": [{"kind": "LEVEL", "value": 20}]}, "level <> 20"),
):
    add(f"log_{_name}", f"WITH {LOGS} SELECT {', '.join(_log)} FROM logs WHERE {_cond}", lambda s, d, t=_tree: L.query(T.logs(s, d), 0, 1 << 62, t).select(*_log))
add("log_page", f"WITH {LOGS} SELECT {', '.join(_log)} FROM logs WHERE ts_ms BETWEEN 60000 AND 600000000 AND (ts_ms > 300000 OR (ts_ms = 300000 AND doc_id > '5-0')) ORDER BY ts_ms, doc_id LIMIT 50", lambda s, d: L.query(T.logs(s, d), 60_000, 600_000_000, None, 50, (300_000, "5-0")).select(*_log))
add("log_sources_joined", f"WITH {LOGS} SELECT {', '.join(_log)} FROM logs QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY ts_ms, level, body) = 1", lambda s, d: L.union_of_sources([T.logs(s, d), T.logs(s, d).where("level >= 20")]).select(*_log))
add("log_trigrams", f"WITH {LOGS}, l AS (SELECT doc_id, list_distinct([substr(body, i, 3) FOR i IN range(1, length(body) - 1)]) AS t FROM logs WHERE length(body) >= 3) SELECT doc_id, CAST(len(t) AS INTEGER) AS n FROM l", lambda s, d: T.logs(s, d).where(F.char_length("body") >= 3).select("doc_id", F.size(S.trigrams(F.col("body"))).alias("n")))

# -- rollups -----------------------------------------------------------------------------------------------------------

_HOURS = f"WITH {GAUGES}, h AS (SELECT metric || '{{' || labels || '}}' AS series_key, ts_ms - ts_ms % {HOUR} AS ts_ms, avg(value) AS v FROM gauges WHERE metric = 'click' AND ts_ms BETWEEN {T0} AND {T0 + 29 * DAY} GROUP BY ALL)"


def hours(s: SparkSession, d: str, metric: str = "click") -> DataFrame:
    return U.scan(g(s, d, metric), T0, T0 + 29 * DAY, HOUR, F.avg("value"))


add("rollup_scan", _HOURS + " SELECT series_key, ts_ms, round(v, 6) AS value FROM h", lambda s, d: rounded(hours(s, d)))
add("rollup_scale", _HOURS + " SELECT series_key, ts_ms, round(v * 3, 6) AS value FROM h", lambda s, d: rounded(U.scale(hours(s, d), 3.0)))
add("rollup_log", _HOURS + " SELECT series_key, ts_ms, round(ln(v), 6) AS value FROM h", lambda s, d: rounded(U.transform(hours(s, d), "LOG")))
add("rollup_sigmoid", _HOURS + " SELECT series_key, ts_ms, round(1 / (1 + exp(-v)), 6) AS value FROM h", lambda s, d: rounded(U.transform(hours(s, d), "SIGMOID")))
add("rollup_derivative", _HOURS + ", x AS (SELECT series_key, ts_ms, (v - lag(v) OVER w) / (ts_ms - lag(ts_ms) OVER w) AS v FROM h WINDOW w AS (PARTITION BY series_key ORDER BY ts_ms)) SELECT series_key, ts_ms, round(v * 1000000, 6) AS value FROM x WHERE v IS NOT NULL", lambda s, d: rounded(U.scale(U.derivative(hours(s, d)), 1_000_000.0)))
for _f in ("AVG", "SUM"):
    add(f"rollup_moving_{_f.lower()}", _HOURS + f", e AS (SELECT series_key, min(ts_ms) AS a, max(ts_ms) AS b FROM h GROUP BY ALL), st AS (SELECT series_key, unnest(generate_series(a, b, CAST({HOUR} AS BIGINT))) AS ts_ms FROM e), j AS (SELECT st.series_key, st.ts_ms, h.v FROM st LEFT JOIN h USING (series_key, ts_ms)), m AS (SELECT series_key, ts_ms, {_f}(v) OVER (PARTITION BY series_key ORDER BY ts_ms RANGE BETWEEN {12 * HOUR} PRECEDING AND CURRENT ROW) AS v FROM j) SELECT series_key, ts_ms, round(v, 6) AS value FROM m WHERE v IS NOT NULL", lambda s, d, f=_f: rounded(U.moving(hours(s, d), 12 * HOUR, HOUR, f)))
add("rollup_total", _HOURS + " SELECT series_key, round(sum(v), 6) AS value FROM h GROUP BY ALL", lambda s, d: rounded(U.total(hours(s, d))))
add("rollup_add", f"WITH {GAUGES}, h AS (SELECT metric, ts_ms - ts_ms % {HOUR} AS ts_ms, sum(value) AS v FROM gauges WHERE metric IN ('click', 'view') AND ts_ms BETWEEN {T0} AND {T0 + 29 * DAY} GROUP BY ALL) SELECT ts_ms, round(sum(v), 6) AS value FROM h GROUP BY ts_ms", lambda s, d: rounded(U.add(*[U.scan(g(s, d, m), T0, T0 + 29 * DAY, HOUR, F.sum("value")).groupBy("ts_ms").agg(F.sum("value").alias("value")) for m in ("click", "view")])))
for _r, _size in (("s", 1000), ("m", 60_000), ("h", HOUR)):
    add(f"rollup_statistics_{_r}", f"WITH {GAUGES} SELECT metric || '{{' || labels || '}}' AS series_key, '{_r}' AS resolution, ts_ms - ts_ms % {_size} AS bucket, count(*) AS n, round(sum(value), 6) AS sum, min(value) AS min, max(value) AS max, round(var_pop(value), 4) AS var FROM gauges GROUP BY ALL", lambda s, d, r=_r: rounded(U.rollup(T.gauges(s, d), r).drop("sketch").withColumn("var", F.round("var", 4))))

# -- ingestion ---------------------------------------------------------------------------------------------------------

add("ingest_dialect", f"WITH {SUMS} SELECT 'api_orders' AS metric, count(*) AS n FROM sums", lambda s, d: T.sums(s, d).select(*(lambda m, t: (m.alias("metric"), t.alias("labels")))(*S.dotted_to_underscored(F.lit("api.orders"), F.col("labels")))).groupBy("metric").agg(F.count("*").alias("n")))
add("ingest_excluded_tags", f"WITH {SUMS} SELECT 'status=' || status AS labels, count(*) AS n FROM sums GROUP BY ALL", lambda s, d: T.sums(s, d).select(S.label_text(S.without_excluded(F.col("labels"), ["none"], ["prio"])).alias("labels")).groupBy("labels").agg(F.count("*").alias("n")))
add("ingest_valid_gauges", f"WITH {GAUGES} SELECT metric, count(*) AS n FROM gauges WHERE metric <> '' AND value IS NOT NULL AND ts_ms IS NOT NULL GROUP BY metric", lambda s, d: T.valid_gauges(T.gauges(s, d)).groupBy("metric").agg(F.count("*").alias("n")))
add("series_catalogue", _CAT + " SELECT event_type, metric, labels, a AS ts_start, b AS ts_end FROM cat", lambda s, d: T.catalogue(s, d).select("event_type", "metric", S.label_text("labels").alias("labels"), "ts_start", "ts_end"))
add("otlp_gauges", f"WITH {GAUGES} SELECT metric, labels, ts_ms, round(coalesce(value, 0), 6) AS value FROM gauges", lambda s, d: shown(O.gauges(O.parse(O.gauge_requests(T.gauges(s, d)), O.METRICS))))
add("otlp_sums", f"WITH {SUMS} SELECT metric, labels, ts_start, ts_end, CAST(value AS BIGINT) AS value, 'DELTA' AS temporality FROM sums", lambda s, d: O.sums(O.parse(O.sum_requests(T.sums(s, d)), O.METRICS)).withColumn("labels", S.label_text("labels")))
add("otlp_histograms", f"WITH {HISTOS}, h AS (SELECT *, labels AS tags FROM histos) {_unpivot.format(k='tags, ts_start')}", lambda s, d: _cells(O.histograms(O.parse(O.histogram_requests(T.histograms(s, d)), O.METRICS)).withColumn("tags", S.label_text("labels")), "tags", "ts_start"))


def exports(s: SparkSession, d: str) -> DataFrame:
    """The gauges as export requests in JSON, one a sample, read back."""
    point = F.struct(F.array("ts_ms").alias("ts"), F.array(F.col("value").cast("float")).alias("value"))
    lines = T.gauges(s, d).select(F.to_json(F.struct(F.col("metric").alias("metricName"), F.col("labels").alias("tags"), F.lit("GAUGE").alias("type"), point.alias("gauge"))).alias("value"))
    return lines.select(F.from_json("value", T.EXPORT_SCHEMA).alias("r")).select("r.*")


add("export_gauges", f"WITH {GAUGES} SELECT metric, labels, ts_ms, round(CAST(CAST(value AS FLOAT) AS DOUBLE), 4) AS value FROM gauges", lambda s, d: shown(T.export_gauges(exports(s, d)), digits=4))


def payloads(s: SparkSession, d: str, kind: str) -> DataFrame:
    """The gauges as answers of other systems, one a sample."""
    named = F.map_concat("labels", F.create_map(F.lit("__name__"), F.col("metric")))
    vector = F.struct(named.alias("metric"), F.array((F.col("ts_ms") / 1000).cast("string"), F.col("value").cast("string")).alias("value"))
    points = F.struct("metric", F.transform(F.map_entries("labels"), lambda e: F.concat(e["key"], F.lit(":"), e["value"])).alias("tag_set"), F.array(F.array(F.col("ts_ms").cast("double"), "value")).alias("pointlist"))
    body = F.struct(F.struct(F.lit("vector").alias("resultType"), F.array(vector).alias("result")).alias("data")) if kind == "matrix" else F.struct(F.array(points).alias("series"))
    return T.gauges(s, d).select(F.to_json(body).alias("payload"))


for _kind, _read in (("matrix", Q.matrix_payload), ("points", Q.point_list_payload)):
    add(f"payload_{_kind}", f"WITH {GAUGES} SELECT metric, labels, ts_ms, round(value, 6) AS value FROM gauges WHERE value IS NOT NULL", lambda s, d, k=_kind, r=_read: shown(r(payloads(s, d, k)).where("value is not null")))
add("log_from_otlp", f"WITH {LOGS} SELECT ts_ms, lower(hex(trace_id)) AS trace_id, level, service, sha256(concat_ws('|', CAST(ts_ms * 1000000 AS VARCHAR), lower(hex(trace_id)), CAST(level AS VARCHAR), body)) AS doc_id FROM logs WHERE body IS NOT NULL", lambda s, d: L.from_otlp(T.logs(s, d).select((F.col("ts_ms") * 1_000_000).alias("time_unix_nano"), F.encode("trace_id", "UTF-8").alias("trace_id"), F.col("level").alias("severity_number"), "body", "service")).select(*_log))

# -- sketches ----------------------------------------------------------------------------------------------------------


def sketch_checked(s: SparkSession, d: str) -> DataFrame:
    """By metric and day: the number of samples, and whether the sketch's 90th percentile has its rank to within 2 percent."""
    samples = T.gauges(s, d).withColumn("labels", F.create_map().cast("map<string,string>"))
    days = U.merge(U.rollup(samples, "h"), DAY, "d")
    found = U.read(days, "P90").select("series_key", "ts_ms", F.col("value").alias("q"))
    rows = P.keyed(samples).select("series_key", (F.col("ts_ms") - F.col("ts_ms") % DAY).alias("ts_ms"), "value").join(found, ["series_key", "ts_ms"])
    n = F.count("value")
    by = rows.groupBy("series_key", "ts_ms").agg(n.alias("n"), (F.count_if(F.col("value") < F.col("q")) / n).alias("low"), (F.count_if(F.col("value") <= F.col("q")) / n).alias("high"))
    slack = 0.02 + 1 / F.col("n")
    return by.select("series_key", "ts_ms", "n", ((F.col("low") <= 0.9 + slack) & (F.col("high") >= 0.9 - slack)).alias("in_bounds"))


add("rollup_sketch_rank", f"WITH {GAUGES} SELECT metric || '{{}}' AS series_key, ts_ms - ts_ms % {DAY} AS ts_ms, count(value) AS n, true AS in_bounds FROM gauges GROUP BY ALL", sketch_checked)
for _agg, _expr in (("AVG", "avg(value)"), ("MAX", "max(value)"), ("COUNT", "CAST(count(value) AS DOUBLE)")):
    add(f"rollup_read_{_agg.lower()}", f"WITH {GAUGES} SELECT metric || '{{' || labels || '}}' AS series_key, 'h' AS resolution, ts_ms - ts_ms % {HOUR} AS ts_ms, round({_expr}, 6) AS value FROM gauges GROUP BY ALL", lambda s, d, a=_agg: rounded(U.read(U.rollup(T.gauges(s, d), "h"), a)))
