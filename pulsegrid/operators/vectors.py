"""Operators between instant vectors and aggregations over them. Everything is per step."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.series import drop_labels, keep_labels, label_text, series_key

NAN = float("nan")


def arithmetic(op: str, a: Column, b: Column) -> Column:
    """+ - * / % ^; a divisor of zero gives NaN, never infinity."""
    if op in "+-*":
        return {"+": a + b, "-": a - b, "*": a * b}[op]
    if op == "^":
        return F.pow(a, b)
    safe = F.when(b == 0, F.lit(1.0)).otherwise(b)
    return F.when(b == 0, F.lit(NAN)).otherwise(a / safe if op == "/" else a % safe)


def comparison(op: str, a: Column, b: Column) -> Column:
    """A comparison in which NaN equals nothing and is in no order; two NaN are equal, as the sample values are."""
    plain = ~F.isnan(a) & ~F.isnan(b)
    both = F.isnan(a) & F.isnan(b)
    return {"==": (plain & (a == b)) | both, "!=": ~((plain & (a == b)) | both), ">": plain & (a > b), "<": plain & (a < b), ">=": plain & (a >= b), "<=": plain & (a <= b)}[op]


COMPARISONS = ("==", "!=", ">", "<", ">=", "<=")


def scalar_op(op: str, a: float, b: float, as_bool: bool = False) -> float:
    """Two scalars; without bool a comparison gives the left one or NaN."""
    if op in COMPARISONS:
        hit = {"==": a == b, "!=": a != b, ">": a > b, "<": a < b, ">=": a >= b, "<=": a <= b}[op]
        return float(hit) if as_bool else (a if hit else NAN)
    if op in "+-*^":
        return {"+": a + b, "-": a - b, "*": a * b}[op] if op != "^" else a**b
    if b == 0:
        return NAN
    return a / b if op == "/" else a - b * int(a / b)


def with_scalar(vector: DataFrame, op: str, value: float | Column, scalar_left: bool = False, as_bool: bool = False) -> DataFrame:
    """A vector and a scalar. A comparison keeps the samples of the vector that pass, or with bool gives 1 and 0."""
    v, s = F.col("value"), value if isinstance(value, Column) else F.lit(float(value))
    a, b = (s, v) if scalar_left else (v, s)
    if op not in COMPARISONS:
        return vector.withColumn("value", arithmetic(op, a, b))
    hit = comparison(op, a, b)
    return vector.withColumn("value", F.when(hit, 1.0).otherwise(0.0)) if as_bool else vector.where(hit)


def with_scalars(vector: DataFrame, op: str, scalars: DataFrame, scalar_left: bool = False, as_bool: bool = False) -> DataFrame:
    """A vector and a scalar that has a value at each step (ts_ms, value), such as time() or scalar(v)."""
    by_step = scalars.select("ts_ms", F.col("value").alias("scalar_value"))
    return with_scalar(vector.join(by_step, "ts_ms"), op, F.col("scalar_value"), scalar_left, as_bool).drop("scalar_value")


def negated(vector: DataFrame) -> DataFrame:
    return vector.withColumn("value", -F.col("value"))


@dataclass(frozen=True)
class Matching:
    """on or ignoring, and which side may hold many series to one of the other."""

    on: list[str] | None = None
    ignoring: list[str] = field(default_factory=list)
    group: str | None = None  # left or right
    include: list[str] = field(default_factory=list)

    def key(self, labels: Column) -> Column:
        """The text that series are matched by; NULL, and so never matched, where a label of on is missing."""
        if self.on is None:
            return label_text(drop_labels(labels, [*self.ignoring, "__name__"]))
        there = F.size(F.map_keys(keep_labels(labels, self.on))) == len(set(self.on))
        return F.when(there, label_text(keep_labels(labels, self.on)))


def _single(vector: DataFrame, how: Matching) -> DataFrame:
    """A side that may have one series a key and step; a second one fails the query when it runs."""
    by = vector.withColumn("key", how.key(F.col("labels"))).where("key is not null").groupBy("key", "ts_ms")
    one = by.agg(F.count("*").alias("n"), F.first(F.struct("metric", "labels", "series_key", "value")).alias("r"))
    return one.select("key", "ts_ms", F.when(F.col("n") == 1, F.col("r")).otherwise(F.raise_error(F.lit("many-to-many matching: several series share a match key"))).alias("r"))


def binary(left: DataFrame, right: DataFrame, op: str, how: Matching = Matching(), as_bool: bool = False) -> DataFrame:
    """Arithmetic or comparison of the series that match, step by step."""
    if how.group not in (None, "left", "right"):
        raise ValueError("group_left and group_right exclude each other")
    if how.group == "right":
        many, one = right, _single(left, how)
    elif how.group == "left":
        many, one = left, _single(right, how)
    else:
        many, one = _single(left, how).select(F.col("r.metric").alias("metric"), F.col("r.labels").alias("labels"), F.col("r.series_key").alias("series_key"), "ts_ms", F.col("r.value").alias("value")), _single(right, how)
    rows = many.withColumn("key", how.key(F.col("labels"))).join(one, ["key", "ts_ms"])
    a, b = F.col("value"), F.col("r.value")
    a, b = (b, a) if how.group == "right" else (a, b)
    if op in COMPARISONS:
        hit = comparison(op, a, b)
        if as_bool:
            rows = rows.withColumn("value", F.when(hit, 1.0).otherwise(0.0))
        else:
            rows = rows.where(hit).withColumn("value", F.when(F.lit(how.group == "right"), F.col("r.value")).otherwise(F.col("value")))
    else:
        rows = rows.withColumn("value", arithmetic(op, a, b))
    if how.include:
        rows = rows.withColumn("labels", F.map_concat(drop_labels(F.col("labels"), how.include), keep_labels(F.col("r.labels"), how.include)))
        rows = rows.withColumn("series_key", series_key("metric", "labels"))
    return rows.select("metric", "labels", "series_key", "ts_ms", "value")


def set_op(left: DataFrame, right: DataFrame, op: str, how: Matching = Matching()) -> DataFrame:
    """and, unless and or, by match key and step."""
    mine = left.withColumn("key", how.key(F.col("labels")))
    others = right.withColumn("key", how.key(F.col("labels"))).select("key", "ts_ms").distinct()
    if op == "and":
        return mine.join(others, ["key", "ts_ms"], "left_semi").drop("key")
    if op == "unless":
        return mine.join(others, ["key", "ts_ms"], "left_anti").drop("key")
    if op != "or":
        raise ValueError(f"unknown set operator {op}")
    fields = ["metric", "labels", "series_key", "ts_ms", "value"]
    taken = mine.select("key", "ts_ms").distinct()
    rest = right.withColumn("key", how.key(F.col("labels"))).join(taken, ["key", "ts_ms"], "left_anti")
    return left.select(*fields).unionByName(rest.select(*fields))


# -- aggregation -------------------------------------------------------------------------------------------------------


def _group(vector: DataFrame, by: list[str] | None, without: list[str] | None) -> DataFrame:
    labels = F.col("labels")
    kept = drop_labels(labels, [*without, "__name__"]) if without is not None else keep_labels(labels, by or [])
    return vector.withColumn("group", kept).withColumn("group_key", label_text("group"))


_AGGREGATES = {
    "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "count": lambda c: F.count(c).cast("double"),
    "group": lambda c: F.max(F.lit(1.0)), "stddev": F.stddev_pop, "stdvar": F.var_pop,
}


def aggregate(vector: DataFrame, op: str, by: list[str] | None = None, without: list[str] | None = None, parameter: float | str | None = None) -> DataFrame:
    """sum avg min max count group stddev stdvar quantile count_values topk bottomk, per group and step.

    Without by or without all series form one group. The result is named after the operator; topk and bottomk keep the labels.
    """
    rows = _group(vector, by, without)
    keys = ["group_key", "ts_ms"]
    if op in ("topk", "bottomk"):
        w = Window.partitionBy(*keys).orderBy(F.desc("value") if op == "topk" else F.asc("value"), "series_key")
        top = rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= int(parameter))
        return top.select(F.lit(op).alias("metric"), "labels", series_key(F.lit(op), F.col("labels")).alias("series_key"), "ts_ms", "value")
    if op == "count_values":
        text = F.col("value").cast("string")
        out = rows.withColumn("text", text).groupBy(*keys, "text").agg(F.first("group").alias("group"), F.count("*").cast("double").alias("value"))
        out = out.withColumn("group", F.map_concat(F.col("group"), F.create_map(F.lit(str(parameter)), F.col("text"))))
    else:
        value = F.percentile("value", F.lit(float(parameter))) if op == "quantile" else _AGGREGATES[op](F.col("value"))
        out = rows.groupBy(*keys).agg(F.first("group").alias("group"), value.alias("value"))
    return out.select(F.lit(op).alias("metric"), F.col("group").alias("labels"), series_key(F.lit(op), F.col("group")).alias("series_key"), "ts_ms", "value")
