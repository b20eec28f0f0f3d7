"""Log queries: a filter tree as one Column, time range, de-duplication by document id, order, limit and paging."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.series import checked_regex
from ..functions.timegrid import ns_to_ms


def condition(node: dict) -> Column:
    """A Column from a tree of {"kind": ..., ...}: LEVEL (value), TRACE (value), SPAN (value), SERVICE (value), BODY or REGEX
    (pattern, found anywhere), AND, OR and NOT (children)."""
    kind = node["kind"].upper()
    if kind in ("AND", "OR"):
        parts = [condition(c) for c in node["children"]]
        if not parts:
            raise ValueError(f"{kind} needs children")
        return reduce((lambda a, b: a & b) if kind == "AND" else (lambda a, b: a | b), parts)
    if kind == "NOT":
        return ~condition(node["children"][0])
    if kind in ("BODY", "REGEX"):
        return F.coalesce(F.col("body").rlike(checked_regex(node["pattern"])), F.lit(False))
    column = {"LEVEL": "level", "TRACE": "trace_id", "SPAN": "span_id", "SERVICE": "service"}.get(kind)
    if column is None:
        raise ValueError(f"unknown filter {kind}")
    return F.coalesce(F.col(column) == node["value"], F.lit(False))


def first_of_each(records: DataFrame, key: str = "doc_id") -> DataFrame:
    """Of records with one id, that of the earliest time, level and body; records without an id all stay."""
    w = Window.partitionBy(key).orderBy("ts_ms", "level", "body")
    known = records.where(F.col(key).isNotNull()).withColumn("place", F.row_number().over(w)).where("place = 1").drop("place")
    return known.unionByName(records.where(F.col(key).isNull()))


def query(records: DataFrame, start: int, end: int, tree: dict | None = None, limit: int | None = None, after: tuple[int, str] | None = None) -> DataFrame:
    """Records in [start, end] that the tree keeps, in order of (ts_ms, doc_id); after: the last such pair of the page before."""
    rows = records.where(F.col("ts_ms").between(start, end))
    if tree is not None:
        rows = rows.where(condition(tree))
    if after is not None:
        rows = rows.where((F.col("ts_ms") > after[0]) | ((F.col("ts_ms") == after[0]) & (F.col("doc_id") > after[1])))
    rows = rows.orderBy("ts_ms", "doc_id")
    return rows if limit is None else rows.limit(limit)


def union_of_sources(sources: list[DataFrame]) -> DataFrame:
    """Records of several sources, each document once."""
    return first_of_each(reduce(lambda a, b: a.unionByName(b), sources))


def from_otlp(records: DataFrame) -> DataFrame:
    """Log rows from (time_unix_nano, trace_id binary, severity_number, body, service): milliseconds, lower-case hexadecimal
    ids, the severity number as the level, and a document id that depends on the content alone."""
    trace = F.lower(F.hex("trace_id"))
    ms = ns_to_ms(F.col("time_unix_nano"))
    doc = F.sha2(F.concat_ws("|", F.col("time_unix_nano").cast("string"), trace, F.col("severity_number").cast("string"), "body"), 256)
    return records.where("body is not null").select(ms.alias("ts_ms"), trace.alias("trace_id"), F.col("severity_number").cast("int").alias("level"), "body", F.coalesce("service", F.lit("unknown")).alias("service"), doc.alias("doc_id"))
