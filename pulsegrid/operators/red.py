"""Request, error and duration series of services, from one pass over the events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.timegrid import RESOLUTIONS, ns_to_ms

OPERATIONS_MOST = 20
QUANTILES = (0.5, 0.75, 0.9, 0.99)


def _measures() -> list[Column]:
    ms = (F.col("ts_end_ns") - F.col("ts_start_ns")) / 1e6
    good = F.when((F.col("status") == "OK") & (ms > 0), ms)
    return [F.count("*").alias("total"), F.count_if(F.col("status") == "ERROR").alias("errors"), *[F.percentile(good, F.lit(q)).alias(f"p{round(q * 100)}") for q in QUANTILES]]


def within(events: DataFrame, start_ns: int, end_ns: int, service: str | None = None) -> DataFrame:
    """Events that lie wholly in the range."""
    rows = events.where((F.col("ts_start_ns") >= start_ns) & (F.col("ts_end_ns") <= end_ns))
    return rows if service is None else rows.where(F.col("service") == service)


def services(events: DataFrame, start_ns: int, end_ns: int) -> DataFrame:
    return within(events, start_ns, end_ns).where("service <> ''").select("service").distinct().orderBy("service")


def peers(events: DataFrame, start_ns: int, end_ns: int, service: str) -> DataFrame:
    return within(events, start_ns, end_ns, service).where("peer <> ''").select("peer").distinct().orderBy("peer")


def operations(events: DataFrame, start_ns: int, end_ns: int, service: str, limit: int = OPERATIONS_MOST) -> DataFrame:
    return within(events, start_ns, end_ns, service).where("name <> ''").select("name").distinct().orderBy("name").limit(limit)


def operation_count(events: DataFrame, start_ns: int, end_ns: int, service: str) -> DataFrame:
    return within(events, start_ns, end_ns, service).agg(F.count_distinct("name").alias("n"))


def series(events: DataFrame, start_ns: int, end_ns: int, service: str, resolution: str, operations_most: int = OPERATIONS_MOST) -> DataFrame:
    """RED series of a service, of each of its peers and of its first operations by name: grouping service, peer or op, with
    the name in group_name. One scan with grouping sets; a bucket without good spans has NULL quantiles."""
    size = RESOLUTIONS[resolution]
    ms = ns_to_ms(F.col("ts_start_ns"))
    rows = within(events, start_ns, end_ns, service).withColumn("ts_ms", ms - ms % size)
    first_ops = operations(events, start_ns, end_ns, service, operations_most).select(F.col("name").alias("op"))
    # the list of operations is bounded by operations_most
    rows = rows.join(F.broadcast(first_ops), rows["name"] == F.col("op"), "left").withColumn("peer", F.when(F.col("peer") != "", F.col("peer")))
    by = rows.groupingSets([["ts_ms"], ["ts_ms", "peer"], ["ts_ms", "op"]], "ts_ms", "peer", "op").agg(F.grouping("peer").alias("no_peer"), F.grouping("op").alias("no_op"), *_measures())
    kind = F.when((F.col("no_peer") == 1) & (F.col("no_op") == 1), "service").when(F.col("no_op") == 1, "peer").otherwise("op")
    name = F.when(kind == "service", F.lit(service)).when(kind == "peer", F.col("peer")).otherwise(F.col("op"))
    out = by.withColumn("grouping", kind).withColumn("group_name", name).where("group_name is not null")
    return out.drop("no_peer", "no_op", "peer", "op")
