"""Span search, counts, statistics, attribute hints and trace trees."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.storage import cut
from ..functions.timegrid import RESOLUTIONS, ns_to_ms
from .metrics import aggregation

SPANS_MOST, HINTS_MOST = 1000, 100
#: Columns that stand for attributes of their own, with their type.
DEFAULT_ATTRIBUTES = {"service": "string", "peer": "string", "name": "string", "kind": "string", "status": "string", "http_method": "string", "http_status": "number", "db_system": "string"}


@dataclass(frozen=True)
class SpanFilter:
    """Conditions on spans, all of which hold. In a search * stands for any value; an HTTP status under 100 is no condition."""

    equal: dict[str, str | int | None] = field(default_factory=dict)
    http_status: int | None = None
    start_ns: int | None = None
    end_ns: int | None = None
    least_ns: int | None = None
    most_ns: int | None = None
    strings: dict[str, str | None] = field(default_factory=dict)
    numbers: dict[str, float | None] = field(default_factory=dict)

    def column(self, wildcards: bool = True) -> Column:
        skip = lambda v: v is None or (wildcards and v == "*")
        parts = [F.col(c) == v for c, v in self.equal.items() if not skip(v)]
        if self.http_status is not None and (self.http_status >= 100 or not wildcards):
            parts.append(F.col("http_status") == self.http_status)
        duration = F.col("end_ns") - F.col("start_ns")
        for value, test in ((self.start_ns, lambda v: F.col("start_ns") >= v), (self.end_ns, lambda v: F.col("end_ns") <= v), (self.least_ns, lambda v: duration >= v), (self.most_ns, lambda v: duration <= v)):
            if value is not None:
                parts.append(test(value))
        parts += [F.coalesce(F.col("attrs_str")[k] == v, F.lit(False)) for k, v in self.strings.items() if not skip(v)]
        parts += [F.coalesce(F.col("attrs_num")[k] == v, F.lit(False)) for k, v in self.numbers.items() if v is not None]
        return reduce(lambda a, b: a & b, parts, F.lit(True))


def search(spans: DataFrame, where: SpanFilter, limit: int = SPANS_MOST) -> DataFrame:
    """The newest matching spans."""
    return spans.where(where.column()).orderBy(F.desc("start_ns"), "trace_id", "span_id").limit(limit)


def count(spans: DataFrame, where: SpanFilter, wildcards: bool = True) -> DataFrame:
    return spans.where(where.column(wildcards)).agg(F.count("*").alias("n"))


def attribute(name: str, kind: str) -> Column:
    """The value of a column attribute, or else of the attribute map of that type."""
    if name in DEFAULT_ATTRIBUTES:
        return F.col(name)
    return F.col("attrs_num" if kind == "number" else "attrs_str")[name]


def numeric_series(spans: DataFrame, where: SpanFilter, name: str, resolution: str | None, agg: str) -> DataFrame:
    """An aggregate of a numeric attribute per bucket (of a second if no resolution is given), where it is present."""
    size = RESOLUTIONS[resolution or "SECONDLY"]
    rows = spans.where(where.column(False)).withColumn("v", attribute(name, "number").cast("double")).where("v is not null")
    ms = ns_to_ms(F.col("start_ns"))
    return rows.groupBy((ms - ms % size).alias("ts_ms")).agg(aggregation(agg, F.col("v")).alias("value"))


def numeric_summary(spans: DataFrame, where: SpanFilter, name: str) -> DataFrame:
    """avg, p25, p50, p75 and p90 of a numeric attribute."""
    v = attribute(name, "number").cast("double")
    quarters = [F.percentile("v", F.lit(q)).alias(f"p{round(q * 100)}") for q in (0.25, 0.5, 0.75, 0.9)]
    return spans.where(where.column(False)).select(v.alias("v")).where("v is not null").agg(F.avg("v").alias("avg"), *quarters)


def distribution(spans: DataFrame, where: SpanFilter, names: list[str], limit: int = HINTS_MOST) -> DataFrame:
    """Counts of the values of each attribute, the most frequent ones first: one pass, however many attributes."""
    pairs = F.array(*[F.struct(F.lit(n).alias("attribute"), attribute(n, "string").cast("string").alias("attr_value")) for n in names])
    rows = spans.where(where.column(False)).select(F.explode(pairs).alias("p")).select("p.*").where("attr_value is not null")
    by = rows.groupBy("attribute", "attr_value").agg(F.count("*").alias("n"))
    w = Window.partitionBy("attribute").orderBy(F.desc("n"), "attr_value")
    return by.withColumn("place", F.row_number().over(w)).where(F.col("place") <= limit).drop("place")


def attribute_catalogue(spans: DataFrame) -> DataFrame:
    """One row per attribute and type of every span, as ingestion records it."""
    one = lambda c, kind: spans.select("start_ns", "end_ns", F.explode(F.map_keys(c)).alias("attribute"), F.lit(kind).alias("type"))
    return one("attrs_str", "string").unionByName(one("attrs_num", "number"))


def attribute_hints(spans: DataFrame, start_ns: int, end_ns: int, limit: int = HINTS_MOST) -> DataFrame:
    """Attributes of their own column, and the distinct custom ones seen in the range."""
    fixed = spans.sparkSession.createDataFrame(sorted(DEFAULT_ATTRIBUTES.items()), "attribute string, type string").withColumn("custom", F.lit(False))
    custom = attribute_catalogue(spans).where((F.col("start_ns") >= start_ns) & (F.col("end_ns") <= end_ns)).select("attribute", "type").distinct().orderBy("attribute", "type").limit(limit)
    return fixed.unionByName(custom.withColumn("custom", F.lit(True)))


def attribute_types(spans: DataFrame) -> DataFrame:
    """number, string, or mixed for attributes that come as both."""
    by = attribute_catalogue(spans).groupBy("attribute").agg(F.collect_set("type").alias("types"))
    return by.select("attribute", F.when(F.size("types") > 1, "mixed").otherwise(F.col("types")[0]).alias("type"))


def value_hints(spans: DataFrame, name: str, start_ns: int, end_ns: int, limit: int = HINTS_MOST) -> DataFrame:
    """Distinct values of a text attribute."""
    rows = spans.where((F.col("start_ns") >= start_ns) & (F.col("end_ns") <= end_ns)).select(attribute(name, "string").alias("attr_value"))
    return rows.where("attr_value is not null").distinct().orderBy("attr_value").limit(limit)


def stats(spans: DataFrame, where: SpanFilter, names: list[str], types: dict[str, str], agg: str | None = None, resolution: str | None = None) -> dict[str, DataFrame]:
    """What a statistics request returns, by attribute: blanks and repeats are dropped, numeric ones give series, the others
    the distribution. A numeric aggregation of a text attribute is an error, a count is not."""
    out: dict[str, DataFrame] = {}
    clean = list(dict.fromkeys(n.strip() for n in names if n and n.strip()))
    for n in clean:
        kind = DEFAULT_ATTRIBUTES.get(n, types.get(n, "string"))
        if kind == "number":
            out[n] = numeric_series(spans, where, n, resolution, agg or "COUNT")
        elif agg not in (None, "COUNT"):
            raise ValueError(f"{n} is not numeric")
        else:
            out[n] = distribution(spans, where, [n])
    return out


# -- traces ------------------------------------------------------------------------------------------------------------


def trace_tree(spans: DataFrame) -> DataFrame:
    """Flame graph rows: trace_id, span_id, parent_id, start_ns, end_ns, offset_ns, duration_ns, is_root.

    A span without a parent in its trace is a root and has a NULL parent. Offsets count from the trace's first start.
    """
    one = spans.groupBy("trace_id", "span_id").agg(F.first("parent_id").alias("parent_id"), F.min("start_ns").alias("start_ns"), F.max("end_ns").alias("end_ns"))
    # both joins are left ones to unique keys, so they are left out where their columns are not used; the parents lie by their
    # key already, from the grouping
    parents = one.select("trace_id", F.col("span_id").alias("parent_id"), F.lit(1).alias("hit"))
    rows = one.join(parents, ["trace_id", "parent_id"], "left").withColumn("parent_id", F.when(F.col("hit") == 1, F.col("parent_id"))).drop("hit")
    first = spans.groupBy("trace_id").agg(F.min("start_ns").alias("first_ns"))
    rows = rows.join(first, "trace_id", "left").withColumn("offset_ns", F.col("start_ns") - F.col("first_ns")).drop("first_ns").withColumn("duration_ns", F.greatest(F.lit(0), F.col("end_ns") - F.col("start_ns")))
    return rows.withColumn("is_root", F.col("parent_id").isNull())


def with_depth(tree: DataFrame, rounds: int = 20) -> DataFrame:
    """trace_tree with root_id and depth, by pointer doubling: each round a span learns its ancestor twice as far up, so a
    tree of 2^n levels takes n rounds, and the loop ends when all have reached a root. Spans in a cycle have no root. Jobs run
    while the frame is made."""
    up = cut(tree.select("trace_id", "span_id", F.coalesce("parent_id", "span_id").alias("above"), F.when(F.col("is_root"), 0).otherwise(1).alias("depth"), F.col("is_root").alias("done")))
    for _ in range(rounds):
        if up.where("not done").isEmpty():
            break
        other = up.select("trace_id", F.col("span_id").alias("above"), F.col("above").alias("next"), F.col("depth").alias("more"), F.col("done").alias("there"))
        moved = up.where("not done").join(other, ["trace_id", "above"]).select("trace_id", "span_id", F.col("next").alias("above"), (F.col("depth") + F.col("more")).alias("depth"), F.col("there").alias("done"))
        up = cut(up.where("done").unionByName(moved))
    found = up.select("trace_id", "span_id", F.when(F.col("done"), F.col("above")).alias("root_id"), F.when(F.col("done"), F.col("depth")).alias("depth"))
    return tree.join(found, ["trace_id", "span_id"])
