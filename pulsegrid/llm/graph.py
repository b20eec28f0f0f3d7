"""Connected components of an edge table, in rounds of joins; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C


def _mark(edges: DataFrame) -> tuple[int, int]:
    n, s = edges.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))).first()
    return n, s or 0


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node on an edge (u, v): the label is the smallest node of its component.

    Alternates two steps until nothing changes: each node links its larger neighbours to its smallest one, then its smaller
    neighbours and itself to the smallest. A node with very many neighbours only meets them in a sum and in a join.
    """
    edges = C.cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = _mark(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = C.cut(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        after = _mark(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
