"""Shaping of requests before they run: variables, placeholders, time limits, payloads of other systems."""

from __future__ import annotations

import re
from dataclasses import replace
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def substitute(text: str, variables: dict[str, str]) -> str:
    """$__{name} becomes the variable's value, or nothing if it is unknown; an unclosed one is an error."""
    out = re.sub(r"\$__\{([^}]*)\}", lambda m: variables.get(m[1], ""), text)
    if "$__{" in out:
        raise ValueError("a variable is not closed")
    return out


def hydrate(text: str, values: dict[str, object]) -> str:
    """{{name}} becomes the value; one without a value is an error."""
    for k, v in values.items():
        text = text.replace("{{" + k + "}}", str(v))
    if left := re.search(r"\{\{([^{}]*)\}\}", text):
        raise ValueError(f"no value for {left[1]}")
    return text


def within(request, start: int, end: int):
    """A request with its time range replaced."""
    return replace(request, start=start, end=end)


def unescape_label(name: str) -> str:
    """Label names in a path: percent escapes, and U__ names with _xx_ for a code point and __ for an underscore."""
    name = unquote(name)
    if not name.startswith("U__"):
        return name
    return re.sub(r"__|_([0-9A-Fa-f]{1,6})_", lambda m: "_" if m[1] is None else chr(int(m[1], 16)), name[3:])


def hex_id(raw: Column) -> Column:
    return F.lower(F.hex(raw))


def matrix_payload(rows: DataFrame, column: str = "payload") -> DataFrame:
    """Samples from JSON answers of type matrix or vector: (metric, labels, ts_ms, value)."""
    schema = "struct<data: struct<resultType: string, result: array<struct<metric: map<string,string>, values: array<array<string>>, value: array<string>>>>>"
    parsed = rows.select(F.from_json(column, schema).alias("p")).select(F.explode("p.data.result").alias("r"))
    points = F.coalesce(F.col("r.values"), F.array(F.col("r.value")))
    flat = parsed.select("r.metric", F.explode(points).alias("v"))
    named = F.map_filter("metric", lambda k, _: k != "__name__")
    return flat.select(F.col("metric")["__name__"].alias("metric"), named.alias("labels"), F.round(F.col("v")[0].cast("double") * 1000).cast("long").alias("ts_ms"), F.expr("try_cast(v[1] as double)").alias("value"))


def point_list_payload(rows: DataFrame, column: str = "payload") -> DataFrame:
    """Samples from JSON answers with series of [ms, value] points and tags written as name:value."""
    schema = "struct<series: array<struct<metric: string, tag_set: array<string>, pointlist: array<array<double>>>>>"
    flat = rows.select(F.explode(F.from_json(column, schema)["series"]).alias("s")).select("s.metric", "s.tag_set", F.explode("s.pointlist").alias("p"))
    pairs = F.transform(F.coalesce("tag_set", F.array().cast("array<string>")), lambda t: F.struct(F.substring_index(t, ":", 1).alias("k"), F.regexp_replace(t, "^[^:]*:?", "").alias("v")))
    labels = F.map_from_arrays(F.transform(pairs, lambda x: x["k"]), F.transform(pairs, lambda x: x["v"]))
    return flat.select("metric", labels.alias("labels"), F.col("p")[0].cast("long").alias("ts_ms"), F.col("p")[1].alias("value")).where("value is not null")


def any_value_text(value: Column) -> Column:
    """Text of an attribute value (a struct of string, bool, int, double, array and kvlist, one of them set)."""
    return F.coalesce(value["string"], value["bool"].cast("string"), value["int"].cast("string"), value["double"].cast("string"), F.when(value["array"].isNotNull(), "unrecognized_arr"), F.when(value["kvlist"].isNotNull(), "unrecognized_kvlist"))


def first_present(attributes: Column, names: list[str], kind: str = "string") -> Column:
    """The value of the first attribute that is present at all, read as string or int; a value that is no int gives NULL."""
    value = F.coalesce(*[F.when(F.array_contains(F.map_keys(attributes), n), F.struct(attributes[n].alias("v"))) for n in names])["v"]
    return value if kind == "string" else F.round(value.try_cast("double")).try_cast("int")
