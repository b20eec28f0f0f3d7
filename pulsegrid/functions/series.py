"""Series identity: a metric with an unordered set of labels, and the predicates on both.

Maps are not comparable keys, so joins and groupings go by `series_key`, the labels sorted and written as k=v.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _escaped(text: Column, *marks: str) -> Column:
    """A backslash before backslashes and the marks, so that no two label sets are written alike."""
    for mark in ("\\", *marks):
        text = F.replace(text, F.lit(mark), F.lit("\\" + mark))
    return text


def label_text(labels: Column | str) -> Column:
    """Labels as k=v,k=v in order of name; an empty map gives an empty text. Commas, backslashes, and = in names are escaped."""
    entries = F.array_sort(F.map_entries(labels))
    return F.array_join(F.transform(entries, lambda e: F.concat(_escaped(e["key"], "=", ","), F.lit("="), _escaped(e["value"], ","))), ",")


def series_key(metric: Column | str, labels: Column | str) -> Column:
    """name{k=v,k=v}: the canonical path of a series. A brace in a name is escaped."""
    name = F.col(metric) if isinstance(metric, str) else metric
    return F.concat(_escaped(F.coalesce(name, F.lit("")), "{"), F.lit("{"), label_text(labels), F.lit("}"))


def tenant_path(tenant: str, path: Column) -> Column:
    return F.concat(F.lit(f"{tenant}:"), path)


def keep_labels(labels: Column, names: list[str]) -> Column:
    return F.map_filter(labels, lambda k, _: k.isin(*names)) if names else F.map_filter(labels, lambda k, _: F.lit(False))


def drop_labels(labels: Column, names: list[str]) -> Column:
    return F.map_filter(labels, lambda k, _: ~k.isin(*names)) if names else labels


def label_join(labels: Column, target: str, separator: str, sources: list[str]) -> Column:
    """Labels with target set to the sources' values joined; a missing one counts as empty."""
    value = F.concat_ws(separator, *[F.coalesce(labels[s], F.lit("")) for s in sources])
    return F.map_concat(drop_labels(labels, [target]), F.create_map(F.lit(target), value))


def label_replace(labels: Column, target: str, replacement: str, source: str, pattern: str) -> Column:
    """Labels with target set from source where the pattern matches it whole."""
    value = F.coalesce(labels[source], F.lit(""))
    new = F.map_concat(drop_labels(labels, [target]), F.create_map(F.lit(target), F.regexp_replace(value, f"^(?:{checked_regex(pattern)})\\z", replacement)))
    return F.when(value.rlike(f"^(?:{pattern})\\z"), new).otherwise(labels)


# -- matchers ----------------------------------------------------------------------------------------------------------


def checked_regex(pattern: str) -> str:
    """The pattern, if it keeps to what a linear-time engine accepts: no look-around, no back-references."""
    if re.search(r"\(\?(?:[=!]|<[=!]|>)|\\[1-9]|[*+?}]\+", pattern):
        raise ValueError(f"unsupported regular expression: {pattern}")
    re.compile(pattern)
    return pattern


def matches(metric: Column, labels: Column, name: str, op: str, value: str) -> Column:
    """One label matcher: = != =~ !~, regular expressions match whole values. An absent label matches none of them."""
    subject = metric if name == "__name__" else labels[name]
    if op == "=":
        ok = subject == value
    elif op == "!=":
        ok = subject != value
    elif op in ("=~", "!~"):
        ok = subject.rlike(f"^(?:{checked_regex(value)})\\z")
        ok = ~ok if op == "!~" else ok
    else:
        raise ValueError(f"unknown matcher {op}")
    return F.coalesce(ok, F.lit(False))


def all_match(metric: Column, labels: Column, matchers: list[tuple[str, str, str]]) -> Column:
    return reduce(lambda a, m: a & matches(metric, labels, *m), matchers, F.lit(True))


def has_tags(tags: Column, wanted: dict[str, str], exact: bool = False) -> Column:
    """Tags hold the wanted pairs; exact: and no others."""
    ok = reduce(lambda a, kv: a & F.coalesce(tags[kv[0]] == kv[1], F.lit(False)), wanted.items(), F.lit(True))
    return ok & (F.size(F.map_keys(tags)) == len(wanted)) if exact else ok


def path_filter(metric: Column, tags: Column, name: str | None = None, name_pattern: str | None = None, labels: dict[str, str] | None = None, label_patterns: dict[str, str] | None = None) -> Column:
    """All given conditions on a metric path; patterns match whole values."""
    matchers = [("__name__", "=", name)] if name else []
    matchers += [("__name__", "=~", name_pattern)] if name_pattern else []
    matchers += [(k, "=", v) for k, v in (labels or {}).items()] + [(k, "=~", v) for k, v in (label_patterns or {}).items()]
    return all_match(metric, tags, matchers)


def any_value_filter(metric: Column, tags: Column, value: str | None = None, pattern: str | None = None) -> Column:
    """The metric or any tag value equals value, or else matches the pattern whole."""
    if value and value.strip():
        return (metric == value) | F.exists(F.map_values(tags), lambda x: x == value)
    if pattern and pattern.strip():
        full = f"^(?:{checked_regex(pattern)})\\z"
        return metric.rlike(full) | F.exists(F.map_values(tags), lambda x: x.rlike(full))
    raise ValueError("value or pattern is needed")


def glob(text: Column, pattern: str) -> Column:
    """* stands for any run of characters."""
    return text.rlike("^" + ".*".join(re.escape(p) for p in pattern.split("*")) + r"\z")


def _any_key(tags: Column, pattern: str) -> Column:
    return F.exists(F.map_keys(tags), lambda x: glob(x, pattern))


def wildcard_search(metric: Column, tags: Column, query: str) -> Column:
    """A search such as name*{key=value*,pre*=*,key=*}: a glob on the name, and for each pair an exact value, a prefix of the
    value, or a prefix of the key with any value. A pair may not have a wildcard in key and value both unless the value is *."""
    m = re.fullmatch(r"([^{}]*)(?:\{([^{}]*)\})?", query.strip())
    if not m:
        raise ValueError(f"not a search: {query}")
    ok = glob(metric, m[1]) if m[1] else F.lit(True)
    for pair in filter(None, (p.strip() for p in (m[2] or "").split(","))):
        k, eq, v = pair.partition("=")
        if not eq or ("*" in k and v != "*"):
            raise ValueError(f"not a label filter: {pair}")
        if "*" in k:
            ok &= _any_key(tags, k)
        elif v == "*":
            ok &= tags[k].isNotNull()
        else:
            ok &= F.coalesce(glob(tags[k], v), F.lit(False))
    return ok


def trigrams(text: Column) -> Column:
    """The distinct trigrams of a text, in order; shorter texts have none."""
    n = F.char_length(text)
    grams = F.transform(F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1))), lambda i: F.substring(text, i, F.lit(3)))
    return F.when(n >= 3, F.array_sort(F.array_distinct(grams))).otherwise(F.array().cast("array<string>"))


def dotted_to_underscored(metric: Column, tags: Column) -> tuple[Column, Column]:
    """Names and tag keys as a metrics dialect without dots has them."""
    return F.translate(metric, ".", "_"), F.transform_keys(tags, lambda k, _: F.translate(k, ".", "_"))


def without_excluded(tags: Column, names: list[str] = (), prefixes: list[str] = ()) -> Column:
    """Tags whose key is none of the names and begins with none of the prefixes."""
    return F.map_filter(tags, lambda k, _: ~reduce(lambda a, p: a | k.startswith(p), prefixes, k.isin(*names) if names else F.lit(False)))
