"""Rules over nested rows: one declared table of rules, one violation per path.

A rule names a path inside a row, what it asks, and a check of the value there. `[]` in a path stands
for the elements of a list and `{}` for the entries of a map (their parts are `key` and `value`). The
rules of a table are walked together, so a list is visited once however many rules look into it. A
violation tells the concrete place, such as `segments[3].start` or `edits{12.5}.value.text`.

What lies below a missing value is not looked at: only the rule on the value itself speaks, or none if
it is optional."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VIOLATION = "array<struct<path:string,rule:string>>"


@dataclass(frozen=True)
class Rule:
    path: str
    name: str
    ok: Callable[[Column], Column]
    optional: bool = False


@dataclass
class _Node:
    rules: list[Rule] = field(default_factory=list)
    children: dict[str, _Node] = field(default_factory=dict)


def _steps(path: str) -> list[str]:
    return re.findall(r"\[\]|\{\}|[^.\[\]{}]+", path)


def _tree(rules: Iterable[Rule]) -> _Node:
    root = _Node()
    for rule in rules:
        node = root
        for step in _steps(rule.path):
            node = node.children.setdefault(step, _Node())
        node.rules.append(rule)
    return root


def _walk(value: Column, place: Column, node: _Node) -> Column:
    none = F.array().cast(VIOLATION)
    found = []
    for rule in node.rules:
        bad = ~F.coalesce(rule.ok(value), F.lit(False))
        if rule.optional:
            bad = value.isNotNull() & bad
        hit = F.struct(place.alias("path"), F.lit(rule.name).alias("rule"))
        found.append(F.when(bad, F.array(hit)).otherwise(none))
    below = [_below(value, place, step, child) for step, child in node.children.items()]
    if below:
        found.append(F.when(value.isNotNull(), F.concat(*below)).otherwise(none))
    return F.concat(*found)


def _below(value: Column, place: Column, step: str, child: _Node) -> Column:
    if step == "[]":
        return F.flatten(F.transform(value, lambda x, i: _walk(x, F.concat(place, F.lit("["), i, F.lit("]")), child)))
    if step == "{}":
        return F.flatten(F.transform(F.map_entries(value), lambda e: _walk(e, F.concat(place, F.lit("{"), e["key"], F.lit("}")), child)))
    return _walk(value[step], F.concat(place, F.lit(f".{step}")), child)


def violations(row: Column, rules: Iterable[Rule]) -> Column:
    """All violations of the rules in a struct, as an array of path and rule."""
    walked = _walk(row, F.lit(""), _tree(rules))
    return F.transform(walked, lambda v: F.struct(F.ltrim(v["path"], F.lit(".")).alias("path"), v["rule"].alias("rule")))


def violation_rows(df: DataFrame, rules: Iterable[Rule], *keys: str) -> DataFrame:
    """keys, path, rule: one row per violation of a table's rows."""
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    return df.select(*keys, F.explode(violations(row, rules)).alias("v")).select(*keys, "v.path", "v.rule")
