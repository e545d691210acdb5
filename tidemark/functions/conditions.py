"""Declarative conditions compiled to boolean columns: comparators on facts, nested with all_of, any_of and not."""

from __future__ import annotations

import re
from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.text import mentions

EQUAL = 1e-9
_NUMBER = r"-?\d+(?:\.\d+)?"
_COMPARED = re.compile(rf"^(>=|<=|==|!=|>|<)\s*({_NUMBER})$")
_RANGE = re.compile(rf"^({_NUMBER})\.\.({_NUMBER})$")
_NAMED = {"gt": ">", "gte": ">=", "lt": "<", "lte": "<=", "eq": "==", "ne": "!="}


def _compare(x: Column, sign: str, value: float) -> Column:
    match sign:
        case ">":
            return x > value
        case ">=":
            return x >= value
        case "<":
            return x < value
        case "<=":
            return x <= value
        case "==":
            return F.abs(x - value) < EQUAL
    return F.abs(x - value) >= EQUAL


def comparator(x: Column, rule: float | str | Mapping[str, float]) -> Column:
    """A number (equal within 1e-9), ``">0.7"``, ``"a..b"`` (both ends included), or ``{"gte": a, "lt": b}``.

    Raises ``ValueError`` for an empty rule, an unknown one, or a range whose ends are reversed.
    """
    if isinstance(rule, bool):
        raise ValueError(f"not a comparator: {rule!r}")
    if isinstance(rule, (int, float)):
        return F.abs(x - float(rule)) < EQUAL
    if isinstance(rule, str):
        if m := _COMPARED.match(rule.strip()):
            return _compare(x, m[1], float(m[2]))
        if m := _RANGE.match(rule.strip()):
            if float(m[1]) > float(m[2]):
                raise ValueError(f"reversed range: {rule!r}")
            return x.between(float(m[1]), float(m[2]))
        raise ValueError(f"not a comparator: {rule!r}")
    if not rule or set(rule) - set(_NAMED):
        raise ValueError(f"not a comparator: {rule!r}")
    out = F.lit(True)
    for name, value in rule.items():
        out = out & _compare(x, _NAMED[name], float(value))
    return out


def condition(tree: Mapping[str, Any], facts: Mapping[str, Column]) -> Column:
    """A tree of facts, all of which must hold. A null fact makes its test false, also under ``not``'s own tests.

    Numbers and comparator strings test numeric facts, booleans test boolean ones, and a list or another string tests
    membership; ``mentions`` tests text. Raises ``KeyError`` for a fact that isn't there.
    """
    out = F.lit(True)
    for name, rule in tree.items():
        if name == "all_of":
            test = F.lit(True)
            for t in rule:
                test = test & condition(t, facts)
        elif name == "any_of":
            test = F.lit(False)
            for t in rule:
                test = test | condition(t, facts)
        elif name == "not":
            test = ~condition(rule, facts)
        elif name == "mentions":
            test = mentions(facts["text"], *([rule] if isinstance(rule, str) else rule))
        elif isinstance(rule, bool):
            test = facts[name] == rule
        elif isinstance(rule, list):
            test = facts[name].isin(rule)
        elif isinstance(rule, str) and not _COMPARED.match(rule.strip()) and not _RANGE.match(rule.strip()):
            test = facts[name] == rule
        else:
            test = comparator(facts[name], rule)
        out = out & F.coalesce(test, F.lit(False))
    return out
