"""Scores and directives of a rule set: weighted base scores, then rules in priority order folded into one expression
per directive, so that any number of rules is a single projection."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.conditions import condition
from tidemark.functions.numbers import rounded

BIAS = 0.15


@dataclass(frozen=True)
class Rule:
    """What follows where a condition holds: ``prefer``/``avoid`` (True or a number), ``multiply``, ``drop``,
    ``require``, ``max_ms``, ``role``."""

    id: str
    when: Mapping[str, Any]
    then: Mapping[str, Any]
    priority: int = 50


@dataclass(frozen=True)
class RuleSet:
    weights: Mapping[str, float]
    rules: Sequence[Rule] = field(default_factory=tuple)

    def extended(self, weights: Mapping[str, float], rules: Sequence[Rule]) -> RuleSet:
        """A rule of the same id takes the place of an inherited one; others follow."""
        new = {r.id: r for r in rules}
        kept = [new.pop(r.id, r) for r in self.rules]
        return RuleSet({**self.weights, **weights}, [*kept, *new.values()])

    def ordered(self) -> list[Rule]:
        return [r for _, r in sorted(enumerate(self.rules), key=lambda x: (x[1].priority, x[0]))]


def base_score(weights: Mapping[str, float], facts: Mapping[str, Column]) -> Column:
    """Weighted sum of facts (0.5 where one is unknown) over the positive weights; 0.5 without positive weights."""
    positive = sum(w for w in weights.values() if w > 0)
    if positive <= 0:
        return F.lit(0.5)
    total = F.lit(0.0)
    for name, w in weights.items():
        total = total + w * F.coalesce(facts[name].cast("double"), F.lit(0.5))
    return rounded(total / positive)


def directives(rule_set: RuleSet, facts: Mapping[str, Column]) -> dict[str, Column]:
    """Columns ``score``, ``base_score``, ``dropped``, ``required``, ``max_ms``, ``role`` and ``reasons`` (ids of the rules
    that applied, in order). Biases add, multipliers multiply, drops and requirements stick; of durations and roles the
    last rule's holds."""
    bias, factor = F.lit(0.0), F.lit(1.0)
    dropped, required = F.lit(False), F.lit(False)
    max_ms: Column = F.lit(None).cast("long")
    role: Column = F.lit(None).cast("string")
    reasons = []
    for r in rule_set.ordered():
        holds = condition(r.when, facts)
        for name, sign in (("prefer", 1), ("avoid", -1)):
            if (x := r.then.get(name)) is not None and x is not False:
                bias = bias + F.when(holds, sign * (BIAS if x is True else float(x))).otherwise(0.0)
        if "multiply" in r.then:
            factor = factor * F.when(holds, float(r.then["multiply"])).otherwise(1.0)
        if r.then.get("drop"):
            dropped = dropped | holds
        if r.then.get("require"):
            required = required | holds
        if "max_ms" in r.then:
            max_ms = F.when(holds, F.lit(int(r.then["max_ms"]))).otherwise(max_ms)
        if "role" in r.then:
            role = F.when(holds, F.lit(r.then["role"])).otherwise(role)
        reasons.append(F.when(holds, F.lit(r.id)))
    base = base_score(rule_set.weights, facts)
    return {
        "base_score": base,
        "score": rounded(base * factor + bias),
        "dropped": dropped,
        "required": required,
        "max_ms": max_ms,
        "role": role,
        "reasons": F.array_compact(F.array(*reasons)) if reasons else F.array().cast("array<string>"),
    }
