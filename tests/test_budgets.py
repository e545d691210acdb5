"""Escalation, token rates, instants and pieces against plain loops."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators.budgets import Policy, bounded_pieces, decisions, escalated, estimated_tokens, instants_to_look_at, token_rates


@pytest.mark.parametrize("policy", [Policy(), Policy(3, None, 0.5, 0), Policy(None, 1.0, None, 0), Policy(6, 0.9, 0.6, 2), Policy(0)])
def test_escalation(spark, policy):
    rng = random.Random(3)
    rows = [(g, i, rng.choice([0.2, 0.5, 0.6, rng.random()]), rng.choice([0.0, 0.125, 0.25, 0.5])) for g in range(12) for i in range(rng.randint(1, 30))]
    frame = spark.createDataFrame(rows, "g long, id long, value double, cost double").repartition(5)
    found = escalated(frame, "g", policy)
    got = {(r["g"], r["id"]): r["limited_by"] for r in found.collect()}
    ends = {r["g"]: (r["taken"], r["cost"], r["limited_by"]) for r in decisions(found, "g").collect()}
    for g in range(12):
        n, spent, last = 0, 0.0, "nothing"
        for _, i, value, cost in sorted((r for r in rows if r[0] == g), key=lambda r: (-r[2], r[1])):
            why = None
            if n >= policy.min_items and policy.min_value is not None and value < policy.min_value:
                why = "value"
            elif policy.max_items is not None and n >= policy.max_items:
                why = "count"
            elif policy.max_cost is not None and spent + cost > policy.max_cost:
                why = "cost"
            else:
                n, spent = n + 1, spent + cost
            last = why or last
            assert got[g, i] == why
        assert ends[g] == (n, spent, last)
    assert escalated(frame.limit(0), "g", policy).count() == 0


def test_token_rates(spark):
    calls = spark.createDataFrame([("a", 100, 30, 5), ("a", 300, 70, None), ("a", 50, None, 9), ("a", 0, 10, 1), ("b", 10, None, 1)], "m string, chars long, input long, output long")
    rates = token_rates(calls, ["m"])
    asked = spark.createDataFrame([("a", 10), ("a", 0), ("b", 10)], "m string, chars long").join(rates, "m", "left")
    got = sorted((r[0], r[1], r[2]) for r in asked.select("m", "chars", estimated_tokens(F.col("chars"), F.col("per_char"), F.col("per_call"))).collect())
    assert got == [("a", 0, 3), ("a", 10, 5), ("b", 10, 0)]


def test_instants(spark):
    rng = random.Random(4)
    spans, instants = [], []
    for a in range(10):
        for _ in range(rng.randint(0, 5)):
            s = rng.randint(0, 900)
            spans.append((a, s, s + rng.randint(1, 300)))
        instants += [(a, a * 100 + i, rng.randint(0, 1200)) for i in range(40)]
    want = set()
    for a in range(10):
        mine, seen = sorted(s[1:] for s in spans if s[0] == a), set()
        for _, i, t in sorted((x for x in instants if x[0] == a), key=lambda x: (x[2], x[1])):
            span = next((s for s in mine if s[0] <= t < s[1]), None)
            if span is None or span not in seen:
                want.add((a, i))
            seen.add(span)
    f = spark.createDataFrame
    got = {(r["a"], r["id"]) for r in instants_to_look_at(f(instants, "a long, id long, at long"), f(spans, "a long, start long, end long"), ["a"], 100).collect()}
    assert got == want and len(want) < len(instants)


def test_pieces(spark):
    rng = random.Random(5)
    stretches, levels, want = [], [], set()
    for a in range(12):
        level = {h: rng.choice([-60.0, -40.0, rng.random()]) for h in range(400) if a % 4 or h < 100}
        levels += [(a, h, v) for h, v in level.items()]
        at = rng.randint(0, 500)
        for _ in range(3):
            end = at + rng.choice([300, 1500, 5150, 12000])
            stretches.append((a, at, end))
            p = at
            while end - p > 1500:
                best, quietest = p + 1500, math.inf
                t = math.ceil((p + 1500 * 0.9) / 100) * 100
                while t + 100 <= p + 1500:
                    if level.get(t // 100, math.inf) < quietest:
                        best, quietest = t, level[t // 100]
                    t += 100
                want.add((a, at, p, best))
                p = best
            want.add((a, at, p, end))
            at = end + rng.randint(1, 300)
    f = spark.createDataFrame
    got = {tuple(r) for r in bounded_pieces(f(stretches, "a long, start long, end long"), f(levels, "a long, hop long, level double"), ["a"], 1500).collect()}
    assert got == want
