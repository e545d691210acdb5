"""The choice for an arc against a loop that ranks all candidates again after every pick."""

from __future__ import annotations

import random

import pytest

from tidemark.operators.selection import Segment, Taste, arc_positions, preferred_durations, select_for_arc

ARC = [Segment("a", 0.25, ("hook",), ("hook", "setup")), Segment("b", 0.5, ("peak",)), Segment("c", 0.25, (), ("close",))]
CANDIDATE = "plan string, id long, ms long, value double, required boolean, role string, segment int, target long"


def by_hand(rows, relations, arc, taste):
    taken, out = [], []

    def worth(r, roles):
        best = {"continuation_of": 0.0, "duplicate_of": 0.0}
        for s, t, kind, strength in relations:
            for a, b in ((s, t), (t, s)):
                if a == r["id"] and b in taken and a != b:
                    best[kind] = max(best[kind], strength)
        bonus = 0.15 if r["role"] in roles else 0.0
        # Terms are added in one order, so that equal worths are equal.
        return r["value"] + bonus + (taste.continuity_bonus * best["continuation_of"] - taste.duplicate_penalty * best["duplicate_of"]), (r["value"] + bonus) / max(1, r["ms"] / 1000)

    def pick(pool, roles, room):
        some = [(*worth(r, roles), -r["id"], r) for r in pool if r["id"] not in taken and r["ms"] <= room]
        return max(some, key=lambda x: x[:3]) if some else None

    def take(found, why):
        taken.append(found[-1]["id"])
        out.append((found[-1]["id"], len(out) + 1, why, round(found[0], 9)))

    limit = taste.max_operations or 10**9
    used, target = 0, rows[0]["target"]
    for k, part in enumerate(arc):
        pool, spent, count = [r for r in rows if r["segment"] == k], 0, 0
        cap = max(1, int(limit * part.budget + 0.5)) if taste.max_operations else 10**9
        for r in pool:
            if r["required"]:
                take((worth(r, part.prefer_roles)[0], r), "required")
                spent, count = spent + r["ms"], count + 1
        if part.require_roles and not any(r["id"] in taken and r["role"] in part.require_roles for r in pool):
            found = pick([r for r in pool if r["role"] in part.require_roles], part.prefer_roles, target * part.budget - spent)
            if found:
                take(found, "opener")
                spent, count = spent + found[-1]["ms"], count + 1
        while len(taken) < limit and count < cap and (found := pick([r for r in pool if not r["required"]], part.prefer_roles, target * part.budget - spent)):
            take(found, "ranked")
            spent, count = spent + found[-1]["ms"], count + 1
        used += spent
    while used < target and len(taken) < limit and (found := pick(rows, (), target - used)):
        take(found, "filled")
        used += found[-1]["ms"]
    return out


@pytest.mark.parametrize("limit", [None, 8])
def test_choice(spark, limit):
    rng = random.Random(4)
    rows, relations, i = [], [], 0
    for plan in range(25):
        ids = []
        for _ in range(rng.choice([1, 3, 20, 45])):
            ids.append(i)
            rows.append((f"p{plan}", i, rng.randint(500, 6000), rng.choice([0.2, 0.4, 0.5, rng.random()]), rng.random() < 0.06, rng.choice(["hook", "setup", "peak", "close", None]), rng.randrange(3), 40000))
            i += 1
        for _ in range(3 * len(ids)):
            relations.append((rng.choice(ids), rng.choice(ids), rng.choice(["continuation_of", "duplicate_of"]), rng.choice([0.25, 0.5, rng.random()])))
    relations.append((0, 10**6, "duplicate_of", 1.0))  # to what is no candidate
    taste = Taste(0.1, 0.3, limit)
    got: dict[str, list] = {}
    frame = spark.createDataFrame(rows, CANDIDATE).repartition(7)
    for r in select_for_arc(frame, spark.createDataFrame(relations, "source long, target long, kind string, strength double"), "plan", ARC, taste).orderBy("plan", "rank").collect():
        got.setdefault(r["plan"], []).append((r["id"], r["rank"], r["why"], round(r["worth"], 9)))
    names = [c.split()[0] for c in CANDIDATE.split(", ")]
    want = {}
    for plan in {r[0] for r in rows}:
        mine = [dict(zip(names, r)) for r in rows if r[0] == plan]
        if out := by_hand(mine, [r for r in relations if r[0] in {m["id"] for m in mine}], ARC, taste):
            want[plan] = out
    assert got == want and {w for v in want.values() for _, _, w, _ in v} >= {"required", "opener", "ranked"} | (set() if limit else {"filled"})


def test_empty(spark):
    none = spark.createDataFrame([], "source long, target long, kind string, strength double")
    assert select_for_arc(spark.createDataFrame([], CANDIDATE), none, "plan", ARC, Taste()).count() == 0


def test_arc_positions_and_lengths(spark):
    rows = [("p", i, i, 1000, 100, 500, float(v)) for i, v in enumerate([5, 1, 1, 9])] + [("q", 9, 0, 0, 100, 501, 1.0)]
    frame = spark.createDataFrame(rows, "plan string, id long, at long, ms long, min_ms long, max_ms long, value double")
    got = {r["id"]: (r["segment"], r["preferred_ms"]) for r in arc_positions(preferred_durations(frame, ["plan"]), ["plan"], ["at"], "ms", ARC).collect()}
    assert got == {0: (0, 367), 1: (1, 100), 2: (1, 233), 3: (2, 500), 9: (0, 301)}
