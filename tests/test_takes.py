"""Subdivision of long takes against a recursion, and evidence and signals in single cases."""

from __future__ import annotations

import math
import random

from tidemark.operators.segments import kept_apart
from tidemark.operators.takes import LEVELS, boundary_signals, subdivided, take_evidence

EVIDENCE = "asset long, level int, at long, s long, e long"


def divide(atom, evidence, least, most, level=0):
    start, end, score, opened = atom
    if end - start <= most:
        return [atom]
    for n in range(level, len(LEVELS)):
        points = []
        for at in sorted({a for k, a, s, e in evidence if k == n and s >= start and e <= end}):
            if start + least <= at <= end - least and at - (points[-1] if points else start) >= least:
                points.append(at)
        if points:
            edges = [start, *points, end]
            parts = [(a, b, score if i == 0 else None, opened if i == 0 else LEVELS[n]) for i, (a, b) in enumerate(zip(edges, edges[1:]))]
            return [x for p in parts for x in divide(p, evidence, least, most, n + 1)]
    n = math.ceil((end - start) / most)
    edges = [math.floor(start + k * (end - start) / n + 0.5) for k in range(n + 1)]
    return [(a, b, score if i == 0 else None, opened if i == 0 else "fixed") for i, (a, b) in enumerate(zip(edges, edges[1:]))]


def test_subdivision(spark):
    rng = random.Random(6)
    atoms, evidence, want = [], [], set()
    for asset in range(60):
        at, own = rng.randint(0, 500), []
        mine = []
        for _ in range(rng.randint(0, 40)):
            level, s = rng.randrange(3), rng.randint(0, 60000)
            e = s if level == 0 else s + rng.randint(0, 4000)
            mine.append((level, math.floor((s + e) / 2 + 0.5), s, e))
        evidence += [(asset, *m) for m in mine]
        for _ in range(rng.randint(1, 4)):
            own.append((at, at + rng.choice([900, 5000, 9000, 26000, 45001]), rng.random(), None))
            at = own[-1][1] + rng.choice([0, 0, 700])
        atoms += [(asset, *a[:3]) for a in own]
        want |= {(asset, *p, p[0] + (p[1] - p[0]) // 3) for a in own for p in divide(a, mine, 2000, 9000)}
    frame = spark.createDataFrame(atoms, "asset long, start long, end long, change_score double")
    got = {tuple(r) for r in subdivided(frame, spark.createDataFrame(evidence, EVIDENCE), ["asset"], 2000, 9000, 5000).collect()}
    assert got == want and {p[4] for p in got} == {None, *LEVELS, "fixed"}
    assert subdivided(frame.limit(0), spark.createDataFrame([], EVIDENCE), ["asset"], 2000, 9000, 5000).count() == 0


def test_points_kept_apart(spark):
    frame = spark.createDataFrame([(a, t) for a in (1, 2) for t in (0, 3, 5, 9, 10, 10, 16)], "asset long, at long").repartition(3)
    got = sorted(tuple(r) for r in kept_apart(frame, ["asset"], "at", 5).collect())
    assert got == [(a, t) for a in (1, 2) for t in (0, 5, 10, 16)]


def test_evidence(spark):
    f = spark.createDataFrame
    span = "a long, start long, end long"
    stills = f([(1, 0, 3000), (1, 4000, 9000), (2, 0, 500)], span)
    motion = f([(1, 12, 5.0), (1, 39, 3.0), (1, 36, 3.9)], "a long, hop long, value double")
    reads = f([(1, 5000, "x"), (1, 5000, "y"), (1, 10000, "y"), (1, 10000, "x"), (1, 12000, "z"), (1, 20000, "q"), (2, 0, "m")], "a long, start long, key string")
    said = f([(1, 0, 5000, 1), (1, 100, 900, 2), (1, 6499, 7000, 3), (1, 8501, 9000, 4)], span + ", id long")
    silent = f([(1, 0, 1499), (1, 0, 1500)], span)
    got = sorted(tuple(r) for r in take_evidence(stills, motion, reads, said, silent, ["a"], 250, 5000).collect())
    # The still of 1 that ends at 9000 isn't followed by enough motion; asset 2 has no motion at all.
    assert got == [(1, 0, 3000, 3000, 3000), (1, 0, 11000, 11000, 11000), (1, 0, 16000, 16000, 16000), (1, 1, 7751, 7000, 8501), (1, 2, 750, 0, 1500), (2, 0, 500, 500, 500)]


def test_signals(spark):
    f = spark.createDataFrame
    atoms = f([(1, 0, 5000, None), (1, 5000, 9000, 0.4), (1, 9000, 12000, None)], "a long, start long, end long, change_score double")
    said = f([(1, 0, 1000, 1, "p", ["red", "car"]), (1, 6000, 8000, 2, "q", ["red"]), (1, 8500, 9200, 3, "q", ["sun"])], "a long, start long, end long, id long, speaker string, features array<string>")
    silent = f([(1, 4000, 5500)], "a long, start long, end long")
    marks = f([(1, 5600, "split"), (1, 8900, "card_end"), (1, 9150, "card_start")], "a long, at long, kind string")
    got = {r["at"]: r for r in boundary_signals(atoms, said, silent, marks, ["a"], 4000).collect()}
    assert got.keys() == {5000, 9000}
    assert tuple(got[5000])[2:] == ("split", False, 1.0, 0.5, 1.0, 0.4)
    assert tuple(got[9000])[2:] == ("merge", True, 0.0, 0.0, None, None)
