"""Placement, cards, distributions and incremental runs: edges and plain loops."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import judge
from tidemark.operators.cards import steady_shots, title_cards
from tidemark.operators.placement import placed, starts_apart
from tidemark.streaming.incremental import last_generation, refreshed

FILE = "project long, id long, name string, kind string, ms long, utc long, local long, offset_min int"


def test_placement(spark):
    rows = [
        (1, 1, "B.MOV", "video", 500, 1000, None, None), (1, 2, "A.MOV", "video", 700, 2000, None, None), (1, 3, "A.JPG", "image", 0, None, None, None), (1, 4, "B2.JPG", "image", 0, None, None, None),
        (2, 5, "x", "video", 10, None, 50, 60), (2, 6, "y", "video", 10, 5, 40, 60), (2, 7, "z", "video", 10, None, None, None),
        (3, 8, "x", "video", 10, None, 50, 60), (3, 9, "y", "video", 10, 5, 40, 120), (4, 10, "b", "video", 10, None, None, None), (4, 11, "a", "video", 10, None, None, None),
    ]
    got = {r["id"]: (r["place"], r["at"], r["ordered_by"], r["clock"], r["beside"], r["side"]) for r in placed(spark.createDataFrame(rows, FILE), ["project"]).collect()}
    # A.JPG's name sorts before every dated file's: it stands before the first of them by name.
    assert got[1] == (0, 0, "creation_time", "utc", None, None) and got[4] == (1, 1500, "file_name", None, 1, 1)
    assert got[3] == (2, 5500, "file_name", None, 2, -1) and got[2] == (3, 9500, "creation_time", "utc", None, None)
    assert [got[i][:4] for i in (6, 5)] == [(0, 0, "creation_time", "local"), (2, 2020, "creation_time", "local")] and got[7] == (1, 1010, "file_name", None, 6, 1)
    # Two zones: the instants order it, though fewer files have one.
    assert got[9] == (1, 1010, "creation_time", "utc", None, None)
    assert got[8][2:] == ("file_name", None, 9, -1) and got[11][0] == 0 and got[10] == (1, 1010, "file_name", None, None, None)
    assert placed(spark.createDataFrame([], FILE), ["project"]).count() == 0
    one = spark.createDataFrame([(1, 5, 2, 9), (None, 5, 2, 9), (None, 5, None, 9)], "a long, b long, c long, d long")
    assert [r[0] for r in one.select(starts_apart(F.col("a"), F.col("b"), F.col("c"), F.col("d"))).collect()] == [4, 7, None]


def folded(shots):
    out, held = [], None
    for s, e, _ in sorted(shots, key=lambda x: (x[0], x[2])):
        if e - s < 1000:
            if out:
                out[-1] = (out[-1][0], max(out[-1][1], e))
            else:
                held = (held[0] if held else s, e)
        else:
            out.append((min(s, held[0]) if held else s, e))
            held = None
    return out + ([held] if held else [])


def test_steady_shots(spark):
    rng = random.Random(1)
    rows, want = [], set()
    for a in range(50):
        own, at = [], rng.randint(0, 9)
        for i in range(rng.randint(1, 12)):
            n = rng.choice([300, 999, 1000, 4000]) if a % 5 else 400
            own.append((at, at + n, i))
            at += rng.choice([n, n, n // 2, n + 500])
        rows += [(a, *s) for s in own]
        want |= {(a, *s) for s in folded(own)}
    frame = spark.createDataFrame(rows, "a long, start long, end long, id long")
    assert {tuple(r) for r in steady_shots(frame, ["a"]).collect()} == want
    assert steady_shots(frame.limit(0), ["a"]).count() == 0


def test_title_cards(spark):
    f = spark.createDataFrame
    shots = f([(1, 0, 2000), (1, 2000, 4000), (1, 4000, 11000), (1, 11000, 12000), (2, 0, 2000)], "a long, start long, end long")
    # The first sample of a shot compares it with the shot before.
    moves = {0: 9.0, 8: 9.0, 10: 0.6, 44: 5.0}
    pictures = f([(1, h, moves.get(h, 0.1), 10.0 if h < 40 else 90.0) for h in range(48)], "a long, hop long, motion double, luma double")
    reads = f([(1, 11500, 0.4), (1, 500, 0.9), (2, 100, 0.5)], "a long, start long, middle double")
    black = f([(1, 12000, 12300), (2, 5000, 6000)], "a long, start long, end long")
    assert sorted(tuple(r) for r in title_cards(shots, pictures, reads, black, ["a"], 250, 5000).collect()) == [(1, 0, 2000), (1, 11000, 12300), (2, 5000, 6000)]


def entropy(mean, n):
    if mean <= 0 or mean >= n - 1:
        return [float(i == (0 if mean <= 0 else n - 1)) for i in range(n)]
    low, high = -60.0, 60.0
    for _ in range(60):
        rate = (low + high) / 2
        w = [math.exp(rate * i - max(0, rate * (n - 1))) for i in range(n)]
        p = [x / sum(w) for x in w]
        now = sum(i * x for i, x in enumerate(p))
        if abs(now - mean) < 1e-9:
            break
        low, high = (rate, high) if now < mean else (low, rate)
    return p


@pytest.mark.parametrize("n", [1, 2, 5, 7])
def test_distributions(spark, n):
    values = [-0.5, 0.0, 1e-6, 0.1, 0.25, 0.5, 0.503, 0.75, 0.99, 1.0, 3.0]
    frame = spark.createDataFrame([(v,) for v in values], "v double")
    for r in frame.select("v", judge.unit_distribution(F.col("v"), n).alias("p"), judge.entropy_distribution(F.col("v") * (n - 1), n).alias("e")).collect():
        mean = min(1, max(0, r["v"])) * (n - 1)
        assert abs(sum(r["p"]) - 1) < 1e-3
        if n > 1:
            assert abs(sum(i * p for i, p in enumerate(r["p"])) - mean) < n * n * 1e-4
            assert all(abs(a - b) < 1e-9 for a, b in zip(r["e"], entropy(r["v"] * (n - 1), n)))
            two = [max(0.0, 1 - abs(mean - i)) for i in range(n)]
            assert all(abs(p - (0.6 * a + 0.4 * b)) < 6e-5 for p, a, b in zip(r["p"], entropy(mean, n), two))


def test_only_changes_are_computed_again(spark, tmp_path):
    seen = []

    def compute(rows):
        seen.append(sorted(r["k"] for r in rows.collect()))
        return rows.select("k", F.upper("text").alias("out"), (F.col("text") == "bad").alias("failed"))

    def run(rows, version="1"):
        frame = spark.createDataFrame(rows, "k long, text string")
        return {r["k"]: (r["out"], r["reused"]) for r in refreshed(frame, str(tmp_path), ["k"], ["text"], version, compute).collect()}

    assert run([(1, "a"), (2, "bad"), (3, None)]) == {1: ("A", False), 2: ("BAD", False), 3: (None, False)}
    # Failed rows, changed rows (null and empty differ) and new ones; 4 goes again later.
    assert run([(1, "a"), (2, "bad"), (3, ""), (4, "d")])[1] == ("A", True) and seen[-1] == [2, 3, 4]
    # A run that was lost halfway has no mark of its end.
    (tmp_path / "generation=3").mkdir()
    (tmp_path / "generation=3" / "part-0.parquet").write_text("half")
    assert last_generation(spark, str(tmp_path)) == 2
    assert run([(1, "a"), (3, "")]) == {1: ("A", True), 3: ("", True)} and seen[-1] == [] and last_generation(spark, str(tmp_path)) == 3
    assert run([(1, "a"), (3, "")], "2")[1] == ("A", False) and seen[-1] == [1, 3]
    assert run([], "2") == {}
