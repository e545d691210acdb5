"""Small cases of the operators: touching ranges, ties, nulls, empty tables and order-sensitive passes."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import conditions, numbers, text, time
from tidemark.operators import components, intervals, planner, rules, scans, search, segments
from tidemark.sources import files, writers

RANGE = "owner long, id long, start long, end long"


def rows(frame, *columns):
    return sorted(tuple(r) for r in frame.select(*columns).collect())


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_touching_ranges_do_not_overlap_but_merge(spark):
    a = spark.createDataFrame([(1, 1, 0, 10), (1, 2, 10, 20), (1, 3, 25, 30)], RANGE)
    joined = intervals.overlap_join(a, a, ["owner"], 7)
    assert rows(joined, "id", "r_id") == [(1, 1), (2, 2), (3, 3)]
    assert rows(intervals.union(a, ["owner"]), "start", "end", "n") == [(0, 20, 2), (25, 30, 1)]
    assert rows(intervals.gaps(a, ["owner"]), "start", "end") == [(20, 25)]


def test_range_join_against_brute_force(spark):
    rng = random.Random(3)
    data = [(rng.randrange(3), i, s := rng.randrange(200), s + rng.randrange(1, 40)) for i in range(120)]
    a = spark.createDataFrame(data, RANGE)
    want = sorted((x[1], y[1], min(x[3], y[3]) - max(x[2], y[2])) for x in data for y in data if x[0] == y[0] and x[2] < y[3] and y[2] < x[3])
    for width in (1, 13, 500):
        assert rows(intervals.overlap_join(a, a, ["owner"], width), "id", "r_id", "overlap") == want


def test_interval_algebra_against_points(spark):
    rng = random.Random(5)
    make = lambda: [(1, i, s := rng.randrange(100), s + rng.randrange(1, 15)) for i in range(12)]
    x, y = make(), make()
    points = lambda rs: {p for *_, s, e in rs for p in range(s, e)}
    a, b = spark.createDataFrame(x, RANGE), spark.createDataFrame(y, RANGE)
    assert points(rows(intervals.subtract(a, b, ["owner"]), "start", "end")) == points(x) - points(y)
    assert points(rows(intervals.intersect(a, b, ["owner"]), "start", "end")) == points(x) & points(y)
    assert rows(intervals.covered(a, ["owner"]), "covered") == [(len(points(x)),)]


def test_nearest_prefers_the_earlier_of_two(spark):
    left = spark.createDataFrame([(1, 10), (1, 100), (2, 5)], "k long, at long")
    right = spark.createDataFrame([(1, 5, 50), (1, 15, 51), (1, 15, 49)], "k long, t long, v long")
    out = intervals.nearest(left, right, ["k"], "at", "t", "v", 20)
    assert sorted((r["k"], r["at"], r["v"]) for r in out.collect() if r["v"] is not None) == [(1, 10, 50)]
    assert out.count() == 3


def test_topmost_track_wins(spark):
    clips = spark.createDataFrame([(1, 1, 0, 10, 0), (1, 2, 4, 6, 1), (1, 3, 4, 5, 1)], RANGE + ", track int")
    assert rows(intervals.topmost(clips, ["owner"], 5), "start", "end", "id") == [(0, 4, 1), (4, 6, 2), (6, 10, 1)]


def test_session_gap_is_exclusive(spark):
    e = spark.createDataFrame([(1, 0, 1), (1, 10, 2), (1, 21, 3)], "u long, at long, id long")
    assert rows(scans.sessions(e, ["u"], "at", 10, "id"), "id", "session") == [(1, 1), (2, 1), (3, 2)]


def test_runs_and_positions(spark):
    e = spark.createDataFrame([(1, i, f) for i, f in enumerate([True, True, False, None, True])], "u long, i long, f boolean")
    assert rows(scans.runs(e, ["u"], ["i"], "f"), "first", "last", "n") == [(1, 2, 2), (5, 5, 1)]
    assert [r["position"] for r in scans.positions(e, ["u"], ["i"]).orderBy("i").collect()] == ["first", "middle", "middle", "middle", "last"]


def test_empty_tables(spark):
    empty = spark.createDataFrame([], RANGE)
    for frame in (intervals.overlap_join(empty, empty, ["owner"], 10), intervals.union(empty, ["owner"]), intervals.subtract(empty, empty, ["owner"]), segments.atoms(empty, 10, 2)):
        assert frame.count() == 0


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (5, 5), (None, 4)] + [(i, i + 1) for i in range(100, 140)], "u long, v long")
    got = dict(rows(components.connected_components(edges), "node", "component_id"))
    assert got[3] == 1 and got[9] == 8 and got[140] == 100 and 5 not in got and 4 not in got


def test_text(spark):
    lit = F.lit
    assert one(spark, text.normalize_text(lit("  Héllo—WORLD!! ａ\t$5 "))) == "héllo world ａ 5"
    assert one(spark, text.normalize_text(lit("Ａｂ"), compatibility=True)) == "ab"
    assert one(spark, text.features(lit("a cat 東京都 猫"))) == ["cat", "東京", "京都", "猫"]
    assert one(spark, text.coverage(F.array(lit("a"), lit("b")), F.array(lit("b")))) == 0.5
    assert one(spark, text.coverage(F.array().cast("array<string>"), F.array(lit("b")))) == 0
    assert one(spark, text.mentions_form(lit("a cat sat"), "cat")) and not one(spark, text.mentions_form(lit("concatenate"), "cat"))
    assert one(spark, text.shortened(lit("a  b c d"), 4)) == "a b…"
    assert one(spark, text.tokens(F.lit(None).cast("string"))) == []


def test_numbers(spark):
    assert one(spark, numbers.rounded(F.lit(0.00005))) == 0.0001 and one(spark, numbers.rounded(F.lit(-0.00005))) == 0
    assert one(spark, numbers.decibels(F.lit(0.0))) == -100
    assert one(spark, numbers.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) == 0
    assert one(spark, numbers.clamp(F.lit(None).cast("double"))) is None
    assert one(spark, numbers.evenly(F.array(*map(F.lit, range(10))), 3)) == [0, 5, 9]
    assert one(spark, numbers.best_key(F.create_map(F.lit("b"), F.lit(1.0), F.lit("a"), F.lit(1.0)))) == "a"


def test_time(spark):
    assert one(spark, time.parse_timecode(F.lit("1:02:03.4"))) == 3723400
    assert one(spark, time.parse_timecode(F.lit("x"))) is None
    assert one(spark, time.smpte(F.lit(1800), 30000, 1001)) == "00:01:00;02"
    assert one(spark, time.smpte(F.lit(17982), 30000, 1001)) == "00:10:00;00"
    assert one(spark, time.capture_time(F.lit("2026-05-17T10:00:00Z")))["kind"] == "instant"
    assert one(spark, time.capture_time(F.lit("2026:05:17 10:00:00")))["kind"] == "local"
    assert one(spark, time.capture_time(F.lit("1960-01-01"))) is None


def test_conditions(spark):
    x = {"a": F.lit(0.5), "none": F.lit(None).cast("double"), "kind": F.lit("view"), "text": F.lit("Big, red dog")}
    holds = lambda tree: one(spark, conditions.condition(tree, x))
    assert holds({"a": "0.5..0.7"}) and holds({"a": {"gt": 0.1, "lt": 0.6}}) and not holds({"a": "!=0.5"})
    assert not holds({"none": "<1"}) and holds({"not": {"none": "<1"}}) and holds({"mentions": "red dog", "kind": ["view"]})
    for bad in ("0.7..0.1", "x>1", ""):
        with pytest.raises(ValueError):
            conditions.comparator(F.lit(1.0), bad)
    with pytest.raises(KeyError):
        conditions.condition({"missing": 1}, x)


def test_rules_replace_in_place():
    base = rules.RuleSet({"a": 1.0}, [rules.Rule("x", {}, {"drop": True}), rules.Rule("y", {}, {})])
    child = base.extended({"b": 2.0}, [rules.Rule("x", {}, {}), rules.Rule("z", {}, {})])
    assert [r.id for r in child.rules] == ["x", "y", "z"] and not child.rules[0].then and child.weights == {"a": 1.0, "b": 2.0}


def test_greedy_and_allocation(spark):
    c = spark.createDataFrame([(1, 1, 50, 0.9, False), (1, 2, 60, 0.8, False), (1, 3, 40, 0.1, True), (1, 4, 10, 0.8, False)], "p long, id long, ms long, value double, required boolean")
    chosen = planner.greedy(c, spark.createDataFrame([(1, 100)], "p long, budget long"), "p")
    assert [r["id"] for r in chosen.orderBy("rank").collect()] == [3, 1, 4]
    clips = spark.createDataFrame([(1, 1, 1, 10, 100, 80, 1.0, 120), (1, 2, 2, 10, 100, 80, 1.0, 120)], "p long, id long, position long, min_ms long, max_ms long, preferred_ms long, value double, target long")
    assert sorted(r["ms"] for r in planner.allocate(clips, "p", "target").collect()) == [60, 60]


def test_calibration_needs_five_scores(spark):
    s = spark.createDataFrame([(1, 0.1 * i) for i in range(5)] + [(2, 0.5)] * 6 + [(3, 0.1)], "q long, score double")
    got = {r["q"]: r["centre"] for r in search.calibration(s, ["q"]).collect()}
    assert got[1] == pytest.approx(0.2) and got[2] is None and got[3] is None


def test_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    for name in ("a/x.MP4", "y.wav", ".z.mp4", "n.txt"):
        (tmp_path / name).write_bytes(b"1")
    assert sorted(r["kind"] for r in files.discovered(spark, str(tmp_path)).collect()) == ["audio", "video"]
    bad = spark.createDataFrame([(1, "{")], "id long, probe string")
    assert files.probed(bad).first()["duration_ms"] is None


def test_chapters(spark):
    c = spark.createDataFrame([(1, 5000, "a"), (1, 16000, "a"), (1, 20000, "b"), (1, 20500, "c"), (1, 24000, "d"), (1, 40000, "e")], "p long, start long, title string")
    assert [(r["start"], r["title"]) for r in writers.chapter_lines(c, "p").orderBy("n").collect()] == [(0, "a"), (20500, "c"), (40000, "e")]


def test_bounded_plans(spark):
    from tidemark.operators import planner

    rows = [(1, i, i // 3) for i in range(25)] + [(2, 100, 0), (2, 101, 50), (None, 102, None)]
    out = planner.bounded_plans(spark.createDataFrame(rows, "owner long, id long, start long"), "owner", "start", 20, 8).collect()
    groups = {}
    for r in out:
        groups.setdefault(r["plan"], []).append(r["id"])
    assert len(out) == len(rows)
    assert {k: sorted(v) for k, v in groups.items()} == {"1/0/0": [*range(8)], "1/0/1": [*range(8, 16)], "1/0/2": [*range(16, 24)], "1/0/3": [24], "2/0/0": [100], "2/2/0": [101], "-/-/0": [102]}
