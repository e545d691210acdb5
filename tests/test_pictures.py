"""Frames against plain loops, picture events, and events by level of detail."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators.pictures import frame_statistics, picture_events
from tidemark.operators.summaries import analysis_figures, event_details


def test_frames(spark):
    rng = random.Random(5)
    rows = [(a, h, bytes(rng.choice([rng.randrange(256), 7]) for _ in range(64 * 36))) for a, n in ((1, 5), (2, 1), (3, 2)) for h in range(n)] + [(1, 9, b"short"), (1, 10, None)]
    got = {(r["a"], r["hop"]): r for r in frame_statistics(spark.createDataFrame(rows, "a long, hop long, grey binary").repartition(4), ["a"]).collect()}
    frames = {(a, h): g for a, h, g in rows if g and len(g) == 2304}
    assert got.keys() == frames.keys()

    def motion(x, y):
        cells = {}
        for i, (p, q) in enumerate(zip(x, y)):
            cells.setdefault((i // 64 // 12, i % 64 // 16), []).append(abs(p - q))
        return max(sum(c) / len(c) for c in cells.values())

    for (a, h), g in frames.items():
        r, at = got[a, h], max(h, 1)
        assert abs(r["luma"] - sum(g) / len(g)) < 1e-9 and r["peak"] == sorted(g)[math.ceil(len(g) * 0.98) - 1]
        assert abs(r["motion"] - (motion(frames[a, at - 1], frames[a, at]) if (a, at) in frames else 0)) < 1e-9


def test_picture_events(spark):
    still = [0.1] * 12 + [3.0] + [0.0] * 3 + [0.4] * 15
    rows = [(1, h, m, 5 if 3 <= h < 5 else 200) for h, m in enumerate(still)]
    got = sorted(tuple(r) for r in picture_events(spark.createDataFrame(rows, "a long, hop long, motion double, peak int"), ["a"], 250).collect())
    assert got == [(1, 0, 3000, "static", 0.8), (1, 750, 1250, "black", 0.9), (1, 3250, 7750, "static", 0.5)]
    assert picture_events(spark.createDataFrame([], "a long, hop long, motion double, peak int"), ["a"], 250).count() == 0


def test_details(spark):
    lists = "speech on_screen_text seen sound people places topics notes".split()
    schema = "id long, chapter long, start long, end long, description string, event_type string, essential boolean, confidence double, inactive_ratio double, " + ", ".join(f"{c} array<string>" for c in lists) + ", affect map<string,double>, excluded boolean"
    row = lambda i: (i, 1, 1000, 61500, "d", "moment", False, 0.5, 0.0, *[["x", "y", "x"]] * 8, {"joy": 1.0}, False)
    events = spark.createDataFrame([row(1), row(2)], schema)
    judged = spark.createDataFrame([(1, "hook", {"story_importance": 0.9}, {"preserve": 0.1}, {"hook": 1.0}, "because")], "id long, role string, metrics map<string,double>, flags map<string,double>, probabilities map<string,double>, rationale string")
    near = spark.createDataFrame([(1, 2, "same_topic", 0.5)], "source long, target long, kind string, strength double")
    short = {r["id"]: r for r in event_details(events, judged).collect()}
    assert (short[1]["start"], short[1]["duration_ms"], short[1]["role"], short[1]["importance"], short[1]["emotion"], short[1]["inactive_ratio"]) == ("00:00:01.000", 60500, "hook", 0.9, 0.5, None)
    assert (short[2]["role"], short[2]["importance"]) == ("context", 0.5) and "speech" not in short[1]
    more = event_details(events, judged, "detailed").collect()[0]
    assert more["sound"] == ["x", "y"] and more["seen"] == ["x", "y", "x"] and "metrics" not in more
    full = {r["id"]: r for r in event_details(events, judged, "full", near).collect()}
    assert [tuple(x) for x in full[2]["relations"]] == [("same_topic", 1, 0.5)] and full[2]["metrics"] == {} and full[1]["rationale"] == "because"
    with pytest.raises(ValueError):
        event_details(events, judged, "all")


def test_figures(spark):
    none = spark.createDataFrame([], "ms long, cost double")
    got = {r["figure"]: r["value"] for r in analysis_figures({"event": none, "shot": spark.range(3)}, none, none, none).collect()}
    assert got == {"event_count": 0, "shot_count": 3, "total_media_duration_ms": 0, "mean_event_duration_ms": 0, "total_cost_usd": 0}
    some = spark.range(2).select((F.col("id") * 3).alias("ms"), F.lit(0.5).alias("cost"))
    assert {r["figure"]: r["value"] for r in analysis_figures({}, some, some, some).collect()} == {"total_media_duration_ms": 3, "mean_event_duration_ms": 2, "total_cost_usd": 1}
