"""Sync: offsets of planted echoes across blocks, companions and their speech."""

from __future__ import annotations

import numpy as np
import pytest

from tidemark.operators.sync import audio_companions, measured_offsets, skipped_pairs, sync_candidates, with_companion_speech

ENV = "asset long, hop long, onset double"


@pytest.fixture(scope="module")
def onsets():
    rng = np.random.default_rng(2)
    base = np.where(rng.random(900) < 0.2, rng.random(900) * 20, 0)
    out = {1: base[:700], 2: base[137:620] + rng.random(483), 3: rng.random(500) * 5, 4: np.zeros(300), 5: base[400:] + rng.random(500)}
    return out


@pytest.mark.parametrize("block", [4096, 100, 64])
def test_offsets(spark, onsets, block):
    frame = spark.createDataFrame([(a, h, float(v)) for a, x in onsets.items() for h, v in enumerate(x)], ENV)
    pairs = spark.createDataFrame([(a, b) for a in onsets for b in onsets if a != b] + [(2, 1), (9, 1)], "asset long, reference long")
    got = {(r["asset"], r["reference"]): r for r in measured_offsets(frame, pairs, 10, block).collect()}
    want = {}
    for a in onsets:
        for b in onsets:
            x, y = (v - v.mean() for v in (onsets[b], onsets[a]))
            if a == b or not x.any() or not y.any():
                continue
            c = np.correlate(x / np.linalg.norm(x), y / np.linalg.norm(y), "full")
            k = int(c.argmax())
            ratio = c[k] / c[np.abs(np.arange(len(c)) - k) > 50].max()
            left, right = c[k - 1] if k else 0, c[k + 1] if k + 1 < len(c) else 0
            bend = left - 2 * c[k] + right
            ms = int(np.floor((k - len(y) + 1 + (0.5 * (left - right) / bend if bend < 0 else 0)) * 10 + 0.5))
            if ratio >= 1.5 and min(len(x) * 10, ms + len(y) * 10) - max(0, ms) >= 1000:
                want[a, b] = ms, ratio
    assert got.keys() == want.keys() and {(2, 1), (1, 2), (5, 1), (1, 5)} <= got.keys()
    for pair, (ms, ratio) in want.items():
        assert got[pair]["offset_ms"] == ms and abs(got[pair]["score"] - ratio) < 0.006
    assert abs(got[2, 1]["offset_ms"] - 1370) < 10 and abs(got[5, 1]["offset_ms"] - 4000) < 10


def test_candidates(spark):
    rows = [(1, 10, "audio", True, None, 100), (1, 11, "video", True, 0, 1000), (1, 12, "video", True, 61000, 10), (1, 13, "video", True, 61001, 10), (1, 14, "video", True, None, 10), (1, 15, "audio", False, 0, 10), (2, 20, "video", True, 0, 10)]
    assets = spark.createDataFrame(rows, "project long, id long, kind string, has_audio boolean, start long, ms long")
    pairs = lambda cap: [(r["asset"], r["reference"], r["place"]) for r in sync_candidates(assets, ["project"], cap).orderBy("place").collect()]
    # 12 starts just 60 s after 11 ends: within the slack only if it were strictly nearer.
    assert pairs(100) == [(10, 11, 0), (10, 12, 1), (10, 13, 2), (10, 14, 3), (13, 12, 4)]
    assert pairs(2) == pairs(100)[:2]
    total = len(pairs(100))
    assert {r["project"]: (r["pairs"], r["skipped"]) for r in skipped_pairs(assets, ["project"], 2).collect()} == {1: (total, total - 2), 2: (0, 0)}


def test_companions(spark):
    assets = spark.createDataFrame([(1, "video", 10000), (2, "video", 10000), (7, "audio", 6000), (8, "audio", 9000), (9, "audio", 100)], "id long, kind string, ms long")
    syncs = spark.createDataFrame([(7, 1, 1000, 3.0, 0.9, False), (8, 1, 0, 2.0, 0.6, False), (9, 2, 500, 9.0, 0.9, False), (9, 2, 500, 0.0, 1.0, True), (8, 2, 0, 5.0, 0.9, False), (2, 1, 0, 9.0, 0.9, False)], "asset long, reference long, offset_ms long, score double, confidence double, declared boolean")
    c = audio_companions(syncs, assets)
    assert {r["video"]: (r["recorder"], r["declared"], r["start"], r["end"]) for r in c.collect()} == {1: (7, False, 1000, 7000), 2: (9, True, 500, 600)}
    said = [(1, "a", 0, 1000, None), (1, "b", 900, 1100, None), (1, "c", 7000, 8000, None), (7, "d", 100, 7000, [(100, 200, "x"), (5990, 6100, "y")]), (7, "e", 6500, 6900, None), (2, "f", 0, 400, None)]
    u = spark.createDataFrame(said, "asset long, id string, start long, end long, words array<struct<start:long,end:long,word:string>>")
    got = {(r["asset"], r["id"]): (r["start"], r["end"], None if r["words"] is None else [w["word"] for w in r["words"]]) for r in with_companion_speech(u, c).collect()}
    assert got == {(1, "a"): (0, 1000, None), (1, "c"): (7000, 8000, None), (1, "d-on-1"): (1100, 7000, ["x"]), (7, "d"): (100, 7000, ["x", "y"]), (7, "e"): (6500, 6900, None), (2, "f"): (0, 400, None)}


def test_empty(spark):
    none = spark.createDataFrame([], ENV)
    assert measured_offsets(none, spark.createDataFrame([], "asset long, reference long")).count() == 0
