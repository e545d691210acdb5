"""Trims and clip pieces against a plain loop over each clip."""

from __future__ import annotations

import math
import random

import pytest

from tidemark.operators.trim import EVIDENCE, Handling, clip_pieces, trimmed, with_evidence
from pyspark.sql import functions as F

H = Handling(pad_in=150, pad_out=250, window=800, least_pause=500, handle=100)
NAMES = "asset long, id long, start long, end long, allocated long, least long, most long, settle boolean, snap boolean, edited boolean, reaction boolean, remove_pauses boolean"


def closest(options, at):
    """The option nearest to an instant within the window; the first of two."""
    best = None
    for o in options:
        if abs(o - at) <= H.window and (best is None or abs(o - at) < abs(best - at)):
            best = o
    return best


def by_hand(clip, ev, want, least, most):
    start, end = clip["start"], clip["end"]
    room = end - start
    want = min(max(want, least), most, room)
    if want >= room:
        return start, end, "whole_event"
    fits = lambda a, b: least <= b - a <= most
    talk = sorted(s for s in ev["speech"] if s[1] > start and s[0] < end)
    if talk:
        why, a = "speech", max(start, talk[0][0] - H.pad_in)
        b = a + want
        if clip["reaction"]:
            last = ([s for s in talk if s[0] < b] or talk[:1])[-1]
            b = max(b, min(end, a + most, last[1] + H.pad_out + 1200))
        near = closest([s[1] + H.pad_out for s in talk], b)
        if near is not None and near <= end:
            b = near
    else:
        why, a = "centre", start + (min(room * 0.15, 1200) if clip["settle"] else 0)
        b = a + want
    if b > end:
        a, b = max(start, end - want), end
    a0, b0 = a, b
    if clip["snap"]:
        x, y = closest([s[1] for s in ev["silences"]], a), closest([s[0] for s in ev["silences"]], b)
        x, y = max(start, a if x is None else x), min(end, b if y is None else y)
        if (x, y) != (a, b) and fits(x, y):
            a, b, why = x, y, "snapped"
    cuts = sorted({c for c, _ in ev["cuts"] if start <= c <= end}) if clip["edited"] else []
    shots = lambda x, y: [c for c in cuts if x < c < y]
    if cuts:
        x, y = a, b
        i, o = closest(cuts, a0), closest(cuts, b0)
        for p, q in ((i if i is not None else a, o if o is not None else b), (i, b), (a, o)):
            if p is not None and q is not None and fits(p, q):
                x, y = p, q
                break
        inner = shots(x, y)
        if inner and inner[0] - x < 400:
            before = [c for c in cuts if c <= x]
            x = inner[0] if y - inner[0] >= least else before[-1] if before and y - before[-1] <= most else x
        inner = shots(x, y)
        if inner and y - inner[-1] < 400:
            after = [c for c in cuts if c >= y]
            y = inner[-1] if inner[-1] - x >= least else after[0] if after and after[0] - x <= most else y
        if (x, y) != (a, b):
            a, b, why = x, y, "cut"

    def leave(at, inward, outward, span, flash):
        options = [inward, outward]
        return next((o for o in options if fits(*span(o)) and not flash(o)), next((o for o in options if fits(*span(o))), inward))

    hit = [w for w in ev["words"] if w[0] < a < w[1]]
    if hit:
        a = leave(a, max(start, hit[0][0]), min(end, hit[0][1]), lambda o: (o, b), lambda o: bool(shots(o, b)) and shots(o, b)[0] - o < 400)
    hit = [w for w in ev["words"] if w[0] < b < w[1]]
    if hit:
        b = leave(b, min(end, hit[0][1]), max(start, hit[0][0]), lambda o: (a, o), lambda o: bool(shots(a, o)) and o - shots(a, o)[-1] < 400)
    lo, hi = max(start, math.floor(a + 0.5)), min(end, math.floor(b + 0.5))
    if hi - lo < least:
        hi = min(end, lo + least)
        lo = max(start, hi - least)
    return lo, hi, why


def gone(a, b, ev):
    """Pauses by marking every millisecond of the clip."""
    words = [w for w in ev["words"] if w[1] > a and w[0] < b]
    quiet = [False] * (b - a)
    for s, e in ev["silences"] + [(x[1], y[0]) for x, y in zip(words, words[1:]) if not any(m[0] < y[0] and m[1] > x[1] for m in ev["music"])]:
        for t in range(max(a, s), min(b, e)):
            quiet[t - a] = True
    for s, e in words:
        for t in range(max(a, s), min(b, e)):
            quiet[t - a] = False
    runs, t = [], a
    while t < b:
        if quiet[t - a]:
            u = t
            while u < b and quiet[u - a]:
                u += 1
            if u - t >= H.least_pause:
                x, y = (a if t == a else t + H.handle), (b if u == b else u - H.handle)
                if y > x:
                    runs.append([x, y])
            t = u
        else:
            t += 1
    out = []
    for r in runs:
        if out and words and not any(w[0] < r[0] and w[1] > out[-1][1] for w in words):
            out[-1][1] = r[1]
        else:
            out.append(r)
    return [tuple(r) for r in out] if sum(y - x for x, y in out) < b - a else []


def spans(rng, n, least, most, gap):
    at, out = rng.randint(0, 900), []
    for _ in range(n):
        length = rng.randint(least, most)
        out.append((at, at + length))
        at += length + rng.choice(gap)
    return out


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(11)
    clips, evidence = [], {k: [] for k in EVIDENCE}
    for asset in range(40):
        per = {"words": spans(rng, 60, 80, 500, [5, 60, 200, 700, 1500]), "speech": spans(rng, 9, 500, 4000, [300, 2500]), "silences": spans(rng, 12, 200, 2500, [100, 900, 4000]), "music": spans(rng, 2, 1000, 6000, [9000]), "cuts": [(c, c + 1) for c in sorted({rng.randint(0, 30000) for _ in range(rng.choice([0, 6, 25]))})]}
        if asset % 5 == 0:
            per["words"] = []
        if asset % 4 == 0:
            per["speech"] = []
        for k, v in per.items():
            evidence[k] += [(asset, *r) for r in v]
        for n in range(6):
            start = rng.randint(0, 20000)
            least = rng.randint(300, 3000)
            clips.append((asset, asset * 10 + n, start, start + rng.randint(400, 15000), rng.randint(500, 9000), least, least + rng.randint(500, 8000), *(rng.random() < 0.5 for _ in range(5))))
    return clips, evidence


def frames(spark, corpus):
    clips, evidence = corpus
    return with_evidence(spark.createDataFrame(clips, NAMES), {k: spark.createDataFrame(v, "asset long, start long, end long") for k, v in evidence.items()}, ["asset"], 5000, H.window)


def per_asset(corpus, asset):
    return {k: sorted(r[1:] for r in v if r[0] == asset) for k, v in corpus[1].items()}


def test_trims(spark, corpus):
    got = {r["id"]: (r["in_ms"], r["out_ms"], r["reason"]) for r in trimmed(frames(spark, corpus), H, F.col("allocated"), F.col("least"), F.col("most")).collect()}
    clips = [dict(zip([c.split()[0] for c in NAMES.split(", ")], c)) for c in corpus[0]]
    assert {c["id"]: by_hand(c, per_asset(corpus, c["asset"]), c["allocated"], c["least"], c["most"]) for c in clips} == got
    assert {r for _, _, r in got.values()} == {"whole_event", "speech", "centre", "snapped", "cut"}


def test_pieces(spark, corpus):
    got = {r["id"]: r for r in clip_pieces(frames(spark, corpus), H).collect()}
    rounds = set()
    for row in corpus[0]:
        c = dict(zip([x.split()[0] for x in NAMES.split(", ")], row))
        ev, extra = per_asset(corpus, c["asset"]), 0
        for n in range(1, 5):
            lo, hi, why = by_hand(c, ev, c["allocated"] + extra, c["least"] + extra, c["most"] + extra)
            cut = gone(lo, hi, ev) if c["remove_pauses"] else []
            ms = sum(b - a for a, b in cut)
            if ms == extra:
                break
            extra = ms
        r = got[c["id"]]
        rounds.add(n)
        assert (r["in_ms"], r["out_ms"], r["reason"], r["removed_ms"], r["rounds"]) == (lo, hi, why, ms, n), c
        assert [tuple(x) for x in r["removed"]] == cut
        edges = [lo, *(x for span in cut for x in span), hi]
        assert [tuple(p) for p in r["pieces"]] == [(a, b) for a, b in zip(edges[::2], edges[1::2]) if b > a]
    assert rounds == {1, 2, 3, 4} or rounds == {1, 2, 3}


def test_no_evidence(spark):
    none = {k: spark.createDataFrame([], "asset long, start long, end long") for k in EVIDENCE}
    clips = spark.createDataFrame([(1, 1, 0, 10000, 4000, 1000, 6000, True, True, True, True, True), (1, 2, 0, 0, 4000, 1000, 6000, True, True, True, True, True)], NAMES)
    rows = {r["id"]: r for r in clip_pieces(with_evidence(clips, none, ["asset"], 5000, 500), H).collect()}
    assert (rows[1]["in_ms"], rows[1]["out_ms"], rows[1]["reason"]) == (1200, 5200, "centre") and len(rows[1]["pieces"]) == 1
    assert rows[2]["reason"] == "whole_event" and rows[2]["pieces"] == []
    assert clip_pieces(with_evidence(clips.limit(0), none, ["asset"], 5000, 500), H).count() == 0
