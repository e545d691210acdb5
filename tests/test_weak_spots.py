"""Merging of segments against a loop over all boundaries, levels and captions of dense scripts against plain loops."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from tidemark.functions import embedding
from tidemark.functions import text as tx
from tidemark.operators import review, segments, signals


def by_hand(atoms, least, most, threshold):
    a = [list(x) for x in sorted(atoms)]

    def join(i):
        a[i][1] = max(a[i][1], a[i + 1][1])
        del a[i + 1]

    fits = lambda i: max(a[i][1], a[i + 1][1]) - a[i][0] <= most and a[i + 1][2] < 1
    i = 0
    while i < len(a):
        if a[i][1] - a[i][0] < least:
            left, right = i > 0 and fits(i - 1), i + 1 < len(a) and fits(i)
            if left and (not right or a[i][2] <= a[i + 1][2]):
                join(i - 1)
                i -= 1
                continue
            if right:
                join(i)
                continue
        i += 1
    while weak := [(a[i + 1][2], i) for i in range(len(a) - 1) if a[i + 1][2] < threshold and fits(i)]:
        join(min(weak)[1])
    return [(s, e) for s, e, _ in a]


def test_merged(spark):
    rng = random.Random(7)
    rows, want = [], set()
    for plan in range(80):
        at, own = 0, []
        for _ in range(rng.randint(1, 40)):
            n = rng.choice([100, 300, 900, 2500])
            own.append((at, at + n, rng.choice([0.05, 0.1, 0.1, 0.3, 0.6, 1.0, rng.random()])))
            at += n + rng.choice([0, 0, 50])
        rows += [(plan, *x) for x in own]
        want |= {(plan, *x) for x in by_hand(own, 500, 4000, 0.38)}
    frame = spark.createDataFrame(rows, "plan long, start long, end long, separation double").repartition(6)
    assert {tuple(r) for r in segments.merged(frame, "plan", 500, 4000, 0.38).collect()} == want
    assert segments.merged(frame.limit(0), "plan", 500, 4000, 0.38).count() == 0


def test_levels(spark):
    rng = random.Random(2)
    values = {a: [rng.choice([-60.0, -40.0, -20.0, rng.random()]) for _ in range(n)] for a, n in ((1, 1), (2, 2), (3, 7), (4, 100))}
    frame = spark.createDataFrame([(a, i, v) for a, vs in values.items() for i, v in enumerate(vs)] + [(3, 99, None), (5, 0, None)], "a long, hop long, db double")
    got = {r["a"]: (r["p10"], r["p90"]) for r in signals.levels(frame, ["a"], "db").collect()}
    at = lambda vs, q: sorted(vs)[int((len(vs) - 1) * q + 0.5)]
    assert got == {a: (at(vs, 0.1), at(vs, 0.9)) for a, vs in values.items()} | {5: (-100.0, -100.0)}


def test_text_roles(spark):
    rows = [(1, 0, "one two three", 0.9), (1, 0, "four five six", 0.9), (1, 5, "seven eight nine", 0.8), (1, 6, "x", 0.9), (2, 0, "one two three", 0.9), (2, 1, None, 0.9)]
    got = sorted((r["a"], r["start"], str(r["text"]), r["text_role"]) for r in review.text_roles(spark.createDataFrame(rows, "a long, start long, text string, centre double"), ["a"], 2).collect())
    assert got == [(1, 0, "four five six", "subtitle"), (1, 0, "one two three", "subtitle"), (1, 5, "seven eight nine", "subtitle"), (1, 6, "x", "junk"), (2, 0, "one two three", "scene"), (2, 1, "None", "scene")]


def dense_by_hand(text, limit=13):
    if len(text) <= limit:
        return [text]
    if len(text) > 2 * limit:
        out = []
        while len(text) > limit:
            at = limit
            while at > 1 and text[at] in tx.NOT_FIRST:
                at -= 1
            out.append(text[:at].strip())
            text = text[at:]
        return out + ([text.strip()] if text else [])
    best = None
    for at in range(1, len(text)):
        a, b = at, len(text) - at
        if a > limit or b > limit or text[at] in tx.NOT_FIRST:
            continue
        score = abs(a - b) - (limit if text[at - 1] in "、。，．！？!?," else 0) + (0.5 if a > b else 0)
        if best is None or score < best[0]:
            best = (score, at)
    at = best[1] if best else limit
    return [x for x in (text[:at].strip(), text[at:].strip()) if x]


def test_dense_captions(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("日本語の文章、です。っー「」が") for _ in range(rng.randint(1, 70))) for _ in range(300)] + ["、" * 20, "。" * 40, "今日は USJ だね、また来ようね"]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string")
    got = {r["i"]: r["l"] for r in frame.select("i", tx.wrapped_dense(F.col("t")).alias("l")).collect()}
    assert got == {i: dense_by_hand(t) for i, t in enumerate(texts)}
    both = {r["i"]: r["l"] for r in frame.select("i", tx.caption_lines(F.col("t")).alias("l")).collect()}
    assert both[0] == got[0] and both[302] == got[302]


def test_embeddings_of_batches():
    rng = random.Random(9)
    words = ["harbour", "a", "夜景", "é", "😀x", "x" * 70, "the", "of"]
    texts = [[rng.choice(words) for _ in range(rng.randint(0, 30))] for _ in range(60)] + [[], None, ["a"]]
    some = ["w:a", "c2:é😀", "", "w:" + "夜" * 40, "c3:abc"]
    own, sign = embedding.hashes(some)
    assert own.tolist() == [embedding.fnv1a(f) for f in some] and sign.tolist() == [embedding.fnv1a(f"{f}#sign") for f in some]
    for t, v in zip(texts, embedding.embedded_batch(texts)):
        assert (t is None) == (v is None) and (t is None or max(abs(a - b) for a, b in zip(v, embedding.embedded(t))) < 1e-12)
    assert embedding.embedded_batch([]) == []


def test_chapters_limited(spark):
    rng = random.Random(12)
    rows, want = [], set()
    for owner in range(20):
        groups, at, i = [], 0, 0
        for chapter in range(1, rng.choice([3, 12, 13, 30]) + 1):
            group = []
            for _ in range(rng.randint(1, 4)):
                group.append((owner, owner * 1000 + i, at, at + 10, rng.random() < 0.3 if not group else False, chapter))
                i, at = i + 1, at + 10
            groups.append(group)
            at += rng.choice([0, 0, 50, 700])
        rows += [e for g in groups for e in g]
        while len(groups) > 12:
            free = [(groups[k][0][2] - groups[k - 1][-1][3], len(groups[k - 1]) + len(groups[k]), k) for k in range(1, len(groups)) if not groups[k][0][4]]
            k = min(free or [(groups[k][0][2] - groups[k - 1][-1][3], len(groups[k - 1]) + len(groups[k]), k) for k in range(1, len(groups))])[2]
            groups[k - 1 : k + 1] = [groups[k - 1] + groups[k]]
        want |= {(e[1], n + 1) for n, g in enumerate(groups) for e in g}
    frame = spark.createDataFrame(rows, "owner long, id long, start long, end long, card boolean, chapter long").repartition(5)
    assert {(r["id"], r["chapter"]) for r in review.chapters_limited(frame, "owner").collect()} == want
    assert review.chapters_limited(frame.limit(0), "owner").count() == 0
