"""Names found in texts against a search for each, and what annotations come to."""

from __future__ import annotations

import random
import unicodedata

from tidemark.operators.knowledge import assessed, conflicts, continuity_overrides, folded_annotations, known_entities, numbered, with_overrides

NOTE = "event long, id long, type string, priority long, created long, value double, text string, names array<string>, mood map<string,double>, other long"


def plain(text):
    return " ".join("".join(" " if unicodedata.category(c)[0] in "PS" else c for c in text.lower()).split())


def latin(c):
    return "LATIN" in unicodedata.name(c, "") or unicodedata.category(c)[0] == "N"


def is_mentioned(form, said):
    at = said.find(form)
    while at >= 0:
        before, after = said[at - 1 : at], said[at + len(form) : at + len(form) + 1]
        if not all(latin(c) or c == " " for c in form) or not (before and latin(before) or after and latin(after)):
            return True
        at = said.find(form, at + 1)
    return False


def test_names(spark):
    rng = random.Random(8)
    entities = [("me", "people", 0, []), ("USJ", "places", 1, ["ユニバ", "universal studios japan"]), ("partner", "people", 2, ["Anna-Lena", "Ö"]), ("x", "people", 3, ["山田"]), ("q7", "places", 4, ["R2 都", "new"])]
    words = ["come", "me", "USJ", "ame", "今日は", "だね", "universal", "studios", "japan", "Anna", "Lena", "山", "田", "R2", "都", "new", "newer", "7", "ö", "!", "ユニ", "バ"]
    texts = [(i, "".join(rng.choice(words) + rng.choice(["", " ", ", "]) for _ in range(rng.randint(0, 12)))) for i in range(400)] + [(1000, None), (1001, "今日はUSJだね"), (1002, "come to Universal  Studios, Japan!")]
    frame = spark.createDataFrame(texts, "id long, text string")
    got = {(r["id"], r["kind"]): r["entities"] for r in known_entities(frame, spark.createDataFrame(entities, "entity string, kind string, place long, names array<string>")).collect()}
    want = {}
    for i, text in texts:
        for name, kind, _, names in entities:
            if text and any(len(f) >= 2 and is_mentioned(f, plain(text)) for f in map(plain, [name, *names])):
                want.setdefault((i, kind), []).append(name)
    assert got == want and got[1001, "places"] == ["USJ"] and len(want) > 100
    assert known_entities(frame.limit(0), spark.createDataFrame(entities, "entity string, kind string, place long, names array<string>")).count() == 0


def test_fold(spark):
    rows = [
        (1, 1, "essential", 0, 5, None, None, None, None, None), (1, 2, "exclude", 9, 1, None, None, None, None, None), (1, 3, "rename", 1, 9, None, "late", None, None, None),
        (1, 4, "rename", 2, 1, None, "high", None, None, None), (1, 5, "label", 1, 1, None, None, ["b", "a"], None, None), (1, 6, "label", 0, 1, None, None, ["c"], None, None),
        (2, 7, "mood", 0, 1, None, None, None, {"joy": 0.5}, None), (2, 8, "mood", 0, 2, None, None, None, {"awe": 1.0}, None), (2, 9, "importance", 0, 1, 0.9, None, None, None, None),
        (2, 10, "note", 1, 1, None, "two", None, None, None), (2, 11, "note", 0, 1, None, "one", None, None, None), (3, 12, "narrative_role", 0, 0, None, "ending", None, None, None),
        (3, 13, "unheard", 0, 0, None, None, None, None, None), (1, 14, "continuity", 0, 1, 0.2, None, None, None, 2), (1, 15, "continuity", 0, 2, 0.7, None, None, None, 2),
    ]
    notes = spark.createDataFrame(rows, NOTE).repartition(5)
    f = {r["event"]: r for r in folded_annotations(notes).collect()}
    assert (f[1]["essential"], f[1]["excluded"], f[1]["contradictory"], f[1]["title"], f[1]["labels"]) == (False, True, True, "high", ["c", "b", "a"])
    assert (f[2]["mood"], f[2]["moods"], f[2]["importance"], f[2]["notes"]) == ({"awe": 1.0}, 2, 0.9, ["one", "two"]) and f[3]["role"] == "ending" and f[3]["refs"] == [12, 13]
    events = spark.createDataFrame([(1, "t", ["a", "a"], ["p"], {}), (2, "u", [], [], {"joy": 0.1}), (4, "v", ["z"], [], {"joy": 0.2})], "event long, title string, labels array<string>, people array<string>, affect map<string,double>")
    e = {r["event"]: r for r in with_overrides(events, folded_annotations(notes)).collect()}
    assert (e[1]["title"], e[1]["labels"], e[1]["people"], e[1]["overridden"]) == ("high", ["a", "c", "b"], ["p"], ["title", "labels"])
    assert (e[2]["affect"], e[2]["overridden"], e[4]["title"], e[4]["overridden"], e[4]["labels"]) == ({"awe": 1.0}, ["affect"], "v", [], ["z"])
    c = [tuple(r) for r in conflicts(notes, events).orderBy("conflict").collect()]
    assert c == [(1, "knowledge", None, "cfl_0001"), (2, "affect", 7, "cfl_0002"), (2, "affect", 8, "cfl_0003")]
    a = spark.createDataFrame([(2, 0.4, 0.3, "hook", {"hook": 0.6}), (3, 0.5, 0.2, "peak", {"peak": 1.0}), (5, 0.1, 0.1, "peak", {})], "event long, importance double, preserve double, role string, probabilities map<string,double>")
    h = {(r["event"], r["current"]): (r["importance"], r["preserve"], r["role"], r["probabilities"]) for r in assessed(a, folded_annotations(notes)).collect()}
    assert h == {(2, True): (0.9, 0.9, "hook", {"hook": 0.6}), (2, False): (0.4, 0.3, "hook", {"hook": 0.6}), (3, True): (0.5, 0.2, "ending", {"ending": 1.0}), (3, False): (0.5, 0.2, "peak", {"peak": 1.0}), (5, True): (0.1, 0.1, "peak", {})}
    assert [tuple(r) for r in continuity_overrides(notes).collect()] == [(1, 2, 0.7)]
    assert folded_annotations(notes.limit(0)).count() == 0


def test_numbered(spark):
    rows = spark.range(1000).selectExpr("id * 7919 % 1000 AS a").repartition(9)
    assert all(r["a"] + 1 == r["n"] for r in numbered(rows, ["a"], "n").collect())


def test_mentions_stay_with_their_text(spark):
    texts = spark.createDataFrame([(1, "日本tokyo tower日本, red car!"), (2, "tokyo日 tower red-car redcar"), (3, "Red  CAR red car tokyo")], "id long, text string")
    known = spark.createDataFrame([("tokyo tower", "places", 1, ["tower"]), ("red car", "places", 0, ["red", "car"]), ("x", "people", 2, ["car"])], "entity string, kind string, place long, names array<string>")
    out = known_entities(texts, known)
    assert sorted((r["id"], r["kind"], *r["entities"]) for r in out.collect()) == [(i, k, *e) for i in (1, 2, 3) for k, e in (("people", ["x"]), ("places", ["red car", "tokyo tower"] if i < 3 else ["red car"]))]
    # Texts and forms meet once; mentions, many times the texts, aren't joined with the texts again.
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1
