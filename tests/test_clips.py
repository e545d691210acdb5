"""Clips, context, embeddings and envelopes on small cases."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions.embedding import embedded, fnv1a
from tidemark.operators import clips, planner, segments, signals

RANGE = "owner long, start long, end long"


def test_fnv1a_vectors():
    # Published 32-bit vectors of the hash.
    assert fnv1a("") == 0x811C9DC5 and fnv1a("a") == 0xE40C292C and fnv1a("foobar") == 0xBF9CF968


def test_embedding_is_a_unit_vector():
    v = embedded(["hello", "world"])
    assert len(v) == 256 and math.isclose(sum(x * x for x in v), 1) and embedded([]) == [0.0] * 256
    assert embedded(["hello", "world"]) == v


def test_context_cascades(spark):
    chosen = spark.createDataFrame([(1, 1), (1, 2), (1, 3), (2, 9)], "p long, id long")
    needs = spark.createDataFrame([(2, 7), (3, 2), (9, 9)], "id long, needs long")
    assert sorted((r["p"], r["id"]) for r in clips.with_context(chosen, needs, "p").collect()) == [(1, 1), (2, 9)]


def test_pauses_keep_handles(spark):
    quiet = spark.createDataFrame([(1, 0, 5000), (1, 9000, 9500)], RANGE)
    words = spark.createDataFrame([(1, 2000, 2100)], RANGE)
    got = sorted((r["start"], r["end"]) for r in clips.pauses(quiet, words, ["owner"], 700, 120).collect())
    assert got == [(120, 1880), (2220, 4880)]


def test_cues_break_at_sentences_pauses_and_length(spark):
    words = [("Hello", 0), ("there.", 300), ("New", 600), ("one", 900), ("late", 5000)]
    frame = spark.createDataFrame([(1, at, at + 250, w) for w, at in words], "f long, start long, end long, word string")
    assert [r["text"] for r in planner.cues(frame, ["f"]).orderBy("start").collect()] == ["Hello there.", "New one", "late"]
    many = spark.createDataFrame([(1, i * 300, i * 300 + 250, "word") for i in range(60)], "f long, start long, end long, word string")
    rows = planner.cues(many, ["f"]).collect()
    assert all(r["end"] - r["start"] <= 7000 and len(r["text"]) <= 84 for r in rows) and sum(len(r["text"].split()) for r in rows) == 60


def test_boundaries_are_thinned_from_the_last_kept(spark):
    b = spark.createDataFrame([(1, t) for t in (0, 500, 900, 1700, 1800)], "a long, at long")
    assert [(r["start"], r["end"]) for r in segments.thinned(b, ["a"], "at", 800).orderBy("start").collect()] == [(0, 900), (900, 1700), (1700, None)]


def test_weak_boundaries_are_merged(spark):
    atoms = spark.createDataFrame([(1, 0, 1000, 0.0), (1, 1000, 6000, 0.9), (1, 6000, 12000, 0.1), (1, 12000, 20000, 0.5)], RANGE + ", separation double")
    got = [(r["start"], r["end"]) for r in segments.merged(atoms, "owner", 2000, 45000, 0.38).orderBy("start").collect()]
    assert got == [(0, 12000), (12000, 20000)]


def test_offset_of_shifted_envelopes(spark):
    x = np.random.default_rng(1).normal(size=400)
    frame = spark.createDataFrame([(1, x[:300].tolist(), x[37:337].tolist()), (2, [1.0] * 5, [1.0, 2.0])], "k long, a array<double>, b array<double>")
    got = {r["k"]: r for r in signals.offsets(frame, "a", "b", 50).collect()}
    assert got[1]["offset"] == pytest.approx(37, abs=0.5) and got[1]["ratio"] > 2 and got[2]["offset"] is None


def test_labels_by_deviation(spark):
    row = spark.createDataFrame([([0.0] * 9 + [10.0],), ([1.0] * 10,)], "s array<double>")
    got = [r["x"] for r in row.select(signals.labels_by_deviation(F.col("s"), list("abcdefghij")).alias("x")).collect()]
    assert got == [["j"], []]
