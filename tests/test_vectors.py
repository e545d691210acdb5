"""Search and calibration of vectors by blocks, against a row for each pair."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions.numbers import cosine
from tidemark.operators import search


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(5)
    some = [[rng.choice([-1.0, 0.0, 0.5, 2.0]) for _ in range(4)] for _ in range(9)]
    rows = [(i, rng.choice([1, 1, 1, 2, None]), rng.choice(some)) for i in range(150)]
    rows += [(200, 1, None), (201, 1, [0.0] * 4), (202, 1, [1.0, None, 0.0, 0.0]), (203, 1, [1.0, 2.0]), (204, 1, [2.0, 4.0]), (205, 9, some[0]), (206, 2, [])]
    e = spark.createDataFrame(rows, "id long, kind int, v array<float>")
    q = e.where("id % 7 = 0 or id > 199").select(F.col("id").alias("query_id"), "kind", F.col("v").alias("q"))
    return q, e


def pairs(q, e):
    return q.join(e, "kind").where((F.col("query_id") != F.col("id")) & (F.size("q") == F.size("v"))).select("query_id", "id", cosine(F.col("q"), F.col("v")).alias("score"))


@pytest.mark.parametrize("rows, queries", [(2048, 256), (3, 2)])
def test_nearest(tables, monkeypatch, rows, queries):
    monkeypatch.setattr(search, "ROWS", rows)
    monkeypatch.setattr(search, "QUERIES", queries)
    got = {tuple(r) for r in search.nearest_vectors(*tables, "kind", 4).select("query_id", "id", "score", "rank").collect()}
    assert got == {tuple(r) for r in search.best(pairs(*tables), 4, ["query_id"]).select("query_id", "id", "score", "rank").collect()}
    assert len(got) > 80


@pytest.mark.parametrize("rows, scores", [(2048, 2**24), (3, 300)])
def test_calibration(tables, monkeypatch, rows, scores):
    monkeypatch.setattr(search, "ROWS", rows)
    monkeypatch.setattr(search, "SCORES", scores)
    got = {tuple(r) for r in search.vector_calibration(*tables, "kind").collect()}
    assert got == {tuple(r) for r in search.calibration(pairs(*tables), ["query_id"]).collect()}
    assert len(got) > 20


def test_no_row_for_each_pair(spark, sf_dir):
    from tidemark import plans

    for name in ("flat_vector_search", "robust_calibration", "corpus_discrimination", "hybrid_search"):
        frame = plans.QUERIES[name](spark, sf_dir)
        # Cosines of pairs in Spark's own rows are what took the time.
        assert "zip_with" not in frame._jdf.queryExecution().optimizedPlan().toString(), name


def test_hybrid(spark, tables, monkeypatch):
    from tidemark.functions.numbers import rounded, strength

    monkeypatch.setattr(search, "ROWS", 5)
    monkeypatch.setattr(search, "TILE", 2)
    rng = random.Random(6)
    words = spark.createDataFrame([(i, rng.sample(["red", "car", "sun", "été", "日本"], rng.randrange(6))) for i in range(0, 230) if i % 9], "id long, features array<string>")
    q, e = tables
    c = search.vector_calibration(q, e, "kind")
    text = words.select("id", F.array_join("features", " ").alias("words"))
    got = search.hybrid(q.join(text.withColumnRenamed("id", "query_id"), "query_id", "left").join(c, "query_id", "left"), e.join(text, "id", "left"), "kind", 5)
    lexical = search.lexical(words.withColumnRenamed("id", "query_id"), words)
    both = pairs(q, e).join(c, "query_id").join(lexical, ["query_id", "id"], "left")
    similar = F.when(F.col("centre").isNull(), F.col("score")).otherwise(strength(F.col("score"), F.col("centre"), F.col("spread"), F.col("undiscriminating")))
    each = both.select("query_id", "id", rounded(0.65 * similar + 0.35 * F.coalesce("coverage", F.lit(0.0))).alias("score")).where("score > 0")
    expected = {tuple(r) for r in search.best(each, 5, ["query_id"]).collect()}
    assert {tuple(r) for r in got.select("query_id", "id", "score", "rank").collect()} == expected and len(expected) > 80
