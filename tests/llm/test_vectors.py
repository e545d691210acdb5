"""Embedding near-dedup and exact top-k search against brute force."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import vectors
from tidemark.llm.topk import top_k

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute_links(rows, least=0.98):
    good = [(i, np.array(x, float), y) for i, x, y in rows if y is not None and x is not None and None not in x and np.isfinite(np.array(x, float)).all() and np.any(x)]
    near = {i: set() for i, *_ in rows}
    for i, x, y in good:
        for j, z, w in good:
            if i != j and y == w and len(x) == len(z) and x @ z / np.linalg.norm(x) / np.linalg.norm(z) >= least:
                near[i].add(j)
    out = {}
    for i in near:
        seen, todo = {i}, [i]
        while todo:
            new = near[todo.pop()] - seen
            seen |= new
            todo += new
        out[i] = (len(near[i]), min(seen), min(seen) == i)
    return out


def cases(n=400, seed=2):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(40, 16))
    rows = []
    for i in range(n):
        x = base[rng.integers(40)] + rng.normal(size=16) * (0.05 if i % 3 else 0.6)
        rows.append((i, [float(np.float32(v)) for v in x], int(rng.integers(2))))
    rows += [(n, None, 0), (n + 1, [0.0] * 16, 0), (n + 2, [float("nan")] + [1.0] * 15, 0), (n + 3, rows[5][1], None), (n + 4, [float("inf")] * 16, 1), (n + 5, [1.0, None], 1)]
    rows += [(n + 10 + i, rows[7][1], rows[7][2]) for i in range(30)]
    return rows + [(n + 50, [1.0, 1.0], 0), (n + 51, [2.0, 2.0], 0)]


@pytest.mark.parametrize("shard", [10000, 60])
def test_near_duplicates(spark, shard):
    rows = cases()
    frame = spark.createDataFrame(rows, SCHEMA).withColumn("component_id", F.lit("clash"))
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in vectors.near_duplicate_vectors(frame, shard=shard).collect()}
    assert got == brute_links(rows)


def test_graph_recall():
    rng = np.random.default_rng(4)
    x = vectors._unit(rng.normal(size=(3000, 24)))
    g = vectors.SmallWorld(x)
    ids, _ = g.search(g.x[:300], 64)
    true = np.argsort(-(g.x[:300] @ g.x.T), axis=1)[:, :10]
    assert np.mean([len(set(a[:10]) & set(b)) / 10 for a, b in zip(ids, true)]) > 0.9


def test_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert vectors.near_duplicate_vectors(empty).count() == 0
    assert top_k(empty, 5, F.col("vec_id") % 20 == 0).count() == 0


@pytest.mark.parametrize("k", [1, 7, 1000])
def test_top_k(spark, k):
    rows = [r for r in cases(300) if r[1] is None or len(r[1]) == 16]
    rows += [(1000 + i, rows[20][1], 0) for i in range(40)]  # ties
    got = {}
    for r in top_k(spark.createDataFrame(rows, SCHEMA).withColumn("score", F.lit(1)), k, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    x = {i: np.floor(np.array(v, float) * 64).astype(int) for i, v, _ in rows if v is not None and None not in v and np.isfinite(np.array(v, float)).all()}
    want = {}
    for q in (i for i in x if i % 20 == 0):
        best = sorted((-int(x[q] @ x[i]), i) for i in x if i != q)[:k]
        want[q] = [(n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert {q: sorted(v) for q, v in got.items()} == want


def test_audits_measure_where_links_are_rare(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 24))
    x[1] = x[0] + 1e-3  # the only link
    docs = spark.createDataFrame([(i, "a", v.tolist()) for i, v in enumerate(x)], "vec_id long, label string, embedding array<double>")
    audits = vectors.search_audits(docs, shard=1000).collect()
    assert len(audits) == 9 and all(r["queries"] == 64 and r["recall"] >= 0.97 for r in audits)
    # A beam of one finds no ten neighbours: the audit must fail it.
    g = vectors.SmallWorld(vectors._unit(x))
    unit, ids = vectors._unit(x), g.order.astype(np.int64)
    s = unit[:50] @ unit.T
    s[np.arange(50), np.arange(50)] = -2
    nearest = -np.sort(-s, axis=1)[:, 9]
    low, high = (vectors.audited(g, unit[:50], np.arange(50), ids, nearest, beam) for beam in (1, 512))
    assert low < 0.5 and high > 0.97
    got = {r["vec_id"]: r for r in vectors.near_duplicate_vectors(docs, shard=1000).collect()}
    assert sum(r["n_links"] for r in got.values()) == 2 and got[1]["component_id"] == 0
