"""Whitening against a dense eigensolver, and graph search against brute force."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm.ann import RobustGraph, _asked, _scale, nearest_neighbours, neighbour_audits
from tidemark.llm.whitening import leading, positives, whitened

SCHEMA = "vec_id long, embedding array<float>, label int"


def fine(v):
    return v is not None and None not in v and np.isfinite(np.array(v, float)).all()


def table(n=600, d=24, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)) * np.exp(-np.arange(d) / 9) + rng.normal(size=d) / 2
    rows = [(i, [float(np.float32(v)) for v in r], int(i % 3)) for i, r in enumerate(x)]
    rows += [(n, None, 0), (n + 20, [float("nan")] + [1.0] * (d - 1), 0), (n + 40, [1.0] * (d - 1) + [None], 1), (n + 60, [float("inf")] * d, 1), (n + 80, [], 0)]
    rows += [(n + 100 + i, rows[7][1], None) for i in range(60)]  # copies
    return rows + [(n + 300, [0.0] * d, 0), (None, rows[9][1], 0)]


def test_inertia():
    rng = np.random.default_rng(0)
    for n in range(120):
        d = int(rng.integers(1, 30))
        a = rng.normal(size=(d, d))
        a = a + a.T
        if n % 3 == 0:
            a[np.abs(a) < 1] = 0
        t = rng.normal()
        assert positives(a - t * np.eye(d)) == (np.linalg.eigvalsh(a) > t).sum()


@pytest.mark.parametrize("values", [[4.0], np.exp(-np.arange(40) / 3), [3.0] * 30, [5.0] * 10 + [3.0] * 12 + [1.0] * 10, [2.0, 1.0] + [0.0] * 9, np.linspace(1, 1.0001, 50), 1e-9 ** (np.arange(30) / 30)])
def test_leading_components(values):
    values = np.array(values)
    d = len(values)
    q = np.linalg.qr(np.random.default_rng(2).normal(size=(d, d)))[0]
    v = q @ np.diag(values) @ q.T
    v = (v + v.T) / 2
    e, x = leading(v)
    want = np.sort(values[values > 0])[::-1][:16]
    assert len(e) == len(want) and np.abs(e - want).max() <= 1e-13 * want[0]
    assert np.abs(v @ x - x * e).max() <= 1e-12 * want[0] and np.abs(x.T @ x - np.eye(len(e))).max() <= 1e-12


def test_whitened(spark):
    rows = table()
    frame = spark.createDataFrame(rows, SCHEMA).withColumn("whitened", F.lit("clash")).repartition(5)
    got = whitened(frame).toPandas()
    good = [(i, np.floor(np.array(v, float) * 64).astype(int) + 1_000_000) for i, v, _ in rows if fine(v) and v]
    fit = np.unique(np.stack([x for _, x in good]), axis=0)
    n, s = len(fit), fit.sum(0)
    c = (fit * n - s).astype(float) / n
    v = c.T @ c / n
    e, base = np.linalg.eigh(v)
    e, base = e[::-1][:16], base[:, ::-1][:, :16]
    assert len(got) == 16 * len(good) and set(got["n"]) == {n}
    assert got["identity_error"].nunique() == 1 and got["identity_error"].iloc[0] < 1e-9
    assert np.allclose(got.groupby("component")["explained"].first(), e / np.trace(v), rtol=1e-12)
    first = got[got["vec_id"] == 3].sort_values("component")["whitened"].to_numpy()
    sign = np.sign(first * (((np.array(dict(good)[3]) * n - s) / n) @ base))
    for i, x in good[:50] + good[-60:]:
        mine = got[got["vec_id"] == i].sort_values("component") if i is not None else got[got["vec_id"].isna()].sort_values("component")
        assert set(mine["deviation"]) == {int(((n * x - s) ** 2).sum())}
        assert np.allclose(mine["whitened"], ((n * x - s) / n) @ base * sign / np.sqrt(e), atol=1e-8)


def test_whitened_edges(spark):
    assert whitened(spark.createDataFrame([], SCHEMA)).count() == 0
    one = [(i, [1.0, 2.0], 0) for i in range(5)]
    assert whitened(spark.createDataFrame(one, SCHEMA)).count() == 0  # no variance
    # Few components, other lengths, and entries too large for a long.
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=2).tolist(), 0) for i in range(30)] + [(100 + i, rng.normal(size=5).tolist(), 0) for i in range(40)] + [(200 + i, [1e300 * (i % 2), float(i)], 0) for i in range(4)]
    got = whitened(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).toPandas()
    assert got[got["vec_id"] == 5]["component"].tolist() == [1] or len(got[got["vec_id"] == 5]) == 2
    assert len(got[got["vec_id"] == 105]) == 5 and got[got["vec_id"] == 201]["deviation"].isna().all() and got["identity_error"].max() < 1e-4


def brute(rows, k):
    x = {i: np.array(v, float) for i, v, _ in rows if i is not None and fine(v) and np.any(v)}
    out = {}
    for q in (i for i in x if i % 20 == 0):
        s = sorted((-float(x[q] @ x[i]), i) for i in x if i != q and len(x[i]) == len(x[q]))[:k]
        out[q] = [i for _, i in s], [-v for v, _ in s]
    return out


@pytest.mark.parametrize(("k", "n"), [(20, 600), (1000, 100)])
def test_neighbours(spark, k, n):
    rows = table(n) + [(5000, [1.0, 2.0], 0), (5001, [2.0, 1.0], 0)]
    frame = spark.createDataFrame(rows, SCHEMA).withColumn("score", F.lit("clash")).repartition(5)
    got = {}
    for r in nearest_neighbours(frame, k, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    want = brute(rows, k)
    assert got.keys() == want.keys()
    hit = 0
    for q, found in got.items():
        assert [r for r, _, _ in found] == list(range(1, len(want[q][0]) + 1))
        assert sorted(found, key=lambda f: (-f[2], f[1])) == found and len({i for _, i, _ in found}) == len(found)
        x = {i: np.array(v, float) for i, v, _ in rows if i is not None and v is not None and None not in v}
        assert all(abs(s - x[q] @ x[i]) < 1e-9 for _, i, s in found)
        hit += len({i for _, i, _ in found} & set(want[q][0])) / len(found)
    assert hit / len(got) >= 0.95


@pytest.mark.parametrize("spread", [0.0, 0.3, 1.0])
def test_beams_widen_until_recall(spread):
    """Where norms differ, the largest inner products aren't the nearest directions, and beams have to widen."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 12)) * rng.lognormal(0, spread, size=(3000, 1))
    g = RobustGraph(_scale(x)[0])
    assert (g.links[0] != np.arange(len(x))[:, None]).all() and (g.links[0] >= 0).any(1).all()
    q = rng.normal(size=(400, 12))
    found, score, measured, _ = _asked(q, x, g.links[0], g.order, 9, 0.97, 48)
    true = np.argsort(-(q @ x.T), axis=1)[:, :10]
    assert measured >= 0.97 and np.mean([len(set(a) & set(b)) / 10 for a, b in zip(found, true)]) > 0.93
    assert np.allclose(np.einsum("nkd,nd->nk", x[found], q), score)


def test_neighbour_edges(spark):
    query = F.col("vec_id") % 20 == 0
    assert nearest_neighbours(spark.createDataFrame([], SCHEMA), 5, query).count() == 0
    alone = spark.createDataFrame([(0, [1.0, 2.0], 0), (3, [0.0, 0.0], 0)], SCHEMA)
    assert nearest_neighbours(alone, 5, query).count() == 0
    same = spark.createDataFrame([(i, [1.0, 2.0], 0) for i in range(100)], SCHEMA)
    assert [r["vec_id"] for r in nearest_neighbours(same, 5, query).where("query_id = 0").orderBy("rank").collect()] == [1, 2, 3, 4, 5]
    audits = neighbour_audits(spark.createDataFrame(table(), SCHEMA), 5, query).collect()
    assert audits and all(r["recall"] >= 0.97 for r in audits)
