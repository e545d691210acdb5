"""Embedding whitening: the leading eigenvectors of the covariance by contour integration (FEAST).

Sums and covariances are added up in Spark over all distinct vectors. An eigenvalue interval is projected on by a quadrature of
complex shifted solves around it, Rayleigh-Ritz extracts its eigenpairs, and inertia counts say how many there must be.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._common import discard, written

#: Components at most, eigenvalues of an interval at most, quadrature nodes of a half circle, and steps before a subspace grows.
COMPONENTS, INTERVAL, NODES, STEPS = 16, 8, 8, 12
#: Numbers of a block of covariance rows, partial sums that are added apart first, and numbers of all models together, at most.
BLOCK, APART, MODEL = 1 << 17, 32, 1 << 26
#: Entries beyond this are held at it, so that sums of them stay exact.
MOST = 2.0**62


def positives(a: np.ndarray) -> int:
    """How many eigenvalues of a symmetric matrix are positive: those of D in its factors L D L', by symmetric pivoting of
    blocks of one or two rows."""
    a, n, k, count = a.copy(), len(a), 0, 0
    bound = (1 + np.sqrt(17)) / 8
    while k < n:
        col = np.abs(a[k + 1 :, k])
        below = float(col.max(initial=0))
        two = False
        if max(abs(a[k, k]), below) == 0:
            k += 1
            continue
        if abs(a[k, k]) < bound * below:
            r = k + 1 + int(col.argmax())
            other = np.abs(a[r, k:])
            other[r - k] = 0
            widest = float(other.max())
            if abs(a[k, k]) * widest >= bound * below * below:
                pass
            elif abs(a[r, r]) >= bound * widest:
                a[[k, r]] = a[[r, k]]
                a[:, [k, r]] = a[:, [r, k]]
            else:
                two = True
                a[[k + 1, r]] = a[[r, k + 1]]
                a[:, [k + 1, r]] = a[:, [r, k + 1]]
        if two:
            d, c = a[k : k + 2, k : k + 2], a[k + 2 :, k : k + 2]
            count += int((np.linalg.eigvalsh(d) > 0).sum())
            a[k + 2 :, k + 2 :] -= c @ np.linalg.solve(d, c.T)
            k += 2
        else:
            count += a[k, k] > 0
            c = a[k + 1 :, k]
            a[k + 1 :, k + 1 :] -= np.outer(c, c / a[k, k])
            k += 1
    return int(count)


class Spectrum:
    """Counts of eigenvalues of a covariance above thresholds, remembered."""

    def __init__(self, v: np.ndarray):
        self.v, self.top = v, float(np.abs(v).sum(1).max(initial=0)) * (1 + 1e-9)  # no eigenvalue lies above
        self.counts = {self.top: 0, -self.top * 1e-9: len(v)}

    def above(self, t: float) -> int:
        if t not in self.counts:
            self.counts[t] = positives(self.v - t * np.eye(len(self.v)))
        return self.counts[t]

    def bracket(self, k: int, width: float = 1e-7) -> tuple[float, float]:
        """An interval no wider than ``width`` of the matrix's bound that holds the k-th largest eigenvalue."""
        low = max(t for t, c in self.counts.items() if c >= k)
        high = min(t for t, c in self.counts.items() if c < k)
        while high - low > width * self.top:
            mid = (low + high) / 2
            low, high = (mid, high) if self.above(mid) >= k else (low, mid)
        return low, high

    def gap(self, k: int) -> float | None:
        """A threshold between the k-th and the next eigenvalue; None if they are too close to tell apart."""
        if k >= len(self.v):
            return -self.top * 1e-9
        low, high = self.bracket(k)[0], self.bracket(k + 1)[1]
        return (low + high) / 2 if high < low else None


def contour(v: np.ndarray, low: float, high: float, count: int, top: float) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` eigenpairs of ``v`` in an interval, which lie in it as inertia says; the subspace grows until all are found."""
    d = len(v)
    angle, weight = np.polynomial.legendre.leggauss(NODES)
    turn = np.exp(1j * np.pi / 2 * (1 - angle))  # from the high end over the upper half plane to the low end
    centre, radius = (low + high) / 2, (high - low) / 2
    size = min(d, count + max(4, count // 2))
    while True:
        q = np.random.default_rng(1).standard_normal((d, size))
        for _ in range(STEPS if size < d else 1):
            if size < d:
                # (1 / 2 pi i) times the integral of (zI - V)^-1 Q around the circle; its halves are conjugate.
                q = sum(weight[n] / 2 * radius * (turn[n] * np.linalg.solve((centre + radius * turn[n]) * np.eye(d) - v, q)).real for n in range(NODES))
            q = np.linalg.qr(q)[0]
            values, small = np.linalg.eigh(q.T @ v @ q)
            q = q @ small
            inside = (values > low) & (values <= high)
            if inside.sum() == count:
                x, e = q[:, inside], values[inside]
                if not count or np.abs(v @ x - x * e).max() <= 4e-15 * top * np.sqrt(d) or size == d:
                    return e, x
        if size == d:
            raise ArithmeticError(f"{int(inside.sum())} eigenvalues in an interval that holds {count}")
        size = min(d, 2 * size)


def leading(v: np.ndarray, most: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """Up to ``most`` largest eigenvalues, falling, and unit eigenvectors in columns; those that rounding can't tell from zero are
    left out."""
    d, trace = len(v), float(np.trace(v))
    if not trace > 0:
        return np.zeros(0), np.zeros((d, 0))
    s = Spectrum(v)
    floor = trace * d * 2.0**-51
    rank = s.above(floor)
    most = min(most, rank)
    ends = [s.top]
    for k in range(INTERVAL, most, INTERVAL):
        if (t := s.gap(k)) is not None and t > floor:
            ends.append(t)
    last = floor if most == rank else s.gap(most)
    if last is None:  # equal eigenvalues at the end: all of them are taken, and the first returned
        last = s.bracket(most)[0] - 1e-6 * s.top
        while last > floor and s.gap(s.above(last)) is None:
            last -= 1e-6 * s.top
    ends.append(max(last, floor))
    found = [contour(v, low, high, s.above(low) - s.above(high), s.top) for high, low in zip(ends, ends[1:])]
    # One more Rayleigh-Ritz over all intervals makes them orthogonal to each other.
    q = np.linalg.qr(np.concatenate([x for _, x in found], 1))[0]
    e, small = np.linalg.eigh(q.T @ v @ q)
    by = np.argsort(-e, kind="stable")[:most]
    return e[by], q @ small[:, by]


def _entries(vectors: DataFrame, scale: float, shift: int) -> DataFrame:
    """``vec_id``, ``dim`` and ``x`` = floor(scale * component) + shift of the rows that take part."""
    scaled = F.transform("embedding", lambda v: v.cast("double") * F.lit(scale))
    limit = F.lit(1.7976931348623157e308)
    fine = F.forall("embedding", lambda v: F.coalesce((F.abs(v.cast("double")) <= limit) & ~F.isnan(v.cast("double")), F.lit(False)))
    rows = vectors.where((F.size("embedding") > 0) & fine).select(F.col("vec_id").cast("long").alias("vec_id"), scaled.alias("x"))
    x = F.transform("x", lambda v: F.floor(F.greatest(F.lit(-MOST), F.least(F.lit(MOST), v))).cast("long") + F.lit(shift))
    return rows.select("vec_id", F.size("x").alias("dim"), x.alias("x"))


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Of each batch and length: the rows' places and their entries."""
    for b in batches:
        dims = b.column("dim").to_numpy()
        for d in np.unique(dims):
            at = np.flatnonzero(dims == d)
            yield int(d), at, b.column("x").take(pa.array(at)).flatten().to_numpy().reshape(len(at), int(d))


def _deviations(x: np.ndarray, n: int, s: np.ndarray) -> np.ndarray:
    """n * x - s, exact: longs, or Python's integers where these don't do."""
    most = max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))) * n + max((abs(int(v)) for v in s), default=0)
    return n * x - np.array(s, np.int64) if most < 2**62 else n * x.astype(object) - np.array(s, object)


def _squares(y: np.ndarray) -> list[int | None]:
    """Exact sums of squares of rows; None where a long can't hold one."""
    most = float(np.abs(y).max(initial=0)) ** 2 * y.shape[1]
    if y.dtype != object and most < 2.0**62:
        return np.einsum("nd,nd->n", y, y).tolist()
    return [t if (t := sum(int(v) ** 2 for v in row)) < 2**63 else None for row in y]


def whitened(vectors: DataFrame, components: int = COMPONENTS, scale: float = 64.0, shift: int = 1_000_000) -> DataFrame:
    """Vectors on the leading components of their covariance, scaled to unit variance.

    Returns, for each row and component, ``vec_id``, ``component`` (from 1 by falling eigenvalue), ``n`` (distinct vectors),
    ``deviation`` (sum of (n*x - S)^2, exact; null beyond a long), ``whitened``, ``explained`` (the eigenvalue's share of the
    trace) and ``identity_error`` (of the covariance of all distinct whitened vectors, one value).

    x is floor(scale * entry) + shift, entries beyond 2^62 held there. Rows whose vector is null, of no entries, or holds null or
    non-finite ones are dropped; rows with null or repeated ids stay, each for itself. The covariance is over distinct vectors, divided
    by their number; vectors of each length have their own. Components whose eigenvalue is zero, to rounding, can't be scaled and
    aren't returned, so a table of one distinct vector gives no rows, as does an empty one. Equal eigenvalues
    have some orthonormal basis of their space.
    """
    rows = _entries(vectors, scale, shift)
    fit = written(rows.select("dim", "x").distinct())
    sorted_fit = fit.sortWithinPartitions("dim")  # so that a task holds the sums of one length at a time

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for d, n, total in _by_length(batches, lambda x: np.array([sum(map(int, c)) for c in x.T], object) if float(np.abs(x).max(initial=0)) * len(x) >= 2.0**62 else x.sum(0).astype(object)):
            yield pa.RecordBatch.from_pydict({"dim": pa.array([d] * d, pa.int32()), "j": pa.array(range(d), pa.int32()), "s": pa.array([str(v) for v in total]), "n": pa.array([n] * d, pa.int64())})

    added = sorted_fit.mapInArrow(sums, "dim int, j int, s string, n long").groupBy("dim", "j").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.sum("n").alias("n"))
    added = written(added)
    if (size := added.count()) * (components + 1) > MODEL:
        raise ValueError(f"{size} sums of vectors' entries are too many for a model: is the column one of vectors?")
    means: dict[int, tuple[int, list[int]]] = {}
    for r in added.orderBy("dim", "j").toLocalIterator():
        means.setdefault(r["dim"], (r["n"], []))[1].append(int(r["s"]))

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def centred(x: np.ndarray) -> np.ndarray:
            y = _deviations(x, *means[x.shape[1]]).astype(float) / means[x.shape[1]][0]
            return y.T @ y

        for d, _, total in _by_length(batches, centred):
            step = max(1, BLOCK // max(1, d))
            salt = TaskContext.get().partitionId() % APART
            for at in range(0, d, step):
                yield pa.RecordBatch.from_pydict({"dim": pa.array([d], pa.int32()), "block": pa.array([at // step], pa.int32()), "part": pa.array([salt], pa.int32()), "v": pa.array([total[at : at + step].tobytes()], pa.binary())})

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, None
        for b in batches:
            for d, block, part, v in zip(*(b.column(c).to_pylist() for c in ("dim", "block", "part")), b.column("v")):
                now = np.frombuffer(v.as_buffer())
                if (d, block, part) == last:
                    held = held + now
                    continue
                if last is not None:
                    yield _blob(last, held)
                last, held = (d, block, part), now
        if last is not None:
            yield _blob(last, held)

    kind = "dim int, block int, part int, v binary"
    keys = ["dim", "block", "part"]
    partial = sorted_fit.mapInArrow(products, kind).repartition(*keys).sortWithinPartitions(*keys).mapInArrow(together, kind)
    blocks = partial.withColumn("part", F.lit(0)).repartition(*keys).sortWithinPartitions(*keys).mapInArrow(together, kind)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        # One length's covariance: d * d numbers, however many rows there are.
        d = int(pdf["dim"].iloc[0])
        v = np.concatenate([np.frombuffer(b) for b in pdf.sort_values("block")["v"]]).reshape(d, d) / means[d][0]
        v = (v + v.T) / 2
        e, x = leading(v, components)
        return pd.DataFrame({"dim": [d] * len(e), "component": range(1, len(e) + 1), "e": e, "explained": e / np.trace(v), "x": pd.Series([c.tolist() for c in x.T], dtype=object)})

    models: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
    solved = blocks.groupBy("dim").applyInPandas(solve, "dim int, component int, e double, explained double, x array<double>").toPandas()
    for d, of in solved.sort_values(["dim", "component"]).groupby("dim"):
        models[int(d)] = np.stack(of["x"].tolist()).T, np.sqrt(of["e"].to_numpy()), of["explained"].to_numpy()

    def project(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exact deviations, and whitened vectors."""
        n, s = means[x.shape[1]]
        base, root, _ = models[x.shape[1]]
        y = _deviations(x, n, s)
        return y, (y.astype(float) / n) @ base / root

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def of(x: np.ndarray) -> np.ndarray:
            w = project(x)[1] if x.shape[1] in models else np.zeros((len(x), 0))
            w = np.concatenate([np.ones((len(w), 1)), w], 1)
            return w.T @ w

        for d, n, m in _by_length(batches, of):
            i, j = (x.ravel() for x in np.indices(m.shape))
            yield pa.RecordBatch.from_pydict({"dim": pa.array([d] * len(i), pa.int32()), "i": pa.array(i), "j": pa.array(j), "m": pa.array(m.ravel())})

    error = 0.0
    moment = sorted_fit.mapInArrow(moments, "dim int, i long, j long, m double").groupBy("dim", "i", "j").agg(F.sum("m").alias("m")).toPandas()
    for _, of in moment.sort_values(["dim", "i", "j"]).groupby("dim"):
        m = of["m"].to_numpy().reshape(int(of["i"].max()) + 1, -1)
        m = m / m[0, 0]
        error = max(error, float(np.abs(m[1:, 1:] - np.outer(m[1:, 0], m[0, 1:]) - np.eye(len(m) - 1)).max(initial=0)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in batches for part in (whole.slice(at, 4096) for at in range(0, whole.num_rows, 4096))):
            ids = b.column("vec_id")
            for d, at, x in _matrices([b]):
                if d not in models:
                    continue
                y, w = project(x)
                k, explained = w.shape[1], models[d][2]
                each = np.repeat(np.arange(len(at)), k)
                yield pa.RecordBatch.from_pydict({
                    "vec_id": ids.take(pa.array(at[each])), "component": pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(at))),
                    "n": pa.array(np.full(len(each), means[d][0])), "deviation": pa.array(_squares(y), pa.int64()).take(pa.array(each)),
                    "whitened": pa.array(w.ravel()), "explained": pa.array(np.tile(explained, len(at))), "identity_error": pa.array(np.full(len(each), error)),
                })

    discard(fit, added)
    return rows.mapInArrow(place, "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")


def _by_length(batches: Iterator[pa.RecordBatch], of) -> Iterator[tuple[int, int, np.ndarray]]:
    """Sums of what ``of`` gives for the rows of each length, with their number; rows come sorted by length."""
    last, n, held = None, 0, None
    for d, at, x in _matrices(batches):
        if d != last:
            if last is not None:
                yield last, n, held
            last, n, held = d, 0, None
        now = of(x)
        held, n = now if held is None else held + now, n + len(at)
    if last is not None:
        yield last, n, held


def _blob(key: tuple[int, int, int], v: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({**{c: pa.array([x], pa.int32()) for c, x in zip(("dim", "block", "part"), key)}, "v": pa.array([v.tobytes()], pa.binary())})
