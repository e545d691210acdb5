"""Envelopes sampled at equal hops: changes, loudness events, voice activity, labels by deviation and offsets between
recordings. Frames have one row per hop: an asset, ``hop`` (from 0) and a value."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.numbers import rank_at, silence_threshold


def onsets(frame: DataFrame, by: list[str], value: str, floor: float = -70.0) -> DataFrame:
    """Adds ``onset``: how much a hop is louder than the one before, both not below ``floor``; 0 at the first."""
    held = F.greatest(F.lit(floor), F.col(value))
    before = F.lag(held).over(Window.partitionBy(*by).orderBy("hop"))
    return frame.withColumn("onset", F.coalesce(F.greatest(F.lit(0.0), held - before), F.lit(0.0)))


def crossings(frame: DataFrame, by: list[str], value: str, hop: int) -> DataFrame:
    """Level and zero crossings of samples (``hop`` is the sample's number) in blocks of ``hop``: ``rms`` and ``zcr``."""
    before = F.lag(value).over(Window.partitionBy(*by).orderBy("hop"))
    crossed = F.coalesce(((F.col(value) >= 0) != (before >= 0)).cast("int"), F.lit(0))
    s = frame.withColumn("_x", crossed).withColumn("block", F.floor(F.col("hop") / hop))
    return s.groupBy(*by, "block").agg(F.sqrt(F.avg(F.col(value) * F.col(value))).alias("rms"), F.avg("_x").alias("zcr"))


def change_ahead(frame: DataFrame, by: list[str], value: str, hops: int) -> DataFrame:
    """Adds ``ahead``: the largest value from a hop on, over ``hops`` hops."""
    w = Window.partitionBy(*by).orderBy("hop").rowsBetween(0, hops - 1)
    return frame.withColumn("ahead", F.max(value).over(w))


def levels(frame: DataFrame, by: list[str], value: str) -> DataFrame:
    """Per asset the 10th and 90th percentile (nearest rank) and the threshold under which it is silent."""
    order = Window.partitionBy(*by).orderBy(F.col(value).asc_nulls_last())
    v = frame.select(*by, value).withColumns({"_i": F.row_number().over(order), "_n": F.count(value).over(Window.partitionBy(*by))})
    at = lambda q: F.coalesce(F.max(F.when((F.col("_n") > 0) & (F.col("_i") == rank_at(F.col("_n"), q)), F.col(value))), F.lit(-100.0))
    both = v.groupBy(*by).agg(at(0.1).alias("p10"), at(0.9).alias("p90"))
    return both.withColumn("threshold", silence_threshold(F.col("p10"), F.col("p90")))


def quiet_runs(frame: DataFrame, by: list[str], value: str, least: int) -> DataFrame:
    """Runs of ``least`` hops or more under the asset's threshold: ``first``, ``last`` (hops), ``n``."""
    flagged = frame.join(levels(frame, by, value).select(*by, "threshold"), by).where(F.col(value) < F.col("threshold"))
    island = F.col("hop") - F.row_number().over(Window.partitionBy(*by).orderBy("hop"))
    runs = flagged.withColumn("_i", island).groupBy(*by, "_i").agg(F.min("hop").alias("first"), F.max("hop").alias("last"), F.count("*").alias("n"))
    return runs.where(F.col("n") >= least).drop("_i")


def active_stretches(frame: DataFrame, by: list[str], value: str, level: Column, pause: int, pad: int) -> DataFrame:
    """Stretches of hops at ``level`` or louder, which a pause longer than ``pause`` hops ends, with ``pad`` hops around."""
    loud = frame.where(F.col(value) >= level)
    w = Window.partitionBy(*by).orderBy("hop")
    new = F.coalesce(F.col("hop") - F.lag("hop").over(w) > pause, F.lit(True)).cast("long")
    part = loud.withColumn("_new", new).withColumn("_part", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = part.groupBy(*by, "_part").agg(F.min("hop").alias("first"), F.max("hop").alias("last"))
    return out.select(*by, F.greatest(F.lit(0), F.col("first") - pad).alias("first"), (F.col("last") + pad).alias("last"))


def labels_by_deviation(scores: Column, names: list[str], least: float = 1.8, most: int = 8) -> Column:
    """Names whose score lies ``least`` deviations above the mean of the row, best first, ``most`` at most."""
    n = F.size(scores)
    total = lambda f: F.aggregate(scores, F.lit(0.0), lambda a, x: a + f(x.cast("double")))

    def chosen(mean: Column, spread: Column) -> Column:
        named = F.zip_with(F.array(*map(F.lit, names)), scores, lambda k, x: F.struct((-(x.cast("double") - mean) / spread).alias("z"), k.alias("k")))
        best = F.slice(F.array_sort(F.filter(named, lambda s: s["z"] <= -least)), 1, most)
        return F.when(spread > 0, F.transform(best, lambda s: s["k"])).otherwise(F.array().cast("array<string>"))

    def with_mean(mean: Column) -> Column:
        return _let(F.sqrt(total(lambda x: (x - mean) * (x - mean)) / n), lambda spread: chosen(mean, spread))

    return _let(total(lambda x: x) / n, with_mean)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` worked out once, also where it is used for each element of an array."""
    return F.element_at(F.transform(F.array(value), use), 1)


def offsets(pairs: DataFrame, a: str, b: str, apart: int) -> DataFrame:
    """Offset between two envelopes (arrays ``a`` and ``b``): adds ``offset`` (hops by which ``b`` starts after ``a``), to a
    part of a hop, and ``ratio`` of its correlation to the best at least ``apart`` hops away. Null where an envelope is
    constant or shorter than two hops."""

    def measure(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            found = [_offset(np.asarray(x, float), np.asarray(y, float), apart) for x, y in zip(f[a], f[b])]
            yield f.drop(columns=[a, b]).assign(offset=[x[0] for x in found], ratio=[x[1] for x in found])

    rest = [c for c in pairs.columns if c not in (a, b)]
    schema = ", ".join(f"`{c}` {t}" for c, t in pairs.select(*rest).dtypes)
    return pairs.select(*rest, a, b).mapInPandas(measure, f"{schema}, offset double, ratio double")


def _offset(x: np.ndarray, y: np.ndarray, apart: int) -> tuple[float | None, float | None]:
    if min(len(x), len(y)) < 2 or x.std() == 0 or y.std() == 0:
        return None, None
    x, y = ((v - v.mean()) / np.linalg.norm(v - v.mean()) for v in (x, y))
    n = len(x) + len(y) - 1
    size = 1 << (n - 1).bit_length()
    c = np.fft.irfft(np.fft.rfft(x, size) * np.conj(np.fft.rfft(y, size)), size)
    c = np.concatenate([c[size - len(y) + 1 :], c[: len(x)]])  # lags from -(len(y) - 1) on
    k = int(c.argmax())
    lag = float(k - len(y) + 1)
    if 0 < k < n - 1 and (bend := c[k - 1] - 2 * c[k] + c[k + 1]) < 0:
        lag += 0.5 * (c[k - 1] - c[k + 1]) / bend
    far = np.abs(np.arange(n) - k) >= apart
    rival = float(c[far].max(initial=0.0))
    return round(lag, 4), round(float(c[k]) / rival, 4) if rival > 0 else None
