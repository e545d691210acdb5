"""Numbers as columns: rounding, clamping, decibels, calibrated strengths and distributions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(x: Column, places: int = 4) -> Column:
    """Half-way cases go up, also below zero."""
    scale = float(10**places)
    return F.floor(x * scale + 0.5) / scale


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """``x`` between two bounds; null stays null."""
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def decibels(amplitude: Column) -> Column:
    """20 log10, not below -100."""
    return F.when(amplitude > 0, F.greatest(F.lit(-100.0), 20 * F.log10(amplitude))).otherwise(-100.0)


def gain(db: Column) -> Column:
    return F.pow(F.lit(10.0), db / 20)


def strength(score: Column, centre: Column, spread: Column, undiscriminating: Column | bool = False) -> Column:
    """Calibrated similarity: robust deviations above the centre, four of them count as 1."""
    z = (score - centre) / spread
    off = F.lit(undiscriminating) if isinstance(undiscriminating, bool) else undiscriminating
    return F.when(off | (z <= 0), F.lit(0.0)).otherwise(F.least(F.lit(1.0), z / 4))


def rank_at(n: Column, q: float) -> Column:
    """Place of a quantile among ``n`` sorted values, from 1, without interpolation."""
    return F.floor((n - 1) * q + 0.5).cast("int") + 1


def nearest_rank(values: Column, q: float) -> Column:
    """Element of a sorted array at the rounded index of a quantile; -100 if there is none."""
    return F.when(F.size(values) > 0, F.element_at(values, rank_at(F.size(values), q))).otherwise(F.lit(-100.0))


def silence_threshold(p10: Column, p90: Column, configured: float = -45.0) -> Column:
    """Level under which a recording is silent; a narrow range leaves only what lies under its floor."""
    spread = p90 - p10
    return F.when(spread < 10, F.least(F.lit(configured), p10 - 1)).otherwise(p10 + F.least(F.lit(8.0), 0.3 * spread))


def speech_probability(db: Column, crossings: Column, threshold: Column) -> Column:
    """How likely a hop is speech, by its level and its zero-crossing rate."""
    band = F.when(crossings < 0.01, 0.3).when(crossings > 0.3, 0.4).otherwise(1.0)
    return F.when(db <= threshold, F.lit(0.0)).otherwise(rounded(clamp((db - threshold) / 18) * band, 3))


def distribution(weights: Column) -> Column:
    """Map of weights as shares: not negative, summing to 1; equal if all are 0."""
    positive = F.transform_values(weights, lambda _, v: F.greatest(F.lit(0.0), v))
    total = F.aggregate(F.map_values(positive), F.lit(0.0), lambda a, v: a + v)
    return F.transform_values(positive, lambda _, v: F.when(total > 0, v / total).otherwise(1.0 / F.size(weights)))


def pruned(shares: Column, least: float = 0.02) -> Column:
    """Shares below ``least`` go, the rest sum to 1 again."""
    return distribution(F.map_filter(shares, lambda _, v: v >= least))


def best_key(shares: Column) -> Column:
    """Key of the largest value; the first by name among equals."""
    entries = F.transform(F.map_entries(shares), lambda e: F.struct((-e["value"]).alias("v"), e["key"].alias("k")))
    return F.array_min(entries)["k"]


def dot(a: Column, b: Column) -> Column:
    """Inner product of arrays in double precision; null if their lengths differ."""
    total = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda t, v: t + v)
    return F.when(F.size(a) == F.size(b), total)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda t, v: t + v.cast("double") * v.cast("double")))


def unit(a: Column) -> Column:
    """Array at length 1; a zero array stays as it is."""
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda v: v.cast("double") / n)).otherwise(F.transform(a, lambda v: v.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; 0 where one has no length."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(F.lit(0.0))


def evenly(values: Column, k: int) -> Column:
    """``k`` elements of an array spread evenly from its first to its last, without repeats."""
    n = F.size(values)
    at = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.floor(i * (n - 1) / (k - 1) + 0.5).cast("int") + 1)
    return F.when(n <= k, values).otherwise(F.transform(F.array_distinct(at), lambda i: F.element_at(values, i)))
