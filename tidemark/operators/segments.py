"""Segmentation of an asset's time: boundaries thinned, atoms of bounded length, and greedy merging of weak boundaries.

The thinning and the merge depend on what was kept before, so they run as an ordered pass per asset: the thinning as a scan of
sorted rows, the merge in memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators.selection import per_plan


def first_matching(text: Column, ladder: list[tuple[str, str]]) -> Column:
    """Name of the first pattern that text matches; null if none does."""
    out: Column | None = None
    for pattern, name in ladder:
        test = text.rlike(pattern)
        out = F.when(test, name) if out is None else out.when(test, name)
    return F.lit(None).cast("string") if out is None else out


def kept_apart(points: DataFrame, by: list[str], at: str, least: int, since: str | None = None) -> DataFrame:
    """Points of which each is ``least`` or more behind the last one kept, in order; ``since`` (a column) stands before the first.

    Rows are sorted by Spark and scanned; the scan holds one instant, however many points a group has. Of equal points one stays.
    """
    names = points.columns

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, last = None, None
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in by)))
            times = batch.column(at).to_pylist()
            starts = batch.column(since).to_pylist() if since else [None] * len(times)
            keep = []
            for i, (k, t, s) in enumerate(zip(keys, times, starts)):
                if k != group:
                    group, last = k, s
                if last is None or t - last >= least:
                    keep.append(i)
                    last = t
            yield batch.take(pa.array(keep, pa.int64()))

    schema = ", ".join(f"`{c}` {t}" for c, t in points.dtypes)
    return points.repartition(*by).sortWithinPartitions(*by, at).select(*names).mapInArrow(scan, schema)


def thinned(frame: DataFrame, by: list[str], at: str, least: int) -> DataFrame:
    """Spans between boundaries, of which those closer than ``least`` to the last one kept are dropped. Rows ``start``,
    ``end`` (null for the last span)."""
    kept = kept_apart(frame.where(F.col(at).isNotNull()).select(*by, at).distinct(), by, at, least)
    return kept.select(*by, F.col(at).alias("start"), F.lead(at).over(Window.partitionBy(*by).orderBy(at)).alias("end"))


def windows(frame: DataFrame, length: int, least: int = 200) -> DataFrame:
    """Ranges cut into parts of ``length``; a last part shorter than ``least`` is left out. Adds ``part``."""
    size = F.col("end") - F.col("start")
    n = F.floor(size / length) + F.when(size % length >= F.greatest(F.lit(1), F.lit(least)), 1).otherwise(0)
    cut = frame.withColumn("_n", n).where("_n > 0").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)))
    begin = F.col("start") + F.col("part") * length
    return cut.withColumn("_end", F.least("end", begin + length)).withColumn("start", begin).withColumn("end", F.col("_end")).drop("_n", "_end")


def atoms(frame: DataFrame, length: int, least: int) -> DataFrame:
    """Ranges cut into parts of ``length``; a last part shorter than ``least`` joins the one before. Adds ``part``."""
    size = F.col("end") - F.col("start")
    parts = F.greatest(F.lit(1), F.floor(size / length) + F.when(size % length >= least, 1).otherwise(0))
    cut = frame.withColumn("_n", parts).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)))
    begin = F.col("start") + F.col("part") * length
    end = F.when(F.col("part") == F.col("_n") - 1, F.col("end")).otherwise(begin + length)
    return cut.withColumn("_end", end).withColumn("start", begin).withColumn("end", F.col("_end")).drop("_n", "_end")


def merged(frame: DataFrame, by: str, least: int, most: int, threshold: float) -> DataFrame:
    """Atoms (``start``, ``end``, ``separation`` from the atom before) merged over weak boundaries.

    First, left to right, atoms shorter than ``least`` join the neighbour behind the weaker boundary; then the weakest
    boundary below ``threshold`` goes, again and again; no merge may exceed ``most`` or a separation of 1.
    """

    def merge(run: list[dict]) -> list[dict]:
        fits = lambda a, b: max(a[1], b[1]) - a[0] <= most and b[2] < 1
        done: list[list] = []
        rest = [[int(r["start"]), int(r["end"]), float(r["separation"])] for r in reversed(run)]
        while rest:
            now = rest.pop()
            while now[1] - now[0] < least:
                left, right = bool(done) and fits(done[-1], now), bool(rest) and fits(now, rest[-1])
                if left and (not right or now[2] <= rest[-1][2]):
                    now = [done[-1][0], max(done[-1][1], now[1]), done.pop()[2]]
                elif right:
                    now[1] = max(now[1], rest.pop()[1])
                else:
                    break
            done.append(now)
        # Boundaries never change, and what is too long once stays so: the weakest first, each is looked at once.
        into = list(range(len(done)))

        def first(i: int) -> int:
            while into[i] != i:
                into[i] = i = into[into[i]]
            return i

        for _, i in sorted((x[2], i) for i, x in enumerate(done) if i and x[2] < threshold):
            a = first(i - 1)
            if fits(done[a], done[i]):
                done[a][1] = max(done[a][1], done[i][1])
                into[i] = a
        return [{by: run[0][by], "start": s, "end": e} for i, (s, e, _) in enumerate(done) if into[i] == i]

    rows = frame.select(by, "start", "end", "separation")
    return per_plan(rows, by, ["start", "end", "separation"], merge, f"{by} {dict(frame.dtypes)[by]}, start long, end long")


def separation(forced: Column, speech_spans: Column, terms: dict[str, tuple[Column, float]]) -> Column:
    """How strongly two neighbours stay apart, 0 to 1: a forced split or merge decides, then speech across the boundary,
    else the weighted mean of the signals (name: value, weight) that are not null; 0.5 with none."""
    total = sum((F.when(v.isNotNull(), w).otherwise(0.0) for v, w in terms.values()), F.lit(0.0))
    value = sum((F.coalesce(v * w, F.lit(0.0)) for v, w in terms.values()), F.lit(0.0))
    mean = F.when(total == 0, 0.5).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), value / total)))
    return F.when(forced == "split", 1.0).when(forced == "merge", 0.0).when(speech_spans, 0.05).otherwise(mean)


#: Weights of the signals of a boundary. Fixed values.
SIGNALS = {"visual": 0.4, "silence": 0.25, "shot_change": 0.15, "topic": 0.2, "speaker_change": 0.15}
