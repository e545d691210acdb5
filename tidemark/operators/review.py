"""Chapters, plan reviews, companions of recordings, annotations and roles of on-screen text."""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators.intervals import overlap_join
from tidemark.operators.selection import per_plan


def chapter_breaks(events: DataFrame, by: list[str], gap: int) -> DataFrame:
    """Adds ``chapter``, from 1: a new one begins at a title card, after a gap of ``gap`` or more, or where the places of two
    neighbours are known and differ. Events have ``start``, ``end``, ``id``, ``place`` and ``card``."""
    w = Window.partitionBy(*by).orderBy("start", "id")
    moved = F.coalesce(F.lag("place").over(w) != F.col("place"), F.lit(False))
    new = F.lag("id").over(w).isNull() | F.coalesce(F.col("card"), F.lit(False)) | F.coalesce(F.col("start") - F.lag("end").over(w) >= gap, F.lit(False)) | moved
    return events.withColumn("_new", new.cast("long")).withColumn("chapter", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def chapters_folded(events: DataFrame, by: list[str], least: int = 2) -> DataFrame:
    """Chapters of fewer than ``least`` events join the one before, unless a title card begins them; the first stays."""
    size = Window.partitionBy(*by, "chapter")
    small = (F.count("*").over(size) < least) & ~F.max(F.coalesce(F.col("card"), F.lit(False))).over(size)
    marked = events.withColumn("_keep", ~small | (F.col("chapter") == 1)).withColumn("_kept", F.when(F.col("_keep"), F.col("chapter")))
    into = F.last("_kept", ignorenulls=True).over(Window.partitionBy(*by).orderBy("chapter", "start", "id").rowsBetween(Window.unboundedPreceding, 0))
    number = F.dense_rank().over(Window.partitionBy(*by).orderBy("_into"))
    return marked.withColumn("_into", into).withColumn("chapter", number.cast("long")).drop("_keep", "_kept", "_into")


def chapters_limited(events: DataFrame, by: str, most: int = 12) -> DataFrame:
    """Chapters joined at their weakest boundary until an owner has ``most``: ``chapter`` is numbered anew.

    Weakest is the shortest time between the last event before and the first after; of equal ones that with the fewest events on both sides,
    then the first. A chapter that a title card begins is joined to the one before only when no other boundary is left. One row for
    each chapter comes to the pass over an owner, none for its events.
    """
    first, last = F.struct("start", "id"), F.struct("start", "id")
    groups = events.groupBy(by, "chapter").agg(F.count("*").alias("n"), F.min("start").alias("start"), F.max_by("end", last).alias("end"), F.min_by(F.coalesce(F.col("card"), F.lit(False)), first).alias("card"))

    def join(run: list[dict]) -> list[dict]:
        n = [r["n"] for r in run]
        before, after, version = list(range(-1, len(run) - 1)), list(range(1, len(run) + 1)), [0] * len(run)
        gap = [0] + [max(0, b["start"] - a["end"]) for a, b in zip(run, run[1:])]
        entry = lambda i: (run[i]["card"], gap[i], n[before[i]] + n[i], i, version[i])
        queue = [entry(i) for i in range(1, len(run))]
        heapq.heapify(queue)
        into = list(range(len(run)))
        left = len(run)
        while left > most:
            *_, i, v = heapq.heappop(queue)
            if into[i] != i or v != version[i]:
                continue
            # The chapter before takes this one; boundaries on both its sides weigh other numbers of events now.
            b, a = before[i], after[i]
            into[i], n[b], after[b], left = b, n[b] + n[i], a, left - 1
            if a < len(run):
                before[a] = b
                version[a] += 1
                heapq.heappush(queue, entry(a))
            if b > 0:
                version[b] += 1
                heapq.heappush(queue, entry(b))
        out, number = [], 0
        for i, r in enumerate(run):
            number += into[i] == i
            out.append({by: r[by], "chapter": r["chapter"], "_number": number})
        return out

    kind = dict(events.dtypes)[by]
    numbers = per_plan(groups, by, ["chapter"], join, f"{by} {kind}, chapter long, _number long")
    return events.join(numbers, [by, "chapter"]).drop("chapter").withColumnRenamed("_number", "chapter")


def reviewed(clips: DataFrame, by: list[str], least: int = 900, most: int = 25000) -> DataFrame:
    """Observations on a cut, one row each: ``too_short``, ``too_long``, ``abrupt_location_change``, ``repetition``. Clips
    have ``position``, ``id``, ``ms``, ``place`` and ``event``."""
    w = Window.partitionBy(*by).orderBy("position")
    seen = F.row_number().over(Window.partitionBy(*by, "event").orderBy("position"))
    c = clips.withColumn("_p", F.lag("place").over(w)).withColumn("_s", seen)
    tests = {
        "too_short": F.col("ms") < least,
        "too_long": F.col("ms") > most,
        "abrupt_location_change": F.coalesce(F.col("_p") != F.col("place"), F.lit(False)),
        "repetition": F.col("event").isNotNull() & (F.col("_s") > 1),
    }
    found = F.array_compact(F.array(*[F.when(t, F.lit(k)) for k, t in tests.items()]))
    return c.select(*by, "id", F.explode(found).alias("code"))


def companions(scores: DataFrame) -> DataFrame:
    """Best recorder of each video: declared ones first, then the higher ``score``, then the smaller ``recorder``."""
    order = Window.partitionBy("video").orderBy(F.col("declared").desc(), F.col("score").desc(), "recorder")
    return scores.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def annotated(events: DataFrame, notes: DataFrame, by: list[str], width: int) -> DataFrame:
    """Notes (ranges) on the events that they cover: the overlap is half of the shorter range or more."""
    pairs = overlap_join(events, notes, by, width)
    shorter = F.least(F.col("end") - F.col("start"), F.col("r_end") - F.col("r_start"))
    return pairs.where(2 * F.col("overlap") >= shorter)


def text_roles(reads: DataFrame, by: list[str], least: int = 3) -> DataFrame:
    """Adds ``text_role``: ``junk`` for reads under two characters, ``subtitle`` for sentence-like text low in the picture
    of an asset that has such text at ``least`` moments or more, else ``scene``. Reads have ``start``, ``text``, ``centre``."""
    low = (F.size(F.split(F.trim("text"), r"\s+")) >= 3) & (F.col("centre") >= 0.75)
    # Moments are counted apart, so that no row carries those of its asset.
    moments = reads.where(low).select(*by, "start").distinct().groupBy(*by).agg(F.count("start").alias("_moments"))
    role = F.when(F.length(F.trim("text")) < 2, "junk").when(low & (F.col("_moments") >= least), "subtitle").otherwise("scene")
    return reads.join(moments, by, "left").withColumn("text_role", role).drop("_moments")


def tier(decisive: Column, failed: Column) -> Column:
    """How complete an analysis is: ``standard`` if nothing decisive is missing, ``degraded`` if all that is missing failed."""
    missing = F.count_if(decisive)
    return F.when(missing == 0, "standard").when(F.bool_and(F.when(decisive, failed)), "degraded").otherwise("offline_minimal")
