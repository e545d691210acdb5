"""Half-open time ranges: joins, as-of matches and interval algebra.

Range joins are bucketed: a range is listed under each time bin that it touches, so that the join has an equality key
besides its owner, and a pair is kept in the bin where its overlap begins, once. Frames have ``start`` and ``end``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def overlap(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Length of the common part of two half-open ranges; 0 if they only touch."""
    return F.greatest(F.lit(0), F.least(a_end, b_end) - F.greatest(a_start, b_start))


def _binned(frame: DataFrame, start: str, end: str, width: int) -> DataFrame:
    first = F.floor(F.col(start) / width)
    last = F.floor((F.greatest(F.col(end), F.col(start) + 1) - 1) / width)
    return frame.withColumn("_bin", F.explode(F.sequence(first, last)))


def overlap_join(left: DataFrame, right: DataFrame, by: list[str], width: int) -> DataFrame:
    """Pairs of equal ``by`` whose ranges overlap. ``right``'s columns other than ``by`` are prefixed ``r_``.

    Adds ``overlap``, ``clip_start``, ``clip_end`` and ``whole`` (the right range lies inside the left). ``width`` is
    the bins' width: about the length of a usual range.
    """
    r = right.select(*by, *[F.col(c).alias(f"r_{c}") for c in right.columns if c not in by])
    pairs = _binned(left, "start", "end", width).join(_binned(r, "r_start", "r_end", width), [*by, "_bin"])
    pairs = pairs.where("start < r_end and r_start < end").withColumn("clip_start", F.greatest("start", "r_start")).withColumn("clip_end", F.least("end", "r_end"))
    pairs = pairs.where(F.col("_bin") == F.floor(F.col("clip_start") / width)).drop("_bin")
    return pairs.withColumn("overlap", F.col("clip_end") - F.col("clip_start")).withColumn("whole", F.expr("r_start >= start and r_end <= end"))


def points_in(ranges: DataFrame, points: DataFrame, by: list[str], at: str, width: int) -> DataFrame:
    """Points that lie in a range of the same ``by``: ``start`` included, ``end`` not."""
    p = points.withColumn("_bin", F.floor(F.col(at) / width))
    return _binned(ranges, "start", "end", width).join(p, [*by, "_bin"]).where(F.col(at).between(F.col("start"), F.col("end") - 1)).drop("_bin")


def nearest(left: DataFrame, right: DataFrame, by: list[str], left_at: str, right_at: str, value: str, within: int) -> DataFrame:
    """As-of join: for each row of ``left`` the ``value`` of the nearest row of ``right``, the earlier one if two are as
    near and the smallest ``value`` at one time; null beyond ``within``. Two ordered scans of one union, no range join.
    """
    once = right.groupBy(*by, F.col(right_at).alias("_at")).agg(F.min(value).alias(value))
    rows = left.withColumn("_at", F.col(left_at)).withColumn("_left", F.lit(True)).unionByName(once.withColumn("_left", F.lit(False)), allowMissingColumns=True)
    seen = F.when(~F.col("_left"), F.struct(F.col("_at").alias("at"), F.col(value).alias("v")))
    before = F.last(seen, ignorenulls=True).over(Window.partitionBy(*by).orderBy(F.col("_at"), F.col("_left")).rowsBetween(Window.unboundedPreceding, 0))
    after = F.last(seen, ignorenulls=True).over(Window.partitionBy(*by).orderBy(F.col("_at").desc(), F.col("_left")).rowsBetween(Window.unboundedPreceding, 0))
    both = rows.withColumn("_b", before).withColumn("_a", after).where("_left")
    db, da = F.col("_at") - F.col("_b.at"), F.col("_a.at") - F.col("_at")
    earlier = F.col("_b").isNotNull() & (F.col("_a").isNull() | (db <= da))
    far = F.when(earlier, db).otherwise(da)
    match = F.when(earlier, F.col("_b.v")).otherwise(F.col("_a.v"))
    return both.select(*left.columns, F.when(far <= within, match).alias(value), F.when(far <= within, far).alias("distance"))


def islands(frame: DataFrame, by: list[str], gap: int = 0) -> DataFrame:
    """Adds ``island``: ranges of one ``by`` belong together while each starts at most ``gap`` after the furthest end so
    far (touching ranges merge at gap 0)."""
    order = Window.partitionBy(*by).orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = (F.col("start") > F.col("_reach") + gap) | F.col("_reach").isNull()
    return frame.withColumn("_reach", reach).withColumn("island", F.sum(new.cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_reach")


def union(frame: DataFrame, by: list[str], gap: int = 0) -> DataFrame:
    """Ranges of one ``by`` merged where they overlap, touch, or lie within ``gap``: ``start``, ``end``, ``n``."""
    return islands(frame, by, gap).groupBy(*by, "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n")).drop("island")


def covered(frame: DataFrame, by: list[str]) -> DataFrame:
    """Length of time covered by at least one range."""
    return union(frame, by).groupBy(*by).agg(F.sum(F.col("end") - F.col("start")).alias("covered"))


def gaps(frame: DataFrame, by: list[str]) -> DataFrame:
    """Time between merged ranges of one ``by``."""
    merged = union(frame, by)
    after = F.lead("start").over(Window.partitionBy(*by).orderBy("start"))
    return merged.select(*by, F.col("end").alias("start"), after.alias("end")).where("end > start")


def _sweep(pieces: DataFrame, other: DataFrame, by: list[str], want: str) -> DataFrame:
    """Parts of the time axis by how many ranges of both sides cover them: an ordered scan over their ends."""
    ends = []
    for frame, a, b in ((union(pieces, by), 1, 0), (union(other, by), 0, 1)):
        for at, sign in (("start", 1), ("end", -1)):
            ends.append(frame.select(*by, F.col(at).alias("at"), F.lit(sign * a).alias("a"), F.lit(sign * b).alias("b")))
    steps = ends[0].union(ends[1]).union(ends[2]).union(ends[3]).groupBy(*by, "at").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    order = Window.partitionBy(*by).orderBy("at")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    level = steps.select(*by, F.col("at").alias("start"), F.lead("at").over(order).alias("end"), F.sum("a").over(so_far).alias("a"), F.sum("b").over(so_far).alias("b"))
    return union(level.where(want).where("end > start").select(*by, "start", "end"), by).select(*by, "start", "end")


def subtract(pieces: DataFrame, cuts: DataFrame, by: list[str]) -> DataFrame:
    """Time covered by ``pieces`` and by no cut, as merged ranges."""
    return _sweep(pieces, cuts, by, "a > 0 and b = 0")


def intersect(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    """Time covered by both sides, as merged ranges."""
    return _sweep(left, right, by, "a > 0 and b > 0")


def topmost(clips: DataFrame, by: list[str], width: int) -> DataFrame:
    """Flattens overlapping tracks: the axis is cut at every start and end, the clip of the highest ``track`` (then the
    smallest ``id``) takes each part, and neighbours of one clip are joined: ``start``, ``end``, ``id``."""
    ends = clips.select(*by, F.col("start").alias("at")).union(clips.select(*by, "end")).distinct()
    parts = ends.select(*by, F.col("at").alias("start"), F.lead("at").over(Window.partitionBy(*by).orderBy("at")).alias("end")).where("end is not null")
    held = overlap_join(parts, clips.select(*by, "start", "end", "track", "id"), by, width)
    best = held.groupBy(*by, "start", "end").agg(F.min_by("r_id", F.struct(-F.col("r_track"), F.col("r_id"))).alias("id"))
    order = Window.partitionBy(*by).orderBy("start")
    new = (F.lag("id").over(order) != F.col("id")) | (F.lag("end").over(order) != F.col("start")) | F.lag("id").over(order).isNull()
    run = best.withColumn("_new", new.cast("long")).withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return run.groupBy(*by, "_run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.first("id").alias("id")).drop("_run")


def same_moments(events: DataFrame, offsets: DataFrame, width: int, least: float = 0.5) -> DataFrame:
    """Pairs of events (``asset``, ``id``, ``start``, ``end``) on two recordings that ``offsets`` (``asset``, ``reference``,
    ``offset``) line up, which share ``least`` of the shorter one: ``source`` < ``target`` and the largest share. An event
    without length that lies inside another is shared whole."""
    shifted = events.join(offsets, "asset").select(F.col("reference").alias("asset"), "id", (F.col("start") + F.col("offset")).alias("start"), (F.col("end") + F.col("offset")).alias("end"))
    pairs = overlap_join(events.select("asset", "id", "start", "end"), shifted, ["asset"], width).where("id <> r_id")
    shorter = F.least(F.col("end") - F.col("start"), F.col("r_end") - F.col("r_start"))
    out = pairs.withColumn("share", F.when(shorter != 0, F.col("overlap") / shorter).otherwise(1.0)).where(F.col("share") >= least)
    strength = F.floor(F.least(F.lit(1.0), F.col("share")) * 10000 + 0.5) / 10000
    return out.groupBy(F.least("id", "r_id").alias("source"), F.greatest("id", "r_id").alias("target")).agg(F.max(strength).alias("strength"))


def inactive(still: DataFrame, silent: DataFrame, by: list[str], margin: int = 500, least: int = 3000) -> DataFrame:
    """Ranges that are still and silent at once, less a margin at both ends, of ``least`` or more."""
    both = intersect(still, silent, by).select(*by, (F.col("start") + margin).alias("start"), (F.col("end") - margin).alias("end"))
    return both.where(F.col("end") - F.col("start") >= least)
