"""Where clips start and stop inside an event: trims that keep to quiet moments, picture cuts and whole words, and pauses taken out.

Evidence is joined to each clip once, by time; everything after that is column expressions over the clip's own short arrays, so
that the rounds in which a clip's window and its pauses settle need no further shuffle and no Python.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.components import checkpoint_folder
from tidemark.operators.intervals import overlap_join, union

#: Time kept after the last words where a reaction is wanted, the least remnant of a neighbouring shot, and the settling of a
#: camera: a share of the event, at most so long. Fixed values.
REACTION_MS, FLASH_MS, SETTLE_SHARE, SETTLE_MS = 1200, 400, 0.15, 1200
#: Rounds in which a window grows by the pauses that are taken out of it, at most.
ROUNDS = 4
#: Kinds of evidence, each a frame of ranges (``cuts``: instants as ranges of 1 ms).
EVIDENCE = ("speech", "words", "silences", "cuts", "music")

_RANGES = "array<struct<start:bigint,end:bigint>>"


@dataclass(frozen=True)
class Handling:
    """What a style asks for, in ms."""

    pad_in: int = 200
    pad_out: int = 300
    window: int = 500
    least_pause: int = 700
    handle: int = 120


def with_evidence(clips: DataFrame, evidence: dict[str, DataFrame], by: list[str], width: int, window: int) -> DataFrame:
    """Adds an array of ranges for each kind of evidence that touches a clip's range or lies within ``window`` of it.

    ``clips``: ``by``, ``id``, ``start``, ``end`` and what else they have; evidence: ``by``, ``start``, ``end``. Overlapping or
    touching words, silences and stretches of music are merged. A clip without evidence has empty arrays. One interval join takes
    all kinds, binned by ``width``, and one aggregation by clip: an array is no longer than its clip's time has room for.
    """
    frames = []
    for kind, frame in evidence.items():
        if kind in ("words", "silences", "music"):
            frame = union(frame, by)
        frames.append(frame.select(*by, F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.lit(kind).alias("kind")))
    every = frames[0]
    for frame in frames[1:]:
        every = every.unionByName(frame)
    near = clips.select(*by, "id", (F.col("start") - window - 1).alias("start"), (F.col("end") + window + 1).alias("end"))
    pairs = overlap_join(near, every, by, width)
    each = [F.array_sort(F.collect_set(F.when(F.col("r_kind") == k, F.struct(F.col("r_start").alias("start"), F.col("r_end").alias("end"))))).alias(k) for k in EVIDENCE]
    held = pairs.groupBy(*by, "id").agg(*each)
    return clips.join(held, [*by, "id"], "left").withColumns({k: F.coalesce(F.col(k), F.array().cast(_RANGES)) for k in EVIDENCE})


def _nearest(options: Column, at: Column, window: int) -> Column:
    """Of structs (``start``, ``v``) in order, the ``v`` nearest to ``at`` and no further than ``window``, the first if two are as
    near; null if there is none."""
    near = F.filter(F.transform(options, lambda o: F.struct(F.abs(o["v"] - at).alias("d"), o["start"].alias("start"), o["v"].alias("v"))), lambda o: o["d"] <= window)
    return F.array_min(near)["v"]


def _head(start: Column, end: Column, cuts: Column) -> Column:
    """The shot that a clip opens on, up to the first cut within it; null without one."""
    return F.array_min(F.filter(cuts, lambda c: (c > start) & (c < end))) - start


def _tail(start: Column, end: Column, cuts: Column) -> Column:
    return end - F.array_max(F.filter(cuts, lambda c: (c > start) & (c < end)))


def trimmed(clips: DataFrame, handling: Handling, desired: Column, least: Column, most: Column, into: str = "") -> DataFrame:
    """Adds ``in_ms``, ``out_ms`` and ``reason`` (each after ``into``) for clips of ``desired`` ms between ``least`` and ``most``.

    ``clips`` come from ``with_evidence`` and have ``start``, ``end`` and the booleans ``settle`` (skip the opening of a wordless
    take), ``snap`` (to silences), ``edited`` (keep to picture cuts) and ``reaction`` (keep what follows the last words).

    An event that is no longer than wanted is whole. Else the clip opens just before the first speech, or behind the camera's
    settling, and ends with a sentence that ends nearby. Then, each over the one before: both edges go to the nearest silence in
    reach, if the length allows; in edited material to the nearest picture cut, and remnants of neighbouring shots under 400 ms
    go; an edge inside a word moves out of it, preferably keeping the word. A clip is no shorter than ``least`` where its
    event isn't.
    """
    h = handling
    n = lambda c: f"_t_{c}"
    c = F.col
    low, high = c("start").cast("double"), c("end").cast("double")
    out = clips.withColumns({
        n("least"): least.cast("double"), n("most"): most.cast("double"),
        n("cuts"): F.when(c("edited"), F.transform(F.filter("cuts", lambda x: (x["start"] >= c("start")) & (x["start"] <= c("end"))), lambda x: x["start"].cast("double"))).otherwise(F.array().cast("array<double>")),
        n("inside"): F.filter("speech", lambda s: (s["end"] > c("start")) & (s["start"] < c("end"))),
    })
    least_, most_, cuts, inside = (c(n(x)) for x in ("least", "most", "cuts", "inside"))
    out = out.withColumn(n("want"), F.least(F.greatest(desired.cast("double"), least_), most_, high - low))
    want = c(n("want"))
    fits = lambda a, b: (b - a >= least_) & (b - a <= most_)
    spoken = F.size(inside) > 0
    skip = F.when(c("settle"), F.least((high - low) * SETTLE_SHARE, F.lit(float(SETTLE_MS)))).otherwise(0.0)
    out = out.withColumn(n("s"), F.when(spoken, F.greatest(low, F.get(inside, F.lit(0))["start"] - h.pad_in)).otherwise(low + skip).cast("double"))
    s, e = c(n("s")), c(n("e"))
    # The reaction belongs to the words in the clip, not to the last ones of the event.
    last = F.coalesce(F.element_at(F.filter(inside, lambda x: x["start"] < s + want), -1), F.get(inside, F.lit(0)))
    kept = F.greatest(s + want, F.least(high, s + most_, last["end"] + (h.pad_out + REACTION_MS)))
    out = out.withColumn(n("e"), F.when(spoken & c("reaction"), kept).otherwise(s + want).cast("double"))
    sentence = _nearest(F.transform(inside, lambda x: F.struct(x["start"].alias("start"), (x["end"] + h.pad_out).cast("double").alias("v"))), e, h.window)
    out = out.withColumn(n("e"), F.when(sentence <= high, sentence).otherwise(e))
    over = e > high
    out = out.withColumns({n("s"): F.when(over, F.greatest(low, high - want)).otherwise(s), n("e"): F.least(e, high)})
    # Silences: an opening behind one, an end before one.
    quiet = lambda at, edge: F.coalesce(_nearest(F.transform("silences", lambda x: F.struct(x["start"].alias("start"), x[edge].cast("double").alias("v"))), at, h.window), at)
    out = out.withColumns({n("qs"): F.greatest(low, quiet(s, "end")), n("qe"): F.least(high, quiet(e, "start"))})
    quieter = c("snap") & ((c(n("qs")) != s) | (c(n("qe")) != e)) & fits(c(n("qs")), c(n("qe")))
    out = out.withColumns({n("s1"): F.when(quieter, c(n("qs"))).otherwise(s), n("e1"): F.when(quieter, c(n("qe"))).otherwise(e), n("snapped"): quieter})
    s1, e1 = c(n("s1")), c(n("e1"))
    # Picture cuts, from where the edges were before silences moved them.
    as_options = F.transform(cuts, lambda x: F.struct(x.alias("start"), x.alias("v")))
    out = out.withColumns({n("ic"): _nearest(as_options, s, h.window), n("oc"): _nearest(as_options, e, h.window)})
    i, o = c(n("ic")), c(n("oc"))
    both = fits(F.coalesce(i, s1), F.coalesce(o, e1))
    head_only, tail_only = i.isNotNull() & fits(i, e1), o.isNotNull() & fits(s1, o)
    out = out.withColumns({
        n("s2"): F.when(both, F.coalesce(i, s1)).when(head_only, i).otherwise(s1),
        n("e2"): F.when(both, F.coalesce(o, e1)).when(head_only, e1).when(tail_only, o).otherwise(e1),
    })
    s2, e2, s3, e3 = (c(n(x)) for x in ("s2", "e2", "s3", "e3"))
    head = _head(s2, e2, cuts)
    before = F.array_max(F.filter(cuts, lambda x: x <= s2))
    out = out.withColumn(n("s3"), F.when(head < FLASH_MS, F.when(e2 - (s2 + head) >= least_, s2 + head).when(e2 - before <= most_, before).otherwise(s2)).otherwise(s2))
    tail = _tail(s3, e2, cuts)
    after = F.array_min(F.filter(cuts, lambda x: x >= e2))
    out = out.withColumn(n("e3"), F.when(tail < FLASH_MS, F.when(e2 - tail - s3 >= least_, e2 - tail).when(after - s3 <= most_, after).otherwise(e2)).otherwise(e2))
    # Words, over all the rest: the way out that fits and leaves no flash, else one that fits, else the one that keeps the word.
    word = lambda at: F.array_min(F.filter("words", lambda w: (w["start"] < at) & (w["end"] > at)))

    def way_out(keep: Column, drop: Column, fit, flash) -> Column:
        good = lambda at: fit(at) & (F.coalesce(flash(at), F.lit(1e18)) >= FLASH_MS)
        return F.when(good(keep), keep).when(good(drop), drop).when(fit(keep), keep).when(fit(drop), drop).otherwise(keep)

    out = out.withColumn(n("w"), word(s3))
    keep, drop = F.greatest(low, c(n("w"))["start"]), F.least(high, c(n("w"))["end"])
    out = out.withColumn(n("s4"), F.when(c(n("w")).isNull(), s3).otherwise(way_out(keep, drop, lambda at: fits(at, e3), lambda at: _head(at, e3, cuts))))
    s4, e4 = c(n("s4")), c(n("e4"))
    out = out.withColumn(n("w"), word(e3))
    keep, drop = F.least(high, c(n("w"))["end"]), F.greatest(low, c(n("w"))["start"])
    out = out.withColumn(n("e4"), F.when(c(n("w")).isNull(), e3).otherwise(way_out(keep, drop, lambda at: fits(s4, at), lambda at: _tail(s4, at, cuts))))
    out = out.withColumns({n("in"): F.greatest(low, F.floor(s4 + 0.5)), n("out"): F.least(high, F.floor(e4 + 0.5))})
    short = c(n("out")) - c(n("in")) < least_
    grown = F.least(high, c(n("in")) + least_)
    whole = want >= high - low
    cut = (F.size(cuts) > 0) & ((s3 != s1) | (e3 != e1))
    reason = F.when(whole, "whole_event").when(cut, "cut").when(c(n("snapped")), "snapped").when(spoken, "speech").otherwise("centre")
    result = out.withColumns({
        f"{into}in_ms": F.when(whole, c("start")).when(short, F.greatest(low, grown - least_)).otherwise(c(n("in"))).cast("long"),
        f"{into}out_ms": F.when(whole, c("end")).when(short, grown).otherwise(c(n("out"))).cast("long"),
        f"{into}reason": reason,
    })
    return result.drop(*[x for x in result.columns if x.startswith("_t_")])


def removed_pauses(window_in: Column, window_out: Column, handling: Handling) -> Column:
    """What to take out of a clip (``in``, ``out``) so that its speech runs on, in order: an array of ranges.

    A pause is a silence, or a gap between two words that no music plays over, without the words in it, of ``least_pause`` or
    more. ``handle`` is left beside words; a pause at the clip's edge goes to the edge. Where words are timed, what lies between two
    pauses and holds no word goes with them. Nothing is taken out where nothing would be left.
    """
    h = handling
    words = F.filter("words", lambda w: (w["end"] > window_in) & (w["start"] < window_out))
    edge = lambda a, b, inner: F.struct(a.cast("long").alias("start"), b.cast("long").alias("end"), inner.alias("inner"))
    # Time without words: before the first, between, and behind the last.
    first = F.array(edge(window_in, F.get(words, F.lit(0))["start"], F.lit(False)))
    between = F.zip_with(words, F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: edge(a["end"], b["start"], F.lit(True)))
    last = F.array(edge(F.element_at(words, -1)["end"], window_out, F.lit(False)))
    gaps = F.when(F.size(words) > 0, F.concat(first, F.slice(between, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))), last)).otherwise(F.array(edge(window_in, window_out, F.lit(False))))

    def pauses(g: Column) -> Column:
        quiet = F.transform(F.filter("silences", lambda s: (s["end"] > g["start"]) & (s["start"] < g["end"])), lambda s: F.struct(F.greatest(s["start"], g["start"]).alias("start"), F.least(s["end"], g["end"]).alias("end")))
        music = F.exists("music", lambda m: (m["start"] < g["end"]) & (m["end"] > g["start"]))
        found = F.when(g["inner"] & ~music, F.array(F.struct(g["start"].alias("start"), g["end"].alias("end")))).otherwise(quiet)
        long = F.filter(found, lambda p: (p["end"] > p["start"]) & (p["end"] - p["start"] >= h.least_pause))
        handled = F.transform(long, lambda p: F.struct(F.when(p["start"] <= window_in, window_in).otherwise(p["start"] + h.handle).cast("long").alias("start"), F.when(p["end"] >= window_out, window_out).otherwise(p["end"] - h.handle).cast("long").alias("end")))
        left = F.filter(handled, lambda p: p["end"] > p["start"])
        one = F.array(F.struct(F.get(left, F.lit(0))["start"].alias("start"), F.element_at(left, -1)["end"].alias("end")))
        return F.when((F.size(left) > 1) & (F.size(words) > 0), one).otherwise(left)

    out = F.flatten(F.transform(gaps, pauses))
    return F.when(_total(out) < window_out - window_in, out).otherwise(F.array().cast(_RANGES))


def _total(spans: Column) -> Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda a, p: a + p["end"] - p["start"])


def clip_pieces(clips: DataFrame, handling: Handling) -> DataFrame:
    """Trims clips (see ``trimmed``; ``allocated``, ``least`` and ``most`` ms) and takes out pauses where ``remove_pauses`` says so.

    What is taken out leaves a clip shorter than it was given, so its window grows by that and is chosen again, until what goes is
    what it grew by, four rounds at most. Adds ``in_ms``, ``out_ms``, ``reason``, ``removed`` (ranges), ``removed_ms``,
    ``rounds`` and ``pieces``, the ranges that are left, in order.
    """
    checkpoint_folder(clips.sparkSession)
    left = clips.withColumns({"_extra": F.lit(0).cast("long"), "rounds": F.lit(0)})
    settled = None
    for n in range(1, ROUNDS + 1):
        extra = F.col("_extra")
        now = trimmed(left, handling, F.col("allocated") + extra, F.col("least") + extra, F.col("most") + extra)
        removed = F.when(F.col("remove_pauses"), removed_pauses(F.col("in_ms"), F.col("out_ms"), handling)).otherwise(F.array().cast(_RANGES))
        now = now.withColumn("removed", removed).withColumns({"removed_ms": _total(F.col("removed")), "rounds": F.lit(n)}).checkpoint()
        done = now if n == ROUNDS else now.where(F.col("removed_ms") == extra)
        settled = done if settled is None else settled.unionByName(done)
        if n < ROUNDS:
            # Only clips that still grow come to the next round.
            left = now.where(F.col("removed_ms") != extra).withColumn("_extra", F.col("removed_ms")).drop("in_ms", "out_ms", "reason", "removed", "removed_ms")
            if left.isEmpty():
                break
    at = settled
    starts = F.concat(F.array(F.col("in_ms")), F.transform("removed", lambda p: p["end"]))
    ends = F.concat(F.transform("removed", lambda p: p["start"]), F.array(F.col("out_ms")))
    pieces = F.filter(F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("start"), b.alias("end"))), lambda p: p["end"] > p["start"])
    return at.withColumn("pieces", pieces).drop("_extra")
