"""Budgeted selection plans: candidates, greedy choice, duration allocation, layout on a frame grid and captions.

The order-sensitive steps run as one group per plan; plans are independent and Spark deals them out. A plan's candidates
must be bounded (the clips of one cut): ``bounded_plans`` cuts owners of any size into such plans.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.time import frame_at
from tidemark.operators.selection import per_plan


def bounded_plans(frame: DataFrame, by: str, at: str, width: int, most: int = 500) -> DataFrame:
    """Adds ``plan`` (string): an owner's rows of one ``width`` of time, in parts of ``most`` rows in their order by time and
    ``id``, so that no plan is larger, however many rows an owner has. A null owner or time makes plans of its own."""
    block = F.floor(F.col(at) / width)
    n = F.row_number().over(Window.partitionBy(by, block).orderBy(at, "id")) - 1
    part = [F.coalesce(c.cast("string"), F.lit("-")) for c in (F.col(by), block)]
    return frame.withColumn("plan", F.concat_ws("/", *part, F.floor(n / most).cast("string")))


def exclusion_reason(excluded: Column, dropped: Column, ms: Column, least_ms: int) -> Column:
    """Why an event is no candidate; null if it is one."""
    return F.when(excluded, "excluded").when(dropped, "dropped_by_rules").when(ms < least_ms, "too_short")


def default_target(total_ms: Column) -> Column:
    """A tenth of the footage, between 30 seconds and 10 minutes."""
    return F.greatest(F.lit(30000), F.least(F.lit(600000), F.floor(total_ms / 10 + 0.5)))


def greedy(candidates: DataFrame, budgets: DataFrame | None, by: str) -> DataFrame:
    """Chooses candidates within each plan's budget: required ones first, then by falling value, each if it still fits.

    ``candidates``: ``by``, ``id``, ``ms``, ``value``, ``required``; ``budgets``: ``by``, ``budget``, or none where candidates have
    a ``budget`` themselves. Equal values go by
    value per millisecond, then by id. Returns the chosen rows with ``rank``. Plans without a budget choose nothing.
    """
    def choose(run: list[dict]) -> list[dict]:
        left, out = run[0]["budget"], []
        for r in run:
            if r["ms"] <= left:
                left -= r["ms"]
                out.append({by: r[by], "id": r["id"], "ms": r["ms"], "value": r["value"], "rank": len(out) + 1})
        return out

    rows = (candidates if budgets is None else candidates.join(budgets, by)).select(by, "id", "ms", "value", "budget", (~F.coalesce(F.col("required"), F.lit(False))).alias("_late"), (-F.col("value")).alias("_value"), (-F.col("value") / F.greatest(F.lit(1), "ms")).alias("_density"))
    return per_plan(rows, by, ["_late", "_value", "_density", "id"], choose, f"{by} {dict(candidates.dtypes)[by]}, id long, ms long, value double, rank int")


def allocate(chosen: DataFrame, by: str, target: str) -> DataFrame:
    """Lengths between each clip's ``min_ms`` and ``max_ms`` that sum to the plan's ``target`` where they can.

    Preferred lengths are clamped; what is too much is taken from the slack in proportion (rounded up, in order), and
    what is missing is added in proportion to value in at most 8 passes (rounded down).
    """
    def spread(run: list[dict]) -> list[dict]:
        low, high, value = ([r[c] for r in run] for c in ("min_ms", "max_ms", "value"))
        ms = [min(h, max(a, r["preferred_ms"])) for a, h, r in zip(low, high, run)]
        goal = int(run[0][target])
        over = sum(ms) - goal
        if over > 0:
            slack = sum(m - a for m, a in zip(ms, low))
            todo = over
            for i, (m, a) in enumerate(zip(ms, low)):
                cut = min(todo, m - a, math.ceil(over * (m - a) / slack) if slack else 0)
                ms[i], todo = m - cut, todo - cut
        for _ in range(8):
            missing = goal - sum(ms)
            room = [i for i, (m, h) in enumerate(zip(ms, high)) if m < h]
            weight = sum(value[i] for i in room)
            if missing <= 0 or not room or weight <= 0:
                break
            for i in room:
                ms[i] = min(high[i], ms[i] + math.floor(missing * value[i] / weight))
        return [{by: r[by], "id": r["id"], "ms": m} for r, m in zip(run, ms)]

    rows = chosen.select(by, "id", "position", "min_ms", "max_ms", "preferred_ms", "value", target)
    return per_plan(rows, by, ["position", "id"], spread, f"{by} {dict(chosen.dtypes)[by]}, id long, ms long")


def frame_layout(clips: DataFrame, by: list[str], rate: int, per: int = 1) -> DataFrame:
    """Frames of clips (``start``, ``end`` in ms) on a grid: a clip that the next one follows without a gap ends where that
    one starts, and every clip has one frame at least. Adds ``first_frame`` and ``end_frame``."""
    w = Window.partitionBy(*by).orderBy("start", "id")
    out = clips.withColumn("first_frame", frame_at(F.col("start"), rate, per)).withColumn("_next", F.lead("start").over(w)).withColumn("_frame", F.lead("first_frame").over(w))
    end = F.when(F.col("_next") == F.col("end"), F.col("_frame")).otherwise(frame_at(F.col("end"), rate, per))
    return out.withColumn("end_frame", F.greatest(end, F.col("first_frame") + 1)).drop("_next", "_frame")


def transition_frames(frames: Column, handle_before: Column, handle_after: Column, before: Column, after: Column) -> Column:
    """Half of a transition's frames as far as handles and both clips allow; null if there is no room for one."""
    half = F.least(F.floor(frames / 2), handle_before, handle_after, before, after)
    return F.when(half >= 1, half)


def cues(words: DataFrame, by: list[str], pause: int = 1000, most_ms: int = 7000, most_chars: int = 84) -> DataFrame:
    """Caption cues from words (``start``, ``end``, ``word``): a cue ends at a pause, at the end of a sentence, or before it
    would be too long. The fold over a cue's words is an aggregate over the session's sorted array.
    """
    w = Window.partitionBy(*by).orderBy("start", "end", "word")
    new = (F.col("start") - F.lag("end").over(w) >= pause) | F.lag("word").over(w).rlike(r"[.!?…。！？]$") | F.lag("end").over(w).isNull()
    part = words.withColumn("_new", new.cast("long")).withColumn("part", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    listed = part.groupBy(*by, "part").agg(F.sort_array(F.collect_list(F.struct("start", "end", "word"))).alias("ws"))
    one = "struct<start:bigint,end:bigint,text:string>"

    def add(done: Column, x: Column) -> Column:
        last = F.element_at(done, -1)
        text = F.concat(last["text"], F.lit(" "), x["word"])
        fits = (F.size(done) > 0) & (x["end"] - last["start"] <= most_ms) & (F.length(text) <= most_chars)
        grown = F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(F.struct(last["start"].alias("start"), x["end"].cast("long").alias("end"), text.alias("text"))))
        fresh = F.concat(done, F.array(F.struct(x["start"].cast("long").alias("start"), x["end"].cast("long").alias("end"), x["word"].alias("text"))))
        return F.when(F.size(done) == 0, fresh).when(fits, grown).otherwise(fresh)

    folded = F.aggregate("ws", F.array().cast(f"array<{one}>"), add)
    return listed.select(*by, F.explode(folded).alias("c")).select(*by, "c.*")
