"""Clips of a cut: pauses, words, required assets, duplicates, missing context and bridges between events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators.intervals import points_in, subtract, union
from tidemark.operators.selection import per_plan


def words_in_clips(clips: DataFrame, words: DataFrame, by: list[str], width: int) -> DataFrame:
    """Words whose middle lies in a clip, its start included and its end not."""
    w = words.select(*by, F.floor((F.col("start") + F.col("end")) / 2).alias("middle"), "word", F.col("start").alias("w_start"))
    return points_in(clips, w, by, "middle", width)


def pauses(quiet: DataFrame, words: DataFrame, by: list[str], least: int, handle: int) -> DataFrame:
    """Time to cut: quiet ranges without the words in them, ``handle`` left at both ends, if ``least`` long or more."""
    left = subtract(quiet, words, by).where(F.col("end") - F.col("start") >= least)
    return left.select(*by, (F.col("start") + handle).alias("start"), (F.col("end") - handle).alias("end")).where("end > start")


def pieces_after(clips: DataFrame, cuts: DataFrame, by: list[str]) -> DataFrame:
    """What is left of clips when cuts are taken out, with the time removed per owner."""
    left = subtract(clips, cuts, by)
    length = F.sum(F.col("end") - F.col("start"))
    before = union(clips, by).groupBy(*by).agg(length.alias("before"))
    after = left.groupBy(*by).agg(F.count("*").alias("pieces"), length.alias("after"))
    return before.join(after, by, "left").select(*by, F.coalesce("pieces", F.lit(0)).alias("pieces"), (F.col("before") - F.coalesce("after", F.lit(0))).alias("removed"))


def required_assets(candidates: DataFrame, assets: DataFrame, asset: str) -> DataFrame:
    """Adds ``promoted``: the best candidate (by value, then id) of each required asset of which none is required yet."""
    wanted = candidates.join(assets.select(asset).distinct(), asset, "left_semi")
    have = wanted.groupBy(asset).agg(F.bool_or("required").alias("_have"), F.min_by("id", F.struct(-F.col("value"), F.col("id"))).alias("_best")).where("not _have")
    return candidates.join(have.select(asset, "_best"), asset, "left").withColumn("promoted", F.coalesce(F.col("id") == F.col("_best"), F.lit(False))).drop("_best")


def without_duplicates(candidates: DataFrame, groups: DataFrame) -> DataFrame:
    """Of candidates in one group (``id``, ``group``) only the best by value, quality and id; others stay."""
    order = Window.partitionBy("group").orderBy(F.col("value").desc(), F.col("quality").desc(), "id")
    grouped = candidates.join(groups, "id").withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n", "group")
    return candidates.join(groups.select("id"), "id", "left_anti").unionByName(grouped)


def with_context(chosen: DataFrame, needs: DataFrame, by: str) -> DataFrame:
    """Chosen clips whose needed predecessors (``id``, ``needs``) are chosen too; a clip that goes takes those that need it
    along. Each plan is one group: its chosen clips and their needs."""
    def prune(run: list[dict]) -> list[dict]:
        left = {r["id"] for r in run}
        pairs = [(r["id"], r["needs"]) for r in run if r["needs"] is not None]
        dependants: dict[int, list[int]] = {}
        for i, n in pairs:
            dependants.setdefault(n, []).append(i)
        gone = [n for n in dependants if n not in left]  # each is followed once
        while gone:
            for i in dependants.get(gone.pop(), ()):
                if i in left:
                    left.discard(i)
                    gone.append(i)
        return [{by: run[0][by], "id": i} for i in sorted(left)]

    both = chosen.select(by, "id").join(needs.select("id", "needs"), "id", "left")
    return per_plan(both, by, ["id"], prune, f"{by} {dict(chosen.dtypes)[by]}, id long")


def bridges(events: DataFrame, used: DataFrame, by: list[str], order: list[str], roles: list[str], back: int = 4) -> DataFrame:
    """For each used event the nearest of the ``back`` events before it that is unused and of one of ``roles``."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(-back, -1)
    flagged = events.join(used.select("id").distinct().withColumn("_used", F.lit(True)), "id", "left")
    fit = F.when(F.col("_used").isNull() & F.col("role").isin(roles), F.col("id"))
    return flagged.withColumn("bridge", F.last(fit, ignorenulls=True).over(w)).where("_used and bridge is not null").select(*by, "id", "bridge")
