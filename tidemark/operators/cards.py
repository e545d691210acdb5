"""What edited material shows: shots with a detector's stutter folded away, and title cards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators.intervals import points_in, union

#: Shots shorter than this are a stutter; the longest card, the most motion of a still picture, the mean luma of a dark one, and how far
#: from the middle of the frame a title may lie: fixed values.
BURST_MS, CARD_MS, STILL, DARK, CENTRE = 1000, 6000, 0.5, 20.0, 0.25


def steady_shots(shots: DataFrame, by: list[str]) -> DataFrame:
    """Shots (``start``, ``end``, ``id``) of which those under a second join the shot before them: ``start``, ``end``.

    Those at the very start join the first long one, and where none is long all are one shot. A count of long shots so far tells which
    belong together, so no asset's shots are gathered.
    """
    order = Window.partitionBy(*by).orderBy("start", "id")
    long = (F.col("end") - F.col("start") >= BURST_MS).cast("int")
    n = shots.withColumn("_n", F.sum(long).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    parts = n.groupBy(*by, F.greatest(F.lit(1), "_n").alias("_g")).agg(F.min("start").alias("start"), F.max(F.when(F.col("_n") > 0, F.col("end"))).alias("_end"), F.max_by("end", F.struct("start", "id")).alias("_last"))
    return parts.select(*by, "start", F.coalesce("_end", "_last").alias("end"))


def title_cards(shots: DataFrame, pictures: DataFrame, reads: DataFrame, black: DataFrame, by: list[str], hop_ms: int, width: int) -> DataFrame:
    """Title cards and cuts to black: ``start``, ``end``, those that overlap or touch as one.

    ``pictures``: ``hop``, ``motion``, ``luma``; ``reads``: ``start`` and ``middle`` (of the text's box, 0 to 1) of scene text;
    ``black``: ranges. A shot of six seconds or less is a card if none of its samples but the first moves, there are two at least, and
    it is dark or has text in the middle of the frame. An asset without pictures has none but its black ranges.
    """
    short = shots.where(F.col("end") - F.col("start") <= CARD_MS).select(*by, "start", "end")
    first, last = F.ceil((F.col("start") + hop_ms) / hop_ms), F.ceil(F.col("end") / hop_ms) - 1
    sampled = short.where(last >= first).withColumn("hop", F.explode(F.sequence(first, last))).join(pictures.select(*by, "hop", "motion", "luma"), [*by, "hop"])
    still = sampled.groupBy(*by, "start", "end").agg(F.count("*").alias("n"), F.max("motion").alias("most"), F.avg("luma").alias("mean")).where((F.col("n") >= 2) & (F.col("most") <= STILL))
    centred = reads.where(F.abs(F.col("middle") - 0.5) <= CENTRE).select(*by, F.col("start").alias("at"))
    titled = points_in(still, centred, by, "at", width).select(*by, "start", "end").distinct().withColumn("_titled", F.lit(True))
    cards = still.join(titled, [*by, "start", "end"], "left").where((F.col("mean") <= DARK) | F.col("_titled"))
    return union(cards.select(*by, "start", "end").unionByName(black.select(*by, "start", "end")), by).select(*by, "start", "end")
