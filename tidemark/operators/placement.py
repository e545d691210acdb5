"""Recordings on one capture timeline: the clock that orders most of them, their places, and how long lies between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Time that a still takes on the timeline, and between any two files: fixed values.
STILL_MS, GAP_MS = 3000, 1000


def starts_apart(a_utc: Column, b_utc: Column, a_local: Column, b_local: Column) -> Column:
    """How long after a recording another started: by their instants if both have one, else by their wall clocks; never one against
    the other."""
    return F.coalesce(b_utc - a_utc, b_local - a_local)


def placed(assets: DataFrame, by: list[str]) -> DataFrame:
    """Adds to ``assets`` (``by``, ``id``, ``name``, ``kind``, ``ms``, ``utc``, ``local``, ``offset_min``; times in ms, nulls where
    unknown) ``place`` (from 0), ``at`` (ms on the timeline), ``ordered_by``, ``clock``, ``beside`` and ``side``.

    A project is ordered by instants, unless more of its files have a wall clock and these were written in one time zone at most. Files
    without a time on that clock stand beside the dated file whose name is next before theirs (``side`` 1), or next after (-1);
    where nothing is dated names decide. Equal times go by name, then id. All are windows over a project's sorted files.
    """
    project = Window.partitionBy(*by)
    count = lambda c: F.count(F.col(c)).over(project)
    one_zone = F.coalesce(F.min("offset_min").over(project) == F.max("offset_min").over(project), F.lit(True))
    clock = F.when((count("local") > count("utc")) & one_zone, "local").when(count("utc") > 0, "utc")
    a = assets.withColumn("_clock", clock)
    a = a.withColumn("_at", F.when(F.col("_clock") == "local", F.col("local")).when(F.col("_clock") == "utc", F.col("utc")))
    dated = F.col("_at").isNotNull()
    # Dated files come first in this order, so their numbers are their places in time.
    number = F.row_number().over(Window.partitionBy(*by).orderBy(F.col("_at").asc_nulls_last(), "name", "id"))
    a = a.withColumn("_slot", F.when(dated, F.struct(number.alias("index"), F.col("id").alias("id"))))
    names = Window.partitionBy(*by).orderBy("name", "id")
    a = a.withColumns({"_before": F.last("_slot", ignorenulls=True).over(names.rowsBetween(Window.unboundedPreceding, -1)), "_after": F.first("_slot", ignorenulls=True).over(names.rowsBetween(1, Window.unboundedFollowing))})
    beside = F.when(~dated, F.coalesce("_before", "_after"))
    side = F.when(dated | beside.isNull(), 0).when(F.col("_before").isNotNull(), 1).otherwise(-1)
    a = a.withColumns({"_index": F.coalesce(F.col("_slot.index"), beside["index"], F.lit(0)), "side": side, "beside": beside["id"]})
    order = Window.partitionBy(*by).orderBy("_index", "side", "name", "id")
    room = F.when(F.col("kind") == "image", F.lit(STILL_MS)).otherwise(F.col("ms")) + GAP_MS
    out = a.withColumns({"place": (F.row_number().over(order) - 1).cast("long"), "at": F.coalesce(F.sum(room).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")})
    by_time = F.col("_at").isNotNull()
    out = out.withColumns({"ordered_by": F.when(by_time, "creation_time").otherwise("file_name"), "clock": F.when(by_time, F.col("_clock"))})
    return out.select(*assets.columns, "place", "at", "ordered_by", "clock", "beside", F.when(F.col("beside").isNotNull(), F.col("side")).alias("side"))
