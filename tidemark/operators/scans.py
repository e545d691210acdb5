"""Ordered scans: sessions, runs, positions, changes, placements and ranked limits, as window functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def sessions(frame: DataFrame, by: list[str], at: str, gap: int, tie: str) -> DataFrame:
    """Adds ``session``, from 1: a row more than ``gap`` after the one before it begins a new one."""
    order = Window.partitionBy(*by).orderBy(at, tie)
    before = F.lag(at).over(order)
    new = before.isNull() | (F.col(at) - before > gap)
    return frame.withColumn("_new", new.cast("long")).withColumn("session", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def runs(frame: DataFrame, by: list[str], order: list[str], flag: str) -> DataFrame:
    """Longest runs of successive rows with a true ``flag``: ``first``, ``last`` (row numbers from 1) and ``n``."""
    w = Window.partitionBy(*by).orderBy(*order)
    numbered = frame.withColumn("_i", F.row_number().over(w)).where(flag)
    island = F.col("_i") - F.row_number().over(Window.partitionBy(*by).orderBy("_i"))
    return numbered.withColumn("_island", island).groupBy(*by, "_island").agg(F.min("_i").alias("first"), F.max("_i").alias("last"), F.count("*").alias("n")).drop("_island")


def positions(frame: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Adds ``position`` (first, middle, last; a single row is first) and ``relative`` (0 to 1)."""
    i = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    n = F.count("*").over(Window.partitionBy(*by))
    out = frame.withColumn("_i", i).withColumn("_n", n)
    place = F.when(F.col("_i") == 1, "first").when(F.col("_i") == F.col("_n"), "last").otherwise("middle")
    relative = F.when(F.col("_n") > 1, (F.col("_i") - 1) / (F.col("_n") - 1)).otherwise(0.0)
    return out.withColumn("position", place).withColumn("relative", relative).drop("_i", "_n")


def changes(frame: DataFrame, by: list[str], order: list[str], column: str) -> DataFrame:
    """Rows whose ``column`` differs from the row before; the first row counts as a change."""
    before = F.lag(column).over(Window.partitionBy(*by).orderBy(*order))
    return frame.withColumn("_before", before).where(~F.col("_before").eqNullSafe(F.col(column)) | F.col("_before").isNull()).drop("_before")


def placed(frame: DataFrame, by: list[str], order: list[str], length: Column, pad: int = 0) -> DataFrame:
    """Adds ``offset``: the sum of the lengths before a row, each with ``pad`` after it."""
    before = F.sum(length + pad).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return frame.withColumn("offset", F.coalesce(before, F.lit(0)))


def strongest(edges: DataFrame, k: int) -> DataFrame:
    """Edges (``source``, ``target``, ``type``, ``strength``) in the ``k`` strongest of their type at either end."""
    ends = edges.withColumn("end", F.col("source")).union(edges.withColumn("end", F.col("target")))
    rank = F.row_number().over(Window.partitionBy("end", "type").orderBy(F.col("strength").desc(), "source", "target"))
    return ends.withColumn("_rank", rank).where(F.col("_rank") <= k).drop("_rank", "end").distinct()


def first_seen(frame: DataFrame, by: list[str], order: Column, value: str, most: int | None = None) -> DataFrame:
    """Distinct values of each group in the order in which they first appear, as ``values``."""
    once = frame.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.min(order).alias("_at"))
    listed = F.transform(F.sort_array(F.collect_list(F.struct("_at", value))), lambda s: s[value])
    return once.groupBy(*by).agg((F.slice(listed, 1, most) if most else listed).alias("values"))


def most_common(frame: DataFrame, by: list[str], value: str, at_least: int = 1) -> DataFrame:
    """Most frequent value of each group, the first by name among equals: ``value``, ``n``."""
    n = frame.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n")).where(F.col("n") >= at_least)
    return n.groupBy(*by).agg(F.min_by(F.struct(F.col(value).alias("v"), "n"), F.struct(-F.col("n"), F.col(value))).alias("_b")).select(*by, F.col("_b.v").alias("value"), F.col("_b.n").alias("n"))


def role_runs(frame: DataFrame, by: list[str], order: list[str], role: str) -> DataFrame:
    """Adds ``run`` (number of the run of equal roles) and ``run_length``."""
    w = Window.partitionBy(*by).orderBy(*order)
    new = ~F.lag(role).over(w).eqNullSafe(F.col(role))
    out = frame.withColumn("_new", new.cast("long")).withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")
    return out.withColumn("run_length", F.count("*").over(Window.partitionBy(*by, "run")))
