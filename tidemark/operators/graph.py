"""Relations between events: continuations, content edges by shared features, adjacency and duplicate groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.numbers import clamp, rounded
from tidemark.functions.text import coverage
from tidemark.operators.components import connected_components


def continuity(same_asset: Column, shared_place: Column, no_places: Column, cover: Column, gap_ms: Column) -> Column:
    """How well one event continues the one before it."""
    place = F.when(shared_place, 0.3).when(no_places, 0.1).otherwise(0.0)
    return rounded(clamp(0.25 + F.when(same_asset, 0.2).otherwise(0.0) + place + 0.25 * cover - F.least(F.lit(0.3), gap_ms / 600000)))


def continuations(events: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """An edge from each event (``id``, ``features``, ``place``, ``start``, ``end``) to the next of its group."""
    w = Window.partitionBy(*by).orderBy(*order)
    e = events
    for c in ("id", "features", "place", "end"):
        e = e.withColumn(f"p_{c}", F.lag(c).over(w))
    gap = F.greatest(F.lit(0), F.col("start") - F.col("p_end"))
    value = continuity(F.lit(True), F.coalesce(F.col("place") == F.col("p_place"), F.lit(False)), F.col("place").isNull() & F.col("p_place").isNull(), coverage(F.col("features"), F.col("p_features")), gap)
    return e.where("p_id is not null").select(F.col("p_id").alias("source"), F.col("id").alias("target"), F.lit("continuation").alias("type"), value.alias("strength"))


def shared_features(events: DataFrame, by: list[str], most: int | None = None) -> DataFrame:
    """Pairs of one group that share a feature, with the overlap coefficient: ``a`` < ``b``, ``similarity``.

    An inverted index of features stands in for comparing all pairs. ``most`` leaves out, as an edge's evidence only,
    features that more events of a group have; sizes are still those of the whole sets.
    """
    each = events.select(*by, "id", F.size("features").alias("n"), F.explode("features").alias("f"))
    if most:
        common = each.groupBy(*by, "f").agg(F.count("*").alias("c")).where(F.col("c") <= most).select(*by, "f")
        each = each.join(common, [*by, "f"])
    left = each.select(*by, "f", F.col("id").alias("a"), F.col("n").alias("na"))
    right = each.select(*by, "f", F.col("id").alias("b"), F.col("n").alias("nb"))
    pairs = left.join(right, [*by, "f"]).where("a < b").groupBy(*by, "a", "b").agg(F.count("*").alias("shared"), F.first("na").alias("na"), F.first("nb").alias("nb"))
    return pairs.select(*by, "a", "b", (F.col("shared") / F.least("na", "nb")).alias("similarity"))


def content_edges(pairs: DataFrame, duplicate: float = 0.88, topic: float = 0.6) -> DataFrame:
    """Pairs as ``duplicate_of`` or ``same_topic`` edges by their similarity."""
    kind = F.when(F.col("similarity") >= duplicate, "duplicate_of").otherwise("same_topic")
    return pairs.where(F.col("similarity") >= topic).select(F.col("a").alias("source"), F.col("b").alias("target"), kind.alias("type"), rounded(F.col("similarity")).alias("strength"))


def adjacency(edges: DataFrame) -> DataFrame:
    """Strongest edge of each pair from both ends: ``node``, ``other``, ``strength``, ``n``."""
    both = edges.select(F.col("source").alias("node"), F.col("target").alias("other"), "strength").union(edges.select("target", "source", "strength"))
    return both.groupBy("node", "other").agg(F.max("strength").alias("strength"), F.count("*").alias("n"))


def duplicate_groups(edges: DataFrame) -> DataFrame:
    """Components of ``duplicate_of`` edges: ``node``, ``component_id``."""
    return connected_components(edges.where("type = 'duplicate_of'").select(F.col("source").alias("u"), F.col("target").alias("v")))
