"""Events as rows for rules, judges and search: facts against neighbours, aspect texts, descriptions, vocabularies,
fingerprints, and plans fitted to what a target can hold."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.text import readable, shortened


def facts(events: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Adds what rules ask of an event's surroundings: ``new_places`` and ``new_people`` against the event before (all of
    them at the first), ``position`` from 1 and ``n``."""
    w = Window.partitionBy(*by).orderBy(*order)
    none = F.array().cast("array<string>")
    new = lambda c: F.size(F.array_except(F.coalesce(F.col(c), none), F.coalesce(F.lag(c).over(w), none))).cast("long")
    return events.withColumns({"new_places": new("places"), "new_people": new("people"), "position": F.row_number().over(w), "n": F.count("*").over(Window.partitionBy(*by))})


def aspect_texts(labels: Column, speech: Column, places: Column, affect: Column) -> Column:
    """Map of aspect to text: ``visual``, ``speech``, ``context``, and ``mood``, in which an axis is repeated by its strength.
    Aspects without text are left out."""
    axes = F.flatten(F.transform(F.array_sort(F.map_entries(affect)), lambda e: F.array_repeat(e["key"], F.greatest(F.lit(1), F.floor(3 * e["value"] + 0.5).cast("int")))))
    joined = lambda x: F.array_join(F.coalesce(x, F.array().cast("array<string>")), " ")
    every = F.create_map(F.lit("visual"), joined(labels), F.lit("speech"), joined(speech), F.lit("context"), joined(places), F.lit("mood"), joined(axes))
    return F.map_filter(every, lambda _, v: v != "")


def description(speech: Column, reads: Column, labels: Column, most: int = 140) -> Column:
    """Text for an event without a model: what is said, up to 3 reads in brackets, up to 4 labels."""
    said = F.array_join(speech, " ")
    shown = F.transform(F.slice(reads, 1, 3), lambda r: F.concat(F.lit("["), r, F.lit("]")))
    parts = F.array_compact(F.concat(F.array(F.nullif(said, F.lit(""))), shown, F.slice(labels, 1, 4)))
    return shortened(F.array_join(parts, " "), most)


def affect(text: Column, axes: Mapping[str, str], intensity: float = 0.6) -> Column:
    """Map of the axes whose pattern text matches."""
    found = F.array_compact(F.array(*[F.when(F.lower(text).rlike(p), F.lit(k)) for k, p in axes.items()]))
    return F.map_from_arrays(found, F.transform(found, lambda _: F.lit(intensity)))


def vocabulary(terms: DataFrame, by: list[str], order: list[str], most: int = 40) -> DataFrame:
    """Terms of each group, one of each spelling regardless of case (the first), in readable scripts only, ``most`` at
    most; groups of fewer than two terms have none. ``term``, ``rank``."""
    fine = terms.where(F.col("term").isNotNull() & (F.trim("term") != "") & readable(F.col("term"))).withColumn("_k", F.lower(F.trim("term")))
    once = fine.withColumn("_n", F.row_number().over(Window.partitionBy(*by, "_k").orderBy(*order))).where("_n = 1")
    ranked = once.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).withColumn("_all", F.count("*").over(Window.partitionBy(*by)))
    return ranked.where((F.col("rank") <= most) & (F.col("_all") > 1)).select(*by, "term", "rank")


def fingerprint(*columns: str) -> Column:
    """Digest of columns in the order of their names, nulls left out."""
    return F.sha2(F.to_json(F.struct(*sorted(columns))), 256)


def lenient_json(text: Column, schema: str) -> Column:
    """The first JSON object in prose or in a fenced block; null if there is none that can be read."""
    return F.from_json(F.regexp_extract(text, r"(?s)(\{.*\})", 1), schema, {"mode": "PERMISSIVE"})


def latest(frame: DataFrame, by: list[str], at: str, tie: str) -> DataFrame:
    """The last row of each group, the larger ``tie`` at one time."""
    order = Window.partitionBy(*by).orderBy(F.col(at).desc(), F.col(tie).desc())
    return frame.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def negotiated(clips: DataFrame, tracks: int, speeds: bool, transitions: list[str]) -> DataFrame:
    """Clips as a target can hold them, with ``downgrades``: speeds become 1 over the same time on the timeline, unknown
    transitions hard cuts, and clips above the highest track are dropped (``kept``)."""
    slow = F.lit(not speeds) & (F.col("speed") != 1)
    hard = F.col("transition").isNotNull() & ~F.col("transition").isin(transitions)
    high = F.col("track") >= tracks
    notes = F.array_compact(F.array(F.when(slow, "speed"), F.when(hard, "transition"), F.when(high, "track")))
    out = F.when(slow, F.col("in_ms") + F.floor((F.col("out_ms") - F.col("in_ms")) / F.col("speed") + 0.5)).otherwise(F.col("out_ms"))
    return clips.withColumn("downgrades", notes).withColumn("kept", ~high).withColumn("out_ms", out).withColumn("transition", F.when(~hard, F.col("transition"))).withColumn("speed", F.when(slow, 1.0).otherwise(F.col("speed")))
