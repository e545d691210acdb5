"""Events as they are listed and inspected, by level of detail, and the figures of an analysis."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.time import format_timecode

LEVELS = ("summary", "detailed", "full")


def event_details(events: DataFrame, assessments: DataFrame, level: str = "summary", relations: DataFrame | None = None) -> DataFrame:
    """Events as a row each for a reader: what a listing has, or all that was observed, or also why it was judged so.

    ``events``: ``id``, ``chapter``, ``start``, ``end``, ``description``, ``event_type``, ``essential``, ``confidence``,
    ``inactive_ratio``; for more than a summary also ``speech``, ``on_screen_text``, ``seen``, ``sound``, ``people``,
    ``places``, ``topics``, ``notes`` (arrays), ``affect`` (map) and ``excluded``. ``assessments``: ``id``, ``role``,
    ``metrics`` and ``flags`` (maps), ``probabilities`` (map), ``rationale``. ``relations``: ``source``, ``target``, ``kind``,
    ``strength``, thinned before; both directions are listed.

    An event without an assessment is 'context' at 0.5 throughout. Sounds are listed once each.
    """
    if level not in LEVELS:
        raise ValueError(f"{level}: not one of {', '.join(LEVELS)}")
    metric = lambda name: F.coalesce(F.col("_metrics")[name], F.lit(0.5))
    judged = assessments.select("id", F.col("role").alias("_role"), F.col("metrics").alias("_metrics"), F.col("flags").alias("_flags"), F.col("probabilities").alias("_probabilities"), F.col("rationale").alias("_rationale"))
    e = events.join(judged, "id", "left")
    out = {
        "id": F.col("id"), "chapter": F.col("chapter"), "start": format_timecode(F.col("start")), "end": format_timecode(F.col("end")), "duration_ms": F.col("end") - F.col("start"), "description": F.col("description"), "event_type": F.col("event_type"),
        "role": F.coalesce("_role", F.lit("context")), "importance": metric("story_importance"), "emotion": metric("emotional_intensity"), "redundancy": metric("redundancy"), "essential": F.col("essential"), "confidence": F.col("confidence"), "inactive_ratio": F.when(F.col("inactive_ratio") > 0, F.col("inactive_ratio")),
    }
    if level != "summary":
        out |= {c: F.col(c) for c in ("speech", "on_screen_text", "seen")} | {"sound": F.array_distinct("sound")} | {c: F.col(c) for c in ("people", "places", "topics", "affect", "notes", "excluded")}
    if level == "full":
        empty = F.create_map().cast("map<string,double>")
        out |= {"metrics": F.coalesce("_metrics", empty), "flags": F.coalesce("_flags", empty), "role_probabilities": F.coalesce("_probabilities", empty), "rationale": F.col("_rationale")}
        if relations is not None:
            ends = relations.select(F.col("source").alias("id"), F.col("target").alias("other"), "kind", "strength").union(relations.select("target", "source", "kind", "strength"))
            near = ends.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("kind", "other", "strength"))).alias("_near"))
            e = e.join(near, "id", "left")
            out["relations"] = F.coalesce("_near", F.array().cast("array<struct<kind:string,other:bigint,strength:double>>"))
    return e.select(*[c.alias(name) for name, c in out.items()])


def analysis_figures(counted: dict[str, DataFrame], assets: DataFrame, events: DataFrame, runs: DataFrame) -> DataFrame:
    """Figures of an analysis as rows ``figure``, ``value``: how many rows each of ``counted`` has, the media's and the events' mean length
    in ms (``assets`` and ``events`` have ``ms``), and what model ``runs`` cost in all. Each table is aggregated by itself."""
    total = {"total_media_duration_ms": assets.agg(F.coalesce(F.sum("ms"), F.lit(0))), "mean_event_duration_ms": events.agg(F.coalesce(F.floor(F.avg("ms") + 0.5), F.lit(0))), "total_cost_usd": runs.agg(F.coalesce(F.sum("cost"), F.lit(0.0)))}
    total |= {f"{name}_count": frame.agg(F.count("*")) for name, frame in counted.items()}
    out = None
    for name, one in total.items():
        row = one.toDF("value").select(F.lit(name).alias("figure"), F.col("value").cast("double").alias("value"))
        out = row if out is None else out.unionByName(row)
    return out
