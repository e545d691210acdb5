"""Steps about a chosen cut: overrides, order, transitions, continuations, reasons, chapters and suggested revisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def overridden(candidates: DataFrame, by: str, id: str = "id") -> DataFrame:
    """A caller's overrides on candidates with ``value``, ``aside`` (turned down before), ``essential``, and the wishes
    ``require``, ``drop`` and ``boost``: a required candidate comes back, a dropped one goes unless it is essential, a
    boost adds to the value. Adds ``required`` and ``decision`` (kept, recovered, dropped; null: stays aside)."""
    want, gone = F.coalesce("require", F.lit(False)), F.coalesce("drop", F.lit(False))
    back = F.col("aside") & want & ~gone
    inside = ~F.col("aside") | back
    decision = F.when(~inside, None).when(gone & ~F.col("essential"), "dropped").when(back, "recovered").otherwise("kept")
    value = F.when(inside, F.col("value") + F.coalesce("boost", F.lit(0.0))).otherwise(F.col("value"))
    return candidates.select(by, id, value.alias("value"), decision.alias("decision"), F.coalesce(inside & want & (decision != "dropped"), F.lit(False)).alias("required"))


def unknown_ids(wishes: DataFrame, known: DataFrame, id: str = "id") -> DataFrame:
    """Ids that overrides name and no event has."""
    return wishes.select(id).distinct().join(known.select(id), id, "left_anti")


def sequence_order(selected: DataFrame, by: str, at: str, hook: str, hook_first: bool) -> DataFrame:
    """Adds ``place`` from 0: by time, or with the highest ``hook`` (then the smallest ``id``) first where there are three
    or more."""
    plan = Window.partitionBy(by)
    best = F.row_number().over(plan.orderBy(F.col(hook).desc(), "id")) == 1
    lead = best & (F.count("*").over(plan) >= 3) & F.lit(hook_first)
    order = plan.orderBy(F.col("_lead").desc(), at, "id")
    return selected.withColumn("_lead", lead).withColumn("place", (F.row_number().over(order) - 1).cast("int")).drop("_lead")


def transitions(sequence: DataFrame, by: str, place: str, own: str, chapter: str, at_chapter: str | None, default: str | None) -> DataFrame:
    """Adds ``transition``: a clip's own, else none for a plan's first, else that of a chapter's change, else the default."""
    order = Window.partitionBy(by).orderBy(place)
    changed = ~F.lag(chapter).over(order).eqNullSafe(F.col(chapter))
    first = F.row_number().over(order) == 1
    chosen = F.when(F.col(own).isNotNull(), F.col(own)).when(first, None)
    if at_chapter is not None:
        chosen = chosen.when(changed, at_chapter)
    return sequence.withColumn("transition", chosen.otherwise(F.lit(default)))


def invalid_continuations(clips: DataFrame, by: str, place: str) -> DataFrame:
    """Clips that say they continue the one before (``continues``) and don't, with the ``problem``: clips have ``track``,
    ``asset``, ``event``, ``source_in``, ``source_out``, ``transition_in`` and ``transition_out``."""
    order = Window.partitionBy(by).orderBy(place)
    before = lambda c: F.lag(c).over(order)
    soft = lambda c: c.isNotNull() & (c != "hard_cut")
    problem = (
        F.when(F.row_number().over(order) == 1, "nothing_before")
        .when(before("track") != F.col("track"), "nothing_before")
        .when(~before("asset").eqNullSafe(F.col("asset")) | ~before("event").eqNullSafe(F.col("event")), "different_moment")
        .when(F.col("source_in") < before("source_out"), "starts_before_end")
        .when(soft(F.col("transition_in")) | soft(before("transition_out")), "has_transition")
    )
    return clips.withColumn("problem", problem).where("continues and problem is not null").select(by, place, "problem")


def speech_share(clips: DataFrame, by: str, length: Column, speaks: Column, least: float) -> DataFrame:
    """Share of a cut's time whose clips carry speech, and whether it is below ``least``; no row for a cut of no length."""
    out = clips.groupBy(by).agg(F.sum(length).alias("_all"), F.sum(F.when(speaks, length).otherwise(0)).alias("_said")).where("_all > 0")
    return out.select(by, (F.col("_said") / F.col("_all")).alias("share"), (F.col("_said") / F.col("_all") < least).alias("below"))


def top_reasons(rationale: DataFrame, by: str, k: int = 3) -> DataFrame:
    """The ``k`` most frequent reasons for dropping or excluding, the first by name among equals: ``reason``, ``n``, ``rank``."""
    n = rationale.where(F.col("decision").isin("dropped", "excluded")).groupBy(by, "reason").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.col("n").desc(), "reason"))
    return n.withColumn("rank", rank).where(F.col("rank") <= k)


def chapter_summaries(events: DataFrame, by: list[str], at: str, text: str, k: int = 3) -> DataFrame:
    """Start, end, number of events, and the first ``k`` descriptions of each chapter."""
    order = Window.partitionBy(*by).orderBy(at, "id")
    # Only the first k rows of a chapter have a text by the time they come together.
    few = events.withColumn("_n", F.row_number().over(order)).withColumn("_t", F.when(F.col("_n") <= k, F.struct("_n", F.coalesce(text, F.lit("")).alias("t"))))
    out = few.groupBy(*by).agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n"), F.sort_array(F.collect_list("_t")).alias("_s"))
    return out.select(*by, "start", "end", "n", F.array_join(F.transform("_s", lambda s: s["t"]), " / ").alias("summary"))


def revision_action(kind: Column, bridge: Column) -> tuple[Column, Column]:
    """What to change for what a review found, and why; null for findings that suggest nothing."""
    gap = kind.isin("missing_context", "abrupt_location_change")
    action = F.when(kind == "too_short", "extend_operation").when(kind == "repetition", "drop_operation").when(gap, "insert_bridge")
    reason = F.when(kind == "too_short", "give it at least a second").when(kind == "repetition", "shown before").when(gap & bridge.isNotNull(), "material between the two exists").when(gap, "nothing bridges this")
    return action, reason


def reports(issues: DataFrame, by: str) -> DataFrame:
    """``ok`` where no issue of a report is an error, and how many are errors and warnings."""
    count = lambda s: F.sum((F.col("severity") == s).cast("long"))
    return issues.groupBy(by).agg(F.bool_and(F.col("severity") != "error").alias("ok"), count("error").alias("errors"), count("warning").alias("warnings"))
