"""What a closer look may cost: which items are escalated under a policy, what calls would use, which instants are worth looking at, and
recordings cut into uploads of a bounded size."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators.intervals import points_in
from tidemark.operators.selection import scanned


@dataclass(frozen=True)
class Policy:
    """Bounds of an escalation: items and cost at most, the least value, and items that are taken whatever their value."""

    max_items: int | None = None
    max_cost: float | None = None
    min_value: float | None = None
    min_items: int = 0


def escalated(candidates: DataFrame, by: str, policy: Policy) -> DataFrame:
    """Candidates (``by``, ``id``, ``value``, ``cost``) in the order of their worth, with ``taken`` and, where not, ``limited_by``:
    'value', 'count' or 'cost'.

    By falling value, then id: those under ``min_value`` go unless ``min_items`` aren't reached, then those beyond ``max_items``, then those that
    would exceed ``max_cost``; a later one that costs less may still fit. Adds ``place`` (from 1). One ordered pass per group.
    """
    most, cost = (float("inf") if x is None else x for x in (policy.max_items, policy.max_cost))
    least = float("-inf") if policy.min_value is None else policy.min_value

    def step(state: dict, r: dict) -> list[dict]:
        state["place"] += 1
        why = None
        if state["n"] >= policy.min_items and r["value"] < least:
            why = "value"
        elif state["n"] >= most:
            why = "count"
        elif state["spent"] + r["cost"] > cost:
            why = "cost"
        else:
            state["n"] += 1
            state["spent"] += r["cost"]
        return [{by: r[by], "id": r["id"], "place": state["place"], "cost": r["cost"], "taken": why is None, "limited_by": why}]

    rows = candidates.select(by, "id", F.col("value").cast("double").alias("value"), F.col("cost").cast("double").alias("cost"), (-F.col("value")).alias("_v"))
    schema = f"{by} {dict(candidates.dtypes)[by]}, id long, place long, cost double, taken boolean, limited_by string"
    return scanned(rows, [by], ["_v", "id"], lambda _: {"n": 0, "spent": 0.0, "place": 0}, step, lambda _: [], schema)


def decisions(escalation: DataFrame, by: str) -> DataFrame:
    """Of each group: how many were taken, what they cost, and what the last one that wasn't was limited by ('nothing' if none was)."""
    out = escalation.groupBy(by).agg(F.count_if("taken").alias("taken"), F.sum(F.when(F.col("taken"), F.col("cost")).otherwise(0.0)).alias("_cost"), F.max_by("limited_by", F.when(~F.col("taken"), F.col("place"))).alias("_why"))
    return out.select(by, "taken", (F.floor(F.col("_cost") * 1e6 + 0.5) / 1e6).alias("cost"), F.coalesce("_why", F.lit("nothing")).alias("limited_by"))


def token_rates(calls: DataFrame, by: list[str]) -> DataFrame:
    """What calls (``chars``, ``input``, ``output`` tokens) used: ``per_char`` (input tokens) and ``per_call`` (output tokens). Calls that report
    no input, or have no prompt, measure nothing."""
    seen = calls.where("input is not null and chars > 0").groupBy(*by).agg(F.sum("input").alias("_i"), F.sum("chars").alias("_c"), F.sum(F.coalesce("output", F.lit(0))).alias("_o"), F.count("*").alias("_n"))
    return seen.select(*by, (F.col("_i") / F.col("_c")).alias("per_char"), (F.col("_o") / F.col("_n")).alias("per_call"))


def estimated_tokens(chars: Column, per_char: Column, per_call: Column) -> Column:
    """Tokens that a call with such a prompt would use; 0 where nothing was measured."""
    return F.coalesce(F.floor(chars * per_char + per_call + 0.5), F.lit(0)).cast("long")


def instants_to_look_at(instants: DataFrame, inactive: DataFrame, by: list[str], width: int) -> DataFrame:
    """Instants (``by``, ``id``, ``at``) of which those in one inactive span (``start``, ``end``) are thinned to the first: one look shows
    what an empty place is like. An instant in several spans belongs to the one that starts, then ends, first."""
    inside = points_in(inactive.select(*by, "start", "end"), instants.select(*by, "id", "at"), by, "at", width)
    span = inside.groupBy(*by, "id").agg(F.min(F.struct("start", "end")).alias("_s"))
    n = F.row_number().over(Window.partitionBy(*by, "_s").orderBy("at", "id"))
    first = instants.join(span, [*by, "id"]).withColumn("_n", n)
    return instants.join(first.where("_n > 1").select(*by, "id"), [*by, "id"], "left_anti")


def bounded_pieces(stretches: DataFrame, levels: DataFrame, by: list[str], limit: int, hop_ms: int = 100) -> DataFrame:
    """Stretches of recordings (``start``, ``end``) in pieces of ``limit`` ms at most: one that is too long is cut at the quietest hop that begins
    in the last tenth of what a piece may hold, the first of equals, or at the limit where nothing was measured.

    ``levels``: ``hop`` and ``level``. A stretch meets its own hops only, in order, and the pass over them holds one piece. Stretches of one
    ``by`` start at different times.
    """
    hops = levels.select(*by, "hop", (F.col("hop") * hop_ms).alias("at"), F.col("level").cast("double").alias("level"))
    inside = points_in(stretches.select(*by, "start", "end"), hops, by, "at", max(limit, hop_ms))
    # A row of no hop stands before those of its stretch, so that a stretch without levels comes too.
    marks = stretches.select(*by, "start", "end", F.lit(-1).cast("long").alias("at"), F.lit(None).cast("double").alias("level"))
    rows = marks.unionByName(inside.where("level is not null").select(*by, "start", "end", "at", "level"))
    tenth = limit * 0.9

    def start(r: dict) -> dict:
        return {"keys": {c: r[c] for c in by}, "from": r["start"], "at": r["start"], "end": r["end"], "best": None, "level": None}

    def cut(s: dict, until: float) -> list[dict]:
        """Pieces whose last tenth is over by ``until``."""
        out = []
        while s["end"] - s["at"] > limit and until + hop_ms > s["at"] + limit:
            to = s["at"] + limit if s["best"] is None else s["best"]
            out.append({**s["keys"], "stretch": s["from"], "start": s["at"], "end": to})
            s |= {"at": to, "best": None, "level": None}
        return out

    def step(s: dict, r: dict) -> list[dict]:
        if r["level"] is None:
            return []
        out = cut(s, r["at"])
        if r["at"] >= s["at"] + tenth and r["at"] + hop_ms <= s["at"] + limit and (s["level"] is None or r["level"] < s["level"]):
            s |= {"best": r["at"], "level": r["level"]}
        return out

    def finish(s: dict) -> list[dict]:
        out = cut(s, float("inf"))
        return out + ([{**s["keys"], "stretch": s["from"], "start": s["at"], "end": s["end"]}] if s["end"] > s["at"] else [])

    kinds = dict(stretches.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in by) + ", stretch long, start long, end long"
    return scanned(rows, [*by, "start"], ["at"], start, step, finish, schema)
