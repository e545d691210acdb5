"""What goes into a cut: preferred lengths by rank, the parts of an arc, and a budgeted choice whose gains depend on what was
chosen before.

The choice is one pass over each plan's candidates in a priority queue. Plans are bounded (``planner.bounded_plans``), sorted
together by Spark and walked as runs of Arrow batches.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: What a role that a part of the arc prefers adds to a value: a fixed value.
ROLE_BONUS = 0.15


@dataclass(frozen=True)
class Segment:
    """A part of an arc: its share of the target and of the clips, roles that it prefers, and roles that it must have one of."""

    name: str
    budget: float
    prefer_roles: tuple[str, ...] = ()
    require_roles: tuple[str, ...] = ()


@dataclass(frozen=True)
class Taste:
    """What a style asks for beside its arc."""

    continuity_bonus: float = 0.1
    duplicate_penalty: float = 0.3
    max_operations: int | None = None


def preferred_durations(candidates: DataFrame, by: list[str]) -> DataFrame:
    """Adds ``preferred_ms``, between ``min_ms`` and ``max_ms`` by the rank of a candidate's ``value`` among those of its plan (equal
    values by ``id``); the middle where it is alone."""
    order, plan = Window.partitionBy(*by).orderBy("value", "id"), Window.partitionBy(*by)
    n = F.count("*").over(plan)
    rank = F.when(n > 1, (F.row_number().over(order) - 1) / (n - 1)).otherwise(0.5)
    return candidates.withColumn("preferred_ms", F.floor(F.col("min_ms") + (F.col("max_ms") - F.col("min_ms")) * rank + 0.5))


def arc_positions(candidates: DataFrame, by: list[str], order: list[str], length: str, arc: Sequence[Segment], place: Column | None = None) -> DataFrame:
    """Adds ``segment``, the part of the arc (from 0) that a candidate's beginning lies in when the lengths of a plan's candidates
    are laid end to end; ``place`` ('opening' or 'ending') overrides it."""
    w = Window.partitionBy(*by).orderBy(*order)
    before = F.sum(length).over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col(length)
    total = F.sum(length).over(Window.partitionBy(*by))
    position = before / F.when(total == 0, 1).otherwise(total)
    segment, end = F.lit(len(arc) - 1), 0.0
    rules = []
    for i, part in enumerate(arc):
        end += part.budget
        rules.append((position < end, i))
    for rule, i in reversed(rules):
        segment = F.when(rule, F.lit(i)).otherwise(segment)
    if place is not None:
        segment = F.when(place == "opening", F.lit(0)).when(place == "ending", F.lit(len(arc) - 1)).otherwise(segment)
    return candidates.withColumn("segment", segment.cast("int"))


def runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[list[dict]]:
    """Rows of one ``key`` after another, from batches sorted by it; holds one such run."""
    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and row[key] != held[0][key]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def per_plan(frame: DataFrame, by: str, order: list[str], choose: Callable[[list[dict]], list[dict]], schema: str) -> DataFrame:
    """``choose`` on the rows of each plan, in order: one shuffle by plan, then runs of sorted rows."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    into = to_arrow_schema(StructType.fromDDL(schema))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[dict] = []
        for run in runs(batches, by):
            out += choose(run)
            if len(out) >= 10_000:
                yield pa.RecordBatch.from_pylist(out, into)
                out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, into)

    return frame.repartition(by).sortWithinPartitions(by, *order).mapInArrow(walk, schema)


def scanned(frame: DataFrame, by: list[str], order: list[str], start: Callable[[dict], dict], step: Callable[[dict, dict], list[dict]], finish: Callable[[dict], list[dict]], schema: str) -> DataFrame:
    """An ordered pass over each group's rows that holds no more than a state: ``start`` makes it from the first row, ``step`` takes each
    row and gives what is known by then, ``finish`` the rest. One shuffle by ``by``; a group may be of any size."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    into = to_arrow_schema(StructType.fromDDL(schema))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, state = None, None
        for batch in batches:
            out: list[dict] = []
            for row in batch.to_pylist():
                key = tuple(row[c] for c in by)
                if state is None or key != group:
                    out += finish(state) if state is not None else []
                    group, state = key, start(row)
                out += step(state, row)
            yield pa.RecordBatch.from_pylist(out, into)
        if state is not None:
            yield pa.RecordBatch.from_pylist(finish(state), into)

    return frame.repartition(*by).sortWithinPartitions(*by, *order).mapInArrow(walk, schema)


def select_for_arc(candidates: DataFrame, relations: DataFrame, by: str, arc: Sequence[Segment], taste: Taste) -> DataFrame:
    """Chooses candidates of each plan, part by part of its arc, and says why.

    ``candidates``: ``by``, ``id`` (unique), ``ms`` (the length a clip should get), ``value``, ``required``, ``role``,
    ``segment`` and the plan's ``target``; ``relations``: ``source``, ``target``, ``kind`` ('continuation_of' or
    'duplicate_of') and ``strength``. In each part required candidates are taken; if it must have a role and none taken has it, the best
    that fits opens it; then the best that fits, again and again, while the part's share of the target and of
    ``max_operations`` lasts. What is left of the target is filled from all parts.

    The best has the highest worth: its value, more for a preferred role, more by its strongest continuation of what is taken
    and less by its strongest duplicate in it; then the highest value a second, then the smallest id. Returns ``by``, ``id``,
    ``rank`` (in the order of choice), ``segment``, ``worth`` (when chosen) and ``why``. An empty table gives an empty result.
    """
    w = [F.col("source"), F.col("target"), F.col("kind"), F.col("strength").cast("double").alias("strength")]
    ends = relations.select(*w).where("source <> target")
    ends = ends.select(F.col("source").alias("id"), F.col("target").alias("other"), "kind", "strength").union(ends.select("target", "source", "kind", "strength"))
    near = ends.groupBy("id").agg(F.collect_list(F.struct("other", "kind", "strength")).alias("near"))
    rows = candidates.select(by, "id", "ms", F.col("value").cast("double").alias("value"), "required", "role", "segment", F.col("target").cast("double").alias("target")).join(near, "id", "left")
    kind = dict(candidates.dtypes)[by]
    return per_plan(rows, by, ["id"], lambda run: _chosen(run, by, arc, taste), f"{by} {kind}, id long, rank int, segment int, worth double, why string")


def _chosen(rows: list[dict], by: str, arc: Sequence[Segment], taste: Taste) -> list[dict]:
    """One plan. Worths change only for neighbours of what is taken: these are put into the queue again, and older entries for
    them count no more. What doesn't fit once never fits again in that part, as what is used only grows."""
    of = {r["id"]: r for r in rows}
    target = rows[0]["target"]
    limit = taste.max_operations if taste.max_operations is not None else float("inf")
    gain = {i: 0.0 for i in of}  # by the strongest relations to what is taken
    strongest = {i: [0.0, 0.0] for i in of}
    out: list[dict] = []
    taken: set[int] = set()
    queue: list[tuple[float, float, int, int]] = []
    version = {i: 0 for i in of}
    prefer: tuple[str, ...] = ()

    def entry(i: int) -> tuple[float, float, int, int]:
        bonus = ROLE_BONUS if of[i]["role"] is not None and of[i]["role"] in prefer else 0.0
        worth = of[i]["value"] + bonus + gain[i]
        return -worth, -(of[i]["value"] + bonus) / max(1.0, of[i]["ms"] / 1000), i, version[i]

    def fill(pool: list[int], roles: tuple[str, ...]) -> None:
        nonlocal queue, prefer
        prefer = roles
        queue = [entry(i) for i in pool if i not in taken]
        heapq.heapify(queue)

    def best(room: float) -> tuple[int, float] | None:
        """Takes the best out of the queue; others that don't fit are gone from it."""
        while queue:
            worth, _, i, v = heapq.heappop(queue)
            if v == version[i] and i not in taken and of[i]["ms"] <= room:
                return i, -worth
        return None

    def take(i: int, worth: float, why: str) -> None:
        taken.add(i)
        out.append({by: of[i][by], "id": i, "rank": len(out) + 1, "segment": of[i]["segment"], "worth": worth, "why": why})
        for n in of[i]["near"] or ():
            o = n["other"]
            if o in of and o not in taken:
                k = int(n["kind"] == "duplicate_of")
                if n["strength"] > strongest[o][k]:
                    strongest[o][k] = n["strength"]
                    gain[o] = taste.continuity_bonus * strongest[o][0] - taste.duplicate_penalty * strongest[o][1]
                    version[o] += 1
                    if members is None or o in members:
                        heapq.heappush(queue, entry(o))

    used = 0
    members: set[int] | None
    for k, part in enumerate(arc):
        room, count = target * part.budget, 0
        cap = limit if limit == float("inf") else max(1, int(limit * part.budget + 0.5))
        pool = [r["id"] for r in rows if r["segment"] == k]
        spent = 0
        members, prefer, queue = set(), part.prefer_roles, []
        for i in pool:
            if of[i]["required"]:
                take(i, -entry(i)[0], "required")
                spent, count = spent + of[i]["ms"], count + 1
        wanted = part.require_roles
        if wanted and not any(i in taken and of[i]["role"] in wanted for i in pool):
            members = {i for i in pool if of[i]["role"] in wanted}
            fill(sorted(members), part.prefer_roles)
            if (found := best(room - spent)) is not None:
                take(*found, "opener")
                spent, count = spent + of[found[0]]["ms"], count + 1
        members = {i for i in pool if not of[i]["required"]}
        fill(sorted(members), part.prefer_roles)
        while len(out) < limit and count < cap and (found := best(room - spent)) is not None:
            take(*found, "ranked")
            spent, count = spent + of[found[0]]["ms"], count + 1
        used += spent
    members = None
    fill([r["id"] for r in rows], ())
    while used < target and len(out) < limit and (found := best(target - used)) is not None:
        take(*found, "filled")
        used += of[found[0]]["ms"]
    return out
