"""Queries on cuts: flags and roles, boundaries, overrides, order, continuations, chapters, captions and reports.

Orders stand for plans and their lines for clips; the event stream stands for recorded events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import judge
from tidemark.functions import text as tx
from tidemark.functions.numbers import rounded
from tidemark.operators import cuts, segments
from tidemark.operators import intervals as iv
from tidemark.plans.registry import RANGES, query, ranges, table

KINDS = ["travel", "departure", "arrival", "reaction", "explanation", "farewell", "b_roll", "other"]


def _round(x: str, n: int = 4) -> str:
    return f"floor(({x}) * 1e{n} + 0.5) / 1e{n}"


def _clamp(x: str) -> str:
    return f"greatest(0.0, least(1.0, {x}))"


_PLACE, _FEEL = "(event_id % 100) / 100.0::DOUBLE", "least(1.0::DOUBLE, value / 500)"


@query(f"""SELECT event_id, {_round(_clamp("CASE WHEN user_id % 2 = 0 THEN 0.4::DOUBLE ELSE 0.05 END + CASE WHEN user_id % 3 > 0 THEN 0.3 ELSE 0 END + CASE WHEN event_id % 5 <= 2 THEN 0.2 ELSE 0 END + CASE WHEN value * 10 >= 2000 THEN 0.1 ELSE 0 END"))} AS establishing,
  {_round(_clamp(f"CASE WHEN {_PLACE} < 0.2 THEN 0.35::DOUBLE ELSE 0.05 END + 0.4::DOUBLE * {_FEEL} + CASE WHEN user_id % 7 < 2 THEN 0.2 ELSE 0 END"))} AS opening FROM events""")
def flag_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    user, event = F.col("user_id"), F.col("event_id")
    one = judge.establishing(user % 2 == 0, user % 3 > 0, event % 5, F.col("value") * 10)
    two = judge.opening_flag((event % 100) / 100, F.least(F.lit(1.0), F.col("value") / 500), user % 7 < 2)
    return table(spark, sf_dir, "events").select("event_id", rounded(one, 4).alias("establishing"), rounded(two, 4).alias("opening"))


@query("""SELECT conv_id, turn, CASE WHEN """ + " OR ".join(f"starts_with(lower(text), '{w}')" for w in judge.OPENERS) + """ THEN 0.55::DOUBLE ELSE 0.15 END + CASE WHEN role = 'user' THEN 0.25::DOUBLE ELSE 0 END AS needs FROM conversations""")
def context_needs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", judge.needs_context(F.lower("text"), F.col("role") == "user", judge.OPENERS).alias("needs"))


@query(f"""WITH e AS (SELECT event_id, list_extract({KINDS}, CAST(event_id % 8 AS INTEGER) + 1) AS kind, {_PLACE} AS p, {_FEEL} AS f, user_id % 2 = 0 AS quiet, user_id % 3 = 0 AS bare, user_id % 5 = 0 AS blind FROM events),
  w AS (SELECT *, quiet AND f < 0.3 AND bare AND blind AS fill, quiet AND NOT blind AS seen FROM e)
  SELECT event_id, {_round("0.1::DOUBLE + CASE WHEN kind = 'arrival' THEN 0.15 ELSE 0 END + CASE WHEN p < 0.15 THEN 0.3 ELSE 0 END")} AS setup,
  {_round("0.1::DOUBLE + CASE WHEN kind = 'explanation' THEN 0.5 WHEN kind = 'b_roll' THEN 0.2 ELSE 0 END + CASE WHEN seen THEN 0.2 ELSE 0 END")} AS context,
  {_round("0.1::DOUBLE + CASE WHEN kind IN ('travel', 'departure') THEN 0.5 WHEN kind = 'b_roll' THEN 0.2 ELSE 0 END + CASE WHEN seen THEN 0.15 ELSE 0 END")} AS transition,
  {_round("0.1::DOUBLE + CASE WHEN kind = 'arrival' THEN 0.35 ELSE 0 END + CASE WHEN f > 0.6 AND f <= 0.8 THEN 0.25 ELSE 0 END")} AS payoff,
  {_round("0.05::DOUBLE + CASE WHEN f > 0.8 THEN 0.3::DOUBLE * f ELSE 0 END")} AS climax,
  {_round("0.05::DOUBLE + CASE WHEN kind = 'farewell' THEN 0.6 ELSE 0 END + CASE WHEN p > 0.85 THEN 0.25 ELSE 0 END")} AS ending,
  {_round("0.1::DOUBLE + CASE WHEN fill THEN 0.4 ELSE 0 END")} AS filler FROM w""")
def narrative_role_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    user, event = F.col("user_id"), F.col("event_id")
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (event % 8).cast("int") + 1)
    w = judge.role_weights(kind, (event % 100) / 100, F.least(F.lit(1.0), F.col("value") / 500), user % 2 == 0, user % 3 == 0, user % 5 == 0)
    e = table(spark, sf_dir, "events").select("event_id", w.alias("w"))
    return e.select("event_id", *[rounded(F.col("w")[k], 4).alias(k) for k in ("setup", "context", "transition", "payoff", "climax", "ending", "filler")])


@query(f"""WITH s AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 3 > 0 THEN l_discount::DOUBLE * 10 END AS v, CASE WHEN l_linenumber % 2 = 0 THEN l_tax::DOUBLE * 10 END AS q, CASE WHEN l_linenumber = 5 THEN 1::DOUBLE END AS t, l_suppkey FROM lineitem)
  SELECT l_orderkey, l_linenumber, CASE WHEN l_suppkey % 11 = 0 THEN 1 WHEN l_suppkey % 11 = 1 THEN 0 WHEN l_suppkey % 11 = 2 THEN 0.05 WHEN v IS NULL AND q IS NULL AND t IS NULL THEN 0.5
  ELSE {_round("greatest(0.0, least(1.0, (coalesce(v * 0.4::DOUBLE, 0) + coalesce(q * 0.25::DOUBLE, 0) + coalesce(t * 0.2::DOUBLE, 0)) / (CASE WHEN v IS NULL THEN 0 ELSE 0.4::DOUBLE END + CASE WHEN q IS NULL THEN 0 ELSE 0.25::DOUBLE END + CASE WHEN t IS NULL THEN 0 ELSE 0.2::DOUBLE END)))")} END AS separation FROM s""")
def separation_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    line, supplier = F.col("l_linenumber"), F.col("l_suppkey") % 11
    forced = F.when(supplier == 0, "split").when(supplier == 1, "merge")
    signals = {"visual": F.when(line % 3 > 0, F.col("l_discount").cast("double") * 10), "silence": F.when(line % 2 == 0, F.col("l_tax").cast("double") * 10), "topic": F.when(line == 5, F.lit(1.0))}
    score = segments.separation(forced, supplier == 2, {k: (v, segments.SIGNALS[k]) for k, v in signals.items()})
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", rounded(score, 4).alias("separation"))


@query(f"""WITH {RANGES}, p AS (SELECT owner, start, "end", CAST(k AS BIGINT) AS part FROM (SELECT *, unnest(range(0, ("end" - start) // 5400000 + 1)) AS k FROM r WHERE "end" > start))
  SELECT owner, part, start + part * 5400000 AS start, least("end", start + (part + 1) * 5400000) AS "end" FROM p WHERE least("end", start + (part + 1) * 5400000) - (start + part * 5400000) >= 200""")
def fixed_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.windows(ranges(spark, sf_dir).select("owner", "start", "end"), 5400000).select("owner", "part", "start", "end")


@query(f"""WITH {RANGES}, s AS (SELECT owner - 1 AS asset, id, start + 1800000 AS start, "end" + 1800000 AS "end" FROM r WHERE owner % 2 = 1),
  o AS (SELECT least(a.id, s.id) AS source, greatest(a.id, s.id) AS target, (least(a."end", s."end") - greatest(a.start, s.start)) / least(a."end" - a.start, s."end" - s.start) AS share
    FROM r a JOIN s ON a.owner = s.asset AND a.start < s."end" AND s.start < a."end")
  SELECT source, target, max({_round("least(1.0::DOUBLE, share)")}) AS strength FROM o WHERE share >= 0.5 GROUP BY ALL""")
def same_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = ranges(spark, sf_dir).select(F.col("owner").alias("asset"), "id", "start", "end")
    offsets = r.where("asset % 2 = 1").select("asset", (F.col("asset") - 1).alias("reference"), F.lit(1800000).alias("offset")).distinct()
    return iv.same_moments(r, offsets, 3600000)


@query(f"""WITH {RANGES}, a AS (SELECT * FROM r WHERE id % 2 = 0), b AS (SELECT * FROM r WHERE id % 2 = 1),
  t AS (SELECT owner, start AS tm FROM r UNION SELECT owner, "end" FROM r), g AS (SELECT owner, tm AS start, lead(tm) OVER (PARTITION BY owner ORDER BY tm) AS "end" FROM t),
  h AS (SELECT * FROM g WHERE "end" IS NOT NULL AND EXISTS (SELECT 1 FROM a WHERE a.owner = g.owner AND a.start <= g.start AND a."end" >= g."end") AND EXISTS (SELECT 1 FROM b WHERE b.owner = g.owner AND b.start <= g.start AND b."end" >= g."end")),
  i AS (SELECT *, sum(CASE WHEN before = start THEN 0 ELSE 1 END) OVER (PARTITION BY owner ORDER BY start) AS n FROM (SELECT *, lag("end") OVER (PARTITION BY owner ORDER BY start) AS before FROM h))
  SELECT owner, min(start) + 500 AS start, max("end") - 500 AS "end" FROM i GROUP BY owner, n HAVING max("end") - min(start) >= 4000""")
def inactive_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = ranges(spark, sf_dir).select("owner", "id", "start", "end")
    return iv.inactive(r.where("id % 2 = 0"), r.where("id % 2 = 1"), ["owner"])


_WISH = "l_suppkey % 5 = 0 AS req, l_suppkey % 7 = 0 AS gone, CASE WHEN l_suppkey % 3 = 0 THEN 0.5::DOUBLE END AS boost, l_linenumber % 2 = 0 AS aside, l_linenumber = 3 AS essential"


@query(f"""WITH c AS (SELECT l_orderkey, l_linenumber AS id, l_discount::DOUBLE AS value, {_WISH} FROM lineitem), i AS (SELECT *, NOT aside OR (req AND NOT gone) AS inside FROM c),
  d AS (SELECT *, CASE WHEN NOT inside THEN NULL WHEN gone AND NOT essential THEN 'dropped' WHEN aside THEN 'recovered' ELSE 'kept' END AS decision FROM i)
  SELECT l_orderkey, id, CASE WHEN inside THEN value + coalesce(boost, 0) ELSE value END AS value, decision, coalesce(inside AND req AND decision <> 'dropped', false) AS required FROM d""")
def user_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("l_suppkey")
    c = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("id"), F.col("l_discount").cast("double").alias("value"), (s % 5 == 0).alias("require"), (s % 7 == 0).alias("drop"), F.when(s % 3 == 0, 0.5).alias("boost"), (F.col("l_linenumber") % 2 == 0).alias("aside"), (F.col("l_linenumber") == 3).alias("essential"))
    return cuts.overridden(c, "l_orderkey")


@query("""WITH s AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) = 1 AND count(*) OVER (PARTITION BY user_id) >= 3 AS lead, CASE WHEN event_id % 13 = 0 THEN 'wipe' END AS own FROM events),
  o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY lead DESC, event_id) - 1 AS place FROM s)
  SELECT user_id, event_id, CAST(place AS INTEGER) AS place, CASE WHEN own IS NOT NULL THEN own WHEN place = 0 THEN NULL WHEN lag(event_id // 50) OVER (PARTITION BY user_id ORDER BY place) <> event_id // 50 THEN 'dissolve' ELSE 'hard_cut' END AS transition FROM o""")
def ordered_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    event = F.col("event_id")
    s = table(spark, sf_dir, "events").select("user_id", event.alias("id"), "value", F.floor(event / 50).alias("chapter"), F.when(event % 13 == 0, "wipe").alias("own"))
    out = cuts.transitions(cuts.sequence_order(s, "user_id", "id", "value", True), "user_id", "place", "own", "chapter", "dissolve", "hard_cut")
    return out.select("user_id", F.col("id").alias("event_id"), "place", "transition")


@query("""WITH c AS (SELECT user_id, event_id, event_id % 2 AS track, event_id % 3 AS asset, CAST(floor(value) AS BIGINT) AS a, CAST(floor(value) AS BIGINT) + 20 AS b, event_id % 4 > 0 AS goes, CASE WHEN event_id % 7 = 0 THEN 'dissolve' END AS t FROM events),
  p AS (SELECT *, lag(track) OVER w AS pt, lag(asset) OVER w AS pa, lag(b) OVER w AS pb, row_number() OVER w AS n FROM c WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
  q AS (SELECT *, CASE WHEN n = 1 OR pt <> track THEN 'nothing_before' WHEN pa <> asset THEN 'different_moment' WHEN a < pb THEN 'starts_before_end' WHEN t IS NOT NULL THEN 'has_transition' END AS problem FROM p)
  SELECT user_id, event_id, problem FROM q WHERE goes AND problem IS NOT NULL""")
def continuation_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, event = F.floor("value").cast("long"), F.col("event_id")
    c = table(spark, sf_dir, "events").select("user_id", event, (event % 2).alias("track"), (event % 3).alias("asset"), F.lit(1).alias("event"), q.alias("source_in"), (q + 20).alias("source_out"), (event % 4 > 0).alias("continues"), F.when(event % 7 == 0, "dissolve").alias("transition_in"), F.lit("hard_cut").alias("transition_out"))
    return cuts.invalid_continuations(c, "user_id", "event_id")


@query("""WITH s AS (SELECT l_orderkey, sum(CAST(l_quantity AS BIGINT)) AS a, sum(CASE WHEN l_returnflag = 'R' THEN CAST(l_quantity AS BIGINT) ELSE 0 END) AS b FROM lineitem GROUP BY 1 HAVING sum(CAST(l_quantity AS BIGINT)) > 0) SELECT l_orderkey, b / a AS share, b / a < 0.4 AS below FROM s""")
def speech_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cuts.speech_share(table(spark, sf_dir, "lineitem"), "l_orderkey", F.col("l_quantity").cast("long"), F.col("l_returnflag") == "R", 0.4)


@query("""WITH n AS (SELECT user_id, event_type AS reason, count(*) AS n FROM events WHERE event_id % 3 < 2 GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, reason) AS rank FROM n) SELECT user_id, reason, n, CAST(rank AS INTEGER) AS rank FROM k WHERE rank <= 3""")
def drop_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    decision = F.element_at(F.array(F.lit("dropped"), F.lit("excluded"), F.lit("kept")), (F.col("event_id") % 3).cast("int") + 1)
    return cuts.top_reasons(table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("reason"), decision.alias("decision")), "user_id")


@query("""WITH o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations) SELECT conv_id, min(turn) AS start, max(turn) + 1 AS "end", count(*) AS n, array_to_string(list(coalesce(text, '') ORDER BY turn) FILTER (WHERE n <= 3), ' / ') AS summary FROM o GROUP BY conv_id""")
def chapter_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("id"), F.col("turn").alias("start"), (F.col("turn") + 1).alias("end"), "text")
    return cuts.chapter_summaries(c, ["conv_id"], "start", "text")


@query("""WITH o AS (SELECT l_orderkey, l_linenumber, list_extract(['too_short', 'repetition', 'missing_context', 'abrupt_location_change', 'too_long'], CAST(l_suppkey % 5 AS INTEGER) + 1) AS kind, l_partkey % 2 = 0 AS bridge FROM lineitem)
  SELECT l_orderkey, l_linenumber, CASE kind WHEN 'too_short' THEN 'extend_operation' WHEN 'repetition' THEN 'drop_operation' ELSE 'insert_bridge' END AS action,
  CASE kind WHEN 'too_short' THEN 'give it at least a second' WHEN 'repetition' THEN 'shown before' ELSE CASE WHEN bridge THEN 'material between the two exists' ELSE 'nothing bridges this' END END AS reason FROM o WHERE kind <> 'too_long'""")
def revision_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.array(*map(F.lit, ("too_short", "repetition", "missing_context", "abrupt_location_change", "too_long")))
    action, reason = cuts.revision_action(F.element_at(kinds, (F.col("l_suppkey") % 5).cast("int") + 1), F.when(F.col("l_partkey") % 2 == 0, F.col("l_partkey")))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", action.alias("action"), reason.alias("reason")).where("action is not null")


@query("""SELECT l_orderkey, bool_and(l_quantity < 49) AS ok, count(*) FILTER (WHERE l_quantity >= 49) AS errors, count(*) FILTER (WHERE l_quantity < 49 AND l_quantity >= 40) AS warnings FROM lineitem GROUP BY 1""")
def validation_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    severity = F.when(F.col("l_quantity") >= 49, "error").when(F.col("l_quantity") >= 40, "warning").otherwise("info")
    return cuts.reports(table(spark, sf_dir, "lineitem").select("l_orderkey", severity.alias("severity")), "l_orderkey")


@query("""WITH RECURSIVE c AS (SELECT conv_id, turn, text AS t FROM conversations WHERE text IS NOT NULL), w AS (SELECT *, string_split(t, ' ') AS ws FROM c),
  p AS (SELECT conv_id, turn, array_to_string(ws[1:k], ' ') AS a, array_to_string(ws[k + 1:], ' ') AS b, k FROM (SELECT *, unnest(range(1, len(ws))) AS k FROM w WHERE length(t) > 42 AND length(t) <= 84)),
  b AS (SELECT conv_id, turn, arg_min([a, b], abs(length(a) - length(b)) + CASE WHEN length(a) > length(b) THEN 0.5 ELSE 0 END + k / 1e6) AS two FROM p WHERE length(a) <= 42 AND length(b) <= 42 GROUP BY ALL),
  g AS (SELECT conv_id, turn, ws, 0 AS k, '' AS line, '' AS done FROM w WHERE length(t) > 42
    UNION ALL SELECT conv_id, turn, ws, k + 1, CASE WHEN line <> '' AND length(line) + 1 + length(ws[k + 1]) <= 42 THEN line || ' ' || ws[k + 1] ELSE ws[k + 1] END,
      CASE WHEN line = '' OR length(line) + 1 + length(ws[k + 1]) <= 42 THEN done ELSE done || line || '|' END FROM g WHERE k < len(ws))
  SELECT w.conv_id, w.turn, CASE WHEN length(t) <= 42 THEN t WHEN two IS NOT NULL THEN array_to_string(two, '|') ELSE done || line END AS lines FROM w LEFT JOIN b USING (conv_id, turn) LEFT JOIN (SELECT conv_id, turn, done, line FROM g WHERE k = len(ws)) g USING (conv_id, turn)""")
def wrapped_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").where("text is not null")
    return c.select("conv_id", "turn", F.array_join(tx.caption_lines(F.col("text")), "|").alias("lines"))
