"""Queries over time ranges: joins, as-of matches, interval algebra and windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.numbers import rounded
from tidemark.functions.time import epoch_ms
from tidemark.operators import intervals as iv
from tidemark.operators import scans
from tidemark.plans.registry import RANGES, merged, query, ranges, table

HOUR = 3600000


@query(f"""WITH {RANGES} SELECT a.owner, a.id, b.id AS r_id, greatest(a.start, b.start) AS clip_start, least(a."end", b."end") AS clip_end,
  least(a."end", b."end") - greatest(a.start, b.start) AS overlap, b.start >= a.start AND b."end" <= a."end" AS whole
  FROM r a JOIN r b ON a.owner = b.owner AND a.start < b."end" AND b.start < a."end" WHERE a.kind = 'view' AND b.kind = 'click'""")
def interval_overlap_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = ranges(spark, sf_dir)
    out = iv.overlap_join(r.where("kind = 'view'"), r.where("kind = 'click'"), ["owner"], HOUR)
    return out.select("owner", "id", "r_id", "clip_start", "clip_end", "overlap", "whole")


@query(f"""WITH {RANGES} SELECT a.owner, a.id, count(*) AS points, round(sum(b.value), 2) AS total
  FROM r a JOIN r b ON a.owner = b.owner AND b.start >= a.start AND b.start < a."end" GROUP BY a.owner, a.id""")
def points_in_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = ranges(spark, sf_dir)
    points = r.select("owner", F.col("start").alias("at"), F.col("value").alias("v"))
    return iv.points_in(r, points, ["owner"], "at", HOUR).groupBy("owner", "id").agg(F.count("*").alias("points"), F.round(F.sum("v"), 2).alias("total"))


@query(f"""WITH {RANGES}, c AS (SELECT a.id, a.owner, b.id AS near, abs(a.start - b.start) AS distance,
    row_number() OVER (PARTITION BY a.id ORDER BY abs(a.start - b.start), b.start, b.id) AS k
  FROM r a JOIN r b ON a.owner = b.owner WHERE a.kind = 'purchase' AND b.kind = 'click' AND abs(a.start - b.start) <= 14400000)
  SELECT r.owner, r.id, c.near, c.distance FROM r LEFT JOIN c ON r.id = c.id AND c.k = 1 WHERE r.kind = 'purchase'""")
def asof_nearest_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = ranges(spark, sf_dir)
    left = r.where("kind = 'purchase'").select("owner", "id", "start")
    right = r.where("kind = 'click'").select("owner", "start", F.col("id").alias("near"))
    return iv.nearest(left, right, ["owner"], "start", "start", "near", 4 * HOUR).select("owner", "id", "near", "distance")


@query(f"WITH {RANGES}, {merged('m')} SELECT * FROM m")
def interval_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iv.union(ranges(spark, sf_dir), ["owner"])


@query(f"""WITH {RANGES}, {merged('m')} SELECT owner, CAST(sum("end" - start) AS BIGINT) AS covered FROM m GROUP BY owner""")
def interval_union_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iv.covered(ranges(spark, sf_dir), ["owner"])


@query(f"""WITH {RANGES}, {merged('m')}, g AS (SELECT owner, "end" AS start, lead(start) OVER (PARTITION BY owner ORDER BY start) AS "end" FROM m)
  SELECT owner, start, "end" FROM g WHERE "end" > start""")
def interval_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iv.gaps(ranges(spark, sf_dir), ["owner"])


_AXIS = f"""WITH {RANGES}, {merged('a', "kind = 'view'")}, {merged('b', "kind = 'click'")},
  t AS (SELECT owner, start AS tm FROM a UNION SELECT owner, "end" FROM a UNION SELECT owner, start FROM b UNION SELECT owner, "end" FROM b),
  p AS (SELECT owner, tm AS start, lead(tm) OVER (PARTITION BY owner ORDER BY tm) AS "end" FROM t),
  h AS (SELECT p.* FROM p WHERE "end" > start AND EXISTS (SELECT 1 FROM a WHERE a.owner = p.owner AND a.start <= p.start AND p."end" <= a."end")
    AND {{}} EXISTS (SELECT 1 FROM b WHERE b.owner = p.owner AND b.start <= p.start AND p."end" <= b."end")),
  n AS (SELECT *, CASE WHEN lag("end") OVER (PARTITION BY owner ORDER BY start) = start THEN 0 ELSE 1 END AS fresh FROM h),
  i AS (SELECT *, sum(fresh) OVER (PARTITION BY owner ORDER BY start ROWS UNBOUNDED PRECEDING) AS island FROM n)
  SELECT owner, min(start) AS start, max("end") AS "end" FROM i GROUP BY owner, island"""


@query(_AXIS.format("NOT"))
def interval_subtraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = ranges(spark, sf_dir)
    return iv.subtract(r.where("kind = 'view'"), r.where("kind = 'click'"), ["owner"])


@query(_AXIS.format(""))
def interval_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = ranges(spark, sf_dir)
    return iv.intersect(r.where("kind = 'view'"), r.where("kind = 'click'"), ["owner"])


@query(f"""WITH {RANGES}, c AS (SELECT owner, id, start, "end", CASE kind WHEN 'view' THEN 0 WHEN 'click' THEN 1 ELSE 2 END AS track FROM r),
  t AS (SELECT owner, start AS tm FROM c UNION SELECT owner, "end" FROM c),
  p AS (SELECT owner, tm AS start, lead(tm) OVER (PARTITION BY owner ORDER BY tm) AS "end" FROM t),
  b AS (SELECT p.owner, p.start, p."end", c.id, row_number() OVER (PARTITION BY p.owner, p.start ORDER BY c.track DESC, c.id) AS k
    FROM p JOIN c ON c.owner = p.owner AND c.start < p."end" AND p.start < c."end"),
  n AS (SELECT *, CASE WHEN lag(id) OVER w = id AND lag("end") OVER w = start THEN 0 ELSE 1 END AS fresh FROM b WHERE k = 1 WINDOW w AS (PARTITION BY owner ORDER BY start)),
  i AS (SELECT *, sum(fresh) OVER (PARTITION BY owner ORDER BY start ROWS UNBOUNDED PRECEDING) AS run FROM n)
  SELECT owner, min(start) AS start, max("end") AS "end", min(id) AS id FROM i GROUP BY owner, run""")
def timeline_flattening(spark: SparkSession, sf_dir: str) -> DataFrame:
    track = F.when(F.col("kind") == "view", 0).when(F.col("kind") == "click", 1).otherwise(2)
    return iv.topmost(ranges(spark, sf_dir).withColumn("track", track), ["owner"], HOUR)


@query(f"""WITH {RANGES}, g AS (SELECT *, max("end") OVER (PARTITION BY owner, kind ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM r),
  i AS (SELECT *, sum(CASE WHEN reach IS NULL OR start > reach THEN 1 ELSE 0 END) OVER (PARTITION BY owner, kind ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS island FROM g)
  SELECT owner, kind, min(start) AS start, max("end") AS "end", max(value) AS score, arg_min(id, (-value, id)) AS best_id FROM i GROUP BY owner, kind, island""")
def merge_overlapping_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = iv.islands(ranges(spark, sf_dir), ["owner", "kind"])
    best = F.min_by("id", F.struct(-F.col("value"), F.col("id")))
    return found.groupBy("owner", "kind", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.max("value").alias("score"), best.alias("best_id")).drop("island")


@query(f"""WITH {RANGES}, {merged('m', "kind = 'signup'")}, c AS (SELECT a.owner, a.id, a."end" - a.start AS length, coalesce(sum(CASE WHEN m.start IS NOT NULL THEN least(a."end", m."end") - greatest(a.start, m.start) END), 0) AS spoken
  FROM (SELECT * FROM r WHERE kind = 'view') a LEFT JOIN m ON a.owner = m.owner AND a.start < m."end" AND m.start < a."end" GROUP BY ALL)
  SELECT owner, id, CASE WHEN length > 0 THEN floor(least(1, spoken / length) * 1000 + 0.5) / 1000 ELSE 0 END AS ratio FROM c""")
def overlap_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = ranges(spark, sf_dir)
    own = r.where("kind = 'view'").select("owner", "id", "start", "end")
    other = iv.union(r.where("kind = 'signup'"), ["owner"]).select("owner", "start", "end")
    sums = iv.overlap_join(own, other, ["owner"], HOUR).groupBy("id").agg(F.sum("overlap").alias("spoken"))
    length = F.col("end") - F.col("start")
    ratio = F.when(length > 0, rounded(F.least(F.lit(1.0), F.coalesce("spoken", F.lit(0)) / length), 3)).otherwise(0.0)
    return own.join(sums, "id", "left").select("owner", "id", ratio.alias("ratio"))


@query("""WITH s AS (SELECT user_id, event_id, (epoch_us(ts) // 1000) AS tm, value, lag((epoch_us(ts) // 1000)) OVER (PARTITION BY user_id ORDER BY (epoch_us(ts) // 1000), event_id) AS before FROM events),
  n AS (SELECT *, sum(CASE WHEN before IS NULL OR tm - before > 14400000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY tm, event_id ROWS UNBOUNDED PRECEDING) AS session FROM s)
  SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS n, min(tm) AS start, max(tm) AS "end", round(sum(value), 2) AS total FROM n GROUP BY user_id, session""")
def session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    s = scans.sessions(e.withColumn("at", epoch_ms(e, "ts")), ["user_id"], "at", 4 * HOUR, "event_id")
    return s.groupBy("user_id", "session").agg(F.count("*").alias("n"), F.min("at").alias("start"), F.max("at").alias("end"), F.round(F.sum("value"), 2).alias("total"))


@query("""SELECT user_id, (epoch_us(ts) // 1000) // 86400000 * 86400000 AS start, count(*) AS n, round(sum(value), 2) AS total, count(DISTINCT event_type) AS kinds FROM events GROUP BY ALL""")
def tumbling_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    start = F.floor(epoch_ms(e, "ts") / 86400000) * 86400000
    return e.groupBy("user_id", start.alias("start")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"), F.countDistinct("event_type").alias("kinds"))


@query("""WITH w AS (SELECT event_type, value, ((epoch_us(ts) // 1000) // 43200000 - k) * 43200000 AS start FROM events, (SELECT unnest([0, 1]) AS k))
  SELECT event_type, start, count(*) AS n, max(value) AS most FROM w GROUP BY ALL""")
def sliding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    slot = F.floor(epoch_ms(e, "ts") / 43200000)
    every = e.withColumn("start", F.explode(F.array(slot * 43200000, (slot - 1) * 43200000)))
    return every.groupBy("event_type", "start").agg(F.count("*").alias("n"), F.max("value").alias("most"))


@query("""WITH o AS (SELECT user_id, value > 50 AS high, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
  g AS (SELECT user_id, i, i - row_number() OVER (PARTITION BY user_id ORDER BY i) AS island FROM o WHERE high)
  SELECT user_id, min(i) AS "first", max(i) AS "last", count(*) AS n FROM g GROUP BY user_id, island HAVING count(*) >= 3""")
def boolean_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("high", F.col("value") > 50)
    out = scans.runs(e, ["user_id"], ["ts", "event_id"], "high").where("n >= 3")
    return out.select("user_id", F.col("first").cast("long").alias("first"), F.col("last").cast("long").alias("last"), "n")


@query("""WITH o AS (SELECT user_id, event_id, row_number() OVER w AS i, count(*) OVER (PARTITION BY user_id) AS n, lag(event_type) OVER w AS before, lead(event_type) OVER w AS after
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
  SELECT user_id, event_id, before, after, CASE WHEN i = 1 THEN 'first' WHEN i = n THEN 'last' ELSE 'middle' END AS position,
    CASE WHEN n > 1 THEN floor((i - 1) / (n - 1) * 10000 + 0.5) / 10000 ELSE 0 END AS relative FROM o""")
def neighbours_and_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = scans.positions(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"])
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return e.select("user_id", "event_id", F.lag("event_type").over(w).alias("before"), F.lead("event_type").over(w).alias("after"), "position", rounded(F.col("relative")).alias("relative"))


@query("""WITH o AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)
  SELECT user_id, event_id, event_type FROM o WHERE before IS NULL OR before <> event_type""")
def change_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.changes(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "event_type").select("user_id", "event_id", "event_type")


@query(f"""WITH {RANGES} SELECT owner, id, coalesce(CAST(sum("end" - start + 1000) OVER (PARTITION BY owner ORDER BY start, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS "offset" FROM r""")
def running_placement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.placed(ranges(spark, sf_dir), ["owner"], ["start", "id"], F.col("end") - F.col("start"), 1000).select("owner", "id", F.col("offset").cast("long").alias("offset"))


@query("""WITH p AS (SELECT *, lag(event_type) OVER w IS NOT DISTINCT FROM event_type AND row_number() OVER w > 1 AS same FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
  n AS (SELECT *, sum(CASE WHEN same THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM p),
  k AS (SELECT *, count(*) OVER (PARTITION BY user_id, run) AS length, row_number() OVER (PARTITION BY user_id, run ORDER BY value DESC, event_id) AS place FROM n)
  SELECT user_id, event_id, CAST(run AS BIGINT) AS run, length FROM k WHERE place <= 2""")
def consecutive_role_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scans.role_runs(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "event_type")
    place = F.row_number().over(Window.partitionBy("user_id", "run").orderBy(F.col("value").desc(), "event_id"))
    return found.withColumn("place", place).where("place <= 2").select("user_id", "event_id", "run", F.col("run_length").alias("length"))


@query("""WITH f AS (SELECT user_id, event_type, min(ts) AS tm FROM events GROUP BY ALL)
  SELECT user_id, string_agg(event_type, ',' ORDER BY tm, event_type) AS kinds FROM f GROUP BY user_id""")
def distinct_in_first_seen_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scans.first_seen(table(spark, sf_dir, "events"), ["user_id"], F.col("ts"), "event_type")
    return out.select("user_id", F.array_join("values", ",").alias("kinds"))


@query("""WITH n AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL)
  SELECT user_id, arg_min(event_type, (-n, event_type)) AS value, max(n) AS n FROM n WHERE n > 1 GROUP BY user_id""")
def dominant_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.most_common(table(spark, sf_dir, "events"), ["user_id"], "event_type", 2)


@query("""WITH o AS (SELECT user_id, event_id, value, row_number() OVER w AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY value, event_id))
  SELECT user_id, event_id, CAST(floor(1200 + (12000 - 1200) * CASE WHEN n > 1 THEN (i - 1) / (n - 1) ELSE 0.5 END + 0.5) AS BIGINT) AS preferred_ms FROM o""")
def preferred_duration_by_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("value", "event_id")
    n = F.count("*").over(Window.partitionBy("user_id"))
    e = table(spark, sf_dir, "events").withColumn("i", F.row_number().over(w)).withColumn("n", n)
    rank = F.when(F.col("n") > 1, (F.col("i") - 1) / (F.col("n") - 1)).otherwise(0.5)
    return e.select("user_id", "event_id", F.floor(1200 + (12000 - 1200) * rank + 0.5).alias("preferred_ms"))


@query("""WITH o AS (SELECT user_id, event_id, value, sum(value) OVER w - value AS before, sum(value) OVER (PARTITION BY user_id) AS total FROM
    (SELECT user_id, event_id, ts, CAST(floor(value * 100 + 0.5) AS BIGINT) AS value FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))
  SELECT user_id, event_id, CASE WHEN before * 100 < 15 * total THEN 'opening' WHEN before * 100 < 80 * total THEN 'middle' ELSE 'ending' END AS segment FROM o""")
def arc_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("v", F.floor(F.col("value") * 100 + 0.5))
    before = F.sum("v").over(Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)) - F.col("v")
    total = F.sum("v").over(Window.partitionBy("user_id"))
    e = e.withColumn("before", before).withColumn("total", total)
    segment = F.when(F.expr("before * 100 < 15 * total"), "opening").when(F.expr("before * 100 < 80 * total"), "middle").otherwise("ending")
    return e.select("user_id", "event_id", segment.alias("segment"))


@query("""WITH e AS (SELECT l_orderkey AS source, l_partkey AS target, l_shipmode AS type, strength FROM (
    SELECT l_orderkey, l_partkey, l_returnflag AS l_shipmode, max(l_quantity) AS strength FROM lineitem GROUP BY ALL)),
  ends AS (SELECT *, source AS k, 's' AS side FROM e UNION ALL SELECT *, target, 't' FROM e),
  n AS (SELECT *, row_number() OVER (PARTITION BY k, type ORDER BY strength DESC, source, target) AS i FROM ends)
  SELECT DISTINCT source, target, type, strength FROM n WHERE i <= 8""")
def strongest_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("source"), F.col("l_partkey").alias("target"), F.col("l_returnflag").alias("type")).agg(F.max("l_quantity").alias("strength"))
    return scans.strongest(edges, 8)


@query("""WITH o AS (SELECT o_custkey, (epoch_us(o_orderdate) // 1000) AS start, o_orderkey, lag((epoch_us(o_orderdate) // 1000)) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS before FROM orders)
  SELECT o_custkey, o_orderkey, CASE WHEN before IS NULL THEN 'start' WHEN start = before THEN 'collision' WHEN start - before > 15552000000 THEN 'gap' ELSE 'ok' END AS state FROM o""")
def collisions_and_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    start, w = epoch_ms(o, "o_orderdate"), Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    o = o.withColumn("start", start).withColumn("before", F.lag("start").over(w))
    state = F.when(F.col("before").isNull(), "start").when(F.col("start") == F.col("before"), "collision").when(F.col("start") - F.col("before") > 15552000000, "gap").otherwise("ok")
    return o.select("o_custkey", "o_orderkey", state.alias("state"))
