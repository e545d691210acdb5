"""Queries on frames, which are vectors' entries as grey levels, and on events as they are listed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators import pictures, summaries
from tidemark.plans.registry import RANGES, query, ranges, table

_GREY = """g AS (SELECT label % 3 AS asset, row_number() OVER (PARTITION BY label % 3 ORDER BY vec_id) - 1 AS hop, list_transform(embedding, lambda x: CASE WHEN vec_id % 40 < 8 THEN 3 WHEN vec_id % 40 < 20 THEN 90 ELSE greatest(0, least(255, CAST(floor(CAST(x AS DOUBLE) * 200) AS BIGINT) + 100)) END) AS v FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
px AS (SELECT asset, hop, unnest(v) AS x, unnest(lag(v) OVER (PARTITION BY asset ORDER BY hop)) AS y, unnest(range(0, 64)) AS i FROM g),
cell AS (SELECT asset, hop, avg(abs(x - y)) AS d FROM px GROUP BY asset, hop, i // 16, i % 8 // 2), mv AS (SELECT asset, hop, max(d) AS motion FROM cell GROUP BY asset, hop),
st AS (SELECT g.asset, g.hop, list_avg(v) AS luma, list_sort(v)[63] AS peak, coalesce(motion, lead(motion) OVER (PARTITION BY g.asset ORDER BY g.hop), 0) AS motion FROM g JOIN mv ON mv.asset = g.asset AND mv.hop = g.hop)"""


def _statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").where((F.size("embedding") == 64) & F.forall("embedding", lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False))))
    n = F.col("vec_id") % 40
    level = F.transform("embedding", lambda x: F.when(n < 8, 3).when(n < 20, 90).otherwise(F.greatest(F.lit(0), F.least(F.lit(255), F.floor(x.cast("double") * 200) + 100))).cast("int"))
    hop = F.row_number().over(Window.partitionBy(F.col("label") % 3).orderBy("vec_id")) - 1
    grey = F.unhex(F.array_join(F.transform(level, lambda v: F.lpad(F.hex(v), 2, "0")), ""))
    return pictures.frame_statistics(e.select((F.col("label") % 3).alias("asset"), hop.cast("long").alias("hop"), grey.alias("grey")), ["asset"], 8, 8, (4, 4))


@query(f"""WITH {_GREY} SELECT asset, hop, luma, CAST(peak AS INTEGER) AS peak, motion FROM st""")
def frame_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _statistics(spark, sf_dir)


@query(f"""WITH {_GREY}, r AS (SELECT asset, hop, motion, 'static' AS kind FROM st WHERE motion < 0.5 UNION ALL SELECT asset, hop, motion, 'black' FROM st WHERE peak < 24), i AS (SELECT *, hop - row_number() OVER (PARTITION BY asset, kind ORDER BY hop) AS island FROM r),
  e AS (SELECT asset, kind, min(hop) * 250 AS start, (max(hop) + 1) * 250 AS "end", avg(motion) AS m FROM i GROUP BY asset, kind, island)
  SELECT asset, start, "end", kind, CASE kind WHEN 'black' THEN 0.9 ELSE floor(greatest(0.5, least(0.95, 1 - m / 0.5)) * 1000 + 0.5) / 1000 END::DOUBLE AS confidence FROM e WHERE "end" - start >= CASE kind WHEN 'black' THEN 400 ELSE 750 END""")
def picture_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pictures.picture_events(_statistics(spark, sf_dir), ["asset"], 250, least_static=750)


@query("""WITH e AS (SELECT event_id AS id, user_id AS chapter, event_id * 997 AS a, event_id * 997 + CAST(floor(value * 100) AS BIGINT) AS b, event_type, value FROM events),
  t AS (SELECT *, lpad(CAST(a // 3600000 AS VARCHAR), CAST(greatest(2, length(CAST(a // 3600000 AS VARCHAR))) AS INTEGER), '0') || ':' || lpad(CAST(a // 60000 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(a // 1000 % 60 AS VARCHAR), 2, '0') || '.' || lpad(CAST(a % 1000 AS VARCHAR), 3, '0') AS start,
    lpad(CAST(b // 3600000 AS VARCHAR), CAST(greatest(2, length(CAST(b // 3600000 AS VARCHAR))) AS INTEGER), '0') || ':' || lpad(CAST(b // 60000 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(b // 1000 % 60 AS VARCHAR), 2, '0') || '.' || lpad(CAST(b % 1000 AS VARCHAR), 3, '0') AS "end" FROM e)
  SELECT id, chapter, start, "end", b - a AS duration_ms, event_type, CASE WHEN id % 3 = 0 THEN 'context' ELSE 'hook' END AS role, CASE WHEN id % 3 = 0 THEN 0.5 ELSE value / 500 END AS importance, 0.5::DOUBLE AS emotion, id % 7 = 0 AS essential, CASE WHEN id % 4 > 0 THEN (id % 4) / 4 END AS inactive_ratio, array_to_string(list_distinct_(id), ',') AS sound, CASE WHEN id % 3 = 0 THEN 0 ELSE 1 END AS n_metrics FROM t""".replace("array_to_string(list_distinct_(id), ',')", "CASE WHEN id % 2 = 0 THEN 'music' ELSE 'music,speech' END"))
def inspected_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, none = table(spark, sf_dir, "events"), F.array().cast("array<string>")
    start = F.col("event_id") * 997
    rows = e.select(
        F.col("event_id").alias("id"), F.col("user_id").alias("chapter"), start.alias("start"), (start + F.floor(F.col("value") * 100)).alias("end"), F.lit("").alias("description"), "event_type", (F.col("event_id") % 7 == 0).alias("essential"), F.lit(0.9).alias("confidence"), (F.col("event_id") % 4 / 4).alias("inactive_ratio"),
        *[none.alias(c) for c in ("speech", "on_screen_text", "seen", "people", "places", "topics", "notes")], F.when(F.col("event_id") % 2 == 0, F.array(F.lit("music"), F.lit("music"))).otherwise(F.array(F.lit("music"), F.lit("speech"), F.lit("music"))).alias("sound"), F.create_map().cast("map<string,double>").alias("affect"), F.lit(False).alias("excluded"),
    )
    judged = e.where("event_id % 3 <> 0").select(F.col("event_id").alias("id"), F.lit("hook").alias("role"), F.create_map(F.lit("story_importance"), F.col("value") / 500).alias("metrics"), *[F.create_map().cast("map<string,double>").alias(c) for c in ("flags", "probabilities")], F.lit(None).cast("string").alias("rationale"))
    out = summaries.event_details(rows, judged, "full")
    return out.select("id", "chapter", "start", "end", "duration_ms", "event_type", "role", "importance", "emotion", "essential", "inactive_ratio", F.array_join("sound", ",").alias("sound"), F.size("metrics").alias("n_metrics"))


@query(f"""WITH {RANGES} SELECT 'total_media_duration_ms' AS figure, CAST(sum(p_size) AS DOUBLE) AS value FROM part UNION ALL SELECT 'mean_event_duration_ms', floor(avg("end" - start) + 0.5) FROM r UNION ALL SELECT 'total_cost_usd', CAST(sum(l_linenumber) AS DOUBLE) FROM lineitem
  UNION ALL SELECT 'asset_count', count(*) FROM part UNION ALL SELECT 'event_count', count(*) FROM r UNION ALL SELECT 'chapter_count', count(DISTINCT owner) FROM r UNION ALL SELECT 'utterance_count', count(*) FROM conversations""")
def analysis_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, p = ranges(spark, sf_dir), table(spark, sf_dir, "part")
    counted = {"asset": p, "event": r, "chapter": r.select("owner").distinct(), "utterance": table(spark, sf_dir, "conversations")}
    return summaries.analysis_figures(counted, p.select(F.col("p_size").alias("ms")), r.select((F.col("end") - F.col("start")).alias("ms")), table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").cast("double").alias("cost")))
