"""Queries on recordings that heard one moment. Each user is a recording, ten users are a project; every fifth user is a recorder
that heard what the next user's camera did, some hops later and with sounds of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.time import epoch_ms
from tidemark.operators import sync
from tidemark.plans.registry import query, table

CAP = 24

_ASSETS = """e AS (SELECT user_id, event_id, event_type, value, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS hop FROM events),
assets AS (SELECT user_id // 10 AS project, user_id AS id, CASE WHEN user_id % 5 = 0 THEN 'audio' ELSE 'video' END AS kind, count(*) * 60000 AS ms, CASE WHEN user_id % 4 <> 1 THEN min(epoch_us(ts) // 1000) END AS start, user_id % 9 <> 8 AS has_audio FROM e GROUP BY user_id)"""
_PAIRS = f"""{_ASSETS}, heard AS (SELECT * FROM assets WHERE has_audio),
met AS (SELECT r.project, r.id AS asset, v.id AS reference, 0 AS late FROM heard r JOIN heard v ON r.project = v.project AND r.kind = 'audio' AND v.kind = 'video'
  UNION ALL SELECT a.project, b.id, a.id, 1 FROM heard a JOIN heard b ON a.project = b.project AND a.kind = 'video' AND b.kind = 'video' AND a.id < b.id AND a.start - 60000 < b.start + b.ms AND b.start - 60000 < a.start + a.ms),
placed AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY late, CASE late WHEN 0 THEN asset ELSE reference END, CASE late WHEN 0 THEN reference ELSE asset END) - 1 AS place FROM met)"""
#: What a recorder hears, and the rise of each level over the one before.
_ONSETS = """env AS (SELECT user_id AS asset, hop, value - 100 AS db FROM e WHERE user_id % 5 <> 0
  UNION ALL SELECT r.user_id, r.hop, 0.9 * coalesce(v.value, 0) + 0.1 * r.value - 100 FROM e r LEFT JOIN e v ON v.user_id = r.user_id + 1 AND v.hop = r.hop + r.user_id % 13 - 6 WHERE r.user_id % 5 = 0),
ons AS (SELECT asset, hop, coalesce(greatest(0, greatest(-70, db) - lag(greatest(-70, db)) OVER (PARTITION BY asset ORDER BY hop)), 0) AS onset FROM env)"""


def recordings(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Assets, and their onset envelopes."""
    e = table(spark, sf_dir, "events")
    e = e.withColumn("ms", epoch_ms(e, "ts")).withColumn("hop", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1)
    u = F.col("user_id")
    assets = e.groupBy("user_id").agg((F.count("*") * 60000).alias("ms"), F.min("ms").alias("first"))
    assets = assets.select(F.floor(u / 10).alias("project"), u.alias("id"), F.when(u % 5 == 0, "audio").otherwise("video").alias("kind"), "ms", F.when(u % 4 != 1, F.col("first")).alias("start"), (u % 9 != 8).alias("has_audio"))
    own = e.select(u.alias("asset"), F.col("hop").cast("long").alias("hop"), "value")
    shift = F.col("asset") % 13 - 6
    heard = own.select((F.col("asset") - 1).alias("asset"), "hop", F.col("value").alias("v")).where("asset % 5 = 0").withColumn("hop", F.col("hop") - shift)
    recorder = own.where("asset % 5 = 0").join(heard, ["asset", "hop"], "left").select("asset", "hop", (0.9 * F.coalesce("v", F.lit(0.0)) + 0.1 * F.col("value") - 100).alias("db"))
    env = own.where("asset % 5 <> 0").select("asset", "hop", (F.col("value") - 100).alias("db")).unionByName(recorder)
    held = F.greatest(F.lit(-70.0), "db")
    before = F.lag(held).over(Window.partitionBy("asset").orderBy("hop"))
    return assets, env.select("asset", "hop", F.coalesce(F.greatest(F.lit(0.0), held - before), F.lit(0.0)).alias("onset"))


@query(f"""WITH {_PAIRS} SELECT project, asset, reference, CAST(place AS BIGINT) AS place FROM placed WHERE place < {CAP}""")
def sync_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sync.sync_candidates(recordings(spark, sf_dir)[0], ["project"], CAP, width=86400000)


@query(f"""WITH {_PAIRS} SELECT project, count(*) AS pairs, greatest(0, count(*) - {CAP}) AS skipped FROM placed GROUP BY project""")
def skipped_sync_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sync.skipped_pairs(recordings(spark, sf_dir)[0], ["project"], CAP, width=86400000).where("pairs > 0")


#: Direct sums over all lags. Hops last a minute here.
_SYNCS = f"""{_PAIRS}, {_ONSETS}, st AS (SELECT asset, count(*) AS n, avg(onset) AS mean, sqrt(var_pop(onset) * count(*)) AS norm FROM ons GROUP BY asset),
x AS (SELECT o.asset, hop, n, (onset - mean) / norm AS x FROM ons o JOIN st ON st.asset = o.asset AND norm > 0),
cc AS (SELECT p.asset, p.reference, any_value(b.n) AS n, any_value(a.n) AS rn, a.hop - b.hop AS lag, sum(a.x * b.x) AS c FROM placed p JOIN x b ON b.asset = p.asset JOIN x a ON a.asset = p.reference WHERE place < {CAP} GROUP BY p.asset, p.reference, a.hop - b.hop),
pk AS (SELECT asset, reference, any_value(n) AS n, any_value(rn) AS rn, max(c) AS peak, arg_max(lag, struct_pack(c := c, l := -lag)) AS lag FROM cc GROUP BY asset, reference),
ab AS (SELECT p.*, max(c.c) FILTER (abs(c.lag - p.lag) > 2) AS rival, coalesce(max(c.c) FILTER (c.lag = p.lag - 1), 0) AS lo, coalesce(max(c.c) FILTER (c.lag = p.lag + 1), 0) AS hi FROM pk p JOIN cc c ON c.asset = p.asset AND c.reference = p.reference GROUP BY ALL),
of AS (SELECT *, CAST(floor((lag + CASE WHEN lo - 2 * peak + hi < 0 THEN 0.5 * (lo - hi) / (lo - 2 * peak + hi) ELSE 0 END) * 60000 + 0.5) AS BIGINT) AS offset_ms, peak / rival AS ratio FROM ab WHERE peak > 0 AND rival > 0),
syncs AS (SELECT asset, reference, offset_ms, floor(ratio * 100 + 0.5) / 100 AS score, floor(least(1, 0.5 + (ratio - 1.5) / 5) * 1000 + 0.5) / 1000 AS confidence FROM of WHERE ratio >= 1.5 AND least(rn * 60000, offset_ms + n * 60000) - greatest(0, offset_ms) >= 1000)"""


def _syncs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    assets, onsets = recordings(spark, sf_dir)
    pairs = sync.sync_candidates(assets, ["project"], CAP, width=86400000)
    return assets, sync.measured_offsets(onsets, pairs, hop_ms=60000, block=64)


@query(f"""WITH {_SYNCS} SELECT * FROM syncs""")
def recording_syncs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _syncs(spark, sf_dir)[1]


@query(f"""WITH {_SYNCS}, fit AS (SELECT v.id AS video, r.id AS recorder, offset_ms, score, asset % 25 = 0 AS declared, v.ms AS vms, greatest(0, offset_ms) AS a, least(v.ms, offset_ms + r.ms) AS b FROM syncs JOIN assets r ON r.id = asset AND r.kind = 'audio' JOIN assets v ON v.id = reference AND v.kind = 'video' WHERE confidence > 0),
one AS (SELECT *, row_number() OVER (PARTITION BY video ORDER BY declared DESC, score DESC, recorder) AS n FROM fit WHERE CASE WHEN declared THEN b > a ELSE b - a >= 0.5 * vms END),
comp AS (SELECT * FROM one WHERE n = 1),
said AS (SELECT user_id AS asset, event_id AS id, hop * 60000 AS start, hop * 60000 + 30000 + CAST(floor(value * 500) AS BIGINT) AS "end" FROM e WHERE event_type <> 'error')
SELECT s.asset, CAST(s.id AS VARCHAR) AS id, s.start, s."end", 3 AS words FROM said s LEFT JOIN comp c ON c.video = s.asset WHERE c.video IS NULL OR s."end" <= a OR s.start >= b
UNION ALL SELECT c.video, s.id || '-on-' || c.video, greatest(a, s.start + offset_ms), least(b, s."end" + offset_ms), len(list_filter([0, 1, 2], lambda k: s.start + k * 10000 + offset_ms >= a AND s.start + k * 10000 + 9000 + offset_ms <= b))
  FROM said s JOIN comp c ON c.recorder = s.asset WHERE s."end" + offset_ms > a AND s.start + offset_ms < b""")
def companion_speech(spark: SparkSession, sf_dir: str) -> DataFrame:
    assets, syncs = _syncs(spark, sf_dir)
    companions = sync.audio_companions(syncs.withColumn("declared", F.col("asset") % 25 == 0), assets)
    e = table(spark, sf_dir, "events").withColumn("hop", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1).where("event_type <> 'error'")
    start = F.col("hop").cast("long") * 60000
    said = e.select(F.col("user_id").alias("asset"), F.col("event_id").cast("string").alias("id"), start.alias("start"), (start + 30000 + F.floor(F.col("value") * 500)).alias("end"))
    words = F.array(*[F.struct((F.col("start") + k * 10000).alias("start"), (F.col("start") + k * 10000 + 9000).alias("end"), F.lit(f"w{k}").alias("word")) for k in range(3)])
    out = sync.with_companion_speech(said.withColumn("words", words), companions)
    return out.select("asset", "id", "start", "end", F.size("words").cast("long").alias("words"))
