"""Queries over envelopes, chapters, reviews and annotations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.numbers import rounded
from tidemark.operators import review, signals
from tidemark.plans.registry import RANGES, query, ranges, table


def envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's values as a sampled level in dB."""
    hop = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return table(spark, sf_dir, "events").select("user_id", hop.cast("long").alias("hop"), (F.col("value") - 100).alias("db"))


_ENV = "v AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS hop, value - 100 AS db FROM events)"
_LEVELS = f"{_ENV}, h AS (SELECT user_id, list(db ORDER BY db) AS s FROM v GROUP BY user_id), q AS (SELECT user_id, s[CAST(floor((len(s) - 1) * 0.1 + 0.5) AS INTEGER) + 1] AS p10, s[CAST(floor((len(s) - 1) * 0.9 + 0.5) AS INTEGER) + 1] AS p90 FROM h), l AS (SELECT user_id, p10, p90, CASE WHEN p90 - p10 < 10 THEN least(-45, p10 - 1) ELSE p10 + least(8, 0.3 * (p90 - p10)) END AS threshold FROM q)"


@query(f"""WITH {_ENV} SELECT user_id, hop, floor(CASE WHEN hop = 0 THEN 0 ELSE greatest(0, greatest(-70, db) - lag(greatest(-70, db)) OVER (PARTITION BY user_id ORDER BY hop)) END * 10000 + 0.5) / 10000 AS onset FROM v""")
def onset_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.onsets(envelope(spark, sf_dir), ["user_id"], "db").select("user_id", "hop", rounded(F.col("onset")).alias("onset"))


@query(f"""WITH {_ENV}, x AS (SELECT *, db + 50 AS y, lag(db + 50) OVER (PARTITION BY user_id ORDER BY hop) AS p FROM v)
  SELECT user_id, CAST(hop // 10 AS BIGINT) AS block, floor(sqrt(avg(y * y)) * 10000 + 0.5) / 10000 AS rms, floor(avg(CASE WHEN p IS NOT NULL AND (y >= 0) <> (p >= 0) THEN 1 ELSE 0 END) * 10000 + 0.5) / 10000 AS zcr FROM x GROUP BY ALL""")
def hop_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = signals.crossings(envelope(spark, sf_dir).withColumn("y", F.col("db") + 50), ["user_id"], "y", 10)
    return out.select("user_id", "block", rounded(F.col("rms")).alias("rms"), rounded(F.col("zcr")).alias("zcr"))


@query(f"""WITH {_ENV} SELECT user_id, hop, max(db) OVER (PARTITION BY user_id ORDER BY hop ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS ahead FROM v""")
def change_in_next_second(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.change_ahead(envelope(spark, sf_dir), ["user_id"], "db", 10).select("user_id", "hop", "ahead")


@query(f"""WITH {_LEVELS}, f AS (SELECT v.user_id, hop, hop - row_number() OVER (PARTITION BY v.user_id ORDER BY hop) AS i FROM v JOIN l ON v.user_id = l.user_id AND db < threshold)
  SELECT user_id, min(hop) AS "first", max(hop) AS "last", count(*) AS n FROM f GROUP BY user_id, i HAVING count(*) >= 2""")
def silence_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.quiet_runs(envelope(spark, sf_dir), ["user_id"], "db", 2)


@query(f"""WITH {_ENV}, g AS (SELECT user_id, hop, hop - lag(hop) OVER (PARTITION BY user_id ORDER BY hop) AS d FROM v WHERE db >= -20), p AS (SELECT *, sum(CASE WHEN d IS NULL OR d > 3 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY hop ROWS UNBOUNDED PRECEDING) AS part FROM g)
  SELECT user_id, greatest(0, min(hop) - 1) AS "first", max(hop) + 1 AS "last" FROM p GROUP BY user_id, part""")
def voice_activity_stretches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.active_stretches(envelope(spark, sf_dir), ["user_id"], "db", F.lit(-20.0), 3, 1)


@query("""WITH x AS (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings), m AS (SELECT vec_id, avg(CAST(v AS DOUBLE)) AS mean, stddev_pop(CAST(v AS DOUBLE)) AS sd FROM x GROUP BY vec_id),
  z AS (SELECT vec_id, i, (v - mean) / sd AS z, row_number() OVER (PARTITION BY vec_id ORDER BY (v - mean) / sd DESC, i) AS k FROM x JOIN m USING (vec_id) WHERE (v - mean) / sd >= 1.8)
  SELECT vec_id, coalesce(string_agg('d' || lpad(CAST(i AS VARCHAR), 3, '0'), ',' ORDER BY k) FILTER (k <= 8), '') AS labels FROM (SELECT vec_id FROM embeddings) LEFT JOIN z USING (vec_id) GROUP BY vec_id""")
def zero_shot_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = [f"d{i:03d}" for i in range(1, 65)]
    return table(spark, sf_dir, "embeddings").select("vec_id", F.array_join(signals.labels_by_deviation(F.col("embedding"), names), ",").alias("labels"))


@query()
def recording_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's envelope against the next user's, as pairs of recordings of 500 hops at most."""
    e = envelope(spark, sf_dir).groupBy("user_id", F.floor(F.col("hop") / 500).alias("recording")).agg(F.transform(F.sort_array(F.collect_list(F.struct("hop", "db"))), lambda s: s["db"]).alias("a"))
    other = e.select((F.col("user_id") - 1).alias("user_id"), "recording", F.col("a").alias("b"))
    return signals.offsets(e.join(other, ["user_id", "recording"]), "a", "b", 20)


_EVENTS = f"{RANGES}, e AS (SELECT owner, id, start, \"end\", CASE WHEN kind <> 'error' THEN kind END AS place, id % 97 = 0 AS card FROM r), b AS (SELECT *, CASE WHEN lag(id) OVER w IS NULL OR card OR coalesce(start - lag(\"end\") OVER w >= 86400000, false) OR coalesce(lag(place) OVER w <> place, false) THEN 1 ELSE 0 END AS fresh FROM e WINDOW w AS (PARTITION BY owner ORDER BY start, id)), c AS (SELECT *, sum(fresh) OVER (PARTITION BY owner ORDER BY start, id ROWS UNBOUNDED PRECEDING) AS chapter FROM b)"


def _chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = ranges(spark, sf_dir).select("owner", "id", "start", "end", F.when(F.col("kind") != "error", F.col("kind")).alias("place"), (F.col("id") % 97 == 0).alias("card"))
    return review.chapter_breaks(e, ["owner"], 86400000)


@query(f"WITH {_EVENTS} SELECT owner, id, CAST(chapter AS BIGINT) AS chapter FROM c")
def chapter_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chapters(spark, sf_dir).select("owner", "id", "chapter")


@query(f"""WITH {_EVENTS}, s AS (SELECT *, count(*) OVER (PARTITION BY owner, chapter) AS n, bool_or(card) OVER (PARTITION BY owner, chapter) AS carded FROM c),
  k AS (SELECT owner, id, max(CASE WHEN n >= 2 OR carded OR chapter = 1 THEN chapter END) OVER (PARTITION BY owner ORDER BY chapter, start, id ROWS UNBOUNDED PRECEDING) AS into_ FROM s)
  SELECT owner, id, dense_rank() OVER (PARTITION BY owner ORDER BY into_) AS chapter FROM k""")
def chapters_folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.chapters_folded(_chapters(spark, sf_dir), ["owner"]).select("owner", "id", "chapter")


@query()
def chapters_limited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve chapters of each owner at most; tested against a loop over all boundaries."""
    return review.chapters_limited(review.chapters_folded(_chapters(spark, sf_dir), ["owner"]), "owner").select("owner", "id", "chapter")


@query("""WITH c AS (SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_extendedprice AS BIGINT) AS ms, l_returnflag AS place, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS position FROM lineitem),
  x AS (SELECT *, lag(place) OVER (PARTITION BY l_orderkey ORDER BY position) AS p, row_number() OVER (PARTITION BY l_orderkey, l_partkey ORDER BY position) AS s FROM c)
  SELECT l_orderkey, position AS id, unnest(list_filter([CASE WHEN ms < 5000 THEN 'too_short' END, CASE WHEN ms > 60000 THEN 'too_long' END, CASE WHEN p <> place THEN 'abrupt_location_change' END, CASE WHEN s > 1 THEN 'repetition' END], lambda v: v IS NOT NULL)) AS code FROM x""")
def plan_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    position = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"))
    line = table(spark, sf_dir, "lineitem").withColumn("position", position.cast("long"))
    clips = line.select("l_orderkey", "position", F.col("position").alias("id"), F.rint("l_extendedprice").cast("long").alias("ms"), F.col("l_returnflag").alias("place"), F.col("l_partkey").alias("event"))
    return review.reviewed(clips, ["l_orderkey"], 5000, 60000)


@query("""WITH s AS (SELECT l_partkey AS video, l_suppkey AS recorder, max(l_quantity) AS score, bool_or(l_returnflag = 'R' AND l_discount > 0.09) AS declared FROM lineitem GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY video ORDER BY declared DESC, score DESC, recorder) AS n FROM s)
  SELECT video, recorder, score, declared FROM k WHERE n = 1""")
def companion_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    declared = F.bool_or((F.col("l_returnflag") == "R") & (F.col("l_discount") > 0.09))
    s = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("video"), F.col("l_suppkey").alias("recorder")).agg(F.max("l_quantity").alias("score"), declared.alias("declared"))
    return review.companions(s)


@query(f"""WITH {RANGES} SELECT a.owner, a.id, b.id AS note FROM r a JOIN r b ON a.owner = b.owner AND a.start < b."end" AND b.start < a."end" WHERE a.kind <> 'error' AND b.kind = 'error'
  AND 2 * (least(a."end", b."end") - greatest(a.start, b.start)) >= least(a."end" - a.start, b."end" - b.start)""")
def annotations_on_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = ranges(spark, sf_dir).select("owner", "id", "start", "end", "kind")
    out = review.annotated(r.where("kind <> 'error'").drop("kind"), r.where("kind = 'error'").drop("kind"), ["owner"], 3600000)
    return out.select("owner", "id", F.col("r_id").alias("note"))


@query(r"""WITH t AS (SELECT conv_id, turn, CASE WHEN turn % 4 = 3 THEN 'x' ELSE text END AS text, (turn % 3 + 1) / 4 + 0.1 AS centre FROM conversations), l AS (SELECT *, len(regexp_split_to_array(trim(text), '\s+')) >= 3 AND centre >= 0.75 AS low FROM t),
  m AS (SELECT *, count(*) FILTER (low) OVER (PARTITION BY conv_id) AS n FROM l)
  SELECT conv_id, turn, CASE WHEN length(trim(text)) < 2 THEN 'junk' WHEN low AND n >= 2 THEN 'subtitle' ELSE 'scene' END AS text_role FROM m""")
def text_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    text = F.when(F.col("turn") % 4 == 3, "x").otherwise(F.col("text"))
    reads = c.select("conv_id", "turn", F.col("turn").alias("start"), text.alias("text"), ((F.col("turn") % 3 + 1) / 4 + 0.1).alias("centre"))
    return review.text_roles(reads, ["conv_id"], 2).select("conv_id", "turn", "text_role")


@query("""SELECT user_id, CASE WHEN count(*) FILTER (event_type = 'error') = 0 THEN 'standard' WHEN bool_and(value > 1) FILTER (event_type = 'error') THEN 'degraded' ELSE 'offline_minimal' END AS tier FROM events GROUP BY user_id""")
def analysis_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("user_id").agg(review.tier(F.col("event_type") == "error", F.col("value") > 1).alias("tier"))
