"""Queries over recorded observations, files, segments, streams and sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.numbers import clamp, rounded
from tidemark.operators import intervals as iv
from tidemark.operators import planner, segments
from tidemark.operators.components import checkpoint_folder
from tidemark.plans.registry import RANGES, merged, query, ranges, table
from tidemark.sources import files, writers
from tidemark.streaming import windows


def _folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one."""
    return f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query("""SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'video' WHEN page_id % 4 = 1 THEN 'audio' END AS kind FROM pages""")
def media_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.regexp_replace("url", r"[?#].*$", "")
    name = F.when(F.col("page_id") % 4 == 0, "/a.b.mp4").when(F.col("page_id") % 4 == 1, "/c.WAV").when(F.col("page_id") % 4 == 2, "/.hidden.mov").otherwise("/d.html")
    return table(spark, sf_dir, "pages").select("page_id", files.kind_of(F.concat(url, name)).alias("kind"))


@query("""WITH d AS (SELECT doc_id, md5(text) AS sha256, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) AS n FROM documents)
  SELECT doc_id, sha256 FROM d WHERE n = 1 AND sha256 NOT IN (SELECT md5(text) FROM documents WHERE doc_id % 10 = 0)""")
def register_by_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("sha256"))
    return files.registered(d.where("doc_id % 10 = 0"), d, order="doc_id")


@query("""SELECT l_orderkey, l_linenumber, CAST(floor(l_extendedprice / 100 * 1000 + 0.5) AS BIGINT) AS duration_ms, CAST(1920 AS INTEGER) AS width, floor(30000 / 1001 * 1000 + 0.5) / 1000 AS fps, l_tax > 0.03 AS variable, 'video' AS kind
  FROM (SELECT *, row_number() OVER () FROM lineitem)""")
def probe_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    measured = F.when(F.col("l_tax") > 0.03, F.lit("25/1")).otherwise(F.lit("30000/1001"))
    video = F.struct(F.lit("video").alias("codec_type"), F.lit(1920).alias("width"), F.lit("30000/1001").alias("r_frame_rate"), measured.alias("avg_frame_rate"))
    document = F.to_json(F.struct(F.array(video).alias("streams"), F.struct((F.col("l_extendedprice") / 100).cast("string").alias("duration")).alias("format")))
    return files.probed(line.withColumn("probe", document)).select("l_orderkey", "l_linenumber", "duration_ms", "width", "fps", "variable", "kind")


@query("""WITH w AS (SELECT conv_id, turn, unnest(string_split(text, ' ')) AS word, generate_subscripts(string_split(text, ' '), 1) - 1 AS i FROM conversations),
  t AS (SELECT conv_id, turn, i, trim(word) AS word, i * 400 + (i // 12) * 2500 AS start, i * 400 + (i // 12) * 2500 + 300 AS "end", i // 12 AS part FROM w)
  SELECT conv_id, turn, min(start) AS start, max("end") AS "end", string_agg(word, ' ' ORDER BY i) AS text, 0.75 AS confidence FROM t GROUP BY conv_id, turn, part""")
def transcript_utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    at = lambda i: i * 0.4 + F.floor(i / 12) * 2.5
    words = F.transform(F.split("text", " "), lambda w, i: F.struct(at(i).alias("start"), (at(i) + 0.3).alias("end"), w.alias("word")))
    segment = F.struct(F.lit(0.0).alias("start"), F.lit(0.0).alias("end"), F.col("text"), F.lit(-0.25).alias("avg_logprob"), words.alias("words"))
    return files.utterances(c.withColumn("transcript", F.to_json(F.struct(F.array(segment).alias("segments")))), ["conv_id", "turn"]).select("conv_id", "turn", "start", "end", "text", "confidence")


@query("""WITH o AS (SELECT user_id, (epoch_us(ts) // 1000) % 86400000 AS tm FROM events WHERE event_type = 'view') SELECT user_id, count(*) AS n, min(tm) AS "first" FROM o GROUP BY user_id""")
def replay_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the events as recorded shots, a replay bundle per user, and reads them back."""
    from tidemark.functions.time import epoch_ms

    e = table(spark, sf_dir, "events")
    at = epoch_ms(e, "ts") % 86400000
    shot = F.struct(at.alias("start_ms"), (at + 1000).alias("end_ms"), at.alias("representative_frame_ms"), F.lit(0.5).alias("change_score"))
    shots = e.where("event_type = 'view'").groupBy("user_id").agg(F.sort_array(F.collect_list(shot)).alias("shots"))
    observed = F.struct(F.struct(F.lit("cut").alias("model"), F.col("shots")).alias("detect_shots"))
    bundles = shots.select(F.to_json(F.struct(F.create_map(F.col("user_id").cast("string"), observed).alias("assets"))).alias("value"))
    path = _folder(spark, "replay")
    bundles.write.option("maxRecordsPerFile", 1).text(path)
    out = files.replay(spark, path).select(F.col("asset").cast("long").alias("user_id"), F.explode("detect_shots.shots").alias("s"))
    return out.groupBy("user_id").agg(F.count("*").alias("n"), F.min("s.start_ms").alias("first"))


@query(f"""WITH {RANGES}, {merged('m', "kind = 'view'", 1000)}, n AS (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY start, "end") AS i FROM (SELECT owner, start % 86400000 AS start, start % 86400000 + least(5000, "end" - start) AS "end", n FROM m))
  SELECT owner, CAST(i AS INTEGER) AS n, CAST(i AS VARCHAR) || chr(10) || strftime(make_timestamp(start * 1000), '%H:%M:%S,%g') || ' --> ' || lpad(CAST("end" // 3600000 AS VARCHAR), 2, '0') || ':' || lpad(CAST("end" // 60000 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST("end" // 1000 % 60 AS VARCHAR), 2, '0') || ',' || lpad(CAST("end" % 1000 AS VARCHAR), 3, '0') || chr(10) || 'x' || CAST(n AS VARCHAR) || chr(10) AS block FROM n""")
def caption_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = iv.union(ranges(spark, sf_dir).where("kind = 'view'"), ["owner"], 1000)
    day = F.col("start") % 86400000
    cues = m.select("owner", day.alias("start"), (day + F.least(F.lit(5000), F.col("end") - F.col("start"))).alias("end"), F.concat(F.lit("x"), F.col("n").cast("string")).alias("text"))
    return writers.caption_blocks(cues, ["owner"])


@query()
def chapter_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = planner.bounded_plans(ranges(spark, sf_dir), "owner", "start", 10 * 86400000)
    first = F.min("start").over(Window.partitionBy("plan"))
    out = writers.chapter_lines(r.select("plan", (F.col("start") - first).alias("start"), F.col("kind").alias("title")), "plan", 3600000)
    return out.select("plan", "n", writers.chapter_line(F.col("start"), F.col("title")).alias("line"))


@query("""WITH c AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY start, id) AS n FROM (SELECT o_custkey, o_orderkey AS id, o_orderkey * 40 AS start, o_orderkey % 100 * 1000 AS a, o_orderkey % 100 * 1000 + 2000 AS b, replace(o_orderpriority, '-', '') AS source FROM orders)), f AS (SELECT *, [a, b, start, start + 2000] AS t FROM c)
  SELECT o_custkey, CAST(n AS INTEGER) AS n, lpad(CAST(n AS VARCHAR), 3, '0') || ' ' || rpad(upper(regexp_replace(source, '[^A-Za-z0-9]', '', 'g'))[:8], 8, ' ') || ' V     C        ' ||
    array_to_string(list_transform(t, lambda x: lpad(CAST((x * 30 + 500) // 1000 // 108000 AS VARCHAR), 2, '0') || ':' || lpad(CAST((x * 30 + 500) // 1000 // 1800 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST((x * 30 + 500) // 1000 // 30 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST((x * 30 + 500) // 1000 % 30 AS VARCHAR), 2, '0')), ' ') AS line FROM f""")
def edit_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    clips = o.select("o_custkey", k.alias("id"), (k * 40).alias("start"), (k % 100 * 1000).alias("in_ms"), (k % 100 * 1000 + 2000).alias("out_ms"), F.col("o_orderpriority").alias("source"))
    return writers.edit_lines(clips, ["o_custkey"])


@query("""WITH RECURSIVE o AS (SELECT user_id, epoch_us(ts) // 1000 AS tm, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
  k AS (SELECT user_id, i, tm, tm AS kept FROM o WHERE i = 1 UNION ALL SELECT o.user_id, o.i, o.tm, CASE WHEN o.tm - k.kept >= 14400000 THEN o.tm ELSE k.kept END FROM k JOIN o ON o.user_id = k.user_id AND o.i = k.i + 1),
  s AS (SELECT DISTINCT user_id, kept AS start FROM k) SELECT user_id, start, lead(start) OVER (PARTITION BY user_id ORDER BY start) AS "end" FROM s""")
def shots_from_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.functions.time import epoch_ms

    e = table(spark, sf_dir, "events")
    return segments.thinned(e.select("user_id", epoch_ms(e, "ts").alias("at")), ["user_id"], "at", 14400000)


@query(f"""WITH {RANGES}, s AS (SELECT owner, id, start, "end", unnest(range(0, greatest(1, ("end" - start) // 1800000 + CASE WHEN ("end" - start) % 1800000 >= 60000 THEN 1 ELSE 0 END))) AS k FROM r)
  SELECT owner, id, k AS part, start + k * 1800000 AS start, CASE WHEN k = max(k) OVER (PARTITION BY id) THEN "end" ELSE start + (k + 1) * 1800000 END AS "end" FROM s""")
def fixed_atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.atoms(ranges(spark, sf_dir).select("owner", "id", "start", "end"), 1800000, 60000)


@query()
def merged_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = planner.bounded_plans(ranges(spark, sf_dir), "owner", "start", 10 * 86400000)
    return segments.merged(r.select("plan", "start", "end", (F.col("value") / 500).alias("separation")), "plan", 3600000, 14400000, 0.38)


@query("""WITH b AS (SELECT user_id, event_type, CAST(floor(epoch_us(ts) / 1000000 / 21600) AS BIGINT) * 21600 AS start, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL) SELECT event_type, start, CAST(sum(n) AS BIGINT) AS n, round(sum(total), 2) AS total FROM b GROUP BY ALL""")
def streaming_tumbling_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{sf_dir}/events.parquet"
    stream = _stream(spark, path)
    out = windows.tumbling(stream, "ts", ["event_type"], "value", "6 hours", "60 days")
    done = windows.run_available(out, _folder(spark, "tumbling-rows"), _folder(spark, "tumbling"), ["event_type", "start"])
    return done.select("event_type", F.unix_timestamp("start").alias("start"), "n", F.round("total", 2).alias("total"))


def _stream(spark: SparkSession, path: str) -> DataFrame:
    """A table as a stream of its files, with ``ts`` as an instant."""
    frame = spark.read.parquet(path)
    # A single file is read by its folder and name, a folder of files as it is.
    whole = [f for f in frame.inputFiles() if f.rstrip("/").endswith(path.rstrip("/").rsplit("/", 1)[-1])]
    folder, name = path.rsplit("/", 1)
    source = spark.readStream.schema(frame.schema)
    stream = source.option("pathGlobFilter", name).parquet(folder) if whole else source.parquet(path)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


@query("""WITH s AS (SELECT user_id, epoch_us(ts) AS tm, value, lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM events), n AS (SELECT *, sum(CASE WHEN before IS NULL OR tm - before > 14400000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY tm ROWS UNBOUNDED PRECEDING) AS k FROM s)
  SELECT user_id, count(*) AS n, round(sum(value), 2) AS total FROM n GROUP BY user_id, k""")
def streaming_session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = windows.sessions(_stream(spark, f"{sf_dir}/events.parquet"), "ts", ["user_id"], "value", "4 hours", "60 days")
    done = windows.run_available(out, _folder(spark, "session-rows"), _folder(spark, "sessions"), ["user_id", "start"], "complete")
    return done.select("user_id", "n", F.round("total", 2).alias("total"))


@query("""WITH w AS (SELECT event_type, value, (epoch_us(ts) // 1000000 // 43200 - k) * 43200 AS start FROM events, (SELECT unnest([0, 1]) AS k))
  SELECT event_type, start, count(*) AS n, round(sum(value), 2) AS total FROM w GROUP BY ALL""")
def streaming_sliding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = windows.sliding(_stream(spark, f"{sf_dir}/events.parquet"), "ts", ["event_type"], "value", "24 hours", "12 hours", "60 days")
    done = windows.run_available(out, _folder(spark, "sliding-rows"), _folder(spark, "sliding"), ["event_type", "start"])
    return done.select("event_type", F.unix_timestamp("start").alias("start"), "n", F.round("total", 2).alias("total"))


@query("""WITH k AS (SELECT DISTINCT event_type, user_id % 10 AS version FROM events), c AS (SELECT DISTINCT event_type, user_id % 10 AS version FROM events WHERE user_id % 10 < 7) SELECT * FROM k EXCEPT SELECT * FROM c""")
def cache_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = table(spark, sf_dir, "events").select("event_type", (F.col("user_id") % 10).alias("version")).distinct().withColumn("key", windows.cache_key("event_type", "version"))
    return windows.missing(k, k.where("version < 7"), ["key"]).drop("key")


@query("""WITH a AS (SELECT user_id, count(*) FILTER (event_type = 'view') AS cuts, avg(value) AS mean, max(value) AS longest, count(*) AS n FROM events GROUP BY user_id)
  SELECT user_id, CASE WHEN n < 5 THEN 'still' WHEN cuts >= 15 AND mean <= 50 THEN 'edited' WHEN longest <= 200 THEN 'clip' ELSE 'raw' END AS material, floor(greatest(0, least(1, cuts / n)) * 1000 + 0.5) / 1000 AS share FROM a""")
def material_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "view").alias("cuts"), F.avg("value").alias("mean"), F.max("value").alias("longest"), F.count("*").alias("n"))
    kind = F.when(F.col("n") < 5, "still").when((F.col("cuts") >= 15) & (F.col("mean") <= 50), "edited").when(F.col("longest") <= 200, "clip").otherwise("raw")
    return a.select("user_id", kind.alias("material"), rounded(clamp(F.col("cuts") / F.col("n")), 3).alias("share"))


@query("""SELECT doc_id, CASE WHEN regexp_matches(lower(text), 'password|token|secret') THEN 'secret' WHEN regexp_matches(lower(text), 'license') THEN 'legal' WHEN length(text) < 200 THEN 'b_roll' ELSE 'moment' END AS event_type FROM documents""")
def event_type_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.lower("text")
    kind = segments.first_matching(t, [("password|token|secret", "secret"), ("license", "legal")])
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce(kind, F.when(F.length("text") < 200, "b_roll"), F.lit("moment")).alias("event_type"))
