"""Queries over events as rows for rules, judges and search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.numbers import rounded
from tidemark.operators import events as ev
from tidemark.operators import search
from tidemark.plans.registry import query, table
from tidemark.plans.texts import _CALIBRATED, _vectors


@query("""WITH e AS (SELECT user_id, event_id, ts, [event_type] AS places, CASE WHEN event_id % 3 = 0 THEN [] ELSE [CAST(event_id % 4 AS VARCHAR)] END AS people FROM events), w AS (SELECT *, coalesce(lag(places) OVER w, []) AS pp, coalesce(lag(people) OVER w, []) AS pq, row_number() OVER w AS position, count(*) OVER (PARTITION BY user_id) AS n FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
  SELECT user_id, event_id, CAST(len(list_filter(places, lambda x: NOT list_contains(pp, x))) AS BIGINT) AS new_places, CAST(len(list_filter(people, lambda x: NOT list_contains(pq, x))) AS BIGINT) AS new_people, CAST(position AS INTEGER) AS position, n FROM w""")
def rule_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = F.when(F.col("event_id") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array((F.col("event_id") % 4).cast("string")))
    e = table(spark, sf_dir, "events").withColumn("places", F.array("event_type")).withColumn("people", people)
    return ev.facts(e, ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "new_places", "new_people", "position", "n")


@query("""SELECT event_id, event_type || CASE WHEN event_id % 2 = 0 THEN ' even' ELSE '' END AS visual, CASE WHEN event_id % 3 = 0 THEN props END AS speech, array_to_string(list_transform(range(greatest(1, CAST(floor(3 * (event_id % 10) / 10 + 0.5) AS INTEGER))), lambda x: 'joy'), ' ') AS mood FROM events""")
def aspect_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    labels = F.array_compact(F.array(F.col("event_type"), F.when(F.col("event_id") % 2 == 0, "even")))
    speech = F.when(F.col("event_id") % 3 == 0, F.array("props"))
    mood = F.create_map(F.lit("joy"), (F.col("event_id") % 10) / 10)
    texts = ev.aspect_texts(labels, speech, F.array().cast("array<string>"), mood)
    return e.select("event_id", texts.alias("t")).select("event_id", *[F.try_element_at("t", F.lit(k)).alias(k) for k in ("visual", "speech", "mood")])


@query(r"""WITH t AS (SELECT event_id, concat_ws(' ', CASE WHEN event_id % 2 = 0 THEN event_type || ' said' END, '[' || props || ']', 'label') AS t FROM events), c AS (SELECT event_id, trim(regexp_replace(t, '\s+', ' ', 'g')) AS t FROM t)
  SELECT event_id, CASE WHEN length(t) > 24 THEN rtrim(t[:23]) || '…' ELSE t END AS description FROM c""")
def observed_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    speech = F.when(F.col("event_id") % 2 == 0, F.array(F.col("event_type"), F.lit("said"))).otherwise(F.array().cast("array<string>"))
    return table(spark, sf_dir, "events").select("event_id", ev.description(speech, F.array("props"), F.array(F.lit("label")), 24).alias("description"))


@query("""SELECT doc_id, CAST(CASE WHEN regexp_matches(lower(text), 'idiot|scum') THEN 1 ELSE 0 END + CASE WHEN regexp_matches(lower(text), 'license') THEN 1 ELSE 0 END AS INTEGER) AS axes FROM documents""")
def affect_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ev.affect(F.col("text"), {"anger": "idiot|scum", "calm": "license"})
    return table(spark, sf_dir, "documents").select("doc_id", F.size(F.map_keys(found)).alias("axes"))


@query("""WITH t AS (SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN upper(o_orderpriority) ELSE lower(o_orderpriority) END AS term FROM orders), o AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, lower(term) ORDER BY o_orderkey) AS n FROM t), k AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rank, count(*) OVER (PARTITION BY o_custkey) AS c FROM o WHERE n = 1)
  SELECT o_custkey, term, CAST(rank AS INTEGER) AS rank FROM k WHERE rank <= 3 AND c > 1""")
def label_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    term = F.when(F.col("o_orderkey") % 2 == 0, F.upper("o_orderpriority")).otherwise(F.lower("o_orderpriority"))
    return ev.vocabulary(table(spark, sf_dir, "orders").withColumn("term", term), ["o_custkey"], ["o_orderkey"], 3)


@query("""SELECT p_partkey, sha256('{"p_brand":"' || p_brand || '","p_name":"' || p_name || '","p_size":' || CAST(p_size AS VARCHAR) || '}') AS fingerprint FROM part""")
def content_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", ev.fingerprint("p_size", "p_name", "p_brand").alias("fingerprint"))


@query("""SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS k FROM events""")
def lenient_json_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    prose = F.when(F.col("event_id") % 5 != 0, F.concat(F.lit("Sure! ```json\n"), F.col("props"), F.lit("\n``` Done."))).otherwise("none {")
    return table(spark, sf_dir, "events").select("event_id", ev.lenient_json(prose, "k bigint")["k"].alias("k"))


@query("""WITH k AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) SELECT o_custkey, o_orderkey, o_totalprice FROM k WHERE n = 1""")
def latest_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.latest(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderdate", "o_orderkey").select("o_custkey", "o_orderkey", "o_totalprice")


@query("""WITH c AS (SELECT event_id, event_id % 4 AS track, event_id * 10 AS a, event_id * 10 + 3000 AS b, CASE WHEN event_id % 3 = 0 THEN 2.0 ELSE 1.0 END AS speed, CASE event_id % 5 WHEN 0 THEN 'wipe' WHEN 1 THEN 'dissolve' END AS transition FROM events)
  SELECT event_id, track < 2 AS kept, CAST(CASE WHEN speed <> 1 THEN a + 1500 ELSE b END AS BIGINT) AS out_ms, CASE WHEN transition = 'dissolve' THEN transition END AS transition,
    concat_ws(',', CASE WHEN speed <> 1 THEN 'speed' END, CASE WHEN transition = 'wipe' THEN 'transition' END, CASE WHEN track >= 2 THEN 'track' END) AS downgrades FROM c""")
def capability_negotiation(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    c = table(spark, sf_dir, "events").select(i, (i % 4).alias("track"), (i * 10).alias("in_ms"), (i * 10 + 3000).alias("out_ms"), F.when(i % 3 == 0, 2.0).otherwise(1.0).alias("speed"), F.when(i % 5 == 0, "wipe").when(i % 5 == 1, "dissolve").alias("transition"))
    return ev.negotiated(c, 2, False, ["dissolve"]).select("event_id", "kept", "out_ms", "transition", F.array_join("downgrades", ",").alias("downgrades"))


@query(f"""WITH {_CALIBRATED} SELECT count(*) AS queries, CAST(count_if(n >= 5 AND spread > 0 AND centre + 4 * spread > 1) AS BIGINT) AS undiscriminating, floor(median(centre) * 1000 + 0.5) / 1000 AS centre FROM c""")
def corpus_discrimination(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = search.vector_calibration(*_vectors(spark, sf_dir), "label")
    return c.agg(F.count("*").alias("queries"), F.count_if("undiscriminating").alias("undiscriminating"), rounded(F.percentile("centre", F.lit(0.5)), 3).alias("centre"))
