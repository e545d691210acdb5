"""Queries on what users declared: names taken from some turns and looked for in all, and annotations made from line items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import knowledge
from tidemark.plans.registry import query, table
from tidemark.plans.texts import _NORM

_ENTITIES = f"""said AS (SELECT conv_id * 1000 + turn AS id, ' ' || {_NORM.format("text")} || ' ' AS s FROM conversations),
toks AS (SELECT conv_id, string_split(trim({_NORM.format("text")}), ' ') AS w FROM conversations WHERE turn = 0 AND conv_id % 7 = 0),
ents AS (SELECT 'person' || conv_id AS entity, 'people' AS kind, conv_id AS place, unnest(['person' || conv_id, w[1] || ' ' || w[2], w[5]]) AS form FROM toks WHERE len(w) >= 5
  UNION ALL SELECT n_name, 'places', n_nationkey, trim(lower(n_name)) FROM nation UNION ALL SELECT 'spot' || conv_id, 'places', 100 + conv_id, w[3] || ' ' || w[4] || ' ' || w[5] FROM toks WHERE len(w) >= 5)"""


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """People named by words of every seventh conversation's first turn, places by three of its words, and nations."""
    w = table(spark, sf_dir, "conversations").where("turn = 0 and conv_id % 7 = 0").select("conv_id", F.split(knowledge.normalize_text(F.col("text")), " ").alias("w")).where(F.size("w") >= 5)
    word = lambda i: F.get("w", F.lit(i))
    people = w.select(F.concat(F.lit("person"), "conv_id").alias("entity"), F.lit("people").alias("kind"), "conv_id", F.array(F.concat_ws(" ", word(0), word(1)), word(4)).alias("names"))
    spots = w.select(F.concat(F.lit("spot"), "conv_id").alias("entity"), F.lit("places").alias("kind"), (F.col("conv_id") + 100).alias("conv_id"), F.array(F.concat_ws(" ", word(2), word(3), word(4))).alias("names"))
    nations = table(spark, sf_dir, "nation").select(F.col("n_name").alias("entity"), F.lit("places").alias("kind"), F.col("n_nationkey").cast("long").alias("conv_id"), F.array().cast("array<string>").alias("names"))
    return people.unionByName(spots).unionByName(nations).withColumnRenamed("conv_id", "place")


@query(f"""WITH {_ENTITIES}, hit AS (SELECT DISTINCT id, kind, place, entity FROM said JOIN ents ON length(form) >= 2 AND contains(s, ' ' || form || ' ')) SELECT id, kind, string_agg(entity, ',' ORDER BY place, entity) AS entities FROM hit GROUP BY id, kind""")
def known_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    return knowledge.known_entities(texts, entities(spark, sf_dir)).select("id", "kind", F.array_join("entities", ",").alias("entities"))


_TYPES = ["essential", "exclude", "importance", "note", "rename", "label", "person", "mood", "narrative_role"]
_NOTES = f"""notes AS (SELECT l_partkey AS event, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS id, {_TYPES}[CAST((l_orderkey * 7 + l_linenumber * 3 + l_suppkey) % 9 + 1 AS INTEGER)] AS type,
  CAST(l_linenumber AS BIGINT) AS priority, epoch_us(l_shipdate) // 1000 AS created, l_discount AS value, l_returnflag || l_suppkey AS text, [l_linestatus, l_returnflag] AS names, l_tax AS mood FROM lineitem WHERE l_orderkey % 3 = 0)"""


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of the line items as annotations on their part."""
    i = table(spark, sf_dir, "lineitem").where("l_orderkey % 3 = 0")
    kind = F.element_at(F.array(*map(F.lit, _TYPES)), ((F.col("l_orderkey") * 7 + F.col("l_linenumber") * 3 + F.col("l_suppkey")) % 9 + 1).cast("int"))
    rows = knowledge.numbered(i, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], "id")
    return rows.select(
        F.col("l_partkey").alias("event"), "id", kind.alias("type"), F.col("l_linenumber").cast("long").alias("priority"), F.unix_millis(F.col("l_shipdate").cast("timestamp")).alias("created"),
        F.col("l_discount").alias("value"), F.concat("l_returnflag", F.col("l_suppkey").cast("string")).alias("text"), F.array("l_linestatus", "l_returnflag").alias("names"), F.create_map(F.lit("joy"), F.col("l_tax")).alias("mood"),
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    affect = F.when(F.col("p_size") % 2 == 0, F.create_map(F.lit("calm"), F.lit(0.5))).otherwise(F.create_map().cast("map<string,double>"))
    return p.select(F.col("p_partkey").alias("event"), F.col("p_name").alias("title"), F.array(F.substring("p_brand", 7, 1), F.lit("O")).alias("labels"), F.array().cast("array<string>").alias("people"), affect.alias("affect"))


#: Each type's last annotation, and lists in order.
_FOLD = f"""{_NOTES}, o AS (SELECT *, struct_pack(p := priority, c := created, i := id) AS k FROM notes),
fold AS (SELECT event, bool_or(type = 'essential') AS ess, bool_or(type = 'exclude') AS exc, arg_max(value, k) FILTER (type = 'importance') AS importance, arg_max(text, k) FILTER (type = 'rename') AS title, arg_max(names, k) FILTER (type = 'person') AS people,
  arg_max(mood, k) FILTER (type = 'mood') AS mood, arg_max(text, k) FILTER (type = 'narrative_role') AS role, count(*) FILTER (type = 'mood') AS moods, list(text ORDER BY priority, created, id) FILTER (type = 'note') AS notes_,
  flatten(list(names ORDER BY priority, created, id) FILTER (type = 'label')) AS labels, list(id ORDER BY priority, created, id) AS refs FROM o GROUP BY event)"""


@query(f"""WITH {_FOLD} SELECT event, ess AND NOT exc AS essential, exc AS excluded, ess AND exc AS contradictory, importance, title, role, moods, array_to_string(people, ',') AS people, mood AS joy, coalesce(array_to_string(notes_, ','), '') AS notes,
  coalesce(array_to_string(labels, ','), '') AS labels, array_to_string(refs, ',') AS refs FROM fold""")
def annotation_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = knowledge.folded_annotations(annotations(spark, sf_dir))
    join = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return f.select("event", "essential", "excluded", "contradictory", "importance", "title", "role", "moods", join("people"), F.col("mood")["joy"].alias("joy"), join("notes"), join("labels"), join("refs"))


@query(f"""WITH {_FOLD}, e AS (SELECT p_partkey AS event, p_name AS title, [p_brand[7], 'O'] AS labels, CASE WHEN p_size % 2 = 0 THEN 0.5::DOUBLE END AS calm FROM part)
  SELECT e.event, coalesce(f.title, e.title) AS title, array_to_string(list_distinct_in_order(e.labels, f.labels), ',') AS labels, coalesce(array_to_string(f.people, ','), '') AS people, mood AS joy, CASE WHEN mood IS NULL THEN calm END AS calm, coalesce(ess AND NOT exc, false) AS essential, coalesce(exc, false) AS excluded,
  array_to_string(list_filter([CASE WHEN f.title IS NOT NULL THEN 'title' END, CASE WHEN f.labels IS NOT NULL THEN 'labels' END, CASE WHEN f.people IS NOT NULL THEN 'people' END, CASE WHEN mood IS NOT NULL THEN 'affect' END], lambda x: x IS NOT NULL), ',') AS overridden
  FROM e LEFT JOIN fold f ON f.event = e.event""".replace("list_distinct_in_order(e.labels, f.labels)", "list_concat(list_filter(e.labels, lambda x, i: list_position(e.labels, x) = i), list_filter(coalesce(f.labels, []), lambda x, i: list_position(f.labels, x) = i AND NOT list_contains(e.labels, x)))").replace("list_concat(list_filter(e.labels, lambda x, i: list_position(e.labels, x) = i)", "list_concat(CASE WHEN f.labels IS NULL THEN e.labels ELSE list_filter(e.labels, lambda x, i: list_position(e.labels, x) = i) END"))
def overridden_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = knowledge.with_overrides(events(spark, sf_dir), knowledge.folded_annotations(annotations(spark, sf_dir)))
    return out.select("event", "title", F.array_join("labels", ",").alias("labels"), F.array_join("people", ",").alias("people"), F.col("affect")["joy"].alias("joy"), F.col("affect")["calm"].alias("calm"), "essential", "excluded", F.array_join("overridden", ",").alias("overridden"))


@query(f"""WITH {_FOLD}, c AS (SELECT event, 'affect' AS about, id AS annotation, 0 AS late, priority, created FROM notes WHERE type = 'mood' AND event IN (SELECT p_partkey FROM part WHERE p_size % 2 = 0) UNION ALL SELECT event, 'knowledge', NULL, 1, NULL, NULL FROM fold WHERE ess AND exc),
  n AS (SELECT *, row_number() OVER (ORDER BY event, late, priority NULLS FIRST, created NULLS FIRST, annotation NULLS FIRST) AS n FROM c)
  SELECT event, about, annotation, 'cfl_' || CASE WHEN n < 10000 THEN lpad(CAST(n AS VARCHAR), 4, '0') ELSE CAST(n AS VARCHAR) END AS conflict FROM n""")
def annotation_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knowledge.conflicts(annotations(spark, sf_dir), events(spark, sf_dir))


@query(f"""WITH {_FOLD}, a AS (SELECT p_partkey AS event, p_size / 50 AS importance, 0.3::DOUBLE AS preserve, p_brand AS role FROM part)
  SELECT a.event, coalesce(f.importance, a.importance) AS importance, CASE WHEN f.importance IS NOT NULL THEN greatest(preserve, f.importance) ELSE preserve END AS preserve, coalesce(f.role, a.role) AS role, CASE WHEN f.role IS NOT NULL THEN 1.0 ELSE 0.6 END::DOUBLE AS probability, true AS current FROM a LEFT JOIN fold f ON f.event = a.event
  UNION ALL SELECT a.event, a.importance, preserve, a.role, 0.6::DOUBLE, false FROM a JOIN fold f ON f.event = a.event AND (f.importance IS NOT NULL OR f.role IS NOT NULL)""")
def assessment_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    a = p.select(F.col("p_partkey").alias("event"), (F.col("p_size") / 50).alias("importance"), F.lit(0.3).alias("preserve"), F.col("p_brand").alias("role"), F.create_map("p_brand", F.lit(0.6)).alias("probabilities"))
    out = knowledge.assessed(a, knowledge.folded_annotations(annotations(spark, sf_dir)))
    return out.select("event", "importance", "preserve", "role", F.element_at(F.map_values("probabilities"), 1).alias("probability"), "current")
