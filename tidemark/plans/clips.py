"""Queries over clips, context and embeddings of text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.embedding import hashing_embedding
from tidemark.functions.numbers import dot, rounded
from tidemark.functions.text import tokens
from tidemark.operators import clips
from tidemark.plans.decisions import GREEDY, candidates, greedy_selection, plans
from tidemark.plans.registry import RANGES, merged, query, ranges, table

HOUR = 3600000


def _minus(name: str, a: str, b: str) -> str:
    """SQL for ranges of ``a`` (merged) without those of ``b`` (disjoint): the gaps that b leaves in each."""
    return f"""{name}_e AS (SELECT {a}.owner, {a}.start AS lo, {a}."end" AS hi, CASE WHEN {b}.start IS NOT NULL THEN greatest({b}.start, {a}.start) END AS x, CASE WHEN {b}.start IS NOT NULL THEN least({b}."end", {a}."end") END AS y FROM {a} LEFT JOIN {b} ON {a}.owner = {b}.owner AND {b}.start < {a}."end" AND {b}."end" > {a}.start),
{name}_g AS (SELECT owner, lo, hi, coalesce(lag(y) OVER (PARTITION BY owner, lo ORDER BY x), lo) AS start, coalesce(x, hi) AS "end" FROM {name}_e UNION ALL SELECT owner, lo, hi, max(y), hi FROM {name}_e WHERE y IS NOT NULL GROUP BY owner, lo, hi),
{name} AS (SELECT owner, start, "end" FROM {name}_g WHERE "end" > start)"""


@query(f"""WITH {RANGES} SELECT c.owner, c.id, w.id AS word FROM r c JOIN r w ON c.owner = w.owner AND (w.start + w."end") // 2 >= c.start AND (w.start + w."end") // 2 < c."end" WHERE c.kind = 'view' AND w.kind = 'click'""")
def words_in_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = ranges(spark, sf_dir)
    words = r.where("kind = 'click'").select("owner", "start", "end", F.col("id").alias("word"))
    return clips.words_in_clips(r.where("kind = 'view'").select("owner", "id", "start", "end"), words, ["owner"], HOUR).select("owner", "id", "word")


@query(f"""WITH {RANGES}, {merged("v", "kind = 'view'")}, {merged("w", "kind = 'click'")}, {merged("s", "kind = 'signup'")},
  {_minus("q", "v", "w")}, u AS (SELECT owner, start + 120000 AS start, "end" - 120000 AS "end" FROM q WHERE "end" - start >= 700000), {_minus("l", "s", "u")}
  SELECT b.owner, coalesce(pieces, 0) AS pieces, CAST(b.before - coalesce(a.after, 0) AS BIGINT) AS removed FROM (SELECT owner, sum("end" - start) AS before FROM s GROUP BY owner) b
  LEFT JOIN (SELECT owner, count(*) AS pieces, sum("end" - start) AS after FROM l GROUP BY owner) a ON a.owner = b.owner""")
def pause_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = ranges(spark, sf_dir)
    of = lambda kind: r.where(F.col("kind") == kind).select("owner", "start", "end")
    cuts = clips.pauses(of("view"), of("click"), ["owner"], 700000, 120000)
    return clips.pieces_after(of("signup"), cuts, ["owner"])


@query("""WITH c AS (SELECT user_id AS owner, event_id AS id, value / 500 AS value, event_type = 'purchase' AND value > 80 AS required FROM events), w AS (SELECT DISTINCT owner FROM c WHERE owner % 3 = 0),
  b AS (SELECT owner, arg_min(id, (-value, id)) AS best FROM c WHERE owner IN (SELECT owner FROM w) GROUP BY owner HAVING NOT bool_or(required))
  SELECT c.owner, id, coalesce(id = best, false) AS promoted FROM c LEFT JOIN b ON c.owner = b.owner""")
def required_asset_promotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = candidates(spark, sf_dir)
    c = c.withColumn("required", (F.col("kind") == "purchase") & (F.col("value") * 500 > 80))
    return clips.required_assets(c, c.where("owner % 3 = 0"), "owner").select("owner", "id", "promoted")


@query("""WITH c AS (SELECT event_id AS id, value, event_id % 7 AS quality, user_id * 10 + event_id % 3 AS g FROM events), k AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY value DESC, quality DESC, id) AS n FROM c WHERE id % 2 = 0)
  SELECT id, value, quality FROM c WHERE id % 2 = 1 UNION ALL SELECT id, value, quality FROM k WHERE n = 1""")
def duplicate_suppression(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    c = e.select(F.col("event_id").alias("id"), "value", (F.col("event_id") % 7).alias("quality"))
    groups = e.where("event_id % 2 = 0").select(F.col("event_id").alias("id"), (F.col("user_id") * 10 + F.col("event_id") % 3).alias("group"))
    return clips.without_duplicates(c, groups)


@query(f"""WITH RECURSIVE {GREEDY}, n AS (SELECT plan, id, lag(id) OVER (PARTITION BY plan ORDER BY start, id) AS needs FROM p),
  d AS (SELECT c.plan, c.id, n.needs FROM chosen c JOIN n ON n.plan = c.plan AND n.id = c.id AND n.id % 5 = 0 AND n.needs IS NOT NULL),
  gone AS (SELECT plan, id FROM d WHERE needs NOT IN (SELECT id FROM chosen) UNION SELECT d.plan, d.id FROM gone JOIN d ON d.plan = gone.plan AND d.needs = gone.id)
  SELECT plan, id FROM chosen WHERE id NOT IN (SELECT id FROM gone)""")
def context_pruning(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = greedy_selection(spark, sf_dir)
    before = F.lag("id").over(Window.partitionBy("plan").orderBy("start", "id"))
    needs = plans(spark, sf_dir).withColumn("needs", before).where("id % 5 = 0 and needs is not null").select("id", "needs")
    return clips.with_context(chosen, needs, "plan")


@query("""WITH e AS (SELECT user_id, event_id, event_type, event_id % 3 = 0 AS used, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events)
  SELECT a.user_id, a.event_id AS id, arg_max(b.event_id, b.i) AS bridge FROM e a JOIN e b ON a.user_id = b.user_id AND b.i BETWEEN a.i - 4 AND a.i - 1 AND NOT b.used AND b.event_type IN ('click', 'signup') WHERE a.used GROUP BY a.user_id, a.event_id""")
def bridge_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("id"), F.col("event_type").alias("role"), "ts")
    return clips.bridges(e, e.where("id % 3 = 0"), ["user_id"], ["ts", "id"], ["click", "signup"])


@query()
def text_embedding_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarity of each turn with the next by their hashing embeddings; each distinct text is encoded once."""
    c = table(spark, sf_dir, "conversations")
    coded = c.select("text").distinct().withColumn("v", hashing_embedding(tokens(F.col("text"))))
    v = c.join(coded, "text").select("conv_id", "turn", "v")
    after = v.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("v").alias("w"))
    return v.join(after, ["conv_id", "turn"]).select("conv_id", "turn", rounded(dot(F.col("v"), F.col("w"))).alias("similarity"))


@query("""SELECT l_returnflag AS stage, l_linestatus AS model, count(*) AS calls, CAST(sum(l_partkey) AS BIGINT) AS tokens, floor(sum(CAST(l_extendedprice * 100 AS BIGINT)) / 100 * 1000000 + 0.5) / 1000000 AS cost FROM lineitem GROUP BY ALL""")
def cost_per_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    cents = F.sum(F.rint(F.col("l_extendedprice") * 100).cast("long"))
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("stage"), F.col("l_linestatus").alias("model")).agg(F.count("*").alias("calls"), F.sum("l_partkey").alias("tokens"), rounded(cents / 100, 6).alias("cost"))


@query("""WITH p AS (SELECT o_custkey, CAST(floor(o_totalprice) AS BIGINT) AS price FROM orders)
  SELECT o_custkey, list_aggregate(list(price ORDER BY price), 'min') AS low, CAST(quantile_disc(price, 0.5) AS BIGINT) AS lower_median, max(price) AS high FROM p GROUP BY o_custkey""")
def lower_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = Window.partitionBy("o_custkey")
    p = table(spark, sf_dir, "orders").select("o_custkey", F.floor("o_totalprice").alias("price"))
    p = p.withColumn("i", F.row_number().over(own.orderBy("price"))).withColumn("n", F.count("*").over(own))
    middle = F.max(F.when(F.col("i") == F.floor((F.col("n") - 1) / 2) + 1, F.col("price")))
    return p.groupBy("o_custkey").agg(F.min("price").alias("low"), middle.alias("lower_median"), F.max("price").alias("high"))
