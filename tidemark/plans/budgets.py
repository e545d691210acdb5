"""Queries on what a closer look may cost: events as candidates, line items as calls, the event stream as instants and levels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import budgets
from tidemark.plans.registry import RANGES, query, ranges, table
from tidemark.plans.signals import envelope

POLICY = budgets.Policy(max_items=12, max_cost=6.0, min_value=0.05, min_items=2)


@query(f"""WITH RECURSIVE c AS (SELECT user_id, event_id AS id, value / 500 AS value, event_id % 8 / 8 AS cost, row_number() OVER (PARTITION BY user_id ORDER BY value / 500 DESC, event_id) AS place FROM events),
  g AS (SELECT user_id, 0::BIGINT AS id, 0::BIGINT AS place, 0 AS n, 0.0::DOUBLE AS spent, NULL::VARCHAR AS why FROM c WHERE place = 1
    UNION ALL SELECT user_id, id, place, CASE WHEN why IS NULL THEN n + 1 ELSE n END, CASE WHEN why IS NULL THEN spent + cost ELSE spent END, why FROM (SELECT c.user_id, c.id, c.place, n, spent, cost,
      CASE WHEN n >= 2 AND value < 0.05 THEN 'value' WHEN n >= 12 THEN 'count' WHEN spent + cost > 6 THEN 'cost' END AS why FROM g JOIN c ON c.user_id = g.user_id AND c.place = g.place + 1))
  SELECT user_id, id, place, why IS NULL AS taken, why AS limited_by FROM g WHERE place > 0""")
def escalation_under_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("id"), (F.col("value") / 500).alias("value"), (F.col("event_id") % 8 / 8).alias("cost"))
    return budgets.escalated(c, "user_id", POLICY).drop("cost")


@query("""WITH r AS (SELECT l_linestatus AS model, sum(l_partkey) / sum(l_orderkey) AS per_char, sum(coalesce(CASE WHEN l_suppkey % 3 > 0 THEN l_suppkey END, 0)) / count(*) AS per_call FROM lineitem WHERE l_linenumber <> 3 AND l_orderkey > 0 GROUP BY 1)
  SELECT o_orderkey, model, CAST(floor(o_custkey * per_char + per_call + 0.5) AS BIGINT) AS tokens FROM orders JOIN r ON model = o_orderstatus UNION ALL SELECT o_orderkey, o_orderstatus, 0 FROM orders WHERE o_orderstatus NOT IN (SELECT model FROM r)""")
def token_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = table(spark, sf_dir, "lineitem")
    calls = i.select(F.col("l_linestatus").alias("model"), F.col("l_orderkey").alias("chars"), F.when(F.col("l_linenumber") != 3, F.col("l_partkey")).alias("input"), F.when(F.col("l_suppkey") % 3 > 0, F.col("l_suppkey")).alias("output"))
    rates = budgets.token_rates(calls, ["model"])
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("model"), "o_custkey")
    return o.join(rates, "model", "left").select("o_orderkey", "model", budgets.estimated_tokens(F.col("o_custkey"), F.col("per_char"), F.col("per_call")).alias("tokens"))


@query(f"""WITH {RANGES}, s AS (SELECT owner, start, "end" FROM r WHERE kind = 'error'), t AS (SELECT r.owner, id, any_value(r.start) AS pos, min(CASE WHEN s.start IS NOT NULL THEN struct_pack(a := s.start, b := s."end") END) AS span FROM r LEFT JOIN s ON s.owner = r.owner AND r.start >= s.start AND r.start < s."end" WHERE kind <> 'error' GROUP BY r.owner, id),
  n AS (SELECT *, row_number() OVER (PARTITION BY owner, span ORDER BY pos, id) AS n FROM t) SELECT owner, id FROM n WHERE span IS NULL OR n = 1""")
def instants_to_look_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = ranges(spark, sf_dir)
    instants = r.where("kind <> 'error'").select("owner", "id", F.col("start").alias("at"))
    return budgets.instants_to_look_at(instants, r.where("kind = 'error'"), ["owner"], 3600000).select("owner", "id")


@query()
def upload_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's envelope as one recording of 100 ms hops, in uploads of two seconds; tested against a plain loop."""
    e = envelope(spark, sf_dir).select("user_id", "hop", F.col("db").alias("level"))
    whole = e.groupBy("user_id").agg(F.lit(0).cast("long").alias("start"), ((F.max("hop") + 1) * 100).alias("end"))
    return budgets.bounded_pieces(whole, e, ["user_id"], 2000).drop("stretch")
