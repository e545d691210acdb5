"""Queries on where recordings stand in time, what edited material shows, distributions, and results kept from run to run."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions import judge
from tidemark.functions.time import epoch_ms
from tidemark.operators import cards, placement
from tidemark.operators.components import checkpoint_folder
from tidemark.plans.registry import RANGES, query, ranges, table
from tidemark.streaming.incremental import refreshed

_FILES = """f AS (SELECT o_custkey AS project, o_orderkey AS id, 'IMG_' || lpad(CAST(o_orderkey * 7919 % 10007 AS VARCHAR), 5, '0') AS name, CASE WHEN o_orderkey % 5 = 0 THEN 'image' ELSE 'video' END AS kind, CAST(floor(o_totalprice) AS BIGINT) AS ms,
  CASE WHEN o_orderkey % (2 + o_custkey % 3) <> 0 THEN epoch_us(o_orderdate) // 1000 END AS utc, CASE WHEN o_orderkey % 4 <> 1 AND o_custkey % 6 <> 5 THEN epoch_us(o_orderdate) // 1000 + 7200000 - o_orderkey % 3 * 3600000 END AS local, CASE o_orderkey % 11 WHEN 0 THEN 120 WHEN 1 THEN CASE WHEN o_custkey % 2 = 0 THEN 60 ELSE 120 END END AS zone FROM orders WHERE o_custkey % 13 <> 4 OR o_orderkey % 2 = 0)"""


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's orders as the files of a project, some without an instant, some without a wall clock."""
    o = table(spark, sf_dir, "orders").where("o_custkey % 13 <> 4 or o_orderkey % 2 = 0")
    k, c, at = F.col("o_orderkey"), F.col("o_custkey"), epoch_ms(o, "o_orderdate")
    return o.select(
        c.alias("project"), k.alias("id"), F.concat(F.lit("IMG_"), F.lpad((k * 7919 % 10007).cast("string"), 5, "0")).alias("name"), F.when(k % 5 == 0, "image").otherwise("video").alias("kind"), F.floor("o_totalprice").alias("ms"),
        F.when(k % (2 + c % 3) != 0, at).alias("utc"), F.when((k % 4 != 1) & (c % 6 != 5), at + 7200000 - k % 3 * 3600000).alias("local"), F.when(k % 11 == 0, 120).when(k % 11 == 1, F.when(c % 2 == 0, 60).otherwise(120)).alias("offset_min"),
    )


@query(f"""WITH {_FILES}, c AS (SELECT project, CASE WHEN count(local) > count(utc) AND count(DISTINCT zone) <= 1 THEN 'local' WHEN count(utc) > 0 THEN 'utc' END AS clock FROM f GROUP BY project),
  t AS (SELECT f.*, clock, CASE clock WHEN 'local' THEN local WHEN 'utc' THEN utc END AS t FROM f JOIN c ON c.project = f.project), d AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY t, name, id) AS i FROM t WHERE t IS NOT NULL),
  b AS (SELECT t.*, d.i, (SELECT arg_max(struct_pack(i := i, id := id), struct_pack(n := name, i := id)) FROM d x WHERE x.project = t.project AND (x.name, x.id) < (t.name, t.id)) AS before, (SELECT arg_min(struct_pack(i := i, id := id), struct_pack(n := name, i := id)) FROM d x WHERE x.project = t.project AND (x.name, x.id) > (t.name, t.id)) AS after FROM t LEFT JOIN d ON d.project = t.project AND d.id = t.id),
  s AS (SELECT *, coalesce(i, before.i, after.i, 0) AS slot, CASE WHEN t IS NULL AND before IS NOT NULL THEN 1 WHEN t IS NULL AND after IS NOT NULL THEN -1 END AS side, CASE WHEN t IS NULL THEN coalesce(before.id, after.id) END AS beside FROM b)
  SELECT project, id, row_number() OVER w - 1 AS place, CAST(coalesce(sum(CASE kind WHEN 'image' THEN 3000 ELSE ms END + 1000) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "at", CASE WHEN t IS NULL THEN 'file_name' ELSE 'creation_time' END AS ordered_by, CASE WHEN t IS NOT NULL THEN clock END AS clock, beside, side FROM s WINDOW w AS (PARTITION BY project ORDER BY slot, coalesce(side, 0), name, id)""")
def capture_placement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return placement.placed(files(spark, sf_dir), ["project"]).select("project", "id", "place", "at", "ordered_by", "clock", "beside", "side")


@query(f"""WITH {_FILES}, n AS (SELECT project, id, utc, local, lag(id) OVER w AS before, lag(utc) OVER w AS u, lag(local) OVER w AS l FROM f WINDOW w AS (PARTITION BY project ORDER BY name, id)) SELECT project, before, id, coalesce(utc - u, local - l) AS apart FROM n WHERE before IS NOT NULL""")
def real_time_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("project").orderBy("name", "id")
    f = files(spark, sf_dir).withColumns({"before": F.lag("id").over(w), "u": F.lag("utc").over(w), "l": F.lag("local").over(w)}).where("before is not null")
    return f.select("project", "before", "id", placement.starts_apart(F.col("u"), F.col("utc"), F.col("l"), F.col("local")).alias("apart"))


_SHOTS = f"""{RANGES}, shots AS (SELECT owner, id, start // 60000 AS start, start // 60000 + CAST(floor(value * value / 6) AS BIGINT) AS "end", value FROM r)"""


def shots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as shots, an hour of theirs as a second."""
    start = F.floor(F.col("start") / 60000)
    return ranges(spark, sf_dir).select("owner", "id", start.alias("start"), (start + F.floor(F.col("value") * F.col("value") / 6)).alias("end"), "value")


@query(f"""WITH {_SHOTS}, n AS (SELECT *, sum(CASE WHEN "end" - start >= 1000 THEN 1 ELSE 0 END) OVER (PARTITION BY owner ORDER BY start, id ROWS UNBOUNDED PRECEDING) AS n FROM shots)
  SELECT owner, min(start) AS start, coalesce(max("end") FILTER (n > 0), arg_max("end", struct_pack(s := start, i := id))) AS "end" FROM n GROUP BY owner, greatest(1, n)""")
def steady_shots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cards.steady_shots(shots(spark, sf_dir), ["owner"])


@query(f"""WITH {_SHOTS}, pic AS (SELECT owner, (start + 250 * k) // 250 AS hop, max(value % 1) AS motion, avg(id % 50) AS luma FROM (SELECT *, unnest(range(0, 8)) AS k FROM shots) WHERE owner % 5 <> 0 GROUP BY owner, (start + 250 * k) // 250),
  st AS (SELECT s.owner, s.start, s."end", count(*) AS n, max(motion) AS most, avg(luma) AS mean FROM (SELECT DISTINCT owner, start, "end" FROM shots WHERE "end" - start <= 6000) s JOIN pic p ON p.owner = s.owner AND hop >= ceil((s.start + 250) / 250) AND hop < ceil(s."end" / 250) GROUP BY ALL HAVING count(*) >= 2 AND max(motion) <= 0.5),
  cd AS (SELECT owner, start, "end" FROM st WHERE mean <= 20 OR EXISTS (SELECT 1 FROM shots t WHERE t.owner = st.owner AND id % 3 = 0 AND t.start >= st.start AND t.start < st."end") UNION ALL SELECT owner, start, start + 700 FROM shots WHERE id % 29 = 0),
  g AS (SELECT *, max("end") OVER (PARTITION BY owner ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM cd), i AS (SELECT *, sum(CASE WHEN reach IS NULL OR start > reach THEN 1 ELSE 0 END) OVER (PARTITION BY owner ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS island FROM g)
  SELECT owner, min(start) AS start, max("end") AS "end" FROM i GROUP BY owner, island""")
def title_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = shots(spark, sf_dir)
    hops = s.where("owner % 5 <> 0").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(7))))
    pictures = hops.groupBy("owner", F.floor((F.col("start") + 250 * F.col("k")) / 250).alias("hop")).agg(F.max(F.col("value") % 1).alias("motion"), F.avg(F.col("id") % 50).alias("luma"))
    reads = s.select("owner", "start", F.when(F.col("id") % 3 == 0, 0.6).otherwise(0.9).alias("middle"))
    black = s.where("id % 29 = 0").select("owner", "start", (F.col("start") + 700).alias("end"))
    return cards.title_cards(s.select("owner", "start", "end").distinct(), pictures, reads, black, ["owner"], 250, 20000)


_RATE = "(exp({l} - {m}) + 2 * exp(2 * {l} - {m}) + 3 * exp(3 * {l} - {m}) + 4 * exp(4 * {l} - {m})) / (exp(-{m}) + exp({l} - {m}) + exp(2 * {l} - {m}) + exp(3 * {l} - {m}) + exp(4 * {l} - {m}))"


@query(f"""WITH RECURSIVE v AS (SELECT DISTINCT value, greatest(0, least(1, value / 100)) * 4 AS mean FROM events), s AS (
    SELECT value, mean, -60.0::DOUBLE AS low, 60.0::DOUBLE AS high, 0.0::DOUBLE AS rate, false AS done, 0 AS k FROM v
    UNION ALL SELECT value, mean, CASE WHEN NOT done AND NOT near AND now < mean THEN l ELSE low END, CASE WHEN NOT done AND NOT near AND now >= mean THEN l ELSE high END, CASE WHEN done THEN rate ELSE l END, done OR near, k + 1
      FROM (SELECT *, {_RATE.format(l="l", m="m")} AS now, abs({_RATE.format(l="l", m="m")} - mean) < 1e-9 AS near FROM (SELECT *, (low + high) / 2 AS l, CASE WHEN (low + high) / 2 >= 0 THEN (low + high) / 2 * 4 ELSE 0 END AS m FROM s WHERE k < 60))),
  e AS (SELECT value, mean, list_transform([0, 1, 2, 3, 4], lambda i: exp(rate * i - CASE WHEN rate >= 0 THEN rate * 4 ELSE 0 END)) AS w FROM s WHERE k = 60),
  d AS (SELECT value, list_transform([0, 1, 2, 3, 4], lambda i: floor((0.6 * CASE WHEN mean <= 0 THEN CASE i WHEN 0 THEN 1 ELSE 0 END WHEN mean >= 4 THEN CASE i WHEN 4 THEN 1 ELSE 0 END ELSE w[i + 1] / list_sum(w) END + 0.4 * greatest(0, 1 - abs(mean - i))) * 10000 + 0.5) / 10000) AS p FROM e)
  SELECT event_id, p[1] AS p0, p[2] AS p1, p[3] AS p2, p[4] AS p3, p[5] AS p4, floor((p[2] + 2 * p[3] + 3 * p[4] + 4 * p[5]) / 4 * 10000 + 0.5) / 10000 AS value FROM events JOIN d USING (value)""")
def unit_distributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = judge.unit_distribution(F.col("value") / 100, 5)
    e = table(spark, sf_dir, "events").select("value").distinct().withColumn("p", p)
    e = table(spark, sf_dir, "events").select("event_id", "value").join(e, "value")
    return e.select("event_id", *[F.get("p", F.lit(i)).alias(f"p{i}") for i in range(5)], judge.unit_value(F.col("p"), 5).alias("value"))


@query("""SELECT doc_id, len(regexp_split_to_array(coalesce(text, ''), ' ')) AS words, doc_id % 3 = 0 AND doc_id % 5 <> 0 AND doc_id % 7 <> 0 AS reused, doc_id % 7 = 0 AS failed FROM documents""")
def incremental_recompute(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A first run over a third of the documents, a fifth of them with other texts than now, and a second over all."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    path = f"{checkpoint_folder(spark)}/incremental-{uuid.uuid4().hex}"

    def compute(rows: DataFrame) -> DataFrame:
        return rows.select("doc_id", F.size(F.split(F.coalesce("text", F.lit("")), " ")).cast("long").alias("words"), (F.col("doc_id") % 7 == 0).alias("failed"))

    old = d.where("doc_id % 3 = 0").withColumn("text", F.when(F.col("doc_id") % 5 == 0, F.concat(F.coalesce("text", F.lit("")), F.lit(" more"))).otherwise(F.col("text")))
    refreshed(old, path, ["doc_id"], ["text"], "1", compute)
    return refreshed(d, path, ["doc_id"], ["text"], "1", compute).select("doc_id", "words", "reused", "failed")
