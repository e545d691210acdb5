"""Queries on long takes: each conversation is one recording of which nothing but its words is known."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators import takes
from tidemark.plans.registry import query
from tidemark.plans.trims import _TIMED, recordings

WIDTH, HOP, PAUSE = 20000, 250, 700


def _evidence(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, dict[str, DataFrame]]:
    """The recording's evidence: a still picture before every twelfth word, motion by the words' lengths, texts every 25 words."""
    _, e = recordings(spark, sf_dir)
    w, c = e["words"], F.col("conv_id")
    stills = w.where("i % 12 = 5").select("conv_id", (F.col("start") - 2000).alias("start"), F.col("start").alias("end"))
    motion = w.where(c % 6 != 0).groupBy("conv_id", F.floor(F.col("start") / HOP).alias("hop")).agg((F.max(F.length("word")) / 2).alias("value"))
    read = F.array(F.struct(F.col("start"), F.substring("word", 1, 1).alias("key")), F.struct(F.col("start"), F.lit("x").alias("key")))
    reads = w.where("i % 25 = 3 and turn % 4 <> 3").select("conv_id", F.explode(read).alias("r")).select("conv_id", "r.*")
    utterances = e["speech"].withColumn("id", F.col("start"))
    found = takes.take_evidence(stills, motion, reads, utterances, e["silences"], ["conv_id"], HOP, WIDTH, PAUSE)
    return found, e


_EVIDENCE = f"""{_TIMED}, stills AS (SELECT conv_id, start AS pos FROM words WHERE (i - 1) % 12 = 5),
motion AS (SELECT conv_id, start // {HOP} AS hop, max(length(word)) / 2 AS value FROM words WHERE conv_id % 6 <> 0 GROUP BY ALL),
moved AS (SELECT s.conv_id, s.pos, max(value) AS most FROM stills s LEFT JOIN motion m ON m.conv_id = s.conv_id AND hop >= floor(s.pos / {HOP} + 0.5) AND hop < floor(s.pos / {HOP} + 0.5) + 4 GROUP BY ALL),
seen AS (SELECT conv_id, start AS pos, list_sort(list_distinct([word[1], 'x'])) AS keys FROM words WHERE (i - 1) % 25 = 3 AND turn % 4 <> 3),
lagged AS (SELECT conv_id, lag(pos) OVER z AS a, pos AS b, lag(keys) OVER z AS before, keys FROM seen WINDOW z AS (PARTITION BY conv_id ORDER BY pos)),
swaps AS (SELECT conv_id, a, b, (a + b + 1) // 2 AS mid FROM lagged WHERE before <> keys),
texts AS (SELECT w.conv_id, coalesce(arg_min(s.pos, struct_pack(d := abs(s.pos - mid), p := s.pos)), mid) AS pos FROM swaps w LEFT JOIN stills s ON s.conv_id = w.conv_id AND s.pos > a AND s.pos <= b GROUP BY w.conv_id, a, b, mid),
evidence AS (SELECT conv_id, 0 AS level, pos AS "at", pos AS s, pos AS e FROM (SELECT conv_id, pos FROM moved WHERE most >= 4 OR conv_id % 6 = 0 UNION SELECT conv_id, pos FROM texts)
  UNION ALL SELECT conv_id, 1, (s + e + 1) // 2, s, e FROM (SELECT conv_id, max("end") OVER (PARTITION BY conv_id ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS s, start AS e FROM speech) WHERE e - s >= {PAUSE}
  UNION ALL SELECT conv_id, 2, (start + "end" + 1) // 2, start, "end" FROM silences WHERE "end" - start >= {PAUSE})"""


@query(f"""WITH {_EVIDENCE} SELECT * FROM evidence""")
def take_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _evidence(spark, sf_dir)[0]


def _atoms(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, dict[str, DataFrame]]:
    found, e = _evidence(spark, sf_dir)
    whole = e["words"].groupBy("conv_id").agg(F.lit(0).cast("long").alias("start"), F.max("end").alias("end")).withColumn("change_score", F.lit(0.7))
    # Of a third of the recordings nothing but silences is known, of another third nothing at all.
    some = found.where("conv_id % 3 = 0 or (conv_id % 3 = 1 and level = 2 and at % 5 = 0)")
    return takes.subdivided(whole, some, ["conv_id"], 2000, 12000, WIDTH), e


@query()
def subdivided_takes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tested against a recursion over each take."""
    return _atoms(spark, sf_dir)[0]


_CUTS = f"""{_TIMED}, atoms AS (SELECT conv_id, k * 9000 AS start, least(last, (k + 1) * 9000) AS "end", CASE WHEN k % 3 <> 1 THEN (k * 7 % 10) / 10 END AS score FROM (SELECT conv_id, last, unnest(range(0, (last + 8999) // 9000)) AS k FROM (SELECT conv_id, max("end") AS last FROM words GROUP BY conv_id))),
bounds AS (SELECT * FROM (SELECT conv_id, start AS pos, "end" AS until, score, lag(start) OVER (PARTITION BY conv_id ORDER BY start) AS prior FROM atoms) WHERE prior IS NOT NULL),
said AS (SELECT conv_id, start, "end", start % 3 AS speaker, (SELECT list_distinct(list(w.t)) FROM (SELECT unnest(regexp_extract_all(lower(word), '[a-z]+')) AS t FROM words w WHERE w.conv_id = q.conv_id AND w.start >= q.start AND w."end" <= q."end") w) AS f FROM speech q)"""


@query(f"""WITH {_CUTS}, silent AS (SELECT conv_id, start, "end" FROM silences),
marks AS (SELECT conv_id, start + CASE WHEN conv_id % 4 < 2 THEN 300 ELSE 150 END AS pos, CASE conv_id % 4 WHEN 0 THEN 'split' WHEN 1 THEN 'merge' WHEN 2 THEN 'card_start' ELSE 'card_end' END AS kind FROM atoms WHERE start // 9000 % 4 = 2 UNION ALL SELECT conv_id, start - 100, 'card_end' FROM atoms WHERE start // 9000 % 8 = 2),
dist AS (SELECT b.conv_id, b.pos, min(abs(m.pos - b.pos)) FILTER (kind = 'split') AS sp, min(abs(m.pos - b.pos)) FILTER (kind = 'merge') AS me, min(abs(m.pos - b.pos)) FILTER (kind = 'card_start') AS cs, min(abs(m.pos - b.pos)) FILTER (kind = 'card_end') AS ce FROM bounds b JOIN marks m ON m.conv_id = b.conv_id GROUP BY ALL),
sides AS (SELECT b.conv_id, b.pos, b.score, (SELECT arg_max(speaker, start) FROM said s WHERE s.conv_id = b.conv_id AND s.start < b.pos AND s."end" > prior) AS ls, (SELECT arg_min(speaker, start) FROM said s WHERE s.conv_id = b.conv_id AND s.start < until AND s."end" > b.pos) AS fs,
  (SELECT list_distinct(flatten(list(f))) FROM said s WHERE s.conv_id = b.conv_id AND s.start < b.pos AND s."end" > prior) AS lf, (SELECT list_distinct(flatten(list(f))) FROM said s WHERE s.conv_id = b.conv_id AND s.start < until AND s."end" > b.pos) AS ff FROM bounds b)
SELECT s.conv_id, s.pos AS "at", CASE WHEN sp <= 600 THEN 'split' WHEN me <= 600 THEN 'merge' WHEN cs <= 200 AND cs <= coalesce(ce, 201) THEN 'split' WHEN ce <= 200 THEN 'merge' END AS forced,
  EXISTS (SELECT 1 FROM said x WHERE x.conv_id = s.conv_id AND x.start < s.pos - 120 AND x."end" > s.pos + 120) AS speech_spans, CASE WHEN ls <> fs THEN 1.0 WHEN ls = fs THEN 0.0 END::DOUBLE AS speaker_change,
  floor((1 - greatest(len(list_intersect(lf, ff)) / len(ff), len(list_intersect(lf, ff)) / len(lf))) * 10000 + 0.5) / 10000 AS topic,
  CASE WHEN (SELECT max(least(x."end", s.pos + 1200) - greatest(x.start, s.pos - 1200)) FROM silent x WHERE x.conv_id = s.conv_id AND x.start < s.pos + 1200 AND x."end" > s.pos - 1200) / 1400 >= 1 THEN 1 ELSE floor((SELECT max(least(x."end", s.pos + 1200) - greatest(x.start, s.pos - 1200)) FROM silent x WHERE x.conv_id = s.conv_id AND x.start < s.pos + 1200 AND x."end" > s.pos - 1200) / 1400 * 10000 + 0.5) / 10000 END AS silence, score AS shot_change
FROM sides s LEFT JOIN dist d ON d.conv_id = s.conv_id AND d.pos = s.pos""")
def boundary_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, e = recordings(spark, sf_dir)
    w = e["words"]
    last = w.groupBy("conv_id").agg(F.max("end").alias("last"))
    k = last.select("conv_id", "last", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("last") + 8999) / 9000) - 1)).alias("k"))
    atoms = k.select("conv_id", (F.col("k") * 9000).alias("start"), F.least("last", (F.col("k") + 1) * 9000).alias("end"), F.when(F.col("k") % 3 != 1, F.col("k") * 7 % 10 / 10).alias("change_score"))
    said = e["speech"].select("conv_id", "start", "end", F.col("start").alias("id"))
    # In the SQL the dotted capital I is an i in lower case.
    letters = F.filter(F.split(F.lower(F.translate("word", "\u0130", "i")), "[^a-z]+"), lambda x: x != "")
    spoken = w.withColumn("s", F.sum((F.col("pause") >= 700).cast("int")).over(Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_last(), "i")) - (F.col("pause") >= 700).cast("int"))
    features = spoken.groupBy("conv_id", "s").agg(F.min("start").alias("id"), F.array_distinct(F.flatten(F.collect_list(letters))).alias("features")).drop("s")
    said = said.join(features, ["conv_id", "id"]).withColumn("speaker", F.col("start") % 3)
    n, c = F.floor(F.col("start") / 9000), F.col("conv_id")
    kind = F.when(c % 4 == 0, "split").when(c % 4 == 1, "merge").when(c % 4 == 2, "card_start").otherwise("card_end")
    marks = atoms.where(n % 4 == 2).select("conv_id", (F.col("start") + F.when(c % 4 < 2, 300).otherwise(150)).alias("at"), kind.alias("kind"))
    marks = marks.unionByName(atoms.where(n % 8 == 2).select("conv_id", (F.col("start") - 100).alias("at"), F.lit("card_end").alias("kind")))
    out = takes.boundary_signals(atoms, said, e["silences"], marks, ["conv_id"], WIDTH)
    four = lambda x: F.when(F.isnan(x), F.col(x)).otherwise(F.floor(F.col(x) * 10000 + 0.5) / 10000).alias(x)
    return out.select("conv_id", "at", "forced", "speech_spans", "speaker_change", four("topic"), four("silence"), "shot_change")
