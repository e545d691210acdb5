"""Queries on clips of spoken recordings: each conversation is a recording, its turns are events and its words are timed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators import trim
from tidemark.operators.components import checkpoint_folder
from tidemark.plans.registry import query, table

HANDLING = trim.Handling(pad_in=150, pad_out=250, window=900, least_pause=600, handle=100)

#: A word lasts 40 ms and 60 more for each character; 80 ms follow it, 700 behind a sentence and 1500 behind a turn.
_TIMED = """w AS (SELECT conv_id, turn, i, regexp_split_to_array(trim(text), '\\s+')[i] AS word, i = n AS closes FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM (SELECT conv_id, turn, text, len(regexp_split_to_array(trim(text), '\\s+')) AS n FROM conversations WHERE trim(text) <> ''))),
l AS (SELECT *, CAST(40 + 60 * length(word) AS BIGINT) AS ms, CASE WHEN closes THEN 1500 WHEN regexp_matches(word, '[.!?]$') THEN 700 ELSE 80 END AS pause FROM w),
words AS (SELECT conv_id, turn, i, word, pause, CAST(sum(ms + pause) OVER (PARTITION BY conv_id ORDER BY turn, i) - ms - pause AS BIGINT) AS start, CAST(sum(ms + pause) OVER (PARTITION BY conv_id ORDER BY turn, i) - pause AS BIGINT) AS "end" FROM l),
speech AS (SELECT conv_id, min(start) AS start, max("end") AS "end" FROM (SELECT *, sum(CASE WHEN pause >= 700 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn, i) - CASE WHEN pause >= 700 THEN 1 ELSE 0 END AS s FROM words) GROUP BY conv_id, s),
silences AS (SELECT conv_id, "end" AS start, "end" + pause AS "end" FROM words WHERE pause >= 700),
cuts AS (SELECT conv_id, unnest(range(conv_id % 5 * 311, last, 3700)) AS pos FROM (SELECT conv_id, max("end") AS last FROM words GROUP BY conv_id)),
clips AS (SELECT conv_id, turn AS id, greatest(0, min(start) - 700) AS start, max("end") + 900 AS "end", 5000 + turn % 4 * 2500 AS want, 1500 AS least, 9000 + turn % 3 * 2000 AS most,
  turn % 3 <> 0 AS settle, turn % 5 <> 0 AS snap, conv_id % 2 = 0 AS edited, turn % 2 = 0 AS reaction, conv_id % 7 AS k FROM words GROUP BY conv_id, turn)"""


def recordings(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Turns as events, and the evidence of their conversations. A seventh of the events have no speech in them."""
    # The SQL trims all separators of words, splits at ASCII white space only and ends a word where it ends.
    c = table(spark, sf_dir, "conversations").withColumn("text", F.regexp_replace("text", r"\A\p{Zs}+|\p{Zs}+\z", "")).where("text <> ''")
    words = F.split("text", r"[ \t\n\f\r]+")
    w = c.select("conv_id", "turn", F.posexplode(words).alias("i", "word"), (F.size(words) - 1).alias("last"))
    pause = F.when(F.col("i") == F.col("last"), 1500).when(F.col("word").rlike(r"[.!?]\z"), 700).otherwise(80)
    w = w.withColumns({"ms": 40 + 60 * F.length("word"), "pause": pause})
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_last(), "i")
    done = F.sum(F.col("ms") + F.col("pause")).over(order)
    w = w.withColumn("done", done).select("conv_id", "turn", "i", "word", "pause", (F.col("done") - F.col("pause") - F.col("ms")).alias("start"), (F.col("done") - F.col("pause")).alias("end"))
    # All evidence comes from the timed words, which are worked out once.
    checkpoint_folder(spark)
    w = w.checkpoint()
    stops = (F.col("pause") >= 700).cast("int")
    speech = w.withColumn("s", F.sum(stops).over(order) - stops).groupBy("conv_id", "s").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    silences = w.where("pause >= 700").select("conv_id", F.col("end").alias("start"), (F.col("end") + F.col("pause")).alias("end"))
    last = w.groupBy("conv_id").agg(F.max("end").alias("last"))
    first = F.col("conv_id") % 5 * 311
    at = F.explode(F.sequence(first, F.col("last") - 1, F.lit(3700).cast("long")))
    cuts = last.where(F.col("last") > first).select("conv_id", at.alias("start")).withColumn("end", F.col("start") + 1)
    music = w.where("turn % 4 = 3").groupBy("conv_id", "turn").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    turn = F.col("turn")
    events = w.groupBy("conv_id", F.col("turn").alias("id")).agg(F.greatest(F.lit(0), F.min("start") - 700).alias("start"), (F.max("end") + 900).alias("end")).withColumn("turn", F.col("id"))
    events = events.withColumns({"allocated": 5000 + turn % 4 * 2500, "least": F.lit(1500).cast("long"), "most": 9000 + turn % 3 * 2000, "settle": turn % 3 != 0, "snap": turn % 5 != 0, "edited": F.col("conv_id") % 2 == 0, "reaction": turn % 2 == 0, "remove_pauses": turn % 2 == 1})
    return events.drop("turn"), {"speech": speech, "words": w, "silences": silences, "cuts": cuts, "music": music}


def _spoken(speech: DataFrame) -> DataFrame:
    """Conversations whose recordings have words but no speech ranges are cut like wordless takes."""
    return speech.where("conv_id % 7 <> 0")


_FITS = """({b}) - ({a}) >= least AND ({b}) - ({a}) <= most"""
_HEAD, _TAIL = "(SELECT min(pos) FROM cut u WHERE u.conv_id = p.conv_id AND u.id = p.id AND pos > {a} AND pos < {b}) - ({a})", "({b}) - (SELECT max(pos) FROM cut u WHERE u.conv_id = p.conv_id AND u.id = p.id AND pos > {a} AND pos < {b})"


def _out(keep: str, drop: str, fit: str, flash: str) -> str:
    """Of two ways out of a word the first that fits and leaves no flash, or that fits."""
    good = "({f}) AND coalesce({g}, 1e18) >= 400"
    rules = [(good.format(f=fit.format(x=x), g=flash.format(x=x)), x) for x in (keep, drop)] + [(fit.format(x=x), x) for x in (keep, drop)]
    return "CASE " + " ".join(f"WHEN {rule} THEN {x}" for rule, x in rules) + f" ELSE {keep} END"


_IN = "(p.conv_id, p.id)"
_SQL = f"""WITH {_TIMED},
spoken AS (SELECT c.conv_id, c.id, s.start, s."end" FROM clips c JOIN speech s ON s.conv_id = c.conv_id AND s."end" > c.start AND s.start < c."end" WHERE k <> 0),
cut AS (SELECT c.conv_id, c.id, pos FROM clips c JOIN cuts u ON u.conv_id = c.conv_id AND pos BETWEEN c.start AND c."end" WHERE edited),
a AS (SELECT *, "end" - start AS room, least(greatest(want, least), most, "end" - start) AS need, (SELECT arg_min(struct_pack(a := start, b := "end"), start) FROM spoken s WHERE s.conv_id = c.conv_id AND s.id = c.id) AS opens FROM clips c),
b AS (SELECT *, CAST(CASE WHEN opens IS NOT NULL THEN greatest(start, opens.a - 150) WHEN settle THEN start + least(room * 0.15, 1200) ELSE start END AS DOUBLE) AS s FROM a),
c AS (SELECT *, CASE WHEN opens IS NOT NULL AND reaction THEN greatest(s + need, least("end", s + most, coalesce((SELECT arg_max(t."end", t.start) FROM spoken t WHERE t.conv_id = b.conv_id AND t.id = b.id AND t.start < s + need), opens.b) + 1450)) ELSE s + need END AS e FROM b),
d AS (SELECT * REPLACE (coalesce((SELECT CASE WHEN t <= c."end" THEN t END FROM (SELECT x."end" + 250 AS t, abs(x."end" + 250 - e) AS far, x.start FROM spoken x WHERE x.conv_id = c.conv_id AND x.id = c.id) WHERE far <= 900 ORDER BY far, start LIMIT 1), e) AS e) FROM c),
f AS (SELECT * REPLACE (CASE WHEN e > "end" THEN greatest(start, "end" - need) ELSE s END AS s, least(e, "end") AS e) FROM d),
g AS (SELECT *, greatest(start, coalesce((SELECT "end" FROM silences q WHERE q.conv_id = f.conv_id AND abs(q."end" - s) <= 900 ORDER BY abs(q."end" - s), q.start LIMIT 1), s)) AS qs,
  least("end", coalesce((SELECT start FROM silences q WHERE q.conv_id = f.conv_id AND abs(q.start - e) <= 900 ORDER BY abs(q.start - e), q.start LIMIT 1), e)) AS qe FROM f),
h AS (SELECT *, snap AND (qs <> s OR qe <> e) AND {_FITS.format(a="qs", b="qe")} AS quiet FROM g),
i AS (SELECT *, CASE WHEN quiet THEN qs ELSE s END AS s1, CASE WHEN quiet THEN qe ELSE e END AS e1,
  (SELECT pos FROM cut u WHERE u.conv_id = h.conv_id AND u.id = h.id AND abs(pos - s) <= 900 ORDER BY abs(pos - s), pos LIMIT 1) AS ic, (SELECT pos FROM cut u WHERE u.conv_id = h.conv_id AND u.id = h.id AND abs(pos - e) <= 900 ORDER BY abs(pos - e), pos LIMIT 1) AS oc FROM h),
j AS (SELECT *, CASE WHEN {_FITS.format(a="coalesce(ic, s1)", b="coalesce(oc, e1)")} THEN 'both' WHEN {_FITS.format(a="ic", b="e1")} THEN 'in' WHEN {_FITS.format(a="s1", b="oc")} THEN 'out' END AS moves FROM i),
m AS (SELECT *, CASE WHEN moves = 'both' THEN coalesce(ic, s1) WHEN moves = 'in' THEN ic ELSE s1 END AS s2, CASE WHEN moves = 'both' THEN coalesce(oc, e1) WHEN moves = 'out' THEN oc ELSE e1 END AS e2 FROM j),
n AS (SELECT *, {_HEAD.format(a="s2", b="e2")} AS head, (SELECT max(pos) FROM cut u WHERE u.conv_id = p.conv_id AND u.id = p.id AND pos <= s2) AS prior FROM m p),
o AS (SELECT *, CASE WHEN head < 400 AND e2 - s2 - head >= least THEN s2 + head WHEN head < 400 AND e2 - prior <= most THEN prior ELSE s2 END AS s3 FROM n),
q AS (SELECT *, {_TAIL.format(a="s3", b="e2")} AS tail, (SELECT min(pos) FROM cut u WHERE u.conv_id = p.conv_id AND u.id = p.id AND pos >= e2) AS next FROM o p),
r AS (SELECT *, CASE WHEN tail < 400 AND e2 - tail - s3 >= least THEN e2 - tail WHEN tail < 400 AND next - s3 <= most THEN next ELSE e2 END AS e3 FROM q),
t AS (SELECT *, (SELECT min(struct_pack(a := start, b := "end")) FROM words w WHERE w.conv_id = r.conv_id AND w.start < s3 AND w."end" > s3) AS sw FROM r),
u AS (SELECT *, CASE WHEN sw IS NULL THEN s3 ELSE {_out("greatest(start, sw.a)", 'least("end", sw.b)', _FITS.format(a="{x}", b="e3"), _HEAD.format(a="{x}", b="e3"))} END AS s4 FROM t p),
v AS (SELECT *, (SELECT min(struct_pack(a := start, b := "end")) FROM words w WHERE w.conv_id = u.conv_id AND w.start < e3 AND w."end" > e3) AS ew FROM u),
x AS (SELECT *, CASE WHEN ew IS NULL THEN e3 ELSE {_out('least("end", ew.b)', "greatest(start, ew.a)", _FITS.format(a="s4", b="{x}"), _TAIL.format(a="s4", b="{x}"))} END AS e4 FROM v p),
y AS (SELECT *, greatest(start, floor(s4 + 0.5)) AS lo, least("end", floor(e4 + 0.5)) AS hi, need >= room AS whole FROM x)
SELECT conv_id, id, CAST(CASE WHEN whole THEN start WHEN hi - lo < least THEN greatest(start, least("end", lo + least) - least) ELSE lo END AS BIGINT) AS in_ms, CAST(CASE WHEN whole THEN "end" WHEN hi - lo < least THEN least("end", lo + least) ELSE hi END AS BIGINT) AS out_ms,
  CASE WHEN whole THEN 'whole_event' WHEN EXISTS (SELECT 1 FROM cut u WHERE u.conv_id = y.conv_id AND u.id = y.id) AND (s3 <> s1 OR e3 <> e1) THEN 'cut' WHEN quiet THEN 'snapped' WHEN opens IS NOT NULL THEN 'speech' ELSE 'centre' END AS reason FROM y"""


@query(_SQL)
def trimmed_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    events, evidence = recordings(spark, sf_dir)
    clips = trim.with_evidence(events, evidence | {"speech": _spoken(evidence["speech"])}, ["conv_id"], 20000, HANDLING.window)
    return trim.trimmed(clips, HANDLING, F.col("allocated"), F.col("least"), F.col("most")).select("conv_id", "id", "in_ms", "out_ms", "reason")


@query()
def clip_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tested against a plain loop: SQL would repeat the query above for every round."""
    events, evidence = recordings(spark, sf_dir)
    clips = trim.with_evidence(events, evidence | {"speech": _spoken(evidence["speech"])}, ["conv_id"], 20000, HANDLING.window)
    done = trim.clip_pieces(clips, HANDLING)
    return done.select("conv_id", "id", "in_ms", "out_ms", "reason", "rounds", "removed_ms", F.posexplode("pieces").alias("piece", "p")).select("conv_id", "id", "in_ms", "out_ms", "reason", "rounds", "removed_ms", "piece", F.col("p.start").alias("start"), F.col("p.end").alias("end"))
