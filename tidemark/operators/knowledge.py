"""What users say about a recording: names that they declared, found in events, and annotations folded into what is known."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.text import normalize_text
from tidemark.operators.components import checkpoint_folder

#: Surface forms that are broadcast; a larger vocabulary is joined by a shuffle.
FORMS = 500_000
#: Parts in which texts meet the forms: mentions are many times the texts, and those of a part are sorted together.
PARTS = 256


def surface_forms(entities: DataFrame) -> DataFrame:
    """Normalised names of two characters or more of each entity (``entity``, ``kind``, ``place`` in its list, ``names``): ``form``,
    whether it is ``latin``, and the ``seed`` that a text must have to mention it: the first word of a Latin form, the first two
    characters of another."""
    form = F.explode(F.transform(F.array_append("names", F.col("entity")), lambda n: normalize_text(n)))
    out = entities.select("entity", "kind", "place", form.alias("form")).where(F.length("form") >= 2).distinct()
    out = out.withColumn("latin", F.col("form").rlike(r"^[\p{IsLatin}\p{N}\s]+$"))
    return out.withColumn("seed", F.when(F.col("latin"), F.concat(F.lit("w"), F.split("form", " ")[0])).otherwise(F.concat(F.lit("c"), F.substring("form", 1, 2))))


def known_entities(texts: DataFrame, entities: DataFrame) -> DataFrame:
    """Entities that each text (``id``, unique, ``text``) mentions: ``id``, ``kind`` and ``entities``, in the order of ``place``.

    A Latin form must not stand beside another Latin letter or digit; one in another script, or in several, may stand anywhere.
    A text meets each distinct form once, however many entities have it: Latin forms as runs of its words, others where it holds their
    first two characters. Mentions of Latin forms stay where their text is, so that only texts are shuffled. Texts without a mention have no row.
    """
    said = texts.where("text is not null").select("id", normalize_text(F.col("text")).alias("said"))
    forms = surface_forms(entities)
    few = forms.limit(FORMS + 1).count() <= FORMS
    spread = lambda frame: F.broadcast(frame) if few else frame
    of = forms.where("latin").groupBy("form").agg(F.collect_set(F.struct("kind", "place", "entity")).alias("of"))
    lengths = [r[0] for r in of.select(F.size(F.split("form", " "))).distinct().collect()]
    # What is neither blank nor Latin parts words and is itself in no Latin form.
    words = F.split(F.regexp_replace("said", r"[^\p{IsLatin}\p{N} ]+", " | "), " ")
    run = lambda n: F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.array_join(F.slice("w", i, F.lit(n)), " "))
    runs = [F.col("w") if n == 1 else F.when(F.size("w") >= n, run(n)).otherwise(F.array().cast("array<string>")) for n in lengths]
    each = said.repartition(PARTS, "id").withColumn("w", words).select("id", F.explode(F.array_distinct(F.concat(F.array().cast("array<string>"), *runs))).alias("form"))
    found = each.join(spread(of), "form").select("id", F.explode("of").alias("o")).select("id", "o.kind", "o.place", "o.entity")
    others = forms.where("not latin")
    if not others.isEmpty():
        chars = F.split("said", "")
        pairs = F.zip_with(chars, F.slice(chars, 2, F.greatest(F.lit(0), F.size(chars) - 1)), lambda a, b: F.concat(F.lit("c"), a, b))
        seeds = said.select("id", F.explode(F.array_distinct(pairs)).alias("seed"))
        held = seeds.join(spread(others), "seed").join(said, "id").where(F.contains("said", "form"))
        found = found.unionByName(held.select("id", "kind", "place", "entity"))
    return found.groupBy("id", "kind").agg(F.transform(F.array_sort(F.collect_set(F.struct("place", "entity"))), lambda s: s["entity"]).alias("entities"))


#: Types of annotations that set one value; the last one counts.
_LAST = {"importance": "value", "rename": "text", "person": "names", "mood": "mood", "narrative_role": "text"}


def folded_annotations(annotations: DataFrame) -> DataFrame:
    """What the annotations of each event come to.

    ``annotations``: ``event``, ``id`` (unique), ``type``, ``priority``, ``created`` and, by type, ``value``, ``text``,
    ``names`` (array) or ``mood`` (map). They hold in the order of ``priority``, ``created`` and ``id``: of 'importance',
    'rename', 'person', 'mood' and 'narrative_role' the last counts, 'note' and 'label' add up, 'essential' and 'exclude' are
    flags. Both flags at once leave an event excluded, and ``contradictory``. ``moods`` counts those of type 'mood'. Other types are only
    listed in ``refs``. One aggregation, combined before the shuffle but for lists.
    """
    order = F.struct("priority", "created", "id")
    of = lambda t, c: F.when(F.col("type") == t, F.col(c))
    last = lambda t: F.max_by(of(t, _LAST[t]), F.when(F.col("type") == t, order))
    listed = lambda t, c: F.transform(F.array_sort(F.collect_list(F.when(F.col("type") == t, F.struct("priority", "created", "id", c)))), lambda s: s[c])
    flag = lambda t: F.max(F.col("type") == t)
    out = annotations.groupBy("event").agg(
        flag("essential").alias("_essential"), flag("exclude").alias("excluded"), last("importance").alias("importance"), last("rename").alias("title"),
        last("person").alias("people"), last("mood").alias("mood"), last("narrative_role").alias("role"), F.count(of("mood", "id")).alias("moods"),
        listed("note", "text").alias("notes"), F.flatten(listed("label", "names")).alias("labels"),
        F.transform(F.array_sort(F.collect_list(order)), lambda s: s["id"]).alias("refs"),
    )
    out = out.withColumns({"essential": F.col("_essential") & ~F.col("excluded"), "contradictory": F.col("_essential") & F.col("excluded")})
    return out.drop("_essential")


def with_overrides(events: DataFrame, folded: DataFrame) -> DataFrame:
    """Events (``event``, ``title``, ``labels``, ``people``, ``affect``) as their users corrected them, with ``essential``,
    ``excluded``, ``notes`` and, in ``overridden``, the fields that a user decided. Labels are added to those there were."""
    k = folded.select("event", "essential", "excluded", "notes", *[F.col(c).alias(f"_{c}") for c in ("title", "people", "mood", "labels")])
    e = events.join(k, "event", "left")
    added = F.size(F.coalesce("_labels", F.array().cast("array<string>"))) > 0
    changes = {"title": F.col("_title").isNotNull() & (F.col("_title") != ""), "labels": added, "people": F.col("_people").isNotNull(), "affect": F.col("_mood").isNotNull()}
    named = F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in changes.items()]))
    return e.select(
        *[c for c in events.columns if c not in ("title", "labels", "people", "affect")],
        F.when(changes["title"], F.col("_title")).otherwise(F.col("title")).alias("title"),
        F.when(added, F.array_union("labels", "_labels")).otherwise(F.col("labels")).alias("labels"),
        F.coalesce("_people", "people").alias("people"), F.coalesce("_mood", "affect").alias("affect"),
        F.coalesce("essential", F.lit(False)).alias("essential"), F.coalesce("excluded", F.lit(False)).alias("excluded"),
        F.coalesce("notes", F.array().cast("array<string>")).alias("notes"), F.coalesce(named, F.array().cast("array<string>")).alias("overridden"),
    )


def numbered(frame: DataFrame, order: list[str], name: str) -> DataFrame:
    """Adds the place (from 1) of each row in a total order, without bringing all rows into one task: rows are sorted in ranges, and
    only the ranges' sizes are added up. The ranges are drawn from a sample, so they are checkpointed before they are read twice."""
    checkpoint_folder(frame.sparkSession)
    ranged = frame.repartitionByRange(*order).withColumn("_p", F.spark_partition_id())
    own = ranged.withColumn("_n", F.row_number().over(Window.partitionBy("_p").orderBy(*order))).checkpoint()
    sizes = own.groupBy("_p").agg(F.max("_n").alias("_s"))
    # As many rows as there are partitions.
    before = sizes.withColumn("_before", F.coalesce(F.sum("_s").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return own.join(F.broadcast(before.select("_p", "_before")), "_p").withColumn(name, F.col("_before") + F.col("_n")).drop("_p", "_n", "_before")


def conflicts(annotations: DataFrame, events: DataFrame) -> DataFrame:
    """Where users and models disagree: ``event``, ``about`` ('affect' or 'knowledge'), ``annotation`` (null for the latter) and
    ``conflict``, 'cfl_0001' and so on, in the order of events and of their annotations.

    A mood that is given where ``events`` have an ``affect`` is one, and so is an event that is essential and excluded at once.
    """
    felt = events.where(F.size("affect") > 0).select("event")
    moods = annotations.where("type = 'mood'").join(felt, "event", "left_semi").select("event", F.lit("affect").alias("about"), F.col("id").alias("annotation"), F.lit(0).alias("late"), "priority", "created")
    both = folded_annotations(annotations).where("contradictory").select("event", F.lit("knowledge").alias("about"), F.lit(None).cast(dict(annotations.dtypes)["id"]).alias("annotation"), F.lit(1).alias("late"))
    every = moods.unionByName(both, allowMissingColumns=True)
    out = numbered(every, ["event", "late", "priority", "created", "annotation"], "n")
    return out.select("event", "about", "annotation", F.concat(F.lit("cfl_"), F.when(F.col("n") < 10000, F.lpad(F.col("n").cast("string"), 4, "0")).otherwise(F.col("n").cast("string"))).alias("conflict"))


def assessed(assessments: DataFrame, folded: DataFrame) -> DataFrame:
    """Assessments (``event``, ``importance``, ``preserve``, ``role``, ``probabilities``) as users decided them, ``current`` first.

    An importance that a user gave replaces the model's and keeps the moment (``preserve``) at least as much; a role replaces the
    distribution by certainty. The model's own answer stays beside it, as a row of its own with ``current`` false.
    """
    k = folded.select("event", F.col("importance").alias("_importance"), F.col("role").alias("_role"))
    a = assessments.join(k, "event", "left")
    changed = F.col("_importance").isNotNull() | F.col("_role").isNotNull()
    now = a.select(
        "event", F.coalesce("_importance", "importance").alias("importance"), F.when(F.col("_importance").isNotNull(), F.greatest("preserve", "_importance")).otherwise(F.col("preserve")).alias("preserve"),
        F.coalesce("_role", "role").alias("role"), F.when(F.col("_role").isNotNull(), F.create_map("_role", F.lit(1.0))).otherwise(F.col("probabilities")).alias("probabilities"), F.lit(True).alias("current"),
    )
    return now.unionByName(a.where(changed).select("event", "importance", "preserve", "role", "probabilities", F.lit(False).alias("current")))


def continuity_overrides(annotations: DataFrame) -> DataFrame:
    """Strengths that users set between pairs of events (``event``, ``other``): the last by ``created`` and ``id``."""
    pairs = annotations.where("type = 'continuity' and other is not null")
    return pairs.groupBy(F.col("event").alias("source"), F.col("other").alias("target")).agg(F.max_by("value", F.struct("created", "id")).alias("strength"))
