"""PII surrogates: detected entities receive keyed replacements of the same type, gender, script and format, with
collision checks that keep different entities different and equal ones equal. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm._common import written

#: What is detected, tried in this order at each place of a text. No pattern repeats a group without a bound, so that
#: texts of any length are matched without recursion.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-][A-Za-z0-9.-]*(?<=\.[A-Za-z]{2,24})",
    "ipv6": r"(?<![\w:])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){2,6}(?::[0-9A-Fa-f]{1,4}){1,5})(?![\w:])",
    "ip": r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\w]|\.\d)",
    "iban": r"(?<![\w-])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![\w-])",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "card": r"(?<![\w+-])\d(?:[ -]?\d){12,18}(?![\w-])",
    "phone": r"(?<![\w+(])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)|\d{2,4})[ .-]?\d{3,4}[ .-]\d{3,4}(?![\w-])"
    r"|(?<![\w+])\+\d(?:[ .-]?\d){7,14}(?![\w-])|(?<![\w+])0\d(?:[ .]\d\d){4}(?![\w-])|(?<=\b(?:[Cc]all|[Pp]hone|[Tt]el|[Ff]ax|[Mm]obile)[.:]? )\d{9,11}(?![\w-])",
    "name": r"\b(?:Mrs|Mr|Ms|Miss|Dr|Prof|Herr|Frau|Mme|Monsieur|Madame|Señora|Señor)\.? \p{Lu}\p{Ll}++(?:-\p{Lu}\p{Ll}++)?(?: \p{Lu}\p{Ll}++(?:-\p{Lu}\p{Ll}++)?)?",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: A text without one of these holds no entity.
HINT = r"@|\d[\d .)-]{5}|[0-9A-Fa-f]:[0-9A-Fa-f:]|\b[A-Z]{2}\d\d|\b(?:M(?:rs?|s|iss|me|onsieur|adame)|Dr|Prof|Herr|Frau|Señora?)\.? \p{Lu}"

_TITLE = r"^((?:Mrs|Mr|Ms|Miss|Dr|Prof|Herr|Frau|Mme|Monsieur|Madame|Señora|Señor)\.? )?(.*)$"
#: Between a part of a name and its gender.
_MARK = "\x1f"
#: Draws after which a surrogate grows by a character, so that a small format never runs out.
DRAWS = 2
_SYLLABLES = {
    "latin": ("b c d f g h k l m n p r s t v".split(), "a e i o u ai ea ou".split(), {"f": "a", "m": "o", "x": "en"}),
    "cyrillic": ("б в г д з к л м н п р с т".split(), "а е и о у я ю".split(), {"f": "а", "m": "ий", "x": "о"}),
    "greek": ("β γ δ κ λ μ ν π ρ σ τ φ".split(), "α ε η ι ο ου".split(), {"f": "α", "m": "ος", "x": "ι"}),
}


def kind_of(value: Column) -> Column:
    """Type of a detected string."""
    one = lambda p: value.rlike(f"^(?:{PATTERNS[p]})$")
    out = F.when(F.contains(value, F.lit("@")), "email")
    for kind in ("ipv6", "ip", "iban", "ssn", "card"):
        out = out.when(one(kind), kind)
    return out.when(value.rlike(r"^[+(\d]"), "phone").otherwise("name")


def canonical(kind: Column, value: Column) -> Column:
    """What equal entities other than names share: digits of numbers, addresses in lower case, accounts without spaces."""
    return F.when(kind.isin("ssn", "card", "phone"), F.regexp_replace(value, r"\D", "")).when(kind == "iban", F.regexp_replace(value, " ", "")).otherwise(F.lower(value))


def gender(value: Column) -> Column:
    """Gender that a title tells: f, m, or x."""
    return F.when(value.rlike(r"^(?:Mrs|Ms|Miss|Frau|Mme|Madame|Señora)\b"), "f").when(value.rlike(r"^(?:Mr|Herr|Monsieur|Señor)\b"), "m").otherwise("x")


def _draw(seed: Column, i: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(seed, i), F.lit(n)).cast("int")


def _shaped(seed: Column, text: Column) -> Column:
    """``text`` with letters for letters, of the same case, and digits for digits."""

    def letter(c: Column, i: Column) -> Column:
        pick = lambda alphabet: F.substring(F.lit(alphabet), _draw(seed, i, len(alphabet)) + 1, F.lit(1))
        return F.when(c.rlike("[a-z]"), pick("abcdefghijklmnopqrstuvwxyz")).when(c.rlike("[A-Z]"), pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ")).when(c.rlike("[0-9]"), pick("0123456789")).otherwise(c)

    return F.array_join(F.transform(F.split(text, ""), letter), "")


def _digits(seed: Column, old: Column, keep: Column) -> Column:
    """Digits for digits, the first ``keep`` as they are."""
    return F.concat(F.substring(old, F.lit(1), keep), _shaped(seed, F.substring(old, keep + 1, F.length(old))))


def _checked(number: Column) -> Column:
    """A card number whose last digit fits the others by Luhn's rule."""
    body = F.reverse(F.substring(number, F.lit(1), F.length(number) - 1))

    def add(total: Column, i: Column) -> Column:
        d = F.substring(body, i, F.lit(1)).cast("int")
        twice = 2 * d
        return total + F.when(i % 2 == 1, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d)

    total = F.aggregate(F.sequence(F.lit(1), F.length(body)), F.lit(0), add)
    return F.concat(F.reverse(body), ((10 - total % 10) % 10).cast("string"))


def _name(seed: Column, old: Column, sex: Column) -> Column:
    """A name for a part of a name, in its script; a given name's end shows its gender."""

    def made(script: str) -> Column:
        first, second, ends = _SYLLABLES[script]
        pick = lambda xs, k: F.element_at(F.array(*map(F.lit, xs)), _draw(seed, F.lit(k), len(xs)) + 1)
        end = F.when(sex == "f", ends["f"]).when(sex == "m", ends["m"]).otherwise(ends["x"])
        return F.concat(F.initcap(pick(first, 1)), pick(second, 2), pick(first, 3), pick(second, 4), pick(first, 5), end)

    return F.when(old.rlike(r"\p{IsCyrillic}"), made("cyrillic")).when(old.rlike(r"\p{IsGreek}"), made("greek")).otherwise(made("latin"))


def _hexed(seed: Column, text: Column) -> Column:
    """``text`` with hexadecimal digits for hexadecimal digits."""
    digit = lambda c, i: F.when(c == ":", c).otherwise(F.substring(F.lit("0123456789abcdef"), _draw(seed, i, 16) + 1, F.lit(1)))
    return F.array_join(F.transform(F.split(text, ""), digit), "")


def _seeded(entities: DataFrame, key: str) -> DataFrame:
    """``entities`` with the ``seed`` of each draw, written: it is read for every character of a surrogate."""
    return written(entities.withColumn("seed", F.sha2(F.concat_ws(_MARK, F.lit(key), "kind", "canon", F.col("attempt").cast("string")), 256)))


def _surrogate() -> Column:
    """Replacement of a canonical entity (columns ``kind``, ``canon``, ``sex``, ``attempt``, ``seed``)."""
    kind, canon, sex, attempt, seed = (F.col(c) for c in ("kind", "canon", "sex", "attempt", "seed"))
    more = F.floor(attempt / DRAWS).cast("int")
    letters = _shaped(F.sha2(seed, 256), F.repeat(F.lit("a"), more))
    digits = _shaped(F.sha2(seed, 256), F.repeat(F.lit("0"), more))
    at = F.instr(canon, "@")
    end = F.regexp_extract(canon, r"\.[a-z]+$", 0)
    host = F.substring(canon, at + 1, F.length(canon) - at - F.length(end))
    email = F.concat(_shaped(seed, F.substring(canon, F.lit(1), at - 1)), letters, F.lit("@"), F.regexp_replace(_shaped(F.sha2(F.concat(seed, F.lit("@")), 256), host), "^-|-$", "x"), end)
    ip = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: (_draw(seed, i, 254) + 1).cast("string")), ".")
    iban = F.concat(F.substring(canon, F.lit(1), F.lit(2)), _shaped(seed, F.substring(canon, F.lit(3), F.length(canon))))
    out = F.when(kind == "email", email).when(kind == "ip", ip).when(kind == "ipv6", _hexed(seed, canon)).when(kind == "iban", iban)
    out = out.when(kind == "card", _checked(_digits(seed, canon, F.lit(1))))
    out = out.when(kind == "phone", F.concat(_digits(seed, canon, F.when(F.length(canon) > 10, F.length(canon) - 10).otherwise(F.lit(0))), digits))
    return out.when(kind == "ssn", F.concat(_digits(seed, canon, F.lit(0)), digits)).otherwise(F.concat(_name(seed, canon, sex), letters))


def surrogates(entities: DataFrame, key: str) -> DataFrame:
    """One surrogate per entity: ``kind``, ``canon``, ``surrogate``.

    A surrogate that another entity has too, or that equals an entity of the corpus, is drawn again for all but the
    least of those that share it, until none is left. Where a format has few members it grows with the draws.
    """
    known = written(entities.groupBy("kind", "canon").agg(F.min("sex").alias("sex")))
    real = known.select("kind", F.substring_index("canon", _MARK, 1).alias("surrogate")).distinct()
    now = written(_seeded(known.withColumn("attempt", F.lit(0)), key).withColumn("surrogate", _surrogate()))
    while True:
        owner = now.groupBy("kind", "surrogate").agg(F.min("canon").alias("owner"), F.count("*").alias("n")).where("n > 1").select("kind", "surrogate", "owner")
        taken = now.join(real, ["kind", "surrogate"], "left_semi").select("kind", "canon")
        shared = now.join(owner, ["kind", "surrogate"]).where("canon <> owner").select("kind", "canon")
        again = written(shared.union(taken).distinct())
        if not again.limit(1).count():
            return now.select("kind", "canon", "surrogate")
        redrawn = F.col("again").isNotNull()
        attempt = F.col("attempt") + F.when(redrawn, 1).otherwise(0)
        now = _seeded(now.join(again.withColumn("again", F.lit(True)), ["kind", "canon"], "left").withColumn("attempt", attempt), key)
        now = written(now.withColumn("surrogate", F.when(redrawn, _surrogate()).otherwise(F.col("surrogate"))).drop("again"))


def _formatted(value: Column, kind: Column, surrogate: Column) -> Column:
    """The surrogate as the entity was written: its punctuation and capitals."""
    place = lambda i: F.length(F.regexp_replace(F.substring(value, F.lit(1), i), r"\D", ""))
    digit = lambda c, i: F.when(c.rlike(r"\d"), F.substring(surrogate, place(i + 1), F.lit(1))).otherwise(c)
    own = F.length(F.regexp_replace(value, r"\D", ""))
    numbers = F.concat(F.array_join(F.transform(F.split(value, ""), digit), ""), F.substring(surrogate, own + 1, F.length(surrogate)))
    upper = F.when((F.upper(value) == value) & (F.lower(value) != value), F.upper(surrogate)).otherwise(surrogate)
    spaced = F.when(F.contains(value, F.lit(" ")), F.trim(F.regexp_replace(surrogate, "(.{4})", "$1 "))).otherwise(surrogate)
    return F.when(kind.isin("ssn", "card", "phone"), numbers).when(kind.isin("email", "ipv6"), upper).when(kind == "iban", spaced).otherwise(surrogate)


def pseudonymised(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with every detected entity replaced, and ``n_entities``, the number of replacements. ``key`` is a secret.

    The same entity has the same surrogate everywhere, however it is written, and different entities have different
    ones, none of which is itself an entity of the corpus. Names are found after a title, and then wherever the same
    document repeats a part of one; they are replaced part by part, so that Mr. John Smith, Mr. Smith and Smith stay one
    surname, and a given name takes the gender of the title before it: in documents in which it stands for different
    genders it is another name. Texts without entities, and null and empty ones, are unchanged with ``n_entities`` 0.
    Rows with equal texts are treated alike, whatever their ids; other columns pass through (a column ``n_entities`` is
    replaced); an empty table gives an empty result.
    """
    names = [c for c in docs.columns if c != "n_entities"]
    docs = docs.select(*names)
    likely = F.coalesce(F.col("text").rlike(HINT), F.lit(False))
    once = F.regexp_extract_all("text", F.lit(ANY), F.lit(0))
    named = F.filter("_once", lambda v: v.rlike(_TITLE.replace(")?(.*)$", ")")))
    parts = F.array_distinct(F.flatten(F.transform(named, lambda v: F.split(F.regexp_replace(v, _TITLE, "$2"), "[ -]"))))
    # A part of a name that a title has shown is found wherever the text repeats it.
    again = F.concat(F.lit(ANY + r"|(?<![\p{L}\d])(?:"), F.array_join("_parts", "|"), F.lit(r")(?![\p{L}\d])"))
    # Few texts hold entities; only these are shuffled, by a digest of the text.
    own = docs.where(likely).withColumn("_once", once)
    some = own.where(F.size("_once") > 0).withColumn("_parts", parts).withColumn("_any", F.when(F.size("_parts") > 0, again).otherwise(F.lit(ANY))).withColumn("_text", F.sha2("text", 256))
    plain = docs.where(~likely).withColumn("n_entities", F.lit(0)).union(own.where(F.size("_once") == 0).drop("_once").withColumn("n_entities", F.lit(0)))
    found = F.when(F.size("_parts") > 0, F.regexp_extract_all("text", F.col("_any"), F.lit(0))).otherwise(F.col("_once"))
    # Copies of a text count once.
    each = some.groupBy("_text").agg(F.first(found).alias("found")).select("_text", F.posexplode("found").alias("i", "value"))
    about = written(each.withColumn("kind", kind_of(F.col("value"))))
    bare = F.regexp_replace("value", _TITLE, "$2")
    pieces = F.when(F.col("kind") == "name", F.split(bare, "[ -]")).otherwise(F.array(canonical(F.col("kind"), F.col("value"))))
    each = about.select("_text", "i", "kind", "value", F.posexplode(pieces).alias("j", "part"))
    given = about.where((F.col("kind") == "name") & bare.contains(" ")).select("_text", F.element_at(F.split(bare, "[ -]"), 1).alias("part"), gender(F.col("value")).alias("g")).where("g <> 'x'")
    sex = given.groupBy("_text", "part").agg(F.when(F.min("g") == F.max("g"), F.min("g")).otherwise("x").alias("g")).withColumn("kind", F.lit("name"))
    each = each.join(sex, ["_text", "part", "kind"], "left").withColumn("sex", F.coalesce("g", F.lit("x")))
    each = written(each.withColumn("canon", F.when(F.col("kind") == "name", F.concat_ws(_MARK, "part", "sex")).otherwise(F.col("part"))))
    mapped = each.join(surrogates(each, key), ["kind", "canon"])
    one = mapped.groupBy("_text", "i").agg(F.first("value").alias("value"), F.first("kind").alias("kind"), F.transform(F.array_sort(F.collect_list(F.struct("j", "surrogate"))), lambda x: x["surrogate"]).alias("s"))
    joined = F.transform(F.arrays_zip(F.col("s").alias("p"), F.regexp_extract_all(bare, F.lit("[ -]"), F.lit(0)).alias("q")), lambda x: F.concat(x["p"], F.coalesce(x["q"], F.lit(""))))
    whole = F.concat(F.regexp_extract("value", _TITLE, 1), F.array_join(joined, ""))
    new = one.select("_text", "i", F.when(F.col("kind") == "name", whole).otherwise(_formatted(F.col("value"), F.col("kind"), F.element_at("s", 1))).alias("new"))
    # A text's replacements are bounded by the text itself.
    lists = new.groupBy("_text").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "new"))), lambda x: x["new"]).alias("_new"))
    cut = F.split("text", F.col("_any"), -1)
    woven = F.concat_ws("", F.flatten(F.transform(F.arrays_zip(cut.alias("p"), F.col("_new").alias("q")), lambda x: F.array(F.coalesce(x["p"], F.lit("")), F.coalesce(x["q"], F.lit(""))))))
    both = some.join(lists, "_text")
    changed = both.select(*[woven.alias("text") if c == "text" else F.col(c) for c in names], F.size("_new").alias("n_entities"))
    return plain.unionByName(changed)


def counted(frame: DataFrame) -> DataFrame:
    """``n_chars``, where there is such a column, as the length of the text."""
    if "n_chars" not in frame.columns:
        return frame
    return frame.withColumn("n_chars", F.length("text").cast(frame.schema["n_chars"].dataType))
