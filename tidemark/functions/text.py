"""Text as columns: normalisation, tokens, match features, coverage and mentions."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Scripts written without spaces, as a character class.
SPACELESS = r"぀-ヿ㐀-䶿一-鿿豈-﫿ｦ-ﾟ"
#: Scripts that a Latin vocabulary can't serve.
OTHER_SCRIPTS = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}\p{IsCyrillic}\p{IsArabic}\p{IsHebrew}\p{IsThai}\p{IsDevanagari}]"


@F.pandas_udf(StringType())
def _compatible(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in parts:
        yield s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def normalize_text(text: Column, compatibility: bool = False) -> Column:
    """Lower case, punctuation and symbols as spaces, white space collapsed and trimmed.

    ``compatibility`` folds compatibility forms (full-width letters, ligatures) first; that needs a pandas UDF, so
    leave it off for text known to have none.
    """
    base = _compatible(text) if compatibility else text
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(base), r"[\p{P}\p{S}]+", " "), r"\s+", " "))


def tokens(text: Column, compatibility: bool = False) -> Column:
    """Words of normalised text; empty for null."""
    words = F.split(normalize_text(text, compatibility), " ")
    return F.coalesce(F.filter(words, lambda w: w != ""), F.array().cast("array<string>"))


def features(text: Column, compatibility: bool = False) -> Column:
    """Distinct match features: words longer than one letter, and pairs of neighbours in scripts without spaces (a
    single such character stands for itself)."""
    runs = F.flatten(F.transform(tokens(text, compatibility), lambda w: F.regexp_extract_all(w, F.lit(f"[{SPACELESS}][{SPACELESS}\\p{{IsLatin}}0-9]*|[^{SPACELESS}]+"), F.lit(0))))

    def of_run(run: Column) -> Column:
        pairs = F.transform(F.sequence(F.lit(1), F.length(run) - 1), lambda i: F.substring(run, i, F.lit(2)))
        spaceless = run.rlike(f"^[{SPACELESS}]")
        return F.when(spaceless & (F.length(run) == 1), F.array(run)).when(spaceless, pairs).when(F.length(run) > 1, F.array(run)).otherwise(F.array().cast("array<string>"))

    plain = F.filter(tokens(text, compatibility), lambda w: F.length(w) > 1)
    split = F.coalesce(text.rlike(f"[{SPACELESS}]"), F.lit(False))
    return F.array_distinct(F.when(split, F.flatten(F.transform(runs, of_run))).otherwise(plain))


def coverage(needle: Column, haystack: Column) -> Column:
    """Share of the needle's features that the haystack has; 0 if either has none. Both are feature arrays."""
    n = F.size(needle)
    return F.when((n > 0) & (F.size(haystack) > 0), F.size(F.array_intersect(needle, haystack)) / n).otherwise(F.lit(0.0))


def overlap_coefficient(a: Column, b: Column) -> Column:
    """Shared features over the smaller set; 0 if either is empty."""
    n = F.least(F.size(a), F.size(b))
    return F.when(n > 0, F.size(F.array_intersect(a, b)) / n).otherwise(F.lit(0.0))


def mentions(text: Column, *needles: str) -> Column:
    """Whether normalised text contains one of the normalised needles; empty needles never match."""
    found = F.lit(False)
    for n in needles:
        n = " ".join("".join(c if unicodedata.category(c)[0] not in "PS" else " " for c in n.lower()).split())
        if n:
            found = found | F.contains(normalize_text(text), F.lit(n))
    return F.coalesce(found, F.lit(False))


def mentions_form(text: Column, form: str) -> Column:
    """Whether a surface form of two characters or more appears: between non-letters where it is Latin, anywhere else."""
    if len(form) < 2:
        return F.lit(False)
    latin = all("LATIN" in unicodedata.name(c, "") for c in form if c.isalpha())
    edge = r"[\p{IsLatin}\p{N}]"
    pattern = rf"(?<!{edge})\Q{form.lower()}\E(?!{edge})" if latin else rf"\Q{form.lower()}\E"
    return F.coalesce(F.lower(text).rlike(pattern), F.lit(False))


def readable(text: Column) -> Column:
    """Whether text keeps to scripts that a Latin vocabulary serves."""
    return ~F.coalesce(text.rlike(OTHER_SCRIPTS), F.lit(False))


def shortened(text: Column, most: int) -> Column:
    """White space collapsed, cut to ``most`` characters with an ellipsis."""
    t = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(t) > most, F.concat(F.rtrim(F.substring(t, 1, most - 1)), F.lit("…"))).otherwise(t)


def line_key(text: Column) -> Column:
    """Key under which two readings of a line are the same: lower case, no white space."""
    return F.lower(F.regexp_replace(text, r"\s+", ""))


def display_length(text: Column) -> Column:
    """Characters as they are counted on a caption's line."""
    return F.length(text)


#: Characters on a line of a caption, of spaced scripts and of others, and the lines of one. Fixed values.
SPACED_LINE, DENSE_LINE, LINES = 42, 13, 2
_DENSE = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}]"


def is_dense(text: Column) -> Column:
    """Whether half of a text's characters or more are of scripts written without spaces."""
    plain = F.regexp_replace(text, r"\s", "")
    return (F.length(plain) > 0) & (F.length(F.regexp_replace(plain, _DENSE, "")) * 2 <= F.length(plain))


def _greedy(words: Column, limit: int) -> Column:
    """Lines filled with words one after another."""

    def add(done: Column, w: Column) -> Column:
        joins = F.length(done["line"]) + 1 + F.length(w) <= limit
        empty = F.length(done["line"]) == 0
        line = F.when(empty, w).when(joins, F.concat_ws(" ", done["line"], w)).otherwise(w)
        lines = F.when(empty | joins, done["lines"]).otherwise(F.concat(done["lines"], F.array(done["line"])))
        return F.struct(lines.alias("lines"), line.alias("line"))

    start = F.struct(F.array().cast("array<string>").alias("lines"), F.lit("").alias("line"))
    return F.aggregate(words, start, add, lambda d: F.when(F.length(d["line"]) > 0, F.concat(d["lines"], F.array(d["line"]))).otherwise(d["lines"]))


def wrapped(text: Column, limit: int = SPACED_LINE) -> Column:
    """Lines of a caption of a spaced script: two, as equal as they can be and rather the second longer, or as many as it
    takes to fill them one by one where two won't hold it."""
    words = F.split(text, " ")
    head = lambda at: F.array_join(F.slice(words, F.lit(1), at), " ")
    tail = lambda at: F.array_join(F.slice(words, at + 1, F.size(words)), " ")
    places = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(words) - 1))
    scored = F.transform(places, lambda at: F.struct((F.abs(F.length(head(at)) - F.length(tail(at))) + F.when(F.length(head(at)) > F.length(tail(at)), 0.5).otherwise(0.0)).alias("score"), at.alias("at"), (F.greatest(F.length(head(at)), F.length(tail(at))) <= limit).alias("fits")))
    best = F.array_min(F.filter(scored, lambda s: s["fits"]))
    two = F.array(head(best["at"]), tail(best["at"]))
    return F.when(F.length(text) <= limit, F.array(text)).when((F.length(text) > limit * LINES) | (F.size(words) < 2) | best.isNull(), _greedy(words, limit)).otherwise(two)


#: Marks and small letters that no line of a dense script begins with, and marks that one rather ends with. Fixed values.
NOT_FIRST = "、。，．・：；？！ー」』）】〕〉》”’ぁぃぅぇぉっゃゅょゎァィゥェォッャュョヮヵヶ!?,.)]"
LAST = "、。，．！？!?,"


def wrapped_dense(text: Column, limit: int = DENSE_LINE) -> Column:
    """Lines of a caption of a script without spaces: two, as equal as they can be, rather behind a mark and rather the second longer;
    or lines filled one by one where two won't hold it. No line begins with a closing mark or a small letter, if that can be."""
    chars = F.split(text, "")
    n = F.size(chars)
    one = lambda marks, c: F.contains(F.lit(marks), c)
    part = lambda at, m: F.trim(F.array_join(F.slice(chars, at + 1, m), ""))
    places = F.filter(F.sequence(F.lit(1), F.greatest(F.lit(1), n - 1)), lambda at: (at <= limit) & (n - at <= limit) & ~one(NOT_FIRST, F.get(chars, at)))
    score = lambda at: F.abs(2 * at - n) - F.when(one(LAST, F.get(chars, at - 1)), limit).otherwise(0) + F.when(2 * at > n, 0.5).otherwise(0.0)
    best = F.coalesce(F.array_min(F.transform(places, lambda at: F.struct(score(at).alias("score"), at.alias("at"))))["at"], F.lit(limit))
    two = F.filter(F.array(part(F.lit(0), best), part(best, F.greatest(F.lit(0), n - best))), lambda line: line != "")

    def add(done: Column, _: Column) -> Column:
        at = done["at"]
        fit = F.coalesce(F.array_max(F.filter(F.sequence(F.lit(1), F.lit(limit)), lambda m: (m == 1) | ~one(NOT_FIRST, F.get(chars, at + m)))), F.lit(1))
        m = F.when(n - at <= limit, n - at).otherwise(fit)
        more = F.struct((at + m).alias("at"), F.concat(done["lines"], F.array(part(at, m))).alias("lines"))
        return F.when(at >= n, F.struct(at.alias("at"), done["lines"].alias("lines"))).otherwise(more)

    filled = F.aggregate(F.sequence(F.lit(1), n), F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("lines")), add, lambda d: d["lines"])
    return F.when(n <= limit, F.array(text)).when(n > limit * LINES, filled).otherwise(two)


def caption_lines(text: Column) -> Column:
    """Lines of a caption, by its script."""
    return F.when(is_dense(text), wrapped_dense(text)).otherwise(wrapped(text))
