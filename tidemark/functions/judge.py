"""Closed-form estimates of an event's metrics, flags and narrative roles, all between 0 and 1."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.numbers import clamp


# Words that point back, as an utterance begins.
OPENERS = [
    "それ", "これ", "あれ", "そこ", "ここ", "その", "この", "あの", "だから", "でも", "そして",
    "this", "that", "these", "those", "so ", "but ", "and ", "then ", "it ",
]


def _if(test: Column, amount: float) -> Column:
    return F.when(test, amount).otherwise(0.0)


def density(chars: Column, seconds: Column, has_ocr: Column, labels: Column) -> Column:
    return clamp(0.7 * clamp(chars / F.greatest(F.lit(1.0), seconds) / 10) + _if(has_ocr, 0.15) + 0.25 * clamp(labels / 5))


def emotion(affect: Column, lively: Column) -> Column:
    """Strongest affect (0.2 if none); 0.65 at least where there is laughter, applause or cheering."""
    strongest = F.coalesce(F.array_max(F.map_values(affect)), F.lit(0.2))
    return clamp(F.when(lively, F.greatest(F.lit(0.65), strongest)).otherwise(strongest))


def redundancy(similarity: Column) -> Column:
    return clamp(F.coalesce((similarity - 0.6) / 0.4, F.lit(0.2)))


def context(wanted: Column, cover: Column) -> Column:
    return F.when(F.size(wanted) == 0, 0.5).otherwise(clamp(0.35 + 0.65 * cover))


def story(essential: Column, emotional: Column, dense: Column, fits: Column, people: Column, redundant: Column, ms: Column) -> Column:
    value = 0.3 + 0.25 * emotional + 0.2 * dense + 0.15 * fits + _if(people, 0.1) - 0.25 * redundant - _if(ms < 1500, 0.1)
    return F.when(essential, 1.0).otherwise(clamp(value))


def audio(speech: Column, silence: Column) -> Column:
    return F.when((speech == 0) & (silence == 0), 0.5).otherwise(clamp(0.45 + 0.45 * speech - 0.3 * F.greatest(F.lit(0.0), silence - 0.5)))


def preserve(essential: Column, importance: Column) -> Column:
    return F.when(essential, 1.0).otherwise(clamp(0.15 + 0.85 * importance))


def opening(position: Column, emotional: Column, arrives: Column) -> Column:
    return clamp(F.when(position < 0.2, 0.4).otherwise(0.05) + 0.4 * emotional + _if(arrives, 0.2))


def ending(position: Column, emotional: Column, farewell: Column) -> Column:
    return clamp(F.when(position > 0.75, 0.4).otherwise(0.05) + 0.3 * emotional + _if(farewell, 0.3))


def b_roll(speech: Column, quality: Column) -> Column:
    return clamp(F.when(speech < 0.2, 0.5).otherwise(0.05) + 0.4 * F.coalesce(quality, F.lit(0.5)))


def escalation(confidence: Column, share: Column, speech: Column, ocr: Column) -> Column:
    """How much a closer look at an event is worth."""
    return clamp(0.6 * (1 - confidence) + 0.3 * F.least(F.lit(1.0), share * 20) + _if(speech, 0.2) + _if(ocr, 0.1))


# Terms of the flags and role weights below.
def establishing(speechless: Column, places: Column, shots: Column, ms: Column) -> Column:
    return clamp(F.when(speechless, 0.4).otherwise(0.05) + _if(places, 0.3) + _if(shots <= 2, 0.2) + _if(ms >= 2000, 0.1))


def opening_flag(position: Column, emotional: Column, arrives: Column) -> Column:
    return clamp(F.when(position < 0.2, 0.35).otherwise(0.05) + 0.4 * emotional + _if(arrives, 0.2))


def needs_context(opener: Column, reaction: Column, deictic: list[str]) -> Column:
    """Whether a normalised first utterance leans on what was said before: it begins with a pointing word."""
    points = F.lit(False)
    for word in deictic:
        points = points | opener.startswith(word)
    return clamp(F.when(F.coalesce(points, F.lit(False)), 0.55).otherwise(0.15) + _if(reaction, 0.25))


def role_weights(kind: Column, position: Column, emotional: Column, speechless: Column, no_text: Column, nothing_seen: Column) -> Column:
    """Map of narrative roles to weights, from an event's kind, place, intensity and what is said and seen in it."""
    filler = speechless & (emotional < 0.3) & no_text & nothing_seen
    seen = speechless & ~nothing_seen & ~filler
    travels, broll = kind.isin("travel", "departure"), kind == "b_roll"
    weights = {
        "setup": 0.1 + _if(kind == "arrival", 0.15) + _if(position < 0.15, 0.3),
        "context": 0.1 + _if(kind == "explanation", 0.5) + _if(broll, 0.2) + _if(seen, 0.2),
        "build_up": F.lit(0.1),
        "transition": 0.1 + _if(travels, 0.5) + _if(broll, 0.2) + _if(seen, 0.15),
        "payoff": 0.1 + _if(kind == "arrival", 0.35) + _if((emotional > 0.6) & (emotional <= 0.8), 0.25),
        "climax": 0.05 + F.when(emotional > 0.8, 0.3 * emotional).otherwise(0.0),
        "reaction": 0.1 + _if(kind == "reaction", 0.5),
        "resolution": 0.05 + _if(position > 0.85, 0.25),
        "ending": 0.05 + _if(kind == "farewell", 0.6) + _if(position > 0.85, 0.25),
        "filler": 0.1 + _if(filler, 0.4),
    }
    return F.create_map(*[x for k, v in weights.items() for x in (F.lit(k), v)])


def entropy_distribution(mean: Column, levels: int) -> Column:
    """Probabilities of levels 0 to ``levels`` - 1 with this mean that assume nothing else: p_i in proportion to exp(rate * i), the rate
    found by 60 halvings of [-60, 60] at most. A mean at an end, or beyond, is a spike there."""
    last = levels - 1
    weights = lambda rate: [F.exp(rate * i - F.when(rate >= 0, rate * last).otherwise(0.0)) for i in range(levels)]

    def halve(s: Column, _: Column) -> Column:
        rate = (s["low"] + s["high"]) / 2
        w = weights(rate)
        now = sum((x * i for i, x in enumerate(w)), F.lit(0.0)) / sum(w[1:], w[0])
        near = F.abs(now - mean) < 1e-9
        kept = F.struct(s["low"].alias("low"), s["high"].alias("high"), s["rate"].alias("rate"), s["done"].alias("done"))
        low, high = F.when(~near & (now < mean), rate).otherwise(s["low"]), F.when(~near & (now >= mean), rate).otherwise(s["high"])
        return F.when(s["done"], kept).otherwise(F.struct(low.alias("low"), high.alias("high"), rate.alias("rate"), near.alias("done")))

    start = F.struct(F.lit(-60.0).alias("low"), F.lit(60.0).alias("high"), F.lit(0.0).alias("rate"), F.lit(False).alias("done"))
    found = F.aggregate(F.sequence(F.lit(1), F.lit(60)), start, halve, lambda s: s["rate"])
    spike = lambda k: F.array(*[F.lit(float(i == k)) for i in range(levels)])
    shares = F.element_at(F.transform(F.array(found), lambda rate: F.array(*[x / sum(weights(rate)[1:], weights(rate)[0]) for x in weights(rate)])), 1)
    return F.when(mean <= 0, spike(0)).when(mean >= last, spike(last)).otherwise(shares)


def two_point_distribution(mean: Column, levels: int) -> Column:
    """The narrowest one with this mean: the two levels around it."""
    at = F.greatest(F.lit(0.0), F.least(F.lit(float(levels - 1)), mean))
    return F.array(*[F.greatest(F.lit(0.0), 1 - F.abs(at - i)) for i in range(levels)])


def unit_distribution(value: Column, levels: int, concentration: float = 0.4) -> Column:
    """A value from 0 to 1 as probabilities of ``levels`` ordered levels with that mean, to four places: a blend of the widest and the
    narrowest such distribution. One level takes all."""
    if levels <= 1:
        return F.array(F.lit(1.0))
    mean, c = clamp(value) * (levels - 1), min(1.0, max(0.0, concentration))
    return F.zip_with(entropy_distribution(mean, levels), two_point_distribution(mean, levels), lambda a, b: F.floor(((1 - c) * a + c * b) * 10000 + 0.5) / 10000)


def unit_value(probabilities: Column, levels: int) -> Column:
    """The mean of such a distribution on the scale from 0 to 1, to four places."""
    total = F.aggregate(F.transform(probabilities, lambda p, i: p * i), F.lit(0.0), lambda a, x: a + x)
    return F.floor(total / max(1, levels - 1) * 10000 + 0.5) / 10000
