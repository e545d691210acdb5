"""Recordings of one moment: which pairs to compare, by how much they are apart, and a recorder's speech in place of a camera's.

Offsets are the peaks of cross-correlations of onset envelopes. Envelopes are cut into blocks, so that recordings of any length
are compared: each pair of blocks gives two runs of lags, which Spark adds up.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators.components import checkpoint_folder
from tidemark.operators.intervals import overlap_join

#: Least ratio of a peak to its best rival, how far off a rival is, the least overlap, and the share of a video that a recorder
#: must cover to be its sound: fixed values.
LEAST_RATIO, APART_MS, LEAST_OVERLAP_MS, COVER = 1.5, 500, 1000, 0.5


def sync_candidates(assets: DataFrame, by: list[str], cap: int, slack: int = 60_000, width: int = 3_600_000) -> DataFrame:
    """Pairs of recordings to compare within each project: ``asset``, ``reference`` and ``place`` (from 0), less than ``cap``.

    ``assets``: ``by``, ``id``, ``kind`` ('video' or 'audio'), ``has_audio``, ``start`` (capture time in ms, null if unknown)
    and ``ms``. First every sound-only recording against every video, by their ids; then videos whose capture times overlap, or
    lie within ``slack``, the later id against the earlier. Of recordings and videos only those are joined whose pairs come
    before ``cap``. ``skipped_pairs`` counts the rest.
    """
    recorded, overlapping = _candidates(assets, by, slack, width)
    sound = recorded.where((F.col("r") - 1) * F.col("videos") < cap).drop("videos")
    videos = recorded.where((F.col("kind") == "video") & (F.col("v") <= cap)).select(*by, F.col("id").alias("reference"), "v", "videos")
    pairs = sound.where("kind = 'audio'").select(*by, F.col("id").alias("asset"), "r").join(videos, by)
    first = pairs.withColumn("place", (F.col("r") - 1) * F.col("videos") + F.col("v") - 1).where(F.col("place") < cap)
    return first.select(*by, "asset", "reference", "place").unionByName(overlapping.where(F.col("place") < cap))


def skipped_pairs(assets: DataFrame, by: list[str], cap: int, slack: int = 60_000, width: int = 3_600_000) -> DataFrame:
    """How many pairs of each project ``cap`` leaves out: ``by``, ``pairs``, ``skipped``."""
    recorded, overlapping = _candidates(assets, by, slack, width)
    each = F.sum((F.col("kind") == "audio").cast("long")) * F.sum((F.col("kind") == "video").cast("long"))
    both = recorded.groupBy(*by).agg(each.alias("n")).join(overlapping.groupBy(*by).agg(F.count("*").alias("m")), by, "left")
    total = F.col("n") + F.coalesce("m", F.lit(0))
    return both.select(*by, total.alias("pairs"), F.greatest(F.lit(0), total - cap).alias("skipped"))


def _candidates(assets: DataFrame, by: list[str], slack: int, width: int) -> tuple[DataFrame, DataFrame]:
    own = Window.partitionBy(*by)
    number = lambda kind: F.sum((F.col("kind") == kind).cast("long")).over(own.orderBy("id").rowsBetween(Window.unboundedPreceding, 0))
    count = lambda kind: F.sum((F.col("kind") == kind).cast("long")).over(own)
    heard = assets.where("has_audio").withColumns({"r": number("audio"), "v": number("video"), "videos": count("video"), "recorders": count("audio")})
    timed = heard.where("kind = 'video' and start is not null")
    spans = timed.select(*by, "id", (F.col("start") - slack / 2).cast("long").alias("start"), (F.col("start") + F.col("ms") + slack / 2).cast("long").alias("end"), (F.col("videos") * F.col("recorders")).alias("before"))
    met = overlap_join(spans, spans.drop("before"), by, width).where("id < r_id")
    place = F.col("before") + F.row_number().over(own.orderBy("id", "r_id")) - 1
    return heard, met.select(*by, F.col("r_id").alias("asset"), F.col("id").alias("reference"), place.alias("place"))


def measured_offsets(envelopes: DataFrame, pairs: DataFrame, hop_ms: int = 10, block: int = 4096) -> DataFrame:
    """Where each pair's ``asset`` begins in its ``reference``'s time: ``offset_ms``, ``score`` (the peak over its best rival) and
    ``confidence``, for pairs that match.

    ``envelopes``: ``asset``, ``hop`` (from 0, without holes) and ``onset``. Pairs without a rival above zero, of a ratio under 1.5,
    or that would overlap by less than a second, don't match; nor does a recording without any change. Of equal peaks the
    earliest counts. A parabola through the peak's neighbours places it between hops.
    """
    checkpoint_folder(envelopes.sparkSession)
    stats = envelopes.groupBy("asset").agg(F.count("*").alias("n"), F.avg("onset").alias("mean"), (F.stddev_pop("onset") * F.sqrt(F.count("*"))).alias("norm")).where("norm > 0")
    scaled = envelopes.join(stats, "asset").select("asset", "n", F.floor(F.col("hop") / block).alias("b"), F.col("hop"), ((F.col("onset") - F.col("mean")) / F.col("norm")).alias("x"))
    blocks = scaled.groupBy("asset", "b", "n").agg(F.transform(F.array_sort(F.collect_list(F.struct("hop", "x"))), lambda s: s["x"]).alias("x")).checkpoint()
    a = blocks.select(F.col("asset").alias("reference"), F.col("b").alias("rb"), F.col("n").alias("rn"), F.col("x").alias("rx"))
    met = pairs.select("asset", "reference").distinct().join(blocks, "asset").join(a, "reference")

    def correlate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                c = np.fft.irfft(np.fft.rfft(r["rx"], 2 * block) * np.conj(np.fft.rfft(r["x"], 2 * block)), 2 * block)
                # Lags of this pair of blocks: those from their distance on, and the ones before.
                s, back = r["rb"] - r["b"], np.concatenate([[0.0], c[block + 1 :]])
                keys = {k: pa.array([r[k]] * 2) for k in ("asset", "reference", "n", "rn")}
                yield pa.RecordBatch.from_pydict({**keys, "part": pa.array([s, s - 1], pa.int64()), "c": pa.array([c[:block].tobytes(), back.tobytes()])})

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, total = None, None
        for batch in batches:
            for r in batch.to_pylist():
                key = {k: r[k] for k in ("asset", "reference", "n", "rn", "part")}
                if last is not None and key != last:
                    yield out(last, total)
                    total = None
                now = np.frombuffer(r["c"])
                last, total = key, now if total is None else total + now
        if last is not None:
            yield out(last, total)

    def out(key: dict, total: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({**{k: pa.array([v]) for k, v in key.items()}, "c": pa.array([total.tolist()], pa.list_(pa.float64()))})

    kinds = dict(envelopes.dtypes)
    ids = f"asset {kinds['asset']}, reference {kinds['asset']}, n long, rn long, part long"
    keys = ["asset", "reference", "part"]
    parts = met.mapInArrow(correlate, f"{ids}, c binary").repartition(*keys).sortWithinPartitions(*keys).mapInArrow(summed, f"{ids}, c array<double>").checkpoint()
    first = F.col("part") * block
    top = parts.withColumn("v", F.array_max("c")).withColumn("lag", first + F.array_position("c", F.col("v")) - 1)
    peaks = top.groupBy("asset", "reference", "n", "rn").agg(F.max("v").alias("peak"), F.max_by("lag", F.struct("v", -F.col("lag"))).alias("lag"))
    apart = max(2, round(APART_MS / hop_ms))
    beside = lambda d: F.sum(F.when(F.floor((F.col("lag") + d) / block) == F.col("part"), F.get("c", (F.col("lag") + d - first).cast("int"))))
    rival = F.array_max(F.filter("c", lambda v, i: F.abs(first + i - F.col("lag")) > apart))
    about = parts.join(peaks, ["asset", "reference", "n", "rn"]).groupBy("asset", "reference", "n", "rn", "peak", "lag").agg(F.max(rival).alias("rival"), F.coalesce(beside(-1), F.lit(0.0)).alias("left"), F.coalesce(beside(1), F.lit(0.0)).alias("right"))
    bend = F.col("left") - 2 * F.col("peak") + F.col("right")
    offset = F.floor((F.col("lag") + F.when(bend < 0, 0.5 * (F.col("left") - F.col("right")) / bend).otherwise(0.0)) * hop_ms + 0.5).cast("long")
    ratio = F.col("peak") / F.col("rival")
    good = about.where("peak > 0 and rival > 0").withColumn("ratio", ratio).where(F.col("ratio") >= LEAST_RATIO).withColumn("offset_ms", offset)
    shared = F.least(F.col("rn") * hop_ms, F.col("offset_ms") + F.col("n") * hop_ms) - F.greatest(F.lit(0), "offset_ms")
    sure = F.floor(F.least(F.lit(1.0), 0.5 + (F.col("ratio") - LEAST_RATIO) / 5) * 1000 + 0.5) / 1000
    return good.where(shared >= LEAST_OVERLAP_MS).select("asset", "reference", "offset_ms", (F.floor(F.col("ratio") * 100 + 0.5) / 100).alias("score"), sure.alias("confidence"))


def audio_companions(syncs: DataFrame, assets: DataFrame) -> DataFrame:
    """The recorder that is a video's sound: ``video``, ``recorder``, ``offset_ms``, ``confidence``, ``declared``, and the range
    ``start`` to ``end`` of the video that it covers.

    ``syncs``: ``asset``, ``reference``, ``offset_ms``, ``score``, ``confidence``, ``declared``; ``assets``: ``id``,
    ``kind``, ``ms``. A measured recorder covers half of the video at least, a declared one some of it. Declared ones come first,
    then higher scores, then smaller ids.
    """
    recorder = assets.where("kind = 'audio'").select(F.col("id").alias("asset"), F.col("ms").alias("_r"))
    video = assets.where("kind = 'video' and ms > 0").select(F.col("id").alias("reference"), F.col("ms").alias("_v"))
    both = syncs.where("confidence > 0").join(recorder, "asset").join(video, "reference")
    both = both.withColumns({"start": F.greatest(F.lit(0), "offset_ms"), "end": F.least("_v", F.col("offset_ms") + F.col("_r"))})
    covered = F.col("end") - F.col("start")
    fit = both.where(F.when(F.col("declared"), covered > 0).otherwise(covered >= COVER * F.col("_v")))
    order = Window.partitionBy("reference").orderBy(F.desc("declared"), F.desc("score"), "asset")
    best = fit.withColumn("_n", F.row_number().over(order)).where("_n = 1")
    return best.select(F.col("reference").alias("video"), F.col("asset").alias("recorder"), "offset_ms", "confidence", "declared", "start", "end")


def with_companion_speech(utterances: DataFrame, companions: DataFrame) -> DataFrame:
    """Utterances with each video's speech taken from its recorder where that covers it.

    ``utterances``: ``asset``, ``id`` (string), ``start``, ``end``, ``words`` (array of ``start``, ``end``, ``word``; may be
    null) and what else they have. A camera's own utterances that touch the covered range go. The recorder's come in at the video's
    time, cut to the range, as ``<id>-on-<video>``, with the words that lie in it; they also stay with the recorder.
    """
    c = companions.select(F.col("video").alias("_video"), F.col("recorder").alias("_recorder"), "offset_ms", F.col("start").alias("_a"), F.col("end").alias("_b"))
    own = utterances.join(c.select(F.col("_video").alias("asset"), "_a", "_b"), "asset", "left")
    kept = own.where("_a is null or end <= _a or start >= _b").select(*utterances.columns)
    heard = utterances.join(c, F.col("asset") == F.col("_recorder"))
    at, until = F.col("start") + F.col("offset_ms"), F.col("end") + F.col("offset_ms")
    heard = heard.where((until > F.col("_a")) & (at < F.col("_b")))
    words = F.filter(F.transform("words", lambda w: F.struct((w["start"] + F.col("offset_ms")).alias("start"), (w["end"] + F.col("offset_ms")).alias("end"), w["word"].alias("word"))), lambda w: (w["start"] >= F.col("_a")) & (w["end"] <= F.col("_b")))
    new = {"asset": F.col("_video"), "id": F.concat("id", F.lit("-on-"), F.col("_video").cast("string")), "start": F.greatest("_a", at), "end": F.least("_b", until), "words": words}
    return kept.unionByName(heard.select(*[new.get(x, F.col(x)).alias(x) for x in utterances.columns]))
