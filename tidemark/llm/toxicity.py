"""Toxicity by non-negative positive-unlabelled learning: a linear numpy classifier fitted to confirmed toxic
examples and unlabelled text by a risk estimator corrected for the class prior."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm._common import each_text, written
from tidemark.llm.features import word_set

#: Confirmed toxic rows and unlabelled rows that the classifier is fitted on, at most.
POSITIVE, UNLABELLED = 3000, 9000
#: Texts of the sample that a word must be in; and deviations by which its share of toxic texts must differ from its
#: share of unlabelled ones.
SEEN, APART = 4, 4.0
THRESHOLD = 0.3


@dataclass
class ToxicWords:
    """Word hashes in order, their weights, and the bias."""

    words: np.ndarray
    weights: np.ndarray
    bias: float

    def score(self, text: bytes) -> float:
        s = word_set(text)
        at = np.minimum(np.searchsorted(self.words, s), max(0, len(self.words) - 1))
        own = at[self.words[at] == s] if len(self.words) else at[:0]
        return float(1 / (1 + np.exp(-np.clip(self.weights[own].sum() + self.bias, -40, 40))))


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, steps: int = 400) -> ToxicWords:
    """Minimises prior * R+(p) + max(0, R-(u) - prior * R-(p)) with the logistic loss; where the negative part falls
    below zero its gradient is turned round. Texts are sets of word hashes."""
    sets = positive + unlabelled
    flat = np.concatenate([*sets, np.zeros(0, np.uint64)])
    vocabulary, n = np.unique(flat, return_counts=True)
    p, u = len(positive), len(unlabelled)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    toxic = np.bincount(np.searchsorted(vocabulary, flat[row < p]), minlength=len(vocabulary))
    share = n / max(1, p + u)
    z = (toxic - p * share) / np.sqrt(np.maximum(p * share * (1 - share) * u / max(1, p + u), 1e-12))
    vocabulary = vocabulary[(n >= SEEN) & (np.abs(z) >= APART)]
    at = np.minimum(np.searchsorted(vocabulary, flat), max(0, len(vocabulary) - 1))
    known = vocabulary[at] == flat if len(vocabulary) else np.zeros(len(flat), bool)
    row, at = row[known], at[known]
    label = np.arange(len(sets)) < p
    w, b = np.zeros(len(vocabulary)), float(np.log(prior / (1 - prior)))
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, steps + 1):
        f = np.bincount(row, w[at], len(sets)) + b
        s = 1 / (1 + np.exp(-np.clip(f, -40, 40)))
        negative = np.logaddexp(0, f)
        risk = negative[~label].mean() - prior * negative[label].mean()
        if risk >= 0:
            g = np.where(label, prior * (s - 1) / p - prior * s / p, s / u)
        else:
            g = np.where(label, prior * s / p, -s / u)
        gw, gb = np.bincount(at, g[row], len(w)) + 1e-4 * w, g.sum()
        m, v = 0.9 * m + 0.1 * gw, 0.99 * v + 0.01 * gw * gw
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        rate = 0.1 * (1 - t / (steps + 1))
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-5)
        b -= rate * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.99**t)) + 1e-5)
    return ToxicWords(vocabulary, w, float(b))


def train(docs: DataFrame, labels: DataFrame, learn: Column, positive: int = POSITIVE, unlabelled: int = UNLABELLED) -> ToxicWords | None:
    """Fits on bounded samples, drawn by a hash of the id, of the rows where ``learn`` holds: confirmed toxic ones, and
    others of which nothing is known, whatever their label. The prior is the share of toxic labels. None without
    toxic labels or other rows."""
    own = docs.where(learn).where("doc_id is not null and text is not null").select("doc_id", "text")
    marks = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = own.select("doc_id").join(marks, "doc_id")
    n, toxic = known.agg(F.count("*"), F.sum((F.col("toxic") == 1).cast("int"))).first()
    if not toxic or not own.select("doc_id").limit(2).count():
        return None

    def draw(ids: DataFrame, most: int, seed: int) -> DataFrame:
        return ids.select("doc_id").distinct().orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(most)

    p = draw(known.where("toxic = 1"), positive, 1).withColumn("p", F.lit(True))
    u = draw(own.select("doc_id"), unlabelled, 2).withColumn("p", F.lit(False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [word_set(t).tobytes() for t in each_text(b.column(1))]
            yield pa.record_batch([b.column(0), b.column(2), pa.array(sets, pa.binary())], names=["doc_id", "p", "s"])

    drawn = F.broadcast(p.union(u))  # at most positive + unlabelled ids
    sets_ = written(own.join(drawn, "doc_id").select("doc_id", "text", "p").mapInArrow(run, "doc_id long, p boolean, s binary"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s, p in zip(b.column(2), b.column(1).to_pylist()):
                w = np.frombuffer(s.as_buffer(), np.int64)
                yield pa.record_batch([pa.array(w), pa.array(np.full(len(w), int(p)))], names=["w", "p"])

    # Words are screened before texts come together: what is collected is bounded by the rows and the words that tell.
    of = {r["p"]: r["count"] for r in sets_.groupBy("p").count().collect()}
    share = F.col("n") / max(1, sum(of.values()))
    z = (F.col("t") - of.get(True, 0) * share) / F.sqrt(F.greatest(of.get(True, 0) * share * (1 - share) * of.get(False, 0) / max(1, sum(of.values())), F.lit(1e-12)))
    counts = sets_.mapInArrow(each, "w long, p long").groupBy("w").agg(F.count("*").alias("n"), F.sum("p").alias("t"))
    words = np.array(sorted(r["w"] for r in counts.where((F.col("n") >= SEEN) & (F.abs(z) >= 0.99 * APART)).select("w").collect()), np.int64)

    def screened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own_ = [np.frombuffer(s.as_buffer(), np.int64) for s in b.column(2)]
            yield pa.record_batch([b.column(0), b.column(1), pa.array([s[np.isin(s, words)].tobytes() for s in own_], pa.binary())], names=["doc_id", "p", "s"])

    rows = sets_.mapInArrow(screened, "doc_id long, p boolean, s binary").collect()
    rows.sort(key=lambda r: (r["doc_id"], r["p"], r["s"]))
    sets = {k: [np.frombuffer(r["s"], np.uint64) for r in rows if r["p"] == k] for k in (True, False)}
    return fit(sets[True], sets[False], min(0.9, max(1e-3, toxic / n)))


def score(docs: DataFrame, model: ToxicWords | None) -> DataFrame:
    """``doc_id``, ``score`` (0 to 1, higher: likelier toxic) and ``predicted`` (1 at 0.3 or more) of every whole text.

    Null and empty texts are scored by the model's bias; all scores are 0 if the model is None. Other columns have no
    part in it. Repeated rows are scored each on its own; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # its size is bounded by the sample's

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            s = [m.score(t) if m is not None else 0.0 for t in each_text(b.column(1))]
            yield pa.record_batch([b.column(0), pa.array(s, pa.float64()), pa.array([int(x >= THRESHOLD) for x in s], pa.int32())], names=["doc_id", "score", "predicted"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double, predicted int")


def without_toxic(docs: DataFrame, model: ToxicWords | None) -> DataFrame:
    """The rows of ``docs`` that the model doesn't reject, with all columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            keep = [m is None or m.score(t) < THRESHOLD for t in each_text(b.column(place))]
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
