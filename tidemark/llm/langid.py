"""Language identification by error-correcting output codes: binary classifiers over byte n-grams predict the bits
of languages' codewords, and loss-weighted decoding chooses the nearest codeword."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm._common import texts
from tidemark.llm.features import by_size, grams

SIZES, FEATURES = (1, 2, 3), 4096
#: Labelled rows of a language that the classifiers are fitted on, about and at most twice.
PER_LANGUAGE = 300
#: Margin between the two best codewords' probabilities below which a prediction is ambiguous.
AMBIGUOUS = 0.2

_LETTER = re.compile(r"[^\W\d_]")


@dataclass
class OutputCodes:
    """Languages, their codewords (+1/-1), one linear classifier for each bit, and the bits' weights."""

    languages: list[str]
    words: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    trust: np.ndarray

    def losses(self, x: np.ndarray) -> np.ndarray:
        """Weighted logistic loss of every codeword for every row."""
        margin = x @ self.weights + self.bias
        loss = np.logaddexp(0, -margin[:, None, :] * self.words[None, :, :])
        return loss @ self.trust

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nearest codeword, its probability, and the margin before the next."""
        a = -self.losses(x)
        p = np.exp(a - a.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        best = p.argmax(1)
        top = np.sort(p, axis=1)
        return best, top[:, -1], top[:, -1] - (top[:, -2] if p.shape[1] > 1 else 0)


def codewords(n: int, seed: int = 5) -> np.ndarray:
    """``n`` codewords far from each other: the best of some random draws by least distance; no bit is constant."""
    bits = max(8, 4 * int(np.ceil(np.log2(max(n, 2)))))
    rng, best, found = np.random.default_rng(seed), -1, None
    for _ in range(200):
        w = np.where(rng.random((n, bits)) < 0.5, 1.0, -1.0)
        if n > 1:
            w[0] = np.where(np.abs(w.sum(0)) == n, -w[0], w[0])
        apart = (bits - w @ w.T) / 2 + bits * np.eye(n)
        if apart.min() > best:
            best, found = apart.min(), w
    return found


def fit(x: np.ndarray, y: np.ndarray, languages: list[str], steps: int = 200) -> OutputCodes:
    """Logistic classifiers of all bits together, by gradient descent with momentum; languages weigh the same."""
    words = codewords(len(languages))
    target = words[y]
    share = 1 / np.bincount(y, minlength=len(languages))[y]
    share /= share.sum()
    w, b = np.zeros((x.shape[1], words.shape[1])), np.zeros(words.shape[1])
    vw, vb = np.zeros_like(w), np.zeros_like(b)
    for _ in range(steps):
        g = -target / (1 + np.exp(np.clip(target * (x @ w + b), -30, 30))) * share[:, None]
        vw, vb = 0.9 * vw - 8.0 * (x.T @ g + 1e-5 * w), 0.9 * vb - 2.0 * g.sum(0)
        w, b = w + vw, b + vb
    error = (share[:, None] * (target * (x @ w + b) <= 0)).sum(0)
    trust = np.log((1 - error + 1e-3) / (error + 1e-3))
    return OutputCodes(languages, words, w, b, np.maximum(trust, 0.05) / np.maximum(trust, 0.05).mean())


def train(docs: DataFrame, learn: Column, per_language: int = PER_LANGUAGE) -> OutputCodes | None:
    """Fits on a bounded sample, drawn by a hash of the text, of the rows where ``learn`` holds and ``lang`` is not
    null; languages with up to ``per_language`` rows are taken whole. None if there is no such row."""
    own = docs.where(learn).where("lang is not null and text is not null and text <> ''")
    sizes = own.groupBy("lang").agg(F.approx_count_distinct(F.xxhash64("text"), 0.02).alias("count"))
    chance = F.pmod(F.xxhash64("text", F.lit(17)), F.lit(1 << 20)) / F.lit(float(1 << 20))
    # Languages are few, and a bound on their number is part of what the classifier can tell apart at all.
    drawn = own.join(F.broadcast(sizes), "lang").withColumn("r", chance).where(F.col("r") < 1.5 * per_language / F.col("count"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [grams([t], SIZES, FEATURES)[0].astype("<f4").tobytes() for t in texts(b.column(1))]
            yield pa.record_batch([b.column(0), b.column(2), pa.array(x, pa.binary())], names=["lang", "r", "x"])

    # At most 2 * per_language rows of a language come to the driver, each of a fixed size.
    # Copies of a text count once, before any language's rows come together.
    rows = drawn.select("lang", "text", "r").dropDuplicates(["lang", "text"]).mapInArrow(run, "lang string, r double, x binary")
    kept = rows.groupBy("lang").agg(F.slice(F.sort_array(F.collect_list(F.struct("r", "x"))), 1, 2 * per_language).alias("s")).orderBy("lang").collect()
    if not kept:
        return None
    x = np.stack([np.frombuffer(s["x"], "<f4") for k in kept for s in k["s"]]).astype(float)
    return fit(x, np.repeat(np.arange(len(kept)), [len(k["s"]) for k in kept]), [k["lang"] for k in kept])


def identify(docs: DataFrame, model: OutputCodes | None) -> DataFrame:
    """``doc_id``, ``lang_pred``, ``score`` (the codeword's probability) and ``ambiguous`` for every whole text.

    Null texts, texts without a letter, and every text if the model is None, are ``und`` with score 0. Other columns
    have no part in it. Repeated rows are scored each on its own; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few hundred kB, set by FEATURES and the languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            every = texts(b.column(1))
            lang, score, doubt = ["und"] * len(every), [0.0] * len(every), [True] * len(every)
            if m is not None:
                for at, some in by_size(every):
                    for i, (k, p, gap) in enumerate(zip(*m.decode(grams(some, SIZES, FEATURES)))):
                        if _LETTER.search(some[i].decode()):
                            lang[at + i], score[at + i], doubt[at + i] = m.languages[k], float(p), bool(gap < AMBIGUOUS)
            yield pa.record_batch([b.column(0), pa.array(lang), pa.array(score), pa.array(doubt)], names=["doc_id", "lang_pred", "score", "ambiguous"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double, ambiguous boolean")
