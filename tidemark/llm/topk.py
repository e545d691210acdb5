"""Exact top-k search by distributed histogram selection.

Every query block meets every block of rows. Each pass scores everything and counts scores in histograms that the
previous pass has narrowed, until the k-th highest score of each query is known; then rows above it are kept and
ties at it are broken by id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm._common import written

#: Rows in a block of candidates, queries in a block of queries, and bins of a histogram.
ROWS, QUERIES, BINS = 8192, 512, 256


def integer_vectors(vectors: DataFrame, scale: float = 64.0) -> DataFrame:
    """``vec_id`` and ``x``, floor(scale * component) as longs. Vectors that are null, or hold null or non-finite
    components or products beyond a long, are left out."""
    x = F.transform("embedding", lambda v: v.cast("double") * F.lit(scale))
    fine = F.forall("x", lambda v: F.coalesce(F.abs(v) < F.lit(2.0**62), F.lit(False)))
    return vectors.select(F.col("vec_id").cast("long"), x.alias("x")).where(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & fine).select("vec_id", F.transform("x", lambda v: F.floor(v).cast("long")).alias("x"))


def _blocks(rows: DataFrame, size: int, name: str) -> DataFrame:
    """Rows packed into blocks of equal dimension: ``dim``, ``name`` (block), ids and a flat array of components."""
    sizes = rows.groupBy(F.size("x").alias("dim")).agg(F.ceil(F.count("*") / size).alias("blocks"))
    dealt = rows.withColumn("dim", F.size("x")).join(sizes, "dim").withColumn(name, F.pmod(F.xxhash64("vec_id"), "blocks"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vec_id", kind="stable")
        x = np.stack(pdf["x"].to_numpy()) if pdf["dim"].iloc[0] else np.zeros((len(pdf), 0))
        return pd.DataFrame({"dim": [pdf["dim"].iloc[0]], name: [pdf[name].iloc[0]], f"{name}_ids": [pdf["vec_id"].to_numpy("<i8").tobytes()], f"{name}_x": [x.astype("<i8").tobytes()]})

    return dealt.select("dim", name, "vec_id", "x").groupBy("dim", name).applyInPandas(run, f"dim int, {name} long, {name}_ids binary, {name}_x binary")


def _scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer inner products, by doubles where these hold every sum exactly."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(1, q.shape[1])
    if most < 2**53:
        return np.rint(q.astype(float) @ x.astype(float).T).astype(np.int64)
    if most < 2**63:
        return q @ x.T
    exact = q.astype(object) @ x.astype(object).T
    return np.clip(exact, -(2**63), 2**63 - 1).astype(np.int64)


def top_k(vectors: DataFrame, k: int, is_query: Column, scale: float = 64.0) -> DataFrame:
    """The ``k`` highest integer inner products of each query with every other row of its dimension.

    Returns ``query_id``, ``rank`` (from 1), ``vec_id``, ``score``; fewer than ``k`` rows where a query has fewer
    candidates. Equal scores are ranked by ``vec_id``; rows that share an id are candidates of their own, except to
    a query of that id, which is the least vector of the id. Scores beyond a long are held at its bounds. Empty tables give an empty result.
    """
    rows = written(integer_vectors(vectors, scale))
    whole = rows.withColumn("q", is_query)
    queries = written(_blocks(rows.where(is_query).groupBy("vec_id").agg(F.min("x").alias("x")), QUERIES, "qb"))
    blocks = written(_blocks(whole.select("vec_id", "x"), ROWS, "rb"))
    # Both sides come in blocks: a pair of blocks is a row, dealt out by the pair.
    n = blocks.groupBy("dim").agg(F.count("*").alias("n"))
    pairs = queries.join(n, "dim").withColumn("rb", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))).drop("n")
    pairs = pairs.join(blocks, ["dim", "rb"])

    def score(row) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ids, other = np.frombuffer(row.qb_ids, "<i8"), np.frombuffer(row.rb_ids, "<i8")
        return ids, other, _scores(np.frombuffer(row.qb_x, "<i8").reshape(len(ids), -1), np.frombuffer(row.rb_x, "<i8").reshape(len(other), -1))

    def extent(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for r in f.itertuples():
                ids, other, s = score(r)
                keep = ids[:, None] != other[None, :]
                low = np.where(keep, s, np.iinfo(np.int64).max).min(1, initial=np.iinfo(np.int64).max)
                high = np.where(keep, s, np.iinfo(np.int64).min).max(1, initial=np.iinfo(np.int64).min)
                some = keep.any(1)
                yield pd.DataFrame({"query_id": ids[some], "low": low[some], "high": high[some], "n": keep.sum(1)[some]})

    bound = pairs.mapInPandas(extent, "query_id long, low long, high long, n long").groupBy("query_id").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n"))
    # Of each query: the range that holds its k-th highest score, and how many scores lie above that range.
    high = F.when(F.col("n") > k, F.col("high")).otherwise(F.col("low"))  # all, if there are no more than k
    state = written(bound.select("query_id", "low", high.alias("high"), F.lit(0).cast("long").alias("above")))

    def with_state(now: DataFrame) -> DataFrame:
        """Pairs with their queries' ranges, in the order of the block's ids."""
        place = queries.select("dim", "qb", F.col("qb_ids")).mapInPandas(_listed, "dim int, qb long, query_id long")
        of_block = place.join(now, "query_id", "left").groupBy("dim", "qb").agg(F.array_sort(F.collect_list(F.struct("query_id", "low", "high", "above"))).alias("state"))
        return pairs.join(of_block, ["dim", "qb"])

    def _listed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for r in f.itertuples():
                ids = np.frombuffer(r.qb_ids, "<i8")
                yield pd.DataFrame({"dim": r.dim, "qb": r.qb, "query_id": ids})

    def ranges(state) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Low and high ends, and the bins' width; a query without candidates has an empty range."""
        low = np.array([1 if s["low"] is None else s["low"] for s in state], object)
        high = np.array([0 if s["high"] is None else s["high"] for s in state], object)
        return low.astype(np.int64), high.astype(np.int64), np.maximum(1, -(-(high - low + 1) // BINS)).astype(np.int64)

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for r in f.itertuples():
                ids, other, s = score(r)
                low, high, width = ranges(r.state)
                wide = high > low
                inside = (s >= low[:, None]) & (s <= high[:, None]) & (ids[:, None] != other[None, :]) & wide[:, None]
                q, c = np.nonzero(inside)
                if len(q):
                    b = (s[q, c] - low[q]).astype(np.uint64) // width[q].astype(np.uint64)
                    cell, n = np.unique(q * BINS + b.astype(np.int64), return_counts=True)
                    yield pd.DataFrame({"query_id": ids[cell // BINS], "bin": cell % BINS, "n": n})

    while state.where("low < high").limit(1).count():
        bins = with_state(state).mapInPandas(count, "query_id long, bin long, n long").groupBy("query_id", "bin").agg(F.sum("n").alias("n"))
        # A query has BINS bins at most, so its histogram is one short array.
        histogram = bins.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("bin", "n")), asc=False).alias("bins"))
        found = F.aggregate(
            "bins",
            F.struct(F.lit(-1).cast("long").alias("bin"), F.col("above").alias("above")),
            lambda a, b: F.when(a["bin"] >= 0, a).when(a["above"] + b["n"] >= k, F.struct(b["bin"].alias("bin"), a["above"].alias("above"))).otherwise(F.struct(a["bin"].alias("bin"), (a["above"] + b["n"]).alias("above"))),
        )
        width = F.ceil((F.col("high").cast("decimal(38,0)") - F.col("low") + 1) / BINS).cast("decimal(38,0)")
        at = state.join(histogram, "query_id", "left").withColumn("f", found).withColumn("w", width)
        start = F.col("low") + F.col("f.bin") * F.col("w")
        narrow = F.col("low") < F.col("high")
        state = written(at.select("query_id", F.when(narrow, start).otherwise(F.col("low")).cast("long").alias("low"), F.when(narrow, F.least(start + F.col("w") - 1, F.col("high").cast("decimal(38,0)"))).otherwise(F.col("high")).cast("long").alias("high"), F.when(narrow, F.col("f.above")).otherwise(F.col("above")).alias("above")))

    def select(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Scores above the k-th, and of those equal to it the smallest ids that could be needed."""
        for f in frames:
            for r in f.itertuples():
                ids, other, s = score(r)
                kth, _, _ = ranges(r.state)
                keep = ids[:, None] != other[None, :]
                q, c = np.nonzero((s > kth[:, None]) & keep)
                tq, tc = np.nonzero((s == kth[:, None]) & keep)  # other ids rise along a row
                first = np.searchsorted(tq, tq)
                few = np.arange(len(tq)) - first < k
                q, c = np.concatenate([q, tq[few]]), np.concatenate([c, tc[few]])
                yield pd.DataFrame({"query_id": ids[q], "vec_id": other[c], "score": s[q, c]})

    near = with_state(state).mapInPandas(select, "query_id long, vec_id long, score long")
    best = near.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct(F.col("score"), (-F.col("vec_id")).alias("o"))), asc=False).alias("best"))
    out = best.select("query_id", F.posexplode(F.slice("best", 1, k)).alias("rank", "b"))
    return out.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), (-F.col("b.o")).alias("vec_id"), F.col("b.score").alias("score"))
