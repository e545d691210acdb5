"""Retrieval: lexical coverage by an inverted index, exact vector search per kind, robust calibration and blending."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows in a block of entries, queries in a block of queries, scores that a task holds, and entries that are scored at once.
ROWS, QUERIES, SCORES, TILE = 2048, 256, 2**24, 256


def lexical(queries: DataFrame, entries: DataFrame) -> DataFrame:
    """Coverage of each query's features by each entry that shares one: ``query_id``, ``id``, ``coverage``.

    Both sides have an id and ``features`` (distinct strings). The join is on the feature, so entries that share
    nothing are never met; a query's common features are counted before they are shuffled on.
    """
    q = queries.withColumn("n", F.size("features")).select("query_id", "n", F.explode("features").alias("f"))
    e = entries.select("id", F.explode("features").alias("f"))
    return q.join(e, "f").groupBy("query_id", "id").agg(F.count("*").alias("shared"), F.first("n").alias("n")).select("query_id", "id", (F.col("shared") / F.col("n")).alias("coverage"))


def best(scores: DataFrame, k: int, by: list[str], score: str = "score", tie: str = "id") -> DataFrame:
    """The ``k`` highest rows of each group, equal scores by ``tie``; adds ``rank``."""
    order = Window.partitionBy(*by).orderBy(F.col(score).desc(), tie)
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _packed(rows: DataFrame, kind: str, id: str, vector: str, more: list[str], size: Column, name: str) -> DataFrame:
    """Rows of one ``kind`` and dimension in blocks of about ``size``: ``kind``, ``dim``, the block's number ``name``, ``{name}_rows``."""
    rows = rows.where(F.col(kind).isNotNull() & F.col(vector).isNotNull()).withColumn("dim", F.size(vector)).withColumn("_size", size)
    sizes = rows.groupBy(kind, "dim").agg(F.ceil(F.count("*") / F.max("_size")).alias("_blocks"))
    dealt = rows.join(sizes, [kind, "dim"]).withColumn(name, F.pmod(F.xxhash64(id), "_blocks"))
    row = F.struct(F.col(id).alias("id"), F.col(vector).alias("v"), *more)
    return dealt.groupBy(kind, "dim", name).agg(F.collect_list(row).alias(f"{name}_rows"))


def _met(queries: DataFrame, entries: DataFrame, kind: str) -> DataFrame:
    """A row for each block of queries (``qb``) and block of entries (``eb``) of one kind and dimension. Neither side is broadcast: the
    blocks are much larger than what is known of them."""
    numbers = entries.groupBy(kind, "dim").agg(F.collect_list("eb").alias("_ebs"))
    return queries.join(numbers, [kind, "dim"]).withColumn("eb", F.explode("_ebs")).drop("_ebs").join(entries.hint("merge"), [kind, "dim", "eb"])


def _unpacked(batch: pa.RecordBatch, i: int, name: str) -> tuple[pa.StructArray, np.ndarray, np.ndarray, np.ndarray]:
    """A block's rows, ids, vectors and which vectors hold nulls."""
    rows = batch.column(f"{name}_rows")[i].values
    parts = rows.field("v").flatten()
    shape = (len(rows), batch.column("dim")[i].as_py())
    return rows, rows.field("id").to_numpy(zero_copy_only=False), parts.to_numpy(zero_copy_only=False).astype(float).reshape(shape), parts.is_null().to_numpy(zero_copy_only=False).reshape(shape).any(1)


def _cosines(q: np.ndarray, v: np.ndarray, q_null: np.ndarray, v_null: np.ndarray) -> np.ndarray:
    """Cosines in doubles, 0 where one has no length or holds a null; products are added in the order of the components, so that equal vectors
    have equal scores whatever block they are in."""
    out, across = np.empty((len(q), len(v))), np.ascontiguousarray(v.T)
    with np.errstate(all="ignore"):
        for at in range(0, len(v), TILE):
            total = np.zeros((len(q), min(TILE, len(v) - at)))
            part = np.empty_like(total)
            for k in range(q.shape[1]):
                np.multiply(q[:, k, None], across[k, at : at + TILE], out=part)
                total += part
            out[:, at : at + TILE] = total
        squares = [np.zeros(len(q)), np.zeros(len(v))]
        for k in range(q.shape[1]):
            squares[0] += q[:, k] * q[:, k]
            squares[1] += v[:, k] * v[:, k]
        n = np.sqrt(squares[0])[:, None] * np.sqrt(squares[1])[None, :]
        n[q_null, :] = n[:, v_null] = 0
        return np.where((n > 0) | np.isnan(n), out / n, 0.0)


def _highest(scores: np.ndarray, ids: np.ndarray, keep: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of each row's ``k`` highest scores among those to ``keep``, ties by id."""
    s = np.where(keep, np.where(np.isnan(scores), np.inf, scores), -np.inf)
    least = np.partition(s, s.shape[1] - k, 1)[:, s.shape[1] - k] if s.shape[1] > k else np.full(len(s), -np.inf)
    q, c = np.nonzero((s >= least[:, None]) & keep)
    order = np.lexsort((ids[c], -s[q, c], q))
    q, c = q[order], c[order]
    few = np.arange(len(q)) - np.searchsorted(q, q) < k
    return q[few], c[few]


def nearest_vectors(queries: DataFrame, entries: DataFrame, kind: str, k: int) -> DataFrame:
    """The ``k`` entries (``id``, ``v``) of each query (``query_id``, ``q``) with the highest cosine, among those of its ``kind`` and
    dimension but itself: ``query_id``, ``id``, ``score`` and ``rank``; ties by id. Every pair is scored, block by block; of a block only each
    query's best leave the task. Ids are longs and unique."""
    pairs = _met(_packed(queries, kind, "query_id", "q", [], F.lit(QUERIES), "qb"), _packed(entries, kind, "id", "v", [], F.lit(ROWS), "eb"), kind)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                _, ids, q, q_null = _unpacked(batch, i, "qb")
                _, others, v, v_null = _unpacked(batch, i, "eb")
                s = _cosines(q, v, q_null, v_null)
                a, b = _highest(s, others, ids[:, None] != others[None, :], k)
                yield pa.RecordBatch.from_pydict({"query_id": ids[a], "id": others[b], "score": s[a, b]})

    return best(pairs.select("dim", "qb_rows", "eb_rows").mapInArrow(score, "query_id long, id long, score double"), k, ["query_id"])


def _median(x: np.ndarray) -> float:
    p = np.partition(x, [(len(x) - 1) // 2, len(x) // 2])
    low, high = p[(len(x) - 1) // 2], p[len(x) // 2]
    return float(low if len(x) % 2 else 0.5 * low + 0.5 * high)


def vector_calibration(queries: DataFrame, entries: DataFrame, kind: str) -> DataFrame:
    """``calibration`` of each query's cosines with all entries of its ``kind`` and dimension but itself, without a row for each pair.

    A block of queries meets its kind's entries one block after another; it has as many queries as leave room for ``SCORES`` scores. Arguments
    as for ``nearest_vectors``."""
    many = entries.groupBy(kind).agg(F.greatest(F.lit(1), F.least(F.lit(QUERIES), F.floor(F.lit(SCORES) / F.count("*")))).alias("_room"))
    packed = _packed(queries.join(many, kind), kind, "query_id", "q", [], F.col("_room"), "qb")
    pairs = _met(packed, _packed(entries, kind, "id", "v", [], F.lit(ROWS), "eb"), kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            for i in range(batch.num_rows):
                _, ids, q, q_null = _unpacked(batch, i, "qb")
                _, others, v, v_null = _unpacked(batch, i, "eb")
                held.append((others, _cosines(q, v, q_null, v_null)))
        out = []
        for at, own in enumerate(ids):
            s = np.concatenate([scores[at][others != own] for others, scores in held])
            if len(s):
                centre = _median(s)
                out.append((int(own), centre, _median(np.abs(s - centre)) * 1.4826, len(s)))
        names = ["query_id", "centre", "spread", "n"]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 4, (pa.int64(), pa.float64(), pa.float64(), pa.int64()))], names)

    return _usable(pairs.groupBy(kind, "dim", "qb").applyInArrow(run, "query_id long, centre double, spread double, n long"), ["query_id"])


def calibration(scores: DataFrame, by: list[str], score: str = "score") -> DataFrame:
    """Median (``centre``) and 1.4826 times the median deviation (``spread``) of each group's scores.

    Groups of fewer than five scores, or without spread, have a null ``centre``: nothing is calibrated on them.
    ``undiscriminating``: even a perfect score is within four deviations.
    """
    centre = scores.groupBy(*by).agg(F.percentile(score, F.lit(0.5)).alias("centre"), F.count("*").alias("n"))
    off = scores.join(centre, by).groupBy(*by).agg((F.percentile(F.abs(F.col(score) - F.col("centre")), F.lit(0.5)) * 1.4826).alias("spread"), F.first("centre").alias("centre"), F.first("n").alias("n"))
    return _usable(off, by)


def _usable(off: DataFrame, by: list[str]) -> DataFrame:
    usable = (F.col("n") >= 5) & (F.col("spread") > 0)
    return off.select(*by, F.when(usable, F.col("centre")).alias("centre"), F.when(usable, F.col("spread")).alias("spread"), F.coalesce(usable & (F.col("centre") + 4 * F.col("spread") > 1), F.lit(False)).alias("undiscriminating"))


def _shared(words: pa.Array, others: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """How many words each text has (words parted by blanks, no word twice), and how many of them each other text shares."""
    listed = pc.split_pattern(words.fill_null(""), " ")
    known = listed.flatten().unique()
    known = known.filter(pc.not_equal(known, ""))

    def table(lists: pa.ListArray) -> np.ndarray:
        out = np.zeros((len(lists), len(known)), np.float32)
        place = pc.index_in(lists.flatten(), value_set=known)
        has = place.is_valid().to_numpy(zero_copy_only=False)
        out[pc.list_parent_indices(lists).to_numpy()[has], place.drop_null().to_numpy()] = 1
        return out

    own = table(listed)
    parts = [own @ table(pc.split_pattern(others.slice(at, TILE).fill_null(""), " ")).T for at in range(0, len(others), TILE)]
    return own.sum(1).astype(float), np.concatenate(parts, 1).astype(float)


def blended(score: np.ndarray, centre: np.ndarray, spread: np.ndarray, undiscriminating: np.ndarray, coverage: np.ndarray) -> np.ndarray:
    """65 % of the calibrated similarity (the raw one without a calibration) and 35 % of the coverage, to 4 places; queries by entries.

    Robust deviations above the centre count, four of them as 1."""
    with np.errstate(all="ignore"):
        z = (score - centre[:, None]) / spread[:, None]
        strong = np.where(undiscriminating[:, None] | (z <= 0), 0.0, np.minimum(1.0, z / 4))
    similar = np.where(np.isnan(centre)[:, None], score, strong)
    return np.floor((0.65 * similar + 0.35 * coverage) * 10000 + 0.5) / 10000


def hybrid(queries: DataFrame, entries: DataFrame, kind: str, k: int) -> DataFrame:
    """The ``k`` entries of each query with the highest ``blended`` score above 0, among those of its ``kind`` and dimension but itself:
    ``query_id``, ``id``, ``score`` and ``rank``; ties by id.

    As ``nearest_vectors``, with ``words`` on both sides (distinct features parted by blanks, or null), and a calibration's columns with the queries.
    Features are counted where vectors are scored, so that no row for each pair, or for each feature of a pair, is shuffled."""
    about = ["words", "centre", "spread", "undiscriminating"]
    pairs = _met(_packed(queries, kind, "query_id", "q", about, F.lit(QUERIES), "qb"), _packed(entries, kind, "id", "v", ["words"], F.lit(ROWS), "eb"), kind)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                rows, ids, q, q_null = _unpacked(batch, i, "qb")
                entry_rows, others, v, v_null = _unpacked(batch, i, "eb")
                n, shared = _shared(rows.field("words"), entry_rows.field("words"))
                column = lambda name: rows.field(name).to_numpy(zero_copy_only=False).astype(float)
                s = blended(_cosines(q, v, q_null, v_null), column("centre"), column("spread"), column("undiscriminating") == 1, shared / np.maximum(n, 1)[:, None])
                a, b = _highest(s, others, (ids[:, None] != others[None, :]) & (s > 0), k)
                yield pa.RecordBatch.from_pydict({"query_id": ids[a], "id": others[b], "score": s[a, b]})

    return best(pairs.select("dim", "qb_rows", "eb_rows").mapInArrow(score, "query_id long, id long, score double"), k, ["query_id"])


def keywords(words: DataFrame, by: list[str], word: str, k: int = 5) -> DataFrame:
    """The ``k`` most frequent words of each group: by count, then length, then the word."""
    n = words.groupBy(*by, word).agg(F.count("*").alias("n"))
    order = Window.partitionBy(*by).orderBy(F.col("n").desc(), F.length(word).desc(), word)
    return n.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
