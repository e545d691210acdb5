"""Approximate nearest neighbours by inner product: a robust-pruned directed graph per shard, built from greedy searches whose
neighbours are pruned by relaxed distances, and a beam search of every query in every shard."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm._common import FEW, discard, written
from tidemark.llm.shingles import mix
from tidemark.llm.vectors import SmallWorld, TOGETHER

#: Components of a shard and of a block of queries, and rows of either, at most about.
COMPONENTS, ROWS = 1 << 20, 8192
#: Edges of a node, the beam of the searches that propose them, and how much nearer a kept edge must be for it to rule out another.
DEGREE, PROPOSED, ALPHA = 32, 64, 1.2
#: Share of audited queries' nearest neighbours that a search must find, and queries of a block that are audited.
RECALL, AUDITS = 0.97, 48


class RobustGraph(SmallWorld):
    """Directed graph over vectors of one length, taken as unit vectors; every search begins at the medoid, node 0.

    ``order`` has the row of each node. Of the nodes that a search proposes to a new one, the nearest is kept, and with it
    goes whatever is ``ALPHA`` times nearer to it than to the new node; then the next of the rest, up to ``DEGREE``.
    """

    def __init__(self, x: np.ndarray, seed: int = 7):
        n = len(x)
        x = x.astype(np.float32)
        order = np.random.default_rng(seed).permutation(n)
        if n:
            medoid = int(np.argmax(x[order] @ x.mean(0)))
            order[[0, medoid]] = order[[medoid, 0]]
        self.order, self.x = order, np.ascontiguousarray(x[order])
        self.links = [np.full((n, DEGREE), -1, np.int32)]
        done = min(n, 1)
        while done < n:
            more = min(n, 2 * done, done + 1024)
            self._propose(np.arange(done, more), done)
            done = more
        self._propose(np.arange(n), n)  # again, now that all can be met

    def _propose(self, nodes: np.ndarray, until: int) -> None:
        for at in range(0, len(nodes), TOGETHER):
            some = nodes[at : at + TOGETHER]
            found, _ = self.search(self.x[some], PROPOSED, 0, until)
            self._keep(some, np.concatenate([self.links[0][some], found], 1))
            # Edges back: what a node has no room for is pruned with what it had.
            src, dst = np.repeat(some, DEGREE), self.links[0][some].ravel()
            src, dst = src[dst >= 0], dst[dst >= 0]
            by = np.argsort(dst, kind="stable")
            src, dst = src[by], dst[by]
            to, first, count = np.unique(dst, return_index=True, return_counts=True)
            back = np.full((len(to), int(count.max(initial=0))), -1, np.int32)
            back[np.repeat(np.arange(len(to)), count), np.arange(len(dst)) - np.repeat(first, count)] = src
            for part in range(0, len(to), 512):
                t = to[part : part + 512]
                self._keep(t, np.concatenate([self.links[0][t], back[part : part + 512]], 1), True)

    def _keep(self, nodes: np.ndarray, ids: np.ndarray, lax: bool = False) -> None:
        """Links of ``nodes`` from candidates; ``lax`` keeps all where there is room."""
        ids = np.sort(np.where(ids == nodes[:, None], -1, ids), 1)
        ids[:, 1:][ids[:, 1:] == ids[:, :-1]] = -1
        if lax and len(nodes):
            packed = np.take_along_axis(ids, np.argsort(ids < 0, axis=1, kind="stable"), 1)
            room = (ids >= 0).sum(1) <= DEGREE
            self.links[0][nodes[room]] = np.pad(packed[room], ((0, 0), (0, max(0, DEGREE - packed.shape[1]))), constant_values=-1)[:, :DEGREE]
            nodes, ids = nodes[~room], ids[~room]
        if not len(nodes):
            return
        far = 2 - 2 * np.einsum("bkd,bd->bk", self.x[np.maximum(ids, 0)], self.x[nodes])
        far[ids < 0] = np.inf
        by = np.argsort(far, axis=1, kind="stable")[:, : 2 * DEGREE]
        ids, far = np.take_along_axis(ids, by, 1), np.take_along_axis(far, by, 1)
        v = self.x[np.maximum(ids, 0)]
        between = 2 - 2 * np.matmul(v, v.transpose(0, 2, 1))
        live = np.isfinite(far)
        out = np.full((len(ids), DEGREE), -1, np.int32)
        rows = np.arange(len(ids))
        for k in range(DEGREE):
            some = live.any(1)
            if not some.any():
                break
            first = np.argmax(live, 1)
            out[some, k] = ids[rows[some], first[some]]
            live &= ALPHA**2 * between[rows, first] > far  # relaxed: an edge stays unless one kept is clearly nearer to its end
            live[rows, first] = False
        self.links[0][nodes] = out


def _valid(vectors: DataFrame) -> DataFrame:
    """``vec_id`` and ``x``, as doubles, of the rows that take part."""
    limit = F.lit(1.7976931348623157e308)
    fine = F.forall("x", lambda v: F.coalesce((F.abs(v) <= limit) & ~F.isnan(v), F.lit(False))) & F.exists("x", lambda v: v != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("x"))
    return rows.where("vec_id is not null and x is not null").where(fine).withColumn("dim", F.size("x"))


def _nodes(rows: DataFrame, k: int) -> DataFrame:
    """Each distinct vector once with its ``k + 1`` smallest ids: a query's own and k others."""
    # The limit on ranks is applied before the shuffle too, so that a vector with very many copies sends few rows.
    first = rows.withColumn("n", F.row_number().over(Window.partitionBy("dim", "x").orderBy("vec_id"))).where(F.col("n") <= k + 1)
    return first.groupBy("dim", "x").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))


def _dealt(rows: DataFrame, name: str, key: str) -> DataFrame:
    """Rows dealt out to shards of a bounded size among those of their ``dim``, numbered by ``name``."""
    size = F.greatest(F.lit(1), F.least(F.lit(ROWS), F.floor(F.lit(COMPONENTS) / F.col("dim"))))
    sizes = rows.groupBy("dim").agg(F.count("*").alias("n")).select("dim", F.ceil(F.col("n") / size).alias("of"))
    if sizes.count() <= FEW:
        sizes = F.broadcast(sizes)
    return rows.join(sizes, "dim").withColumn(name, F.pmod(F.xxhash64(key), "of"))


def _scale(x: np.ndarray) -> tuple[np.ndarray, float]:
    """Unit vectors of one more component, among which a vector's inner product with (q, 0) rises with that of its original."""
    most = float(np.abs(x).max(initial=0)) or 1.0
    y = x / most
    norm = np.sqrt((y * y).sum(1))
    top = float(norm.max(initial=0)) or 1.0
    y /= top
    return np.concatenate([y, np.sqrt(np.maximum(0, 1 - (y * y).sum(1)))[:, None]], 1).astype(np.float32), top


def _asked(q: np.ndarray, x: np.ndarray, links: np.ndarray, order: np.ndarray, k: int, recall: float, audits: int) -> tuple[np.ndarray, np.ndarray, float, int]:
    """The nodes nearest to each query that beams find, their scores in doubles, the recall that was measured and its beam.
    A place without a node is -1.

    Some queries are compared with all nodes; the beam doubles until it finds their share, and where it would hold all
    nodes, all are scored.
    """
    g = RobustGraph.__new__(RobustGraph)
    g.x, g.links = _scale(x)[0][order], [links]
    most = np.abs(q).max(1, keepdims=True)
    unit = np.concatenate([q / most, np.zeros((len(q), 1))], 1)
    unit = (unit / np.sqrt((unit * unit).sum(1, keepdims=True))).astype(np.float32)
    want = min(k + 1, len(x))
    sample = np.argsort(mix(np.arange(len(q), dtype=np.uint64)), kind="stable")[:audits]
    true = unit[sample, :-1] @ g.x[:, :-1].T
    nearest = -np.partition(-true, want - 1, axis=1)[:, want - 1]
    beam, measured = 64, 1.0
    while beam < len(x):
        found, sims = g.search(unit[sample], beam)
        measured = float(np.minimum(1, ((found >= 0) & (sims >= nearest[:, None] - 1e-6)).sum(1) / want).mean())
        if measured >= recall:
            break
        beam *= 2
    out, score = np.zeros((len(q), want), np.int64), np.zeros((len(q), want))
    for at in range(0, len(q), TOGETHER):
        some = slice(at, min(at + TOGETHER, len(q)))
        if beam < len(x):
            found = order[np.maximum(g.search(unit[some], beam)[0], 0)]  # an unused place repeats the medoid
            s = np.einsum("nkd,nd->nk", x[found], q[some])
            by = np.lexsort((found, -s))
            found, s = np.take_along_axis(found, by, 1), np.take_along_axis(s, by, 1)
            again = found[:, 1:] == found[:, :-1]
            found[:, 1:][again], s[:, 1:][again] = -1, -np.inf
        else:
            measured = 1.0
            found = np.broadcast_to(np.arange(len(x)), (some.stop - some.start, len(x)))
            s = np.einsum("nd,kd->nk", q[some], x)
        by = np.argsort(-s, axis=1, kind="stable")[:, :want]
        out[some], score[some] = np.take_along_axis(found, by, 1), np.take_along_axis(s, by, 1)
    return out, score, measured, beam


def nearest_neighbours(vectors: DataFrame, k: int, is_query: Column, recall: float = RECALL, audits: int = AUDITS) -> DataFrame:
    """The ``k`` rows of largest inner product with each query, other than itself, that beam searches find.

    Returns ``query_id``, ``rank`` (from 1), ``vec_id`` and ``score``, in doubles on the vectors as they are; nearest first, ties
    to the smaller ``vec_id``; fewer rows where there are fewer candidates. Rows with a null id, and vectors that are null, zero
    or hold null or non-finite components take no part; vectors meet those of their own length. Each distinct vector is indexed
    once and stands for its ``k + 1`` smallest ids, so copies are never missed and ties among them are exact. An id that is
    repeated is one candidate for each of its vectors, and as a query the least of them. Empty tables give an empty result.

    Every query searches the graph of every shard of its length. In each block of queries some are compared with brute force,
    and beams widen until ``recall`` of their ``k + 1`` nearest nodes are found; ``neighbour_audits`` returns what was measured.
    """
    near = _searched(vectors, k, is_query, recall, audits).where("vec_id is not null").select("query_id", "vec_id", "score")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def neighbour_audits(vectors: DataFrame, k: int, is_query: Column, recall: float = RECALL, audits: int = AUDITS) -> DataFrame:
    """The audits of that search: per block of queries and shard the ``recall`` of audited queries and the ``beam`` that gave it."""
    return _searched(vectors, k, is_query, recall, audits).where("vec_id is null").select("recall", "beam")


def _searched(vectors: DataFrame, k: int, is_query: Column, recall: float, audits: int) -> DataFrame:
    nodes = written(_nodes(_valid(vectors), k))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf["ids"].map(lambda i: i[0])
        pdf = pdf.iloc[np.argsort(first.to_numpy(), kind="stable")]
        x = np.stack(pdf["x"].to_numpy())
        g = RobustGraph(_scale(x)[0])
        ids = [np.asarray(i, "<i8") for i in pdf["ids"]]
        row = {"dim": pdf["dim"].iloc[0], "s": pdf["s"].iloc[0], "x": x.astype("<f8").tobytes(), "ids": np.concatenate(ids).tobytes(), "sizes": np.array([len(i) for i in ids], "<i8").tobytes()}
        return pd.DataFrame([row | {"links": g.links[0].astype("<i4").tobytes(), "order": g.order.astype("<i8").tobytes()}])

    shards = _dealt(nodes, "s", "x").select("dim", "s", "x", "ids")
    graphs = written(shards.groupBy("dim", "s").applyInPandas(build, "dim int, s long, x binary, ids binary, sizes binary, links binary, order binary"))

    def block(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("query_id", kind="stable")
        return pd.DataFrame([{"dim": pdf["dim"].iloc[0], "q": pdf["q"].iloc[0], "q_ids": pdf["query_id"].to_numpy("<i8").tobytes(), "q_x": np.stack(pdf["x"].to_numpy()).astype("<f8").tobytes()}])

    # Of repeated ids the least vector asks.
    asked = written(_valid(vectors.where(is_query)).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("x").alias("x")).withColumn("dim", F.size("x")))
    queries = written(_dealt(asked, "q", "query_id").select("dim", "q", "query_id", "x").groupBy("dim", "q").applyInPandas(block, "dim int, q long, q_ids binary, q_x binary"))

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for r in f.itertuples():
                x = np.frombuffer(r.x, "<f8").reshape(-1, r.dim)
                ids, stop = np.frombuffer(r.ids, "<i8"), np.cumsum(np.frombuffer(r.sizes, "<i8"))
                q_ids, q = np.frombuffer(r.q_ids, "<i8"), np.frombuffer(r.q_x, "<f8").reshape(-1, r.dim)
                each, of = np.unique(q, axis=0, return_inverse=True)  # queries may be copies
                found, score, measured, beam = _asked(each, x, np.frombuffer(r.links, "<i4").reshape(len(x), -1), np.frombuffer(r.order, "<i8"), k, recall, audits)
                yield pd.DataFrame({"query_id": [q_ids[0]], "vec_id": pd.array([None], "Int64"), "score": [0.0], "recall": [measured], "beam": [beam]})
                size = np.diff(np.concatenate([[0], stop]))
                for at in range(0, len(q), 256):
                    mine = of.ravel()[at : at + 256]
                    near = found[mine]
                    n = np.where(near >= 0, size[near], 0)
                    total = n.sum(1)
                    # Ids of the nodes found, in the order of scores and ids; a query's own is left out.
                    flat_n, flat = n.ravel(), near.ravel()
                    offset = np.arange(int(flat_n.sum())) - np.repeat(np.cumsum(flat_n) - flat_n, flat_n)
                    out = pd.DataFrame({"query_id": np.repeat(q_ids[at : at + 256], total), "vec_id": ids[np.repeat((stop - size)[flat], flat_n) + offset], "score": np.repeat(score[mine].ravel(), flat_n)})
                    out = out[out["query_id"] != out["vec_id"]].sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True], kind="stable")
                    out = out[out.groupby("query_id").cumcount() < k].astype({"vec_id": "Int64"})
                    yield out.assign(recall=None, beam=None).astype({"recall": "Float64", "beam": "Int64"})

    # A block of queries meets a shard's graph: one row for each pair, dealt out by the shard's number.
    n = graphs.groupBy("dim").agg((F.max("s") + 1).alias("n"))
    pairs = queries.join(F.broadcast(n) if n.count() <= FEW else n, "dim").withColumn("s", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))).drop("n")
    found = written(pairs.join(graphs, ["dim", "s"]).mapInPandas(ask, "query_id long, vec_id long, score double, recall double, beam long"))
    discard(nodes, graphs, asked, queries)
    return found
