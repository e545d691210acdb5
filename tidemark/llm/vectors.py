"""Embedding near-dedup: a hierarchical navigable small-world graph per shard, queries against every shard, beams
that widen until recall audits pass, cosines verified in double precision, and components of the links."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._common import written
from tidemark.llm.shingles import mix
from tidemark.operators.components import connected_components

#: Vectors in a shard and in a block of queries, on average.
SHARD = 8000
#: Neighbours of a node: in upper layers and in the lowest.
UPPER, LOWEST = 16, 32
#: Searches that advance together, and nodes that each expands at a time.
TOGETHER, EXPAND = 256, 4
#: Share of audited queries' nearest neighbours and links that a search must find; neighbours of each that are audited.
RECALL, NEAREST = 0.97, 10


class SmallWorld:
    """Hierarchical navigable small-world graph over unit vectors; inserts and searches run in batches."""

    def __init__(self, x: np.ndarray, seed: int = 7):
        n = len(x)
        self.x = x.astype(np.float32)
        level = np.minimum(np.floor(-np.log(1 - np.random.default_rng(seed).random(n)) / np.log(LOWEST)), 6).astype(int)
        self.order = np.argsort(-level, kind="stable")  # upper layers are filled first
        self.x, self.level = np.ascontiguousarray(self.x[self.order]), level[self.order]
        self.links = [np.full((int((self.level >= h).sum()), LOWEST if h == 0 else UPPER), -1, np.int32) for h in range(int(level.max(initial=0)) + 1)]
        done = 0
        while done < n:
            more = min(n, max(done + 1, min(2 * done, done + 1024)))
            self._insert(done, more)
            done = more

    def _insert(self, a: int, b: int) -> None:
        """Adds nodes ``a`` to ``b``; each batch is no larger than what is there."""
        if a == 0:
            return
        for h in range(len(self.links)):
            new = np.arange(a, min(b, len(self.links[h])))
            if not len(new):
                continue
            for at in range(0, len(new), TOGETHER):
                some = new[at : at + TOGETHER]
                ids, sims = self.search(self.x[some], 48, h, a)
                self._connect(h, some, ids, sims)

    def _connect(self, h: int, nodes: np.ndarray, ids: np.ndarray, sims: np.ndarray) -> None:
        links = self.links[h]
        width = links.shape[1]
        chosen = self._diverse(ids, sims, width // 2)
        links[nodes, : chosen.shape[1]] = chosen
        # Links back: with what a node had, the most diverse are kept.
        src = np.repeat(nodes, chosen.shape[1])
        dst = chosen.ravel()
        ok = dst >= 0
        src, dst = src[ok], dst[ok]
        by = np.argsort(dst, kind="stable")
        src, dst = src[by], dst[by]
        to, first, count = np.unique(dst, return_index=True, return_counts=True)
        most = int(count.max(initial=0))
        add = np.full((len(to), most), -1, np.int32)
        add[np.repeat(np.arange(len(to)), count), np.arange(len(dst)) - np.repeat(first, count)] = src
        both = np.concatenate([links[to], add], 1)
        free = (both >= 0).sum(1) <= width
        packed = np.take_along_axis(both, np.argsort(both < 0, axis=1, kind="stable"), 1)
        links[to[free]] = packed[free][:, :width]
        for at in range(0, int((~free).sum()), 512):
            full = np.flatnonzero(~free)[at : at + 512]
            cand = packed[full]
            s = np.einsum("bkd,bd->bk", self.x[np.maximum(cand, 0)], self.x[to[full]])
            s[cand < 0] = -2
            by = np.argsort(-s, axis=1, kind="stable")
            links[to[full]] = self._diverse(np.take_along_axis(cand, by, 1), np.take_along_axis(s, by, 1), width)

    def _diverse(self, ids: np.ndarray, sims: np.ndarray, width: int) -> np.ndarray:
        """Of candidates by falling similarity, those nearer to the node than to one chosen already, then the rest."""
        ids, sims = ids[:, : 2 * LOWEST], sims[:, : 2 * LOWEST]
        v = self.x[np.maximum(ids, 0)]
        between = np.einsum("bid,bjd->bij", v, v)
        n, m = ids.shape
        kept = np.zeros((n, m), bool)
        for j in range(m):
            near = ((between[:, j, :j] > sims[:, j, None]) & kept[:, :j]).any(1)
            kept[:, j] = (ids[:, j] >= 0) & ~near & (kept.sum(1) < width)
        by = np.argsort(np.where(kept, 0, np.where(ids >= 0, 1, 2)), axis=1, kind="stable")[:, :width]
        out = np.take_along_axis(ids, by, 1)
        return np.pad(out, ((0, 0), (0, width - out.shape[1])), constant_values=-1) if out.shape[1] < width else out

    def search(self, q: np.ndarray, beam: int, layer: int = 0, until: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ``beam`` best nodes found for each query, by falling similarity; -1 where there are fewer.

        Descends from the entry through the upper layers; ``until`` keeps to the nodes below it.
        """
        n = len(self.x) if until is None else until
        entry = np.zeros((len(q), 1), np.int32)
        for h in range(len(self.links) - 1, layer, -1):
            if min(n, len(self.links[h])) > 1:
                entry = self._beam(q, entry, 4, h, n)[0][:, :1]
        return self._beam(q, entry, beam, layer, n)

    def _beam(self, q: np.ndarray, entry: np.ndarray, beam: int, h: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        links, rows = self.links[h], np.arange(len(q))
        seen = np.zeros((len(q), n + 1), bool)
        ids = np.full((len(q), beam), -1, np.int32)
        sims = np.full((len(q), beam), -2, np.float32)
        done = np.ones((len(q), beam), bool)
        ids[:, :1], sims[:, 0], done[:, 0] = entry, np.einsum("bd,bd->b", q, self.x[entry[:, 0]]), False
        seen[rows, entry[:, 0]] = True
        live = rows
        while len(live):
            # ids are by falling similarity: the first that aren't done are the best.
            wait = ~done[live]
            pick = wait & (np.cumsum(wait, 1) <= EXPAND)
            r, c = np.nonzero(pick)
            done[live[r], c] = True
            near = links[ids[live[r], c]]
            place = np.arange(len(r)) - np.searchsorted(r, r)
            more = np.full((len(live), EXPAND, links.shape[1]), n, np.int32)
            more[r, place] = np.where((near < 0) | (near >= n), n, near)
            more = np.sort(more.reshape(len(live), -1), 1)
            more[:, 1:][more[:, 1:] == more[:, :-1]] = n
            more[seen[live[:, None], more]] = n
            seen[live[:, None], more] = True
            seen[:, n] = False
            fresh = more < n
            s = np.full(more.shape, -2, np.float32)
            a, b = np.nonzero(fresh)
            s[a, b] = np.einsum("bd,bd->b", self.x[more[a, b]], q[live[a]])
            all_s = np.concatenate([sims[live], s], 1)
            all_i = np.concatenate([ids[live], np.where(fresh, more, -1)], 1)
            all_d = np.concatenate([done[live], ~fresh], 1)
            by = np.argsort(-all_s, axis=1, kind="stable")[:, :beam]
            sims[live], ids[live], done[live] = (np.take_along_axis(x, by, 1) for x in (all_s, all_i, all_d))
            live = live[(~done[live]).any(1)]
        return ids, sims


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def valid_vectors(vectors: DataFrame) -> DataFrame:
    """Rows whose label is not null and whose vector is finite, without nulls and not zero; ``x`` as doubles."""
    x = F.col("embedding").cast("array<double>")
    limit = F.lit(1.7976931348623157e308)
    fine = F.forall("x", lambda v: F.coalesce((F.abs(v) <= limit) & ~F.isnan(v), F.lit(False))) & F.exists("x", lambda v: v != 0)
    out = vectors.select(F.col("vec_id").cast("long"), "label", x.alias("x")).where("vec_id is not null and label is not null and x is not null")
    # A common factor changes no cosine; it keeps sums of squares within a double.
    most = F.aggregate("x", F.lit(0.0), lambda a, v: F.greatest(a, F.abs(v)))
    return out.where(fine).withColumn("m", most).select("vec_id", "label", F.transform("x", lambda v: v / F.col("m")).alias("x"))


def near_duplicate_vectors(vectors: DataFrame, least: float = 0.98, shard: int = SHARD, recall: float = RECALL, audits: int = 64) -> DataFrame:
    """Links vectors of one label at cosine ``least`` or more and keeps the first of each component.

    Returns a row per vector: ``vec_id``, ``n_links`` (other vectors linked directly), ``component_id`` (smallest
    ``vec_id`` reachable) and ``kept``. Vectors that are null, zero, of a null label, or hold null or non-finite
    components link with nothing, as do vectors of different lengths. Equal vectors of a label are searched once
    and count as that many partners. A null ``vec_id`` is returned with no links and null elsewhere. Ids are taken
    to be unique; rows that repeat an id come out once for each row, with the most links and the least component of
    its vectors. An empty table gives an empty result.

    Every vector queries the graph of every shard of its label. In each block of queries ``audits`` queries, drawn by a
    hash of their ids, are compared with brute force, and the beam doubles until ``recall`` of their ten nearest
    neighbours are found, whether these are links or not, and as much of their links, copies counted once.
    ``search_audits`` returns what was measured.
    """
    rows, alike, found = _searched(vectors, least, shard, recall, audits)
    return _result(vectors, rows, alike, found)


def search_audits(vectors: DataFrame, least: float = 0.98, shard: int = SHARD, recall: float = RECALL, audits: int = 64) -> DataFrame:
    """The audits of that search: per block of queries and shard ``queries`` audited, ``recall`` of their ten nearest
    neighbours and the ``beam`` that reached it."""
    found = _searched(vectors, least, shard, recall, audits)[2]
    return found.where("u is null").select(F.col("n_links").alias("queries"), "recall", "beam")


def _searched(vectors: DataFrame, least: float, shard: int, recall: float, audits: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Valid rows, distinct vectors with their copies, and what searches found."""
    rows = written(valid_vectors(vectors))
    # Copies stand as one: the first of them, with how many they are.
    alike = rows.groupBy("label", "x").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    reps = written(alike.withColumn("dim", F.size("x")))
    sizes = reps.groupBy("label", "dim").agg(F.ceil(F.count("*") / shard).alias("shards"))
    dealt = reps.join(sizes, ["label", "dim"]).withColumn("s", F.pmod(F.xxhash64("rep"), "shards"))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rep", kind="stable")
        x = _unit(np.stack(pdf["x"].to_numpy()))
        g = SmallWorld(x)
        links = np.concatenate([h.ravel() for h in g.links]).astype("<i4") if len(x) else np.zeros(0, "<i4")
        row = {"label": pdf["label"].iloc[0], "dim": pdf["dim"].iloc[0], "s": pdf["s"].iloc[0]}
        row |= {"ids": pdf["rep"].to_numpy("<i8")[g.order].tobytes(), "copies": pdf["copies"].to_numpy("<i8")[g.order].tobytes(), "x": x[g.order].tobytes(), "layers": [len(h) for h in g.links], "links": links.tobytes()}
        return pd.DataFrame([row])

    label = dict(vectors.dtypes)["label"]
    schema = f"label {label}, dim int, s long, ids binary, copies binary, x binary, layers array<int>, links binary"
    graphs = written(dealt.select("label", "dim", "s", "rep", "copies", "x").groupBy("label", "dim", "s").applyInPandas(build, schema))

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for r in f.itertuples():
                yield _asked(r, least, recall, audits)

    # A block of queries meets a shard's graph: one row for each pair of shards.
    blocks = graphs.select("label", "dim", F.col("ids").alias("q_ids"), F.col("x").alias("q_x"))
    found = written(blocks.join(graphs, ["label", "dim"]).mapInPandas(ask, "u long, v long, n_links long, recall double, beam long"))
    return rows, alike, found


def _result(vectors: DataFrame, rows: DataFrame, alike: DataFrame, found: DataFrame) -> DataFrame:
    """Links and components per row of the table."""
    counts = found.where("u is not null and v is null").groupBy(F.col("u").alias("rep")).agg(F.sum("n_links").alias("n"))
    linked = connected_components(found.where("v is not null").select("u", "v")).withColumnRenamed("node", "rep")
    about = alike.join(counts, "rep", "left").join(linked, "rep", "left")
    about = about.select("label", "x", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component_id", "rep").alias("component_id"))
    valid = rows.join(about, ["label", "x"]).select("vec_id", "n_links", "component_id")
    every = vectors.select(F.col("vec_id").cast("long").alias("vec_id"))
    out = every.join(valid.groupBy("vec_id").agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id")), "vec_id", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (component == F.col("vec_id")).alias("kept"))


def _asked(r, least: float, recall: float, audits: int) -> pd.DataFrame:
    """What a block of queries finds in a shard: per query the number of its links (``v`` null), and links that
    connect all that are linked."""
    q_ids, ids, copies = (np.frombuffer(b, "<i8") for b in (r.q_ids, r.ids, r.copies))
    x = np.frombuffer(r.x).reshape(len(ids), -1)
    q = np.frombuffer(r.q_x).reshape(len(q_ids), -1)
    g = SmallWorld.__new__(SmallWorld)
    g.x, flat, at = x.astype(np.float32), np.frombuffer(r.links, "<i4"), 0
    g.links = []
    for h, n in enumerate(r.layers):
        width = LOWEST if h == 0 else UPPER
        g.links.append(flat[at : at + n * width].reshape(n, width))
        at += n * width
    sample = np.argsort(mix(q_ids.view(np.uint64)), kind="stable")[:audits]
    true = q[sample] @ x.T
    true[q_ids[sample, None] == ids[None, :]] = -2
    nearest = -np.sort(-true, axis=1)[:, min(NEAREST, len(ids)) - 1]  # the least similarity of what must be found
    alone = np.ones(len(ids), np.int64)
    partners = (true >= least).sum(1)
    beam, measured = 64, 0.0
    while True:
        measured = audited(g, q[sample], q_ids[sample], ids, nearest, beam)
        wide = beam >= len(ids)
        if measured >= recall or wide:
            # Links are counted once a copy here, so that no crowd outweighs the other queries.
            own, _ = _linked(g, q[sample], q_ids[sample], x, ids, alone, least, beam)
            if (np.minimum(own, partners) / np.maximum(partners, 1))[partners > 0].sum() >= recall * (partners > 0).sum() or wide:
                break
        beam *= 2
    links, forest = _linked(g, q, q_ids, x, ids, copies, least, beam)
    some = np.flatnonzero(links)
    u = pd.array([*q_ids[some].tolist(), *(a for a, _ in forest), None], "Int64")
    v = pd.array([*[None] * len(some), *(b for _, b in forest), None], "Int64")
    n = np.concatenate([links[some], np.zeros(len(forest), np.int64), [len(sample)]])
    none = [None] * (len(n) - 1)
    return pd.DataFrame({"u": u, "v": v, "n_links": n, "recall": pd.array([*none, measured], "Float64"), "beam": pd.array([*none, beam], "Int64")})


def audited(g: SmallWorld, q: np.ndarray, q_ids: np.ndarray, ids: np.ndarray, nearest: np.ndarray, beam: int) -> float:
    """Share of the nearest neighbours of some queries (as similar as ``nearest`` or more) that a search of this beam finds."""
    found, sims = g.search(q.astype(np.float32), min(beam, len(ids)))
    own = (found >= 0) & (ids[np.maximum(found, 0)] != q_ids[:, None])
    got = (own & (sims >= nearest[:, None] - 1e-5)).sum(1)
    want = min(NEAREST, len(ids))
    # A query that is a row of the shard itself has one neighbour less to find where the shard is small.
    want = np.minimum(want, np.maximum(1, len(ids) - np.isin(q_ids, ids)))
    return float(np.minimum(1, got / want)[np.isfinite(nearest) & (nearest > -2)].mean()) if (nearest > -2).any() else 1.0


def _linked(g: SmallWorld, q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, ids: np.ndarray, copies: np.ndarray, least: float, beam: int) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Per query its links' copies, and pairs that connect what is linked.

    Searches find neighbours, and the graph's own links join nodes; what they connect is one class, and the cosines
    of a class's queries with its nodes are all computed, in blocks, so that a crowded neighbourhood needs no wide beam.
    """
    n, loose = len(q), least - 1e-5  # the graph has single precision; doubles decide
    root = list(range(n + len(ids)))

    def find(a: int) -> int:
        while (b := root[a]) != a:
            root[a] = a = root[b]
        return a

    for at in range(0, n, TOGETHER):
        near, sims = g.search(q[at : at + TOGETHER].astype(np.float32), min(beam, len(ids)))
        i, c = np.nonzero(sims >= loose)
        for a, b in zip((at + i).tolist(), (n + near[i, c]).tolist()):
            ra, rb = find(a), find(b)
            root[max(ra, rb)] = min(ra, rb)
    ends = np.repeat(np.arange(len(ids)), LOWEST), g.links[0].ravel()
    for at in range(0, len(ends[0]), 1 << 16):
        a, b = (e[at : at + (1 << 16)] for e in ends)
        near = (b >= 0) & (np.einsum("nd,nd->n", g.x[a], g.x[b]) >= loose)
        for a, b in zip((n + a[near]).tolist(), (n + b[near]).tolist()):
            ra, rb = find(a), find(b)
            root[max(ra, rb)] = min(ra, rb)
    classes: dict[int, tuple[list[int], list[int]]] = {}
    for a in range(n + len(ids)):
        if (r := find(a)) < n:  # a class begins with a query, if it has one
            classes.setdefault(r, ([], []))[a >= n].append(a if a < n else a - n)
    links, forest = np.zeros(n, np.int64), []
    for some, nodes in classes.values():
        if not nodes:
            continue
        xs, cs, ns = x[nodes].T, copies[nodes], ids[nodes]
        mine: dict[int, int] = {}

        def top(a: int) -> int:
            while (b := mine.setdefault(a, a)) != a:
                mine[a] = a = mine.setdefault(b, b)
            return a

        for at in range(0, len(some), 512):
            rows = np.array(some[at : at + 512])
            ok = (q[rows] @ xs >= least) & (q_ids[rows, None] != ns[None, :])
            links[rows] = ok @ cs
            for k in np.flatnonzero(ok.any(1)):
                a, to = int(q_ids[rows[k]]), ns[ok[k]]
                for b in to.tolist():
                    ra, rb = top(a), top(b)
                    if ra != rb:
                        mine[max(ra, rb)] = min(ra, rb)
                        forest.append((a, b))
    return links, forest
