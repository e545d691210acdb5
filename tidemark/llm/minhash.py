"""MinHash near-dedup by a multi-index Hamming join.

Signatures are split by pigeonhole into chunks, of which one at least has few errors if two signatures are near;
the allowed errors of each chunk are enumerated as wildcards, so that near signatures share a key. Candidates are
confirmed on full shingle sets and joined into components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm._common import FEW, discard, lean, one_each, texts, written
from tidemark.llm.features import by_size
from tidemark.llm.shingles import WORDS, mix, shingle_sets
from tidemark.operators.components import connected_components

#: Symbols of 16 bits in a signature, and in a chunk; one error is allowed in each chunk, so that all pairs of
#: signatures that differ in up to 2 * 12 - 1 = 23 of 60 symbols share a key. A pair at similarity 0.75 shares none
#: with a chance of 6e-6.
SYMBOLS, CHUNK = 60, 5
#: Differing symbols, of 4 bits each, up to which documents may be linked: at 0.75 the mean is 14 and the deviation 3.3.
APART = 29
#: Differing symbols up to which a document is put in its hub's class, so that few are left to meet the others.
CLASS_APART = 38
#: Documents of a class, and shingles in all, up to which it is one group; and shingles in a block of a larger class.
BLOCK, SHINGLES = 512, 1 << 19


def _signature(s: np.ndarray, multipliers: np.ndarray) -> bytes:
    out = np.full(SYMBOLS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(s), 2048):
        np.minimum(out, (s[at : at + 2048, None] * multipliers[None, :]).min(0), out)
    return (mix(out) & np.uint64(0xFFFF)).astype("<u2").tobytes()


def _seeds() -> np.ndarray:
    return mix(np.arange(1, SYMBOLS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def signatures(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """``doc_id``, ``n`` (size of the shingle set), ``h1`` and ``h2`` (the set's digest) and ``sig``."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds = _seeds()
        for b in batches:
            n, h1, h2, sig = [], [], [], []
            for s in shingle_sets(texts(b.column(1)), words):
                n.append(len(s))
                h1.append(int(mix(s).sum(dtype=np.uint64).astype(np.int64)))
                h2.append(int(mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).astype(np.int64)))
                sig.append(_signature(s, seeds))
            yield pa.record_batch([b.column(0), pa.array(n, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(sig, pa.binary())], names=["doc_id", "n", "h1", "h2", "sig"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, h1 long, h2 long, sig binary")


def chunk_keys(reps: DataFrame) -> DataFrame:
    """``key``, ``doc_id``, ``n``: for each chunk of a signature and each place of an error, the other symbols."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                c = b.slice(at, 2000)
                sig = np.frombuffer(b"".join(c.column(2).to_pylist()), "<u2").reshape(c.num_rows, -1).astype(np.uint64)
                keys = np.empty((c.num_rows, SYMBOLS), np.uint64)
                for error in range(SYMBOLS):
                    first = error - error % CHUNK
                    x = np.full(c.num_rows, error + 1, np.uint64)
                    for place in range(first, first + CHUNK):
                        if place != error:
                            x = mix(x * np.uint64(0x9E3779B97F4A7C15) + sig[:, place])
                    keys[:, error] = x
                doc, n = (np.repeat(c.column(i).to_numpy(), SYMBOLS) for i in (0, 1))
                yield pa.record_batch([pa.array(keys.ravel().view(np.int64)), pa.array(doc), pa.array(n)], names=["key", "doc_id", "n"])

    return reps.select("doc_id", "n", "sig").mapInArrow(run, "key long, doc_id long, n long")


def packed(sig: str = "sig") -> Column:
    """The low 4 bits of each symbol, 15 symbols to a long."""
    h = F.hex(sig)
    longs = []
    for at in range(0, SYMBOLS, 15):
        nibbles = [F.substring(h, 4 * i + 2, 1) for i in range(at, at + 15)]
        longs.append(F.conv(F.concat(*nibbles), 16, 10).cast("long"))
    return F.array(*longs)


def apart(a: str, b: str) -> Column:
    """In how many symbols two packed signatures differ."""
    total = F.lit(0)
    for i in range(-(-SYMBOLS // 15)):
        x = F.col(a)[i].bitwiseXOR(F.col(b)[i])
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(0x1111111111111111))
        total = total + F.bit_count(x)
    return total


def full_sets(docs: DataFrame, member: DataFrame, words: int = WORDS) -> DataFrame:
    """``member``, a written table of distinct ids (``doc_id`` and what is known of each), with ``s``: the document's shingle
    set as sorted hashes. Members are broadcast if they are few, so that texts needn't be shuffled."""
    names = member.columns
    few = member.count() <= FEW // 4  # a member is some 90 bytes

    @lean
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, some in by_size(texts(b.column(0))):
                found = [s.tobytes() for s in shingle_sets(some, words)]
                yield pa.record_batch([*(c.slice(at, len(some)) for c in b.columns[1:]), pa.array(found, pa.binary())], names=[*names, "s"])

    held = docs.select("doc_id", "text").join(F.broadcast(member) if few else member.hint("merge"), "doc_id")
    return held.select("text", *names).mapInArrow(sets, T.StructType([*member.schema, T.StructField("s", T.BinaryType())]))


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int = 75) -> DataFrame:
    """Of distinct ``a``, ``b`` pairs of ids, those whose full sets' intersection is ``percent`` of the union or more."""

    @lean
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column(2), b.column(3)):
                x, y = (np.frombuffer(z.as_buffer(), np.uint64) for z in (x, y))
                both = np.sort(np.concatenate([x, y]))
                shared = int((both[1:] == both[:-1]).sum())
                keep.append(100 * shared >= percent * (len(x) + len(y) - shared))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["u", "v"]).filter(pa.array(keep, pa.bool_()))

    both = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("s").alias("s")), "a").join(sets.select(F.col("doc_id").alias("b"), F.col("s").alias("t")), "b")
    return both.select("a", "b", "s", "t").mapInArrow(check, "u long, v long")


class _Components:
    """Union-find over the components of a group's documents."""

    def __init__(self, component: np.ndarray):
        self.names, self.label = np.unique(component, return_inverse=True)
        self.root = np.arange(len(self.names))

    def find(self, a: int) -> int:
        root = self.root
        while (b := root[a]) != a:
            root[a] = a = root[b]
        return int(a)

    def roots(self) -> np.ndarray:
        """The component of every document, as a number."""
        while (self.root[self.root] != self.root).any():
            self.root = self.root[self.root]
        return self.root[self.label]

    def join(self, i: int, j: int) -> bool:
        """Whether ``i`` and ``j`` weren't in one component; they are now."""
        a, b = self.find(self.label[i]), self.find(self.label[j])
        self.root[max(a, b)] = min(a, b)
        return a != b


def differing(p: np.ndarray, one: np.ndarray) -> np.ndarray:
    """In how many symbols packed signatures (rows of ``p``) differ from one."""
    x = p ^ one
    x |= x >> np.uint64(2)
    x |= x >> np.uint64(1)
    return np.bitwise_count(x & np.uint64(0x1111111111111111)).sum(1)


def links_of(mine: np.ndarray, doc: np.ndarray, component: np.ndarray, sets: list[np.ndarray], p: np.ndarray, percent: int) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Links of the documents ``mine`` (row numbers) with all others of a group that join components, found on full sets,
    and the components that result. Only documents with near signatures are compared; one that has many in other
    components meets all in one pass."""
    state, size = _Components(component), np.array([len(x) for x in sets])
    first = np.cumsum(size) - size
    flat = mark = inverse = None
    out = []
    for i in mine.tolist():
        root = state.roots()
        near = np.flatnonzero((root != root[i]) & (differing(p, p[i]) <= APART) & (100 * np.minimum(size, size[i]) >= percent * np.maximum(size, size[i])))
        if len(near) > 32:
            if flat is None:
                flat, inverse = np.unique(np.concatenate(sets), return_inverse=True)
                mark = np.zeros(len(flat), np.int32)
            own = inverse[first[i] : first[i] + size[i]]
            mark[own] = 1
            shared = np.add.reduceat(mark[inverse], first)[near]
            mark[own] = 0
        else:
            at = [np.minimum(np.searchsorted(sets[i], sets[j]), size[i] - 1) for j in near]
            shared = np.array([(sets[i][a] == sets[j]).sum() for a, j in zip(at, near)], np.int64)
        for j in near[100 * shared >= percent * (size[near] + size[i] - shared)].tolist():
            if state.join(i, j):
                out.append((int(doc[i]), int(doc[j])))
    return out, state.names[state.roots()]


def _arrays(t: pa.Table) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Ids, sets and packed signatures of a group."""
    sets = [np.frombuffer(x.as_buffer(), np.uint64) for c in t.column("s").chunks for x in c]
    return t.column("doc_id").to_numpy(), sets, np.array(t.column("p").to_pylist(), np.int64).view(np.uint64)


def small_classes(sets: DataFrame, percent: int = 75) -> DataFrame:
    """Components (``node``, ``component_id``) of classes of few documents (``class``, ``doc_id``, ``p``, ``s``), each
    resolved in one task."""

    def run(t: pa.Table) -> pa.Table:
        doc, full, p = _arrays(t)
        _, component = links_of(np.arange(1, len(doc)), doc, doc, full, p, percent)
        return pa.table({"node": pa.array(doc), "component_id": pa.array(component)})

    return sets.select("class", "doc_id", "p", "s").groupBy("class").applyInArrow(run, "node long, component_id long")


def class_links(member: DataFrame, sets: DataFrame, percent: int = 75) -> DataFrame:
    """Links within large classes (``class``, ``doc_id``, ``c``: component so far, ``n``, ``p``) that join components.

    The members outside a class's largest component meet all others: these are split into blocks, and those into parts,
    of bounded size, and each part and block are one group in which full sets are compared. No pair of documents leaves
    it but the links that are needed.
    """

    def run(t: pa.Table) -> pa.Table:
        doc, full, p = _arrays(t)
        mine = np.flatnonzero(t.column("outside").to_numpy())
        found, _ = links_of(mine, doc, t.column("c").to_numpy(), full, p, percent)
        return pa.table({"u": pa.array([x for x, _ in found], pa.int64()), "v": pa.array([y for _, y in found], pa.int64())})

    parts = member.groupBy("class", "c").agg(F.count("*").alias("m"), F.sum("n").alias("n"))
    whole = parts.groupBy("class").agg(F.max_by("c", F.struct("m", -F.col("c"))).alias("main"), F.sum("n").alias("all"), F.count("*").alias("k")).where("k > 1")
    rest = parts.join(whole, "class").where("c <> main").groupBy("class", "main", "all").agg(F.sum("n").alias("some"))
    count = lambda c: F.ceil(F.col(c) / SHINGLES).cast("int")
    sized = written(rest.select("class", "main", count("all").alias("blocks"), count("some").alias("parts")))
    own = member.join(sized, "class").join(sets.select("doc_id", "s"), "doc_id")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    dealt = lambda n: F.pmod(F.xxhash64("doc_id"), n).cast("int")
    cols = ["doc_id", "c", "p", "s"]
    members = own.select("class", dealt("blocks").alias("i"), every("parts").alias("j"), F.lit(False).alias("outside"), *cols)
    asked = own.where("c <> main").select("class", every("blocks").alias("i"), dealt("parts").alias("j"), F.lit(True).alias("outside"), *cols)
    return members.union(asked).groupBy("class", "i", "j").applyInArrow(run, "u long, v long")


def near_duplicate_documents(docs: DataFrame, words: int = WORDS, percent: int = 75) -> DataFrame:
    """Groups documents whose shingle sets have a Jaccard similarity of ``percent`` or more.

    Returns a row per document: ``doc_id``, ``n_shingles``, ``component_id`` (smallest ``doc_id`` reachable by links)
    and ``kept``. Null and empty texts, and those of white space only, have an empty set and link with nothing. Texts
    of fewer words than a shingle have one, the whole sequence. Equal sets are compared once. Rows that repeat an id
    count once, with the least text, and come out once; a null ``doc_id`` links with nothing and has a null component.
    Extra columns are ignored; an empty table gives an empty result.

    Documents under a key meet the first of them, the hub: those with near signatures form a class with it. A document
    that isn't near its hub meets the others under the key. Full sets are compared within a class, in one task if it
    is small; in a large one they are confirmed against hubs first, and what that leaves outside the largest component
    meets the rest block by block, so that no link is lost and no pairs are listed.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    docs = one_each(docs)
    about = written(signatures(docs, words))
    full = about.where("n > 0 and doc_id is not null")
    same = ["h1", "h2", "n"]
    groups = full.groupBy(*same).agg(F.min(F.struct("doc_id", "sig")).alias("r"))
    reps = written(groups.select(*same, F.col("r.doc_id").alias("doc_id"), F.col("r.sig").alias("sig")))
    near = reps.select("doc_id", "n", packed().alias("p"))

    keys = chunk_keys(reps)
    # Written first: a join of two tables can be split where a key is very frequent, one above an aggregate can't.
    shared = written(keys.groupBy("key").agg(F.count("*").alias("c")).where("c > 1"))
    held = written(keys.join(shared.hint("merge"), "key").select("key", "doc_id", "c"))
    # The hub is the document whose keys are the most frequent: what copies were made from, rather than one of them.
    fame = written(held.groupBy("doc_id").agg(F.sum("c").alias("fame")))
    hubs = written(held.join(fame, "doc_id").groupBy("key").agg(F.max(F.struct("fame", -F.col("doc_id"))).alias("h")).select("key", (-F.col("h.col2")).alias("hub")))
    stars = written(held.join(hubs, "key").select("key", "doc_id", "hub"))
    discard(shared, held, fame, hubs)
    sized = 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")
    alike = sized & (apart("pa", "pb") <= APART)
    side = lambda x: near.select(F.col("doc_id").alias(x), F.col("n").alias(f"n{x}"), F.col("p").alias(f"p{x}"))
    pairs = stars.where("doc_id <> hub").select(F.col("hub").alias("a"), F.col("doc_id").alias("b")).distinct()
    first = written(pairs.join(side("a"), "a").join(side("b"), "b").where(apart("pa", "pb") <= CLASS_APART).select("a", "b", alike.alias("alike")))

    far = written(stars.where("doc_id <> hub").join(first.select(F.col("a").alias("hub"), F.col("b").alias("doc_id")), ["hub", "doc_id"], "left_anti").select("key", "doc_id"))
    under = stars.join(far.select("key").distinct(), "key", "left_semi").select("key", "doc_id")
    a = far.withColumnRenamed("doc_id", "a").join(side("a"), "a")
    b = under.withColumnRenamed("doc_id", "b").join(side("b"), "b")
    met = a.join(b, "key").where((F.col("a") != F.col("b")) & alike).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    candidates = written(first.select("a", "b").union(met).distinct())
    classes = written(connected_components(candidates.select(F.col("a").alias("u"), F.col("b").alias("v"))).select(F.col("node").alias("doc_id"), F.col("component_id").alias("class")))
    discard(stars, far, candidates)
    member = classes.join(near, "doc_id")
    sizes = member.groupBy("class").agg(((F.count("*") > BLOCK) | (F.sum("n") > SHINGLES)).alias("large"))
    member = written(member.join(sizes, "class"))
    # A small class's sets are shuffled once, to their class; only a large one's are joined with links and blocks.
    sets = written(full_sets(docs, member, words))
    component = written(small_classes(sets.where("not large"), percent))
    large = member.where("large").drop("large")
    if large.limit(1).count():
        some = sets.where("large").select("doc_id", "s")
        # First the hubs connect what they can, so that only what is left apart meets the others.
        mine = first.where("alike").select("a", "b").join(large.select(F.col("doc_id").alias("a")), "a", "left_semi")
        links = written(confirmed(mine, some, percent))
        so_far = connected_components(links).withColumnRenamed("node", "doc_id")
        now = written(large.join(so_far, "doc_id", "left").withColumn("c", F.coalesce("component_id", "doc_id")).drop("component_id"))
        more = written(class_links(now, some, percent))
        component = written(component.union(connected_components(links.union(more))))
        discard(links, now, more)
    discard(first, classes, sets, member)

    member = reps.select(*same, F.col("doc_id").alias("rep")).join(component.withColumnRenamed("node", "rep"), "rep", "left").select(*same, F.coalesce("component_id", "rep").alias("c"))
    out = about.join(member, same, "left")
    c = F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.coalesce("c", "doc_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), c.alias("component_id"), (c == F.col("doc_id")).alias("kept"))
