"""Substring dedup by collinear chaining: shared k-mer seeds are joined, ordered matches are chained with gap costs
through a Fenwick tree, and chains are aligned to find fuzzy passages."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm._common import discard, gathered, lean, make_room, of_ids, one_each, runs, starts, texts, written
from tidemark.llm.shingles import WORDS, batched_words, mix, windows, word_edges

#: Of this many successive k-mers one at least is a seed: all exact runs of 8 words hold one.
WINDOW = 4
#: Words of a long window, which lies in every exact run of twice as many.
HALF = 25
#: One document in SAMPLE tells which long windows are frequent: those that one of its documents in COMMON holds.
SAMPLE, COMMON = 32, 20
#: Words of a passage, at least; and the share of them that match, in percent.
LEAST, PERCENT = 50, 75
#: What a seed adds to a chain's score, and what a word between seeds takes from it.
GAIN, GAP_COST = 30.0, 0.6
#: Words between two seeds of one passage, at most; words that a chain of two seeds or more spans, at least.
GAP, SHORT = 80, 12
#: Words of a chain that counts even if nothing about it is known from earlier documents.
FEW_WORDS = 25
#: Bytes of text whose seeds are combined before they are shuffled.
COMBINED = 16 << 20
#: Bytes of text whose seeds a bucket holds, on average: a task has one bucket's in memory at a time.
BUCKET = 16 << 20
#: Classes that seeds and documents are dealt into, at least.
CLASSES = 32
#: Characters aligned beyond a chain's ends, at first; whole texts if a passage reaches beyond them.
MARGIN = 800
#: Documents that share a chain of seeds, up to which each is linked with every earlier one; more are told apart by one
#: seed more, or if the chain is a passage long, linked with the first.
TOGETHER = 16
#: Characters of text whose words are kept in memory for the next chain.
MEMORY = 1 << 20
_NONE = np.iinfo(np.uint64).max


def _code_points(text: bytes) -> np.ndarray:
    """For each byte, how many characters begin before it."""
    b = np.frombuffer(text, np.uint8)
    return np.concatenate([[0], np.cumsum((b & 0xC0) != 0x80)])


def _winnowed(key: np.ndarray, window: int) -> np.ndarray:
    """Places that hold the least of some ``window`` successive keys, the first of equal ones."""
    least = np.concatenate([key, np.full(window - 1, _NONE, np.uint64)])
    at, wide = np.arange(len(least)), 1
    while wide < window:  # two windows that overlap or touch make a wider one
        step = min(wide, window - wide)
        later = least[step:] < least[:-step]
        at, least = np.where(later, at[step:], at[:-step]), np.where(later, least[step:], least[:-step])
        wide += step
    return at[np.diff(at, prepend=-1) != 0]


def _long(k: np.ndarray, h: np.ndarray, own: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of HALF words of which each run of twice as many holds one: hashes, places, and the HALF words on either
    side, 4 bits each, followed by how many there are in the text on the left and on the right."""
    n = len(h) - HALF + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros((0, HALF + 2), np.uint8)
    total = np.full(n, HALF, np.uint64)
    for i in [*range(0, HALF - words, words), HALF - words]:
        total = mix(total + k[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
    whole = own[:n] == own[HALF - 1 :]
    at = _winnowed(np.where(whole, total, _NONE), HALF + 1)
    at = at[at < n]
    at = at[whole[at]]
    prints = np.concatenate([np.zeros(HALF, np.uint8), (h >> np.uint64(60)).astype(np.uint8), np.zeros(HALF, np.uint8)])
    around = prints[at[:, None] + np.concatenate([np.arange(HALF), np.arange(2 * HALF, 3 * HALF)])]
    left = np.minimum(at - np.searchsorted(own, own[at]), HALF)
    right = np.minimum(np.searchsorted(own, own[at], "right") - at - HALF, HALF)
    packed = around[:, ::2] << 4 | around[:, 1::2]
    return total[at], at, np.column_stack([packed, left, right]).astype(np.uint8)


def _seeded(ids: np.ndarray, every: list[bytes], words: int, short: bool = True) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Seeds of a batch of texts: hash, document and place (characters << 32 | words) of the k-mers that are the least
    of a window of k-mers, and of long windows, the latter with the words around them."""
    small: list[tuple] = [(np.zeros(0, np.int64),) * 3]
    large: list[tuple] = [(*small[0], np.zeros((0, HALF + 2), np.uint8))]
    for some, h, s, _, n in batched_words(every):
        k = windows(h, words)
        if not len(k):
            continue
        own = np.repeat(np.arange(len(some)), n)
        first = np.cumsum(n) - n
        begin = s
        if any(not every[i].isascii() for i in some):
            begin = np.concatenate([s[a : a + m] if every[i].isascii() else _code_points(every[i])[s[a : a + m]] for i, a, m in zip(some, first.tolist(), n.tolist())])
        place = begin << 32 | np.arange(len(h)) - first[own]
        doc = ids[np.array(some)]
        if short:
            whole = own[: len(k)] == own[words - 1 :]
            pick = _winnowed(np.where(whole, k, _NONE), WINDOW)
            pick = pick[pick < len(k)]
            pick = pick[whole[pick]]
            small.append((k[pick].view(np.int64), doc[own[pick]], place[pick]))
        more, at, around = _long(k, h, own, words)
        large.append((more.view(np.int64), doc[own[at]], place[at], around))
    return [np.concatenate(c) for c in zip(*small)], [np.concatenate(c) for c in zip(*large)]


def _linked(key: np.ndarray, doc: np.ndarray, at: np.ndarray, in_order: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a batch's occurrences of keys, which may be in the order of documents and places: the first of each key; pairs of a
    later occurrence and an earlier one, which is the one before in the same document, or else the key's first; and the
    firsts that others follow. The holders that this leaves out are met by ``other_holders``."""
    order = np.argsort(key, kind="stable") if in_order else np.lexsort((at, doc, key))
    k, d = key[order], doc[order]
    new = np.diff(k, prepend=k[:1] ^ 1) != 0
    head = np.maximum.accumulate(np.where(new, np.arange(len(k)), 0))
    again = ~new & (np.diff(d, prepend=d[:1]) == 0)
    later = np.flatnonzero(~new)
    later, before = order[later], order[np.where(again, np.arange(len(k)) - 1, head)[later]]
    by = np.argsort(later)
    return np.sort(order[new]), later[by], before[by], np.sort(order[new & ~np.append(new[1:], True)])


def _run_keys(seed: np.ndarray, around: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of long windows, for each run of twice HALF words that may hold one: the rows that have it, and its hash."""
    n = len(seed)
    side = np.empty((n, 2 * HALF), np.uint64)
    side[:, ::2], side[:, 1::2] = around[:, :HALF] >> 4, around[:, :HALF] & 15
    left, right = [np.zeros(n, np.uint64)], [np.full(n, 1, np.uint64)]
    for i in range(HALF):
        left.append(mix(left[-1] * np.uint64(0x9E3779B97F4A7C15) + side[:, HALF - 1 - i] + np.uint64(1)))
        right.append(mix(right[-1] * np.uint64(0x9E3779B97F4A7C15) + side[:, HALF + i] + np.uint64(1)))
    out = []
    for i in range(HALF + 1):
        some = np.flatnonzero((around[:, HALF] >= i) & (around[:, HALF + 1] >= HALF - i))
        out.append((some, mix(mix(left[i][some] + seed[some].view(np.uint64)) + right[HALF - i][some])))
    return out


def _holders(seed: np.ndarray, around: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Long windows and, for every run of twice HALF words about one, the first row that has it, where that is another;
    with the words that agree before and after the window."""
    pairs, before = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i, (some, key) in enumerate(_run_keys(seed, around)):
        order = np.argsort(key, kind="stable")
        new = np.diff(key[order], prepend=key[order][:1] ^ np.uint64(1)) != 0
        if len(some):
            to = some[order[new]][np.cumsum(new) - 1]
            own = some[order]
            pairs.append(own[own != to] * len(seed) + to[own != to])
            before.append(np.full(len(pairs[-1]), i))
    pair, n = np.unique(np.concatenate(pairs), return_inverse=True)
    b = np.concatenate(before)
    most, least = np.zeros(len(pair), np.int64), np.full(len(pair), HALF)
    np.maximum.at(most, n, b)
    np.minimum.at(least, n, b)
    return pair // max(1, len(seed)), pair % max(1, len(seed)), _proof(most, HALF - least)


def _proof(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """How many words before and after a long window agree, as one number over 0."""
    return (1 + (before.astype(np.int32) << 8 | after.astype(np.int32))).astype(np.int32)


def _packed(x: np.ndarray) -> bytes:
    """Numbers of 8 bytes, each byte's place together, compressed."""
    return pa.compress(np.ascontiguousarray(x.astype("<i8").view(np.uint8).reshape(len(x), 8).T).tobytes(), "zstd", asbytes=True)


def _unpacked(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, 8 * n, "zstd", asbytes=True), np.uint8).reshape(8, n)
    return np.ascontiguousarray(planes.T).view("<i8").ravel()


def _pack(bucket: int, first: np.ndarray, columns: list[np.ndarray], around: np.ndarray) -> tuple:
    """A row of ``_PACKS``; ``first`` are ids, nearly in order; ``columns`` are three or four."""
    return (bucket, len(first), _packed(np.diff(first, prepend=0)), *(_packed(c) for c in columns), *[b""] * (4 - len(columns)), around.tobytes())


_PACKS = pa.schema([("bucket", pa.int64()), ("n", pa.int64()), *((c, pa.binary()) for c in ("doc", "at", "x", "y", "z", "around"))])


def _class(key: np.ndarray, buckets: int) -> np.ndarray:
    """Of documents or keys, one of ``buckets`` classes."""
    return (mix(key.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)


def _by_bucket(bucket: np.ndarray) -> np.ndarray:
    """The order of buckets, and as it was within each."""
    few = len(bucket) and bucket.max() < 1 << 16  # sorted by radix
    return np.argsort(bucket.astype(np.uint16) if few else bucket, kind="stable")


def _dealt(bucket: np.ndarray, doc: np.ndarray, columns: list[np.ndarray], proof: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """Rows of ``_PACKS``, one for each bucket."""
    order = np.argsort(doc)
    order = order[_by_bucket(bucket[order])]
    cut = np.append(np.flatnonzero(np.diff(bucket[order], prepend=-1)), len(order)).tolist()
    for k in range(0, len(cut) - 1, 1024):
        rows = []
        for i, j in zip(cut[k : k + 1024], cut[k + 1 : k + 1025]):
            o = order[i:j]
            rows.append(_pack(int(bucket[o[0]]), doc[o], [c[o] for c in columns], np.zeros(0, np.uint8) if proof is None else proof[o].astype("<i4")))
        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), _PACKS)], schema=_PACKS)


def _buckets(t: pa.Table) -> Iterator[pa.Table]:
    """Rows of each bucket."""
    cut = [*starts(t, ["bucket"]).tolist(), t.num_rows]
    return (t.slice(a, b - a) for a, b in zip(cut[:-1], cut[1:]))


def _read(t: pa.Table, *columns: str) -> list[np.ndarray]:
    """Documents of packed rows, and what else is asked for."""
    parts = t.to_pylist()
    doc = np.concatenate([np.cumsum(_unpacked(r["doc"], r["n"])) for r in parts])
    return [doc, *(np.concatenate([_unpacked(r[c], r["n"]) for r in parts]) for c in columns)]


_PACKED = "bucket long, n long, doc binary, at binary, x binary, y binary, z binary, around binary"


def occurrences(docs: DataFrame, common: np.ndarray, buckets: int, words: int = WORDS) -> DataFrame:
    """Seeds, combined within each batch: a seed's first occurrence there goes on alone, the others are links with it. Long
    windows are combined where all words around them agree. Those of ``common`` go on as runs of twice HALF words, so
    that no key is shared by more than what does repeat, and that is combined, too.

    What a batch has for one of ``buckets`` classes of seeds is one row of compressed columns (``x``: keys, ``y``: proofs,
    ``around``: the words around long windows); its links are another, with ``bucket`` below 0 (``x``: other documents,
    ``y``: places there, ``z``: keys of short seeds, ``around``: proofs; a first that others follow is linked with itself). A seed is in a batch's rows once, so even one that all documents hold has
    no more rows than there are batches.
    """

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in gathered(batches, COMBINED):
            ids, every = b.column(0).to_numpy(), texts(b.column(1))
            order = np.argsort(ids, kind="stable").tolist()
            small, (seed, doc, at, around) = _seeded(ids[order], [every[i] for i in order], words)
            del b, ids, every  # here and below: each part goes once the next is made from it
            often = np.isin(seed, common)
            keys = [(mix(key + np.uint64(i)).view(np.int64), np.flatnonzero(often)[some]) for i, (some, key) in enumerate(_run_keys(seed[often], around[often]))]
            runs_ = [np.concatenate([k for k, _ in keys]), *(x[np.concatenate([s for _, s in keys])] for x in (doc, at))]
            ends = np.concatenate([np.full(len(k), i) for i, (k, _) in enumerate(keys)])
            seed, doc, at, around = (x[~often] for x in (seed, doc, at, around))
            ctx = seed.view(np.uint64)
            for i in range(0, HALF + 2):
                ctx = mix(ctx * np.uint64(0x9E3779B97F4A7C15) + around[:, i])
            heads, links = [], []
            kinds = (np.zeros(len(small[0]), np.int32), _proof(ends, HALF - ends), _proof(around[:, HALF], around[:, HALF + 1]))
            for proof, key, (s, d, a) in zip(kinds, (small[0], runs_[0], ctx.view(np.int64)), (small, runs_, (seed, doc, at))):
                first, later, before, led = _linked(key, d, a, proof is not kinds[1])
                heads.append((s[first], d[first], a[first], proof[first]))
                short = s is small[0]
                links.append((d[later], a[later], d[before], a[before], s[later] if short else np.zeros(len(later), np.int64), proof[later]))
                if short:
                    links.append((d[led], a[led], d[led], a[led], s[led], proof[led]))
            around, some = around[first], len(first)
            del small, runs_, keys, kinds, ctx, seed, doc, at, ends, often, first, later, before, led, s, proof, key
            d, a, other, other_at, own_key, proof = (np.concatenate(c) for c in zip(*links))
            del links
            rows = []
            if len(d):
                bucket = -1 - int(_class(d[:1], buckets)[0])
                rows.append(_pack(bucket, d, [a, other, other_at, own_key], proof.astype("<i4")))
            del other, other_at, own_key
            key, d, a, proof = (np.concatenate(c) for c in zip(*heads))
            del heads
            wide = np.zeros(len(key), bool)
            wide[len(key) - some :] = True
            bucket = (key.view(np.uint64) % np.uint64(buckets)).astype(np.int64)
            order = _by_bucket(bucket)  # long windows come last in each
            cut = np.append(np.flatnonzero(np.diff(bucket[order], prepend=-1)), len(order)).tolist()
            for i, j in zip(cut[:-1], cut[1:]):
                o = order[i:j]
                own = around[o[wide[o]] - (len(key) - some)]
                rows.append(_pack(int(bucket[o[0]]), d[o], [a[o], key[o], proof[o]], own))
            del key, d, a, proof, wide, bucket, order, around
            for i in range(0, len(rows), 1024):
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows[i : i + 1024]), _PACKS)], schema=_PACKS)
            del rows
            make_room()

    return docs.select("doc_id", "text").mapInArrow(run, _PACKED)


def common_windows(docs: DataFrame, words: int = WORDS) -> np.ndarray:
    """Long windows that one document in COMMON holds, judged by a sample. As many can be COMMON times those of a mean
    document at most, so the list doesn't grow with the corpus; it only decides how windows are dealt out."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, (seed, doc, _, _) = _seeded(b.column(0).to_numpy(), texts(b.column(1)), words, short=False)
            seed, n = np.unique(np.unique(np.column_stack([seed, doc]), axis=0)[:, 0], return_counts=True)
            yield pa.record_batch([pa.array(seed), pa.array(n)], names=["seed", "n"])

    sample = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE)) == 0).select("doc_id", "text")
    least = max(32 if SAMPLE > 1 else 2, sample.count() // COMMON)
    rows = sample.mapInArrow(run, "seed long, n long").groupBy("seed").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("seed").collect()
    return np.array(sorted(r[0] for r in rows), np.int64)


def classes(docs: DataFrame) -> int:
    """How many classes seeds and documents are dealt into."""
    size = docs.select(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(CLASSES, -(-size // BUCKET))  # rows are packed for each pair of classes, so small tables have few


def seed_matches(docs: DataFrame, buckets: int, words: int = WORDS) -> DataFrame:
    """Each seed beyond its first with an earlier holder, and the first with itself; with a proof over 0 (and a key of 0), each
    long window with those that agree with it on the runs of twice HALF words that were before around it.

    Rows are like those of ``occurrences``, and ``matched`` reads them: what a bucket of seeds has for one class of documents
    is one row of compressed columns (``x``: other documents, ``y``: places there, ``z``: keys of short seeds, ``around``:
    proofs). All rows of a class (``bucket``) are in one partition, one after another."""

    def found(t: pa.Table) -> tuple:
        """Matches of one bucket."""
        parts = [(r["n"], np.cumsum(_unpacked(r["doc"], r["n"])), *(_unpacked(r[c], r["n"]) for c in ("at", "x", "y")), r["around"]) for r in t.to_pylist()]
        if t.column(0)[0].as_py() < 0:
            doc, at, other, other_at = (np.concatenate([p[i] for p in parts]) for i in range(1, 5))
            keys = np.concatenate([_unpacked(r["z"], r["n"]) for r in t.to_pylist()])
            return doc, other, at, other_at, keys, np.concatenate([np.frombuffer(p[5], "<i4") for p in parts])
        n = np.array([p[0] for p in parts])
        m = np.array([len(p[5]) // (HALF + 2) for p in parts])
        doc, at, key, proof = (np.concatenate([p[i] for p in parts]) for i in range(1, 5))
        prints = [np.frombuffer(p[5], np.uint8).reshape(-1, HALF + 2) for p in parts]
        del parts
        row = np.full(len(key), -1)  # of the words around it
        ends = np.cumsum(n)
        row[np.repeat(ends - m, m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)] = np.arange(m.sum())
        order = np.argsort(key)
        again = np.diff(key[order], prepend=key[order[:1]] ^ 1) == 0
        order = order[again | np.append(again[1:], False)]  # what is shared
        order = order[np.lexsort((at[order], doc[order], key[order]))]
        doc, at, key, proof, row = (x[order] for x in (doc, at, key, proof, row))
        new = np.diff(key, prepend=key[:1] ^ 1) != 0
        head = np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))
        some = np.flatnonzero(~new)
        out = [(some, head[some], np.where(row[some] < 0, proof[some], 0).astype(np.int32))]
        plain = (row < 0) & (proof == 0)
        some = np.flatnonzero(new & plain)
        out.append((some, some, np.zeros(len(some), np.int32)))
        some = np.flatnonzero(row >= 0)
        if len(some):
            later, first, agree = _holders(key[some], np.concatenate(prints)[row[some]])
            out.append((some[later], some[first], agree))
        i, j, w = (np.concatenate(c) for c in zip(*out))
        return doc[i], doc[j], at[i], at[j], np.where(plain[i], key[i], 0), w

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, ["bucket"]):
            cut = [*starts(t, ["bucket"]).tolist(), t.num_rows]
            for a, b in zip(cut[:-1], cut[1:]):
                doc, other, at, other_at, key, proof = found(t.slice(a, b - a))
                yield from _dealt(_class(doc, buckets), doc, [at, other, other_at, key], proof)
                del doc, other, at, other_at, key, proof

    dealt = occurrences(docs, common_windows(docs, words), buckets, words).repartition("bucket")
    matches = dealt.sortWithinPartitions("bucket").mapInArrow(run, _PACKED)
    return matches.repartition("bucket").sortWithinPartitions("bucket")


def matched(t: pa.Table) -> tuple[np.ndarray, ...]:
    """Matches of one class of documents: document, other document, places in both, key and proof."""
    doc, at, other, other_at, key = _read(t, "at", "x", "y", "z")
    return doc, other, at, other_at, key, np.concatenate([np.frombuffer(x, "<i4") for x in t.column("around").to_pylist()])


def chains(d: np.ndarray, h: np.ndarray) -> list[list[int]]:
    """Chains of matches (``d`` in one text, ``h`` in the other; sorted by ``d``) that rise in both, best first.

    A match adds GAIN, a word between two matches takes GAP_COST in either text: the best predecessor is a
    prefix maximum over ``h``, which a Fenwick tree gives. Chains are cut where a gap is wider than GAP.
    """
    n = len(d)
    step = np.diff(h - d)
    if not step.any():  # one diagonal, as in exact copies
        cut = np.flatnonzero(np.diff(d) > GAP) + 1
        return [list(range(a, b)) for a, b in zip([0, *cut.tolist()], [*cut.tolist(), n])]
    rank = np.searchsorted(np.unique(h), h).tolist()
    size = max(rank) + 1
    best = [(float("-inf"), -1)] * (size + 1)
    dl, hl = d.tolist(), h.tolist()
    score, before = [0.0] * n, [-1] * n
    waiting: list[int] = []
    for i in range(n):
        if waiting and dl[waiting[0]] < dl[i]:
            for j in waiting:  # matches at one place of the first text can't follow each other
                value, at = (score[j] + GAP_COST * (dl[j] + hl[j]), j), rank[j] + 1
                while at <= size:
                    if best[at] < value:
                        best[at] = value
                    at += at & -at
            waiting = []
        value, at = (float("-inf"), -1), rank[i]
        while at:
            if best[at] > value:
                value = best[at]
            at -= at & -at
        gain = value[0] - GAP_COST * (dl[i] + hl[i])
        score[i], before[i] = (GAIN + gain, value[1]) if gain > 0 else (GAIN, -1)
        waiting.append(i)
    used = [False] * n
    out = []
    for i in np.argsort(-np.array(score), kind="stable").tolist():
        if used[i]:
            continue
        if before[i] < 0 or used[before[i]]:
            used[i] = True
            out.append([i])
            continue
        path = []
        while i >= 0 and not used[i]:
            used[i] = True
            path.append(i)
            i = before[i]
        path.reverse()
        at = 0
        for k in range(1, len(path) + 1):
            if k == len(path) or dl[path[k]] - dl[path[k - 1]] > GAP or hl[path[k]] - hl[path[k - 1]] > GAP:
                if k > at:
                    out.append(path[at:k])
                at = k
    return out


def _common(x: list[int], y: list[int]) -> int:
    """Length of the longest common subsequence of two short word sequences."""
    n = min(len(x), len(y))
    a = 0
    while a < n and x[a] == y[a]:
        a += 1
    b = 0
    while b < n - a and x[-1 - b] == y[-1 - b]:
        b += 1
    x, y = x[a : len(x) - b], y[a : len(y) - b]
    if not x or not y:
        return a + b
    if len(x) * len(y) <= 64:
        row = [0] * (len(y) + 1)
        for w in x:
            diagonal = 0
            for k, v in enumerate(y):
                up = row[k + 1]
                row[k + 1] = diagonal + 1 if v == w else max(up, row[k])
                diagonal = up
        return a + b + row[-1]
    ys, wide = np.array(y, np.int64), np.zeros(len(y) + 1, np.int32)
    for w in x:
        new = np.maximum(wide[1:], wide[:-1] + (ys == w))
        wide[1:] = np.maximum.accumulate(new)
    return a + b + int(wide[-1])


def _run(x: np.ndarray, y: np.ndarray, i: int, j: int, n: int) -> int:
    """How many of ``n`` words from ``i`` and ``j`` on are equal before the first that differ."""
    at, wide = 0, 32
    while at < n:
        differ = x[i + at : i + min(at + wide, n)] != y[j + at : j + min(at + wide, n)]
        run = int(differ.argmax())
        if differ[run]:
            return at + run
        at, wide = at + wide, 4 * wide
    return n


def _extend(x: np.ndarray, y: np.ndarray, xs: list[int], ys: list[int], i0: int, j0: int) -> tuple[int, int, int]:
    """How far two sequences, given as arrays and as lists, stay alike from ``i0`` and ``j0`` on: lengths of both parts and
    matches. A change of up to 4 words is bridged if 4 equal words follow, and replaced words are if over twice as many
    equal ones follow."""
    i, j, same = i0, j0, 0
    while True:
        n = min(len(x) - i, len(y) - j)
        if n and xs[i] == ys[j]:
            run = _run(x, y, i, j, n)
            i, j, same = i + run, j + run, same + run
        u, v = xs[i : i + 8], ys[j : j + 8]
        if len(u) > 3 and len(v) > 3:
            near = [tuple(v[b : b + 4]) for b in range(min(5, len(v) - 3))]
            far = [tuple(u[a : a + 4]) for a in range(min(5, len(u) - 3))]
            if not set(near).isdisjoint(far):
                a, b = next((a, b) for a, b in _CHANGES if a < len(far) and b < len(near) and far[a] == near[b])
                i, j = i + a, j + b
                continue
        n = min(len(x) - i, len(y) - j, LEAST)
        if not n:
            return i - i0, j - j0, same
        equal = x[i : i + n] == y[j : j + n]
        score = np.where(equal, 1, -2).cumsum()
        n = int(score.argmax()) + 1
        if score[n - 1] <= 0:
            return i - i0, j - j0, same
        i, j, same = i + n, j + n, same + int(equal[:n].sum())


_CHANGES = sorted(((a, b) for a in range(5) for b in range(5) if a + b), key=lambda c: (max(c), sum(c)))


class _Words:
    """A text's words as hashes that are compared in this process only, as a list and an array; their first characters
    and ends."""

    def __init__(self, text: str):
        raw = text.encode()
        each = raw.lower().split()
        self.list = list(map(hash, each))
        self.back = self.list[::-1]
        self.h = np.array(self.list, np.int64)
        size = np.fromiter(map(len, each), np.int64, len(each))
        if len(each) and size.sum() + len(each) - 1 == len(raw):  # one character between words, none about them
            self.end = np.cumsum(size + 1) - 1
            self.begin = self.end - size
        else:
            edge = word_edges(raw)
            self.begin, self.end = edge[::2], edge[1::2]
        if len(raw) > len(text):
            at = _code_points(raw)
            self.begin, self.end = at[self.begin], at[self.end]
        self.shared: tuple = (None,)

    def shared_with(self, other: _Words, words: int) -> tuple[np.ndarray, ...]:
        """Where k-mers are that ``other`` has, too; from and to which number they are in its k-mers by their order, which
        is the fourth, and the last is that order's key, to find a place near another by."""
        if self.shared[0] is not other:
            kx, ky = (windows(t.h.view(np.uint64), words) for t in (self, other))
            order = np.argsort(ky, kind="stable")
            sorted_ = ky[order]
            low = np.searchsorted(sorted_, kx)
            i = np.flatnonzero(sorted_[np.minimum(low, len(sorted_) - 1)] == kx) if len(sorted_) else low[:0]
            group = np.cumsum(np.diff(sorted_, prepend=sorted_[:1]) != 0)
            self.shared = other, i, low[i], np.searchsorted(sorted_, kx[i], "right"), order, group << 32 | order
        return self.shared[1:]


def aligned(x: _Words, y: _Words, i: np.ndarray, j: np.ndarray, words: int = WORDS) -> list[tuple[int, int, int, int, int, int]]:
    """Passages along a chain of seeds at words ``i`` of ``x`` and ``j`` of ``y``: start and end in both, words and
    matches."""
    hx, hy = x.h, y.h
    lx, ly = x.list, y.list
    bx, by = hx[::-1], hy[::-1]
    di, dj = np.diff(i), np.diff(j)
    out = []

    def gaps(p: int, q: int) -> int:
        """Matches from seed ``p`` to the end of seed ``q``."""
        if i[q] - i[p] == j[q] - j[p] and (hx[i[p] : i[q]] == hy[j[p] : j[q]]).all():
            return int(i[q] - i[p]) + words
        x, y = di[p:q], dj[p:q]
        plain = (x == y) & (x <= words)  # words of the first seed
        return int(x[plain].sum()) + sum(_common(lx[i[k] : i[k + 1]], ly[j[k] : j[k + 1]]) for k in (np.flatnonzero(~plain) + p).tolist()) + words

    todo = [(0, len(i) - 1)]
    while todo:
        p, q = todo.pop()
        same = gaps(p, q)
        r, s, more = _extend(hx, hy, lx, ly, int(i[q]) + words, int(j[q]) + words)
        t, u, less = _extend(bx, by, x.back, y.back, len(lx) - int(i[p]), len(ly) - int(j[p]))
        if 100 * (same + more + less) < PERCENT * max(i[q] - i[p] + words + r + t, j[q] - j[p] + words + s + u):
            r = s = more = t = u = less = 0
        i0, i1, j0, j1 = i[p] - t, i[q] + words + r, j[p] - u, j[q] + words + s
        same += more + less
        if 100 * same >= PERCENT * max(i1 - i0, j1 - j0):
            if i1 - i0 >= LEAST:
                out.append((int(x.begin[i0]), int(x.end[i1 - 1]), int(y.begin[j0]), int(y.end[j1 - 1]), int(i1 - i0), int(same)))
        elif q > p:
            wide = np.maximum(di[p:q], dj[p:q])
            k = p + int(wide.argmax())
            todo += [(p, k), (k + 1, q)]
    return out


def every_match(x: _Words, y: _Words, at: np.ndarray, to: np.ndarray, words: int = WORDS, near: int | None = None, own: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """All k-mers of ``x`` that ``y`` has, not only seeds, or those within ``near`` characters of the matches ``at`` and
    ``to``: where they are in both, in ``y`` the place that is nearest to the line through the matches, of one's
    ``own`` text one that is a passage's length before. Of long runs each fourth is kept, and the ends."""
    i, low, high, order, by = x.shared_with(y, words)
    if near is not None:
        a, b = np.searchsorted(i, np.searchsorted(x.begin, (x.begin[at[0]] - near, x.begin[at[-1]] + near)))
        i, low, high = i[a:b], low[a:b], high[a:b]
    if own:
        high = np.searchsorted(by, (by[low] >> 32 << 32) + np.maximum(0, i - LEAST + 1)) if len(i) else high
        i, low, high = i[high > low], low[high > low], high[high > low]
    if not len(i):
        return i, i
    line = np.interp(i, at, to) + np.minimum(i - at[0], 0) + np.maximum(i - at[-1], 0)
    after = np.searchsorted(by, (by[low] >> 32 << 32) + np.maximum(0, np.ceil(line)).astype(np.int64))
    j, before = order[np.minimum(after, high - 1)], order[np.maximum(after - 1, low)]
    j = np.where(np.abs(before - line) <= np.abs(j - line), before, j)
    if near is not None:
        some = (y.begin[j] >= y.begin[to[0]] - near) & (y.begin[j] < y.begin[to[-1]] + near)
        i, j = i[some], j[some]
    follows = (np.diff(i) == 1) & (np.diff(j) == 1)
    inner = np.append(False, follows) & np.append(follows, False) & (i % 4 > 0)
    return i[~inner], j[~inner]


def passages(a: str | _Words, b: str | _Words, d: np.ndarray, h: np.ndarray, words: int = WORDS, near: int | None = None, own: bool = False) -> list[tuple[int, int, int, int, int, int]]:
    """Passages about a chain of seeds at characters ``d`` and ``h``, as ``aligned`` gives them; where one alone doesn't
    cover the chain, and where the chain is short, all k-mers that both texts have are chained anew, or those within
    ``near`` characters of the chain. Where both are one's ``own`` text, nothing is a passage of what is at its place."""
    x, y = (_Words(t) if isinstance(t, str) else t for t in (a, b))
    i, j = np.searchsorted(x.begin, d), np.searchsorted(y.begin, h)
    out = aligned(x, y, i, j, words)
    if not any(s <= d[0] and e > d[-1] for s, e, *_ in out):
        i, j = every_match(x, y, i, j, words, near, own)
        for path in chains(i, j) if len(i) else []:
            if i[path[-1]] - i[path[0]] + words >= SHORT:
                out += aligned(x, y, i[path], j[path], words)
    return sorted({o for o in out if not own or o[0] > o[2]})


def _surely(d: np.ndarray, h: np.ndarray, words: int) -> bool:
    """Whether a chain's seeds alone (``d``, ``h`` in words) make it a passage."""
    if d[-1] - d[0] + words < LEAST:
        return False
    x, y = np.diff(d), np.diff(h)
    same = words + np.where((x == y) & (x <= words), x, np.minimum(words, np.minimum(x, y))).sum()
    span = max(d[-1] - d[0], h[-1] - h[0]) + words
    return bool(100 * same >= PERCENT * span)


def _document_chains(doc: int, other: np.ndarray, at: np.ndarray, other_at: np.ndarray, proof: np.ndarray, every: np.ndarray, words: int, few: int = FEW_WORDS) -> tuple[list[tuple[int, np.ndarray, np.ndarray]], np.ndarray]:
    """Chains of one document's matches, sorted by ``other``, ``at`` and ``other_at``: the other document and the seeds'
    characters in both. One that lies within another that is a passage by its seeds alone, or by a long window's proof,
    is left out. Beside them the words, from and to, that are such passages. ``every`` are the words, in order, of all that
    earlier documents have of it, which may be more than its matches."""
    word, other_word = at & 0xFFFFFFFF, other_at & 0xFFFFFFFF
    found = []
    held: list[tuple[int, int]] = []
    cut = np.append(np.flatnonzero(np.diff(other, prepend=other[:1] ^ 1)), len(other)).tolist()
    for a, b in zip(cut[:-1], cut[1:]):
        new = np.arange(a, b)
        some = proof[a:b].astype(np.int64)
        same = (at[a + 1 : b] == at[a : b - 1]) & (other_at[a + 1 : b] == other_at[a : b - 1])
        if same.any():
            new = a + np.flatnonzero(np.append(True, ~same))
            some = np.maximum.reduceat(some, new - a)
        if other[a] == doc:  # apart by the length of a passage, or else a few words are repeated over and over
            far = word[new] - other_word[new] >= LEAST
            new, some = new[far], some[far]
            if not len(new):
                continue
        d, h = word[new], other_word[new]
        proven = bool(some.any())
        places = d.tolist()
        for path in chains(d, h):
            first, last, w = places[path[0]], places[path[-1]] + words, some[:0]
            if proven:
                w = some[path]
                w = w if w.any() else w[:0]
            if len(w):
                x = d[path][w > 0]
                held += zip((x - ((w[w > 0] - 1) >> 8)).tolist(), (x + HALF + ((w[w > 0] - 1) & 255)).tolist())
                first, last = min(first, int((x - ((w[w > 0] - 1) >> 8)).min())), max(last, int((x + HALF + ((w[w > 0] - 1) & 255)).max()))
            elif len(path) < 2 or last - first < SHORT:
                continue
            elif last - first < few:
                low, end = np.searchsorted(every, (first - LEAST + 1, last))
                if (low == len(every) or every[low] >= first) and (end == len(every) or every[end] >= last + LEAST):
                    continue  # a line that others have, with nothing that any earlier document has on either side
            whole = _surely(d[path], h[path], words)
            found.append((not whole and not len(w), first - last, int(other[a]), first, last, whole or len(path) == 1, new[path]))
    found.sort(key=lambda f: f[:4])
    out = []
    sure = np.zeros((0, 2), np.int64)
    for _, _, to, first, last, whole, path in found:
        if len(sure) and ((sure[:, 0] <= first) & (sure[:, 1] >= last)).any():
            continue
        if whole:
            sure = np.concatenate([sure, [[first, last]]])
        out.append((to, (at[path] >> 32).astype(np.int32), (other_at[path] >> 32).astype(np.int32)))
    return out, np.concatenate([sure, np.array(held, np.int64).reshape(-1, 2)])


def _chained(doc: np.ndarray, other: np.ndarray, at: np.ndarray, other_at: np.ndarray, proof: np.ndarray, words: int, few: int = FEW_WORDS) -> Iterator[tuple[int, list[tuple], np.ndarray]]:
    """Documents with their chains: for each other document those of all seeds' characters in both; and the words, from and
    to, that are passages for sure. Matches are in any order."""
    order = np.lexsort((other_at, at, other, doc))
    doc, other, at, other_at, proof = (x[order] for x in (doc, other, at, other_at, proof))
    word = at & 0xFFFFFFFF
    first = np.flatnonzero((np.diff(doc, prepend=doc[:1] ^ 1) != 0) | (np.diff(other, prepend=other[:1] ^ 1) != 0))
    n = np.diff(np.append(first, len(doc)))
    far = (n > 1) & (word[first + n - 1] - word[first] + words >= SHORT)
    if len(first):
        far |= np.maximum.reduceat(proof, first) > 0
    far = np.repeat(far, n)
    cut = np.append(np.flatnonzero(np.diff(doc, prepend=doc[:1] ^ 1)), len(doc))
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
        some = a + np.flatnonzero(far[a:b])
        if not len(some):
            continue
        every = np.sort(word[a:b])
        found, sure = _document_chains(int(doc[a]), other[some], at[some], other_at[some], proof[some], every, words, few)
        pairs: dict[int, list] = {}
        for to, d, h in found:
            pairs.setdefault(to, []).append((d, h))
        yield int(doc[a]), [(to, [d for d, _ in p], [h for _, h in p]) for to, p in pairs.items()], sure


def _unknown(at: np.ndarray, key: np.ndarray, sure: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and keys of one document's shared seeds, those that lie within passages that are known left out."""
    at, some = np.unique(at, return_index=True)
    key, word = key[some], at & 0xFFFFFFFF
    if len(sure):
        sure = sure[np.argsort(sure[:, 0], kind="stable")]
        reach = np.append(0, np.maximum.accumulate(sure[:, 1]))[np.searchsorted(sure[:, 0], word, "right")]
        at, key = at[reach < word + words], key[reach < word + words]
    return at, key


def _followed(at: np.ndarray, last: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """For chains that end at the places ``last``, which of the seeds at ``at`` may follow: so far on that two span SHORT
    words, and no more than a gap beyond. The first of them, and how many."""
    word, end = at & 0xFFFFFFFF, last & 0xFFFFFFFF
    low = np.searchsorted(word, end + SHORT - words)
    return low, np.searchsorted(word, end + SHORT - words + GAP, "right") - low


def _apart(so_far: np.ndarray, paths: np.ndarray) -> np.ndarray:
    """Of chains of equal hashes and ends, which a document of repeated lines has by the thousand, the first and the last
    path: numbers, sorted by hash and path."""
    order = np.lexsort((*paths.T[::-1], paths[:, -1], so_far))
    k, end = so_far[order], paths[order, -1]
    new = (np.diff(k, prepend=k[:1] ^ 1) != 0) | (np.diff(end, prepend=end[:1]) != 0)
    order = order[new | np.append(new[1:], True)]
    return order[np.lexsort((*paths[order].T[::-1], so_far[order]))]


def _lengthened(at: np.ndarray, key: np.ndarray, so_far: np.ndarray, paths: np.ndarray, shared: np.ndarray | None, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Chains of one document (hashes and paths), lengthened by every one of its seeds (``at``, ``key``) that may follow.
    Where ``shared`` are given, hashes of two seeds that many documents share, a chain holds no other two but such that
    are too far apart for a chain of two: documents that share those have met."""
    low, n = _followed(at, paths[:, -1], words)
    found = [(np.zeros(0, np.int64), np.zeros((0, paths.shape[1] + 1), np.int64))]
    total, a = np.cumsum(n), 0
    if not len(n) or not total[-1]:
        return found[0]
    while a < len(n):
        b = max(a + 1, int(np.searchsorted(total, total[a] - n[a] + (1 << 18), "right")))
        i = np.repeat(np.arange(a, b), n[a:b])
        j = np.arange(len(i)) - np.repeat(total[a:b] - n[a:b] - (total[a] - n[a]), n[a:b]) + np.repeat(low[a:b], n[a:b])
        for c in range(paths.shape[1] if shared is not None else 0):
            own = key[np.searchsorted(at, paths[i, c])].view(np.uint64)
            two = mix(own * np.uint64(0x9E3779B97F4A7C15) + key[j].view(np.uint64)).view(np.int64)
            far = (at[j] & 0xFFFFFFFF) - (paths[i, c] & 0xFFFFFFFF) >= SHORT - words + GAP
            some = far | np.isin(two, shared)
            i, j = i[some], j[some]
        new = mix(so_far[i].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + key[j].view(np.uint64)).view(np.int64)
        longer = np.column_stack([paths[i], at[j]])
        some = _apart(new, longer)
        found.append((new[some], longer[some]))
        a = b
    new, longer = (np.concatenate(c) for c in zip(*found))
    some = _apart(new, longer)
    return new[some], longer[some]


def shared_seeds(seeds: DataFrame, buckets: int) -> DataFrame:
    """``doc_id``, ``at``, ``key``: of each document all seeds, in order, that other documents have, too; from packed rows
    (``at``, ``x``: keys) that are dealt out by their keys."""

    @lean
    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, ["bucket"]):
            for some in _buckets(t):
                doc, at, key = _read(some, "at", "x")
                order = np.lexsort((doc, key))
                first = np.flatnonzero(np.diff(key[order], prepend=key[order[:1]] ^ 1))
                n = np.diff(np.append(first, len(order)))
                order = order[np.repeat(doc[order[first]] < doc[order[first + n - 1]], n)]
                if len(order):
                    doc, at, key = doc[order], at[order], key[order]
                    yield from _dealt(_class(doc, buckets), doc, [at, key])

    @lean
    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, ["bucket"]):
            for some in _buckets(t):
                doc, at, key = _read(some, "at", "x")
                order = np.lexsort((key, at, doc))
                doc, at, key = doc[order], at[order], key[order]
                first = np.flatnonzero(np.diff(doc, prepend=doc[:1] ^ 1))
                ends = pa.array(np.append(first, len(doc)).astype(np.int32))
                yield pa.record_batch([pa.array(doc[first]), *(pa.ListArray.from_arrays(ends, pa.array(c)) for c in (at, key))], names=["doc_id", "at", "key"])

    both = seeds.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(shared, _PACKED)
    return both.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(gather, "doc_id long, at array<long>, key array<long>")


def everywhere(at: np.ndarray, key: np.ndarray, other: np.ndarray, place: np.ndarray, other_at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For seeds at ``place`` that are in ``other`` documents at ``other_at``: all places (``at``) of the same seed (``key``)."""
    match = np.unique(np.column_stack([other, key[np.searchsorted(at, place)], other_at]), axis=0)
    order = np.argsort(key, kind="stable")
    low = np.searchsorted(key[order], match[:, 1])
    n = np.searchsorted(key[order], match[:, 1], "right") - low
    i = np.repeat(np.arange(len(n)), n)
    return match[i, 0], at[order[np.arange(len(i)) - np.repeat(np.cumsum(n) - n - low, n)]], match[i, 2]


def other_holders(own: DataFrame, words: int = WORDS) -> DataFrame:
    """``doc_id``, ``at``, ``key``, ``met``: of ``shared_seeds`` (written) those documents that share chains of seeds with
    earlier ones, and where such seeds are in the earlier document's first chain of that kind (``other_id``, ``at``,
    ``other_at``). ``everywhere`` tells all places of such a seed.

    Chains of two seeds are looked up first. Where TOGETHER documents or fewer have the same, each meets every earlier one;
    where more have it, as two common lines, each is linked with the first and all chains are lengthened by every seed
    that more than TOGETHER share with what there is, until few share them or they are LEAST words long. So two documents
    that share a chain meet, or both meet the first that has the same chain of a passage's length, and the work grows
    with the documents rather than their pairs. What a document has of one chain is one row, however often it is repeated.
    """
    schema = "key long, doc_id long, paths array<long>, least int, most int"

    @lean
    def grown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                at, key = (b.column(c)[r].values.to_numpy() for c in (1, 2))
                if b.num_columns == 3:
                    new, paths = _lengthened(at, key, key, at[:, None], None, words)
                else:
                    so_far, shared = (b.column(c)[r].values.to_numpy() for c in (3, 5))
                    lists = b.column(4)[r].values
                    n = lists.value_lengths().to_numpy()
                    paths = lists.flatten().to_numpy().reshape(-1, width)
                    so_far = np.repeat(so_far, n // width)
                    some = (paths[:, -1] & 0xFFFFFFFF) - (paths[:, 0] & 0xFFFFFFFF) + words < LEAST
                    new, paths = _lengthened(at, key, so_far[some], paths[some], shared, words)
                if not len(new):
                    continue
                span = ((paths[:, -1] & 0xFFFFFFFF) - (paths[:, 0] & 0xFFFFFFFF) + words).astype(np.int32)
                first = np.flatnonzero(np.diff(new, prepend=new[:1] ^ 1))
                ends = np.append(first, len(new)) * paths.shape[1]
                least, most = np.minimum.reduceat(span, first), np.maximum.reduceat(span, first)
                for k in range(0, len(first), 1 << 14):
                    some = slice(k, k + (1 << 14))
                    n = len(first[some])
                    offsets = ends[k : k + n + 1]
                    lists = pa.ListArray.from_arrays(pa.array((offsets - offsets[0]).astype(np.int32)), pa.array(paths.ravel()[offsets[0] : offsets[-1]]))
                    yield pa.record_batch([pa.array(new[first[some]]), pa.array(np.full(n, b.column(0)[r].as_py())), lists, pa.array(least[some]), pa.array(most[some])], names=["key", "doc_id", "paths", "least", "most"])

    width, out, pairs = 2, None, None
    level = written(own.mapInArrow(grown, schema))
    while True:
        path = F.slice("paths", 1, width)  # of a document's places of one chain the first is met by others
        groups = level.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", path.alias("path"))).alias("first")).where("n > 1")
        known = written(level.join(groups.hint("merge"), "key"))
        discard(level)
        few = known.where(F.col("n") <= TOGETHER).select("key", "doc_id", path.alias("path"))
        every = few.join(few.select("key", F.col("doc_id").alias("other_id"), F.col("path").alias("other_path")).hint("merge"), "key").where("other_id < doc_id").select("doc_id", "other_id", "path", "other_path")
        first = known.where((F.col("n") > TOGETHER) & (F.col("most") >= FEW_WORDS) & (F.col("first.doc_id") < F.col("doc_id"))).select("doc_id", F.col("first.doc_id").alias("other_id"), path.alias("path"), F.col("first.path").alias("other_path"))
        met = every.union(first).select("doc_id", "other_id", F.explode(F.arrays_zip("path", "other_path")).alias("s")).select("doc_id", "other_id", F.col("s.path").alias("at"), F.col("s.other_path").alias("other_at")).distinct()
        out = written(met) if out is None else out.union(written(met))
        many = known.where(F.col("n") > TOGETHER)
        if not many.where(F.col("least") < LEAST).limit(1).count():
            break
        chains_ = many.where(F.col("least") < LEAST).groupBy("doc_id").agg(F.collect_list(F.struct("key", "paths")).alias("c")).select("doc_id", F.col("c.key").alias("so_far"), F.col("c.paths").alias("paths"))
        if pairs is None:
            pairs = written(many.groupBy("doc_id").agg(F.collect_list("key").alias("shared")))
        level = written(own.join(chains_, "doc_id").join(pairs, "doc_id").select("doc_id", "at", "key", "so_far", "paths", "shared").mapInArrow(grown, schema))
        discard(known)
        width += 1
    met = out.groupBy("doc_id").agg(F.collect_list(F.struct("other_id", "at", "other_at")).alias("met"))
    return own.join(met, "doc_id").select("doc_id", "at", "key", "met")


def repeated_passages(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """Passages of 50 words or more that a document shares with an earlier one, or with an earlier place of its own that
    is 50 words away or more, at least 75 % of the words in order.

    Returns ``doc_id``, ``start``, ``end`` (characters), ``other_id``, ``other_start``, ``other_end``, ``n_words`` and
    ``n_same``. ``other_id`` is one of the documents with a smaller id, or the same id, that hold the passage: each repeat
    is linked with an earlier holder rather than with every one, and what has none is never listed. Every run of 50 words
    that an earlier document holds lies in a passage, wherever its parts occur first; seeds that lie in no passage for
    sure then meet all earlier documents that share two of them or more (``other_holders``). A passage within a longer one
    of the same document is left out; others may overlap. Null and empty texts and null ids hold no passages; rows that
    repeat an id count once, with the least text; extra columns are ignored; an empty table gives an empty result.
    """
    docs = one_each(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and text is not null"))
    texts_, buckets = docs, classes(docs)
    matches = seed_matches(docs, buckets, words)

    # ``chains``: sizes and characters of a pair's chains; ``d``, ``h``: from the first to the last character in both.
    plain = pa.schema([*((c, pa.int64()) for c in ("doc_id", "other_id")), ("chains", pa.binary()), *((c, pa.int32()) for c in ("d", "d_last", "h", "h_last"))])
    schema = "doc_id long, other_id long, chains binary, d int, d_last int, h int, h_last int"
    full = pa.schema([*plain, ("n", pa.int64()), ("at", pa.binary()), ("key", pa.binary())])

    def pair(doc: int, other: int, d: list[np.ndarray], h: list[np.ndarray]) -> tuple:
        packed = np.concatenate([np.array([len(d), *map(len, d)], np.int32), *d, *h]).astype("<i4").tobytes()
        sides = (d + h, d + h) if doc == other else (d, h)  # one's own passages are told from what is at their place
        return doc, other, packed, *(x for c in sides for x in (min(int(t[0]) for t in c), max(int(t[-1]) for t in c)))

    @lean
    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Chains, a row for each pair of documents; and, with a null ``other_id``, a document's shared seeds outside the
        passages that are known."""
        for t in runs(batches, ["bucket"]):
            for some in _buckets(t):
                doc, other, at, other_at, key, proof = matched(some)
                out: list[tuple] = []
                linked = np.flatnonzero((other != doc) | (at != other_at))
                known = {}
                for own, pairs, sure in _chained(doc[linked], other[linked], at[linked], other_at[linked], proof[linked], words):
                    out += [(*pair(own, *p), None, None, None) for p in pairs]
                    known[own] = sure
                del other, other_at, proof, linked
                short = np.flatnonzero(key)
                short = short[np.argsort(doc[short], kind="stable")]
                doc, at, key = doc[short], at[short], key[short]
                cut = np.append(np.flatnonzero(np.diff(doc, prepend=doc[:1] ^ 1)), len(doc)).tolist()
                for a, b in zip(cut[:-1], cut[1:]):
                    seeds = _unknown(at[a:b], key[a:b], known.get(int(doc[a]), ()), words)
                    if len(seeds[0]):
                        out.append((int(doc[a]), *[None] * 6, len(seeds[0]), *map(_packed, seeds)))
                del doc, at, key
                for k in range(0, len(out), 1024):
                    yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out[k : k + 1024]), full)], schema=full)

    @lean
    def chain_others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in range(b.num_rows):
                met = b.column(3)[r].values
                seeds = [b.column(c)[r].values.to_numpy() for c in (1, 2)]
                other, at, other_at = everywhere(*seeds, *(met.field(c).to_numpy() for c in range(3)))
                doc = np.full(len(at), b.column(0)[r].as_py())
                out += [pair(own, *p) for own, pairs, _ in _chained(doc, other, at, other_at, np.zeros(len(doc), np.int32), words, few=SHORT) for p in pairs]
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out) if out else [()] * len(plain), plain)], schema=plain)

    # A document's matches are bounded by its seeds and long windows.
    every = written(matches.mapInArrow(chain, f"{schema}, n long, at binary, key binary"))
    found = every.where("other_id is not null").select(*plain.names)

    def part(text: str, at: str, margin: int | None) -> list:
        """What lies from ``margin`` before a pair's first chain to as much after its last: its place, text, and whether
        it begins and ends with the document."""
        if margin is None:
            return [F.lit(0), F.col(text), F.lit(True), F.lit(True)]
        begin = F.greatest(F.lit(0), F.col(at) - margin)
        length = F.col(f"{at}_last") - begin + margin
        return [begin, F.substring(F.col(text), begin + 1, length), begin == 0, begin + length >= F.length(text)]

    def texts_of(chains_: DataFrame, margin: int | None) -> DataFrame:
        names = ["da", "a", "a_begins", "a_ends"]
        # Only the texts that chains lie in are shuffled, while these are few.
        docs, other = (of_ids(texts_, written(chains_.select(F.col(c).alias("doc_id")).distinct())) for c in ("doc_id", "other_id"))
        mine = chains_.join(docs, "doc_id").select(*chains_.columns, *[c.alias(n) for c, n in zip(part("text", "d", margin), names)])
        return mine.join(other.withColumnRenamed("doc_id", "other_id"), "other_id").select(*mine.columns, *[c.alias(n.replace("a", "b", 1) if n != "da" else "ha") for c, n in zip(part("text", "h", margin), names)])

    @lean
    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "start", "end", "other_id", "other_start", "other_end", "n_words", "n_same"]
        given = pa.schema([*((c, pa.int64()) for c in names), *list(plain)[2:]])
        known: dict[str, _Words] = {}
        size = 0
        for b in batches:
            rows: list[tuple] = []
            col = dict(zip(b.schema.names, b.columns))
            for i in range(b.num_rows):
                doc, other, da, ha, text, other_text = (col[c][i].as_py() for c in ("doc_id", "other_id", "da", "ha", "a", "b"))
                begins, ends, other_begins, other_ends = (col[c][i].as_py() for c in ("a_begins", "a_ends", "b_begins", "b_ends"))
                for x in (text, other_text):  # pairs of the same texts follow one another
                    if x not in known:
                        size += len(x)
                        if size > MEMORY:
                            known, size = {k: v for k, v in known.items() if k == text}, len(text) + len(x)
                        known[x] = _Words(x)
                x, y = known[text], known[other_text]
                last, other_last = len(text.rstrip()), len(other_text.rstrip())
                whole = begins and ends and other_begins and other_ends
                some: set[tuple] = set()
                wider: list[tuple] = []
                flat = np.frombuffer(col["chains"][i].as_py(), "<i4")
                n, cut = int(flat[0]), np.cumsum(flat[1 : flat[0] + 1])
                flat = flat[n + 1 :].reshape(2, -1)
                for d, h in zip(*(np.split(f, cut[:-1]) for f in flat)):
                    beyond = False
                    for s, e, os, oe, n, same in passages(x, y, d - da, h - ha, words, None if whole else MARGIN, doc == other):
                        # Words cut in two at a part's ends don't match: a passage that comes close to them may go on.
                        beyond |= (not begins and s < MARGIN // 2) or (not other_begins and os < MARGIN // 2)
                        beyond |= (not ends and e > last - MARGIN // 2) or (not other_ends and oe > other_last - MARGIN // 2)
                        some.add((doc, s + da, e + da, other, os + ha, oe + ha, n, same, *[None] * 5))
                    if beyond:
                        wider.append((d, h))
                if wider:
                    _, _, *again = pair(doc, other, [d for d, _ in wider], [h for _, h in wider])
                    rows.append((doc, None, None, other, *[None] * 4, *again))
                rows += some
            columns = list(zip(*rows)) if rows else [()] * len(given)
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, given)], schema=given)

    aligned_as = "doc_id long, start long, end long, other_id long, other_start long, other_end long, n_words long, n_same long, chains binary, d int, d_last int, h int, h_last int"

    def tried(chains_: DataFrame) -> DataFrame:
        first = written(texts_of(chains_, MARGIN).mapInArrow(align, aligned_as))
        # Whole texts go once with all chains of a pair.
        whole = texts_of(first.where("chains is not null").select(*plain.names), None).mapInArrow(align, aligned_as)
        return written(first.where("chains is null").union(whole).drop(*plain.names[2:]).distinct())

    @lean
    def unknown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i in range(b.num_rows):
                n, start, end = b.column(1)[i].as_py(), b.column(4)[i].values, b.column(5)[i].values
                at, key = (_unpacked(b.column(c)[i].as_py(), n) for c in (2, 3))
                if start is not None:
                    order = np.argsort(start.to_numpy(), kind="stable")
                    reach = np.append(-1, np.maximum.accumulate(end.to_numpy()[order]))
                    left = reach[np.searchsorted(start.to_numpy()[order], at >> 32, "right")] <= at >> 32
                    at, key = at[left], key[left]
                rows.append((np.full(len(at), b.column(0)[i].as_py()), at, key))
            if rows:
                doc, at, key = (np.concatenate(c) for c in zip(*rows))
                yield from _dealt(_class(key, buckets), doc, [at, key])

    one = tried(found)
    # Seeds within passages that are found have their holder; all others meet whoever else shares them.
    spans = one.groupBy("doc_id").agg(F.collect_set(F.struct("start", "end")).alias("p")).select("doc_id", F.col("p.start").alias("start"), F.col("p.end").alias("end"))
    left = every.where("other_id is null").select("doc_id", "n", "at", "key").join(spans, "doc_id", "left")
    own = written(shared_seeds(left.mapInArrow(unknown, _PACKED), buckets))
    discard(every)
    others = written(other_holders(own, words).mapInArrow(chain_others, schema))
    out = one.union(tried(others)).distinct()
    # Of a document's passages, by their starts, those that end no later than one before lie within it.
    before = Window.partitionBy("doc_id").orderBy("start", F.desc("end"), F.desc("n_same"), "n_words", "other_id", "other_start", "other_end").rowsBetween(Window.unboundedPreceding, -1)
    return out.withColumn("_reach", F.max("end").over(before)).where("_reach is null or _reach < end").drop("_reach")


def without_repeats(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """``docs`` with repeated passages cut from all but their first occurrence; columns and rows stay as they are.

    ``n_chars``, where there is such a column, becomes the length of the new text. Documents with no repeats, null
    texts and null ids are unchanged, and so are rows that repeat an id with another text than the least.
    """
    spans = repeated_passages(docs, words).groupBy("doc_id").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("_spans"))
    own = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    repeated = own.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    least = own.join(repeated, "doc_id").groupBy("doc_id").agg(F.sha2(F.min("text"), 256).alias("_least"))
    spans = spans.join(least, "doc_id", "left")

    def cut(text: pa.Array, spans: pa.Array) -> list[str | None]:
        out = []
        for t, s in zip(text.to_pylist(), spans.to_pylist()):
            if s and t is not None:
                kept, at = [], 0
                for x in s:
                    if x["start"] > at:
                        kept.append(t[at : x["start"]])
                    at = max(at, x["end"])
                t = "".join([*kept, t[at:]])
            out.append(t)
        return out

    names = docs.columns
    place = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = list(b.columns[:-1])
            columns[place] = pa.array(cut(columns[place], b.columns[-1]), columns[place].type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    both = docs.join(spans.withColumnRenamed("doc_id", "_doc"), F.col("doc_id") == F.col("_doc"), "left").select(*[docs[c] for c in names], F.when(F.col("_least").isNull() | (F.col("_least") == F.sha2("text", 256)), F.col("_spans")).alias("_spans"))
    out = both.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else out
