"""Cross-tokenizer alignment: how the tokens of two tokenizers share the bytes of a text.

Byte offsets where a token of each ends cut a text into groups. A byte range of a text is a fragment: an open prefix, closed
groups and an open suffix. Fragments compose associatively, so the parts of a very long document are aligned in different
tasks and put together by a tree.
"""

from __future__ import annotations

import functools
import itertools
import json
import os
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm._common import discard, runs, written

#: Characters of a part of a long text, and fragments that a step of the tree composes, about.
CHUNK, FAN = 1 << 16, 16
#: Texts that are aligned together.
LOT = 64
#: Pairs of ids that are broadcast together; beyond that only those in a share of 1 / HEAVY of all rows are, which are HEAVY at most.
PAIRS, HEAVY = 4_000_000, 100_000


@dataclass(frozen=True)
class Fragment:
    """Tokens of A and B that end within a byte range; ids stand in decimal, joined by commas.

    ``closed`` counts the offsets in the range where both end. The prefix runs to the first of them, or holds all where there is
    none; groups between stand in ``body``, joined by semicolons; the suffix is what follows the last.
    """

    n_a: int = 0
    n_b: int = 0
    closed: int = 0
    prefix_a: str = ""
    prefix_b: str = ""
    body: str = ""
    suffix_a: str = ""
    suffix_b: str = ""
    fine: bool = True
    pairs: dict[int, int] = field(default_factory=dict)

    def then(self, other: Fragment) -> Fragment:
        """This fragment followed by the next of the same text."""
        n_a, n_b, closed, fine = self.n_a + other.n_a, self.n_b + other.n_b, self.closed + other.closed, self.fine and other.fine
        pairs = dict(Counter(self.pairs) + Counter(other.pairs)) if self.pairs and other.pairs else self.pairs or other.pairs
        if not self.closed:
            a, b = _joined(self.prefix_a, other.prefix_a), _joined(self.prefix_b, other.prefix_b)
            return Fragment(n_a, n_b, closed, a, b, other.body, other.suffix_a, other.suffix_b, fine, pairs)
        a, b = _joined(self.suffix_a, other.prefix_a), _joined(self.suffix_b, other.prefix_b)
        if not other.closed:
            return Fragment(n_a, n_b, closed, self.prefix_a, self.prefix_b, self.body, a, b, fine, pairs)
        body = ";".join(x for x in (self.body, f"{a}|{b}", other.body) if x)
        return Fragment(n_a, n_b, closed, self.prefix_a, self.prefix_b, body, other.suffix_a, other.suffix_b, fine, pairs)

    @property
    def groups(self) -> str:
        """All groups of a whole text, whose end is an end of both tokenizers."""
        return ";".join(x for x in (f"{self.prefix_a}|{self.prefix_b}", self.body) if x) if self.closed else ""


def _joined(a: str, b: str) -> str:
    return f"{a},{b}" if a and b else a or b


def fragments(a: Sequence[int], b: Sequence[int], size_a: Sequence[int] | np.ndarray, size_b: Sequence[int] | np.ndarray, step: int) -> Iterator[tuple[int, Fragment]]:
    """The fragments of byte ranges of ``step`` bytes, with their first bytes: tokens ``a`` and ``b`` of one text, whose lengths
    in bytes are ``size_a[id]`` and ``size_b[id]``. A token belongs to the range that its last byte lies in."""
    i = j = end_a = end_b = 0
    start = 0
    while i < len(a) or j < len(b):
        stop, closed, n_a, n_b = start + step, 0, i, j
        done: list[str] = []
        ids_a: list[str] = []
        ids_b: list[str] = []
        pairs: dict[int, int] = {}
        while True:
            next_a = end_a + size_a[a[i]] if i < len(a) else None
            next_b = end_b + size_b[b[j]] if j < len(b) else None
            first = min(x for x in (next_a, next_b, stop + 1) if x is not None)
            if first > stop:
                break
            if next_a == first:
                ids_a.append(str(a[i]))
                end_a, i = next_a, i + 1
            if next_b == first:
                ids_b.append(str(b[j]))
                end_b, j = next_b, j + 1
            if next_a == next_b:
                key = a[i - 1] << 32 | b[j - 1]
                pairs[key] = pairs.get(key, 0) + 1
                closed += 1
                done.append(f"{','.join(ids_a)}|{','.join(ids_b)}")
                ids_a, ids_b = [], []
        rest_a, rest_b = ",".join(ids_a), ",".join(ids_b)
        if closed:
            prefix_a, _, prefix_b = done[0].partition("|")
            yield start, Fragment(i - n_a, j - n_b, closed, prefix_a, prefix_b, ";".join(done[1:]), rest_a, rest_b, True, pairs)
        elif i > n_a or j > n_b:
            yield start, Fragment(i - n_a, j - n_b, 0, rest_a, rest_b)
        start = stop


#: Besides white space, characters that some definitions of it count.
_BLANK = "\u180e\u200b\ufeff"


def segments(text: str) -> list[str]:
    """A text cut before each space that stands between two characters which aren't white space; the space is left out.

    A token of either tokenizer can begin with a space, but none holds one after another character, so tokens of both end there
    and the sides can be encoded one by one. ``Pair`` checks that of B's pieces; A's pre-splitting pattern says it.
    """
    parts = text.split(" ")
    if all(parts) and text.isprintable():
        return parts  # printable text holds no white space but the space, and none of _BLANK
    out = [parts[0]]
    for p in parts[1:]:
        held = out[-1]
        if p and held and not held[-1].isspace() and not p[0].isspace() and held[-1] not in _BLANK and p[0] not in _BLANK:
            out.append(p)
        else:
            out[-1] = f"{held} {p}"
    return out


def cut(text: str, size: int) -> Iterator[str]:
    """A text in parts of about ``size`` characters that end where segments do; a longer segment stays whole."""
    held, n = [], 0
    for s in segments(text):
        if held and n + len(s) > size:
            yield " ".join(held)
            held, n = [], 0
        held.append(s)
        n += len(s) + 1
    yield " ".join(held)


#: The byte-level pattern that such files stand for: a fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Runs too long for the faster encoder, whose work on one grows with its square.
_RUN = re.compile(r"\s{500}|\S{500}")


class Pair:
    """A byte-level BPE file (A) and a sentencepiece model (B), with the bytes of their tokens."""

    def __init__(self, path_a: str, path_b: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        rules = json.loads(self.a.to_str())
        if rules["normalizer"] is not None or rules["pre_tokenizer"].get("type") != "ByteLevel" or not rules["pre_tokenizer"].get("use_regex"):
            raise ValueError(f"{path_a}: not split before spaces by the byte-level pattern")
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(c): c for c in visible} | {chr(256 + n): c for n, c in enumerate(x for x in range(256) if x not in set(visible))}
        self.bytes_a = [b""] * self.a.get_vocab_size()
        for token, i in self.a.get_vocab(with_added_tokens=False).items():
            self.bytes_a[i] = bytes(byte[c] for c in token)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else b"" if self.b.is_control(i) or self.b.is_unknown(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        if any(b" " in x.lstrip(b" ") for x in self.bytes_b) or self.b.encode("  a  b", out_type=str) != ["▁▁", "▁a", "▁", "▁b"]:
            raise ValueError(f"{path_b}: spaces aren't kept, or stand within pieces")
        self.quick = None
        vocabulary, merges = rules["model"]["vocab"], rules["model"]["merges"]
        if all(vocabulary[x + y] == 256 + n for n, (x, y) in enumerate(m.split(" ") if isinstance(m, str) else m for m in merges)):
            # Ids are the ranks of merges, so that the same merges can be had from a faster encoder.
            self.quick = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks={x: i for i, x in enumerate(self.bytes_a[: 256 + len(merges)])}, special_tokens={})
        self.len_a, self.len_b = (np.array([len(x) for x in some]) for some in (self.bytes_a, self.bytes_b))
        self.comma_a, self.bar_a, self.comma_b, self.semi_b = (np.array([f"{i}{then}" for i in range(n)], object) for n, then in ((len(self.len_a), ","), (len(self.len_a), "|"), (len(self.len_b), ","), (len(self.len_b), ";")))

    def encode(self, some: list[str]) -> tuple[list[list[int]], list[list[int]], list[bool]]:
        """Ids of texts in A and B, each with a space before it, and whether both keep its bytes."""
        a = [self.quick.encode_ordinary(f" {s}") if self.quick and not _RUN.search(s) else self.a.encode(f" {s}", add_special_tokens=False).ids for s in some]
        b = self.b.encode(some, num_threads=1)
        get_a, get_b = self.bytes_a.__getitem__, self.bytes_b.__getitem__
        same = [b"".join(map(get_a, x)) == w == b"".join(map(get_b, y)) for x, y, w in zip(a, b, (f" {s}".encode() for s in some))]
        return a, b, same

    def closed(self, some: list[str]) -> dict[str, pa.Array]:
        """Columns of the fragments of texts that begin after a space and end where tokens of both must; none for an empty one."""
        none: list[int] = []
        a, b, same = self.encode(some)
        fine = np.array(same, bool)
        a, b = ([x if ok and t else none for x, ok, t in zip(ids, same, some)] for ids in (a, b))
        n_a, n_b = (np.fromiter(map(len, ids), np.int64, len(ids)) for ids in (a, b))
        ids_a, ids_b = (np.fromiter(itertools.chain.from_iterable(ids), np.int64, int(n.sum())) for ids, n in ((a, n_a), (b, n_b)))
        # Both have the same bytes, text for text, so offsets run on from one text to the next.
        ends_a, ends_b = np.cumsum(self.len_a[ids_a]), np.cumsum(self.len_b[ids_b])
        last_a, last_b = (np.isin(x, y, assume_unique=True) for x, y in ((ends_a, ends_b), (ends_b, ends_a)))
        group_a, group_b = (np.cumsum(x) - x for x in (last_a, last_b))  # the groups before each token's
        # Tokens in the order of the digest, with what follows each: those of A in a group, then those of B.
        order = np.empty(len(ids_a) + len(ids_b), object)
        before_b = np.searchsorted(group_b, group_a)  # tokens of B in earlier groups
        order[np.arange(len(ids_a)) + before_b] = np.where(last_a, self.bar_a[ids_a], self.comma_a[ids_a])
        order[np.arange(len(ids_b)) + np.searchsorted(group_a, group_b, side="right")] = np.where(last_b, self.semi_b[ids_b], self.comma_b[ids_b])
        words, stop = order.tolist(), np.cumsum(n_a + n_b).tolist()
        groups = ["".join(words[i:j])[:-1].partition(";") for i, j in zip([0, *stop], stop)]
        prefix = [g[0].partition("|") for g in groups]
        # Pairs that end together, counted for each text.
        of = np.repeat(np.arange(len(some)), n_a)[last_a]
        pair, at = np.unique(ids_a[last_a] << 32 | ids_b[last_b], return_inverse=True)
        cell, times = np.unique(of * max(1, len(pair)) + at, return_counts=True)
        n_pairs = np.bincount(cell // max(1, len(pair)), minlength=len(some))
        offsets = pa.array(np.concatenate([[0], np.cumsum(n_pairs)]), pa.int32())
        empty = pa.array([""] * len(some))
        return {
            "n_a": pa.array(n_a), "n_b": pa.array(n_b), "closed": pa.array(np.bincount(of, minlength=len(some))),
            "prefix_a": pa.array([x[0] for x in prefix], pa.string()), "prefix_b": pa.array([x[2] for x in prefix], pa.string()), "body": pa.array([g[2] for g in groups], pa.string()),
            "suffix_a": empty, "suffix_b": empty, "fine": pa.array(fine),
            "pair": pa.ListArray.from_arrays(offsets, pa.array(pair[cell % max(1, len(pair))])), "times": pa.ListArray.from_arrays(offsets, pa.array(times)),
        }

    def ranged(self, text: str, step: int) -> list[tuple[int, Fragment]]:
        """Fragments of one such text by byte ranges, with their first bytes."""
        a, b, same = self.encode([text])
        return list(fragments(a[0], b[0], self.len_a, self.len_b, step)) if same[0] else [(0, Fragment(fine=False))]


@functools.lru_cache(1)
def _pair(path_a: str, path_b: str) -> Pair:
    return Pair(path_a, path_b)


_FRAGMENT = "n_a long, n_b long, closed long, prefix_a string, prefix_b string, body string, suffix_a string, suffix_b string, fine boolean, pair array<long>, times array<long>"
_PLAIN = ["n_a", "n_b", "closed", "prefix_a", "prefix_b", "body", "suffix_a", "suffix_b", "fine"]


def _batch(keys: dict[str, list], found: list[Fragment]) -> pa.RecordBatch:
    columns = {k: pa.array(v, pa.int64()) for k, v in keys.items()}
    kinds = [pa.int64()] * 3 + [pa.string()] * 5 + [pa.bool_()]
    columns |= {name: pa.array([getattr(f, name) for f in found], kind) for name, kind in zip(_PLAIN, kinds)}
    columns |= {"pair": pa.array([list(f.pairs) for f in found], pa.list_(pa.int64())), "times": pa.array([list(f.pairs.values()) for f in found], pa.list_(pa.int64()))}
    return pa.RecordBatch.from_pydict(columns)


def aligned(docs: DataFrame, path_a: str, path_b: str, chunk: int = CHUNK) -> DataFrame:
    """The composed fragment of each document, a written table: ``doc_id``, ``key`` (of the row) and the columns of ``Fragment``, with pairs of ids
    that end together as ``pair`` (A's id times 2^32 plus B's) and ``times``.

    Each text is encoded behind a space, without special tokens. Rows keep apart where ids repeat or are null. A text that is
    null, empty, or whose bytes a tokenizer doesn't keep, has no tokens. Texts of more than ``chunk`` characters are cut where
    tokens of both must end, and a run without such a place is aligned by byte ranges; their parts are dealt out and composed by
    a tree.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn("row", F.monotonically_increasing_id())
    long = F.length("text") > chunk

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = _pair(path_a, path_b)
        for batch in batches:
            for lot in (batch.slice(at, LOT) for at in range(0, batch.num_rows, LOT)):
                yield pa.RecordBatch.from_pydict({"doc_id": lot.column("doc_id"), **pair.closed(lot.column("text").to_pylist())})

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                at, keys = 0, {c: batch.column(c)[r].as_py() for c in ("row", "doc_id")}
                for part in cut(batch.column("text")[r].as_py(), chunk):
                    yield pa.RecordBatch.from_pydict({"row": pa.array([keys["row"]], pa.int64()), "doc_id": pa.array([keys["doc_id"]], pa.int64()), "at": pa.array([at], pa.int64()), "part": pa.array([part])})
                    at += len(part.encode()) + 1

    def apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = _pair(path_a, path_b)
        for batch in batches:
            for r in range(batch.num_rows):
                lot = batch.slice(r, 1)
                part = lot.column("part")[0].as_py()
                if len(part) <= chunk:
                    yield pa.RecordBatch.from_pydict({**{c: lot.column(c) for c in ("row", "doc_id", "at")}, **pair.closed([part])})
                else:  # no place to cut: fragments with open ends
                    found = pair.ranged(part, chunk)
                    row, doc, at = (lot.column(c)[0].as_py() for c in ("row", "doc_id", "at"))
                    yield _batch({"row": [row] * len(found), "doc_id": [doc] * len(found), "at": [at + start for start, _ in found]}, [f for _, f in found])

    def composed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, ["row", "up"]):
            held: Fragment | None = None
            last = None
            for r in table.to_pylist():
                now = Fragment(*(r[c] for c in _PLAIN), dict(zip(r["pair"], r["times"])))
                if last is not None and (r["row"], r["up"]) == (last["row"], last["up"]):
                    held = held.then(now)
                    continue
                if last is not None:
                    yield _batch({c: [last[c]] for c in ("row", "doc_id", "at")}, [held])
                held, last = now, r
            if last is not None:
                yield _batch({c: [last[c]] for c in ("row", "doc_id", "at")}, [held])

    keyed = "row long, doc_id long, at long, " + _FRAGMENT
    pieces = written(rows.where(long).mapInArrow(parts, "row long, doc_id long, at long, part string"))
    tree = written(pieces.repartition("row", "at").mapInArrow(apart, keyed))
    discard(pieces)
    most, width, done = tree.agg(F.max("at")).first()[0] or 0, chunk * FAN, 0
    while most > 0 and most >= done:  # until one range holds all first bytes
        up = tree.withColumn("up", F.floor(F.col("at") / width))
        level = written(up.repartition("row", "up").sortWithinPartitions("row", "up", "at").mapInArrow(composed, keyed))
        discard(tree)
        tree, width, done = level, width * FAN, width
    one = rows.where(~long).select("doc_id", "text").mapInArrow(whole, "doc_id long, " + _FRAGMENT)
    out = written(one.unionByName(tree.select(one.columns)).withColumn("key", F.monotonically_increasing_id()))
    discard(tree)
    return out


def pair_counts(found: DataFrame) -> DataFrame:
    """How many links of the corpus join each pair of ids, and whether no pair with the same id of B has more: ``pair``,
    ``count``, ``best``, and ``docs``, the documents that hold it."""
    each = found.where("fine").select(F.explode(F.arrays_zip("pair", "times")).alias("p")).groupBy(F.col("p.pair").alias("pair"))
    counts = each.agg(F.sum("p.times").alias("count"), F.count("*").alias("docs"))
    most = F.max("count").over(Window.partitionBy(F.col("pair").bitwiseAND(F.lit(2**32 - 1))))
    return counts.withColumn("best", F.col("count") == most)


def alignment_digests(docs: DataFrame, path_a: str, path_b: str, chunk: int = CHUNK) -> DataFrame:
    """Per document ``doc_id``, ``n_a`` and ``n_b`` (tokens), ``n_groups``, ``n_links`` (pairs of tokens that end together),
    ``n_best`` (links whose pair is the commonest in the corpus of those with its id of B, ties included), ``count_sum`` (the
    corpus's counts of all its links' pairs) and ``groups_sha256`` (of ``a1,a2|b1;a3|b2,b3``).

    A document without tokens, see ``aligned``, has zeros and an empty digest. Repeated rows come out once each and count in the
    corpus as often. An empty table gives an empty result; extra columns are left aside.
    """
    found = aligned(docs, path_a, path_b, chunk)
    counts = written(pair_counts(found))
    links = found.where("fine").select("key", F.explode(F.arrays_zip("pair", "times")).alias("p")).select("key", F.col("p.pair").alias("pair"), F.col("p.times").alias("times"))
    use = counts.select("pair", "count", "best")
    if counts.count() <= PAIRS:
        known = links.join(F.broadcast(use), "pair")
    else:
        total = counts.agg(F.sum("docs")).first()[0]
        heavy = F.broadcast(counts.where(F.col("docs") * HEAVY >= total).select("pair", "count", "best"))
        known = links.join(heavy, "pair").unionByName(links.join(heavy.select("pair"), "pair", "left_anti").join(use.hint("merge"), "pair"))
    sums = known.groupBy("key").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("count")).alias("count_sum"))
    groups = F.concat_ws(";", F.concat_ws("|", "prefix_a", "prefix_b"), F.when(F.col("body") != "", F.col("body")))
    has = F.col("fine") & (F.col("closed") > 0)
    about = found.select("key", "doc_id", *[F.when(has, F.col(c)).otherwise(0).cast("long").alias(n) for c, n in (("n_a", "n_a"), ("n_b", "n_b"), ("closed", "n_groups"), ("closed", "n_links"))], F.when(has, F.sha2(groups.cast("binary"), 256)).otherwise("").alias("groups_sha256"))
    out = about.join(sums, "key", "left")
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", F.lit(0)).cast("long").alias("n_best"), F.coalesce("count_sum", F.lit(0)).cast("long").alias("count_sum"), "groups_sha256")
