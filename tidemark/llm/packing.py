"""Packing of documents into fixed-length sequences: first-fit decreasing with a tournament tree of bin capacities,
independently in randomised groups of documents."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._common import each_text, make_room
from tidemark.llm.bpe import LibraryCodec, codec

LENGTH = 2048
#: Bytes of text in a group, on average.
GROUP = 8 << 20


class CapacityTree:
    """Tournament tree over bins: the leftmost bin with enough room, in the logarithm of the number of bins."""

    def __init__(self, bins: int, capacity: int):
        self.size = 1 << max(0, bins - 1).bit_length()
        self.best = [capacity] * (2 * self.size)

    def place(self, need: int) -> int:
        """Takes ``need`` from the leftmost bin that has it; returns the bin."""
        best, i = self.best, 1
        while i < self.size:
            i = 2 * i if best[2 * i] >= need else 2 * i + 1
        best[i] -= need
        at = i - self.size
        while i > 1:
            i //= 2
            best[i] = max(best[2 * i], best[2 * i + 1])
        return at

    def room(self, i: int) -> int:
        return self.best[self.size + i]


def pack(lengths: list[int], capacity: int = LENGTH) -> list[tuple[int, int, int, int, int]]:
    """Pieces ``(item, start, length, bin, offset)`` of items longer than 0.

    Each item is cut into full bins and a remainder; remainders are placed by first-fit decreasing (ties: by item).
    What the emptiest bins hold is then cut to fill the gaps that are left in the fullest, so that one bin of a
    group at most is left with a gap that another's pieces could fill.
    """
    pieces = []
    used = 0
    rest = []
    for item, n in enumerate(lengths):
        for start in range(0, n - n % capacity, capacity):
            pieces.append((item, start, capacity, used, 0))
            used += 1
        if n % capacity:
            rest.append((item, n - n % capacity, n % capacity))
    tree = CapacityTree(len(rest), capacity)
    bins: list[list[tuple[int, int, int]]] = []
    for piece in sorted(rest, key=lambda p: (-p[2], p[0])):
        at = tree.place(piece[2])
        if at == len(bins):
            bins.append([])
        bins[at].append(piece)
    order = sorted(range(len(bins)), key=lambda b: (tree.room(b), b))
    room = {b: tree.room(b) for b in order}
    first, last = 0, len(order) - 1
    while first < last:
        to, source = order[first], order[last]
        if not room[to]:
            first += 1
        elif not bins[source]:
            last -= 1
        else:
            item, start, n = bins[source].pop()
            take = min(n, room[to])
            bins[to].append((item, start, take))
            room[to] -= take
            room[source] += take
            if take < n:
                bins[source].append((item, start + take, n - take))
    for b in bins:
        offset = 0
        for item, start, n in b:
            pieces.append((item, start, n, used, offset))
            offset += n
        used += bool(b)
    return pieces


def pack_documents(docs: DataFrame, path: str, end_id: int = 1, capacity: int = LENGTH, group: int = GROUP, keep_ids: bool = False) -> DataFrame:
    """Packs every document into sequences of at most ``capacity`` ids; one row per piece.

    Columns: ``doc_id``, ``start`` (the document's ids before the piece), ``length``, ``ids_crc32``, ``doc_tokens``,
    ``sequence_id``, ``offset`` and, with ``keep_ids``, ``ids``. Null and empty texts are the end id alone. Rows
    that repeat a document, or have a null ``doc_id``, are packed each on its own. Extra columns are ignored; an
    empty table gives an empty result.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, end = codec(path, LibraryCodec), end_id.to_bytes(4, "little")
        for b in batches:
            ids = (c.encode(t) + end for t in each_text(b.column(1)))
            ids = [np.frombuffer(x, "<u4").astype("<u2").tobytes() if c.small else x for x in ids]
            yield pa.record_batch([b.column(0), pa.array(ids, pa.binary()), pa.array([c.small] * len(ids))], names=["doc_id", "ids", "small"])
        make_room()

    def run(table: pa.Table) -> pa.Table:
        ids = [np.frombuffer(x, "<u2" if s else "<u4").astype("<u4") for x, s in zip(table.column("ids").to_pylist(), table.column("small").to_pylist())]
        number = table.column("doc_id").to_pylist()
        order = sorted(range(len(ids)), key=lambda i: (number[i] is None, number[i] or 0, len(ids[i]), ids[i].tobytes()))
        g = table.column("g")[0].as_py()
        rows = pack([len(ids[i]) for i in order], capacity)
        cut = [ids[order[i]][s : s + n] for i, s, n, _, _ in rows]
        out = {
            "doc_id": pa.array([number[order[r[0]]] for r in rows], pa.int64()),
            "start": pa.array([r[1] for r in rows], pa.int64()),
            "length": pa.array([r[2] for r in rows], pa.int64()),
            "ids_crc32": pa.array([zlib.crc32(x.tobytes()) for x in cut], pa.int64()),
            "doc_tokens": pa.array([len(ids[order[r[0]]]) for r in rows], pa.int64()),
            "sequence_id": pa.array([(g << 32) + r[3] for r in rows], pa.int64()),
            "offset": pa.array([r[4] for r in rows], pa.int64()),
        }
        if keep_ids:
            out["ids"] = pa.array([x.tolist() for x in cut], pa.list_(pa.int32()))
        return pa.table(out)

    # A document has one byte at least, for its end.
    size = docs.select(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 1)).first()[0] or 0
    groups = max(1, -(-size // group))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(encode, "doc_id bigint, ids binary, small boolean")
    key = F.pmod(F.xxhash64("doc_id", F.crc32("ids")), F.lit(groups)).cast("long")
    schema = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint" + ", ids array<int>" * keep_ids
    return rows.withColumn("g", key).groupBy("g").applyInArrow(run, schema)
