"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; where the session names none, one in the warehouse, which executors
    share with the driver, too."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoints")
    return sc.getCheckpointDir()


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts lineage and survives the loss of executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def discard(*frames: DataFrame) -> None:
    """Deletes tables that ``written`` made, once all that was read from them is written itself."""
    for df in frames:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._written_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


#: Bytes of an Arrow batch, about: rows may hold long texts or blocks of vectors.
BATCH = 8 << 20


def bounded_batches(spark: SparkSession, most: int = BATCH) -> None:
    """Has Spark hand rows to Python in batches of about ``most`` bytes, unless the session was started with a limit of its
    own. Both sides hold a batch or two for each task, so this bounds what a task needs beside its own data."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not spark.sparkContext.getConf().contains(name):
        spark.conf.set(name, str(most))


#: Ids that are broadcast, at most.
FEW = 1_000_000


def of_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose ``doc_id`` is among ``ids``, a written table of distinct ids: broadcast if they are few, so
    that texts needn't be shuffled, by a shuffle beyond that."""
    return docs.join(F.broadcast(ids) if ids.count() <= FEW else ids.hint("merge"), "doc_id", "left_semi")


def one_each(docs: DataFrame) -> DataFrame:
    """``docs`` (``doc_id``, ``text``) with one row for each id that isn't null, that of the least text; as they are, if no
    id is repeated."""
    known = docs.where("doc_id is not null")
    if not known.groupBy("doc_id").count().where("count > 1").limit(1).count():
        return docs
    return known.groupBy("doc_id").agg(F.min("text").alias("text")).union(docs.where("doc_id is null").select("doc_id", "text"))


_KEPT: dict[str, dict] = {}


def kept(name: str) -> dict:
    """What a Python worker keeps under a name from task to task, until another operator needs the room."""
    return _KEPT.setdefault(name, {})


def make_room(forget: bool = False) -> None:
    """Hands memory that is free, but held by Arrow's and the C library's allocators, back to the system; beforehand, what
    the worker keeps, if wanted."""
    if forget and any(_KEPT.values()):
        for x in _KEPT.values():
            x.clear()
        gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task that needs much memory: what its worker kept for other operators goes first, and what it took itself is handed
    back at its end, as workers outlive their tasks."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room(forget=True)
        yield from run(batches)
        make_room()

    return task


def texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null reads as empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def each_text(column: pa.Array, rows: int = 128) -> Iterator[bytes]:
    """The same one after another: few texts are copied at a time."""
    for at in range(0, len(column), rows):
        yield from texts(column.slice(at, rows))


def gathered(batches: Iterable[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Batches put together until they have about ``most`` bytes, for what is combined within each."""
    held, size = [], 0
    for b in batches:
        if held and size + b.nbytes > most:
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()
            held, size = [], 0  # only what is handed on stays
            yield whole.pop()
        if b.num_rows:
            held.append(b)
            size += b.nbytes
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def runs(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Re-cuts batches sorted by ``keys`` so that no group of equal keys is split between two tables.

    Holds one batch and the group that crosses its end, so use it where a group is bounded.
    """
    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        now = pa.Table.from_batches([batch])
        table = pa.concat_tables([held, now]).combine_chunks() if held is not None and held.num_rows else now
        new = starts(table, keys)
        cut = int(new[-1])
        held = table.slice(cut)
        if cut:
            yield table.slice(0, cut)
    if held is not None and held.num_rows:
        yield held


def starts(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Row numbers at which a new group of equal keys begins."""
    new = np.zeros(table.num_rows, bool)
    new[:1] = True
    for k in keys:
        x = table.column(k).to_numpy()
        new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)
