"""Grey frames: how bright they are, how much they differ from the one before, and where a picture stands still or is black."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The size of a frame and the cells it is compared in (columns, rows), and the share of pixels that a peak leaves above it: fixed values.
WIDTH, HEIGHT, CELLS, PEAK = 64, 36, (4, 3), 0.98


def frame_statistics(frames: DataFrame, by: list[str], width: int = WIDTH, height: int = HEIGHT, cells: tuple[int, int] = CELLS) -> DataFrame:
    """Per frame (``by``, ``hop``, ``grey``: ``width`` times ``height`` bytes) its mean ``luma``, its ``peak`` (the least level that 98 % of
    the pixels don't exceed) and its ``motion``: the largest mean absolute difference of a cell from the frame before.

    The first frame of an asset has the motion of the second, so that no file opens with a stillness that isn't there; 0 where it is
    alone. Frames of another size are left out, as are null ones. Differences are worked out in batches, each row with its forerunner.
    """
    w = Window.partitionBy(*by).orderBy("hop")
    whole = frames.where(F.length("grey") == width * height).select(*by, "hop", "grey")
    pairs = whole.withColumn("_before", F.lag("grey").over(w))
    cols, rows = cells

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in (batch.slice(at, 1024) for at in range(0, batch.num_rows, 1024)):
                now = np.frombuffer(b"".join(b.column("grey").to_pylist()), np.uint8).reshape(b.num_rows, -1)
                held = b.column("_before").to_pylist()
                before = np.frombuffer(b"".join(x or n for x, n in zip(held, b.column("grey").to_pylist())), np.uint8).reshape(b.num_rows, -1)
                differ = np.abs(now.astype(np.int16) - before).reshape(b.num_rows, rows, height // rows, cols, width // cols)
                motion = differ.mean((2, 4)).reshape(b.num_rows, -1).max(1, initial=0)
                place = int(np.ceil(now.shape[1] * PEAK)) - 1
                keys = {c: b.column(c) for c in (*by, "hop")}
                first = np.array([x is None for x in held], bool)
                yield pa.RecordBatch.from_pydict({**keys, "luma": pa.array(now.mean(1)), "peak": pa.array(np.partition(now, place, 1)[:, place].astype(np.int32)), "motion": pa.array(motion, mask=first)})

    kinds = dict(frames.dtypes)
    out = pairs.mapInArrow(measure, ", ".join(f"`{c}` {kinds[c]}" for c in (*by, "hop")) + ", luma double, peak int, motion double")
    return out.withColumn("motion", F.coalesce("motion", F.lead("motion").over(w), F.lit(0.0)))


def picture_events(statistics: DataFrame, by: list[str], hop_ms: int, static: float = 0.5, least_static: int = 3000, black: int = 24, least_black: int = 400) -> DataFrame:
    """Stretches of an asset's frames (``hop`` from 0, without holes) that stand still or are black: ``start``, ``end`` (ms), ``kind``
    ('static' or 'black') and ``confidence``; the further below ``static`` the motion is, the surer, from 0.5 to 0.95."""
    w = Window.partitionBy(*by).orderBy("hop")
    out = None
    for kind, test, least in (("static", F.col("motion") < static, least_static), ("black", F.col("peak") < black, least_black)):
        on = statistics.where(test).withColumn("_i", F.col("hop") - F.row_number().over(w))
        runs = on.groupBy(*by, "_i").agg((F.min("hop") * hop_ms).alias("start"), ((F.max("hop") + 1) * hop_ms).alias("end"), F.avg("motion").alias("_m"))
        sure = F.floor(F.greatest(F.lit(0.5), F.least(F.lit(0.95), 1 - F.col("_m") / static)) * 1000 + 0.5) / 1000 if kind == "static" else F.lit(0.9)
        found = runs.where(F.col("end") - F.col("start") >= least).select(*by, "start", "end", F.lit(kind).alias("kind"), sure.alias("confidence"))
        out = found if out is None else out.unionByName(found)
    return out
