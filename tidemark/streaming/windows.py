"""Windows over event streams: tumbling, sliding and session windows with watermarks, and keyed upserts per batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _aggregated(stream: DataFrame, at: str, late: str, window, by: list[str], value: str) -> DataFrame:
    w = stream.withWatermark(at, late).groupBy(window.alias("w"), *by)
    return w.agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(*by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "total")


def tumbling(stream: DataFrame, at: str, by: list[str], value: str, length: str = "5 seconds", late: str = "10 seconds") -> DataFrame:
    """Count and sum per fixed window; rows later than the watermark are left out."""
    return _aggregated(stream, at, late, F.window(at, length), by, value)


def sliding(stream: DataFrame, at: str, by: list[str], value: str, length: str = "2 seconds", step: str = "1 second", late: str = "10 seconds") -> DataFrame:
    """Count and sum per overlapping window."""
    return _aggregated(stream, at, late, F.window(at, length, step), by, value)


def sessions(stream: DataFrame, at: str, by: list[str], value: str, gap: str = "2 seconds", late: str = "10 seconds") -> DataFrame:
    """Count and sum per session, which a quiet time longer than ``gap`` ends."""
    return _aggregated(stream, at, late, F.session_window(at, gap), by, value)


def run_available(frame: DataFrame, path: str, checkpoint: str, keys: list[str], mode: str = "update") -> DataFrame:
    """Runs a streaming aggregate over what is there now and returns its rows, written as Parquet below ``path``.

    A micro-batch's rows go to a folder named by its number, so a batch that is repeated after a failure replaces its
    own. In update mode a batch holds what it changed, and the last row of each of ``keys`` counts; in complete mode
    (sessions, which Spark doesn't update) the last batch holds all.
    """
    last = [-1]

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")
        last[0] = max(last[0], number)

    frame.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    spark = frame.sparkSession
    if last[0] < 0:
        return spark.createDataFrame([], frame.schema)
    if mode == "complete":
        return spark.read.schema(frame.schema).parquet(f"{path}/batch={last[0]}")
    rows = spark.read.option("basePath", path).parquet(path)
    newest = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("batch").desc()))
    return rows.withColumn("_n", newest).where("_n = 1").drop("_n", "batch")


def each_batch(frame: DataFrame, checkpoint: str, write: Callable[[DataFrame, int], None]) -> None:
    """Hands every micro-batch of what is there now to ``write`` (batch, number); a batch that is repeated after a
    failure has the same number, so writes keyed by it are idempotent."""
    frame.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def missing(keys: DataFrame, cache: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose content-addressed key the cache doesn't hold yet."""
    return keys.join(cache.select(*key).distinct(), key, "left_anti")


def cache_key(*parts: str):
    """Digest of the columns that a cached result depends on; null parts differ from empty ones."""
    return F.sha2(F.to_json(F.struct(*parts), {"ignoreNullFields": "false"}), 256)
