"""Results that are kept from run to run: only what is new, changed, computed by another version, or failed is computed again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.streaming.windows import cache_key


def last_generation(spark: SparkSession, path: str) -> int:
    """The number of the newest generation below ``path`` that was written to its end; 0 if there is none."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/generation=*/_SUCCESS")
    found = folder.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(folder)
    return max((int(f.getPath().getParent().getName().split("=")[1]) for f in found or ()), default=0)


def refreshed(inputs: DataFrame, path: str, key: list[str], content: list[str], version: str, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Results for ``inputs``, of which ``compute`` makes those that the last run under ``path`` can't give.

    ``key`` identifies a row, once in ``inputs``; what it says is fingerprinted from ``content``. ``compute`` gets the rows to compute
    and returns ``key``, its columns and ``failed`` (boolean). A row is reused if its fingerprint and ``version`` are those of the last run
    and it didn't fail. Rows that are gone from ``inputs`` go from the results.

    Each run writes a generation of its own, which counts once it is complete: a run that is lost halfway leaves the one
    before as it was, and the next run writes the same number again. Returns the new generation, with ``reused``.
    """
    spark = inputs.sparkSession
    now = inputs.withColumn("fingerprint", cache_key(*content))
    n = last_generation(spark, path)
    kept = None
    todo = now
    if n:
        before = spark.read.parquet(f"{path}/generation={n}").where((F.col("version") == version) & ~F.col("failed"))
        kept = before.drop("reused").join(now.select(*key, "fingerprint"), [*key, "fingerprint"], "left_semi").withColumn("reused", F.lit(True))
        todo = now.join(kept.select(*key), key, "left_anti")
    fresh = compute(todo.drop("fingerprint")).join(todo.select(*key, "fingerprint"), key).withColumns({"version": F.lit(version), "reused": F.lit(False)})
    out = fresh if kept is None else fresh.unionByName(kept.select(*fresh.columns))
    out.write.mode("overwrite").parquet(f"{path}/generation={n + 1}")
    return spark.read.parquet(f"{path}/generation={n + 1}")
