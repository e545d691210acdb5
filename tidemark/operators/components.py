"""Connected components by alternating star steps."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder for checkpoints: what ``spark.checkpoint.dir`` names, or else one in the warehouse, which executors share.

    A warehouse on a local disk is shared with nobody: on a cluster that is refused.
    """
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            folder = f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoints"
            if not sc.master.startswith("local") and folder.split(":")[0] in ("file", folder):
                raise ValueError("executors can't read a local warehouse: set spark.checkpoint.dir to a folder that they share")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def connected_components(edges: DataFrame) -> DataFrame:
    """Smallest reachable id for every node of ``edges`` (longs ``u``, ``v``): rows ``node``, ``component_id``.

    Alternates small-star and large-star steps until the edges form stars; each step is a pre-aggregated minimum and an
    equi-join, and each round is written to the folder that ``spark.checkpoint.dir`` names, so that the next knows its
    size and broadcasts what is small. Self loops and nulls are ignored; a node without an edge to another is absent from
    the result.
    """
    e = _kept(edges.select(F.least("u", "v").alias("v"), F.greatest("u", "v").alias("u")).where("u <> v").distinct())
    while not _stars(e):
        low = e.groupBy("u").agg(F.min("v").alias("m"))
        small = low.select("u", F.col("m").alias("v")).union(e.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")))
        both = small.select(F.col("u").alias("a"), F.col("v").alias("b")).union(small.select("v", "u"))
        large = both.join(both.groupBy("a").agg(F.min("b").alias("m")), "a").where("b > a")
        e = _kept(large.select(F.col("b").alias("u"), F.least("a", "m").alias("v")).where("u <> v").distinct())
    roots = e.select(F.col("v").alias("node")).distinct().withColumn("component_id", F.col("node"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component_id")).union(roots)


def _kept(edges: DataFrame) -> DataFrame:
    """A round's edges as a Parquet table."""
    spark = edges.sparkSession
    path = f"{checkpoint_folder(spark)}/edges-{uuid.uuid4().hex}"
    edges.write.parquet(path)
    return spark.read.schema(edges.schema).parquet(path)


def _stars(edges: DataFrame) -> bool:
    """Whether every node hangs on one other that hangs on none itself: then no step changes anything."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or up + down > 1").limit(1).count() == 0
