"""Registration of queries and the tables they read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.time import epoch_ms

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    """Registers a query by its name, with DuckDB SQL for the same rows."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event stream as time ranges of an owner: a minute for each unit of value."""
    e = table(spark, sf_dir, "events")
    start = epoch_ms(e, "ts")
    return e.select(F.col("user_id").alias("owner"), F.col("event_id").alias("id"), start.alias("start"), (start + F.floor(F.col("value") * 60000)).alias("end"), F.col("event_type").alias("kind"), "value")


#: The same ranges in SQL.
RANGES = """r AS (SELECT user_id AS owner, event_id AS id, (epoch_us(ts) // 1000) AS start, (epoch_us(ts) // 1000) + CAST(floor(value * 60000) AS BIGINT) AS "end", event_type AS kind, value FROM events)"""
#: Ranges of one kind merged where they overlap or touch.
MERGED = """{name}_m AS (SELECT *, max("end") OVER (PARTITION BY owner ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM r WHERE {where}),
{name}_i AS (SELECT *, sum(CASE WHEN reach IS NULL OR start > reach + {gap} THEN 1 ELSE 0 END) OVER (PARTITION BY owner ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS island FROM {name}_m),
{name} AS (SELECT owner, min(start) AS start, max("end") AS "end", count(*) AS n FROM {name}_i GROUP BY owner, island)"""


def merged(name: str, where: str = "true", gap: int = 0) -> str:
    return MERGED.format(name=name, where=where, gap=gap)
