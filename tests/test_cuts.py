"""Caption wrapping and overrides against brute force."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.operators import cuts, segments
from tidemark.streaming import windows


def greedy(words, limit):
    lines, line = [], ""
    for w in words:
        if line and len(line) + 1 + len(w) <= limit:
            line += " " + w
        else:
            lines += [line] if line else []
            line = w
    return lines + ([line] if line else [])


def wrap(text, limit=42):
    words = text.split(" ")
    if len(text) <= limit:
        return [text]
    if len(text) > 2 * limit or len(words) < 2:
        return greedy(words, limit)
    both = [(" ".join(words[:k]), " ".join(words[k:])) for k in range(1, len(words))]
    fits = [(abs(len(a) - len(b)) + 0.5 * (len(a) > len(b)), k) for k, (a, b) in enumerate(both) if max(len(a), len(b)) <= limit]
    return list(both[min(fits)[1]]) if fits else greedy(words, limit)


def test_wrapped(spark):
    rng = random.Random(1)
    texts = [" ".join("x" * rng.randrange(1, 14) for _ in range(rng.randrange(1, 30))) for _ in range(300)] + ["", "y" * 90, "a " + "b" * 60, "é" * 30 + " " + "é" * 30]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", tx.wrapped(F.col("t")).alias("l"), tx.is_dense(F.col("t")).alias("d")).collect()
    assert all(r["l"] == wrap(r["t"]) and not r["d"] for r in got)
    dense = spark.createDataFrame([("日本語のテキスト",), ("ab 日本",), ("abc 日本",), ("",), (None,)], "t string").select(tx.is_dense(F.col("t")).alias("d")).collect()
    assert [r["d"] for r in dense] == [True, True, False, False, None]


def test_windows_leave_out_a_short_tail(spark):
    rows = spark.createDataFrame([(1, 0, 10_199), (2, 0, 10_200), (3, 0, 5_000), (4, 0, 150), (5, 7, 7)], "id long, start long, end long")
    got = sorted((r["id"], r["start"], r["end"]) for r in segments.windows(rows, 5000).collect())
    assert got == [(1, 0, 5000), (1, 5000, 10000), (2, 0, 5000), (2, 5000, 10000), (2, 10000, 10200), (3, 0, 5000)]


def test_unknown_ids_and_empty_tables(spark):
    wishes, known = spark.createDataFrame([(1,), (2,), (2,)], "id long"), spark.createDataFrame([(1,)], "id long")
    assert [r["id"] for r in cuts.unknown_ids(wishes, known).collect()] == [2]
    assert cuts.reports(spark.createDataFrame([], "k long, severity string"), "k").count() == 0


def test_batches_of_a_stream_are_written_by_number(spark, tmp_path):
    spark.range(6).selectExpr("id", "timestamp_seconds(id) AS ts", "id % 2 AS k").repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, ts timestamp, k long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    seen = {}
    windows.each_batch(stream, str(tmp_path / "a"), lambda b, n: seen.update({n: b.count()}))
    assert sum(seen.values()) == 6 and len(seen) > 1
    out = windows.run_available(windows.sliding(stream, "ts", ["k"], "id", "4 seconds", "2 seconds", "1 hour"), str(tmp_path / "out"), str(tmp_path / "b"), ["k", "start"])
    want = {}
    for i in range(6):
        for start in (i // 2 * 2, i // 2 * 2 - 2):
            n, total = want.get((i % 2, start), (0, 0))
            want[i % 2, start] = (n + 1, total + i)
    assert {(r["k"], r["s"]): (r["n"], r["total"]) for r in out.withColumn("s", F.unix_timestamp("start")).collect()} == want
