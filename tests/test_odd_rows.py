"""Queries against their SQL on rows that the smallest tables don't hold."""

from __future__ import annotations

import os

import duckdb
from test_queries import TABLES, plain

from tidemark import plans
from tidemark.operators.takes import boundary_signals


def against_sql(spark, name, folder, sf_dir, **tables):
    """Rows of a query where some tables (DuckDB SQL over the given ones) are replaced; they must be those of its SQL."""
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
        if t not in tables:
            os.symlink(path, folder / f"{t}.parquet")
    for t, sql in tables.items():
        con.sql(f"COPY ({sql}) TO '{folder}/{t}.parquet' (FORMAT parquet)")
        con.sql(f"CREATE OR REPLACE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    frame = plans.QUERIES[name](spark, str(folder))
    columns = sorted(frame.columns)
    expected = con.sql(plans.ORACLES[name])
    names = expected.columns
    got = plain([r.asDict() for r in frame.collect()], columns)
    assert got == plain([dict(zip(names, r)) for r in expected.fetchall()], columns)
    return got


def test_moments_without_length(spark, sf_dir, tmp_path):
    at = lambda id, user, minute, value: f"SELECT {id}::BIGINT AS event_id, TIMESTAMP '2024-01-01 00:00:00' + INTERVAL {minute} MINUTE AS ts, {user}::BIGINT AS user_id, 'view' AS event_type, {value}::DOUBLE AS value, '' AS props"
    # 2 has no length and lies inside 1; 4, without length too, lies inside nothing; 6 holds all of 5; 7 is as short as 8 and at its place.
    rows = [at(1, 10, 60, 30), at(2, 11, 40, 0), at(3, 12, 60, 30), at(4, 13, 60, 0), at(5, 14, 100, 60), at(6, 15, 50, 90), at(7, 16, 60, 0), at(8, 17, 30, 0)]
    got = against_sql(spark, "same_moments", tmp_path, sf_dir, events=" UNION ALL ".join(rows))
    assert [(r[0], r[2]) for r in got] == [(1.0, 2.0), (5.0, 6.0)]


def test_signals_of_odd_words(spark, sf_dir, tmp_path):
    said = [
        "1 22. 333! — " * 40, "red " * 60 + "car.", None, "one.\u0085 two\u2028 x\x0by a\u00a0b. " * 20 + "\u00a0", " ", "\u0130stanbul \u0130. " * 30 + "\n", "12 34? " * 60, "\n sun. moon " * 40,
    ]
    turn = lambda conv, at, text: f"SELECT {conv} AS conv_id, {at} AS turn, 'user' AS role, {'NULL' if text is None else chr(39) + text + chr(39)} AS text"
    rows = [turn(f"{c}::BIGINT", f"{(k * 3 + c) % 8}::BIGINT", text) for c in range(8) for k, text in enumerate(said)]
    rows += [turn("3::BIGINT", "NULL::BIGINT", "last red words. " * 30), turn("NULL::BIGINT", "0::BIGINT", "of nobody. " * 90)]
    got = against_sql(spark, "boundary_signals", tmp_path, sf_dir, conversations=" UNION ALL ".join(rows))
    assert len(got) > 50


def test_frames_beyond_a_hundred_hours(spark, sf_dir, tmp_path):
    got = against_sql(spark, "timecodes_and_frames", tmp_path, sf_dir, events="SELECT * REPLACE (event_id * 7001 AS event_id) FROM events WHERE event_id < 400")
    assert max(len(r[-1]) for r in got) > len("99:59:59.999")


def test_boundaries_are_not_broadcast(spark):
    rows = lambda values, columns: spark.sql(f"SELECT * FROM VALUES {values} AS t({columns})")
    atoms = rows("(1L, 0L, 5000L, NULL), (1L, 5000L, 9000L, 0.4D)", "a, start, end, change_score")
    said = rows("(1L, 0L, 1000L, 1L, 'p', array('red'))", "a, start, end, id, speaker, features")
    out = boundary_signals(atoms, said, rows("(1L, 4000L, 5500L)", "a, start, end"), rows("(1L, 5600L, 'split')", "a, at, kind"), ["a"], 4000)
    # Bins and atoms are many more rows than Spark's estimate says: none may go through the driver.
    assert out.count() == 1 and "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
