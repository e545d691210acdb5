"""Every registered query of the library against its SQL, at the smallest scale."""

from __future__ import annotations

import math

import duckdb
import pytest

from tidemark import plans

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(rows, columns):
    def value(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return None
        return float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v

    return sorted((tuple(value(r[c]) for c in columns) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, sf_dir, oracle, name):
    frame = plans.QUERIES[name](spark, sf_dir)
    rows = [r.asDict() for r in frame.collect()]
    assert rows
    if name in plans.ORACLES:
        found = oracle.sql(plans.ORACLES[name])
        names = found.columns
        assert sorted(names) == sorted(frame.columns)
        expected = [dict(zip(names, r)) for r in found.fetchall()] if hasattr(found, "fetchall") else found.df().to_dict("records")
        columns = sorted(names)
        assert plain(rows, columns) == plain(expected, columns)
