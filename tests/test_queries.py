"""Every clustering query against its SQL on the smallest tables."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

from cleave.plans.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def sql():
    if not Path(FOLDER).is_dir():
        pytest.skip("no test tables here")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sql, name):
    got = QUERIES[name](spark, FOLDER)
    found = sorted(tuple(sorted((k, repr(v)) for k, v in r.asDict().items())) for r in got.collect())
    if name in ORACLES:
        want = sql.execute(ORACLES[name])
        cols = [d[0] for d in want.description]
        assert found == sorted(tuple(sorted((k, repr(v)) for k, v in zip(cols, r, strict=True))) for r in want.fetchall())
    else:
        assert found
