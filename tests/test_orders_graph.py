"""The graph of customers' orders, against all pairs of a small table, and whole on the test tables."""

from __future__ import annotations

import datetime
import itertools
from pathlib import Path

import pytest

from cleave.sources import graphs

FOLDER = "/root/testdata/sf0.001"


def _pairs(rows, days):
    want = []
    for (k1, c1, d1, p1), (k2, c2, d2, p2) in itertools.combinations(rows, 2):
        if None not in (c1, c2, d1, d2, p1, p2) and c1 == c2 and abs((d1 - d2).days) <= days:
            want.append((min(k1, k2), max(k1, k2), float(3 - abs(p1 - p2) // 50_000.0)))
    return sorted(want)


def test_against_all_pairs(spark, tmp_path):
    start = datetime.datetime(1969, 11, 1)  # spans before and after day 0
    days = [0, 1, 9, 10, 11, 12, 20, 21, 22, 55, 60, 61, 61, 72, 83]
    rows = [(100 - k, k % 2, start + datetime.timedelta(days=d), 40_000.0 * (k * 7 % 5)) for k, d in enumerate(days)]
    rows += [(1, None, start, 1.0), (2, 0, None, 1.0), (3, 0, start, None)]
    schema = "o_orderkey bigint, o_custkey bigint, o_orderdate timestamp, o_totalprice double"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "orders.parquet"))
    for d in (0, 1, 10, 30):
        got = graphs.customer_orders(spark, str(tmp_path), d).collect()
        assert sorted(map(tuple, got)) == _pairs(rows, d)


def test_takes_every_order(spark):
    if not Path(FOLDER).is_dir():
        pytest.skip("no test tables here")
    read = spark.read.parquet(f"{FOLDER}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    got = graphs.customer_orders(spark, FOLDER).collect()
    assert sorted(map(tuple, got)) == _pairs([tuple(r) for r in read.collect()], 180)
