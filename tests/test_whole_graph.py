"""Queries that run on every edge of the suppliers graph, against plain Python over all edges."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

from cleave.plans import evidence
from cleave.plans.oracles import query
from cleave.plans.queries import QUERIES

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def edges():
    if not Path(FOLDER).is_dir():
        pytest.skip("no test tables here")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{FOLDER}/lineitem.parquet'")
    return con.execute(query("SELECT i, j, cost FROM gs")).fetchall()


def test_forest_and_round_trip_take_all_edges(spark, edges):
    parent = {n: n for e in edges for n in e[:2]}

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    want = []
    for i, j, c in sorted((e for e in edges if e[2] > 0), key=lambda e: (-e[2], e[0], e[1])):
        a, b = root(i), root(j)
        if a != b:
            parent[a] = b
            want.append((i, j, c))
    assert sorted(map(tuple, QUERIES["max_spanning_forest_whole"](spark, FOLDER).collect())) == sorted(want)
    assert sorted(map(tuple, QUERIES["src_text_edges_whole"](spark, FOLDER).collect())) == sorted(edges)


def test_solve_p_scores_all_edges(spark, edges):
    found = QUERIES["solve_P"](spark, FOLDER).collect()
    cluster = {r["node"]: r["cluster"] for r in found}
    assert found[0]["objective"] == sum(c for i, j, c in edges if cluster[i] != cluster[j])
    assert found[0]["lower_bound"] == sum(min(c, 0) for _, _, c in edges)


def test_claims_of_p_hold_on_all_edges_without_a_copy_of_them(spark, edges, monkeypatch):
    def none(*_):
        raise AssertionError("a copy of the graph")

    monkeypatch.setattr(evidence, "cut", none)
    [row] = QUERIES["solve_P_claims"](spark, FOLDER).collect()
    assert tuple(row) == (len({n for e in edges for n in e[:2]}), True, True, True, True, sum(min(c, 0) for _, _, c in edges))
