"""Goldens worked out by hand, one or more an operator."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from cleave.operators import components, dual, forest, matching, triangles
from cleave.operators import edges as E
from cleave.operators.prefix import _in_ranges, dense_ids, exclusive_sum, ranked
from cleave.operators.skew import deal, skew_join

TRI_B = [(0, 1, 1.5), (0, 2, -3.0), (1, 2, 1.0)]
MATCH = [(0, 1, 2.0), (1, 2, 3.0), (0, 2, -1.0), (3, 0, 1.0), (3, 1, 2.0)]
FOREST_1 = [(0, 1, 2.0), (1, 2, 3.0), (1, 3, 1.0), (0, 3, -3.0), (0, 2, -2.0)]
FOREST_2 = [*FOREST_1, (0, 4, 0.5), (3, 4, 0.75), (3, 5, 0.9), (3, 2, 0.8)]
FOREST_3 = [(0, 1, 2.0), (1, 2, 3.0), (1, 3, 1.0), (0, 4, 0.5), (3, 4, 0.75), (3, 5, 0.9), (3, 2, 0.8), (1, 5, -2.0), (0, 2, -3.0), (0, 3, -1.0)]
CYCLE_7 = [(0, 1, 2.0), (1, 2, 3.0), (0, 2, -1.0), (2, 3, 4.0), (3, 4, 1.5), (0, 3, 5.0), (2, 4, 2.0), (0, 4, -2.0), (3, 5, -3.0), (4, 5, 2.0), (5, 6, -1.5), (4, 6, 0.5)]


def frame(spark, rows):
    return E.canonical(spark.createDataFrame(rows, "i bigint, j bigint, cost double"))


def nodes(spark, n):
    return spark.range(n).withColumnRenamed("id", "node")


def labels(df):
    return [r["cluster"] for r in df.orderBy("node").collect()]


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]


def test_forms_and_filters(spark):
    g = frame(spark, [(1, 0, 2.0), (1, 2, -1.0), (2, 3, 0.0)])
    assert rows(g) == [(0, 1, 2.0), (1, 2, -1.0), (2, 3, 0.0)]
    assert E.symmetric(g).count() == 6 and rows(E.to_directed(E.symmetric(g))) == rows(g)
    assert rows(E.cost_range(g, -1, 0)) == [(1, 2, -1.0), (2, 3, 0.0)]
    joining, rest = E.split_by_sign(g)
    assert (joining.count(), rest.count()) == (1, 2)
    assert E.attractive(g).count() == 1 and E.repulsive(g).count() == 1
    sym, rep = E.split_with_tolerance(frame(spark, [(0, 1, -10.0), (1, 2, 5e-4), (2, 3, 1.0)]))
    assert (sym.count(), rep.count()) == (2, 1)
    assert rows(E.both_present(g, nodes(spark, 3))) == [(0, 1, 2.0), (1, 2, -1.0)]


def test_self_loops_and_nulls_stop(spark):
    for bad in [(2, 2, 1.0)], [(None, 2, 1.0)], [(1, 2, None)]:
        with pytest.raises(Exception, match="self loop or null"):
            E.validated(spark.createDataFrame(bad, "i bigint, j bigint, cost double")).collect()


def test_offsets_and_runs(spark):
    v = spark.createDataFrame([(x,) for x in (0, 1, 2, 2, 3, 4, 4)], "v bigint")
    assert [r["start"] for r in E.row_offsets(v).orderBy("v").collect()][:6] == [0, 1, 2, 4, 5, 7]
    w = spark.createDataFrame([(x,) for x in (2, 2, 4, 4, 4, 5, 7, 7)], "v bigint")
    assert [r["start"] for r in E.row_offsets(w).orderBy("v").collect()] == [0, 0, 0, 2, 2, 5, 6, 6, 8]
    runs = E.run_lengths(v)
    assert rows(runs) == [(0, 1), (1, 1), (2, 2), (3, 1), (4, 2)]
    assert [r["v"] for r in E.expand_runs(runs).orderBy("v", "k").collect()] == [0, 1, 2, 2, 3, 4, 4]
    assert E.row_offsets(v.where("v < 0")).count() == 0


def test_exclusive_sum_over_many_ranges(spark, monkeypatch):
    monkeypatch.setattr("cleave.operators.prefix.RANGE_ROWS", 3)
    rng = np.random.default_rng(1)
    keys = sorted(set(rng.integers(0, 1000, 60).tolist()))
    df = spark.createDataFrame([(k, k % 7) for k in keys], "k bigint, x bigint")
    got = [r["s"] for r in exclusive_sum(df, "k", "x", "s").orderBy("k").collect()]
    assert got == np.concatenate([[0], np.cumsum([k % 7 for k in keys])[:-1]]).tolist()
    assert rows(dense_ids(df, "k", "d")) == [(k, n) for n, k in enumerate(keys)]


def test_contract_and_sums(spark):
    g = frame(spark, MATCH)
    to = spark.createDataFrame([(0, 0), (1, 1), (2, 1), (3, 0)], "node bigint, cluster bigint")
    c = E.contract(g, to)
    assert rows(c) == [(0, 0, 1.0), (0, 1, 3.0), (1, 1, 3.0)]
    assert rows(E.diagonal(c)) == [(0, 1.0), (1, 3.0)] and E.bad_contractions(c).count() == 0
    assert rows(E.remove_diagonal(c)) == [(0, 1, 3.0)]
    assert E.objective(g, to).first()[0] == 3.0 and E.trivial_bound(g).first()[0] == -1.0
    assert c.agg(F.sum("cost")).first()[0] == E.cost_summary(g).first()["total"]  # contraction keeps the total
    assert rows(E.degrees(g)) == [(0, 3), (1, 3), (2, 2), (3, 2)]
    assert E.matching_threshold(frame(spark, [(0, 1, -1.0)]), 0.5).first()[0] == -1.0


def test_labels(spark):
    mk = lambda x: spark.createDataFrame(x, "node bigint, cluster bigint")
    assert labels(E.compress_labels(mk([(0, 7), (1, 3), (2, 7)]))) == [1, 0, 1]
    assert labels(E.compose_labels(mk([(0, 0), (1, 1), (2, 9)]), mk([(0, 4), (1, 5)]))) == [4, 5, 9]
    g = spark.createDataFrame([(0, 5, 1.0), (5, 0, 2.0), (5, 9, -1.0), (4, 4, 8.0)], "i bigint, j bigint, cost double")
    clean, ids = E.sanitize(g)
    assert rows(clean) == [(0, 1, 1.0), (1, 2, -1.0)] and rows(ids) == [(0, 0), (5, 1), (9, 2)]
    assert labels(E.desanitize(mk([(0, 0), (1, 0), (2, 1)]), ids)) == [0, -1, -1, -1, -1, 0, -1, -1, -1, 1]
    v = spark.createDataFrame([(3,), (5,), (9,)], "v bigint")
    assert [r["new"] for r in E.map_to_consecutive(v, spark.createDataFrame([(5,), (9,), (5,)], "v bigint")).orderBy("v").collect()] == [-1, 0, 1]


def test_components(spark):
    link = lambda x: spark.createDataFrame(x, "i bigint, j bigint")
    got = lambda n, e: [r["component"] for r in components.connected_components(nodes(spark, n), link(e)).orderBy("node").collect()]
    assert got(5, [(0, 1), (2, 3), (2, 4)]) == [0, 0, 2, 2, 2]
    assert got(3, [(1, 2)]) == [0, 1, 1]
    assert got(40, [(k, k + 1) for k in range(39)]) == [0] * 40  # a long path
    assert got(30, [(29, k) for k in range(29)]) == [0] * 30  # a hub
    assert components.connected_components(nodes(spark, 2), link([(0, 1)]).where("i > 5")).count() == 2


def test_random_components(spark):
    from cleave.plans.local import components as plain

    rng = np.random.default_rng(3)
    e = rng.integers(0, 200, (150, 2))
    e = e[e[:, 0] != e[:, 1]]
    got = components.connected_components(nodes(spark, 200), spark.createDataFrame(e.tolist(), "i bigint, j bigint"))
    assert [r["component"] for r in got.orderBy("node").collect()] == plain(200, e[:, 0], e[:, 1]).tolist()


def test_matching(spark):
    pairs, n = matching.match(frame(spark, MATCH), 0.0)
    assert n == 4 and rows(pairs) == [(0, 3), (1, 2)]
    to, n = matching.contraction_map(nodes(spark, 4), frame(spark, MATCH), 0.0)
    assert labels(to) == [0, 1, 1, 0]
    assert matching.match(frame(spark, [(0, 1, -1.0)]), 0.5)[1] == 0
    ring = frame(spark, [(0, 1, 1.0), (1, 2, 1.0), (2, 3, 1.0), (0, 3, 1.0)])  # ties go to the least neighbour
    assert rows(matching.match(ring, 0.0)[0]) == [(0, 1), (2, 3)]
    star = frame(spark, [(0, k, 1.0) for k in range(1, 6)])
    assert rows(matching.match(star, 0.0)[0]) == [(0, 1)]


def test_spanning_forest(spark):
    f = forest.maximum_spanning_forest(E.attractive(frame(spark, FOREST_2)))
    assert rows(f) == [(0, 1, 2.0), (1, 2, 3.0), (1, 3, 1.0), (3, 4, 0.75), (3, 5, 0.9)]
    assert forest.maximum_spanning_forest(frame(spark, [(0, 1, -1.0)]).where("cost > 0")).count() == 0
    tied = frame(spark, [(a, b, 1.0) for a in range(6) for b in range(a + 1, 6)])
    assert rows(forest.maximum_spanning_forest(tied)) == [(0, k, 1.0) for k in range(1, 6)]


@pytest.mark.parametrize(("edges", "want", "n"), [(FOREST_1, [0, 1, 1, 2], 2), (FOREST_2, [0, 1, 1, 2, 2, 2], 6), (FOREST_3, [0, 1, 1, 2, 2, 3], 4)])
def test_conflict_free_forest(spark, edges, want, n):
    to, count = forest.contraction_map(nodes(spark, len(want)), frame(spark, edges))
    got = labels(to)
    assert got == want and count == n
    assert all(got[i] != got[j] for i, j, c in edges if c < 0)


def test_long_conflict(spark):
    """A path of six edges closed by a repulsive one: found by the general search only."""
    path = [(k, k + 1, 1.0 + 0.01 * k) for k in range(6)]
    to, n = forest.contraction_map(nodes(spark, 7), frame(spark, [*path, (0, 6, -5.0)]))
    got = labels(to)
    assert got[0] != got[6] and n == 10


def test_thin(spark):
    assert rows(forest.thin(frame(spark, [(0, 1, 1.0), (1, 2, 3.0), (2, 3, 2.0)]))) == [(1, 2, 3.0), (2, 3, 2.0)]


@pytest.mark.parametrize(
    ("edges", "counts"),
    [
        (CYCLE_7, (5, 10, 11)),
        ([(0, 1, -1.0), (1, 2, 2.0), (2, 0, 1.0)], (1, 1, 1)),
        ([(0, 1, -1.0), (1, 2, 2.0), (2, 3, 1.0), (3, 0, 3.0)], (0, 2, 2)),
        ([(0, 1, -1.0), (1, 2, -2.0), (2, 3, 1.0), (3, 0, 3.0)], (0, 0, 0)),
        ([(0, 1, -1.0), (1, 2, 2.0), (2, 3, 1.0), (3, 4, 3.0), (4, 0, 2.0)], (0, 0, 3)),
    ],
)
def test_conflicted_cycles(spark, edges, counts):
    assert tuple(triangles.conflicted(frame(spark, edges), k).count() for k in (3, 4, 5)) == counts


def test_cycle_limits(spark):
    g = frame(spark, CYCLE_7)
    assert rows(triangles.conflicted(g, 3)) == [(0, 1, 2), (0, 2, 3), (0, 3, 4), (3, 4, 5), (4, 5, 6)]
    assert triangles.conflicted(g, 2).count() == 0
    with pytest.raises(ValueError, match="5 edges"):
        triangles.conflicted(g, 6)
    top = triangles.strongest(triangles.conflicted(g, 3), g, 2)
    assert [(r["place"], r["strength"]) for r in top.orderBy("place").collect()] == [(1, 1.5), (2, 1.5)]  # (0, 3, 4), then (3, 4, 5)


def test_message_passing(spark):
    g = frame(spark, [(0, 1, 1.0), (0, 2, 1.0), (0, 3, -2.0), (1, 3, 1.0), (2, 3, 1.0)])
    state = dual.start(g, spark.createDataFrame([(0, 1, 3), (0, 2, 3)], "a bigint, b bigint, c bigint"))
    assert dual.lower_bound(*state).first()[0] == -2.0
    state, last = dual.send_to_triangles(*state), -2.0
    for _ in range(3):
        state = dual.iterate(*state)
        now = dual.lower_bound(*state).first()[0]
        assert now >= last - 1e-9
        last = now
    assert abs(last) < 1e-6


def test_dual_golden(spark):
    new, bound, n = dual.update(frame(spark, TRI_B), 3, 2)
    assert n == 1 and abs(bound + 2) < 1e-9
    assert [round(r["cost"], 9) for r in new.orderBy("i", "j").collect()] == [round(x, 9) for x in (1 / 6, -5 / 3, -1 / 3)]
    assert dual.update(frame(spark, [(0, 1, -1.0)]), 3, 2)[1:] == (-1.0, 0)
    assert dual.solve(frame(spark, TRI_B), 0, 2, 1)[1] == -3.0


@pytest.mark.parametrize("how", ["inner", "left"])
def test_skew_join_is_a_join(spark, how):
    rng = np.random.default_rng(9)
    many = [(None if k % 7 == 0 else 5 if k % 3 == 0 else int(rng.integers(0, 900)), k % 11) for k in range(3000)]
    one = [(k, f"v{k}") for k in range(0, 900, 2)] + [(5, "hot")]
    left, right = spark.createDataFrame(many, "k bigint, x bigint"), spark.createDataFrame(one, "k bigint, v string")
    got = skew_join(left, right, "k", how=how)
    assert sorted(map(str, got.select("k", "x", "v").collect())) == sorted(map(str, left.join(right, "k", how).select("k", "x", "v").collect()))
    dealt, hot = deal(left, "k")
    assert [r["k"] for r in hot.collect()] == [5] and dealt.where("k = 5").groupBy("__part").count().agg(F.max("count")).first()[0] < 400
    assert dealt.where("k IS NULL").select("__part").distinct().count() > 100


def test_components_and_forest_of_hubs_and_paths(spark, monkeypatch):
    """The rounds on frames against the finish in one task, with hot nodes dealt in parts."""
    monkeypatch.setattr("cleave.operators.skew.PART_ROWS", 20)
    rng = np.random.default_rng(4)
    pairs = {(0, k) for k in range(1, 200, 2)} | {(k, k + 1) for k in range(200, 260)} | {tuple(sorted(p)) for p in rng.integers(0, 400, (150, 2)).tolist() if p[0] != p[1]}
    g = frame(spark, [(a, b, float(rng.integers(1, 5))) for a, b in sorted(pairs)])
    for op in (lambda n: components.connected_components(nodes(spark, 400), g, one_task=n), lambda n: forest.maximum_spanning_forest(g, one_task=n)):
        assert rows(op(0)) == rows(op(1 << 20))


def test_ranges_hold_alike_rows_of_uneven_keys(spark, monkeypatch):
    monkeypatch.setattr("cleave.operators.prefix.RANGE_ROWS", 50)
    keys = [*range(999), 10**15]
    df = spark.createDataFrame([(k,) for k in keys], "v bigint")
    assert [r["r"] for r in dense_ids(df, "v", "r").orderBy("v").collect()] == list(range(1000))
    assert _in_ranges(df, "v").groupBy("__range").count().agg(F.max("count")).first()[0] < 150
    tied = spark.createDataFrame([(float(k % 3), k) for k in range(700)], "s double, k bigint")
    got = [(r["s"], r["k"]) for r in ranked(tied, "place", F.desc("s"), "k").orderBy("place").collect()]
    assert got == sorted(((float(k % 3), k) for k in range(700)), key=lambda x: (-x[0], x[1]))


def test_four_and_five_cycles_against_all_paths(spark):
    rng = np.random.default_rng(6)
    for _ in range(3):
        near, rep = set(), set()
        for a, b in rng.integers(0, 11, (34, 2)).tolist():
            if a != b:
                (near if rng.random() < 0.75 else rep).add((min(a, b), max(a, b)))
        rep -= near
        both = near | {(b, a) for a, b in near}
        to = {k: [b for a, b in both if a == k] for k in range(11)}
        four = {t for i, j in rep for n in to[i] for m in to[n] if j in to[m] for t in ((i, j, n), (j, n, m))}
        five = {t for i, j in rep for n in to[i] for m in to[n] for q in to[m] if j in to[q] and q != n for t in ((i, j, n), (j, n, m), (j, m, q))}
        sym, edges = spark.createDataFrame(sorted(both), "src bigint, dst bigint"), spark.createDataFrame(sorted(rep), "i bigint, j bigint")
        for op, found in ((triangles.four_cycles, four), (triangles.five_cycles, five)):
            assert rows(op(sym, edges)) == sorted({tuple(sorted(t)) for t in found if len(set(t)) == 3})


def test_facade_and_cluster_rows(spark, tmp_path):
    import cleave

    found = cleave.solve(frame(spark, [(0, 1, 1.1), (1, 2, -2.0), (0, 2, 3.0)]), cleave.Options.preset("P", verbose=False))
    cleave.write_clusters(found.labels, str(tmp_path / "rows"), rows=True)
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "rows")).collect()) == ["0\t0", "0\t2", "1\t1"]
    with pytest.raises(AttributeError):
        cleave.nothing
