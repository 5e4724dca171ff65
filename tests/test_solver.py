"""The solver against hand-made goldens, brute force, and its two ways of running against each other."""

from __future__ import annotations

from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from cleave.__main__ import main
from cleave.operators import dual, forest, matching, triangles
from cleave.options import Options, from_arguments
from cleave.plans import local
from cleave.plans.solver import solve
from cleave.sources import read_edges, write_clusters, write_edges
from tests.test_operators import CYCLE_7, FOREST_3, frame, labels, nodes, rows

TRI_A = [(0, 1, 1.1), (1, 2, -2.0), (2, 0, 3.0)]


def raw(spark, edges):
    return spark.createDataFrame(edges, "i bigint, j bigint, cost double")


def optimum(n, edges):
    return min(sum(c for i, j, c in edges if lab[i] != lab[j]) for lab in product(range(n), repeat=n) if all(lab[k] <= max(lab[:k], default=-1) + 1 for k in range(n)))


def random_graph(seed, n, m):
    rng = np.random.default_rng(seed)
    pairs = sorted({(min(a, b), max(a, b)) for a, b in rng.integers(0, n, (m, 2)).tolist() if a != b})
    return [(a, b, float(c)) for (a, b), c in zip(pairs, rng.integers(-8, 9, len(pairs)) / 2, strict=True)]


@pytest.mark.parametrize("local_edges", [0, 1000])
def test_goldens(spark, local_edges):
    found = solve(raw(spark, TRI_A), Options.preset("P", local_edges=local_edges))
    assert labels(found.labels) == [0, 1, 0] and found.lower_bound == -2 and abs(found.objective + 0.9) < 1e-9 and found.iterations == 1
    found = solve(raw(spark, [(0, 1, 1.5), (0, 2, -3.0), (1, 2, 1.0)]), Options.preset("PD", local_edges=local_edges))
    assert labels(found.labels) == [0, 0, 1] and abs(found.lower_bound + 2) < 1e-9 and found.objective == -2


@pytest.mark.parametrize("preset", ["P", "PD", "PD+"])
def test_bounds_hold_the_optimum(spark, preset):
    for seed in range(4):
        edges = random_graph(seed, 7, 16)
        found = solve(raw(spark, edges), Options.preset(preset))
        best = optimum(7, edges)
        assert found.lower_bound <= best + 1e-9 <= found.objective + 2e-9


def test_both_ways_agree(spark):
    edges = random_graph(11, 24, 70)
    for preset in ("P", "PD"):
        small = solve(raw(spark, edges), Options.preset(preset, dump_timeline=True, sanitize_graph=True))
        large = solve(raw(spark, edges), Options.preset(preset, local_edges=0, dump_timeline=True, sanitize_graph=True))
        assert labels(small.labels) == labels(large.labels) and abs(small.lower_bound - large.lower_bound) < 1e-9
        assert rows(small.timeline) == rows(large.timeline) and small.iterations == large.iterations


def test_steps_agree_on_random_graphs(spark):
    for seed in (1, 2):
        edges = random_graph(seed, 18, 60)
        g = frame(spark, edges)
        arrays = local.summed(*(np.array(x) for x in zip(*edges, strict=True)))
        for longest in (3, 4, 5):
            assert rows(triangles.conflicted(g, longest)) == [tuple(t) for t in local.triangles(arrays, longest).tolist()]
        for most in (3, 12, 40):
            assert rows(triangles.conflicted(g, 5, budget=most)) == [tuple(t) for t in local.triangles(arrays, 5, budget=most).tolist()]
        (_, _, cost), bound, n = local.dual_update(arrays, 4, 4)
        new, other, m = dual.update(g, 4, 4)
        assert n == m and abs(bound - other) < 1e-9
        assert np.allclose(cost, [r["cost"] for r in new.orderBy("i", "j").collect()], atol=1e-9)
        joining = arrays[2] > 0
        plus = tuple(x[joining] for x in arrays)
        assert [r[:2] for r in rows(forest.maximum_spanning_forest(g.where("cost > 0")))] == list(zip(*(plus[k][local.spanning_forest(18, plus)].tolist() for k in (0, 1)), strict=True))
        pairs, matched = matching.match(g, 0.05)
        label, count = local.match(18, arrays, 0.05)
        assert matched == count and [(int(b), a) for a, b in enumerate(label) if a != b] == sorted(rows(pairs), key=lambda p: p[1])
        to, twice = forest.contraction_map(nodes(spark, 18), g)
        label, count = local.conflict_free_forest(18, arrays)
        assert twice == count and labels(to) == local.ranks(label).tolist()
        assert all(label[i] != label[j] for i, j, c in edges if c < 0)


def test_forest_mode_and_signs(spark):
    found = solve(raw(spark, FOREST_3), Options.preset("P", matching_thresh_crossover_ratio=2.0, local_edges=0))
    got = labels(found.labels)
    assert all(got[i] != got[j] for i, j, c in FOREST_3 if c < -1.5)
    only_minus = solve(raw(spark, [(0, 1, -1.0), (1, 2, -2.0)]), Options.preset("PD"))
    assert labels(only_minus.labels) == [0, 1, 2] and only_minus.lower_bound == -3 == only_minus.objective
    only_plus = solve(raw(spark, [(0, 1, 1.0), (1, 2, 2.0), (3, 4, 1.0)]), Options.preset("PD"))
    assert labels(only_plus.labels) == [0, 0, 0, 1, 1] and only_plus.lower_bound == 0 == only_plus.objective


def test_sanitized_bound_only_and_time(spark):
    edges = [(0, 5, 1.0), (5, 0, 2.0), (5, 9, -1.0)]
    found = solve(raw(spark, edges), Options.preset("PD", sanitize_graph=True))
    assert labels(found.labels) == [0, -1, -1, -1, -1, 0, -1, -1, -1, 1] and found.objective == -1
    bound = solve(raw(spark, CYCLE_7), Options.preset("D", sanitize_graph=True))
    assert bound.labels is None and bound.objective is None and bound.lower_bound <= 0
    assert solve(raw(spark, CYCLE_7), Options.preset("PD", max_time_sec=0)).labels.count() == 7
    empty = solve(raw(spark, CYCLE_7).where("i < 0"), Options.preset("PD"))
    assert empty.labels.count() == 0 and empty.lower_bound == 0


def test_options():
    assert (Options().max_cycle_length_lb, Options.preset("P").num_dual_itr_lb, Options.preset("PD+").max_cycle_length_primal, Options.preset("D").num_outer_itr_dual) == (5, 0, 5, 5)
    for wrong in (lambda: Options.preset("X"), lambda: Options(max_cycle_length_lb=6), lambda: Options(tri_memory_factor=0), lambda: Options(num_dual_itr_lb=-1)):
        with pytest.raises(ValueError):
            wrong()
    found = from_arguments(["-f", "x", "--preset", "D", "--max_cycle_length_lb", "4", "--no-verbose"])
    assert found.only_compute_lb and found.max_cycle_length_lb == 4 and found.input_file == "x" and not found.verbose
    with pytest.raises(SystemExit):
        from_arguments(["-f", "x", "--max_cycle_length_lb", "9"])


def test_text_round_trip(spark, tmp_path, capsys):
    write_edges(frame(spark, CYCLE_7), f"{tmp_path}/edges")
    assert rows(read_edges(spark, f"{tmp_path}/edges")) == rows(frame(spark, CYCLE_7))
    (tmp_path / "good.txt").write_text("MULTICUT\n0 1 1.1\n1 2 -2\n 2 0 3\n")
    assert read_edges(spark, f"{tmp_path}/good.txt").count() == 3
    (tmp_path / "bad.txt").write_text("OTHER\n0 1 1.1\n")
    with pytest.raises(ValueError, match="MULTICUT"):
        read_edges(spark, f"{tmp_path}/bad.txt")
    (tmp_path / "broken.txt").write_text("MULTICUT\n0 1 1.1\n0 x 2\n")
    with pytest.raises(Exception, match="malformed edge"):
        read_edges(spark, f"{tmp_path}/broken.txt").collect()
    write_clusters(spark.createDataFrame([(0, 0), (3, 0), (1, 2), (2, -1)], "node bigint, cluster bigint"), f"{tmp_path}/clusters")
    assert [r[0] for r in spark.read.text(f"{tmp_path}/clusters").collect()] == ["0\t3", "", "1"]
    assert main(["-f", f"{tmp_path}/good.txt", "-o", f"{tmp_path}/out", "--preset", "P"]) == 0
    said = capsys.readouterr().out
    assert "cost: -0.8" in said or "cost: -0.9" in said
    assert sorted(r[0] for r in spark.read.text(f"{tmp_path}/out").collect()) == ["0\t2", "1"]


def test_validates_input(spark):
    with pytest.raises(Exception, match="self loop"):
        solve(raw(spark, [(2, 2, 1.0)]), Options.preset("P"))
    assert raw(spark, TRI_A).agg(F.sum("cost")).first()[0] == pytest.approx(2.1)
