"""Graphs whose ids lie close together, and searches over many trees: few joins, with the results of the steps on frames."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
import pyarrow as pa
import pytest

from cleave.operators import components, forest, matching
from cleave.operators import edges as E
from cleave.options import Options
from cleave.plans import solver
from cleave.sources import graphs


def blocks(spark, seed, count=4, size=20, edges=40):
    """Blocks of close ids, a hub among them and some edges between blocks; few distinct costs, so many ties."""
    rng, found = np.random.default_rng(seed), {}
    for b in range(count):
        for i, j in np.sort(rng.integers(0, size, (edges, 2)), axis=1).tolist():
            found[b * size + i, b * size + j] = float(rng.integers(-3, 5)) / 2
    for k in range(1, count * size, 9):
        found[0, k] = 1.0
    for i, j in np.sort(rng.integers(0, count * size, (6, 2)), axis=1).tolist():
        found[i, j] = 2.0
    rows = [(10 * i + 7, 10 * j + 7, c) for (i, j), c in found.items() if i != j]
    return spark.createDataFrame(rows, "i bigint, j bigint, cost double").repartition(5).localCheckpoint()


def chains(spark, seed, count=5, size=30):
    """Trees with long paths and repulsive edges across them."""
    rng, tree, rep = np.random.default_rng(seed), {}, set()
    for b in range(count):
        for k in range(1, size):
            near = max(0, k - int(rng.integers(1, 4)))
            tree[b * size + near, b * size + k] = float(rng.integers(16, 21))
        for i, j in np.sort(rng.integers(0, size, (8 if b else 0, 2)), axis=1).tolist():
            if i != j and (b * size + i, b * size + j) not in tree:
                rep.add((b * size + i, b * size + j, -1.0))
    joining = spark.createDataFrame([(*e, c) for e, c in tree.items()], "i bigint, j bigint, cost double")
    return joining, spark.createDataFrame(sorted(rep), "i bigint, j bigint, cost double"), spark.range(count * size).withColumnRenamed("id", "node")


def rows(df):
    return sorted(map(tuple, df.collect()))


def joined(edges):
    """Kruskal's forest and the least node that each node reaches."""
    near, taken = {}, []
    for i, j, c in sorted(edges, key=lambda e: (-e[2], e[0], e[1])):
        a, b = near.setdefault(i, {i}), near.setdefault(j, {j})
        if a is not b:
            a |= b
            near.update(dict.fromkeys(b, a))
            taken.append((i, j, c))
    return sorted(taken), sorted((n, min(s)) for n, s in near.items())


def test_what_lies_in_ranges_is_closed_first(spark):
    g = E.attractive(blocks(spark, 1)).localCheckpoint()
    tree, least = joined(rows(g))
    assert rows(forest.maximum_spanning_forest(g, one_task=60)) == tree
    assert rows(components.connected_components(g.selectExpr("explode(array(i, j)) AS node"), g, one_task=60)) == least


def test_separate_blocks_need_no_steps_on_frames(spark, monkeypatch):
    edges = [(100 * b + k, 100 * b + k + 1, 1.0) for b in range(40) for k in range(20)]
    g = spark.createDataFrame(edges, "i bigint, j bigint, cost double")

    def none(*_):
        raise AssertionError("a step on frames")

    for module, name in ((forest, "_roots"), (components, "_large_star")):
        monkeypatch.setattr(module, name, none)
    assert len(rows(forest.maximum_spanning_forest(g, one_task=200))) == 800
    found = components.connected_components(g.selectExpr("i AS node"), g, one_task=200)
    assert {r["component"] for r in found.collect()} == {100 * b for b in range(40)}


def searched(tree, rep):
    """The general search as it is defined, a path at a time."""
    tree, half, start = {(i, j): c for i, j, c in tree}, 0, 0

    def path(u, v):
        near = {}
        for i, j in tree:
            near.setdefault(i, []).append(j)
            near.setdefault(j, []).append(i)
        found, todo = {u: [u]}, [u]
        for n in todo:
            new = [m for m in near.get(n, []) if m not in found]
            found.update({m: [*found[n], m] for m in new})
            todo += new
        walk = found.get(v, [])
        return [tuple(sorted(e)) for e in zip(walk, walk[1:], strict=False)]

    while paths := [p for i, j, _ in rep if (p := path(i, j))]:
        if half % 10 == 0:
            limit = 0.9 * np.mean([c for c in tree.values() if c >= 0])
            if min(tree.values()) < limit:
                tree, start = {e: c for e, c in tree.items() if c >= limit}, half
                paths = [p for i, j, _ in rep if (p := path(i, j))]
                if not paths:
                    break
        half += 1
        first = len([h for h in range(start, half) if h % 2 == 0])
        due = [(p[:first], p[first:][::-1]) for p in paths if len(p) == half - start]
        for one, two in due:
            a, b = (min(side, key=tree.__getitem__, default=None) for side in (one, two))
            paths.append(a if b is None or a and tree[a] < tree[b] else b)
        if due:
            tree, start = {e: c for e, c in tree.items() if e not in paths[-len(due) :]}, half
    return sorted((*e, c) for e, c in tree.items())


@pytest.mark.parametrize("seed", [3, 4, 5])
def test_search_in_tasks_takes_what_frontiers_meet(spark, seed):
    tree, rep, nodes = chains(spark, seed)
    want = searched(tree.collect(), rep.collect())
    assert rows(forest.conflict_free(nodes, tree, rep)) == want
    assert len(want) < tree.count()


def test_search_on_frames_until_trees_are_small(spark):
    tree, rep, nodes = chains(spark, 4, 1, 12)
    assert rows(forest.conflict_free(nodes, tree, rep, one_task=12)) == searched(tree.collect(), rep.collect())


def test_search_finds_trees_once(spark, monkeypatch):
    calls, plain = [], forest.connected_components
    monkeypatch.setattr(forest, "connected_components", lambda *a, **k: calls.append(1) or plain(*a, **k))
    tree, rep, nodes = chains(spark, 3)
    forest.conflict_free(nodes, tree, rep).collect()
    assert len(calls) == 1


@pytest.mark.parametrize("seed", [6, 7])
def test_matching_in_one_task_takes_what_rounds_on_frames_take(spark, seed, monkeypatch):
    g = blocks(spark, seed)
    want, n = matching.match(g, 0.05, one_task=0)
    got, m = matching.match(g, 0.05, one_task=100)
    assert (rows(got), m) == (rows(want), n) and n

    def none(*_):
        raise AssertionError("a round on frames")

    monkeypatch.setattr(matching, "best_neighbours", none)
    got, m = matching.match(g, 0.05)
    assert (rows(got), m) == (rows(want), n)


def test_contraction_of_few_nodes_sends_only_their_map(spark, monkeypatch):
    """On frames to the end, as on arrays; a bad contraction still raises."""
    g = blocks(spark, 8, 2, 10, 20)
    frames, arrays = (solver.solve(g, Options.preset("P", sanitize_graph=True, verbose=False, local_edges=n)) for n in (0, 200_000))
    assert rows(frames.labels) == rows(arrays.labels) and frames.objective == arrays.objective
    bad = spark.createDataFrame([(0, 0), (1, 0), (2, 1)], "node bigint, cluster bigint")
    monkeypatch.setattr(solver.matching, "contraction_map", lambda *_: (bad, 2))
    with pytest.raises(solver.BadContraction):
        solver.solve(spark.createDataFrame([(0, 1, -1.0), (1, 2, 1.0)], "i bigint, j bigint, cost double"), Options.preset("P", verbose=False, local_edges=0))


def test_lines_are_read_once_for_mean_and_costs(spark, tmp_path):
    lines = [(o, s) for o in range(30) for s in range(o % 4)] + [(0, 1), (None, 1), (2, None)]
    spark.createDataFrame(lines, "l_orderkey bigint, l_suppkey bigint").write.parquet(str(tmp_path / "lineitem.parquet"))
    g = graphs.suppliers(spark, str(tmp_path))
    assert "Scan parquet" not in g._jdf.queryExecution().executedPlan().toString()
    assert rows(g) == [(0, 1, 5.0), (0, 2, -2.0), (1, 2, -2.0)]


def test_pairs_of_lines_are_whole_in_small_batches(monkeypatch):
    monkeypatch.setattr(graphs, "BATCH", 3)
    rng = np.random.default_rng(5)
    lines = [(int(o), int(s)) for o, s in zip(rng.integers(-3, 4, 60), rng.integers(-4, 5, 60), strict=True)] + [(9, 1)]
    batches = [pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*part, strict=True)], names=["o", "s"]) for part in (lines[:20], lines[20:])]
    found = [p for b in graphs._pairs(iter(batches)) for p in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    assert sorted(found) == sorted((s, t) for o, s in set(lines) for p, t in set(lines) if o == p and s < t)
    assert not list(graphs._pairs(iter([])))


@pytest.mark.parametrize("one_task", [0, 40, 1000])
def test_matching_of_few_nodes_takes_what_rounds_on_frames_take(spark, one_task, monkeypatch):
    monkeypatch.setattr(matching, "HELD", 10)
    for seed in (6, 7):
        g = E.densified(blocks(spark, seed))[0].repartition(3).localCheckpoint()
        want, n = matching.match(g, 0.05, one_task=0)
        threshold = E.matching_threshold(g, 0.05).first()[0]
        low, high, m = matching.match_few(g, 80, threshold, one_task)
        assert (list(zip(low.tolist(), high.tolist(), strict=True)), m) == (rows(want), n) and n
    assert matching.match_few(g, 80, -1.0)[2] == 0


@pytest.mark.parametrize("one_task, sent, preset", [(0, 1 << 16, "P"), (60, 1 << 16, "P"), (1000, 1 << 16, "P"), (1000, 0, "P")])
def test_solve_above_local_edges_as_on_arrays(spark, one_task, sent, preset, monkeypatch):
    """Labels of few nodes on the driver, the end in one task, or both; a timeline holds every iteration."""
    g = blocks(spark, 9, 3, 12, 30)
    options = Options.preset(preset, sanitize_graph=True, verbose=False, dump_timeline=True)
    want = solver.solve(g, options)
    monkeypatch.setattr(solver, "ONE_TASK", one_task)
    monkeypatch.setattr(E, "SENT_ROWS", sent)

    def none(*_):
        raise AssertionError("a step on frames")

    if sent:
        monkeypatch.setattr(matching, "compress_labels", none)
        monkeypatch.setattr(matching, "best_neighbours", none)
    got = solver.solve(g, replace(options, local_edges=1))
    assert rows(got.labels) == rows(want.labels) and got.iterations == want.iterations > 1
    assert rows(got.timeline) == rows(want.timeline) and got.objective == pytest.approx(want.objective) and got.lower_bound == pytest.approx(want.lower_bound)
    stopped = solver.solve(g, replace(options, local_edges=1, max_time_sec=0, dump_timeline=False))
    assert stopped.iterations >= 1 and stopped.labels.count() == want.labels.count()


def test_forests_of_few_nodes_above_local_edges(spark):
    g = blocks(spark, 9, 2, 12, 30)
    a, b = (solver.solve(g, Options.preset("P", sanitize_graph=True, verbose=False, matching_thresh_crossover_ratio=2.0, local_edges=n, label_gaps=False)) for n in (1, 200_000))
    assert rows(a.labels) == rows(b.labels) and a.objective == b.objective and a.iterations
