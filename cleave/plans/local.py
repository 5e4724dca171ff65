"""The solver's steps on arrays, for graphs that fit one process; the same definitions as the DataFrame operators.

Edges are arrays i, j, cost with i < j, unique and in order of (i, j).
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from cleave.functions.expressions import SCHEDULE
from cleave.operators.components import least_reached as components
from cleave.options import Options

Graph = tuple[np.ndarray, np.ndarray, np.ndarray]


class BadContraction(RuntimeError):
    """A contraction that joined what repels more than it attracts."""


def summed(i: np.ndarray, j: np.ndarray, cost: np.ndarray) -> Graph:
    """Canonical edges with the costs of equal ones summed."""
    low, high = np.minimum(i, j), np.maximum(i, j)
    width = int(high.max()) + 1 if len(high) else 1
    order = np.argsort(low * width + high, kind="stable") if width < 1 << 31 else np.lexsort((high, low))
    low, high, cost = low[order], high[order], cost[order]
    if not len(low):
        return low, high, cost
    first = np.flatnonzero(np.r_[True, (low[1:] != low[:-1]) | (high[1:] != high[:-1])])
    return low[first], high[first], np.add.reduceat(cost, first)


def through(labels: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Labels after the clusters 0 to len(to) - 1 were mapped on; others stay."""
    return np.where(labels < len(to), to[np.minimum(labels, len(to) - 1)], labels) if len(to) else labels


def renumbered(labels: np.ndarray) -> np.ndarray:
    """Clusters numbered from 0 in the order of their least node."""
    _, first, at = np.unique(labels, return_index=True, return_inverse=True)
    return ranks(first)[at] if len(labels) else labels


def ranks(values: np.ndarray) -> np.ndarray:
    return np.unique(values, return_inverse=True)[1]


def match(n: int, graph: Graph, multiplier: float) -> tuple[np.ndarray, int]:
    """Each node's cluster (the lower node of its pair) and the count of matched nodes."""
    i, j, c = graph
    label, own = np.arange(n), c[c >= 0]
    if not len(own):
        return label, 0
    threshold = own.mean() * multiplier
    free, before = np.ones(n, bool), 0
    keep = c > threshold
    i, j, c = i[keep], j[keep], c[keep]
    src, dst, cost = np.r_[i, j], np.r_[j, i], np.r_[c, c]
    order = np.lexsort((dst, -cost, src))
    src, dst = src[order], dst[order]
    for _ in range(10):
        keep = free[src] & free[dst]
        src, dst = src[keep], dst[keep]
        first = np.r_[True, src[1:] != src[:-1]] if len(src) else np.zeros(0, bool)
        best = np.full(n, -1)
        best[src[first]] = dst[first]
        node = np.flatnonzero(best >= 0)
        mutual = node[(best[best[node]] == node) & (node < best[node])]
        label[best[mutual]] = mutual
        free[mutual] = free[best[mutual]] = False
        now = int((~free).sum())
        gain, before = (now - before) / (before + 1), now
        if not gain or gain < 0.1:
            break
    return label, before


def spanning_forest(n: int, graph: Graph) -> np.ndarray:
    """Places of the maximum spanning forest's edges under (cost falling, i, j)."""
    i, j, c = graph
    parent = list(range(n))

    def root(a: int) -> int:
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    taken = []
    for k in np.lexsort((j, i, -c)).tolist():
        a, b = root(int(i[k])), root(int(j[k]))
        if a != b:
            parent[max(a, b)] = min(a, b)
            taken.append(k)
    return np.sort(np.array(taken, np.int64))


def _adjacency(n: int, i: np.ndarray, j: np.ndarray, c: np.ndarray) -> list[dict[int, float]]:
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, w in zip(i.tolist(), j.tolist(), c.tolist(), strict=True):
        near[a][b] = w
        near[b][a] = w
    return near


def _path(near: list[dict[int, float]], a: int, b: int, depth: int) -> list[list[int]]:
    """All simple paths of exactly `depth` edges from a to b in a forest: at most one."""
    paths = [[a]]
    for _ in range(depth):
        paths = [[*p, x] for p in paths for x in near[p[-1]] if len(p) < 2 or x != p[-2]]
    return [p for p in paths if p[-1] == b]


def conflict_free_forest(n: int, graph: Graph) -> tuple[np.ndarray, int]:
    """Each node's tree (least node) of the conflict-free forest, and twice the count of its edges."""
    i, j, c = graph
    joining = c > 0
    at = spanning_forest(n, (i[joining], j[joining], c[joining]))
    if not len(at):
        return np.arange(n), 0
    fi, fj, fc = i[joining][at], j[joining][at], c[joining][at]
    ri, rj = i[~joining], j[~joining]

    def within() -> None:
        nonlocal ri, rj
        label = components(n, fi, fj)
        same = label[ri] == label[rj]
        ri, rj = ri[same], rj[same]

    def remove(gone: set[tuple[int, int]]) -> None:
        nonlocal fi, fj, fc
        keep = np.array([(a, b) not in gone for a, b in zip(fi.tolist(), fj.tolist(), strict=True)], bool)
        fi, fj, fc = fi[keep], fj[keep], fc[keep]
        within()

    edge = lambda a, b: (min(a, b), max(a, b))
    within()
    near, gone = _adjacency(n, fi, fj, fc), set()
    for a, b in zip(ri.tolist(), rj.tolist(), strict=True):
        for m in near[a].keys() & near[b].keys():
            gone.add(edge(a, m) if near[a][m] < near[b][m] else edge(b, m))
    if gone:
        remove(gone)
    near, gone = _adjacency(n, fi, fj, fc), set()
    for a, b in zip(ri.tolist(), rj.tolist(), strict=True):
        for _, x, m, _ in _path(near, a, b, 3):
            c1, c2, c3 = near[a][x], near[x][m], near[m][b]
            gone.add(edge(a, x) if c1 < c2 and c1 < c3 else edge(x, m) if c2 < c3 else edge(b, m))
    if gone:
        remove(gone)

    # Two frontiers that walk a forest from both ends of a repulsive edge meet when their steps add up to the length of the path between
    # them, which is unique; so lengths replace the walk, and only paths that are due are looked at.
    def rooted() -> tuple[np.ndarray, list[int], list[int]]:
        near = _adjacency(n, fi, fj, fc)
        parent, depth = [-1] * n, [-1] * n
        for start in range(n):
            if depth[start] < 0:
                depth[start], stack = 0, [start]
                while stack:
                    a = stack.pop()
                    for b in near[a]:
                        if depth[b] < 0:
                            parent[b], depth[b] = a, depth[a] + 1
                            stack.append(b)
        lengths = np.array([len(p) - 1 for p in (tree_path(parent, depth, a, b) for a, b in zip(ri.tolist(), rj.tolist(), strict=True))], np.int64)
        return lengths, parent, depth

    def due(steps_i: int, steps_j: int) -> set[tuple[int, int]]:
        """The bottleneck of each path of steps_i + steps_j edges: the cheapest on each side, the older of equal ones; then the cheaper, of equal ones that of j."""
        cost = {edge(a, b): w for a, b, w in zip(fi.tolist(), fj.tolist(), fc.tolist(), strict=True)}
        out = set()
        for k in np.flatnonzero(lengths == steps_i + steps_j).tolist():
            path = tree_path(parent, depth, int(ri[k]), int(rj[k]))
            steps = [edge(a, b) for a, b in zip(path, path[1:], strict=False)]
            one = min(steps[:steps_i], key=cost.__getitem__)
            two = min(reversed(steps[steps_i:]), key=cost.__getitem__, default=None)
            out.add(one if two is None or cost[one] < cost[two] else two)
        return out

    passes = 0
    lengths, parent, depth = rooted()
    steps_i = steps_j = 0
    while len(ri) and len(fi):
        if passes % 5 == 0:
            keep = fc >= 0.9 * fc[fc >= 0].mean()
            if not keep.all():
                fi, fj, fc = fi[keep], fj[keep], fc[keep]
                within()
                (lengths, parent, depth), steps_i, steps_j = rooted(), 0, 0
                if not len(ri) or not len(fi):
                    break
        for first in (True, False):
            steps_i, steps_j = steps_i + first, steps_j + (not first)
            gone = due(steps_i, steps_j) if (lengths == steps_i + steps_j).any() else set()
            if gone:
                remove(gone)
                (lengths, parent, depth), steps_i, steps_j = rooted(), 0, 0
            if not len(ri) or not len(fi):
                break
        passes += 1
    return components(n, fi, fj), 2 * len(fi)


def tree_path(parent: list[int], depth: list[int], a: int, b: int) -> list[int]:
    """Nodes of the path between two nodes of one rooted tree."""
    up, down = [a], [b]
    while a != b:
        if depth[a] >= depth[b]:
            a = parent[a]
            up.append(a)
        else:
            b = parent[b]
            down.append(b)
    return up[:-1] + down[::-1] if up[-1] == down[-1] else up + down[::-1]


def triangles(graph: Graph, longest: int, ratio: float = 1e-4, budget: int | None = None) -> np.ndarray:
    """Rows (a, b, c) of conflicted cycles of 3 to `longest` edges; longer ones only while the budget isn't filled, then the strongest."""
    i, j, c = graph
    empty = np.zeros((0, 3), np.int64)
    if longest < 3 or not len(c):
        return empty
    tol = c.min() * ratio
    plus, minus = c > -tol, c < tol
    if not plus.any() or not minus.any():
        return empty
    near: dict[int, set[int]] = {}
    for a, b in zip(i[plus].tolist(), j[plus].tolist(), strict=True):
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    rep = [(a, b) for a, b in zip(i[minus].tolist(), j[minus].tolist(), strict=True) if a in near and b in near]
    out: set[tuple[int, int, int]] = set()

    def add(a: int, b: int, c: int) -> None:
        if a != b and a != c and b != c:
            out.add(tuple(sorted((a, b, c))))

    for a, b in rep:
        for m in near[a] & near[b]:
            add(a, b, m)
    if longest >= 4 and (budget is None or len(out) < budget):
        for a, b in rep:
            for x in near[a]:
                for m in near[x] & near[b]:
                    add(a, b, x)
                    add(b, x, m)
    if longest >= 5 and (budget is None or len(out) < budget):
        for a, b in rep:
            for x in near[a]:
                for q in near[b]:
                    if q != x:
                        for m in near[x] & near[q]:
                            add(a, b, x)
                            add(b, x, m)
                            add(b, m, q)
    found = np.array(sorted(out), np.int64).reshape(-1, 3)
    if budget is None or len(found) <= budget:
        return found
    cost = {(a, b): abs(w) for a, b, w in zip(i.tolist(), j.tolist(), c.tolist(), strict=True)}
    strength = np.array([min(cost.get((a, b), 0.0), cost.get((a, c), 0.0), cost.get((b, c), 0.0)) for a, b, c in found.tolist()])
    best = np.argsort(-strength, kind="stable")[:budget]  # rows are in order of their corners already
    return found[np.sort(best)]


def _marginal(x: np.ndarray, y: np.ndarray, z: np.ndarray) -> np.ndarray:
    return np.minimum(np.minimum(x + y + z, x + y), x + z) - np.minimum(0, y + z)


def bound(cost: np.ndarray, tri: list[np.ndarray]) -> float:
    a, b, c = tri
    of_tri = np.minimum.reduce([np.zeros_like(a), a + b, a + c, b + c, a + b + c]) if len(a) else a
    return float(np.minimum(cost, 0).sum() + of_tri.sum())


def dual_update(graph: Graph, longest: int, steps: int, ratio: float = 1e-4, budget: float | None = None) -> tuple[Graph, float, int]:
    """Messages over triangles: new edges, bound, count of triangles. budget: triangles a repulsive edge at most."""
    i, j, cost = graph
    tri = triangles(graph, longest, ratio, None if budget is None else int(budget * int((cost < 0).sum())))
    if not len(tri):
        return graph, float(np.minimum(cost, 0).sum()), 0
    m = len(tri)
    si, sj = np.r_[tri[:, 0], tri[:, 0], tri[:, 1]], np.r_[tri[:, 1], tri[:, 2], tri[:, 2]]
    i, j, cost = summed(np.r_[i, si], np.r_[j, sj], np.r_[cost, np.zeros(3 * m)])
    width = int(max(j.max(), i.max())) + 1
    side = np.searchsorted(i * width + j, si * width + sj)
    count = np.bincount(side, minlength=len(i))
    state = {name: np.zeros(m) for name in ("c12", "c13", "c23")}
    before = 0.0
    for k in range(steps):
        now = bound(cost, list(state.values()))
        if k > 0 and now - before < 1e-3:
            break
        share = (cost / np.maximum(count, 1))[side]
        cost = np.where(count > 0, 0.0, cost)
        given = np.zeros(3 * m)
        for p, name in enumerate(state):
            state[name] = state[name] + share[p * m : (p + 1) * m]
        for name, part in SCHEDULE:
            y, z = (state[x] for x in state if x != name)
            d = _marginal(state[name], y, z) * part
            state[name] = state[name] - d
            p = list(state).index(name)
            given[p * m : (p + 1) * m] += d
        cost = cost + np.bincount(side, given, len(i))
        before = now
    return (i, j, cost), bound(cost, list(state.values())), m


def dual(graph: Graph, longest: int, steps: int, outer: int, ratio: float = 1e-4, budget: float | None = None) -> tuple[Graph, float]:
    if longest < 3 or not steps or not outer:
        return graph, float(np.minimum(graph[2], 0).sum())
    now = before = 0.0
    for k in range(outer):
        n = 0
        for length in range(3, longest + 1):
            graph, now, n = dual_update(graph, length, steps, ratio, budget)
        if not n or k > 0 and now - before < 1e-3:
            break
        before = now
    return graph, now


def primal(graph: Graph, n: int, options: Options, by_matching: bool, first: bool, late: Callable[[], bool], tell: Callable) -> list[np.ndarray]:
    """The cluster of each id 0 to n - 1 after each contraction of the solver's loop."""
    o, total, steps = options, np.arange(n), []
    while len(graph[0]):
        if not first:
            graph, _ = dual(graph, o.max_cycle_length_primal, o.num_dual_itr_primal, 1, budget=1.0 if o.triangle_budget else None)
        if by_matching:
            label, count = match(n, graph, o.mean_multiplier_mm)
            by_matching = count >= (int(graph[0].max()) + 1) * o.matching_thresh_crossover_ratio
        else:
            label, count = conflict_free_forest(n, graph)
        tell("%d to contract of %d edges", count, len(graph[0]))
        if not count:
            break
        label = ranks(label)
        i, j, cost = summed(label[graph[0]], label[graph[1]], graph[2])
        if (cost[i == j] < 0).any():
            raise BadContraction("a contraction joined what repels")
        n = int(j.max()) + 1
        graph = i[i != j], j[i != j], cost[i != j]
        total = through(total, label)
        steps.append(total)
        first = False
        if late():
            break
    return steps
