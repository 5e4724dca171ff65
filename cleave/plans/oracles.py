"""DuckDB SQL for the clustering queries, written from the operators' definitions and independent of their DataFrame plans."""

from __future__ import annotations

_GRAPH = """
sup_pairs AS MATERIALIZED (SELECT DISTINCT l_orderkey AS o, l_suppkey AS s FROM lineitem),
sup_c AS MATERIALIZED (SELECT x.s AS i, y.s AS j, count(*) AS c FROM sup_pairs x JOIN sup_pairs y ON x.o = y.o AND x.s < y.s GROUP BY 1, 2),
gs AS MATERIALIZED (SELECT i, j, (c - floor((SELECT avg(c) FROM sup_c)))::DOUBLE AS cost FROM sup_c),
{0}"""

#: Orders of one customer at most 180 days apart.
_ORDERS = """g AS MATERIALIZED (SELECT x.o_orderkey AS i, y.o_orderkey AS j, (3 - floor(abs(x.o_totalprice - y.o_totalprice) / 50000.0))::DOUBLE AS cost
  FROM orders x JOIN orders y ON x.o_custkey = y.o_custkey AND x.o_orderkey < y.o_orderkey WHERE abs(date_diff('day', x.o_orderdate, y.o_orderdate)) <= 180)"""


def query(body: str, *parts: str) -> str:
    return "WITH RECURSIVE " + ",\n".join([_GRAPH.strip().replace("{0}", _ORDERS), *[p.strip().rstrip(",") for p in parts]]) + "\n" + body


def whole(sql: str) -> str:
    """The same SQL with the suppliers graph as g."""
    assert sql.count(_ORDERS) == 1
    return sql.replace(_ORDERS, "g AS MATERIALIZED (SELECT i, j, cost FROM gs)")


def both_ways(edges: str, out: str) -> str:
    return f"{out} AS MATERIALIZED (SELECT i AS src, j AS dst, cost FROM {edges} UNION ALL SELECT j, i, cost FROM {edges})"


def cycles(edges: str, longest: int, p: str, shortest: int = 3) -> str:
    """CTEs that end in {p}tri(a, b, c)."""
    raw = {
        3: f"SELECT r.i AS a, r.j AS b, x.d AS c FROM {p}rep r JOIN {p}near x ON x.s = r.i JOIN {p}near y ON y.s = r.j AND y.d = x.d",
        4: f"SELECT unnest([r.i, r.j]) AS a, unnest([r.j, n.d]) AS b, unnest([n.d, m.d]) AS c FROM {p}rep r JOIN {p}near n ON n.s = r.i JOIN {p}near m ON m.s = n.d JOIN {p}near z ON z.s = m.d AND z.d = r.j",
        5: f"SELECT unnest([r.i, r.j, r.j]) AS a, unnest([r.j, n.d, m.d]) AS b, unnest([n.d, m.d, q.d]) AS c FROM {p}rep r JOIN {p}near n ON n.s = r.i JOIN {p}near m ON m.s = n.d"
        f" JOIN {p}near q ON q.s = m.d JOIN {p}near z ON z.s = q.d AND z.d = r.j WHERE n.d <> q.d",
    }
    return f"""
{p}tol AS MATERIALIZED (SELECT min(cost) * 1e-4 AS tol FROM {edges}),
{p}near AS MATERIALIZED (SELECT i AS s, j AS d FROM {edges}, {p}tol WHERE cost > -tol UNION ALL SELECT j, i FROM {edges}, {p}tol WHERE cost > -tol),
{p}rep AS MATERIALIZED (SELECT i, j FROM {edges}, {p}tol WHERE cost < tol),
{p}raw AS ({" UNION ALL ".join(raw[k] for k in range(shortest, longest + 1))}),
{p}tri AS MATERIALIZED (SELECT DISTINCT t[1] AS a, t[2] AS b, t[3] AS c FROM (SELECT list_sort([a, b, c]) AS t FROM {p}raw WHERE a <> b AND a <> c AND b <> c))"""


_MIN_MARGINAL = "(least({0} + {1} + {2}, {0} + {1}, {0} + {2}) - least(0.0, {1} + {2}))"
_TURNS = [("x", "y", "z", "/ 3.0"), ("y", "x", "z", "/ 2.0"), ("z", "x", "y", ""), ("x", "y", "z", "/ 2.0"), ("y", "x", "z", ""), ("x", "y", "z", "")]


def dual_start(edges: str, tri: str, p: str) -> str:
    return f"""
{p}side AS MATERIALIZED (SELECT a AS i, b AS j FROM {tri} UNION ALL SELECT a, c FROM {tri} UNION ALL SELECT b, c FROM {tri}),
{p}count AS MATERIALIZED (SELECT i, j, count(*) AS n FROM {p}side GROUP BY 1, 2),
{p}e0 AS MATERIALIZED (SELECT coalesce(e.i, k.i) AS i, coalesce(e.j, k.j) AS j, coalesce(e.cost, 0.0) AS cost, coalesce(k.n, 0) AS n FROM {edges} e FULL JOIN {p}count k ON e.i = k.i AND e.j = k.j),
{p}t0 AS MATERIALIZED (SELECT a, b, c, 0.0::DOUBLE AS x, 0.0::DOUBLE AS y, 0.0::DOUBLE AS z FROM {tri}),
{bound(p, 0)}"""


def bound(p: str, k: int) -> str:
    return f"{p}l{k} AS MATERIALIZED (SELECT coalesce((SELECT sum(least(cost, 0.0)) FROM {p}e{k}), 0.0) + coalesce((SELECT sum(least(0.0, x + y, x + z, y + z, x + y + z)) FROM {p}t{k}), 0.0) AS lb)"


def dual_down(p: str, k: int) -> str:
    """Edges give to triangles: {p}r{k}."""
    o = k - 1
    return f"""
{p}r{k} AS MATERIALIZED (SELECT t.a, t.b, t.c, t.x + u.cost / u.n AS x, t.y + v.cost / v.n AS y, t.z + w.cost / w.n AS z FROM {p}t{o} t
  JOIN {p}e{o} u ON u.i = t.a AND u.j = t.b JOIN {p}e{o} v ON v.i = t.a AND v.j = t.c JOIN {p}e{o} w ON w.i = t.b AND w.j = t.c)"""


def dual_up(p: str, k: int) -> str:
    """Triangles give back in six turns: {p}t{k}, {p}e{k}, {p}l{k}."""
    out, last = [], f"(SELECT *, 0.0::DOUBLE AS dx, 0.0::DOUBLE AS dy, 0.0::DOUBLE AS dz FROM {p}r{k})"
    for n, (s, q, r, share) in enumerate(_TURNS):
        rest = ", ".join(f"{v}, d{v}" for v in "xyz" if v != s)
        out.append(f"{p}u{k}_{n} AS MATERIALIZED (SELECT a, b, c, {s} - m AS {s}, d{s} + m AS d{s}, {rest} FROM (SELECT *, {_MIN_MARGINAL.format(s, q, r)} {share} AS m FROM {last}))")
        last = f"{p}u{k}_{n}"
    out.append(f"{p}t{k} AS MATERIALIZED (SELECT a, b, c, x, y, z FROM {last})")
    given = f"SELECT i, j, sum(d) AS d FROM (SELECT a AS i, b AS j, dx AS d FROM {last} UNION ALL SELECT a, c, dy FROM {last} UNION ALL SELECT b, c, dz FROM {last}) GROUP BY 1, 2"
    out.append(f"{p}e{k} AS MATERIALIZED (SELECT e.i, e.j, CASE WHEN e.n > 0 THEN 0.0 ELSE e.cost END + coalesce(q.d, 0.0) AS cost, e.n FROM {p}e{k - 1} e LEFT JOIN ({given}) q ON q.i = e.i AND q.j = e.j)")
    out.append(bound(p, k))
    return ",\n".join(out)


def dual_update(edges: str, longest: int, steps: int, p: str) -> str:
    """CTEs of up to `steps` iterations with the stop rule; they end in {p}edges and {p}final(lb, n_tri)."""
    parts = [cycles(edges, longest, p), dual_start(edges, f"{p}tri", p)]
    for k in range(1, steps + 1):
        parts += [dual_down(p, k), dual_up(p, k)]
    stop = " ".join(f"WHEN (SELECT lb FROM {p}l{k}) - (SELECT lb FROM {p}l{k - 1}) < 1e-3 THEN {k}" for k in range(1, steps))
    parts.append(f"{p}stop AS MATERIALIZED (SELECT CASE {stop} ELSE {steps} END AS k)" if stop else f"{p}stop AS (SELECT {steps} AS k)")
    parts.append(f"{p}edges AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT i, j, cost FROM {p}e{k} WHERE (SELECT k FROM {p}stop) = {k}" for k in range(1, steps + 1)) + ")")
    parts.append(f"{p}final AS MATERIALIZED (SELECT l.lb, (SELECT count(*) FROM {p}tri) AS n_tri FROM (" + " UNION ALL ".join(f"SELECT {k} AS k, lb FROM {p}l{k}" for k in range(1, steps + 1)) + f") l WHERE l.k = (SELECT k FROM {p}stop))")
    return ",\n".join(x.strip().rstrip(",") for x in parts)


def components(nodes: str, edges: str, p: str) -> str:
    """{p}cc(node, component) over the graph of `edges`; nodes has a column node."""
    return f"""
{p}links AS MATERIALIZED (SELECT i AS s, j AS d FROM {edges} UNION ALL SELECT j, i FROM {edges}),
{p}reach(a, b) AS (SELECT node, node FROM {nodes} UNION SELECT r.a, l.d FROM {p}reach r JOIN {p}links l ON l.s = r.b),
{p}cc AS MATERIALIZED (SELECT a AS node, min(b) AS component FROM {p}reach GROUP BY 1)"""


#: The maximum spanning forest of the positive edges of g: those whose ends no path of earlier edges (cost falling, i, j) joins.
FOREST = """
gnodes AS MATERIALIZED (SELECT DISTINCT unnest([i, j]) AS node FROM g),
plus AS MATERIALIZED (SELECT i, j, cost FROM g WHERE cost > 0),
minus AS MATERIALIZED (SELECT i, j FROM g WHERE cost <= 0),
turns AS MATERIALIZED (SELECT i, j, cost, row_number() OVER (ORDER BY cost DESC, i, j) AS k FROM plus),
steps AS MATERIALIZED (SELECT i AS s, j AS d, k FROM turns UNION ALL SELECT j, i, k FROM turns),
early(k, node) AS (SELECT k, i FROM turns UNION SELECT w.k, t.d FROM early w JOIN steps t ON t.s = w.node AND t.k < w.k),
forest AS MATERIALIZED (SELECT i, j, cost FROM turns t WHERE NOT EXISTS (SELECT 1 FROM early w WHERE w.k = t.k AND w.node = t.j)),
fs AS MATERIALIZED (SELECT i AS src, j AS dst, cost FROM forest UNION ALL SELECT j, i, cost FROM forest)"""


def matching(edges: str, multiplier: float, rounds: int, p: str) -> str:
    """{p}pairs(low, high) of up to `rounds` rounds."""
    out = [
        f"{p}thr AS MATERIALIZED (SELECT coalesce(avg(cost) FILTER (WHERE cost >= 0) * {multiplier}, -1.0) AS t FROM {edges})",
        f"{p}f0 AS MATERIALIZED (SELECT i, j, cost FROM {edges}, {p}thr WHERE cost > t AND t >= 0)",
        f"{p}c0 AS MATERIALIZED (SELECT 0::BIGINT AS c, true AS go)",
    ]
    for r in range(1, rounds + 1):
        o = r - 1
        out += [
            f"{p}b{r} AS MATERIALIZED (SELECT src, dst FROM (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY cost DESC, dst) AS k FROM (SELECT i AS src, j AS dst, cost FROM {p}f{o} UNION ALL SELECT j, i, cost FROM {p}f{o})) WHERE k = 1)",
            f"{p}p{r} AS MATERIALIZED (SELECT x.src AS low, x.dst AS high FROM {p}b{r} x JOIN {p}b{r} y ON y.src = x.dst AND y.dst = x.src WHERE x.src < x.dst AND (SELECT go FROM {p}c{o}))",
            f"{p}c{r} AS MATERIALIZED (SELECT now AS c, go AND now > c AND (now - c) / (c + 1.0) >= 0.1 AS go FROM (SELECT c, go, c + 2 * (SELECT count(*) FROM {p}p{r}) AS now FROM {p}c{o}))",
            f"{p}f{r} AS MATERIALIZED (SELECT f.* FROM {p}f{o} f WHERE NOT EXISTS (SELECT 1 FROM {p}p{r} q WHERE f.i IN (q.low, q.high) OR f.j IN (q.low, q.high)))",
        ]
    out.append(f"{p}pairs AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT low, high FROM {p}p{r}" for r in range(1, rounds + 1)) + ")")
    return ",\n".join(out)
