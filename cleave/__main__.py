"""python -m cleave -f EDGES [-o CLUSTERS]: solve an edge list, print cost, bound and time, and write the clusters."""

from __future__ import annotations

import logging

from cleave.options import from_arguments
from cleave.plans.solver import solve
from cleave.session import session
from cleave.sources.text import read_edges, write_clusters


def main(argv: list[str] | None = None) -> int:
    options = from_arguments(argv)
    logging.basicConfig(level=logging.INFO, format="%(message)s")
    logging.getLogger("py4j").setLevel(logging.WARNING)
    spark = session()
    found = solve(read_edges(spark, options.input_file), options)
    if found.objective is not None:
        print(f"cost: {found.objective}")
    print(f"lower bound: {found.lower_bound}")
    print(f"time: {found.elapsed_ms:.0f} ms")
    if options.output_sol_file and found.labels is not None:
        write_clusters(found.labels, options.output_sol_file)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
