"""Solver settings, presets and the command line's arguments."""

from __future__ import annotations

import argparse
from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class Options:
    """Settings of `cleave.plans.solver.solve`.

    label_gaps: when sanitizing, also ids without an edge, up to the greatest, get a row (cluster -1); turn off for ids that are far apart.
    local_edges: from this many edges down, the rest of a solve runs in one process (0: always as DataFrames).
    triangle_budget: keep at most tri_memory_factor triangles for each repulsive edge, the strongest; else all. Chords of long cycles
    make the graph denser with every dual pass, so repeated passes need it.
    """

    input_file: str = ""
    output_sol_file: str = ""
    max_cycle_length_lb: int = 5
    num_dual_itr_lb: int = 10
    max_cycle_length_primal: int = 3
    num_dual_itr_primal: int = 5
    num_outer_itr_dual: int = 1
    mean_multiplier_mm: float = 0.05
    matching_thresh_crossover_ratio: float = 0.05
    tri_memory_factor: float = 2.0
    only_compute_lb: bool = False
    max_time_sec: int = -1
    dump_timeline: bool = False
    verbose: bool = True
    sanitize_graph: bool = False
    label_gaps: bool = True
    triangle_budget: bool = True
    local_edges: int = 200_000

    def __post_init__(self) -> None:
        for name in ("max_cycle_length_lb", "max_cycle_length_primal"):
            if not 0 <= getattr(self, name) <= 5:
                raise ValueError(f"{name} must be from 0 to 5")
        for name in ("num_dual_itr_lb", "num_dual_itr_primal", "num_outer_itr_dual", "mean_multiplier_mm", "matching_thresh_crossover_ratio", "local_edges"):
            if getattr(self, name) < 0:
                raise ValueError(f"{name} must not be negative")
        if self.tri_memory_factor <= 0:
            raise ValueError("tri_memory_factor must be positive")

    @classmethod
    def preset(cls, name: str, **changes) -> Options:
        """`PD` (primal and dual), `P` (primal only), `PD+` (longer cycles in the primal) or `D` (lower bound only)."""
        if name not in PRESETS:
            raise ValueError(f"no preset {name!r}; there are {', '.join(PRESETS)}")
        return replace(cls(), **PRESETS[name] | changes)


PRESETS = {
    "PD": {},
    "P": {"max_cycle_length_lb": 0, "num_dual_itr_lb": 0, "max_cycle_length_primal": 0, "num_dual_itr_primal": 0},
    "PD+": {"max_cycle_length_lb": 5, "num_dual_itr_lb": 10, "max_cycle_length_primal": 5, "num_dual_itr_primal": 10},
    "D": {"max_cycle_length_lb": 5, "num_dual_itr_lb": 10, "num_outer_itr_dual": 5, "only_compute_lb": True},
}


def from_arguments(argv: list[str] | None = None) -> Options:
    """Options of a command line; a wrong value ends the program with argparse's message."""
    parser = argparse.ArgumentParser(prog="cleave", description="Cluster a signed graph and bound the optimum.")
    parser.add_argument("--preset", choices=list(PRESETS), default="PD")
    parser.add_argument("-f", "--file", required=True, help="edge list with a MULTICUT header")
    parser.add_argument("-o", "--output_sol_file")
    kinds = {f.name: f.type for f in fields(Options)}
    for name in kinds:
        if name in ("input_file", "output_sol_file"):
            continue
        if kinds[name] == "bool":
            parser.add_argument(f"--{name}", action=argparse.BooleanOptionalAction, default=None)
        else:
            parser.add_argument(f"--{name}", type=float if kinds[name] == "float" else int)
    found = vars(parser.parse_args(argv))
    preset, path, out = found.pop("preset"), found.pop("file"), found.pop("output_sol_file")
    try:
        return Options.preset(preset, input_file=path, output_sol_file=out or "", **{k: v for k, v in found.items() if v is not None})
    except ValueError as e:
        parser.error(str(e))
