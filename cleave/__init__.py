"""Clustering of signed graphs on Spark: `cleave.solve(edges, cleave.Options.preset("PD"))`."""

from __future__ import annotations

#: Names of the facade and the modules that have them; they are imported when first asked for, as Python workers import this package too.
_FACADE = {
    "Options": "cleave.options",
    "Result": "cleave.plans.solver",
    "solve": "cleave.plans.solver",
    "read_edges": "cleave.sources.text",
    "write_clusters": "cleave.sources.text",
    "write_edges": "cleave.sources.text",
    "session": "cleave.session",
}
__all__ = sorted(_FACADE)


def __getattr__(name: str):
    import importlib

    if name in _FACADE:
        return getattr(importlib.import_module(_FACADE[name]), name)
    raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
