from cleave.plans.solver import Result, solve

__all__ = ["Result", "solve"]
