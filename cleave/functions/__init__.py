from cleave.functions.expressions import edge_bound, min_marginal, sorted_corners, triangle_bound

__all__ = ["edge_bound", "min_marginal", "sorted_corners", "triangle_bound"]
