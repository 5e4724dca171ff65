from cleave.sources.text import read_edges, write_clusters, write_edges

__all__ = ["read_edges", "write_clusters", "write_edges"]
