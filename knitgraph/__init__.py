"""Cohesive-subgraph analytics on undirected graphs, as Spark jobs."""
