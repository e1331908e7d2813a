"""Makes this package importable in the Python workers of every executor."""

from knitgraph.plans.ship import ship

__all__ = ["ship"]
