"""Column expressions shared by the operators."""

from knitgraph.functions.columns import (
    edge_heads_up,
    joined_ids,
    larger_id,
    middle_id,
    smaller_id,
)

__all__ = ["edge_heads_up", "joined_ids", "larger_id", "middle_id", "smaller_id"]
