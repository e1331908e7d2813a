"""Edge lists from text files and graphs derived from ordinary tables."""

from knitgraph.sources.edge_text import parse_edge_lines, read_edge_text
from knitgraph.sources.tables import (
    GRAPHS,
    customer_graph,
    event_graph,
    order_graph,
    shipment_graph,
    user_graph,
)

__all__ = [
    "GRAPHS",
    "customer_graph",
    "event_graph",
    "order_graph",
    "parse_edge_lines",
    "read_edge_text",
    "shipment_graph",
    "user_graph",
]
