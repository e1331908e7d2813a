"""Built-in column expressions only; nothing here leaves whole-stage codegen
except the array rendering used by report queries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def smaller_id(left: str, right: str) -> Column:
    return F.least(F.col(left), F.col(right))


def larger_id(left: str, right: str) -> Column:
    return F.greatest(F.col(left), F.col(right))


def middle_id(first: str, second: str, third: str) -> Column:
    """The median of three ids, without arithmetic that could overflow."""
    return F.greatest(
        smaller_id(first, second),
        F.least(larger_id(first, second), F.col(third)),
    )


def edge_heads_up(src: str, src_degree: str, dst: str, dst_degree: str) -> Column:
    """True if ``dst`` follows ``src`` in the order (degree, id)."""
    return F.struct(F.col(dst_degree), F.col(dst)) > F.struct(F.col(src_degree), F.col(src))


def joined_ids(ids: str) -> Column:
    """An array of ids as text, for reports that compare arrays."""
    return F.array_join(F.col(ids).cast("array<string>"), ",")
