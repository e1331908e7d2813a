"""Edge lists as text: one ``src<whitespace>dst`` pair per line.

* a line that starts with ``#`` is a comment;
* lines that do not hold exactly two tokens are skipped: blank lines, weighted
  edges, and lines with leading whitespace (whose first token is empty);
  trailing whitespace is ignored;
* a token that is no integer fails the job, or is skipped on request;
* self-loops are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the text format.
COMMENT_PREFIX = "#"
SEPARATOR = r"\s+"
TRAILING_SPACE = r"\s+$"
INTEGER = r"^[+-]?\d+$"


def parse_edge_lines(lines: DataFrame, permissive: bool = False) -> DataFrame:
    """Directed ``(src, dst)`` pairs from a DataFrame with a ``value`` column."""
    tokens = lines.filter(~F.col("value").startswith(COMMENT_PREFIX)).select(
        F.split(F.regexp_replace("value", TRAILING_SPACE, ""), SEPARATOR).alias("token")
    )

    def vertex(position: int):
        # The same with and without ANSI mode: only digits count, and what does not fit 64
        # bits is no integer either. The arity guard stays inside the expression, which may be
        # evaluated before a filter would have removed the line.
        token = F.when(F.size("token") == 2, F.get("token", F.lit(position)))
        number = F.when(token.rlike(INTEGER), token.try_cast("long"))
        if permissive:
            return number
        wrong = F.raise_error(F.concat(F.lit("not a 64-bit integer: "), token)).cast("long")
        return F.when(token.isNull() | number.isNotNull(), number).otherwise(wrong)

    pairs = tokens.filter(F.size("token") == 2).select(
        vertex(0).alias("src"), vertex(1).alias("dst")
    )
    return pairs.filter(F.col("src") != F.col("dst"))


def read_edge_text(
    spark: SparkSession, path: str | list[str], permissive: bool = False
) -> DataFrame:
    """Pairs of any path ``spark.read.text`` accepts: files, folders, globs,
    compressed files, any Hadoop file system."""
    return parse_edge_lines(spark.read.text(path), permissive)
