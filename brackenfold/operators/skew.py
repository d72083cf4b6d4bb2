"""Joins that stay balanced when one key holds a large part of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with more rows than this on the large side is looked up by broadcast.
#: At most (rows of the large side) / HOT_ROWS such keys exist, 10^5 for 10^11
#: rows: some MB of numbers, or 30 MB where a row carries a list of neighbours.
HOT_ROWS = 1_000_000


def lookup_join(large: DataFrame, small: DataFrame, keys: list[str], rows: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Inner join of ``large`` with ``small``, whose keys are unique.

    ``small[rows]`` is the number of rows of ``large`` that have the key. Keys
    beyond ``hot_rows`` are broadcast, so their rows never meet in one task; the
    rest is an ordinary shuffle join in which no group exceeds ``hot_rows``.
    The column ``rows`` isn't in the result.
    """
    hot = small.where(F.col(rows) > hot_rows).drop(rows)
    cold = small.where(F.col(rows) <= hot_rows).drop(rows)
    return large.join(cold, keys).unionByName(large.join(F.broadcast(hot), keys))
