"""Totals over all groups next to every group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def grand_totals(groups: DataFrame, *columns: str) -> Column:
    """One struct with the sum of each column over all groups, and their number as ``groups``.

    A scalar subquery, so no task sees all groups. Name every aggregated column
    the query uses: its aggregate and the subquery's are then the same, and the
    grouped shuffle is read twice instead of being computed twice.
    """
    sums = (F.sum(c).alias(c) for c in columns)
    return groups.agg(F.struct(F.count(F.lit(1)).alias("groups"), *sums)).scalar()
