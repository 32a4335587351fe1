"""Joins on a key of which a few values, or null, hold much of the rows.

An ordinary shuffled join sends all rows of a key to one task. AQE splits such a task
when the join allows it; here the split is in the plan:

* Rows without a key match nothing and are not shuffled at all.
* Keys with more than a partition's fair share of the rows are found by a
  frequent-items sketch in one pass over the key column. There are fewer of them than
  partitions. Each is cut into as many parts as fair shares it holds: its rows carry a
  part drawn from their own hash, and its dimension rows are repeated for each part, so all
  repetitions together are at most twice the partitions.
* Everything else joins as ever, in the same shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_KEYS = 10_000  # asked of the sketch
PART, OTHER = "join_part", "join_key"


def heavy_keys(facts: DataFrame, key: str, partitions: int | None = None) -> dict:
    """Keys with more than a partition's share of the rows with a key, and into how many parts to cut them."""
    partitions = partitions or int(facts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    k = min(partitions, MOST_KEYS)
    top = F.expr(f"approx_top_k(`{key}`, {k}, {max(10 * k, 1000)})")
    found = facts.where(F.col(key).isNotNull()).agg(F.count(F.lit(1)).alias("n"), top.alias("top")).first()
    share = found.n / partitions
    return {row["item"]: math.ceil(row["count"] / share) for row in found.top or () if row["count"] > share}


def _parts(key: Column, heavy: Mapping, otherwise: int = 1) -> Column:
    """Into how many parts a key is cut."""
    if not heavy:
        return F.lit(otherwise)
    cut = F.create_map(*(F.lit(x) for pair in heavy.items() for x in pair))
    return F.coalesce(F.try_element_at(cut, key), F.lit(otherwise))


def spread_join(
    facts: DataFrame, dimension: DataFrame, key: str, how: str = "left", heavy: Mapping | None = None
) -> DataFrame:
    """``facts`` joined to ``dimension`` on ``key``, ``how`` being left or inner; columns as of an ordinary join.

    ``heavy`` are the keys to cut and their parts, looked up in ``facts`` by default. Which they are decides
    only where rows go, never what is joined.
    """
    if how not in ("left", "inner"):
        raise ValueError(f"left or inner, not {how}")
    heavy = heavy_keys(facts, key) if heavy is None else heavy
    # A row's own hash: a task that runs again sends its rows where it sent them before.
    part = F.pmod(F.xxhash64(*(F.col(f"`{c}`") for c in facts.columns)), _parts(F.col(key), heavy).cast("long"))
    keyed = facts.where(F.col(key).isNotNull()).withColumn(PART, part.cast("int"))
    repeated = F.sequence(F.lit(0), _parts(F.col(key), heavy) - F.lit(1))
    others = dimension.where(F.col(key).isNotNull()).withColumn(PART, F.explode(repeated))
    joined = keyed.join(others, [key, PART], how).drop(PART)
    if how == "inner":
        return joined
    rest = facts.where(F.col(key).isNull())
    added = [f for f in dimension.schema if f.name != key]
    rest = rest.select(
        key, *(c for c in facts.columns if c != key), *(F.lit(None).cast(f.dataType).alias(f.name) for f in added)
    )
    return joined.unionByName(rest) if len(set(joined.columns)) == len(joined.columns) else joined.union(rest)
