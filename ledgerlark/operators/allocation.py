"""Allocation over groups: sums, shares, concentration."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlark.functions.semantics import ratio


def allocation(df: DataFrame, group: str, value: str) -> DataFrame:
    """Sum of `value` by group, its share of all in %, and its ratio to the largest group.

    The grand total joins as one broadcast row, so no window gathers all groups.
    """
    sums = df.groupBy(group).agg(F.sum(value).alias("value"))
    whole = sums.agg(F.sum("value").alias("__all"), F.max("value").alias("__most"))
    both = sums.crossJoin(F.broadcast(whole))
    return both.withColumns({"share_pct": ratio(F.col("value"), F.col("__all")) * 100, "to_largest": ratio(F.col("value"), F.col("__most"))}).drop("__all", "__most")


def largest(df: DataFrame, group: str, n: int) -> DataFrame:
    """The n groups of most value, ties by name."""
    return df.orderBy(F.desc("value"), group).limit(n)


def concentration(df: DataFrame, group: str, n: int = 5) -> DataFrame:
    """What share the n largest groups have together."""
    return largest(df, group, n).agg(F.sum("share_pct").alias("concentration_pct"), F.count(F.lit(1)).alias("n_groups"))
