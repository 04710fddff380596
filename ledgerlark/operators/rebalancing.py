"""From weights to shares, and from one week's shares to the next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlark.functions.semantics import ratio


def sized(weights: DataFrame, prices: DataFrame, capital: float, on: str = "ticker") -> DataFrame:
    """Whole shares that a weight of the capital buys at the execution price; without a price null."""
    bought = F.floor(ratio(F.col("weight") * capital, F.col("exec_price")))
    return weights.join(prices, on, "left").withColumn("shares", bought.cast("bigint"))


def trades_between(before: DataFrame, after: DataFrame, on: str = "ticker") -> DataFrame:
    """What leads from one set of positions to another: ticker, action, shares. Unchanged positions are left out."""
    mark = lambda df, x: df.select(on, "shares", F.lit(x).alias("is_before"))
    return trades_of(mark(before, True).unionByName(mark(after, False)), F.col("is_before"), on)


def trades_of(positions: DataFrame, is_before: Column, on: str = "ticker") -> DataFrame:
    """trades_between() for positions of one table, of which a condition tells those before: one scan and one aggregation."""
    change = F.sum(F.when(is_before, -F.col("shares")).otherwise(F.col("shares")))
    moved = positions.groupBy(on).agg(change.alias("change")).filter("change <> 0")
    return moved.select(on, F.when(F.col("change") > 0, "BUY").otherwise("SELL").alias("action"), F.abs("change").alias("shares"))


def after_trades(positions: DataFrame, trades: DataFrame, on: str = "ticker") -> DataFrame:
    """Positions after trades; those that are sold out are gone."""
    signed = trades.select(on, F.when(F.col("action") == "SELL", -F.col("shares")).otherwise(F.col("shares")).alias("shares"))
    return positions.select(on, "shares").unionByName(signed).groupBy(on).agg(F.sum("shares").alias("shares")).filter("shares <> 0")
