"""Positions: cost, value, return, and what a portfolio adds up to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlark.functions.semantics import cents, if_set, ratio, round_half_up


def priced() -> Column:
    """Both price and value are known."""
    return F.col("current_price").isNotNull() & F.col("current_investment").isNotNull()


def unpriced() -> Column:
    """The price is null. A price of 0 is neither priced nor unpriced."""
    return F.col("current_price").isNull()


def derived(raw: DataFrame) -> DataFrame:
    """entry_price, current_price and shares, with initial_investment, current_investment and delta (return in %).

    Value and return are null where the price is missing or 0; so is a return of
    exactly 0.
    """
    entry, price, shares = F.col("entry_price"), F.col("current_price"), F.col("shares")
    value = if_set(price, price * shares)
    delta = if_set(price, ratio(price - entry, entry) * 100)
    return raw.withColumns(
        {
            "initial_investment": round_half_up(entry * shares),
            "current_investment": if_set(value, round_half_up(value)),
            "delta": if_set(delta, round_half_up(delta)),
        }
    )


def totals(holdings: DataFrame) -> DataFrame:
    """One row of sums (in cents), counts and returns over derived holdings."""
    cost, value = cents(F.col("initial_investment")), cents(F.col("current_investment"))
    whole = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    sums = holdings.agg(
        whole(F.sum(cost)).alias("total_initial"),
        whole(F.sum(F.when(priced(), cost))).alias("priced_initial"),
        whole(F.sum(F.when(priced(), value))).alias("priced_current"),
        whole(F.sum(F.when(unpriced(), cost))).alias("unpriced_initial"),
        F.count(F.lit(1)).alias("n_holdings"),
        F.count_if(priced()).alias("n_priced"),
        F.count_if(unpriced()).alias("n_unpriced"),
    )
    current = F.col("priced_current") + F.col("unpriced_initial")
    sums = sums.withColumn("estimated_current", current)
    return sums.withColumn("estimated_return", ratio(current - F.col("total_initial"), F.col("total_initial")) * 100).withColumn(
        "priced_return", ratio(F.col("priced_current") - F.col("priced_initial"), F.col("priced_initial")) * 100
    )


def win_rate(*parts: DataFrame, column: str = "ret") -> DataFrame:
    """Winners (return above 0) among all rows of the parts, as counts and in %."""
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part, allowMissingColumns=True)
    counts = rows.agg(F.count_if(F.col(column) > 0).alias("winners"), F.count(F.lit(1)).alias("total"))
    return counts.withColumn("rate_pct", ratio(F.col("winners"), F.col("total")) * 100)


def sign_counts(df: DataFrame, column: str) -> DataFrame:
    """How many rows are above 0, and how many are not."""
    return df.agg(F.count_if(F.col(column) > 0).alias("green"), F.count_if(F.col(column) <= 0).alias("red"))
