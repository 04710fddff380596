"""Figures along long series, from summaries of blocks that are carried on from block to block.

A series is cut into blocks by a column that grows with its order (a day, a
month). Rows are looked at inside their block only; a block's summary (first,
last, highest, sum, lowest running sum) goes on to all later blocks of its
series over a table of blocks, and is joined back by series and block. So no
task sees more than one block's rows, or one series' blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlark.functions.semantics import ratio


def along(df: DataFrame, by: list[str], block: Column, order: list[str], value: str) -> DataFrame:
    """df with what a series has come to at each row.

    Columns: number (from 1), first, previous (null at the first row), peak,
    running (sum), low (the lowest running sum so far, 0 at most) and low_before
    (the same at the row before). Nulls in `value` count as no value for peak and sums. A null in `by` is a series of
    its own; block must not be null.
    """
    rows = df.withColumn("__block", block)
    inside = Window.partitionBy(*by, "__block").orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({
        "__n": F.row_number().over(inside), "__first": F.first(value).over(upto), "__previous": F.lag(value).over(inside), "__peak": F.max(value).over(upto),
        "__running": F.sum(F.coalesce(F.col(value), F.lit(0))).over(upto),
    })
    rows = rows.withColumn("__low", F.min("__running").over(upto)).withColumn("__low_before", F.lag("__low").over(inside))
    last = lambda c: F.max_by(c, "__n")
    blocks = rows.groupBy(*by, "__block").agg(F.max("__n").alias("n"), F.min_by(value, "__n").alias("first"), last(value).alias("last"), F.max(value).alias("peak"), last("__running").alias("sum"), F.min("__low").alias("low"))
    earlier = Window.partitionBy(*by).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("before", F.coalesce(F.sum("sum").over(earlier), F.lit(0)))
    blocks = blocks.select(
        *[F.col(c).alias(f"__by{i}") for i, c in enumerate(by)], F.col("__block").alias("__at"), "before", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n_before"), F.first("first").over(earlier).alias("c_first"),
        F.last("last").over(earlier).alias("c_last"), F.max("peak").over(earlier).alias("c_peak"), F.min(F.col("before") + F.col("low")).over(earlier).alias("c_low"),
    )
    same = F.col("__block") == F.col("__at")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"__by{i}"))
    joined = rows.join(blocks, same)
    begins = F.col("n_before") == 0
    zero = F.lit(0)
    return joined.select(
        *df.columns, (F.col("n_before") + F.col("__n")).alias("number"), F.when(begins, F.col("__first")).otherwise(F.col("c_first")).alias("first"),
        F.when(F.col("__n") > 1, F.col("__previous")).otherwise(F.col("c_last")).alias("previous"), F.greatest("__peak", "c_peak").alias("peak"), (F.col("before") + F.col("__running")).alias("running"),
        F.least(zero, F.col("c_low"), F.col("before") + F.col("__low")).alias("low"), F.least(zero, F.col("c_low"), F.col("before") + F.col("__low_before")).alias("low_before"),
    )


def deepest_fall(df: DataFrame, by: list[str], block: Column, order: list[str], level: str) -> DataFrame:
    """For each series the deepest fall of a level below its highest so far, as a fraction."""
    fall = ratio(F.col(level), F.col("peak")) - 1
    return along(df.select(*by, *order, level, block.alias("__of")), by, F.col("__of"), order, level).groupBy(*by).agg(F.min(fall).alias("max_drawdown"))


def cash_accounts(events: DataFrame, by: list[str], block: Column, order: list[str], amount: str) -> DataFrame:
    """Events (proceeds above 0, purchases below) with the cash that is left after each, and what had to be injected for it.

    New cash comes in only where the proceeds so far don't cover a purchase. What
    has come in up to a row is what the running sum has fallen below 0 at its
    lowest; what is left is the running sum above that.
    """
    rows = along(events, by, block, order, amount)
    return rows.withColumns({"injection": F.col("low_before") - F.col("low"), "available": F.col("running") - F.col("low")}).drop("first", "previous", "peak", "running", "low", "low_before")
