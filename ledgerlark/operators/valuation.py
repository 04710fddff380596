"""Valuation of positions by the latest quotes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlark.functions.semantics import cents, if_set, ratio, text_or_else


def normalised_quotes(raw: DataFrame) -> DataFrame:
    """Quotes with a symbol, missing figures 0 and missing texts defaulted."""
    zero = ["price", "change", "change_percent", "previous_close", "open", "high", "low"]
    named = raw.filter(F.col("symbol").isNotNull() & (F.col("symbol") != ""))
    return named.select("seq", "symbol", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in zero], F.coalesce("volume", F.lit(0)).cast("bigint").alias("volume"), F.coalesce("market_state", F.lit("CLOSED")).alias("market_state"), F.coalesce("name", "symbol").alias("name"), "last_update")


def latest(quotes: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """For each key the row that is last in `order`. One aggregation, no window, no sort of a key's rows."""
    return quotes.groupBy(key).agg(F.max_by(F.struct(*columns), F.col(order)).alias("q")).select(key, *[F.col(f"q.{c}").alias(c) for c in columns])


def stock_value(positions: DataFrame, quotes: DataFrame, on: str) -> DataFrame:
    """The sum of shares times price, in cents; a position without a quote counts 0. Null where there is no quote at all."""
    joined = positions.join(quotes, on, "left")
    value = F.sum(F.col("shares") * F.coalesce(cents(F.col("price")), F.lit(0))).cast("bigint")
    return joined.agg(F.when(F.count("price") > 0, value).alias("stock_value"))


def daily_change(positions: DataFrame, quotes: DataFrame, on: str) -> DataFrame:
    """The sum of shares times (price less previous close), in cents, where the previous close is neither null nor 0."""
    moved = F.when(F.col("previous_close") != 0, F.col("shares") * (cents(F.col("price")) - cents(F.col("previous_close"))))
    return positions.join(quotes, on).agg(F.coalesce(F.sum(moved), F.lit(0)).cast("bigint").alias("change"))


def total_value(stock: Column, cash: Column, dividends: Column, base: Column) -> Column:
    """Stocks, cash and dividends; the base value where the stocks are null or 0."""
    return F.coalesce(if_set(stock, stock + cash + dividends), base)


def change_pct(change: Column, value: Column) -> Column:
    """The day's change in % of the value before it, where the value is above 0."""
    return F.when(value > 0, ratio(change, value - change) * 100)


def returns_on(value: Column, capital: Column) -> dict[str, Column]:
    return {"return_abs": value - capital, "return_pct": ratio(value - capital, capital) * 100}


def week_to_date(stock: Column, base: Column) -> Column:
    """Stocks against a base that holds cash, too, in %; 0 without live stocks."""
    return F.coalesce(if_set(stock, ratio(stock - base, base) * 100), F.lit(0.0))


def live_rows(positions: DataFrame, quotes: DataFrame, on: str) -> DataFrame:
    """Positions with price (0 if missing), value, change and weight in %."""
    price = F.coalesce("price", F.lit(0.0))
    joined = positions.join(quotes, on, "left")
    return joined.select(on, "shares", price.alias("price"), (F.col("shares") * F.coalesce(cents(F.col("price")), F.lit(0))).cast("bigint").alias("value"), F.coalesce("change", F.lit(0.0)).alias("change"), (F.col("weight") * 100).alias("weight_pct"))


def with_dimension(df: DataFrame, dimension: DataFrame, on: str, column: str, default: str) -> DataFrame:
    """df with a text of a small dimension table, defaulted where it has no row. Spark broadcasts it as long as its size allows."""
    return df.join(dimension.select(on, column), on, "left").withColumn(column, text_or_else(F.col(column), default))


def open_for_trade(state: Column) -> Column:
    return state == "REGULAR"


def home_row(name: str, initial: Column, current: Column, return_pct: Column) -> list[Column]:
    """The columns of one portfolio's statistics: what it began with, what it is worth, and its return by its own rule."""
    return [F.lit(name).alias("portfolio"), initial.alias("initial"), current.alias("current"), return_pct.alias("return_pct")]


def with_dividends(initial: Column, final: Column, dividends: Column) -> list[Column]:
    """Rule of the dividend portfolio: dividends are in its value, but not in its return."""
    return home_row("dividends", initial, final + dividends, returns_on(final, initial)["return_pct"])


def reinvested(injected: Column, open_value: Column, available: Column) -> list[Column]:
    """Rule of the reinvesting portfolio: open positions and the cash that is left, against all cash that has come in."""
    return home_row("reinvested", injected, open_value + available, returns_on(open_value + available, injected)["return_pct"])


def estimated(total_initial: Column, estimated_current: Column, estimated_return: Column) -> list[Column]:
    """Rule of the estimated portfolio: unpriced holdings count at cost, in its value and in its return."""
    return home_row("estimated", total_initial, estimated_current, estimated_return)
