"""Sorting by a key chosen at run time, and first and last rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlark.functions.semantics import or_else
from ledgerlark.plans.shared import written

ASCENDING, DESCENDING, BY_NAME = 0, 1, 2
#: Bits of a row's number inside its partition, in what Spark numbers rows by.
_INSIDE = 33


@dataclass(frozen=True)
class SortState:
    """Which key a table is sorted by, and where in the cycle ascending, descending, by name it is."""

    key: str
    cycle: int = ASCENDING

    def clicked(self, key: str) -> SortState:
        return SortState(key, (self.cycle + 1) % 3) if key == self.key else SortState(key)


#: Sort keys of open positions and of holdings. Text sorts by a locale's order, ties keep the input's.
POSITION_KEYS: dict[str, Callable[[], Column]] = {
    **{k: (lambda k=k: F.collate(F.col(k), "UNICODE")) for k in ("ticker", "name", "sector")},
    **{k: (lambda k=k: F.col(k)) for k in ("rec_date", "entry_price", "current_price", "shares", "initial_investment", "current_investment", "profit_loss", "return_pct")},
}
HOLDING_KEYS: dict[str, Callable[[], Column]] = {
    **{k: (lambda k=k: F.collate(F.col(k), "UNICODE")) for k in ("ticker", "sector", "theme")},
    **{k: (lambda k=k: F.col(k)) for k in ("entry_price", "shares", "initial_investment")},
    **{k: (lambda k=k: F.coalesce(F.col(k), F.lit(0.0))) for k in ("current_price", "current_investment")},
    "delta": lambda: or_else(F.col("delta"), -999.0),
}


def order_of(state: SortState, keys: dict[str, Callable[[], Column]], name: str = "ticker", pos: str = "input_pos") -> list[Column]:
    """The sort columns of a state; an unknown key leaves the input's order."""
    if state.cycle == BY_NAME:
        return [F.collate(F.col(name), "UNICODE").asc(), F.col(pos).asc()]
    if state.key not in keys:
        return [F.col(pos).asc()]
    key = keys[state.key]()
    return [key.desc_nulls_last() if state.cycle == DESCENDING else key.asc_nulls_first(), F.col(pos).asc()]


def sorted_by(df: DataFrame, state: SortState, keys: dict[str, Callable[[], Column]], name: str = "ticker", pos: str = "input_pos") -> DataFrame:
    return df.orderBy(*order_of(state, keys, name, pos))


def top(df: DataFrame, value: str, n: int, pos: str) -> DataFrame:
    """The n rows of most value (null as 0), ties in the input's order."""
    return df.orderBy(F.desc(F.coalesce(value, F.lit(0.0))), F.col(pos)).limit(n)


def bottom(df: DataFrame, value: str, n: int, pos: str) -> DataFrame:
    """The n rows of least value (null as 0), least first, ties against the input's order."""
    return df.orderBy(F.asc(F.coalesce(value, F.lit(0.0))), F.desc(pos)).limit(n)


def laggards(df: DataFrame, value: str, below: float, pos: str, of: int = 5, n: int = 3) -> DataFrame:
    """Of the `of` rows of least value the first n below a threshold."""
    least = bottom(df, value, of, pos).filter(or_else(F.col(value), 0.0) < below)
    return least.orderBy(F.asc(F.coalesce(value, F.lit(0.0))), F.desc(pos)).limit(n)


def first_match(df: DataFrame, condition: Column, pos: str) -> DataFrame:
    return df.filter(condition).orderBy(pos).limit(1)


def numbered(df: DataFrame, order: list[Column], by: list[str], name: str = "rank") -> DataFrame:
    """Each row's number, from 1, within its group."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def globally_numbered(df: DataFrame, order: list[Column], name: str = "rank", first: int = 1) -> DataFrame:
    """Each row's number among all rows, without one task that sees all of them.

    Rows are dealt into ranges of the order and sorted inside; the table that
    this gives is written, with each row's number in its range. A second pass
    counts the ranges and adds to each what lies before it. The order should
    tell all rows apart: equal rows share a range, and get numbers as they come.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id())
    ranged = written(ranged, "ranges")
    part = F.shiftright("__id", _INSIDE)
    sizes = ranged.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"))  # a row for each range, whatever the size
    before = F.sum("__n").over(Window.partitionBy(F.lit(0)).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("__part", F.coalesce(before, F.lit(0)).alias("__before"))
    placed = ranged.withColumn("__part", part).join(F.broadcast(offsets), "__part")
    return placed.withColumn(name, F.col("__before") + F.col("__id").bitwiseAND((1 << _INSIDE) - 1) + first).drop("__part", "__id", "__before")
