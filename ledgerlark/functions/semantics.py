"""Null, zero and rounding rules that portfolio figures follow, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def or_else(x: Column, default: float | Column) -> Column:
    """x, or the default where x is null, NaN or 0."""
    return F.coalesce(F.nullif(F.nanvl(x.cast("double"), F.lit(None).cast("double")), F.lit(0.0)), default if isinstance(default, Column) else F.lit(default))


def text_or_else(x: Column, default: str | Column) -> Column:
    """x, or the default where x is null or empty."""
    return F.coalesce(F.nullif(x, F.lit("")), default if isinstance(default, Column) else F.lit(default))


def if_set(x: Column, value: Column) -> Column:
    """The value where x is neither null, NaN nor 0, else null."""
    return F.when((x != 0) & ~F.isnan(x.cast("double")), value)


def ratio(a: Column, b: Column) -> Column:
    """a / b; null where b is 0 (a deliberate choice: no infinities)."""
    return a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0))


def round_half_up(x: Column, digits: int = 2) -> Column:
    """x rounded so that halves go towards plus infinity."""
    scale = 10**digits
    return F.floor(x * scale + 0.5) / F.lit(float(scale))


def cents(x: Column) -> Column:
    """Money as whole cents, whose sums do not depend on the order of rows."""
    return F.round(x * 100).cast("bigint")


def try_number(x: Column) -> Column:
    """A text as a number; null where it is none."""
    return x.try_cast("double")
