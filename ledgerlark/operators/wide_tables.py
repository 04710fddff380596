"""Ragged wide tables: a column for each name that the data hold, and back to rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Columns that a wide table may have.
WIDEST = 2000


def names_of(df: DataFrame, name: str, most: int = WIDEST) -> list[str]:
    """The names that become columns, in order; one more than allowed is an error, not a cut."""
    found = [r[0] for r in df.select(F.col(name).cast("string")).filter(F.col(name).isNotNull()).distinct().limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"more than {most} different names in {name}")
    return sorted(found)


def wide(df: DataFrame, by: list[str], name: str, value: str, names: list[str] | None = None) -> DataFrame:
    """A row for each group, and a column for each name with its value (of several rows the greatest); cells without a row are null.

    One aggregation; the names come from a pass of their own unless they are
    given. A null name has no column, but its group has a row.
    """
    names = names_of(df, name) if names is None else names
    if clash := set(names) & set(by):
        raise ValueError(f"names that are columns already: {sorted(clash)}")
    return df.groupBy(*by).agg(*[F.max(F.when(F.col(name) == n, F.col(value))).alias(n) for n in names], *([] if names else [F.count(F.lit(1)).alias("__n")])).drop("__n")


def long(df: DataFrame, by: list[str], name: str, value: str, keep_null: bool = True) -> DataFrame:
    """A row for each group and column, also for cells without a value unless keep_null is false."""
    columns = [c for c in df.columns if c not in by]
    if not columns:
        return df.select(*by, F.lit("").alias(name), F.lit(None).cast("bigint").alias(value)).limit(0)
    rows = df.unpivot(by, [F.col(f"`{c}`") for c in columns], name, value)
    return rows if keep_null else rows.filter(F.col(value).isNotNull())


def combined(parts: list[DataFrame]) -> DataFrame:
    """Wide tables of several sources one below the other; columns that only some have are null in the others."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out
