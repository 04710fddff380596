"""Sums over all earlier rows of a group, for groups of any size, with DataFrame functions only.

Rows lie in numbered cells of their group. Sums over cells are small tables; what
lies before a cell comes from the cells of its block of `BLOCK` cells and from
the blocks before, so no task sees more than a block's cells or a group's
blocks. Rows are summed inside their cell and joined to it by (group, cell), which
deals out a large group, too; whatever is known of a group can travel with the
cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Cells of a block.
BLOCK = 4096


def cells(df: DataFrame, group: list[str], cell: str, sums: dict[str, Column]) -> DataFrame:
    """A row for each group (all rows, if none is named) and cell: what each sum comes to in all earlier cells of the group, as `before_<name>`."""
    counts = df.groupBy(*group, cell).agg(*[F.sum(x).alias(n) for n, x in sums.items()]).withColumn("__block", F.expr(f"`{cell}` div {BLOCK}"))
    earlier = lambda n, w: F.coalesce(F.sum(n).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = counts.groupBy(*group, "__block").agg(*[F.sum(n).alias(n) for n in sums])
    over = Window.partitionBy(*(group or [F.lit(0)])).orderBy("__block")
    blocks = blocks.select(*group, "__block", *[earlier(n, over).alias(f"__{n}") for n in sums])
    inside = Window.partitionBy(*group, "__block").orderBy(cell)
    within = counts.select(*group, cell, "__block", *[earlier(n, inside).alias(f"__own_{n}") for n in sums])
    both = within.join(blocks, [*group, "__block"])
    return both.select(*group, cell, *[(F.col(f"__{n}") + F.col(f"__own_{n}")).cast("long").alias(f"before_{n}") for n in sums])


def summed(df: DataFrame, known: DataFrame, group: list[str], cell: str, order: list[str], sums: dict[str, Column]) -> DataFrame:
    """df with, for each sum, what the rows before come to, as `before_<name>`; known: cells(), with further columns of cells or groups that are kept."""
    inside = Window.partitionBy(*group, cell).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = df.withColumns({f"__own_{n}": F.coalesce(F.sum(x).over(inside), F.lit(0)) for n, x in sums.items()})
    joined = placed.join(known, [*group, cell])
    return joined.withColumns({f"before_{n}": F.col(f"before_{n}") + F.col(f"__own_{n}") for n in sums}).drop(*[f"__own_{n}" for n in sums])
