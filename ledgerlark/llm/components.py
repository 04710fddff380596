"""Connected components of a graph given by pairs, by contraction in rounds of joins and grouping.

In each round every node takes, of itself and its neighbours, the one whose
hash for that round is smallest; pairs are then rewritten to what was taken.
The hashes differ from round to round, so a path of any length shrinks by a
constant factor each time and a star goes in two or three rounds. Each round's
tables are written, so lineage stays short. Once no more than `FINISH` pairs are
left, however many there were, one task joins them up, which spares the last
rounds. Nothing but a row count reaches the driver.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlark.llm.scratch import removed, written

#: Pairs that one task joins up at most.
FINISH = 200_000


def _joined_up(batches):
    """The node that each node of some pairs ends at."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = x = root[up]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    nodes = list(root)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([find(x) for x in nodes], pa.int64())], ["node", "root"])


def components(pairs: DataFrame) -> DataFrame:
    """For the nodes of `pairs` (columns a, b; long): node, component (the smallest node reachable).

    Pairs of a node with itself, repeated pairs and both directions are allowed;
    pairs with a null are left out. No pairs: no rows.
    """
    ordered = [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")]
    edges = written(pairs.filter("a is not null and b is not null").select(*ordered).distinct(), "pairs")
    roots, k = None, 0
    while (n := edges.count()) or roots is None:
        if n <= FINISH:
            taken = written(edges.select("a", "b").repartition(1).mapInArrow(_joined_up, "node long, root long"), "taken")
        else:
            both = edges.select("a", "b").union(edges.select("b", "a"))
            rank = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(k)).alias("h"), F.col(c).alias("v"))  # noqa: E731, B023
            taken = written(both.groupBy("a").agg(F.min(rank("b")).alias("m")).select(F.col("a").alias("node"), F.least(F.col("m"), rank("a"))["v"].alias("root")), "taken")
        if roots is None:
            roots = taken
        else:
            moved, before = taken.select(F.col("node").alias("root"), F.col("root").alias("next")), roots
            roots = written(before.join(moved, "root", "left").select("node", F.coalesce("next", "root").alias("root")), "roots")
            removed(before)
        if n <= FINISH:
            break
        at_a = taken.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        at_b = taken.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        moved = edges.join(at_a, "a").join(at_b, "b").filter("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"))
        before, edges = edges, written(moved.distinct(), "pairs")
        removed(before, *([taken] if taken is not roots else []))
        k += 1
    removed(edges, *([taken] if taken is not roots else []))
    smallest = roots.groupBy("root").agg(F.min("node").alias("component"))
    return roots.join(smallest, "root").select("node", "component")


def extended(found: DataFrame, pairs: DataFrame) -> DataFrame:
    """The components of the graph whose components are `found` (which is used up), with further pairs added: only what these join is worked out anew."""
    of = lambda c: found.select(F.col("node").alias(c), F.col("component").alias(f"c{c}"))
    between = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left").select("a", "b", F.coalesce("ca", "a").alias("x"), F.coalesce("cb", "b").alias("y"))
    between = written(between, "between")
    joined = components(between.select(F.col("x").alias("a"), F.col("y").alias("b")))
    nodes = found.unionByName(between.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("x").alias("component")), F.struct(F.col("b").alias("node"), F.col("y").alias("component")))).alias("s")).select("s.*")).distinct()
    moved = joined.select(F.col("node").alias("component"), F.col("component").alias("next"))
    out = written(nodes.join(moved, "component", "left").select("node", F.coalesce("next", "component").alias("component")), "components")
    removed(between, found)
    return out
