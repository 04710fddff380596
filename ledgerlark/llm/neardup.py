"""Operator 7: near-duplicates by an LSH forest.

Each set of shingles has `TREES * DEPTH` min-hashes. A tree orders all sets by a
signature that begins with its own DEPTH min-hashes and goes on with those of
the next tree. Sets with a common prefix of DEPTH form a region. Depth adapts to
a region's size. Candidates are

1. in FIRST trees, neighbours in the order of each region, which have the
   longest common prefixes: linearly many pairs that connect most of what is
   alike;
2. in all trees, in regions that are not connected yet, the pairs between
   components of a region of at most SMALL sets, and else neighbours in the
   deeper order again;
3. in larger regions that are still not connected, an exact rest: sets that
   regions hold together are ordered by rarity against a few of them, and a
   pair's first common shingle must leave room for the overlap that it needs.
   Only sets outside the largest component look for partners. Where many sets
   begin with the same shingle, they meet in pieces of a bounded size.

So in a region every pair of similarity 0.8 or more is compared, or already
connected. Two such sets miss all common regions with a probability of
(1 - 0.8**4)**32 = 5e-8; nothing else is left out, and no region, set or partner
is capped. Every link is confirmed on the full sets. Sets that are equal are one
set from the start. Pairs inside a component are not expanded.

Null and empty texts have no shingles and are linked with nothing; a text of
fewer words than a shingle has one shingle, its words. Rows that repeat an id
are all returned, and count as one document for links. A row without an id is
returned with a null component and as kept. Further columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlark.llm.bytewords import NOT_SPACE, mixed, shingle_sets, slices, text_bytes, words_of
from ledgerlark.llm.components import components, extended
from ledgerlark.llm.scratch import removed, written

TREES, DEPTH = 32, 4
#: Trees whose neighbours are compared first; sets of a region that are all compared; how far neighbours may be in the order of a larger one.
FIRST = 6
SMALL, NEAR = 24, 3
#: Sets that stand for those that regions hold together.
HUBS = 8
#: Members of a region, and sets that share a rare shingle, that are joined under one key; those of a larger one are dealt out over several.
PIECE = 256
#: Sets that a part of a hot region has on average; its parts are joined by their first sets.
ORDERED = 4096

_rng = np.random.Generator(np.random.PCG64(7_041_776))
_A = _rng.integers(0, 2**32, TREES * DEPTH, dtype=np.uint32) | np.uint32(1)
_C = _rng.integers(0, 2**32, TREES * DEPTH, dtype=np.uint32)
_K = _rng.integers(0, 2**64, DEPTH, dtype=np.uint64) | np.uint64(1)


def signature(shingles: np.ndarray) -> np.ndarray:
    """The min-hashes of a set that has a shingle at least."""
    top = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(len(_A), 2**32 - 1, dtype=np.uint32)
    for at in range(0, len(top), 256):
        np.minimum(out, (top[at : at + 256, None] * _A + _C).min(axis=0), out=out)
    return out


def _prefixes(signatures: np.ndarray) -> np.ndarray:
    """For each set and tree a number for the tree's first DEPTH min-hashes."""
    parts = signatures.reshape(-1, TREES, DEPTH).astype(np.uint64)
    return mixed((parts * _K).sum(axis=2)).view(np.int64)


def _described(words: int):
    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                sets = shingle_sets(words_of(*text_bytes(part.column("text")), NOT_SPACE), words)
                some = [i for i, s in enumerate(sets) if len(s)]
                signatures = np.array([signature(sets[i]) for i in some], dtype=np.uint32).reshape(-1, TREES * DEPTH)
                place = np.full(len(sets), -1)
                place[some] = range(len(some))
                prefixes = [p.tolist() for p in _prefixes(signatures)]
                pick = lambda values: [values[p] if p >= 0 else None for p in place.tolist()]  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(pick([hashlib.blake2b(sets[i].tobytes(), digest_size=16).digest() for i in some]), pa.binary()), pa.array(pick(prefixes), pa.list_(pa.int64()))],
                    ["doc_id", "n_shingles", "set", "prefixes"],
                )

    return run


def described(docs: DataFrame, words: int) -> DataFrame:
    """For each row: doc_id, n_shingles, set (a digest of it), prefixes (one of each tree)."""
    return docs.mapInArrow(_described(words), "doc_id long, n_shingles long, set binary, prefixes array<long>")


def _linked(words: int, percent: int):
    def run(batches):
        for batch in batches:
            for part in slices(batch, "text_a", 2 << 20):
                n = part.num_rows
                sets = [shingle_sets(words_of(*text_bytes(part.column(c)), NOT_SPACE), words) for c in ("text_a", "text_b")]
                common = [len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(*sets, strict=True)]
                keep = [i for i in range(n) if common[i] and 100 * common[i] >= percent * (len(sets[0][i]) + len(sets[1][i]) - common[i])]
                yield pa.RecordBatch.from_arrays([part.column(c).take(pa.array(keep, pa.int64())) for c in ("a", "b")], ["a", "b"])

    return run


def confirmed(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Those of the pairs (a, b) whose full sets are as alike as `percent` asks; texts: node, text."""
    both = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    return both.mapInArrow(_linked(words, percent), "a long, b long")


def _alike_in_size(percent: int) -> F.Column:
    return 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")


def _between_components(members: DataFrame, percent: int) -> DataFrame:
    """Pairs of sets of a region that lie in different components; each pair from the first tree in which it has a region."""
    side = lambda x: members.select("region", "tree", *[F.col(c).alias(f"{c}_{x}") for c in ("node", "n", "component", "prefixes")]).withColumnRenamed("tree", f"tree_{x}")
    first = F.expr("array_position(zip_with(prefixes_a, prefixes_b, (x, y) -> x = y), true) = tree_a + 1")
    met = side("a").join(side("b"), "region").filter((F.col("node_a") < F.col("node_b")) & (F.col("component_a") != F.col("component_b")) & _alike_in_size(percent) & first)
    return met.select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))


def _with_region(members: DataFrame, regions: DataFrame) -> DataFrame:
    """Members (region, sets: how many sets it has, and others) with what is known of their regions (region, sets, and others); a large region is joined in pieces."""
    pieces = F.ceil(F.col("sets") / PIECE).cast("int")
    regions = regions.withColumn("piece", F.explode(F.sequence(F.lit(0), pieces - 1))).drop("sets")
    return members.withColumn("piece", F.pmod(F.xxhash64("node"), pieces).cast("int")).join(regions, ["region", "piece"]).drop("piece")


def _unsettled(members: DataFrame) -> DataFrame:
    """Members of regions with several components."""
    regions = members.groupBy("region").agg(F.max("sets").alias("sets"), F.min("component").alias("x"), F.max("component").alias("y")).filter("x <> y")
    return _with_region(members, regions.select("region", "sets"))


def _shingles(words: int):
    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                sets = shingle_sets(words_of(*text_bytes(part.column("text")), NOT_SPACE), words)
                yield pa.RecordBatch.from_arrays([part.column("cluster").take(pa.array(np.repeat(np.arange(len(sets)), [len(x) for x in sets]))), pa.array(np.concatenate(sets).view(np.int64))], ["cluster", "shingle"])

    return run


def _rare_first(words: int, percent: int):
    """The first shingles of each set, as far as the first one that it shares with a partner can lie, by rarity."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                sets = shingle_sets(words_of(*text_bytes(part.column("text")), NOT_SPACE), words)
                rows, found, places = [], [], []
                for i, (s, common) in enumerate(zip(sets, part.column("common"), strict=True)):
                    known = np.array(common.as_py() or [], dtype=np.int64).view(np.uint64)
                    ordered = s[np.lexsort((s, np.isin(s, known)))][: len(s) - -(-percent * len(s) // 100) + 1]
                    rows += [i] * len(ordered)
                    found.append(ordered)
                    places += range(len(ordered))
                yield pa.RecordBatch.from_arrays(
                    [part.column(c).take(pa.array(rows, pa.int64())) for c in ("cluster", "node", "n", "component", "outside")] + [pa.array(np.concatenate(found).view(np.int64)), pa.array(places, pa.int64())],
                    ["cluster", "node", "n", "component", "outside", "shingle", "place"],
                )

    return run


def _rest(members: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """All pairs between components that can be alike, of sets that regions hold together; members: region, sets, node, n, component."""
    heads = members.groupBy("region").agg(F.max("sets").alias("sets"), F.min("node").alias("head"))
    clusters = components(_with_region(members, heads).select(F.col("head").alias("a"), F.col("node").alias("b"))).withColumnRenamed("component", "cluster")
    nodes = members.select("node", "n", "component").distinct().join(clusters, "node")
    sizes = nodes.groupBy("cluster", "component").agg(F.count(F.lit(1)).alias("sets"))
    # what is known of clusters is written, so that joins can deal out a large cluster's sets
    largest = written(sizes.groupBy("cluster").agg(F.max(F.struct("sets", "component"))["component"].alias("largest")), "largest")
    nodes = written(nodes.join(largest, "cluster").withColumn("outside", F.col("component") != F.col("largest")).drop("largest"), "clusters")
    hubs = nodes.groupBy("cluster").agg(F.array_distinct(F.array(*[F.min(F.struct(F.xxhash64("node", F.lit(k)).alias("h"), "node"))["node"] for k in range(HUBS)])).alias("hubs"))
    hubs = hubs.select("cluster", F.explode("hubs").alias("node")).join(texts, "node").select("cluster", "text")
    common = hubs.mapInArrow(_shingles(words), "cluster long, shingle long").groupBy("cluster", "shingle").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").groupBy("cluster").agg(F.collect_list("shingle").alias("common"))
    common = written(common, "common")
    described = nodes.join(texts, "node").join(common, "cluster", "left").select("cluster", "node", "n", "component", "outside", "text", "common")
    rows = written(described.mapInArrow(_rare_first(words, percent), "cluster long, node long, n long, component long, outside boolean, shingle long, place long"), "rare-first")
    # a shingle that many sets begin with: those that look for partners meet the others in pieces
    often = rows.groupBy("cluster", "shingle").agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") > PIECE).select("cluster", "shingle", F.ceil(F.col("k") / PIECE).cast("int").alias("pieces"))
    often = written(often, "often")  # written, so that the join can deal out such a shingle's rows
    rows = written(rows.join(often, ["cluster", "shingle"], "left").withColumn("pieces", F.coalesce("pieces", F.lit(1))), "in-pieces")
    side = lambda df, x: df.select("cluster", "shingle", "piece", *[F.col(c).alias(f"{c}_{x}") for c in ("node", "n", "component", "outside", "place")])
    seeking = rows.filter("outside").withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    met = side(seeking, "a").join(side(rows.withColumn("piece", F.pmod(F.xxhash64("node"), "pieces").cast("int")), "b"), ["cluster", "shingle", "piece"])
    needed = F.expr(f"({percent} * (n_a + n_b) + {99 + percent}) div {100 + percent}")
    met = met.filter((F.col("component_a") != F.col("component_b")) & (~F.col("outside_b") | (F.col("node_a") < F.col("node_b"))) & (F.least(F.col("n_a") - F.col("place_a"), F.col("n_b") - F.col("place_b")) >= needed))
    return met.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")).distinct()


def in_order(sets: DataFrame) -> DataFrame:
    """For each set (node, n, prefixes) and tree in which it shares its region: region, tree, node, n, first (of the region), sets (in it), before (the NEAR sets before it in the order).

    Regions are dealt out before rows meet what is known of them: those of more
    than a thousandth of all sets, of which a tree has less than a thousand, are
    broadcast, and their sets and counts are joined, and then ordered, by region
    and part.
    """
    # a row for each set and tree, its region, and how its signature goes on
    in_trees = sets.select("node", "n", F.posexplode("prefixes").alias("tree", "prefix"), "prefixes").select(
        "node", "n", "tree", F.xxhash64("tree", "prefix").alias("region"), F.expr(f"prefixes[(tree + 1) % {TREES}]").alias("further")
    )
    shared = in_trees.groupBy("region").agg(F.count(F.lit(1)).alias("sets"), F.min("node").alias("first")).filter("sets > 1")
    shared = written(shared, "regions").withColumn("parts", F.when(F.col("sets") > max(ORDERED, sets.count() // 1000), F.ceil(F.col("sets") / ORDERED)).cast("int"))
    hot = shared.filter("parts is not null").select(F.col("region").alias("hot"), "parts")
    dealt = in_trees.join(F.broadcast(hot), F.col("region") == F.col("hot"), "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("node"), "parts"), F.lit(0)).cast("int")).drop("hot", "parts")
    known = shared.withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    members = dealt.join(known, ["region", "part"])
    order = Window.partitionBy("region", "part").orderBy("further", "node")
    lags = [F.struct(F.lag("node", k).over(order).alias("node"), F.lag("n", k).over(order).alias("n")) for k in range(1, NEAR + 1)]
    return members.select("region", "tree", "node", "n", "first", "sets", F.filter(F.array(*lags), lambda x: x["node"].isNotNull()).alias("before"))


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """A row for each row of docs: doc_id, n_shingles, component_id (the smallest id reachable by links), kept."""
    docs = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text"))
    rows = written(described(docs, words), "described")
    sets = rows.filter("set is not null and doc_id is not null").groupBy("set").agg(F.min(F.struct("doc_id", "n_shingles", "prefixes")).alias("x"))
    sets = written(sets.select("set", F.col("x.doc_id").alias("node"), F.col("x.n_shingles").alias("n"), "x.prefixes"), "sets")

    members = written(in_order(sets), "members")

    texts = written(docs.join(members.select("node").distinct(), docs["doc_id"] == F.col("node")).select("node", "text"), "texts")
    head = F.when((F.size("before") == 0) & (F.col("first") != F.col("node")), F.col("first"))
    last = members.filter(F.col("tree") < FIRST).select(F.coalesce(F.get("before", F.lit(0))["node"], head).alias("x"), F.col("node").alias("y"), F.coalesce(F.get("before", F.lit(0))["n"], "n").alias("n_a"), F.col("n").alias("n_b"))
    near = last.filter("x is not null").filter(_alike_in_size(percent)).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    found = written(components(confirmed(near, texts, words, percent)), "components")

    # regions that these neighbours have not connected
    at = F.coalesce("component", "node").alias("component")
    open_ = written(_unsettled(members.join(found, "node", "left").select("region", "tree", "node", "n", "sets", "before", at)), "unsettled")
    if not open_.isEmpty():
        small = open_.filter(F.col("sets") <= SMALL).join(sets.select("node", "prefixes"), "node")
        large = open_.filter(F.col("sets") > SMALL)
        of = found.select(F.col("node").alias("x"), F.col("component").alias("component_x"))
        beside = large.select(F.col("node").alias("y"), F.col("n").alias("n_b"), "component", F.explode("before").alias("b")).select(F.col("b.node").alias("x"), F.col("b.n").alias("n_a"), "y", "n_b", "component").filter(_alike_in_size(percent)).distinct()
        beside = beside.join(of, "x", "left").filter(F.coalesce("component_x", "x") != F.col("component")).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
        more = _between_components(small, percent).union(beside).distinct()
        found = extended(found, confirmed(more, texts, words, percent))
        before, open_ = open_, written(_unsettled(large.drop("component").join(found, "node", "left").select("region", "node", "n", "sets", at)), "unsettled")
        if not open_.isEmpty():
            found = extended(found, confirmed(_rest(open_, texts, words, percent), texts, words, percent))
        removed(before)
    removed(members, texts, open_)
    classes = sets.select("set", "node").join(found, "node", "left").select("set", F.coalesce("component", "node").alias("class"))
    out = rows.select("doc_id", "n_shingles", "set").join(classes, "set", "left")
    component = F.coalesce("class", "doc_id")
    component = F.when(F.col("doc_id").isNotNull(), component)
    return out.select(F.col("doc_id").alias(doc_id), "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))
