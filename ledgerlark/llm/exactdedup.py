"""Operator 5: exact duplicates by recipes of content-defined chunks.

A text is cut where its own bytes say so, so equal texts have equal chunks. Each
distinct chunk moves once from each task that has it; grouping by the chunk
itself (not only by its hash) verifies identifiers: the hash is a chunk's
identifier where it stands for one content only, and where several contents
share a hash they get numbers, too. A document is from then on the ordered list
of its identifiers (its recipe), a few bytes for each kilobyte; documents are
equal when their recipes are.

Of equal texts the row with the largest id stays. Null counts as empty; empty
texts are equal to each other. Rows that repeat id and text are each returned
and counted, and one of them cannot be told from the other: all are kept or
none is. A null id is smaller than any other. Further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlark.llm.bytewords import slices, text_bytes
from ledgerlark.llm.scratch import written

#: A cut falls behind one of 2**CUT_BITS bytes on average, LEAST bytes after the last at least and MOST at most.
CUT_BITS, LEAST, MOST = 11, 256, 16_384


def cuts(data: np.ndarray) -> list[int]:
    """Ends of the chunks of a text; what decides on a cut is the eight bytes before it."""
    n = len(data)
    if not n:
        return []
    found = np.zeros(0, np.int64)
    if n > 8:
        parts = []
        for at in range(0, n - 7, 1 << 20):  # blocks that overlap by seven bytes
            block = np.ascontiguousarray(data[at : at + (1 << 20) + 7])
            seen = np.lib.stride_tricks.sliding_window_view(block, 8)
            value = np.ascontiguousarray(seen).view("<u8").ravel() * np.uint64(0x9E3779B97F4A7C15)
            parts.append(np.flatnonzero(value >> np.uint64(64 - CUT_BITS) == 0) + at + 8)
        found = np.concatenate(parts)
    out, last = [], 0
    for end in [*found.tolist(), n]:
        while end - last > MOST:
            last += MOST
            out.append(last)
        if end == n or end - last >= LEAST:
            if end > last:
                out.append(end)
                last = end
    return out


def _hash(chunk: bytes) -> int:
    return xxhash.xxh3_64_intdigest(chunk) - 2**63


def _chunks(data: np.ndarray, hashed: Callable[[bytes], int]) -> list[tuple[int, bytes]]:
    out, last = [], 0
    for end in cuts(data):
        chunk = data[last:end].tobytes()
        out.append((hashed(chunk), chunk))
        last = end
    return out


def _recipes(hashed):
    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                data, at = text_bytes(part.column("text"))
                texts = [data[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
                recipes = [[h for h, _ in _chunks(x, hashed)] for x in texts]
                shas = [hashlib.sha256(x).hexdigest() for x in texts]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(recipes, pa.list_(pa.int64())), pa.array(shas, pa.string())], ["doc_id", "recipe", "text_sha256"])

    return run


def _contents(hashed):
    """Chunks, each distinct one once from each slice."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                data, at = text_bytes(part.column("text"))
                seen = {c: h for a, b in zip(at[:-1], at[1:], strict=True) for h, c in _chunks(data[a:b], hashed)}
                yield pa.RecordBatch.from_arrays([pa.array(seen.values(), pa.int64()), pa.array(seen.keys(), pa.binary())], ["hash", "chunk"])

    return run


def _occurrences(hashed):
    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                data, at = text_bytes(part.column("text"))
                rows = [(i, k, h, c) for i, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)) for k, (h, c) in enumerate(_chunks(data[a:b], hashed))]
                shas = [hashlib.sha256(data[a:b]).hexdigest() for a, b in zip(at[:-1], at[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(pa.array([r[0] for r in rows], pa.int64())), pa.array([shas[r[0]] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.binary())],
                    ["doc_id", "text_sha256", "place", "hash", "chunk"],
                )

    return run


def distinct_chunks(docs: DataFrame, hashed: Callable[[bytes], int] = _hash) -> DataFrame:
    """Each distinct chunk of the column text, once: hash, chunk."""
    return docs.select("text").mapInArrow(_contents(hashed), "hash long, chunk binary").groupBy("hash", "chunk").agg(F.count(F.lit(1)).alias("n")).select("hash", "chunk")


def recipes(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", hashed: Callable[[bytes], int] = _hash) -> DataFrame:
    """A row for each row of docs: doc_id, recipe (ordered verified identifiers), text_sha256."""
    picked = docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text"))
    kind = picked.schema["doc_id"].dataType.simpleString()
    rows = picked.mapInArrow(_recipes(hashed), f"doc_id {kind}, recipe array<long>, text_sha256 string")
    shared = written(distinct_chunks(picked, hashed).groupBy("hash").agg(F.count(F.lit(1)).alias("contents")).filter("contents > 1"), "shared-hashes")
    if shared.isEmpty():
        return rows
    # some hashes stand for several chunks: those chunks get numbers by their content
    chunks = distinct_chunks(picked, hashed).join(shared, "hash", "left_semi")
    numbered = chunks.withColumn("number", F.dense_rank().over(Window.partitionBy("hash").orderBy("chunk")).cast("long"))
    found = picked.mapInArrow(_occurrences(hashed), f"doc_id {kind}, text_sha256 string, place int, hash long, chunk binary")
    numbers = found.join(numbered, ["hash", "chunk"]).groupBy("doc_id", "text_sha256").agg(F.map_from_entries(F.collect_set(F.struct("place", "number"))).alias("numbers"))
    numbers = numbers.select(F.col("doc_id").alias("of"), F.col("text_sha256").alias("sha"), "numbers")
    both = rows.join(numbers, rows["doc_id"].eqNullSafe(numbers["of"]) & (rows["text_sha256"] == numbers["sha"]), "left")
    recipe = F.expr("flatten(transform(recipe, (h, place) -> array(h, coalesce(try_element_at(numbers, place), 0L))))")
    return both.select("doc_id", recipe.alias("recipe"), "text_sha256")


def exact_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", hashed: Callable[[bytes], int] = _hash) -> DataFrame:
    """A row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = written(recipes(docs, text, doc_id, hashed), "recipes")
    # written, so that the join can deal out a recipe that many documents have
    groups = written(rows.groupBy("recipe").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")), "groups")
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    return rows.join(groups, "recipe").select(F.col("doc_id").alias(doc_id), "keep_id", "group_size", kept.alias("kept"), "text_sha256")
