"""Operator 4: proportional stratified interleaving into shards, with DataFrame functions only.

Within each source the rows are put in a seeded random order and given a
fractional rank, (rank + u) / size, with u a hash of seed and source in [0, 1).
All rows sorted by it carry each source evenly from beginning to end, so cutting
the order into runs of equal length gives shards that match the mixture. Of a
range of fractional ranks each source has its share to within one row; where a
shard's range begins and ends depends on the hashes of all sources, so with n
sources a shard's length in the order varies by about the root of n rows, and a
large source's part of it by its share of that.

Ranks over a large group never need the group in one task. Rows fall into about
rows / `CELL` cells by the leading digits of what they are sorted by; a rank is
the number of rows in earlier cells, from sums over the cells' counts by blocks
(see runningsums.py), and the place in the own cell. The law is `rows`: shards differ by one row at most.

Null texts have no bytes and the checksum of the empty text; a null source is a
source of its own. Rows that repeat id and text are interchangeable and each get
a place. No rows: no rows. Further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlark.llm.runningsums import cells, summed
from ledgerlark.llm.scratch import written

#: Rows of a cell on average, and bytes that a row counts besides its text.
CELL, ROW_BYTES = 4096, 8


def stratified_shards(docs: DataFrame, shards: int, seed: int = 0, text: str = "text", doc_id: str = "doc_id", source: str = "source") -> DataFrame:
    """A row for each row of docs: doc_id, source, size, text_crc32, position (in the order of all rows), shard, slot (in the shard)."""
    size = F.coalesce(F.octet_length(docs[text]), F.lit(0)).cast("long") + ROW_BYTES
    crc = F.crc32(F.coalesce(docs[text], F.lit("")).cast("binary"))
    base = docs.select(docs[doc_id].alias("doc_id"), docs[source].alias("source"), F.coalesce(F.concat(F.lit("s"), docs[source].cast("string")), F.lit("n")).alias("stratum"), size.alias("size"), crc.alias("text_crc32"))
    base = written(base.withColumn("key", F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("text_crc32").cast("string")).cast("binary"))), "rows")
    total = base.count()
    bits = max(0, (total // CELL).bit_length())
    n_cells = 1 << bits

    lead = F.conv(F.substring("key", 1, 12), 16, 10).cast("long")
    one = {"rows": F.lit(1)}
    keyed = base.withColumn("cell", F.shiftright(lead, 48 - bits))
    sizes = base.groupBy("stratum").agg(F.count(F.lit(1)).alias("of"))
    hashed = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("stratum")).cast("binary"))
    sizes = sizes.withColumn("u", F.conv(F.substring(hashed, 1, 8), 16, 10).cast("double") / 2**32)
    # what is known of a source reaches its rows cell by cell
    ranked = summed(keyed, cells(keyed, ["stratum"], "cell", one).join(sizes, "stratum"), ["stratum"], "cell", ["key", "doc_id", "size"], one)
    spread = ranked.withColumnRenamed("before_rows", "rank").withColumn("share", (F.col("rank") + F.col("u")) / F.col("of"))
    spread = spread.withColumn("cell", F.floor(F.col("share") * n_cells))
    placed = summed(spread, cells(spread, [], "cell", one), [], "cell", ["share", "stratum", "rank"], one).withColumnRenamed("before_rows", "position")
    shard = F.expr(f"position * {shards} div {max(total, 1)}")
    placed = placed.withColumn("shard", shard.cast("int"))
    slot = F.expr(f"position - (shard * {max(total, 1)}L + {shards - 1}) div {shards}")
    return placed.select(F.col("doc_id").alias(doc_id), F.col("source").alias(source), "size", "text_crc32", "position", "shard", slot.alias("slot"))
