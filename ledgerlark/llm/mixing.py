"""Operator 12: sources mixed to target weights that change in the course of training, with DataFrame functions only.

A source's schedule gives its weight at each time from 0 to 1, linear between
its points and constant outside them. The integral of the schedule is the
source's weight in the whole mix: sources share `amount` times all words by it,
but none has more than `repeats` times its words; what is beyond that goes to
the others by weight. That is a common level, at which a source's demand is
weight times level or its limit: it starts from all weights, and rises as long
as sources below it are found at their limits, each step an aggregation to one
row, so there may be as many sources as there are hosts.

Each source's rows are put in a seeded random order, again for each repetition,
until the demand is met; the last copy is cut there, so what is taken of a
source is its target to within a word. A copy that begins at a part q of the
source's demand belongs to the time at which the integral of the schedule has
reached the part q: the inverse of a cumulative demand that is quadratic between
two points. All copies sorted by time, in ranges, are the training order.

Sums in the order of a source come from cells (see runningsums.py), so a source
may hold any part of the rows. Texts are not moved, only their sizes.

Null texts have no words; rows without words are never taken. A null source is a
source of its own; one without a schedule has weight 0. Rows that repeat id and
size are interchangeable and each get a place. No rows: no rows. Further columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlark.llm.runningsums import cells, summed
from ledgerlark.llm.scratch import written
from ledgerlark.operators.ranking import globally_numbered

#: Rows of a cell on average.
CELL = 4096


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _stratum(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("n"))


def _pieces(schedules: DataFrame) -> DataFrame:
    """Schedules (source, points: array of (at, weight)) as stratum, pieces between points with the integral before each (`upto`), and the whole integral `weight`."""
    points = schedules.select(_stratum(F.col("source")).alias("stratum"), F.array_sort("points").alias("p"))
    ends = F.expr("concat(array(named_struct('at', 0D, 'weight', p[0].weight)), p, array(named_struct('at', 1D, 'weight', element_at(p, -1).weight)))")
    parts = F.expr("transform(sequence(0, size(e) - 2), i -> named_struct('t', e[i].at, 'w', e[i].weight, 'dt', e[i + 1].at - e[i].at, 'v', e[i + 1].weight))")
    pieces = F.expr("""
        aggregate(filter(parts, p -> p.dt > 0 and p.w + p.v > 0), named_struct('upto', 0D, 'pieces', cast(array() as array<struct<t:double,w:double,dt:double,slope:double,upto:double>>)),
          (s, p) -> named_struct('upto', s.upto + p.dt * (p.w + p.v) / 2,
            'pieces', concat(s.pieces, array(named_struct('t', p.t, 'w', p.w, 'dt', p.dt, 'slope', (p.v - p.w) / p.dt, 'upto', s.upto)))))
    """)
    found = points.filter("size(p) > 0").withColumn("e", ends).withColumn("parts", parts).withColumn("x", pieces)
    return found.select("stratum", "x.pieces", F.col("x.upto").alias("weight"))


def level_of(sources: DataFrame, words: float) -> float | None:
    """Where the level lies at which least(most, weight * level) of all sources (most, weight) come to so many words; None if all are at their limits."""
    level = None
    while True:
        limited = F.lit(False) if level is None else F.col("most") <= F.col("weight") * level
        seen = sources.filter("weight > 0").agg(F.sum(F.when(limited, F.col("most"))).alias("full"), F.sum(F.when(~limited, F.col("weight"))).alias("open")).first()
        if not seen.open:
            return None
        risen = (words - (seen.full or 0)) / seen.open
        if level is not None and risen <= level:
            return level
        level = risen


#: When a copy that begins at so much of its source's demand has its turn.
_TIME = """
    aggregate(filter(pieces, p -> p.upto <= q * weight), 0D, (t, p) ->
      p.t + least(p.dt, IF(q * weight - p.upto > 0, 2 * (q * weight - p.upto) / (p.w + sqrt(greatest(0D, p.w * p.w + 2 * p.slope * (q * weight - p.upto)))), 0D)))
"""


def mixed(docs: DataFrame, schedules: DataFrame, amount: float = 1.5, repeats: int = 2, seed: int = 0, text: str = "text", doc_id: str = "doc_id", source: str = "source") -> DataFrame:
    """A row for each row of docs: doc_id, source, size, source_size, target, rank (in its source's order), taken, copies (epoch, words, time).

    schedules: source, points (an array of structs of the doubles at and weight; weights are not negative).
    """
    base = docs.select(docs[doc_id].alias("doc_id"), docs[source].alias("source"), _stratum(docs[source]).alias("stratum"), n_words(docs[text]).alias("size"))
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("size").cast("string")).cast("binary"))
    base = written(base.withColumn("key", key), "sizes")
    sources = base.groupBy("stratum").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    sources = sources.join(_pieces(schedules), "stratum", "left").withColumn("weight", F.coalesce("weight", F.lit(0.0))).withColumn("most", F.col("source_size") * repeats)
    sources = written(sources, "sources")
    whole = sources.agg(F.sum("source_size").alias("words"), F.sum("n").alias("n")).first()
    level = level_of(sources, amount * (whole.words or 0))
    target = F.col("most").cast("double") if level is None else F.least(F.col("most").cast("double"), F.col("weight") * level)
    sources = sources.withColumn("target", F.when(F.col("weight") > 0, target).otherwise(0.0))

    bits = max(0, ((whole.n or 0) // CELL).bit_length())
    rows = base.withColumn("cell", F.shiftright(F.conv(F.substring("key", 1, 12), 16, 10).cast("long"), 48 - bits))
    sums = {"words": F.col("size"), "rows": F.lit(1)}
    known = cells(rows, ["stratum"], "cell", sums).join(sources.select("stratum", "source_size", "target", "weight", "pieces"), "stratum")
    placed = summed(rows, known, ["stratum"], "cell", ["key", "doc_id"], sums).withColumn("demand", F.round("target").cast("long"))
    starts = f"transform(sequence(0L, {repeats - 1}L), e -> named_struct('epoch', e, 'start', e * source_size + before_words))"
    copies = F.expr(f"""
        transform(filter({starts}, x -> size > 0 and x.start < demand), x -> named_struct('epoch', cast(x.epoch as int), 'words', least(size, demand - x.start),
          'time', transform(array(x.start / cast(demand as double)), q -> {_TIME})[0]))
    """)
    placed = placed.withColumn("copies", copies)
    return placed.select(
        F.col("doc_id").alias(doc_id), F.col("source").alias(source), "stratum", "size", "source_size", "target", F.col("before_rows").alias("rank"), F.expr("aggregate(copies, 0L, (n, x) -> n + x.words)").alias("taken"), "copies",
    )


def training_order(placed: DataFrame) -> DataFrame:
    """The copies that mixed() takes, each with its gapless place `slot` among all (from 0): the columns of mixed() but for copies, and epoch, words, time, slot."""
    copies = placed.withColumn("x", F.explode("copies")).select(*[c for c in placed.columns if c != "copies"], "x.*")
    return globally_numbered(copies, [F.col("time"), F.col("stratum"), F.col("epoch"), F.col("rank")], "slot", first=0)
