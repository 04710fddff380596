"""Trades matched to price bars in time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FIRST, NEAREST = "first", "nearest"
#: Cells that a block of the time line falls into.
CELLS = 64


def least_in_ranges(points: DataFrame, ranges: DataFrame, key: list[str], length: int, values: list[str]) -> DataFrame:
    """For each range the least value of the points of its key inside it; ranges without one are left out.

    points: key, at (a whole number) and `values`, columns of one type. ranges:
    key, low, which (the place in `values` of the one that counts) and others;
    a range holds the points with low < at < low + length. Returns the columns
    of ranges but for low, and `least`.

    Points and ends of ranges are merged into one order. Blocks as long as a
    range cut it, so a range is the rest of one block behind its low end and the
    beginning of the next before its high end: two running minima, one in each
    direction. Each block is cut into cells again, whose minima are carried on to
    the cells before and behind, so a key with many points in a block is spread,
    too. No pair of a point and a range is ever formed: work grows with the rows
    alone.
    """
    others = [c for c in ranges.columns if c not in (*key, "low", "which")]
    both = F.array(F.struct(F.col("low").alias("at"), F.lit(-1).alias("side")), F.struct((F.col("low") + length).alias("at"), F.lit(1).alias("side")))
    ends = ranges.select(*key, "which", F.struct(*others).alias("of"), F.inline(both))
    rows = points.select(*key, "at", *values).unionByName(ends, True)
    rows = rows.withColumn("block", F.floor(F.col("at") / F.lit(length))).withColumn("cell", F.floor((F.col("at") - F.col("block") * length) / F.lit(max(1.0, length / CELLS))))
    block = [*key, "block"]

    # inside cells; an end stands before points of its time in both directions, so it is not part of the range
    up, down = (Window.partitionBy(*block, "cell").orderBy(at, F.col("side").isNull()) for at in (F.asc("at"), F.desc("at")))
    ahead = F.col("side") == 1
    own = [F.when(ahead, F.min(v).over(up.rowsBetween(Window.unboundedPreceding, 0))).otherwise(F.min(v).over(down.rowsBetween(Window.unboundedPreceding, 0))).alias(f"own_{v}") for v in values]
    inside = rows.select(*block, "cell", "side", "which", "of", *own).filter("side is not null")

    # from cell to cell
    cells = rows.groupBy(*block, "cell").agg(*[F.min(v).alias(v) for v in values])
    before, behind = (Window.partitionBy(*block).orderBy(c).rowsBetween(Window.unboundedPreceding, -1) for c in (F.asc("cell"), F.desc("cell")))
    cells = cells.select(*block, "cell", *[F.min(v).over(w).alias(f"{n}_{v}") for v in values for n, w in (("before", before), ("behind", behind))])
    joined = inside.join(cells, [*block, "cell"])
    best = None
    for k, v in enumerate(values):
        value = F.least(f"own_{v}", F.when(ahead, F.col(f"before_{v}")).otherwise(F.col(f"behind_{v}")))
        best = F.when(F.col("which") == k, value) if best is None else best.when(F.col("which") == k, value)
    return joined.withColumn("best", best).groupBy(*key, "which", "of").agg(F.min("best").alias("least")).filter("least is not null").select(*key, "of.*", "which", "least")


def match_bars(trades: DataFrame, bars: DataFrame, key: str, mode: str = FIRST, tolerance: str = "1 day") -> DataFrame:
    """For each trade (trade_id, key, at) the bar (bar_seq, key, bar_ts, open) of the same key less than the tolerance away.

    `first` takes the bar that comes first in bar_seq, `nearest` the nearest in
    time, the earlier of two. Trades without a bar are left out, as are trades
    and bars without key or time. Both modes are an ordered merge (see
    least_in_ranges()): `first` asks for the least bar_seq in the range around
    the trade, `nearest` for the last bar in the range before it and the first
    in the range behind it.
    """
    length = int(tolerance.split()[0]) * {"day": 86_400, "hour": 3_600, "minute": 60, "second": 1}[tolerance.split()[1].rstrip("s")] * 1_000_000
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    bar = lambda *order: F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], F.col("bar_seq").alias("bar_seq"), F.col("bar_ts").alias("bar_ts"), F.col("open").alias("open"))
    bars = bars.filter(F.col(key).isNotNull() & F.col("bar_ts").isNotNull()).withColumn("at", micros("bar_ts"))
    asked = trades.filter(F.col(key).isNotNull() & F.col("at").isNotNull()).select("trade_id", key, "at", micros("at").alias("time"))
    if mode == FIRST:
        points = bars.select(key, "at", bar(F.lit(0)).alias("v"))
        ranges = asked.withColumn("low", F.col("time") - length).withColumn("which", F.lit(0))
        found = least_in_ranges(points, ranges, [key], 2 * length, ["v"])
        return found.select("trade_id", key, "at", "least.bar_seq", "least.bar_ts", "least.open")
    points = bars.select(key, "at", bar(-F.col("at")).alias("last"), bar(F.col("at")).alias("first"))
    sides = F.array(F.struct((F.col("time") - length).alias("low"), F.lit(0).alias("which")), F.struct((F.col("time") - 1).alias("low"), F.lit(1).alias("which")))
    ranges = asked.select("*", F.inline(sides))
    found = least_in_ranges(points, ranges, [key], length + 1, ["last", "first"])
    at = F.unix_micros(F.col("least.bar_ts").cast("timestamp"))
    order = F.struct(F.abs(F.col("time") - at).alias("away"), at.alias("bar"), "least.bar_seq")
    return found.groupBy("trade_id", key, "at").agg(F.min_by("least", order).alias("b")).select("trade_id", key, "at", "b.bar_seq", "b.bar_ts", "b.open")


def exploded(executions: DataFrame) -> DataFrame:
    """A row for each day and ticker of planned executions."""
    return executions.select("exec_date", F.explode("tickers").alias("ticker"))


def with_prices(trades: DataFrame, prices: DataFrame) -> DataFrame:
    """Trades with the price of their day and ticker; null where there is none."""
    return trades.join(prices, ["exec_date", "ticker"], "left")


def labelled_history(rows: DataFrame, *parts: tuple[str, str | None, Column]) -> DataFrame:
    """trade_history() of parts of one table in one scan: (label, action or None to keep the row's, condition); a row is in the first part whose condition holds."""
    number = label = action = None
    for k, (name, fixed, condition) in enumerate(parts):
        values = F.lit(k), F.lit(name), F.lit(fixed) if fixed else F.col("action")
        number, label, action = (F.when(condition, v) if w is None else w.when(condition, v) for w, v in zip((number, label, action), values, strict=True))
    out = rows.select(number.alias("part"), label.alias("week"), "exec_date", "ticker", action.alias("action"), "shares", "at")
    return out.filter("part is not null")


def trade_history(*parts: tuple[str, str | None, DataFrame]) -> DataFrame:
    """All trades of several sources: (label, action or None to keep the source's, rows of exec_date, ticker, action, shares, at)."""
    out = None
    for k, (label, action, rows) in enumerate(parts):
        own = rows.select(F.lit(k).alias("part"), F.lit(label).alias("week"), "exec_date", "ticker", (F.lit(action) if action else F.col("action")).alias("action"), "shares", "at")
        out = own if out is None else out.unionByName(own)
    return out
