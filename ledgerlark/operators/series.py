"""Series of returns: differences, risk figures, and expected returns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlark.functions.semantics import ratio
from ledgerlark.plans.shared import written

#: Classes of a histogram, and values that are sorted in one buffer at most.
CLASSES, SORTED = 4096, 1 << 14


def period_changes(df: DataFrame, by: list[str], order: str, columns: list[str]) -> DataFrame:
    """Value less previous value (arithmetic) for each column, without the first row of each group.

    The first row is the base that a cumulative series starts from. The first
    period after it is its own value, whatever the base is.
    """
    w = Window.partitionBy(*by).orderBy(order)
    out = df.withColumn("__n", F.row_number().over(w))
    out = out.withColumns({f"{c}_change": F.when(F.col("__n") == 2, F.col(c)).otherwise(F.col(c) - F.lag(c).over(w)) for c in columns})
    return out.filter("__n > 1").drop("__n")


def geometric_change(cumulative: Column, previous: Column) -> Column:
    """An extension: the return of a period from cumulative returns, both as fractions."""
    return ratio(1 + cumulative, 1 + F.coalesce(previous, F.lit(0.0))) - 1


def to_first(df: DataFrame, by: list[str], order: str, column: str, name: str) -> DataFrame:
    """Each value's change since the group's first, as a fraction."""
    w = Window.partitionBy(*by).orderBy(order)
    return df.withColumn(name, ratio(F.col(column), F.first(column).over(w)) - 1)


def flag_last(df: DataFrame, by: list[str], order: str, name: str = "is_last") -> DataFrame:
    return df.withColumn(name, F.lead(order).over(Window.partitionBy(*by).orderBy(order)).isNull())


def ordinals(df: DataFrame, by: list[str], order: str, name: str = "at") -> DataFrame:
    """Each row's number, from 0."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(order)) - 1)


def append_current(history: DataFrame, current: DataFrame) -> DataFrame:
    return history.unionByName(current)


def period_rate(rate: float, weeks: int = 9) -> float:
    """A yearly rate for a number of weeks."""
    return rate * (weeks / 52)


def alpha(portfolio: Column, benchmark: Column, beta: float, rate: float = 0.0425, weeks: int = 9, rate_in_percent: bool = False) -> dict[str, Column]:
    """Return beyond what beta explains: expected, alpha, excess.

    By default the returns are percentages and the rate a fraction, as published;
    with `rate_in_percent` the rate is scaled to the same unit.
    """
    free = period_rate(rate, weeks) * (100 if rate_in_percent else 1)
    expected = F.lit(free) + F.lit(beta) * (benchmark - F.lit(free))
    return {"expected": expected, "alpha": portfolio - expected, "excess": portfolio - benchmark}


def weekly_expectation(rate: float, beta: float, premium: float = 0.045) -> float:
    """The return of a week that a beta lets expect."""
    return rate / 52 + beta * premium / 52


def annualised_pct(weekly: Column) -> Column:
    """52 times a week's return, in % (not compounded)."""
    return weekly * 52 * 100


def risk(df: DataFrame, by: list[str], ret: str, market: str, weekly_rate: float) -> DataFrame:
    """An extension: figures of returns against a market, from one aggregation but for the quantile.

    mean, volatility, Sharpe ratio, beta, alpha, correlation, tracking error
    (deviation of what the returns have beyond the market), information ratio
    (its mean for each unit of that), and var_95 (the return that is undercut in
    one of twenty periods, interpolated).
    """
    beyond = F.col(ret) - F.col(market)
    stats = df.groupBy(*by).agg(
        F.avg(ret).alias("mean"), F.stddev_samp(ret).alias("volatility"), F.regr_slope(ret, market).alias("beta"), F.avg(market).alias("__market"),
        F.corr(ret, market).alias("correlation"), F.stddev_samp(beyond).alias("tracking_error"), F.avg(beyond).alias("__beyond"),
    )
    undercut = quantile(df, by, ret, 0.05).select(*[F.col(c).alias(f"__{c}") for c in by], F.col("quantile").alias("var_95"))
    stats = stats.join(undercut, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by]).drop(*[f"__{c}" for c in by])
    sharpe = ratio(F.col("mean") - weekly_rate, F.col("volatility"))
    stats = stats.withColumn("information_ratio", ratio(F.col("__beyond"), F.col("tracking_error"))).drop("__beyond")
    return stats.withColumn("sharpe", sharpe).withColumn("alpha", F.col("mean") - (weekly_rate + F.col("beta") * (F.col("__market") - weekly_rate))).drop("__market")


def quantile(df: DataFrame, by: list[str], column: str, q: float) -> DataFrame:
    """For each group the exact quantile of a column, interpolated between neighbours; nulls and NaN are left out.

    The two values around the quantile's rank are found by histograms of
    `CLASSES` classes between the least and the greatest value that each may
    still be: a pass counts the classes, and the one that holds the rank gives
    the next pass's bounds. Classes are powers of 2 with their sign until the
    bounds lie within one, then equal parts, so five or six passes are enough for
    any values. Once at most `SORTED` values are left between the
    bounds they are sorted. A buffer holds that many values at most, however many
    a group has, and only counts of classes are shuffled until then. Where no
    group has more from the start, there are no passes.
    """
    names = [f"__{i}" for i in range(len(by))]
    value = F.col(column).cast("double")
    x = df.select(*[F.col(c).alias(n) for c, n in zip(by, names, strict=True)], value.alias("v")).filter("v is not null and not isnan(v)")
    if (x.groupBy(*names).agg(F.count(F.lit(1)).alias("c")).agg(F.max("c")).first()[0] or 0) <= SORTED:  # every group fits into a buffer
        return x.groupBy(*names).agg(F.percentile("v", F.lit(q)).alias("quantile")).select(*[F.col(n).alias(c) for n, c in zip(names, by, strict=True)], "quantile")
    x = written(x, "values")
    keys = df.sparkSession.createDataFrame([(0,), (1,)], "which int")
    seen = x.groupBy(*names).agg(F.count(F.lit(1)).alias("c"), F.min("v").alias("lo"), F.max("v").alias("hi")).withColumn("at", (F.col("c") - 1) * F.lit(q))
    goals = seen.crossJoin(F.broadcast(keys)).select(*names, "which", "lo", "hi", "c", (F.col("at") - F.floor("at")).alias("part"), F.when(F.col("which") == 0, F.floor("at")).otherwise(F.ceil("at")).alias("rank"))
    goals = written(goals, "goals")

    def between(goals: DataFrame) -> DataFrame:
        bounds = goals.select(*[F.col(n).alias(f"of{n}") for n in names], "which", "lo", "hi", "rank", "part")
        same = (x["v"] >= F.col("lo")) & (x["v"] <= F.col("hi"))
        for n in names:
            same = same & x[n].eqNullSafe(F.col(f"of{n}"))
        return x.join(bounds, same)

    while not goals.filter((F.col("lo") < F.col("hi")) & (F.col("c") > SORTED)).isEmpty():
        wide = goals.filter((F.col("lo") < F.col("hi")) & (F.col("c") > SORTED))
        share = (F.col("v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2)
        near = (F.signum("lo") == F.signum("hi")) & (F.greatest(F.abs("lo"), F.abs("hi")) / 2 <= F.least(F.abs("lo"), F.abs("hi")))
        power = F.signum("v") * (F.floor(F.log2(F.abs("v"))) + 1100)
        by_class = between(wide).withColumn("class", F.when(near, F.least(F.floor(share * CLASSES), F.lit(CLASSES - 1))).otherwise(F.coalesce(power, F.lit(0))).cast("int")).groupBy(*names, "which", "rank", "part", "class").agg(F.count(F.lit(1)).alias("c"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        before = F.coalesce(F.sum("c").over(Window.partitionBy(*names, "which").orderBy("class").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        held = by_class.withColumn("before", before).filter((F.col("before") <= F.col("rank")) & (F.col("rank") < F.col("before") + F.col("c")))
        done = goals.filter((F.col("lo") == F.col("hi")) | (F.col("c") <= SORTED))
        goals = written(done.unionByName(held.withColumn("rank", F.col("rank") - F.col("before")).select(*goals.columns)), "goals")
    few = between(goals.filter("lo < hi")).groupBy(*names, "which", "part").agg(F.array_sort(F.collect_list("v"))[F.first("rank").cast("int")].alias("v"))
    found = few.unionByName(goals.filter("lo = hi").select(*names, "which", "part", F.col("lo").alias("v")))
    pick = lambda k: F.max(F.when(F.col("which") == k, F.col("v")))
    both = found.groupBy(*names).agg(pick(0).alias("a"), pick(1).alias("b"), F.first("part").alias("part"))
    return both.select(*[F.col(n).alias(c) for n, c in zip(names, by, strict=True)], (F.col("a") + (F.col("b") - F.col("a")) * F.col("part")).alias("quantile"))


def drawdown(df: DataFrame, by: list[str], order: str, level: str) -> DataFrame:
    """An extension: the deepest fall of a level below its highest so far, as a fraction."""
    peak = F.max(level).over(Window.partitionBy(*by).orderBy(order))
    return df.withColumn("__d", ratio(F.col(level), peak) - 1).groupBy(*by).agg(F.min("__d").alias("max_drawdown"))


def ledger(events: DataFrame, kind: str, amount: str) -> DataFrame:
    """Sums of a cash ledger by kind."""
    return events.groupBy(kind).agg(F.sum(amount).cast("bigint").alias("amount"), F.count(F.lit(1)).alias("n"))
