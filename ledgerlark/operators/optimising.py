"""An extension: weights of least risk for a wanted return, from co-moments of returns.

The source of these features only declares an optimiser, with its limits (a
largest weight, a smallest position, weeks to look back); this one is of our own
and claims no parity with any.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Steps of the solver at most, and the change of weights at which it ends.
STEPS, ENOUGH = 20_000, 1e-12


def moments(returns: DataFrame, by: list[str], at: str, asset: str, ret: str) -> DataFrame:
    """For each group and pair of assets (a <= b): n (times at which both have a return), mean_a, mean_b, covariance (of a sample; null for one time).

    Returns of one time are gathered (an asset's row each, a portfolio's assets),
    and all pairs' sums come from one aggregation. Times without one of the two
    do not count for a pair; of several rows of an asset the greatest counts.
    """
    one = returns.filter(F.col(ret).isNotNull() & F.col(asset).isNotNull()).groupBy(*by, at, asset).agg(F.max(ret).alias("r"))
    rows = one.groupBy(*by, at).agg(F.array_sort(F.collect_list(F.struct(F.col(asset).alias("asset"), "r"))).alias("x"))
    pairs = F.flatten(F.transform("x", lambda a, i: F.transform(F.slice("x", i + 1, F.size("x")), lambda b: F.struct(a["asset"].alias("a"), b["asset"].alias("b"), a["r"].alias("ra"), b["r"].alias("rb")))))
    each = rows.select(*by, F.inline(pairs))
    return each.groupBy(*by, "a", "b").agg(F.count(F.lit(1)).alias("n"), F.avg("ra").alias("mean_a"), F.avg("rb").alias("mean_b"), F.covar_samp("ra", "rb").alias("covariance"))


def within(x: np.ndarray, most: float) -> np.ndarray:
    """The nearest weights from 0 to `most` that add up to 1: x less a common shift, found between its breakpoints."""
    points = np.sort(np.concatenate([x, x - most]))
    sums = np.clip(x[None, :] - points[:, None], 0, most).sum(axis=1)  # falls from point to point
    k = int(np.clip(np.searchsorted(-sums, -1.0), 1, len(points) - 1))
    a, b = points[k - 1], points[k]
    shift = a + (sums[k - 1] - 1) * (b - a) / (sums[k - 1] - sums[k]) if sums[k - 1] > sums[k] else a
    return np.clip(x - shift, 0, most)


def least_risk(covariance: np.ndarray, means: np.ndarray, tilt: float, most: float) -> np.ndarray:
    """Weights w from 0 to `most`, together 1, with the least w'Cw / 2 - tilt * means'w, by accelerated projected steps."""
    n = len(means)
    most = max(most, 1 / n)
    w = y = np.full(n, 1 / n)
    step, pace = 1 / max(np.linalg.eigvalsh(covariance)[-1], 1e-300), 1.0
    for _ in range(STEPS):
        new = within(y - step * (covariance @ y - tilt * means), most)
        if (new - w) @ (y - new) > 0:  # it goes back: begin anew from here
            pace = 1.0
        ahead = (1 + np.sqrt(1 + 4 * pace * pace)) / 2
        y, moved = new + (pace - 1) / ahead * (new - w), np.abs(new - w).max()
        w, pace = new, ahead
        if moved < ENOUGH:
            break
    return w


def capped_weights(found: DataFrame, by: list[str], tilt: float = 0.0, most: float = 0.3, least: float = 0.0) -> DataFrame:
    """For each group of moments(): asset and weight; weights under `least` are left out and the rest solved again.

    A group is one portfolio's matrix at one time. A pair without a covariance
    counts as unrelated, an asset without one is left out. A group of few assets
    may have weights above `most`, where together they would not make 1.
    """
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in found.select(*by).schema], "asset string", "weight double"])

    def solved(rows: pd.DataFrame) -> pd.DataFrame:
        own = rows[(rows["a"] == rows["b"]) & rows["covariance"].notna()]
        assets = sorted(own["a"])
        at = {x: i for i, x in enumerate(assets)}
        matrix, means = np.zeros((len(assets), len(assets))), np.zeros(len(assets))
        for a, b, mean, c in zip(rows["a"], rows["b"], rows["mean_a"], rows["covariance"], strict=True):
            if a in at and b in at and c == c:
                matrix[at[a], at[b]] = matrix[at[b], at[a]] = c
            if a == b and a in at:
                means[at[a]] = mean
        kept = np.arange(len(assets))
        weights = np.zeros(len(assets))
        while len(kept):
            w = least_risk(matrix[np.ix_(kept, kept)], means[kept], tilt, most)
            if (w >= least).all() or len(kept) == 1:
                weights[kept] = w
                break
            kept = np.delete(kept, np.argmin(w))
        out = {c: pd.Series([rows[c].iloc[0]] * len(assets), dtype=object) for c in by}
        return pd.DataFrame(out | {"asset": pd.Series(assets, dtype=object), "weight": weights})

    return found.groupBy(*by).applyInPandas(solved, schema)


def looking_back(day: Column, weeks: int) -> Column:
    """The Mondays at which a day's return is among those of the `weeks` weeks before."""
    monday = F.date_trunc("week", day).cast("date")
    return F.transform(F.sequence(F.lit(1), F.lit(weeks)), lambda k: F.date_add(monday, k * 7))
