"""JSON envelopes of prices, as one-row tables."""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

log = logging.getLogger(__name__)
#: Keys of one map at most.
MOST_KEYS = 10_000


def later_wins(df: DataFrame, key: list[str], seq: str, value: Column) -> DataFrame:
    """For each key the value of the row that comes last."""
    return df.groupBy(*key).agg(F.max_by(value, F.col(seq)).alias("value"))


def price_map(df: DataFrame, key: str, seq: str, value: Column, most: int = MOST_KEYS) -> DataFrame:
    """One row with a map from key to value; a later row of a key replaces an earlier one. More than `most` keys are an error, and no more are ever gathered."""
    entries = F.array_sort(F.collect_list(F.struct(F.col(key), F.col("value"))))
    rows = later_wins(df, [key], seq, value).limit(most + 1).agg(F.count(F.lit(1)).alias("n"), F.map_from_entries(entries).alias("prices"))
    return rows.select(F.when(F.col("n") > most, F.raise_error(F.lit(f"more than {most} keys in one map"))).otherwise(F.col("prices")).alias("prices"))


def nested_prices(df: DataFrame, day: str, key: str, seq: str, value: Column) -> DataFrame:
    """One row for each day, with a map from key to value."""
    entries = F.array_sort(F.collect_list(F.struct(F.col(key), F.col("value"))))
    return later_wins(df, [day, key], seq, value).groupBy(day).agg(F.map_from_entries(entries).alias("prices"))


def one_or_many(body: Column, schema: str) -> Column:
    """JSON of one object or of a list of them, as an array of structs. Null, and what is neither: null."""
    text = F.ltrim(body)
    return F.when(F.startswith(text, F.lit("[")), F.from_json(body, f"array<{schema}>")).when(F.startswith(text, F.lit("{")), F.array(F.from_json(body, schema)))


def quote_envelope(prices: DataFrame, timestamp: str, source: str, market_state: str) -> DataFrame:
    """prices (one row with a map) as a JSON text, with when and whence it is and whether the market is open."""
    fields = F.struct("prices", F.lit(timestamp).alias("timestamp"), F.lit(source).alias("source"), F.lit(market_state).alias("marketState"), F.lit(market_state == "REGULAR").alias("isOpen"))
    return prices.select(F.to_json(fields).alias("body"), F.lit(200).alias("status"))


def error_envelope(prices: DataFrame, message: str) -> DataFrame:
    """What a failed fetch answers: no prices, and status 502. The failure is logged."""
    log.error("prices could not be fetched: %s", message)
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<double>"))
    return prices.sparkSession.range(1).select(F.to_json(F.struct(empty.alias("prices"), F.lit(message).alias("error"))).alias("body"), F.lit(502).alias("status"))
