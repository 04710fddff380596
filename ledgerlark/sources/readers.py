"""Readers of landed files and of request parameters; nothing here reaches a network."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ledgerlark.sources.schemas import BARS, PORTFOLIO, QUOTES

log = logging.getLogger(__name__)


def rows(spark: SparkSession, values: Iterable[tuple], schema: str) -> DataFrame:
    """A small table given in the program, such as a dimension."""
    return spark.createDataFrame(list(values), schema)


def portfolio_document(spark: SparkSession, path: str) -> DataFrame:
    """A nested portfolio document: one row."""
    return spark.read.schema(PORTFOLIO).json(path, multiLine=True)


def _week(document: DataFrame) -> DataFrame:
    return document.select(F.posexplode("weeks").alias("at", "w")).select((F.col("at") + 1).alias("week"), "w.*")


def week_table(document: DataFrame) -> DataFrame:
    """A row for each week: week, label, calc_date, exec_date, period_end, status, weekly_return."""
    date = lambda c: F.to_date(c)
    return _week(document).select("week", "label", date("calcDate").alias("calc_date"), date("execDate").alias("exec_date"), date("periodEnd").alias("period_end"), "status", F.col("weeklyReturn").alias("weekly_return"))


def week_items(document: DataFrame, field: str) -> DataFrame:
    """The items of an array in each week: week, at (place in the array, from 0) and the item's fields; a week without the array has none."""
    return _week(document).select("week", F.posexplode(field).alias("at", "x")).select("week", "at", "x.*")


def week_weights(document: DataFrame) -> DataFrame:
    """Weights in long form: week, ticker, weight."""
    return _week(document).select("week", F.explode("weights").alias("ticker", "weight"))


def drifting(df: DataFrame, column: str, fields: dict[str, tuple[str, str]]) -> DataFrame:
    """Documents whose shape changes from row to row: df with `document`, all that a JSON text holds as a VARIANT, and fields (name: path, type) as columns.

    A field that a document lacks, or has in another type, is null; it is still
    in `document`, as are fields that nobody has asked for yet. A text that is no
    JSON gives nulls.
    """
    parsed = df.withColumn("document", F.try_parse_json(F.col(column)))
    return parsed.withColumns({name: F.try_variant_get("document", path, kind) for name, (path, kind) in fields.items()})


def document_fields(df: DataFrame, column: str) -> DataFrame:
    """A row for each field of each document: the other columns of df, field, and value (a VARIANT)."""
    others = [c for c in df.columns if c != column]
    pairs = F.map_entries(F.try_variant_get(column, "$", "map<string,variant>"))
    return df.select(*others, F.explode(pairs).alias("x")).select(*others, F.col("x.key").alias("field"), F.col("x.value").alias("value"))


def quotes(spark: SparkSession, path: str) -> DataFrame:
    """Quotes that were landed as JSON lines."""
    return spark.read.schema(QUOTES).json(path)


def bars(spark: SparkSession, path: str) -> DataFrame:
    """Daily bars that were landed as Parquet."""
    return spark.read.schema(BARS).parquet(path)


def symbols(param: str | None, default: str) -> list[str]:
    """A comma-separated request parameter; the default where it is missing or empty. Nothing is trimmed or dropped."""
    return (param or default).split(",")


def only_symbols(df: DataFrame, column: str, wanted: list[str]) -> DataFrame:
    """Rows of the wanted symbols; the filter reaches the scan."""
    return df.filter(F.col(column).isin(wanted))


def between_days(df: DataFrame, column: str, day: str, before: int = 1, after: int = 2) -> DataFrame:
    """Rows from `before` days before a day to `after` days after it, both included."""
    return df.filter(F.col(column).between(F.date_sub(F.lit(day).cast("date"), before), F.date_add(F.lit(day).cast("date"), after)))


def between_times(df: DataFrame, column: str, span: DataFrame, first: str, last: str, tolerance: str) -> DataFrame:
    """Rows whose time lies between the first and last of a one-row span, and a tolerance beyond both.

    Both bounds are scalar subqueries: nothing runs while the query is built, and
    the scan gets their values before it starts.
    """
    bound = lambda c, sign: span.select(F.expr(f"`{c}` {sign} INTERVAL {tolerance}")).scalar()
    return df.filter((F.col(column) >= bound(first, "-")) & (F.col(column) <= bound(last, "+")))


def each_alone(fetch: Callable[[list[str]], list[dict]], key: str) -> Callable[[list[str]], list[dict]]:
    """A client that asks for each symbol by itself; one that fails is logged and gives a row with the symbol alone, and the rest go on."""

    def run(wanted: list[str]) -> list[dict]:
        found = []
        for symbol in wanted:
            try:
                found += fetch([symbol])
            except Exception:
                log.exception("%s could not be fetched", symbol)
                found.append({key: symbol})
        return found

    return run


def land(fetch: Callable[[list[str]], list[dict]], spark: SparkSession, wanted: list[str], path: str, schema: str = QUOTES) -> DataFrame:
    """Lands what a remote client returns for all symbols in one call, and reads it back; how to reach the remote side is the caller's."""
    names = StructType.fromDDL(schema).fieldNames()
    found = [tuple(x.get(n) for n in names) for x in fetch(wanted)]
    spark.createDataFrame(found, schema).write.mode("append").json(path)
    return spark.read.schema(schema).json(path)
