"""A data source over landed quotes and bars, which takes symbols and days from a query's filters.

    table(spark, "bars", "/landed/bars", symbols=["A", "B"], first="2026-01-02")
    table(spark, "bars", "/landed/bars", push=True).filter("symbol IN ('A', 'B') AND day >= '2026-01-02'")

Files (JSON lines or Parquet) lie under symbol=.../day=.../ of any file system
that Arrow reads. A partition is one symbol's one day, so a day's load is spread
over tasks; those that an argument or a pushed filter rules out are not opened. A
file that cannot be read gives one row with its name in `file` and what went
wrong in `error`, and all others go on.

With the option `client` ("module:function") no files are read: each partition
calls function(symbol, day), which returns rows as dicts, in a task of its own.
The query must then name its symbols and bound its days, and a call that fails
gives a row with the error, too.

As a stream it delivers files as they are landed, by the time of modification: a
file must not be put in place with an older time than one that was seen.
"""

from __future__ import annotations

import datetime as dt
import importlib
import json
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.json
import pyarrow.parquet
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ledgerlark.sources.schemas import BARS, QUOTES

_KINDS = {"quotes": QUOTES, "bars": BARS.replace("ticker string, ", "")}


def register(spark: SparkSession) -> None:
    """Makes the format "landed" known, and lets filters reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(LandedSource)


def table(spark: SparkSession, kind: str, path: str | None = None, client: str | None = None, symbols: list[str] | None = None, first: str | None = None, last: str | None = None, push: bool = False) -> DataFrame:
    """Rows of the files below a path, or what a client answers, for some symbols and from a first to a last day.

    With `push` a query's own filters reach the source, too. Such a table may
    stand only once in a query: Spark keeps what was pushed last for all scans of
    one table (call table() for each use). That is also why it has a condition
    that holds for every row: without one Spark would read again what the query
    before has asked for.
    """
    register(spark)
    options = {"kind": kind, "path": path, "client": client, "symbols": None if symbols is None else json.dumps(symbols), "first": first, "last": last, "push": str(push).lower()}
    rows = spark.read.format("landed").options(**{k: v for k, v in options.items() if v is not None}).load()
    return rows.filter("day IS NOT NULL") if push else rows


@dataclass
class Day(InputPartition):
    """One symbol's one day, and its files (none where a client is asked)."""

    symbol: str
    day: dt.date
    files: list[str]


class LandedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "landed"

    def schema(self) -> str:
        fields = [f for f in _KINDS[self.options.get("kind", "quotes")].split(", ") if not f.startswith("symbol ")]
        return ", ".join(["symbol string", "day date", *fields, "file string", "error string"])

    def reader(self, schema: StructType) -> Reader:
        return (PushedReader if self.options.get("push") == "true" else Reader)(schema, self.options)

    def streamReader(self, schema: StructType) -> StreamReader:
        return StreamReader(schema, self.options)


class _Files:
    """Where the files lie, and how their rows become Arrow batches of the schema."""

    def __init__(self, schema: StructType, options: dict[str, str]):
        self.schema, self.client = to_arrow_schema(schema), options.get("client")
        self.path = options.get("path", "")

    def _at(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)

    def below(self, folder: str, key: str) -> Iterator[tuple[str, str]]:
        """Values and folders of one level of the layout."""
        for info in sorted(self._at()[0].get_file_info(fs.FileSelector(folder)), key=lambda x: x.path):
            if info.type == fs.FileType.Directory and info.base_name.startswith(f"{key}="):
                yield unquote(info.base_name[len(key) + 1 :]), info.path

    def days(self, symbols: set[str] | None = None, fits=lambda day: True) -> Iterator[tuple[str, dt.date, list[fs.FileInfo]]]:
        system, root = self._at()
        for symbol, folder in self.below(root, "symbol"):
            if symbols is None or symbol in symbols:
                for day, place in self.below(folder, "day"):
                    if fits(date := dt.date.fromisoformat(day)):
                        files = [x for x in system.get_file_info(fs.FileSelector(place)) if x.is_file and x.base_name[0] not in "._"]
                        yield symbol, date, sorted(files, key=lambda x: x.path)

    def _batches(self, part: Day, file: str | None, table: pa.Table) -> Iterator[pa.RecordBatch]:
        given = {"symbol": part.symbol, "day": part.day, "file": file}
        columns = []
        for field in self.schema:
            if field.name in given:
                columns.append(pa.array([given[field.name]] * table.num_rows, field.type))
            elif field.name in table.column_names:
                columns.append(table.column(field.name).cast(field.type))
            else:
                columns.append(pa.nulls(table.num_rows, field.type))
        yield from pa.table(columns, schema=self.schema).to_batches()

    def _failed(self, part: Day, file: str | None, error: Exception) -> pa.RecordBatch:
        row = {"symbol": part.symbol, "day": part.day, "file": file, "error": f"{type(error).__name__}: {error}"}
        return pa.RecordBatch.from_pylist([{f.name: row.get(f.name) for f in self.schema}], schema=self.schema)

    def _table(self, system: fs.FileSystem, file: str) -> pa.Table:
        with system.open_input_file(file) as f:
            if file.endswith(".parquet"):
                return pa.parquet.read_table(f)
            options = pa.json.ParseOptions(explicit_schema=pa.schema([x for x in self.schema if x.name not in ("file", "error")]), unexpected_field_behavior="ignore")
            return pa.json.read_json(f, parse_options=options) if system.get_file_info(file).size else pa.table({})

    def read(self, part: Day) -> Iterator[pa.RecordBatch]:
        if self.client:
            module, function = self.client.split(":")
            try:
                rows = list(getattr(importlib.import_module(module), function)(part.symbol, part.day))
                yield from list(self._batches(part, None, pa.Table.from_pylist(rows) if rows else pa.table({})))
            except Exception as e:
                yield self._failed(part, None, e)
        system = self._at()[0] if part.files else None
        for file in part.files:
            try:
                yield from list(self._batches(part, file, self._table(system, file)))
            except Exception as e:  # one file that is broken leaves the others
                yield self._failed(part, file, e)


class Reader(_Files, DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]):
        super().__init__(schema, options)
        self.symbols: set[str] | None = set(json.loads(options["symbols"])) if "symbols" in options else None
        self.first, self.last = (dt.date.fromisoformat(options[k]) if k in options else end for k, end in (("first", dt.date.min), ("last", dt.date.max)))

    def partitions(self) -> list[Day]:
        if self.client:
            if self.symbols is None or dt.date.min in (self.first, self.last) or self.last == dt.date.max:
                raise ValueError("a query that asks a client names its symbols and bounds its days")
            days = range((self.last - self.first).days + 1)
            return [Day(s, self.first + dt.timedelta(days=d), []) for s in sorted(self.symbols) for d in days]
        return [Day(s, day, [x.path for x in files]) for s, day, files in self.days(self.symbols, lambda day: self.first <= day <= self.last) if files]


class PushedReader(Reader):
    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes what is said about symbol and day, and leaves the rest to Spark."""
        one = dt.timedelta(days=1)
        for f in filters:
            name, value = ".".join(f.attribute) if hasattr(f, "attribute") else None, getattr(f, "value", None)
            if name == "symbol" and isinstance(f, (EqualTo, In)):
                wanted = {value} if isinstance(f, EqualTo) else set(value)
                self.symbols = wanted if self.symbols is None else self.symbols & wanted
            elif name == "day" and isinstance(value, dt.date) and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    self.first = max(self.first, value + one if isinstance(f, GreaterThan) else value)
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    self.last = min(self.last, value - one if isinstance(f, LessThan) else value)
            else:
                yield f


class StreamReader(_Files, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"ns": 0}

    def latestOffset(self) -> dict:
        return {"ns": max((x.mtime_ns for _, _, files in self.days() for x in files), default=0)}

    def partitions(self, start: dict, end: dict) -> list[Day]:
        found = ((s, day, [x.path for x in files if start["ns"] < x.mtime_ns <= end["ns"]]) for s, day, files in self.days())
        return [Day(*x) for x in found if x[2]]

    def commit(self, end: dict) -> None:
        pass
