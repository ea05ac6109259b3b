"""A Spark data source for vendor bar files: ``spark.read.format("vendor_bars").load(folder)`` after ``register(spark)``.

A folder holds CSV files with headers in a vendor's column names, a folder ``symbol=<ticker>`` per ticker, as most vendors deliver them. Columns come out under
their plain names as doubles, without thousands separators. A file is a partition. Filters on ``Ticker`` are pushed down and leave out whole files before any
is opened; filters on ``Date`` are pushed down too and leave out rows in the reader, so they never reach Arrow.
"""

from __future__ import annotations

import csv
from collections.abc import Iterator
from datetime import date, datetime
from urllib.parse import unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

from quantloom.operators.bars import ALIASES, OHLCV

SCHEMA = "Ticker string, Date date, Open double, High double, Low double, Close double, Volume double"
_ARROW = pa.schema([("Ticker", pa.string()), ("Date", pa.date32()), *((c, pa.float64()) for c in OHLCV)])
ROWS = 8192


class VendorFile(InputPartition):
    def __init__(self, path: str, ticker: str) -> None:
        self.path, self.ticker = path, ticker


def _number(text: str | None) -> float | None:
    try:
        return float(text.replace(",", "")) if text else None
    except ValueError:
        return None


class VendorReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.folder, self.date_format = options["path"], options.get("dateformat", "%Y-%m-%d")
        self.tickers: set[str] | None = None
        self.since, self.until = date.min, date.max  # both included

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes what it can; yields the filters that Spark must still apply: strict bounds, and whatever else."""
        for f in filters:
            if f.attribute == ("Ticker",) and isinstance(f, (EqualTo, In)):
                own = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.tickers = own if self.tickers is None else self.tickers & own
                continue
            if f.attribute == ("Date",) and isinstance(getattr(f, "value", None), date):
                if isinstance(f, (GreaterThan, GreaterThanOrEqual, EqualTo)):
                    self.since = max(self.since, f.value)
                if isinstance(f, (LessThan, LessThanOrEqual, EqualTo)):
                    self.until = min(self.until, f.value)
                if isinstance(f, (GreaterThanOrEqual, LessThanOrEqual, EqualTo)):
                    continue
            yield f

    def partitions(self) -> list[InputPartition]:
        store, root = fs.FileSystem.from_uri(self.folder)
        found, folders = [], [root]
        while folders:  # folders of tickers that are left out are not listed
            for info in store.get_file_info(fs.FileSelector(folders.pop())):
                ticker = next((unquote(x[7:]) for x in info.path.split("/") if x.startswith("symbol=")), None)
                if info.type == fs.FileType.Directory and (ticker is None or self.tickers is None or ticker in self.tickers):
                    folders.append(info.path)
                elif info.is_file and info.base_name.endswith(".csv") and (self.tickers is None or ticker in self.tickers):
                    found.append(VendorFile(info.path, ticker))
        return found or [VendorFile("", "")]

    def read(self, partition: VendorFile) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        store, _ = fs.FileSystem.from_uri(self.folder)
        columns: dict[str, list] = {c: [] for c in _ARROW.names}
        with store.open_input_stream(partition.path) as stream:
            for row in csv.DictReader(_lines(stream)):
                plain = {ALIASES.get(k, k): v for k, v in row.items()}
                day = datetime.strptime(plain["Date"], self.date_format).date() if plain.get("Date") else None
                if day is None or not self.since <= day <= self.until:
                    continue
                columns["Ticker"].append(partition.ticker)
                columns["Date"].append(day)
                for c in OHLCV:
                    columns[c].append(_number(plain.get(c)))
                if len(columns["Date"]) == ROWS:
                    yield pa.RecordBatch.from_pydict(columns, schema=_ARROW)
                    columns = {c: [] for c in columns}
        if columns["Date"]:
            yield pa.RecordBatch.from_pydict(columns, schema=_ARROW)


def _lines(stream: pa.NativeFile) -> Iterator[str]:
    """Text lines of a stream, a megabyte at a time."""
    rest = b""
    while block := stream.read(1 << 20):
        *whole, rest = (rest + block).split(b"\n")
        yield from (x.decode() for x in whole)
    if rest:
        yield rest.decode()


class VendorBars(DataSource):
    @classmethod
    def name(cls) -> str:
        return "vendor_bars"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> VendorReader:
        return VendorReader(self.options)


def register(spark: SparkSession) -> None:
    """Make the format known to the session, with filter push-down."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(VendorBars)
