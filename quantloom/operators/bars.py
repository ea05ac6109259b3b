"""Bars: from trades, from vendor tables and from several sources; coverage, manifest, latest rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType, TimestampType

from quantloom.functions.expr import by_date

OHLCV = ("Open", "High", "Low", "Close", "Volume")
BAR_SCHEMA = StructType([StructField("Ticker", StringType()), StructField("Date", TimestampType()), *(StructField(c, DoubleType()) for c in OHLCV)])
#: Vendor names of the columns.
ALIASES = {"OpenPrice": "Open", "HighPrice": "High", "LowPrice": "Low", "ClosePrice": "Close", "TotalTradedQuantity": "Volume", "TradedQty": "Volume", "Symbol": "Ticker"}


def require(df: DataFrame, columns: list[str] | tuple[str, ...]) -> DataFrame:
    """``df`` itself; an error that names the columns it lacks, before any job runs."""
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def bars_from_trades(df: DataFrame, ticker: str, date: str, price: str, volume: str, order: list[str]) -> DataFrame:
    """OHLCV bars by ticker and date; ``order`` says which trade of a date comes first. Aggregates partially before the shuffle."""
    key = F.struct(*order)
    return df.groupBy(F.col(ticker).cast("string").alias("Ticker"), F.to_date(date).alias("Date")).agg(
        F.min_by(price, key).alias("Open"), F.max(price).alias("High"), F.min(price).alias("Low"), F.max_by(price, key).alias("Close"), F.sum(volume).alias("Volume")
    )


def normalize_ohlcv(df: DataFrame) -> DataFrame:
    """Vendor columns under their plain names, as doubles without thousands separators; missing ones are null."""
    df = df.withColumnsRenamed({a: b for a, b in ALIASES.items() if a in df.columns and b not in df.columns})
    number = lambda c: F.expr(f"try_cast(regexp_replace(cast(`{c}` as string), ',', '') as double)")
    return df.withColumns({c: number(c) if c in df.columns else F.lit(None).cast("double") for c in OHLCV})


def between_dates(df: DataFrame, start: str, end: str) -> DataFrame:
    return df.filter(F.col("Date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def drop_empty_tickers(df: DataFrame) -> DataFrame:
    """Bars of the tickers that have any ``Close``."""
    full = df.groupBy("Ticker").agg(F.count("Close").alias("n")).filter("n > 0").select("Ticker")
    return df.join(full, "Ticker", "left_semi")


def coverage_gaps(df: DataFrame, start: str, end: str) -> DataFrame:
    """``Ticker, month`` of the months from ``start`` to ``end`` in which a ticker has no bar."""
    months = F.sequence(F.trunc(F.lit(start).cast("date"), "month"), F.trunc(F.lit(end).cast("date"), "month"), F.expr("interval 1 month"))
    wanted = df.select("Ticker").distinct().select("Ticker", F.explode(months).alias("month"))
    return wanted.join(df.select("Ticker", F.trunc("Date", "month").alias("month")).distinct(), ["Ticker", "month"], "left_anti")


def merge_sources(*sources: DataFrame) -> DataFrame:
    """One bar per ticker and date: that of the first source that has one. Columns that a source lacks are null."""
    ranked = [df.withColumn("source_rank", F.lit(k)) for k, df in enumerate(sources)]
    every = ranked[0]
    for df in ranked[1:]:
        every = every.unionByName(df, allowMissingColumns=True)
    first = Window.partitionBy("Ticker", "Date").orderBy("source_rank", *[F.col(c).asc_nulls_last() for c in every.columns if c not in ("Ticker", "Date", "source_rank")])
    return every.withColumn("nth", F.row_number().over(first)).filter("nth = 1").drop("nth", "source_rank")


def upsert_manifest(old: DataFrame, new: DataFrame, keys: tuple[str, ...] = ("symbol", "period", "interval")) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those with the same keys."""
    return old.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new)


def stale_symbols(manifest: DataFrame, as_of: str) -> DataFrame:
    """Manifest rows that are neither of ``as_of`` nor of the last market day before it (on a Monday the Friday)."""
    day = F.lit(as_of).cast("date")
    back = F.when(F.weekday(day) == 0, 3).when(F.weekday(day) == 6, 2).otherwise(1)
    return manifest.filter((F.to_date("last_updated") != day) & (F.to_date("last_updated") != F.date_sub(day, back)))


def last_n(df: DataFrame, n: int) -> DataFrame:
    """The last ``n`` bars of each ticker."""
    latest_first = Window.partitionBy("Ticker").orderBy(F.desc("Date"))
    return df.withColumn("nth", F.row_number().over(latest_first)).filter(F.col("nth") <= n).drop("nth")


def latest(df: DataFrame) -> DataFrame:
    """The last bar of each ticker, by an aggregate, without sorting bars."""
    rest = [c for c in df.columns if c != "Ticker"]
    return df.groupBy("Ticker").agg(F.max_by(F.struct(*rest), "Date").alias("last")).select("Ticker", *(F.col(f"last.{c}").alias(c) for c in rest))


def number_bars(df: DataFrame) -> DataFrame:
    """``rn``, from 1, and ``n_bars`` of each ticker."""
    return df.withColumns({"rn": F.row_number().over(by_date()), "n_bars": F.count("*").over(Window.partitionBy("Ticker"))})
