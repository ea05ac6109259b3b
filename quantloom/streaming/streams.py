"""Structured Streaming: daily news sentiment over a growing folder, and bars from ticks. Late rows beyond the watermark are dropped."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_bars(ticks: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """OHLCV bars per ``Ticker`` and tumbling window of ``ts`` from ``ticks (Ticker, ts, price, order, size)``; works on batches too."""
    if ticks.isStreaming:
        ticks = ticks.withWatermark("ts", late)
    key = F.struct("ts", "order")
    return ticks.groupBy("Ticker", F.window("ts", window).alias("w")).agg(
        F.min_by("price", key).alias("Open"), F.max("price").alias("High"), F.min("price").alias("Low"), F.max_by("price", key).alias("Close"), F.sum("size").alias("Volume")
    ).select("Ticker", F.col("w.start").alias("Date"), "Open", "High", "Low", "Close", "Volume")


def stream_news_daily(items: DataFrame, late: str = "1 day") -> DataFrame:
    """Mean and weighted mean score per ``stock`` and daily window from 09:15 IST, of items with ``score`` and ``weight``."""
    if items.isStreaming:
        items = items.withWatermark("published", late)
    day = F.window("published", "1 day", startTime="3 hours 45 minutes").alias("w")
    out = items.groupBy("stock", day).agg(F.avg("score").alias("mean_score"), F.avg(F.col("score") * F.col("weight")).alias("mean_weighted"), F.count("*").alias("items"))
    return out.select("stock", F.to_date(F.from_utc_timestamp("w.start", "Asia/Kolkata")).alias("day"), "mean_score", "mean_weighted", "items")


def run_available(streamed: DataFrame, out: str, checkpoint: str, mode: str = "complete") -> DataFrame:
    """Process what is there now into a table in the folder ``out`` and read it from there; nothing goes through the driver.

    With "append" only windows that the watermark has closed are written, by Spark's file sink. With "complete" each micro-batch
    writes all windows so far to a folder of its own, and the last one is read; a batch that is run again overwrites its own.
    """
    spark, done = streamed.sparkSession, []
    writer = streamed.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if mode == "append":
        writer.format("parquet").start(out).awaitTermination()
        return spark.read.schema(streamed.schema).parquet(out)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")
        done.append(number)

    writer.foreachBatch(write).start().awaitTermination()
    return spark.read.schema(streamed.schema).parquet(f"{out}/batch={max(done)}") if done else spark.createDataFrame([], streamed.schema)
