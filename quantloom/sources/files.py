"""Readers and writers. Any path that Spark opens will do."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quantloom.operators.bars import BAR_SCHEMA


def read_bars(spark: SparkSession, path: str, schema: StructType = BAR_SCHEMA, date_format: str | None = None) -> DataFrame:
    """A folder of CSV files with headers as one table, with the given schema: nothing is inferred."""
    reader = spark.read.schema(schema).option("header", True)
    return (reader.option("timestampFormat", date_format) if date_format else reader).csv(path)


def read_chain(spark: SparkSession, path: str) -> DataFrame:
    """Nested option-chain JSON; see ``options.flatten_chain``."""
    return spark.read.option("multiLine", True).json(path)


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None, format: str = "parquet", mode: str = "errorifexists") -> None:
    writer = df.write.mode(mode).partitionBy(*(partition_by or []))
    if partition_by and mode == "errorifexists":  # tasks move their own files into a new table's many folders, not the driver one by one
        writer = writer.option("mapreduce.fileoutputcommitter.algorithm.version", "2")
    writer.option("header", True).csv(path) if format == "csv" else writer.format(format).save(path)


def settled(df: DataFrame, what: str, rows: int = 100_000) -> DataFrame:
    """``df`` written once below the shared folder and read again, for learners that go over their rows many times. Files hold ``rows`` rows
    at most, so that all cores read them however few tasks wrote them."""
    path = shared_folder(df.sparkSession, what)
    df.write.option("maxRecordsPerFile", rows).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def as_json(df: DataFrame, column: str = "json") -> DataFrame:
    """Each row as one JSON object."""
    return df.select(F.to_json(F.struct(*df.columns)).alias(column))


def shared_folder(spark: SparkSession, what: str) -> str:
    """A new folder below the one that the cluster shares (``spark.checkpoint.dir``), or a local one where that is unset and Spark
    runs on one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="spark-")
    return f"{named}/{what}/{uuid.uuid4().hex}"
