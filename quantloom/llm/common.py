"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes after which an Arrow batch of whole texts is closed.
BATCH_BYTES = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder, by any path that Spark's readers can open."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(name: str = "text") -> Column:
    """A text column with null read as the empty text."""
    return F.coalesce(F.col(name), F.lit(""))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it in ``spark.checkpoint.dir``.

    A folder of our own is used only where that setting is unset and Spark runs on one machine, as in tests; on a cluster
    this is an error, for a folder of the driver's machine is not the executors'.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        named = spark.sparkContext.getCheckpointDir()
    return named


def cut(df: DataFrame) -> DataFrame:
    """Compute ``df`` once and cut its lineage by a checkpoint in the shared folder."""
    spark = df.sparkSession
    folder = shared_folder(spark)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def saved(df: DataFrame, codec: str | None = None) -> DataFrame:
    """Compute ``df`` once into a table of the shared folder and go on from that table.

    Lineage ends there, executors can be lost, and the work's shuffle files go as soon as the table is written.
    """
    spark, path, clean = df.sparkSession, f"{shared_folder(df.sparkSession)}/tables/{uuid.uuid4().hex}", "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(clean, "false")
    spark.conf.set(clean, "true")
    try:
        df.write.options(**({"compression": codec} if codec else {})).parquet(path)
    finally:
        spark.conf.set(clean, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._ql_folders = [path]
    return out


def packed(df: DataFrame) -> DataFrame:
    """``saved`` for tables of many texts: closer compression, for they are the largest."""
    return saved(df, "zstd")


def released(*tables: DataFrame) -> None:
    """Free the disk of tables that ``saved`` wrote; nothing that is still to be computed may read them."""
    for df in tables:
        for path in getattr(df, "_ql_folders", []):
            where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


#: Slots of a filter of keys; the size of what is broadcast does not grow with the corpus.
SLOTS = 1 << 20


def possible(df: DataFrame, keys: list[str], known: DataFrame, names: list[str], mark: str | None = None) -> DataFrame:
    """The rows of ``df`` whose ``keys`` can be among the values of ``names`` in ``known``; with ``mark``, all rows and a column of
    that name that is null for the others.

    Only the slots that the known values fall into are broadcast, ``SLOTS`` numbers at most. Some rows too many stay; what
    comes after joins exactly.
    """
    slot = lambda own: F.expr(f"cast(pmod(xxhash64({', '.join(own)}), {SLOTS}) as int)")
    name = mark or "__ql_slot"
    slots = F.broadcast(known.select(slot(names).alias(name)).distinct())
    found = df.withColumn("__ql_own", slot(keys)).join(slots, F.col("__ql_own") == F.col(name), "left" if mark else "left_semi")
    return found.drop("__ql_own")


def batches_of(df: DataFrame) -> DataFrame:
    """Have Python see ``df`` in Arrow batches that are bounded in rows and in bytes, however long the texts."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2048")
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df
