"""A lasting store of bars: upserts replace whole partitions by new versions, and a commit makes a version count.

``<folder>/version=<n>/year=<y>`` holds the bars of a year as of upsert ``n``; ``<folder>/commits/<n>`` names the years that upsert ``n`` replaced. A commit is written after its
bars, and counts once Spark has marked it complete. So a reader sees all of an upsert or nothing, an upsert that failed leaves files that nobody reads, and
running it again is safe. Only years that new bars fall into are read and written. One writer at a time is assumed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

KEY = ("Ticker", "Date")


def _complete(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the commits that are complete."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{folder}/commits/*/_SUCCESS")
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(int(x.getPath().getParent().getName()) for x in found or [])


def _newest(spark: SparkSession, folder: str) -> dict[int, int]:
    """The version that counts for each year: a row per year and upsert on the way to the driver."""
    done = _complete(spark, folder)
    if not done:
        return {}
    commits = spark.read.schema("year int, version int").parquet(*(f"{folder}/commits/{n}" for n in done))
    return {r["year"]: r["version"] for r in commits.groupBy("year").agg(F.max("version").alias("version")).collect()}


def read_store(spark: SparkSession, folder: str, schema: str, years: list[int] | None = None) -> DataFrame:
    """The bars that count, of some years or all; an empty table before the first upsert."""
    newest = _newest(spark, folder)
    paths = [f"{folder}/version={n}/year={y}" for y, n in newest.items() if years is None or y in years]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def upsert(spark: SparkSession, folder: str, bars: DataFrame) -> int:
    """Put ``bars`` into the store; of two bars of one ticker and date the new one stays. Returns the commit's number."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in bars.schema.fields)
    marked = bars.withColumn("__ql_year", F.year("Date"))
    years = sorted(r["__ql_year"] for r in marked.select("__ql_year").distinct().collect() if r["__ql_year"] is not None)
    done = _complete(spark, folder)
    n = done[-1] + 1 if done else 0
    old = read_store(spark, folder, schema, years).withColumn("__ql_new", F.lit(0))
    both = bars.filter("Date IS NOT NULL").withColumn("__ql_new", F.lit(1)).unionByName(old)
    best = Window.partitionBy(*KEY).orderBy(F.desc("__ql_new"))
    kept = both.withColumn("__ql_nth", F.row_number().over(best)).filter("__ql_nth = 1").drop("__ql_nth", "__ql_new").withColumn("year", F.year("Date"))
    # what a failed upsert of this number has left goes: years are overwritten one by one, and those it didn't get to are named nowhere
    writer = kept.hint("rebalance", "year").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("year")
    writer.parquet(f"{folder}/version={n}")
    spark.createDataFrame([(y, n) for y in years], "year int, version int").coalesce(1).write.mode("overwrite").parquet(f"{folder}/commits/{n}")
    return n
