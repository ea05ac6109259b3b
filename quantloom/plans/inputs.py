"""Inputs that the queries derive from the given tables, in Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.operators.bars import bars_from_trades

ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").withColumn("price", F.col("l_extendedprice") / F.col("l_quantity"))


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars with the supplier as ticker."""
    return bars_from_trades(trades(spark, sf_dir), "l_suppkey", "l_shipdate", "price", "l_quantity", ORDER)


def index_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars of two indices: ALL, every supplier, and R0, the suppliers of region 0."""
    rows = trades(spark, sf_dir)
    near = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation").filter("n_regionkey = 0"), F.col("s_nationkey") == F.col("n_nationkey"))
    both = rows.withColumn("index", F.lit("ALL")).unionByName(rows.join(near.select(F.col("s_suppkey").alias("l_suppkey")), "l_suppkey", "left_semi").withColumn("index", F.lit("R0")))
    return bars_from_trades(both, "index", "l_shipdate", "price", "l_quantity", ORDER)


def sectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sector of a ticker: the supplier's nation."""
    joined = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return joined.select(F.col("s_suppkey").cast("string").alias("Ticker"), F.col("n_name").alias("Sector"))


def chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Option chains from ``part``: brand as underlying, retail price as strike, one of three expiries; see ``CHAIN``."""
    part = table(spark, sf_dir, "part")
    one = part.withColumn("expiry", F.element_at(F.array(*(F.lit(x).cast("date") for x in ("2024-01-25", "2024-02-29", "2024-03-28"))), (F.col("p_partkey") % 3 + 1).cast("int")))
    one = one.groupBy(F.col("p_brand").alias("underlying"), "expiry", F.col("p_retailprice").alias("strike")).agg(F.min_by(F.struct("p_partkey", "p_size"), "p_partkey").alias("p"))
    spot = part.groupBy(F.col("p_brand").alias("underlying")).agg(F.round(F.avg("p_retailprice"), 2).alias("spot"))
    traded = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("oi"), F.sum("l_quantity").alias("volume"))
    rows = one.select("underlying", "expiry", "strike", F.col("p.p_partkey"), F.col("p.p_size").cast("double").alias("size")).join(F.broadcast(spot), "underlying").join(traded, "p_partkey", "left")
    return rows.select(
        "underlying", "expiry", "strike", "spot", F.col("size").alias("CE_iv"), (51 - F.col("size")).alias("PE_iv"),
        (F.greatest(F.col("spot") - F.col("strike"), F.lit(0.0)) + F.col("size") / 10).alias("CE_price"),
        (F.greatest(F.col("strike") - F.col("spot"), F.lit(0.0)) + F.col("size") / 10).alias("PE_price"),
        F.coalesce("oi", F.lit(0)).cast("double").alias("oi"), F.coalesce("volume", F.lit(0.0)).alias("volume"),
    )


def news(spark: SparkSession, sf_dir: str) -> DataFrame:
    """News items from ``documents``, whole: ``stock, title, link, published``."""
    return news_items(table(spark, sf_dir, "documents"))


def news_items(docs: DataFrame) -> DataFrame:
    start = F.lit("2024-01-01 00:00:00").cast("timestamp")
    return docs.select(F.col("source").alias("stock"), F.col("text").alias("title"), F.col("doc_id").cast("string").alias("link"), F.timestamp_seconds(F.unix_timestamp(start) + F.col("doc_id") * 37 * 60).alias("published"))


_BAR = """SELECT {t} AS Ticker, CAST(l_shipdate AS DATE) AS Date,
    first(l_extendedprice / l_quantity ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS Open,
    max(l_extendedprice / l_quantity) AS High, min(l_extendedprice / l_quantity) AS Low,
    last(l_extendedprice / l_quantity ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS Close,
    sum(l_quantity) AS Volume FROM lineitem {w} GROUP BY ALL"""
BARS = "bars AS (" + _BAR.format(t="CAST(l_suppkey AS VARCHAR)", w="") + ")"
INDEX = "idx AS (" + _BAR.format(t="'ALL'", w="") + " UNION ALL " + _BAR.format(t="'R0'", w="WHERE l_suppkey IN (SELECT s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = 0)") + ")"
SECTORS = "sectors AS (SELECT CAST(s_suppkey AS VARCHAR) AS Ticker, n_name AS Sector FROM supplier JOIN nation ON s_nationkey = n_nationkey)"
CHAIN = """chain AS (
    SELECT o.underlying, expiry, strike, spot, size AS CE_iv, 51 - size AS PE_iv, greatest(spot - strike, 0.0) + size / 10 AS CE_price, greatest(strike - spot, 0.0) + size / 10 AS PE_price,
           coalesce(oi, 0)::DOUBLE AS oi, coalesce(volume, 0.0) AS volume
    FROM (SELECT p_brand AS underlying, CAST(['2024-01-25', '2024-02-29', '2024-03-28'][(p_partkey % 3 + 1)::INT] AS DATE) AS expiry, p_retailprice AS strike,
                 min(p_partkey) AS p_partkey, arg_min(p_size, p_partkey)::DOUBLE AS size FROM part GROUP BY ALL) o
    JOIN (SELECT p_brand AS underlying, round(avg(p_retailprice), 2) AS spot FROM part GROUP BY ALL) USING (underlying)
    LEFT JOIN (SELECT l_partkey AS p_partkey, count(*) AS oi, sum(l_quantity) AS volume FROM lineitem GROUP BY ALL) USING (p_partkey))"""
NEWS = "news AS (SELECT source AS stock, text AS title, CAST(doc_id AS VARCHAR) AS link, TIMESTAMP '2024-01-01 00:00:00' + doc_id * 37 * INTERVAL 1 MINUTE AS published FROM documents)"
P = "PARTITION BY Ticker ORDER BY Date"


def frame(n: int, of: str = P) -> str:
    return f"({of} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def full(agg: str, x: str, n: int, least: int | None = None) -> str:
    """SQL of an aggregate over the last ``n`` bars that is null until ``least`` values are there."""
    return f"CASE WHEN count({x}) OVER {frame(n)} >= {n if least is None else least} THEN {agg}({x}) OVER {frame(n)} END"


def ewm(x: str, alpha: float) -> str:
    """SQL of a recursive exponential average of a column without nulls, in closed form, over rows numbered ``rn`` from 1."""
    r = 1 - alpha
    c = f"CASE WHEN rn = 1 THEN {x} ELSE {alpha!r} * {x} END"
    return f"CASE WHEN rn = 1 THEN {x} ELSE pow({r!r}, rn) * sum(({c}) * pow({r!r}, -rn)) OVER ({P} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) END"
