"""Readers of the panel: long cells, events and entities from the supplied tables.

An entity is a customer with a position, a sampling event an order, an analyte a
return flag with a line status. A cell is measured where an order has lines of
that analyte; its value is the summed quantity, and it counts as detected where
a discount of at least DETECTED was given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from paneflow.functions.expressions import bucket_hash, null_if_nan

DETECTED = 0.05


def scan(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """A Parquet table with NaN as null; only ``columns`` are read if any are named."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    df = df.select(*columns) if columns else df
    return df.select(*(null_if_nan(F.col(f.name)).alias(f.name) if isinstance(f.dataType, (DoubleType, FloatType)) else F.col(f.name) for f in df.schema))


def scan_fallback(spark: SparkSession, sf_dir: str, *names: str) -> DataFrame:
    """The first of the named tables that can be read."""
    for name in names[:-1]:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            return scan(spark, sf_dir, name)
    return scan(spark, sf_dir, names[-1])


def clean(df: DataFrame, drop: tuple[str, ...], date_col: str) -> DataFrame:
    """Drop what is there of ``drop``; dates that cannot be read become null."""
    return df.drop(*drop).withColumn(date_col, F.try_to_timestamp(F.col(date_col).cast("string")))


def entity_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """All rows of ``n`` entities chosen by a seeded hash."""
    keys = df.select(key).distinct().orderBy(bucket_hash(F.col(key), seed), key).limit(n)
    return df.join(F.broadcast(keys), key, "left_semi")


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entity, event, ts, analyte, value, detected: one row per measured cell."""
    lines = scan(spark, sf_dir, "lineitem", "l_orderkey", "l_returnflag", "l_linestatus", "l_quantity", "l_discount")
    orders = scan(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderdate")
    summed = lines.groupBy(F.col("l_orderkey").alias("event"), F.concat("l_returnflag", "l_linestatus").alias("analyte")).agg(F.sum("l_quantity").alias("value"), (F.max("l_discount") >= DETECTED).alias("detected"))
    return summed.join(orders.select(F.col("o_orderkey").alias("event"), F.col("o_custkey").alias("entity"), F.col("o_orderdate").alias("ts")), "event").select("entity", "event", "ts", "analyte", "value", "detected")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entity, event, ts, status, price, priority of every order, measured or not."""
    orders = scan(spark, sf_dir, "orders")
    return orders.select(F.col("o_custkey").alias("entity"), F.col("o_orderkey").alias("event"), F.col("o_orderdate").alias("ts"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"), F.col("o_orderpriority").alias("priority"))


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entity, lat, lon, segment, nation, region, score: a position and a score in [0, 1] for every customer."""
    customer = scan(spark, sf_dir, "customer", "c_custkey", "c_nationkey", "c_mktsegment", "c_acctbal")
    nation = scan(spark, sf_dir, "nation", "n_nationkey", "n_regionkey")
    low, high = customer.agg(F.min("c_acctbal")).scalar(), customer.agg(F.max("c_acctbal")).scalar()
    key = F.col("c_custkey")
    lat = F.lit(32.5) + F.pmod(key * 7919, F.lit(9500)).cast("double") / 1000
    lon = F.lit(-124.0) + F.pmod(key * 104729, F.lit(10000)).cast("double") / 1000
    score = F.round((F.col("c_acctbal") - low) / (high - low), 6)
    rows = customer.join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.select(key.alias("entity"), lat.alias("lat"), lon.alias("lon"), F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation"), F.col("n_regionkey").alias("region"), score.alias("score"))
