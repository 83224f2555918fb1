"""Change logs derived from tables.

A log is a table of k (key), seq (unique, ascending with time), op and v (value). Ops have the
numbers of OPS; any other columns travel along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

OPS = {"delete": 0, "put": 1, "merge": 2, "note": 3, "single_delete": 7, "range_delete": 15}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(ts: str) -> Column:
    """Microseconds since 1970 of a timestamp without time zone, whatever the session's zone."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {ts})")


def cents(x: str) -> Column:
    return F.round(F.col(x) * 100).cast("long")


def user_key(x: str) -> Column:
    return F.concat(F.lit("u"), F.lpad(F.col(x).cast("string"), 6, "0"))


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' events: signup and purchase put, click merges, error deletes; views only read. Also ts_us and bytes (of props)."""
    op = F.when(F.col("event_type") == "error", 0).when(F.col("event_type") == "click", 2).otherwise(1)
    events = table(spark, sf_dir, "events").filter("event_type <> 'view'")
    return events.select(user_key("user_id").alias("k"), F.col("event_id").alias("seq"), op.alias("op"), cents("value").alias("v"), micros("ts").alias("ts_us"), F.octet_length("props").cast("long").alias("bytes"))


def order_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' orders: O puts, F deletes, P merges."""
    op = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "P", 2).otherwise(1)
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("seq"), op.alias("op"), cents("o_totalprice").alias("v"))


def trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a query trace: ts_us, type, k, value_size; seq breaks ties of time."""
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), micros("ts").alias("ts_us"), F.col("event_type").alias("type"), user_key("user_id").alias("k"), F.octet_length("props").cast("long").alias("value_size"))


def block_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as block accesses: a user is a block of 4096 + 16 * (id mod 64) bytes, its level the id mod 4, the event type the caller; a value under 100 counts as a hit."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("seq"), micros("ts").alias("ts_us"), F.col("user_id").alias("block"), (F.lit(4096) + 16 * (F.col("user_id") % 64)).alias("bytes"),
        (F.col("user_id") % 4).cast("int").alias("level"), F.col("event_type").alias("caller"), (F.col("value") < 100).alias("hit"),
    )
