"""Sorted runs, text dumps and ingestion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from basalt.operators import resolve


def write_run(log: DataFrame, path: str, key: str = "k", seq: str = "seq", files: int | None = None, codec: str = "zstd", bloom: bool = False) -> None:
    """A sorted run: files of disjoint key ranges, sorted by key and newest first, so that scans prune by Parquet statistics."""
    n = files or int(log.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = log.repartitionByRange(n, key).sortWithinPartitions(F.col(key), F.col(seq).desc()).write.option("compression", codec)
    if bloom:
        out = out.option(f"parquet.bloom.filter.enabled#{key}", "true")
    out.parquet(path)


def read_run(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def out_of_order(run: DataFrame, key: str = "k", pos: str = "pos", part: str | None = None, parts: int = 64) -> DataFrame:
    """Rows whose key isn't above the one before in the run: a writer of sorted files must refuse them.

    Without ``part`` the run is cut into ranges of the position, and a range's first row follows the last key of the ranges before, of which there is one for each range.
    """
    if part:
        return run.withColumn("before", F.lag(key).over(Window.partitionBy(part).orderBy(pos))).filter(F.col("before") >= F.col(key)).drop("before")
    ranged = run.withColumn("_part", resolve.range_part(F.col(pos), resolve.cuts(run, pos, parts)))
    tops = ranged.groupBy("_part").agg(F.max_by(F.struct(F.col(key).alias("key")), F.struct(pos)).alias("_top"))
    carried = tops.select("_part", F.lag("_top.key").over(Window.orderBy("_part")).alias("_carried"))
    by = Window.partitionBy("_part").orderBy(pos)
    near = ranged.withColumn("_turn", F.row_number().over(by)).withColumn("_before", F.lag(key).over(by)).join(F.broadcast(carried), "_part")
    return near.filter(F.when(F.col("_turn") == 1, F.col("_carried")).otherwise(F.col("_before")) >= F.col(key)).select(*[F.col(f"`{c}`") for c in run.columns])


def ingest(log: DataFrame, files: DataFrame, seq: str = "seq", behind: bool = False, at: int | None = None) -> DataFrame:
    """The log with external rows, all of one new sequence number: above every other, or 0, below all, with ``behind``, or ``at``, if the files were given a number before."""
    if at is not None:
        return log.unionByName(files.withColumn(seq, F.lit(at).cast(log.schema[seq].dataType)))
    at = F.lit(0) if behind else F.broadcast(log.agg(F.max(seq).alias("_last")))
    if behind:
        return log.unionByName(files.withColumn(seq, at.cast(log.schema[seq].dataType)))
    stamped = files.drop(seq).crossJoin(at).withColumn(seq, (F.coalesce("_last", F.lit(0)) + 1).cast(log.schema[seq].dataType)).drop("_last")
    return log.unionByName(stamped)


def dump_text(live: DataFrame, path: str, key: str = "k", value: str = "v") -> None:
    """``key ==> value`` lines."""
    live.select(F.concat(F.col(key).cast("string"), F.lit(" ==> "), F.col(value).cast("string")).alias("value")).write.text(path)


def load_text(spark: SparkSession, path: str) -> DataFrame:
    """k and v from ``key ==> value`` lines; a value may hold the mark, a key can't."""
    at = F.instr("value", F.lit(" ==> "))
    return spark.read.text(path).filter(at > 0).select(F.substring("value", F.lit(1), at - 1).alias("k"), F.substring("value", at + 5, F.length("value")).alias("v"))


def split_blobs(log: DataFrame, least: int, key: str = "k", value: str = "v") -> tuple[DataFrame, DataFrame]:
    """(log with large values as references, blobs): values of ``least`` bytes or more move to a table of their own, by content."""
    large = F.octet_length(value) >= least
    ref = F.sha2(F.col(value), 256)
    small = log.withColumn("blob", F.when(large, ref)).withColumn(value, F.when(~large, F.col(value)))
    return small, log.filter(large).select(ref.alias("blob"), F.col(value).alias("blob_value")).dropDuplicates(["blob"])


def join_blobs(log: DataFrame, blobs: DataFrame, value: str = "v") -> DataFrame:
    """The log with its values back. Rows without a reference are dealt by what they hold: as one null they would all go to one task."""
    deal = F.concat(F.lit("no blob "), F.xxhash64(*[c for c, kind in log.dtypes if "map" not in kind]).cast("string"))
    own, there = log.withColumn("_key", F.coalesce("blob", deal)).drop("blob"), blobs.withColumnRenamed("blob", "_key")
    return own.join(there, "_key", "left").withColumn(value, F.coalesce(value, "blob_value")).drop("_key", "blob_value")


def export_family(log: DataFrame, family: str, path: str) -> None:
    """One column family as a sorted run of its own."""
    write_run(log.filter(F.col("cf") == family), path)


def import_family(spark: SparkSession, path: str, name: str) -> DataFrame:
    """An exported run as a column family of that name."""
    return read_run(spark, path).withColumn("cf", F.lit(name))
