"""Rules over statistics series: ts (seconds), entity, stat, value."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bursts(series: DataFrame, lag: int, threshold: float, duration: float = 1.0, percent: bool = False) -> DataFrame:
    """Epochs at which a value grew, over ``lag`` epochs, by at least ``threshold`` in ``duration`` seconds (or by so many percent of the value then)."""
    by = Window.partitionBy("entity", "stat").orderBy("ts")
    old, then = F.lag("value", lag).over(by), F.lag("ts", lag).over(by)
    rate = (F.col("value") - old) * duration / (F.col("ts") - then)
    return series.withColumn("rate", rate * 100 / old if percent else rate).filter(F.col("rate") >= threshold)


def summary(series: DataFrame) -> DataFrame:
    return series.groupBy("entity", "stat").agg(F.avg("value").alias("mean"), F.max("value").alias("max"), F.min("value").alias("min"), F.max_by("value", "ts").alias("latest"), F.min_by("value", "ts").alias("oldest"))


def condition(series: DataFrame, stats: Sequence[str], test: Column, each_epoch: bool = False) -> DataFrame:
    """Entities (and epochs) for which a test of the statistics, one column each, holds; an entity without one of them is left out."""
    keys = ["entity", "ts"] if each_epoch else ["entity"]
    wide = series.groupBy(*keys).pivot("stat", list(stats)).agg(F.avg("value"))
    return wide.filter(F.array_min(F.array(*[F.col(f"`{s}`").isNotNull() for s in stats]))).filter(test)


def overlap(one: DataFrame, two: DataFrame, within: int) -> DataFrame:
    """Per entity the first pair of epochs of two conditions at most ``within`` seconds apart; epochs meet in buckets of that width or the next ones."""
    a = one.select("entity", F.col("ts").alias("t1"), F.explode(F.array(*[F.floor(F.col("ts") / within) + d for d in (-1, 0, 1)])).alias("b"))
    b = two.select("entity", F.col("ts").alias("t2"), F.floor(F.col("ts") / within).alias("b"))
    near = a.join(b, ["entity", "b"]).filter(F.abs(F.col("t1") - F.col("t2")) <= within)
    return near.groupBy("entity").agg(F.min(F.struct("t1", "t2")).alias("p")).select("entity", "p.t1", "p.t2")


def rule(triggered: Sequence[DataFrame]) -> DataFrame:
    """Entities for which every condition holds."""
    out = triggered[0].select("entity").distinct()
    for other in triggered[1:]:
        out = out.intersect(other.select("entity"))
    return out


def deltas(series: DataFrame) -> DataFrame:
    """Growth of cumulative statistics from epoch to epoch; the first epoch has none, and a negative one is marked."""
    by = Window.partitionBy("entity", "stat").orderBy("ts")
    return series.withColumn("delta", F.col("value") - F.lag("value").over(by)).filter("delta is not null").withColumn("wrong", F.col("delta") < 0)


def parse_log(lines: DataFrame) -> DataFrame:
    """Statistics of ``<seconds> <entity> NAME COUNT : value`` lines; others are left out."""
    pattern = r"^(\d+) (\S+) (\S+) COUNT : (-?\d+(?:\.\d+)?)$"
    part = lambda i: F.regexp_extract("value", pattern, i)
    return lines.filter(F.col("value").rlike(pattern)).select(part(1).cast("long").alias("ts"), part(2).alias("entity"), part(3).alias("stat"), part(4).cast("double").alias("v")).withColumnRenamed("v", "value")
