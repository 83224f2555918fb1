"""Histograms with buckets that grow by half, kept to two leading digits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def limits(top: int = 1 << 64) -> list[int]:
    """Upper bounds (inclusive) of the buckets."""
    out, x = [1, 2], 2.0
    while True:
        x *= 1.5
        if x >= top:
            return out
        value, scale = int(x), 1
        while value // 10 > 10:
            value //= 10
            scale *= 10
        out.append(value * scale)
        x = float(out[-1])


LIMITS = [x for x in limits() if x < 1 << 62]


def bucket(x: Column) -> Column:
    """The number of the first bucket whose bound is at least x."""
    return F.size(F.filter(F.array(*[F.lit(b) for b in LIMITS]), lambda b: b < x))


def histogram(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """Counts by bucket: bucket, upper, n, lo, hi, total; histograms add up, so partial ones merge by summing n."""
    bounds = F.array(*[F.lit(b) for b in LIMITS])
    out = df.withColumn("bucket", bucket(F.col(value))).groupBy(*(by or []), "bucket").agg(F.count("*").alias("n"), F.min(value).alias("lo"), F.max(value).alias("hi"), F.sum(value).alias("total"))
    return out.withColumn("upper", F.get(bounds, F.col("bucket")))


def percentiles(hist: DataFrame, ps: list[float], by: list[str] | None = None) -> DataFrame:
    """(p, value): linear within the bucket that holds the rank, clamped to the least and greatest value."""
    by = by or []
    whole = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    order = whole.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    bounds = F.array(*[F.lit(b) for b in LIMITS])
    run = hist.withColumn("cum", F.sum("n").over(order)).withColumn("all", F.sum("n").over(whole)).withColumn("lo", F.min("lo").over(whole)).withColumn("hi", F.max("hi").over(whole))
    asked = run.withColumn("p", F.explode(F.array(*[F.lit(float(p)) for p in ps]))).withColumn("rank", F.col("all") * F.col("p") / 100)
    at = asked.filter((F.col("cum") >= F.col("rank")) & (F.col("cum") - F.col("n") < F.col("rank")))
    left = F.when(F.col("bucket") == 0, F.lit(0)).otherwise(F.get(bounds, F.col("bucket") - 1))
    value = left + (F.col("upper") - left) * ((F.col("rank") - (F.col("cum") - F.col("n"))) / F.col("n"))
    return at.select(*by, "p", F.greatest(F.least(value, F.col("hi")), F.col("lo")).alias("value"))


def moments(value: str, name: str = "") -> list[Column]:
    """n, sum, sum of squares, least, greatest; with these a counter's mean and deviation merge."""
    return [F.count(value).alias(f"{name}n"), F.sum(value).alias(f"{name}sum"), F.sum(F.col(value) * F.col(value)).alias(f"{name}sum_sq"), F.min(value).alias(f"{name}min"), F.max(value).alias(f"{name}max")]


def deviation(n: Column, total: Column, squares: Column) -> Column:
    """The population's standard deviation from sums."""
    return F.sqrt(F.greatest(F.lit(0.0), squares / n - (total / n) * (total / n)))
