"""Reads: the state of keys at a sequence number, ordered scans, seeks and range deletes."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

DELETES = (0, 7)


def versions(log: DataFrame, snapshot: int | None = None, seq: str = "seq") -> DataFrame:
    """What a reader at ``snapshot`` sees of the log; annotations aren't data."""
    seen = log.filter(F.col("op") != 3) if "op" in log.columns else log
    return seen if snapshot is None else seen.filter(F.col(seq) <= snapshot)


def latest(log: DataFrame, keys: Sequence[str] = ("k",), order: Sequence[str] = ("seq",), snapshot: int | None = None) -> DataFrame:
    """The newest version of each key, deletions included. In this form the planner limits each group before the shuffle."""
    newest = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    seen = versions(log, snapshot, order[0]) if order == ("seq",) else log
    return seen.withColumn("_rn", F.row_number().over(newest)).filter("_rn = 1").drop("_rn")


def resolve(log: DataFrame, keys: Sequence[str] = ("k",), snapshot: int | None = None, tombstones: DataFrame | None = None) -> DataFrame:
    """Live rows: the newest version of each key unless it is a deletion or hidden by a newer range tombstone."""
    live = latest(log, keys, ("seq",), snapshot).filter(~F.col("op").isin(*DELETES))
    if tombstones is None:
        return live
    seen = tombstones if snapshot is None else tombstones.filter(F.col("seq") <= snapshot)
    return mask_ranges(live, seen, keys[0])


def folded(log: DataFrame, operator: object, keys: Sequence[str] = ("k",), snapshot: int | None = None) -> DataFrame:
    """Live rows as a reader of a log with merge operands sees them: keys, seq (of the newest row), v folded from the last base on."""
    from basalt.operators import merge

    seen = versions(log, snapshot)
    values = merge.merged(seen, operator, keys).drop("n")
    newest = seen.groupBy(*keys).agg(F.max("seq").alias("seq"))
    return values.join(newest, list(keys)).select(*keys, "seq", "v")


def families(log: DataFrame, names: Sequence[str], keys: Sequence[str] = ("k",), snapshot: int | None = None) -> DataFrame:
    """Ordered live rows of several column families (column cf), all at one snapshot."""
    own = log.filter(F.col("cf").isin(*names))
    return resolve(own, ("cf", *keys), snapshot).orderBy("cf", *keys)


def multi_get(log: DataFrame, wanted: DataFrame, keys: Sequence[str] = ("k",), snapshot: int | None = None) -> DataFrame:
    """A row for each wanted key, with found; keys are looked up before the newest version is picked."""
    own = log.join(wanted.select(*keys).distinct(), list(keys), "left_semi")
    live = resolve(own, keys, snapshot).withColumn("found", F.lit(True))
    return wanted.join(live, list(keys), "left").withColumn("found", F.coalesce("found", F.lit(False)))


def scan(live: DataFrame, key: str = "k", lower: object = None, upper: object = None, prefix: str | None = None, reverse: bool = False, limit: int | None = None) -> DataFrame:
    """An ordered scan: lower inclusive, upper exclusive. A seek is a scan with a bound and a limit."""
    if lower is not None:
        live = live.filter(F.col(key) >= F.lit(lower))
    if upper is not None:
        live = live.filter(F.col(key) < F.lit(upper))
    if prefix is not None:
        live = live.filter(F.col(key).startswith(prefix))
    live = live.orderBy(F.col(key).desc() if reverse else F.col(key))
    return live if limit is None else live.limit(limit)


def cuts(df: DataFrame, key: str, parts: int) -> list:
    """Up to ``parts - 1`` bounds of about equal ranges of a key, from one pass; they come to the driver."""
    if parts < 2:
        return []
    if dict(df.dtypes)[key] in ("int", "bigint", "double", "float", "timestamp", "date"):
        found = df.agg(F.percentile_approx(key, [i / parts for i in range(1, parts)], 100 * parts)).first()[0]
        return sorted(set(found or []))
    some = sorted(r[0] for r in df.select(key).filter(F.col(key).isNotNull()).filter(F.pmod(F.xxhash64(key), F.lit(64)) == 0).distinct().limit(64 * parts).collect())
    return sorted({some[len(some) * i // parts] for i in range(1, parts)}) if some else []


def range_part(key: Column, bounds: list) -> Column:
    """The number of the range that a key lies in."""
    return F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b <= key)) if bounds else F.lit(0)


def parts_of(spark: SparkSession, parts: int | None) -> int:
    """Ranges to cut a key into: as many as the session's shuffles have, if no number is given."""
    return parts or int(spark.conf.get("spark.sql.shuffle.partitions"))


def as_of(probes: DataFrame, table: DataFrame, probe: str, key: str, parts: int | None = None) -> DataFrame:
    """Each probe with the columns of the row of ``table`` (keys unique) at its key or next below it.

    Both sides go to ranges of the key; within a range the last row carries on over a window, and a range that
    begins with probes takes the greatest row of the ranges before, of which there is one for each range.
    """
    bounds = cuts(table, key, parts_of(table.sparkSession, parts))
    kind = table.schema[key].dataType
    row = F.struct(*[F.col(c) for c in table.columns])
    rows = table.select(F.col(key).alias("_at"), F.lit(0).alias("_side"), row.alias("_row"), F.lit(None).cast(probes.select(F.struct("*").alias("s")).schema["s"].dataType).alias("_probe"))
    asks = probes.select(F.col(probe).cast(kind).alias("_at"), F.lit(1).alias("_side"), F.lit(None).cast(table.select(row.alias("s")).schema["s"].dataType).alias("_row"), F.struct("*").alias("_probe"))
    both = rows.unionByName(asks).withColumn("_part", range_part(F.col("_at"), bounds))
    order = Window.partitionBy("_part").orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0)
    carried = both.withColumn("_hit", F.last("_row", ignorenulls=True).over(order)).filter("_side = 1")
    tops = rows.withColumn("_part", range_part(F.col("_at"), bounds)).groupBy("_part").agg(F.max_by("_row", "_at").alias("_top"))
    every = tops.sparkSession.range(len(bounds) + 1).select(F.col("id").cast("int").alias("_part")).join(tops, "_part", "left")
    before = every.select("_part", F.last("_top", ignorenulls=True).over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))
    return carried.join(before, "_part").withColumn("_hit", F.coalesce("_hit", "_before")).select("_probe.*", *[F.col(f"_hit.{c}").alias(f"at_{c}") for c in table.columns])


def fragments(tombstones: DataFrame, parts: int | None = None) -> DataFrame:
    """Disjoint pieces (cf, begin_k, end_k, seq) of range tombstones, each with the greatest sequence number that covers it.

    Tombstones go to the ranges of the key that they meet, cut at the ranges' bounds, which are begins of tombstones; a sweep goes over each
    column family's tombstones of one range. Empty ranges (end at or before begin) cover nothing.
    """
    kind = dict(tombstones.dtypes)["begin_k"]
    some = tombstones.filter(F.col("begin_k") < F.col("end_k")).select("cf", "begin_k", "end_k", "seq")
    bounds = cuts(some, "begin_k", parts_of(tombstones.sparkSession, parts))
    if bounds:
        edges = F.array(*[F.lit(b).cast(kind) for b in bounds])
        ends = F.size(F.filter(edges, lambda b: b < F.col("end_k")))
        dealt = some.withColumn("_part", F.explode(F.sequence(range_part(F.col("begin_k"), bounds), ends)))
        low, high = F.try_element_at(edges, F.nullif(F.col("_part"), F.lit(0))), F.try_element_at(edges, F.col("_part") + 1)
        some = dealt.select("cf", F.greatest("begin_k", low).alias("begin_k"), F.least("end_k", high).alias("end_k"), "seq", "_part")
    else:
        some = some.withColumn("_part", F.lit(0))

    def sweep(held: pd.DataFrame) -> pd.DataFrame:
        import heapq

        held = held[held["begin_k"] < held["end_k"]].sort_values("begin_k")
        points = sorted({*held["begin_k"], *held["end_k"]})
        rows, heap, at = [], [], 0
        begins, ends, seqs = held["begin_k"].tolist(), held["end_k"].tolist(), held["seq"].tolist()
        for here, after in zip(points, points[1:]):
            while at < len(begins) and begins[at] <= here:
                heapq.heappush(heap, (-seqs[at], ends[at]))
                at += 1
            while heap and heap[0][1] <= here:
                heapq.heappop(heap)
            if heap:
                rows.append((here, after, -heap[0][0]))
        out = pd.DataFrame(rows, columns=["begin_k", "end_k", "seq"])
        out.insert(0, "cf", held["cf"].iloc[0] if len(held) else None)
        return out

    return some.groupBy("cf", "_part").applyInPandas(sweep, f"cf string, begin_k {kind}, end_k {kind}, seq bigint")


def mask_ranges(live: DataFrame, tombstones: DataFrame, key: str = "k", parts: int | None = None) -> DataFrame:
    """Rows not hidden by a newer range tombstone: tombstones become disjoint fragments, and an as-of lookup finds the one that may cover a key."""
    if "cf" not in tombstones.columns:
        tombstones = tombstones.withColumn("cf", F.lit("default"))
    found = as_of(live, fragments(tombstones).drop("cf"), key, "begin_k", parts)
    hidden = F.coalesce((F.col(key) < F.col("at_end_k")) & (F.col("at_seq") > F.col("seq")), F.lit(False))
    return found.filter(~hidden).select(*live.columns)


def single_deletes(log: DataFrame, keys: Sequence[str] = ("k",)) -> DataFrame:
    """The log after each single deletion has cancelled the put right before it on its key; a single deletion without one goes too."""
    by = Window.partitionBy(*keys).orderBy("seq")
    near = log.withColumn("_next", F.lead("op").over(by))
    return near.filter(~((F.col("op") == 1) & (F.coalesce("_next", F.lit(-1)) == 7)) & (F.col("op") != 7)).drop("_next")


def as_of_time(log: DataFrame, t: int, keys: Sequence[str] = ("k",), time: str = "ts_us") -> DataFrame:
    """Live rows at user time ``t``, whatever the order of arrival; equal times go by sequence number."""
    newest = latest(log.filter(F.col(time) <= t), keys, (time, "seq"))
    return newest.filter(~F.col("op").isin(*DELETES))


def history(log: DataFrame, lower: int, upper: int, time: str = "ts_us") -> DataFrame:
    """All versions between two user times, both inclusive."""
    return log.filter(F.col(time).between(lower, upper))


def may_exist(log: DataFrame, wanted: DataFrame, keys: Sequence[str] = ("k",)) -> DataFrame:
    """Wanted keys that have any version: no false negatives, and exact where no key was deleted."""
    return wanted.join(log.select(*keys).distinct(), list(keys), "left_semi")
