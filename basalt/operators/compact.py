"""Compaction: what of a log has to stay, and which runs to work on."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basalt.functions.codec import capped_prefix


def _striped(log: DataFrame, snapshots: Sequence[int]) -> DataFrame:
    marks = F.array(*[F.lit(s) for s in sorted(snapshots)]) if snapshots else F.array().cast("array<bigint>")
    seen = log.filter(F.col("op") != 3)  # annotations aren't data
    return seen.withColumn("_stripe", F.coalesce(F.array_min(F.filter(marks, lambda s: s >= F.col("seq"))), F.lit((1 << 63) - 1)))


def compact(log: DataFrame, keys: Sequence[str] = ("k",), snapshots: Sequence[int] = (), bottom: bool = False) -> DataFrame:
    """The newest version of each key in each stripe between snapshots, and with merge operands all of them back to the newest put or deletion of
    the stripe; at the bottom level, a key's oldest row goes if it is a deletion.

    Reading the result at a retained snapshot, or now, gives what reading the log gives, merge operands folded or not.
    """
    of = Window.partitionBy(*keys, "_stripe")
    base = F.max(F.when(F.col("op") != 2, F.col("seq"))).over(of)
    kept = _striped(log, snapshots).withColumn("_base", base).filter(F.col("_base").isNull() | (F.col("seq") >= F.col("_base"))).drop("_base", "_stripe")
    if bottom:
        kept = kept.withColumn("_old", F.min("seq").over(Window.partitionBy(*keys))).filter(~(F.col("op").isin(0, 7) & (F.col("seq") == F.col("_old")))).drop("_old")
    return kept


def compact_merged(log: DataFrame, operator: object, keys: Sequence[str] = ("k",), snapshots: Sequence[int] = (), bottom: bool = False) -> DataFrame:
    """As ``compact`` with the operands of a stripe folded into one row (keys, seq, op, v): into a put where the stripe holds their base, or nothing
    can lie below, else into one operand, so the operator must be associative."""
    from basalt.operators.merge import OPERATORS

    fold = OPERATORS[operator] if isinstance(operator, str) else operator
    own = compact(log, keys, snapshots)
    striped = _striped(own, snapshots)
    value = striped.filter(F.col("op").isin(1, 2)).withColumn("is_base", F.col("op") == 1).groupBy(*keys, "_stripe").agg(fold(F.col("v")).alias("v"))
    shape = striped.groupBy(*keys, "_stripe").agg(
        F.max("seq").alias("seq"), F.max(F.when(F.col("op") != 2, F.col("op"))).alias("_base"), F.max((F.col("op") == 2).cast("int")).alias("_merges"),
    )
    oldest = (F.col("_stripe") == F.min("_stripe").over(Window.partitionBy(*keys))) if bottom else F.lit(False)
    joined = shape.join(value, [*keys, "_stripe"], "left").withColumn("_oldest", oldest)
    op = F.when(F.col("_base") == 1, 1).when(F.col("_base").isNotNull(), F.when(F.col("_merges") == 1, 1).otherwise(F.col("_base"))).otherwise(F.when(F.col("_oldest"), 1).otherwise(2))
    out = joined.withColumn("op", op).filter(~(F.col("_oldest") & F.col("op").isin(0, 7)))
    return out.select(*keys, "seq", "op", "v")


def trivial_moves(files: DataFrame, source: int, most_below: int, level: str = "level", lo: str = "lo", hi: str = "hi", size: str = "bytes") -> DataFrame:
    """Files of a level that may move down by an edit of the manifest: no file of the next level meets them, and of the one after at most ``most_below`` do."""
    own = files.filter(F.col(level) == source)
    for step, name in ((1, "_next"), (2, "_far")):
        there = files.filter(F.col(level) == source + step).select(F.col(lo).alias("_lo"), F.col(hi).alias("_hi"), F.lit(1).alias("_hit"))
        met = own.select("number", lo, hi).join(there, (F.col("_lo") <= F.col(hi)) & (F.col("_hi") >= F.col(lo)), "left").groupBy("number").agg(F.count("_hit").alias(name))
        own = own.join(met, "number")
    return own.filter((F.col("_next") == 0) & (F.col("_far") <= most_below)).drop("_next", "_far")


def filtered(log: DataFrame, keep: Column, change: dict[str, Column] | None = None, keys: Sequence[str] = ("k",)) -> DataFrame:
    """A compaction filter: newest puts that don't pass ``keep`` go, others take ``change``; deletions and merges stay."""
    newest = compact(log, keys)
    put = F.col("op") == 1
    out = newest.filter(~put | F.coalesce(keep, F.lit(False)))
    for name, to in (change or {}).items():
        out = out.withColumn(name, F.when(put, to).otherwise(F.col(name)))
    return out


def expired(log: DataFrame, now_us: int, ttl_s: int, time: str = "ts_us") -> DataFrame:
    """Rows that compaction keeps under a time to live; 0 or less keeps all."""
    return log if ttl_s <= 0 else log.filter(F.col(time) + ttl_s * 1_000_000 >= now_us)


def density(log: DataFrame, window: int, trigger: int, part: str = "part", order: str = "pos") -> DataFrame:
    """Runs with a window of ``window`` consecutive entries that holds ``trigger`` deletions or more."""
    by = Window.partitionBy(part).orderBy(order).rowsBetween(-(window - 1), 0)
    dels = F.sum((F.col("op") == 0).cast("long")).over(by)
    return log.withColumn("dels", dels).groupBy(part).agg(F.max("dels").alias("densest")).withColumn("compact", F.col("densest") >= trigger)


def evict(files: DataFrame, cap: int, order: str = "number", size: str = "bytes") -> DataFrame:
    """First in, first out: files that go so that what stays fits ``cap`` bytes; the newest stay."""
    newest = Window.orderBy(F.col(order).desc()).rowsBetween(Window.unboundedPreceding, 0)
    return files.withColumn("kept_bytes", F.sum(size).over(newest)).filter(F.col("kept_bytes") > cap)


def scores(files: DataFrame, limits: Sequence[int], level: str = "level", size: str = "bytes") -> DataFrame:
    """Bytes of each level against its limit; the level to work on is the one of highest score. The last level has none."""
    limit = F.element_at(F.array(*[F.lit(x) for x in limits]), F.least(F.col(level) + 1, F.lit(len(limits))))
    return files.groupBy(level).agg(F.sum(size).alias("bytes")).withColumn("score_permille", F.floor(F.col("bytes") * 1000 / limit).cast("long"))


def overlapping(files: DataFrame, begin: object, end: object, level: str = "level", lo: str = "lo", hi: str = "hi") -> DataFrame:
    """Files whose range meets [begin, end]."""
    return files.filter((F.col(lo) <= F.lit(end)) & (F.col(hi) >= F.lit(begin)))


def covered(files: DataFrame, begin: object, end: object, lo: str = "lo", hi: str = "hi") -> DataFrame:
    """Files that lie within [begin, end), which deleting files in a range drops whole."""
    return files.filter((F.col(lo) >= F.lit(begin)) & (F.col(hi) < F.lit(end)))


def overlaps(files: DataFrame, level: str = "level", lo: str = "lo", hi: str = "hi", number: str = "number") -> DataFrame:
    """Files of a level that begin before an earlier one of it ends: a level above 0 must have none. One running maximum, no self join."""
    before = Window.partitionBy(level).orderBy(lo, number).rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("reach", F.max(hi).over(before)).filter(F.col("reach") >= F.col(lo))


def base_level(keys: DataFrame, files: DataFrame, above: int, key: str = "k") -> DataFrame:
    """Keys that no file of a level deeper than ``above`` may hold; the files of one level are disjoint, so each level is one as-of lookup."""
    from basalt.operators.resolve import as_of

    deeper = files.filter(F.col("level") > above)
    for row in deeper.select("level").distinct().collect():  # levels are a handful by design
        own = deeper.filter(F.col("level") == row[0]).select("lo", "hi")
        keys = as_of(keys, own, key, "lo").filter(F.col("at_hi").isNull() | (F.col("at_hi") < F.col(key))).select(*keys.columns)
    return keys


def universal_pick(runs: DataFrame, ratio: int = 1, order: str = "number", size: str = "bytes") -> DataFrame:
    """The newest runs to merge: each next older one joins while it isn't larger than all before together by more than ``ratio`` percent."""
    newest = Window.orderBy(F.col(order).desc())
    before = F.sum(size).over(newest.rowsBetween(Window.unboundedPreceding, -1))
    tried = runs.withColumn("before", before).withColumn("stops", F.coalesce(F.col(size) * 100 > F.col("before") * (100 + ratio), F.lit(False)))
    stopped = F.max(F.col("stops").cast("int")).over(newest.rowsBetween(Window.unboundedPreceding, 0))
    return tried.withColumn("stopped", stopped).filter("stopped = 0").drop("before", "stops", "stopped")


def outdated(files: DataFrame, now: int, ttl: int, newest: str = "newest") -> DataFrame:
    """Files whose newest row is older than the time to live, which a first-in-first-out store drops whole."""
    return files.filter(F.col(newest) + ttl < now)


def pick(files: DataFrame, level: int, pointer: object, lo: str = "lo", hi: str = "hi") -> DataFrame:
    """Input of a round-robin compaction: the first file of a level after the pointer, or the level's first, and what it meets one level down."""
    own = files.filter(F.col("level") == level)
    ahead = F.when(F.col(lo) > F.lit(pointer), 0).otherwise(1)
    chosen = own.orderBy(ahead, lo, "number").limit(1)
    span = chosen.select(F.col(lo).alias("_lo"), F.col(hi).alias("_hi"))
    below = files.filter(F.col("level") == level + 1).join(F.broadcast(span), (F.col(lo) <= F.col("_hi")) & (F.col(hi) >= F.col("_lo"))).drop("_lo", "_hi")
    return chosen.unionByName(below)


def partitioned(log: DataFrame, n: int, key: str = "k") -> DataFrame:
    """The log dealt by key prefix, so that no output file holds two prefixes' keys of different tasks."""
    return log.withColumn("part", capped_prefix(F.col(key), n).cast("string")).repartition("part")
