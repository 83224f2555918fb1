"""Transactions, seen as tables: conflicts, visibility and overlays."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basalt.operators.resolve import resolve


def conflicts(writes: DataFrame, log: DataFrame, keys: Sequence[str] = ("k",)) -> DataFrame:
    """Transactions that can't commit: a key that they write has a version newer than their snapshot. writes: txn, k, snapshot."""
    newest = log.groupBy(*keys).agg(F.max("seq").alias("newest"))
    hit = writes.join(newest, list(keys)).filter(F.col("newest") > F.col("snapshot"))
    return hit.groupBy("txn").agg(F.count("*").alias("n_conflicts"))


def visible(log: DataFrame, commits: DataFrame, snapshot: int, keys: Sequence[str] = ("k",)) -> DataFrame:
    """Live rows at a snapshot of what prepared transactions committed by then: a version's time is its commit's. commits: txn, commit_seq (null: rolled back)."""
    done = log.join(commits.filter(F.col("commit_seq") <= snapshot), "txn").withColumn("_own", F.col("seq")).withColumn("seq", F.col("commit_seq"))
    from basalt.operators.resolve import latest

    return latest(done, keys, ("seq", "_own")).filter(~F.col("op").isin(0, 7)).drop("_own")


def overlay(log: DataFrame, batch: DataFrame, keys: Sequence[str] = ("k",)) -> DataFrame:
    """Live rows as the writer of an uncommitted batch reads them: the batch, in order of pos, is newer than everything."""
    top = (1 << 62) + F.col("pos")
    return resolve(log.select(*keys, "seq", "op", "v").unionByName(batch.select(*keys, top.cast("long").alias("seq"), "op", "v")), keys)


def write_batch(ops: DataFrame, last: int, savepoint: int | None = None, pos: str = "pos") -> DataFrame:
    """Operations of a batch as log rows: each takes the next sequence number; after a rollback to a savepoint, what came later is gone.

    ops: pos counts from 0 without gaps, so numbers need no global sort.
    """
    kept = ops if savepoint is None else ops.filter(F.col(pos) < savepoint)
    return kept.withColumn("seq", F.lit(last + 1).cast("long") + F.col(pos))


def lock_overlaps(locks: DataFrame, parts: Sequence[object], cell: int = 2000, pairs: int = 20_000_000) -> DataFrame:
    """Pairs of range locks of different transactions that meet.

    Locks of one range are dealt to cells of about ``cell`` locks; cells whose ranges meet are paired, each pair of cells in the first
    part that both ranges lie in, so it comes once. The pairs of locks of two cells are a task's smallest piece of work, and there are as
    many tasks as it takes for about ``pairs`` pairs each.
    """
    from basalt.operators.resolve import parts_of, range_part
    from basalt.plans.scratch import Scratch

    spark = locks.sparkSession
    scratch = Scratch(spark, "locks")
    ranges = locks.groupBy("lo", "hi").agg(F.count("*").alias("_n")).withColumn("_cells", F.ceil(F.col("_n") / cell))
    own = locks.select("txn", "lo", "hi").join(ranges, ["lo", "hi"]).withColumn("_cell", F.pmod(F.xxhash64("txn"), F.col("_cells")))
    own = scratch.write(own.select("txn", "lo", "hi", F.struct("lo", "hi", "_cell").alias("c")))
    cells = own.groupBy("c").agg(F.count("*").alias("n")).select("c", "n", F.col("c.lo").alias("lo"), F.col("c.hi").alias("hi"))
    spread = max(1, parts_of(spark, None) // (len(parts) + 1))
    cut = scratch.write(cells.withColumn("p0", range_part(F.col("lo"), list(parts))).withColumn("p1", range_part(F.col("hi"), list(parts))).withColumn("part", F.explode(F.sequence("p0", "p1"))))
    a = cut.withColumn("turn", F.pmod(F.xxhash64("c"), F.lit(spread))).alias("a")
    b = cut.withColumn("turn", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(spread - 1).cast("long")))).alias("b")
    meet = (F.col("a.part") == F.col("b.part")) & (F.col("a.turn") == F.col("b.turn")) & (F.col("a.c") <= F.col("b.c")) & (F.col("a.lo") <= F.col("b.hi")) & (F.col("b.lo") <= F.col("a.hi")) & (F.col("a.part") == F.greatest("a.p0", "b.p0"))
    met = scratch.write(a.join(b, meet).select(F.col("a.c").alias("one"), F.col("b.c").alias("two"), (F.col("a.n") * F.col("b.n")).alias("n")))
    tasks = max(parts_of(spark, None), min((met.agg(F.sum("n")).first()[0] or 0) // pairs, 100_000))
    left = met.join(own.select(F.col("c").alias("one"), F.col("txn").alias("x")), "one").select("one", "two", "x").repartition(tasks, "one", "two")
    right = met.join(own.select(F.col("c").alias("two"), F.col("txn").alias("y")), "two").select("one", "two", "y").repartition(tasks, "one", "two")
    both = left.join(right.hint("shuffle_hash"), ["one", "two"]).filter((F.col("x") != F.col("y")) & ((F.col("one") != F.col("two")) | (F.col("x") < F.col("y"))))
    return both.select(F.least("x", "y").alias("one"), F.greatest("x", "y").alias("two"))


def deadlocked(waits: DataFrame, scratch=None, depth: int | None = None) -> DataFrame:
    """Transactions in a circle of waits, each waiting for one other at most (txn, waits_for); with ``depth``, in circles of so many waits at most.

    Whoever is reached after more steps than there are transactions lies in a circle; steps double from round to round.
    For a depth, the least transaction of each circle is found in the same way, and circles are counted by it.
    """
    from basalt.plans.scratch import Scratch

    scratch = scratch or Scratch(waits.sparkSession, "deadlocks")
    first = jump = scratch.write(waits.select(F.col("txn").alias("a"), F.col("waits_for").alias("b")).filter("b is not null"))
    n, steps = jump.count(), 1
    while steps < n:
        jump = scratch.write(jump.join(jump.select(F.col("a").alias("b"), F.col("b").alias("c")), "b").select("a", F.col("c").alias("b")))
        steps *= 2
    found = jump.select(F.col("b").alias("txn")).distinct()
    if depth is None:
        return found
    ring = scratch.write(first.join(found.select(F.col("txn").alias("a")), "a", "left_semi").withColumn("least", F.col("a")))
    n, steps = ring.count(), 1
    while steps < n:
        ahead = ring.select(F.col("a").alias("b"), F.col("b").alias("c"), F.col("least").alias("other"))
        ring = scratch.write(ring.join(ahead, "b").select("a", F.col("c").alias("b"), F.least("least", "other").alias("least")))
        steps *= 2
    short = ring.groupBy("least").agg(F.count("*").alias("n")).filter(F.col("n") <= depth)
    return ring.join(short, "least", "left_semi").select(F.col("a").alias("txn"))


def iterate(batches: DataFrame, handlers: dict[int, Column], ops: str = "ops") -> DataFrame:
    """Each operation of each batch in order, with what the handler of its kind makes of it: a column of said; operations without a handler are passed over.

    ``ops`` is an array of structs with op; a handler is an expression over their fields.
    """
    others = [c for c in batches.columns if c != ops]
    flat = batches.select(*others, F.posexplode(ops).alias("pos", "_op")).select(*others, "pos", "_op.*")
    said = F.lit(None).cast("string")
    for op, what in handlers.items():
        said = F.when(F.col("op") == op, what).otherwise(said)
    return flat.withColumn("said", said).filter(F.col("op").isin(*handlers))
