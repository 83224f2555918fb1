"""Mixing sources to target weights by the cube method.

A document's expected number of copies is its source's target divided by the source's
size. The whole part is taken; the fractional part is an inclusion probability. Blocks of
documents move their probabilities through the null space of two balances, the number of
documents and of tokens, three at a time, so that each step settles one document and
both totals stay. At most two documents of a block remain; they form the next
level's blocks, until a source has one block. Of that the flight leaves LANDING documents, small ones as large ones are settled
first, and they land where the tokens come closest.

Defined results: a null text has size 0, and so has an empty one; a text of any length is counted whole. Sources go by code point, null last, and take the
weights in turn. Rows equal in source, doc_id and text are taken together. Reruns agree,
whatever the partitions: blocks and random numbers come from hashes. No document is
taken more than twice. An empty table, or one without words, gives targets of 0. Further columns of any
names stay with ``mix``. Equal rows count as one document of their size together, so a source that consists of one
such lump comes no nearer to its target than the lump allows.
"""

from __future__ import annotations

import math
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basalt.llm.common import per_text
from basalt.plans.scratch import Scratch, settle

#: Documents of a block.
BLOCK = 20_000
#: Documents of the landing problem, whatever the source: of its last block, the flight leaves that many, small ones.
LANDING = 12

def ranked(own: DataFrame, scratch: Scratch) -> DataFrame:
    """The rows with their rank, from 0, by code point of the source, null last: ranges of sources count on their own, and go on where the ranges before them end."""
    order = [F.col("source").isNull(), F.col("source")]
    dealt = scratch.write(own.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    counts = dict(dealt.groupBy("part").count().collect())  # a row for each partition
    before, total = {}, 0
    for part in sorted(counts):
        before[part] = total
        total += counts[part]
    base = F.create_map(*[F.lit(x).cast("long") for pair in before.items() for x in pair]) if before else F.create_map(F.lit(0), F.lit(0))
    place = F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1
    return dealt.withColumn("rank", place + base[F.col("part").cast("long")]).drop("part")


def targets(sizes: DataFrame, scratch: Scratch, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, source_size and target, from rows of source and size.

    Targets are in proportion to the weights except where they would exceed ``most`` times the source's size: such sources stop there, and what
    they leave is shared by the rest, until none is above. Each turn is an aggregation over the sources, of which there may be many.
    """
    own = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    named = scratch.write(ranked(own, scratch).select("source", "source_size", weight.alias("w"), (F.col("source_size") * F.lit(float(most))).alias("cap")))
    whole, heavy = named.agg(F.sum("source_size"), F.sum("w")).first()
    level, stopped = 0.0, -1
    while heavy:
        stops = F.col("cap") <= F.col("w") * F.lit(level)
        n, cap, w = named.filter(stops).agg(F.count("*"), F.sum("cap"), F.sum("w")).first() if level else (0, None, None)
        if n == stopped or (w or 0) >= heavy:
            break
        stopped, level = n, (float(whole or 0) * share - (cap or 0.0)) / (heavy - (w or 0.0))
    return named.select("source", "source_size", F.least("cap", F.col("w") * F.lit(float(level))).alias("target"))


def fly(size: np.ndarray, p: np.ndarray, rng: random.Random, rest: int = 2) -> np.ndarray:
    """Probabilities after the flight: all but ``rest`` at most are 0 or 1, and the sums of p and of size * p stay. Large documents are settled first."""
    p = p.astype(float).tolist()
    todo = [int(i) for i in np.argsort(-size, kind="stable") if 0.0 < p[i] < 1.0]
    todo.reverse()
    active: list[int] = []
    eps = 1e-9
    while True:
        while len(active) < 3 and todo:
            active.append(todo.pop())
        if len(active) < 2 or len(active) + len(todo) <= rest:
            break
        s = [int(size[i]) for i in active]
        if len(active) == 3:
            u = (s[1] - s[2], s[2] - s[0], s[0] - s[1])
            if not any(u):
                u = (1, -1, 0)
        elif s[0] == s[1]:
            u = (1, -1)
        else:
            break
        up = min((1.0 - p[i]) / d if d > 0 else p[i] / -d for i, d in zip(active, u) if d)
        down = min(p[i] / d if d > 0 else (1.0 - p[i]) / -d for i, d in zip(active, u) if d)
        step = up if rng.random() * (up + down) < down else -down
        for i, d in zip(active, u):
            p[i] += step * d
            if p[i] < eps:
                p[i] = 0.0
            elif p[i] > 1.0 - eps:
                p[i] = 1.0
        active = [i for i in active if 0.0 < p[i] < 1.0]
    return np.array(p)


def land(size: np.ndarray, p: np.ndarray) -> np.ndarray:
    """The fractional ones, at most LANDING, rounded so that the tokens come closest, then the number of documents; all others are settled."""
    p = p.copy()
    left = np.flatnonzero((p > 0) & (p < 1))
    choice = (np.arange(1 << len(left))[:, None] >> np.arange(len(left))) & 1
    gap, other = np.abs(choice @ size[left] - (size[left] * p[left]).sum()), np.abs(choice.sum(axis=1) - p[left].sum())
    p[left] = choice[np.lexsort((other, np.round(gap, 6)))[0]]
    return p


FLIGHT = "doc_id {id}, source string, h bigint, n_rows bigint, size bigint, unit bigint, source_size bigint, target double, whole int, p double, blocks bigint"


def _level(number: int, seed: int):
    def run(key: tuple, held: pa.Table) -> pa.Table:
        """One block; ids stay in Arrow, as numpy would round those beside a null."""
        held = held.sort_by([("h", "ascending"), ("doc_id", "ascending")])
        unit = held.column("unit").to_numpy()
        rng = random.Random(f"{seed}/{number}/{key[0].as_py()}/{key[1].as_py()}")
        last = held.column("blocks")[0].as_py() == 1
        p = fly(unit, held.column("p").to_numpy(), rng, LANDING if last else 2)
        if last:
            p = land(unit, p)
        held = held.set_column(held.column_names.index("p"), "p", pa.array(p))
        return held.select([f.split()[0] for f in FLIGHT.split(", ")])

    return run


def draw(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 11, block: int = BLOCK) -> DataFrame:
    """One row for each different (doc_id, source, text): doc_id, source, h (hash of the text), n_rows, size, source_size, target, copies."""
    if most > 2:
        raise ValueError("a document is taken twice at most")
    scratch = Scratch(docs.sparkSession, "mixing")
    own = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{source}`").cast("string").alias("source"), F.col(f"`{text}`").alias("text"))
    sized = per_text(own, "text", lambda x: (len(x.encode().split()),), [("size", pa.int64())], "held")
    sized = scratch.write(sized.select("doc_id", "source", F.xxhash64("text").alias("h"), F.col("held.size").alias("size")))
    wanted = targets(sized, scratch, weights, share, most)
    units = sized.groupBy("doc_id", "source", "h", "size").agg(F.count("*").alias("n_rows"))
    named = units.join(wanted.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor(rate + 1e-12).cast("int")
    unit = F.col("size") * F.col("n_rows")
    p = F.greatest(F.lit(0.0), rate - whole)
    ready = scratch.write(named.select("doc_id", "source", "h", "n_rows", "size", unit.alias("unit"), "source_size", "target", whole.alias("whole"), F.when(F.col("unit") > 0, p).otherwise(F.lit(0.0)).alias("p")))
    moving = ready.filter("p > 0 and p < 1")
    most_units = moving.groupBy("source").count().agg(F.max("count")).first()[0] or 0
    done = ready.filter("not (p > 0 and p < 1)")
    kind = docs.schema[doc_id].dataType.simpleString()
    level = 0
    while most_units:
        counts = moving.groupBy("source").agg(F.ceil(F.count("*") / F.lit(block)).cast("long").alias("blocks")).withColumnRenamed("source", "of")
        dealt = moving.join(counts, F.col("source").eqNullSafe(F.col("of"))).drop("of").withColumn("block", F.pmod(F.xxhash64("h", "doc_id", F.lit(level)), F.col("blocks")))
        flown = scratch.write(dealt.groupBy("source", "block").applyInArrow(_level(level, seed), FLIGHT.format(id=kind))).drop("blocks")
        done = done.unionByName(flown.filter("not (p > 0 and p < 1)"))
        if most_units <= block:
            break
        moving = flown.filter("p > 0 and p < 1")
        most_units = 2 * math.ceil(most_units / block)
        level += 1
    drawn = done.withColumn("copies", F.col("whole") + F.round("p").cast("int")).select("doc_id", "source", "h", "n_rows", "size", "source_size", "target", "copies")
    return settle(drawn, "drawn", scratch)


def mix(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", **how) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it."""
    from basalt.llm.common import fresh

    taken = draw(docs, doc_id, source, text, **how).filter("copies > 0").select(F.col("doc_id").alias("_1"), F.col("source").alias("_2"), F.col("h").alias("_3"), F.col("copies").alias("_4"))
    names = [fresh(n, docs) for n in ("mix_id", "mix_source", "mix_hash", "mix_copies")]
    taken = taken.toDF(*names)
    held = fresh("mix_own", docs)
    same = F.col(f"`{doc_id}`").eqNullSafe(F.col(names[0])) & F.col(f"`{source}`").cast("string").eqNullSafe(F.col(names[1])) & (F.col(held) == F.col(names[2]))
    return docs.withColumn(held, F.xxhash64(F.col(f"`{text}`"))).join(taken, same).withColumn(held, F.explode(F.sequence(F.lit(1), F.col(names[3])))).select(*[F.col(f"`{c}`") for c in docs.columns])
