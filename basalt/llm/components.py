"""Connected components of a graph given as a table of links.

Alternating large and small stars: each round hooks every node's neighbours to the least
of them, until the links form stars. A round is two joins of the links with one row for
each node, so a hub's links may be split among tasks; each round's links are a written
table, and nothing but two numbers comes to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basalt.plans.scratch import Scratch
from basalt.plans.ship import ship


def union(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same components as star links (node, least node), for links held in memory."""
    nodes, at = np.unique(np.r_[a, b], return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        before = root.copy()
        np.minimum.at(root, root[x], low)
        np.minimum.at(root, root[y], low)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
        if (root == before).all():
            break
    child = root != np.arange(len(nodes))
    return nodes[child], nodes[root[child]]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of one batch as stars: fewer, and shorter chains."""
    for batch in batches:
        if batch.num_rows:
            v, m = union(batch.column(0).to_numpy(), batch.column(1).to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(v), pa.array(m)], names=["u", "v"])


def components(links: DataFrame, scratch: Scratch, rounds: int = 60) -> DataFrame:
    """(node, root) for every node that isn't the least of its component; links: two long columns, no nulls."""
    ship(links.sparkSession)
    a, b = links.columns
    pairs = links.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v")
    edges = scratch.write(pairs.mapInArrow(_contract, "u bigint, v bigint").distinct())
    mark = None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        new = scratch.write(small)
        scratch.drop(edges)
        edges = new
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = now
    raise RuntimeError("components need more rounds")
