"""Merge operators as aggregations: what a key's operands since its last put or delete come to.

Operands fold from oldest to newest over the base value, which is null where the key is absent or was deleted.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def operands(log: DataFrame, keys: Sequence[str] = ("k",), snapshot: int | None = None) -> DataFrame:
    """Rows since each key's last base, with is_base (the put) or is_operand; a deletion is left out, and what is older too."""
    seen = log if snapshot is None else log.filter(F.col("seq") <= snapshot)
    # the last base of each key, aggregated before the shuffle and joined, so that the rows of a hot key may be split among tasks
    base = seen.filter(F.col("op").isin(0, 1, 7)).groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.max("seq").alias("_base"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    live = seen.filter(F.col("op").isin(1, 2)).join(base, same, "left").filter(F.col("_base").isNull() | (F.col("seq") >= F.col("_base"))).select(*log.columns)
    return live.withColumn("is_base", F.col("op") == 1)


def _newest(v: Column) -> Column:
    return F.max_by(v, F.col("seq"))


def _add(v: Column) -> Column:
    """64-bit addition without sign; it wraps."""
    two = F.lit(str(1 << 64)).cast("decimal(38,0)")
    return F.pmod(F.sum(v.cast("decimal(38,0)")), two)


def _append(delimiter: str) -> Callable[[Column], Column]:
    def fold(v: Column) -> Column:
        ordered = F.array_sort(F.collect_list(F.struct(F.col("seq").alias("s"), v.cast("string").alias("v"))))
        return F.array_join(F.transform(ordered, lambda x: x.v), delimiter)

    return fold


def _sort_list(v: Column) -> Column:
    """Ascending integers of comma lists, repeats kept, without the base value."""
    lists = F.collect_list(F.when(~F.col("is_base"), v.cast("string")))
    parts = F.flatten(F.transform(lists, lambda x: F.transform(F.split(x, ","), lambda y: y.cast("bigint"))))
    return F.array_join(F.transform(F.array_sort(parts), lambda x: x.cast("string")), ",")


OPERATORS: dict[str, Callable[[Column], Column]] = {
    "put": _newest, "put_v1": _newest, "uint64add": _add, "max": F.max, "stringappend": _append(","), "stringappendtest": _append(","), "sortlist": _sort_list, "bytesxor": F.bit_xor,
}


def merged(log: DataFrame, operator: str | Callable[[Column], Column], keys: Sequence[str] = ("k",), snapshot: int | None = None) -> DataFrame:
    """keys, v (folded) and n (operands, the base not counted) of every live key. ``operator``: a name of OPERATORS, or a function from the value column to an aggregate."""
    fold = OPERATORS[operator] if isinstance(operator, str) else operator
    return operands(log, keys, snapshot).groupBy(*keys).agg(fold(F.col("v")).alias("v"), F.sum((~F.col("is_base")).cast("long")).alias("n"))


def merged_by(log: DataFrame, fold: Callable[[object, list], object], schema: str, keys: Sequence[str] = ("k",)) -> DataFrame:
    """As ``merged`` with a Python function from (base or None, operands from the oldest) to a value, for what columns can't express."""

    def run(held: pd.DataFrame) -> pd.DataFrame:
        held = held.sort_values("seq")
        base = held.loc[held["is_base"], "v"]
        value = fold(base.iloc[0] if len(base) else None, held.loc[~held["is_base"], "v"].tolist())
        return held[list(keys)].head(1).assign(v=value)

    return operands(log, keys).groupBy(*keys).applyInPandas(run, schema)


def xor_bytes(base: bytes | None, values: list[bytes]) -> bytes:
    """Bytewise exclusive or; the longer one's tail is copied."""
    out = bytearray(base or b"")
    for v in values:
        out.extend(b"\0" * (len(v) - len(out)))
        for i, b in enumerate(v):
            out[i] ^= b
    return bytes(out)


def operand_lists(log: DataFrame, keys: Sequence[str] = ("k",), limit: int | None = None) -> DataFrame:
    """Unfolded operands from base to newest, as a list; with ``limit``, only keys that have no more."""
    ordered = F.array_sort(F.collect_list(F.struct("seq", "v")))
    out = operands(log, keys).groupBy(*keys).agg(F.transform(ordered, lambda x: x.v).alias("operands"))
    return out if limit is None else out.filter(F.size("operands") <= limit)


def wide_rows(cells: DataFrame, row: str = "row_id") -> DataFrame:
    """Merged wide rows: each (row, column) keeps its newest cell, and cells at or before the row's newest row tombstone go.

    cells: row, idx, ts, kind (column, expiring, tombstone, or row_tombstone with null idx), value; equal times go by kind.
    """
    dead = F.max(F.when(F.col("kind") == "row_tombstone", F.col("ts"))).over(Window.partitionBy(row))
    live = cells.withColumn("_dead", dead).filter((F.col("kind") != "row_tombstone") & (F.col("_dead").isNull() | (F.col("ts") > F.col("_dead")))).drop("_dead")
    newest = F.max_by(F.struct("ts", "kind", "value"), F.struct("ts", "kind")).alias("c")
    return live.groupBy(row, "idx").agg(newest).select(row, "idx", "c.*")


def expire_cells(cells: DataFrame, now: int, ttl: int, grace: int) -> DataFrame:
    """Wide-row compaction: expired cells become tombstones, and tombstones older than the grace period go."""
    stale = (F.col("kind") == "expiring") & (F.col("ts") + ttl < now)
    value = F.when(~stale, F.col("value")).alias("value")
    kind = F.when(stale, "tombstone").otherwise(F.col("kind")).alias("kind")
    turned = cells.select(*[value if c == "value" else kind if c == "kind" else F.col(c) for c in cells.columns])
    return turned.filter(~((F.col("kind") == "tombstone") & (F.col("ts") + grace < now)))
