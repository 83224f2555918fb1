"""Helpers that the text operators share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import arrow_udf

from basalt.plans.ship import ship

#: White space between words; also what ``bytes.split()`` cuts at.
BLANK = " \t\n\x0b\x0c\r"
#: A word, for Spark's regular expressions.
WORD = r"[^\x20\x09-\x0D]+"
#: Texts handed to Python code at once; a batch of 64 holds a few MB even where documents are very long.
CHUNK = 64


def fresh(name: str, *dfs: DataFrame) -> str:
    """A column name that none of the tables has, whatever the letter case."""
    taken = {c.lower() for df in dfs for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def text_batches(column: pa.Array) -> Iterator[list[str]]:
    """The strings of an Arrow column, nulls as empty, converted a few at a time."""
    for at in range(0, len(column), CHUNK):
        yield [x or "" for x in column.slice(at, CHUNK).to_pylist()]


def byte_batches(column: pa.Array) -> Iterator[list[bytes]]:
    """The same as UTF-8."""
    for at in range(0, len(column), CHUNK):
        yield [x or b"" for x in column.slice(at, CHUNK).cast(pa.binary()).to_pylist()]


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, and at its end the memory that it no longer needs goes back to the system, as the Python worker stays for other tasks."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # another C library
            pass

    return whole


def texts(column: pa.Array) -> Iterator[str]:
    """The same, one by one."""
    for batch in text_batches(column):
        yield from batch


def per_text(df: DataFrame, text: str, fn: Callable[[str], tuple], fields: list[tuple[str, pa.DataType]], to: str) -> DataFrame:
    """Add a struct column ``to`` with what ``fn`` returns for each text, a null text taken as empty.

    Only the text goes to Python; the other columns wait in the JVM.
    """
    return per_batch(df, text, lambda batch: [fn(x) for x in batch], fields, to)


def per_batch(df: DataFrame, text: str, fn: Callable[[list[str]], list[tuple]], fields: list[tuple[str, pa.DataType]], to: str) -> DataFrame:
    """As ``per_text``, but ``fn`` gets up to CHUNK texts at once and returns a row for each."""
    ship(df.sparkSession)
    return df.withColumn(to, _udf(fn, fields)(F.col(f"`{text}`")))


def _udf(fn: Callable[[list[str]], list[tuple]], fields: list[tuple[str, pa.DataType]]) -> Callable[..., Column]:
    ddl = ",".join(f"{n}:{_DDL[t]}" for n, t in fields)

    def run(column: pa.Array) -> pa.Array:
        done = []
        for batch in text_batches(column):
            rows = fn(batch)
            cols = list(zip(*rows))
            done.append(pa.StructArray.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, fields)], names=[n for n, _ in fields]))
        return pa.concat_arrays(done) if done else pa.array([], pa.struct(fields))

    run.__annotations__ = {"column": pa.Array, "return": pa.Array}
    return arrow_udf(run, f"struct<{ddl}>")


_DDL = {pa.int64(): "bigint", pa.string(): "string", pa.bool_(): "boolean", pa.float64(): "double", pa.binary(): "binary"}
