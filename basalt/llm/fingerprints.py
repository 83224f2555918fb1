"""Document fingerprints from closed syncmers.

A k-mer of a text's bytes is an anchor if the least of the s-mers inside it stands at its first
or last place. That depends on the k-mer alone, so a passage has the same anchors wherever it
stands, and equal anchors at a steady shift show what two texts share. The fingerprint is the
least hashes of a text's anchors; likeness estimates the Jaccard index of the anchor sets.

Defined results: a null text is empty. An empty text's fingerprint is the empty string; two of
them are alike by 1, an empty and another text by 0. A text without an anchor, shorter than
k bytes for instance, has the hash of the whole text as its only one. Equal texts have equal fingerprints.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import arrow_udf

from basalt.llm.common import text_batches
from basalt.plans.ship import ship

K, S, LEAST = 12, 8, 64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def syncmers(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Positions and 64-bit hashes of the closed syncmers of ``data``."""
    n = len(data) - K + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    word = np.ndarray((len(data) - S + 1,), "<u8", data, 0, (1,)).astype(np.uint64)
    h = _mix(word)
    low = h
    span, width = 1, K - S + 1
    while 2 * span <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < width:
        low = np.minimum(low[: n], low[width - span : width - span + n])
    at = np.flatnonzero((h[:n] == low[:n]) | (h[width - 1 : width - 1 + n] == low[:n]))
    return at, _mix(h[at] * np.uint64(0x9E3779B97F4A7C15) + h[at + K - S])


def sketch(data: bytes) -> np.ndarray:
    """The LEAST smallest 32-bit anchor hashes, ascending."""
    if not data:
        return np.zeros(0, np.uint32)
    _, h = syncmers(data)
    if not len(h):
        return np.array([xxhash.xxh32_intdigest(data)], np.uint32)
    h = (h >> np.uint64(32)).astype(np.uint32)
    if len(h) > 8 * LEAST:
        part = 4 * LEAST
        few = np.unique(np.partition(h, part)[:part])
        if len(few) >= LEAST:
            return few[:LEAST]
    return np.unique(h)[:LEAST]


def text_of(s: np.ndarray) -> str:
    return s.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The share of the union's least hashes that both have."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.sort(np.concatenate([a, b]))
    same = both[1:] == both[:-1]
    union = both[np.r_[True, ~same]][:LEAST]
    return float(np.count_nonzero(both[1:][same] <= union[-1])) / len(union)


def anchors(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each anchor, for positional matching: doc_id, pos (byte), hash."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = 0
            for part in text_batches(batch.column(1)):
                made = [syncmers(x.encode()) for x in part]
                owner = np.repeat(np.arange(row, row + len(part)), [len(p) for p, _ in made])
                row += len(part)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner)), pa.array(np.concatenate([p for p, _ in made])), pa.array(np.concatenate([h for _, h in made]).view(np.int64))], names=["doc_id", "pos", "hash"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")).mapInArrow(run, f"doc_id {kind}, pos bigint, hash bigint")


OUT = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by part, own rows before guests, each in the order of the documents; a document waits for the next one's text."""
    part, first, last = None, None, None
    rows: list[tuple] = []

    def pair(a: tuple, b: tuple) -> tuple:
        doc_id, text, own = a
        half = len(text) // 2
        edited = (text[: len(text) - half] + b[1][:half]).encode()
        new = sketch(edited)
        return doc_id, len(text), hashlib.sha256(edited).hexdigest(), text_of(own), text_of(new), likeness(own, new), likeness(own, b[2])

    def flush() -> pa.RecordBatch:
        cols = list(zip(*rows)) if rows else [()] * 7
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])
        rows.clear()
        return out

    for batch in batches:
        ids, parts, guests = batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()
        row = 0
        for texts in text_batches(batch.column(1)):
            for text in texts:
                if parts[row] != part:
                    if last is not None:
                        rows.append(pair(last, first))
                    part, first, last = parts[row], None, None
                if not guests[row] or last is not None:
                    now = (ids[row], text, sketch(text.encode()))
                    if last is not None:
                        rows.append(pair(last, now))
                    first = first or now
                    last = None if guests[row] else now
                row += 1
            if rows:
                yield flush()
    if last is not None:
        rows.append(pair(last, first))
    yield flush()


def compare_edits(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edit, whose second half gives way to the start of the next text.

    The next text is that of the next smaller doc_id (after the last: the first). Rows of equal doc_id follow each
    other by text, null ids come last. The documents are dealt to ranges of doc_id, and each range's first document
    is also a guest at the end of the range before.
    """
    spark = docs.sparkSession
    ship(spark)
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    own = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    share = [i / n for i in range(1, n)] or [1.0]
    top, cuts = own.agg(F.max("doc_id"), F.percentile_approx("doc_id", share, 100 * n)).first()
    cuts = np.array(sorted({c for c in cuts or () if c < top}), np.int64)  # each is a doc_id, and the first of its range
    ranges = len(cuts) + 1

    @arrow_udf("int")
    def part_of(ids: pa.Array) -> pa.Array:
        held = ids.fill_null(np.iinfo(np.int64).min).to_numpy()
        return pa.array((len(cuts) - np.searchsorted(cuts, held, side="left")).astype(np.int32))

    dealt = own.withColumn("own", part_of("doc_id"))
    guest = F.when(F.col("doc_id") == F.lit(top), F.lit(ranges - 1)).when(F.col("doc_id").isin([int(c) for c in cuts]), F.col("own") - 1)
    seats = F.array(F.struct(F.col("own").alias("part"), F.lit(False).alias("guest")), F.struct(guest.cast("int").alias("part"), F.lit(True).alias("guest")))
    seated = dealt.withColumn("seat", F.explode(F.filter(seats, lambda s: s.part.isNotNull()))).select("doc_id", "text", "seat.part", "seat.guest")
    order = seated.repartitionById(ranges, F.col("part")).sortWithinPartitions("part", "guest", F.col("doc_id").desc_nulls_last(), "text")
    return order.mapInArrow(_edits, OUT)
