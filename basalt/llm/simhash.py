"""Near-duplicates by SimHash, found with deletion-variant signatures.

A text's fingerprint takes the majority of each bit over the hashes of its word shingles.
Fingerprints within 3 bits of each other are linked: cut in two segments, at least one
segment of the two fingerprints differs by one bit at most, so each fingerprint is
indexed under its segments with each bit in turn as a wildcard; equal keys meet, and all 64
bits verify. A group too large to compare is not compared: its members are indexed
again, by the halves of the segment that the group leaves free, and once more if need be;
then a group holds at most 2048 different fingerprints. Equal fingerprints are one from the start.

Defined results: a null text is empty; without words the fingerprint is zero, which links
like any other. Fewer words than a shingle has make one shingle. A null doc_id keeps its
row, and its component is the smallest id reachable that isn't null. Repeated rows stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basalt.llm.common import fresh, per_text
from basalt.llm.components import components, union
from basalt.plans.scratch import Scratch, settle
from basalt.plans.ship import ship

#: Most members of a group that are compared; the last level's groups can't have more.
LIMIT = 2048


def fingerprint(text: str, width: int = 3, seed: int = 42) -> int:
    """The 64-bit SimHash of the text's lower-cased word shingles, repeats included."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        h = np.array([xxhash.xxh64_intdigest(joined, seed)], np.uint64)
    else:
        lens = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lens + 1) - 1
        starts = (ends - lens).tolist()
        digest = xxhash.xxh64_intdigest
        h = np.fromiter([digest(joined[a:b], seed) for a, b in zip(starts, ends[width - 1 :].tolist())], np.uint64, len(words) - width + 1)
    bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * bits > len(h), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, text: str = "text", width: int = 3, to: str = "fp") -> DataFrame:
    """Add the fingerprint as a signed long."""
    held = fresh("held", docs)
    row = lambda x: (int(np.uint64(fingerprint(x, width)).view(np.int64)),)
    return per_text(docs, text, row, [("fp", pa.int64())], held).withColumn(to, F.col(f"{held}.fp")).drop(held)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _expand(fp: np.ndarray, key: np.ndarray, off: np.ndarray, width: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(key, fingerprint, offset of the free segment) for each half of the free segment and each wildcard in it."""
    half = width // 2
    out = []
    for h in (0, 1):
        own, other = off + h * half, off + (1 - h) * half
        part = (fp >> own.astype(np.uint64)) & np.uint64((1 << half) - 1)
        for bit in range(half):
            new = _mix(_mix(key + np.uint64(64 * h + bit + 1)) ^ (part & ~np.uint64(1 << bit)))
            out.append((new, fp, other))
    return out


KEYED = "key bigint, fp bigint, off int"


def _index(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 20_000):
                key, fp, off = (c.to_numpy() for c in batch.slice(at, 20_000).columns)
                parts = _expand(fp.view(np.uint64), key.view(np.uint64), off, width)
                cols = [np.concatenate(c) for c in zip(*parts)]
                yield pa.RecordBatch.from_arrays([pa.array(cols[0].view(np.int64)), pa.array(cols[1].view(np.int64)), pa.array(cols[2].astype(np.int32))], names=["key", "fp", "off"])

    return run


def _near(fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Star links among a group's fingerprints, compared in blocks."""
    a, b = [], []
    for at in range(0, len(fps), 256):
        i, j = np.nonzero(np.bitwise_count(fps[at : at + 256, None] ^ fps[None, at + 1 :]) <= distance)
        ok = j >= i
        if ok.any():
            v, m = union(np.r_[fps[at + i[ok]], *a], np.r_[fps[at + 1 + j[ok]], *b])
            a, b = [v], [m]
    return (a[0], b[0]) if a else (fps[:0], fps[:0])


LINKS = "a bigint, b bigint, key bigint, off int"


def _groups(distance: int):
    """Links within groups of equal keys; rows of groups over LIMIT pass through with their key (a: fingerprint, b: null).

    Rows come sorted by key, and at most LIMIT rows of a group are held.
    """

    def batch_of(a: np.ndarray, b: np.ndarray | None, key: np.ndarray, off: np.ndarray) -> pa.RecordBatch:
        n = len(a)
        second = pa.nulls(n, pa.int64()) if b is None else pa.array(b.view(np.int64))
        tail = [pa.array(key), pa.array(off)] if b is None else [pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32())]
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), second, *tail], names=["a", "b", "key", "off"])

    def settle(key: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Links of whole groups of at most LIMIT."""
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        sizes = np.diff(np.r_[first, len(key)])
        a, b = [], []
        many = np.repeat(sizes > 1, sizes)
        key, fp, big = key[many], fp[many], np.repeat(sizes, sizes)[many]
        small = big <= 16
        k, f = key[small], fp[small]
        for d in range(1, 16):
            hit = np.flatnonzero((k[d:] == k[:-d]) & (np.bitwise_count(f[d:] ^ f[:-d]) <= distance)) if len(k) > d else []
            if not len(hit):
                continue
            a.append(f[hit + d])
            b.append(f[hit])
        k, f = key[~small], fp[~small]
        if len(k):
            cuts = np.flatnonzero(k[1:] != k[:-1]) + 1
            for group in np.split(f, cuts):
                v, m = _near(group, distance)
                a.append(v)
                b.append(m)
        a, b = np.concatenate([fp[:0], *a]), np.concatenate([fp[:0], *b])
        return union(a, b) if len(a) else (a, b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple] = []
        held = 0
        passing = None
        for batch in batches:
            if not batch.num_rows:
                continue
            key, fp, off = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64), batch.column(2).to_numpy()
            if passing is not None:
                n = int(np.searchsorted(key != passing, True)) if key[0] == passing else 0
                if n:
                    yield batch_of(fp[:n], None, key[:n], off[:n])
                    key, fp, off = key[n:], fp[n:], off[n:]
                if not len(key):
                    continue
                passing = None
            kept.append((key, fp, off))
            held += len(key)
            key, fp, off = (np.concatenate(c) for c in zip(*kept))
            first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            sizes = np.diff(np.r_[first, len(key)])
            open_ = sizes[-1]
            over = sizes > LIMIT
            if over.any():
                rows = np.repeat(over, sizes)
                yield batch_of(fp[rows], None, key[rows], off[rows])
                if over[-1]:
                    passing = key[-1]
            done = np.repeat(~over, sizes)
            if not over[-1]:
                done[len(done) - open_ :] = False
                kept = [(key[len(key) - open_ :], fp[len(fp) - open_ :], off[len(off) - open_ :])]
            else:
                kept = []
            if done.any():
                a, b = settle(key[done], fp[done])
                if len(a):
                    yield batch_of(a, b, key, off)
        if kept:
            a, b = settle(kept[0][0], kept[0][1])
            if len(a):
                yield batch_of(a, b, kept[0][0], kept[0][2])

    return run


def links(prints: DataFrame, scratch: Scratch, distance: int = 3) -> DataFrame:
    """Links (a, b) that join all fingerprints (distinct longs in column fp) within ``distance`` bits, directly or by way of others."""
    if not 0 <= distance <= 3:
        raise ValueError("two segments serve at most 3 differing bits")
    ship(prints.sparkSession)
    rows = prints.select(F.lit(0).cast("long").alias("key"), "fp", F.lit(0).alias("off"))
    found = None
    for width in (64, 32, 16):
        keyed = rows.mapInArrow(_index(width), KEYED).repartition("key").sortWithinPartitions("key", "fp")
        done = scratch.write(keyed.mapInArrow(_groups(distance), LINKS))
        near = done.filter("b is not null").select("a", "b")
        found = near if found is None else found.unionByName(near)
        rows = done.filter("b is null").select("key", F.col("a").alias("fp"), "off")
        if rows.isEmpty():
            return found.distinct()
    raise RuntimeError("a group of the last level can't be over the limit")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 3, distance: int = 3) -> DataFrame:
    """doc_id, fp (signed long) and component_id of every row."""
    scratch = Scratch(docs.sparkSession, "simhash")
    made = fingerprints(docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")), "text", width).select("doc_id", "fp")
    made = scratch.write(made)
    own = made.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(links(own.select("fp"), scratch, distance), scratch)
    rooted = own.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = rooted.join(named, "root").select("fp", "component_id")
    return settle(made.join(classes, "fp").select("doc_id", "fp", "component_id"), "classes", scratch)


def first_of_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 3, distance: int = 3) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: the smallest doc_id of each group stays (among null ids and repeated rows, one), with its columns as they are."""
    scratch = Scratch(docs.sparkSession, "simhash")
    rank = F.struct(F.col("doc_id").isNull(), "doc_id", "h")
    made = fingerprints(docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")), "text", width).select("doc_id", F.xxhash64("text").alias("h"), "fp")
    made = scratch.write(made)
    own = made.groupBy("fp").agg(F.min(rank).alias("least"))
    roots = components(links(own.select("fp"), scratch, distance), scratch)
    rooted = own.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    kept = settle(rooted.groupBy("root").agg(F.min("least").alias("k")).select("k.doc_id", "k.h"), "kept-documents", scratch)
    return first_rows(docs, kept, doc_id, text)


def first_rows(docs: DataFrame, kept: DataFrame, doc_id: str, text: str) -> DataFrame:
    """The rows of ``docs`` that ``kept`` names by doc_id and h, the text's hash; of rows equal in both, one."""
    names = [fresh(n, docs) for n in ("kept_id", "kept_hash", "kept_own", "kept_turn")]
    kept = kept.toDF(*names[:2])
    same = F.col(f"`{doc_id}`").eqNullSafe(F.col(names[0])) & (F.col(names[2]) == F.col(names[1]))
    found = docs.withColumn(names[2], F.xxhash64(F.col(f"`{text}`"))).join(kept, same)
    # rows equal in doc_id and text: one of them stays
    turn = F.row_number().over(Window.partitionBy(f"`{doc_id}`", names[2]).orderBy(*[F.col(f"`{c}`") for c in docs.columns if c != text]))
    return found.withColumn(names[3], turn).filter(F.col(names[3]) == 1).select(*[F.col(f"`{c}`") for c in docs.columns])
