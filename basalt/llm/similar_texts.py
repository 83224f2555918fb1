"""Near-duplicate texts at a Jaccard threshold, by SimHash and deletion-variant signatures.

Two texts of a Jaccard index of 0.8 in five-word shingles are about 10 bits apart in a SimHash of 64 bits of
those shingles, more than two segments can serve. But they share nearly all of their words: so the
fingerprint is that of the set of words, it has 256 bits, of which 240 are cut into 10 segments of 24 bits; one of them
differs by at most one bit with a probability that the README states. Each segment is indexed with each of its bits
in turn as a wildcard; texts meet under equal keys, 58 bits of another part of the fingerprint drop those that met by chance,
and every link is verified on the sets of shingles, so no two texts are linked below t.

Two texts that meet do so once for a segment: under the wildcard of the bit that differs, or the first one. A text takes its CLOSE closest
partners from a group; where there are more, a later round takes those that the links so far haven't joined to it. A group
of more than LIMIT texts isn't compared: its texts are indexed again under the group's key with each of the other segments.

Defined results: a null text is empty; texts without words are alike. Fewer words than a shingle has make one
shingle. Texts of equal sets are one from the start. A null doc_id keeps its row unless an earlier one is alike. Texts may be of any length.
Further columns stay as they are, whatever their names. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basalt.llm.common import byte_batches, trimmed
from basalt.llm.components import components
from basalt.llm.line_dedup import bitmap_of, in_bitmap, may_have
from basalt.llm.shingles import set_rows, shingle_sets, verified
from basalt.llm.simhash import first_rows
from basalt.llm.words import mix, pack_texts, word_hashes
from basalt.plans.scratch import Scratch, settle
from basalt.plans.ship import ship

#: Segments of a fingerprint, and their bits.
SEGMENTS, BITS = 10, 24
#: Most of 58 bits that may differ: of 1,000 pairs that differ in a tenth of the bits, one is beyond it.
CHECK = 14
#: Low bits beside the 58: the wildcard's, whether it is the first one, the segment's number.
SIDE = 6
#: Partners that a text takes from a group at first.
CLOSE = 4
#: Texts of a group that are compared, and how many all others are compared with if it isn't divided further.
LIMIT, LEADS = 32_768, 4_096
#: Words whose bits are held at once.
HELD = 200_000
#: What a row of no pair is; a row of a group that is indexed again has its segment, DEEPER - segment.
FURTHER, DEEPER = -1, -2


def word_prints(texts: list[bytes]) -> np.ndarray:
    """SimHashes of 256 bits of the texts' sets of lower-cased words, a row of four longs for each."""
    data, ends = pack_texts([t.lower() for t in texts])
    h, at, _ = word_hashes(data)
    owner = np.searchsorted(ends, at)
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    h, owner = h[new], owner[new]
    count = np.zeros((len(texts), 256), np.int64)
    for a in range(0, len(h), HELD):
        part, own = h[a : a + HELD], owner[a : a + HELD]
        first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        for k in range(4):
            bits = np.unpackbits(mix(part + np.uint64(0x9E3779B97F4A7C15 * (k + 1) % 2**64)).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            count[own[first], 64 * k : 64 * k + 64] += np.add.reduceat(bits, first, axis=0, dtype=np.int32)
    n = np.bincount(owner, minlength=len(texts))
    return np.packbits(2 * count > n[:, None], axis=1, bitorder="little").view("<u8")


def _prints(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for part in byte_batches(batch.column(2)):
                _, _, n, ids = shingle_sets(part, width)
                fp = word_prints(part).view(np.int64)
                own = batch.slice(at, len(part))
                at += len(part)
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), pa.array(ids.view(np.int64)), pa.array(n.astype(np.int64)), *[pa.array(np.ascontiguousarray(fp[:, k])) for k in range(4)]], names=["doc_id", "h", "id", "n", *PRINT])

    return run


PRINT = ["f0", "f1", "f2", "f3"]
KEYED = "key bigint, id bigint, bits bigint"


def variants(fp: np.ndarray, base: np.ndarray | None = None, taken: np.ndarray | None = None, wanted: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(key, row, bits) of each segment and wildcard, perhaps below a group's key, which has taken a segment of its own."""
    raw = np.concatenate([np.ascontiguousarray(fp).view(np.uint8), np.zeros((len(fp), 1), np.uint8)], axis=1).astype(np.uint64)
    for s in range(SEGMENTS):
        at = s * BITS // 8
        part = raw[:, at] | (raw[:, at + 1] << np.uint64(8)) | (raw[:, at + 2] << np.uint64(16))
        other = (fp[:, (s * BITS // 64 + 2) % 4] >> np.uint64(SIDE) << np.uint64(SIDE)) | np.uint64(s << 2)
        own = np.ones(len(fp), bool) if taken is None else taken != s
        for b in range(BITS):
            key = mix((part & ~np.uint64(1 << b)) | np.uint64((BITS * s + b + 1) << 32))
            if base is not None:
                key = mix(key ^ mix(base))
            rows = np.flatnonzero(own if wanted is None else own & in_bitmap(wanted, key))
            yield key[rows], rows, (other | (((part >> np.uint64(b)) & np.uint64(1)) << np.uint64(1)) | np.uint64(b == 0))[rows]


def _index(deeper: bool, wanted: np.ndarray | None = None):
    """Rows of id, the fingerprint and perhaps the key of a group and its segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2_000):
                part = batch.slice(at, 2_000)
                ids, *longs = (c.to_numpy() for c in part.columns[:5])
                fp = np.stack(longs, axis=1).view(np.uint64)
                below = (part.column(5).to_numpy().view(np.uint64), part.column(6).to_numpy()) if deeper else (None, None)
                key, rows, bits = (np.concatenate(c) for c in zip(*variants(fp, *below, wanted)))
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(ids[rows]), pa.array(bits.view(np.int64))], names=["key", "id", "bits"])

    return run


PAIRS = "a bigint, b bigint, d int"


def _met(last: bool):
    """Pairs (a, b, d: differing bits) within groups of equal keys, b the smaller id; and rows of what a group leaves: (id, key, FURTHER), (id, key, DEEPER - segment). Rows come sorted by key."""

    def near(x: np.ndarray, y: np.ndarray, bits: np.ndarray) -> np.ndarray:
        """Differing bits, or 64 for pairs that meet elsewhere."""
        both = bits[x] ^ bits[y]
        once = ((both & np.uint64(2)) > 0) | ((bits[x] & np.uint64(1)) > 0)
        return np.where(once, np.bitwise_count(both >> np.uint64(SIDE)), 64).astype(np.int32)

    def rows_of(a: np.ndarray, b: np.ndarray, d: np.ndarray | int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.full(len(a), d, np.int32) if isinstance(d, int) else d.astype(np.int32))], names=["a", "b", "d"])

    def deeper(bits: np.ndarray) -> np.ndarray:
        return DEEPER - ((bits >> 2) & 15)

    def groups(key: np.ndarray, ids: np.ndarray, bits: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = np.lexsort((ids, key))
        key, ids, bits = key[order], ids[order], bits[order]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        size = np.repeat(np.diff(np.r_[first, len(key)]), np.diff(np.r_[first, len(key)]))
        over = (size > LIMIT) & (not last)
        if over.any():
            yield rows_of(ids[over], key[over], deeper(bits[over]))
        stay = (size > 1) & ~over
        key, ids, bits, size = key[stay], ids[stay], bits[stay].view(np.uint64), size[stay]
        found: list[tuple[np.ndarray, ...]] = []
        held = 0

        def squeeze() -> Iterator[pa.RecordBatch]:
            """The closest partners of each row stay."""
            x, y, d = (np.concatenate(c) for c in zip(*found))
            order = np.lexsort((y, d, x))
            x, y, d = x[order], y[order], d[order]
            first = np.flatnonzero(np.r_[True, x[1:] != x[:-1]])
            stay = np.arange(len(x)) - np.repeat(first, np.diff(np.r_[first, len(x)])) < CLOSE
            more = np.unique(x[~stay])
            if len(more):
                yield rows_of(ids[more], key[more], FURTHER)
            found[:] = [(x[stay], y[stay], d[stay])]

        def add(x: np.ndarray, y: np.ndarray) -> Iterator[pa.RecordBatch]:
            nonlocal held
            d = near(x, y, bits)
            ok = (d <= CHECK) & (ids[x] != ids[y])
            if ok.any():
                found.append((x[ok], y[ok], d[ok]))
                held += int(ok.sum())
                if held > 400_000:
                    yield from squeeze()
                    held = 0

        y = np.flatnonzero(size <= 256)
        small = key[y]
        for step in range(1, 256):
            at = np.arange(step, len(y)) if step == 1 else at[at >= step]
            at = at[small[at] == small[at - step]]
            if not len(at):
                break
            yield from add(y[at], y[at - step])
        big = np.flatnonzero(size > 256)
        k = key[big]
        starts = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.zeros(0, np.int64)
        for f, e in zip(starts, np.r_[starts[1:], len(k)]):
            f, e = int(big[f]), int(big[e - 1]) + 1
            if e - f > LIMIT:
                yield rows_of(ids[f:e], key[f:e], FURTHER)
            for a in range(f, e, 256):
                rows = np.arange(a, min(a + 256, e))
                end = min(int(rows[-1]) + 1, e if e - f <= LIMIT else f + LEADS)
                for to in range(f, end, 4096):
                    cols = np.arange(to, min(to + 4096, end))
                    x, y = np.nonzero(np.bitwise_count((bits[rows, None] ^ bits[None, cols]) >> np.uint64(SIDE)) <= CHECK)
                    x, y = rows[x], cols[y]
                    some = y < x
                    yield from add(x[some], y[some])
        if found:
            yield from squeeze()
            x, y, d = found[0]
            a, b = ids[x], ids[y]
            order = np.lexsort((b, a))
            a, b, d = a[order], b[order], d[order]
            new = np.ones(len(a), bool)
            new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
            yield rows_of(a[new], b[new], d[new])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple[np.ndarray, ...]] = []
        held, passing = 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = tuple(c.to_numpy() for c in batch.columns)
            if passing is not None:  # the rest of a group that is known to be too large
                n = int((cols[0] == passing).sum())
                if n:
                    yield rows_of(cols[1][:n], cols[0][:n], deeper(cols[2][:n]))
                    cols = tuple(c[n:] for c in cols)
                if not len(cols[0]):
                    continue
                passing = None
            kept.append(cols)
            held += len(cols[0])
            if held < 200_000:
                continue
            cols = tuple(np.concatenate(c) for c in zip(*kept))
            cut = int(np.searchsorted(cols[0], cols[0][-1]))
            if cut:
                yield from groups(*(c[:cut] for c in cols))
            kept = [tuple(c[cut:] for c in cols)]
            held = len(kept[0][0])
            if held > LIMIT and not last:
                passing = kept[0][0][0]
                yield rows_of(kept[0][1], kept[0][0], deeper(kept[0][2]))
                kept, held = [], 0
        if kept:
            yield from groups(*(np.concatenate(c) for c in zip(*kept)))

    return run


def links(own: DataFrame, texts: DataFrame, scratch: Scratch, width: int, t: Fraction) -> DataFrame:
    """Verified links (a, b) that join all sets that meet and are as similar as t; own: id, n and the fingerprint of each set."""

    def keyed(rows: DataFrame, deeper: bool, wanted: np.ndarray | None = None) -> DataFrame:
        return rows.mapInArrow(trimmed(_index(deeper, wanted)), KEYED).repartition("key")

    some = own.filter("n > 0").select("id", *PRINT)
    met = scratch.write(keyed(some, False).sortWithinPartitions("key").mapInArrow(trimmed(_met(False)), PAIRS))
    below = met.filter(F.col("d") <= DEEPER).select(F.col("a").alias("id"), F.col("b").alias("key"), (F.lit(DEEPER) - F.col("d")).alias("segment"))
    deep = None
    if not below.isEmpty():
        deep = scratch.write(some.join(below, "id").select("id", *PRINT, "key", "segment"))
        met = met.unionByName(scratch.write(keyed(deep, True).sortWithinPartitions("key").mapInArrow(trimmed(_met(True)), PAIRS)))
    sizes = own.select("id", "n")
    pairs = scratch.write(met.filter("d >= 0").groupBy("a", "b").agg(F.min("d").alias("d")))

    def tried(pairs: DataFrame) -> DataFrame:
        """The links among written pairs; only the sets of the pairs move."""
        sets = texts.select("text").mapInArrow(trimmed(set_rows(width, bitmap_of(pairs.select(F.explode(F.array("a", "b")).alias("id"))))), "id bigint, words array<bigint>")
        return verified(pairs.select("a", "b"), scratch.write(sets.groupBy("id").agg(F.first("words").alias("words"))), t)

    def apart(pairs: DataFrame, links: DataFrame) -> DataFrame:
        """The pairs that the links don't join, directly or by way of others."""
        roots = components(links, scratch)
        for c in "ab":
            pairs = pairs.join(roots.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}")), c, "left")
        return pairs.filter(F.coalesce("root_a", "a") != F.coalesce("root_b", "b"))

    # the closest partners first, and of the others those that these don't join
    likely = scratch.write(pairs.groupBy("a").agg(F.min(F.struct("d", "b")).alias("best")).select("a", F.col("best.b").alias("b")))
    sure = scratch.write(tried(likely))
    rest = scratch.write(apart(pairs.select("a", "b").join(likely, ["a", "b"], "left_anti"), sure))
    sure = scratch.write(sure.unionByName(tried(rest)))
    further = met.filter(F.col("d") == FURTHER).select(F.col("b").alias("id"))
    if further.isEmpty():
        return sure
    # texts with more partners than they took: all pairs of their groups that nothing joins yet
    wanted = bitmap_of(further)
    groups = keyed(some, False, wanted)
    if deep is not None:
        groups = groups.unionByName(keyed(deep, True, wanted))
    groups = groups.join(further.select(F.col("id").alias("key")).distinct(), "key", "left_semi")
    roots = components(sure, scratch).withColumnRenamed("node", "id")
    rooted = groups.join(roots, "id", "left").join(sizes, "id").select("key", "id", "bits", "n", F.coalesce("root", "id").alias("root"))
    mixed = rooted.groupBy("key").agg(F.min("root").alias("r"), F.max("root").alias("s")).filter("r < s").select("key")
    rooted = scratch.write(rooted.join(mixed, "key"))
    x, y = (rooted.select("key", *[F.col(c).alias(f"{c}_{o}") for c in ("id", "bits", "n", "root")]) for o in "ab")
    sized = F.least("n_a", "n_b") * t.denominator >= F.greatest("n_a", "n_b") * t.numerator
    close = F.bit_count(F.shiftrightunsigned(F.col("bits_a").bitwiseXOR(F.col("bits_b")), SIDE)) <= CHECK
    more = x.join(y, "key").filter((F.col("id_b") < F.col("id_a")) & (F.col("root_a") != F.col("root_b")) & sized & close).select(F.col("id_a").alias("a"), F.col("id_b").alias("b")).distinct()
    more = scratch.write(more.join(pairs.select("a", "b"), ["a", "b"], "left_anti"))
    return sure.unionByName(tried(more))


def first_of_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5, t: float = 0.8) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: the smallest doc_id of each group stays (among null ids and repeated rows, one), with its columns as they are."""
    ship(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "similar-texts")
    rank = F.struct(F.col("doc_id").isNull(), "doc_id", "h")
    texts = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.xxhash64(F.col(f"`{text}`")).alias("h"), F.col(f"`{text}`").alias("text"))
    kind = docs.schema[doc_id].dataType.simpleString()
    made = texts.mapInArrow(trimmed(_prints(width)), f"doc_id {kind}, h bigint, id bigint, n bigint, " + ", ".join(f"{c} bigint" for c in PRINT))
    own = scratch.write(made.groupBy("id").agg(F.min(rank).alias("least"), F.first("n").alias("n"), *[F.first(c).alias(c) for c in PRINT]))
    roots = components(links(own, texts, scratch, width, Fraction(t).limit_denominator(1000)), scratch)
    rooted = own.select("id", "least").join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    kept = settle(rooted.groupBy("root").agg(F.min("least").alias("k")).select("k.doc_id", "k.h"), "kept-documents", scratch)
    return first_rows(docs, kept, doc_id, text)
