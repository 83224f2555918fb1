"""Line dedup by an exact set-similarity join.

Lines are sets of words. Words are ordered by rarity over the whole corpus; two sets with a
Jaccard index of at least t share a word in their prefixes, the first n - ceil(t n) + 1 words of
each. Prefix words are the keys of the join; sizes, positions and a parity
signature (each word flips one bit, so differing bits bound differing words) drop most pairs inside a key's
group, and what is left is verified on the sets. A line goes if an earlier one, by
(doc_id, text, place), is that similar; lines are judged on the input, so removed ones count too.

A word that more than LIMIT lines may hold isn't a key by itself: it is one together
with each later word of a prefix longer by one, which similar lines share too. A key that still has more
than GROUP sets is refined by one more word in a further round, and a task stops sending a key's postings
at that number, so no group of postings grows without bound. In a large group a set takes its closest candidates
only, and more of them are written beside; a set that they don't settle takes all, in a round of its own. So no group's pairs are all written.

Sets are told apart by 64-bit hashes of their words: among s different sets about s * s / 2**65 pairs are taken
for equal, 0.0004 for a hundred million sets.

Defined results: a null text has no lines and stays null, an empty one has one line without words. Lines of fewer than
``min_words`` different words, and those without a word, stay. Texts and lines may be of any length. An empty table gives an empty one.
Rows equal in doc_id and text are one document and get one result. Null doc_ids come first.
Further columns stay as they are, whatever their names, and n_chars, where there is one, follows the text.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import arrow_udf

from basalt.llm.common import byte_batches, fresh, trimmed
from basalt.llm.words import mix, pack_texts, word_hashes
from basalt.plans.scratch import Scratch, settle
from basalt.plans.ship import ship

#: Places of the table of word frequencies; a word's frequency is taken as its place's, an upper bound.
PLACES = 1 << 17
#: Ranges of that table, each of which is summed in one task.
PARTS = 8
#: Most lines that may hold a word which is a key alone.
LIMIT = 20_000
#: Words of the corpus for each bucket of keys, by which their number is chosen.
BUCKET = 2_000_000
#: Postings that a task holds before it sends them.
POSTINGS = 200_000
#: Postings of one key that a task sends, and sets of a group that are compared; beyond either the key is refined by one more word.
GROUP = 32_768
#: Lines whose numbers fit into a sort key of 64 bits beside 44 bits of a word.
LINES = 1 << 20
#: Longest sets whose signature has 64 bits; those of longer ones have 128.
SHORT = 48
LONGS, INTS = pa.list_(pa.int64()), pa.list_(pa.int32())
NAMES = ["a", "b", "d", "doc_id", "h", "line", "id"]
#: Largest groups that are compared together with others.
MIDDLE = 256
#: Candidates that a set takes from a group, how many more are written beside, and how many it takes if the closest is doubtful.
CLOSE, BESIDE, DOUBTFUL = 3, 128, 512
#: Places of the table of sets that a task remembers.
SEEN = 1 << 19
#: Words of the bitmap of ids whose sets are needed for verification; it lets more ids pass where they are many.
BITMAP = 1 << 17
#: What a row of no pair is: the name of a key to refine, a set's candidates that are written beside, a set with the name of a key that has still more for it.
REFINE, ALSO, FURTHER = -1, -2, -3


def line_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each word: hash, line (numbered through); of each line with a word: its text's number and its place in it."""
    data, ends = pack_texts(texts)
    h, start, _ = word_hashes(data)
    marks = np.flatnonzero(np.frombuffer(data, np.uint8) == 10)
    line = np.searchsorted(marks, start)
    lines, at = np.unique(line, return_inverse=True)
    doc_of_mark = np.searchsorted(ends, marks)
    first_mark = np.searchsorted(marks, np.r_[0, ends[:-1] + 1])
    return h, at, doc_of_mark[lines], lines - first_mark[doc_of_mark[lines]]


def places(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(47)).astype(np.int64)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of a task's words, a row for each of PARTS ranges of places."""
    total = np.zeros(PLACES, np.int64)
    for batch in batches:
        for part in byte_batches(batch.column(0)):
            h, _, _ = word_hashes(pack_texts(part)[0])
            total += np.bincount(places(h), minlength=PLACES)
    yield _counted(np.arange(PARTS), total.reshape(PARTS, -1))


def _counted(part: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array([zstandard.compress(c.tobytes(), 1) for c in counts], pa.binary())], names=["part", "counts"])


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, x in zip(batch.column(0).to_pylist(), batch.column(1)):
            counts = np.frombuffer(zstandard.decompress(x.as_py()), np.int64)
            total[part] = total[part] + counts if part in total else counts
    if total:
        yield _counted(np.array(list(total)), np.array(list(total.values())))


def frequencies(docs: DataFrame, text: str) -> np.ndarray:
    """How often words of each place occur; PLACES numbers, whatever the corpus."""
    ddl = "part int, counts binary"
    total = np.zeros((PARTS, PLACES // PARTS), np.int64)
    for part, counts in docs.select(text).mapInArrow(_frequencies, ddl).repartitionById(PARTS, "part").mapInArrow(_summed, ddl).collect():
        total[part] = np.frombuffer(zstandard.decompress(bytes(counts)), np.int64)
    return total.reshape(-1)


def rarities(often: np.ndarray) -> np.ndarray:
    """Classes of frequencies, two for each power of two; 2**31 and more are one."""
    return np.minimum(63, np.log2(1.0 + often) * 2).astype(np.uint8)


def word_sets(texts: list[bytes], rarity: np.ndarray, min_words: int, signed: bool = True) -> tuple[np.ndarray, ...]:
    """Lines' sets, words in order of rarity: word hashes, start of each set, its size, its text's number and place, its id and signature (a row of two longs)."""
    h, line, doc, place = line_words(texts)
    rare, low = rarity[places(h)].astype(np.uint64), h & np.uint64((1 << 38) - 1)
    if len(doc) <= LINES:
        order = np.argsort((line.astype(np.uint64) << np.uint64(44)) | (rare << np.uint64(38)) | low)
    else:
        order = np.lexsort((low, rare, line))
    h, line = h[order], line[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (line[1:] != line[:-1])
    h, line = h[new], line[new]
    n = np.bincount(line, minlength=len(doc))
    ok = n >= min_words
    stay = ok[line]
    h, n, doc, place = h[stay], n[ok], doc[ok], place[ok]
    start = np.cumsum(n) - n
    if not len(n):
        return h, start, n, doc, place, np.zeros(0, np.uint64), np.zeros((0, 2), np.uint64)
    ids = mix(np.add.reduceat(mix(h + np.uint64(1)), start) + n.astype(np.uint64))
    return h, start, n, doc, place, ids, signatures(h, start, n) if signed else np.zeros((0, 2), np.uint64)


def signatures(h: np.ndarray, start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Parity signatures, a row of two longs for each set; short ones have one."""
    bit = mix(h)
    one = np.uint64(1) << (bit >> np.uint64(58))
    sig = np.zeros((len(n), 2), np.uint64)
    long = n > SHORT
    if not long.any():
        sig[:, 0] = np.bitwise_xor.reduceat(one, start)
        return sig
    word = np.where(np.repeat(long, n), bit & np.uint64(1), np.uint64(0))
    for j in range(2):
        sig[:, j] = np.bitwise_xor.reduceat(np.where(word == j, one, np.uint64(0)), start)
    return sig


def overlap(n: np.ndarray, m: np.ndarray, t: Fraction) -> np.ndarray:
    """Least number of common words of sets of n and m words."""
    a, b = t.numerator, t.numerator + t.denominator
    return -(-(a * (n + m)) // b)


def rounds_of(t: Fraction) -> int:
    """How often a key may be refined: sets that can be similar without being equal share as many words as the smallest of them has."""
    return max(0, -(-t.numerator // (t.denominator - t.numerator)) - 2) if t < 1 else 0


def key_name(key: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    """A key's name in bitmaps, from what its postings carry."""
    return mix(key.astype(np.uint64) | (bucket.astype(np.uint64) << np.uint64(32)))


def prefix_keys(h: np.ndarray, start: np.ndarray, n: np.ndarray, new: np.ndarray, hot: np.ndarray, t: Fraction, buckets: int, refined: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    """Key, bucket, owner and place of the first word of the postings of the new sets.

    The first common word of similar sets is in both prefixes, of n - ceil(t n) + 1 words; the second one in prefixes
    longer by one, and so on. A hot word is a key only with one more, a key that a bitmap of ``refined`` has only with one more again;
    with such bitmaps only what the last of them refines is sent.
    """
    # sets so small that one word more or less makes them unlike have only equal partners, which share their id
    new = new & (t.denominator * n >= t.numerator * (n + 1))
    prefix = np.where(new, n - (-(-(t.numerator * n) // t.denominator)) + 1, 0)

    def named(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return (key >> np.uint64(32)).astype(np.uint32), ((key & np.uint64(0xFFFFFFFF)) % np.uint64(buckets)).astype(np.int32)

    def longer(key: np.ndarray, own: np.ndarray, first: np.ndarray, last: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, ...]:
        more = np.maximum(np.minimum(prefix[own] + words, n[own]) - last - 1, 0)
        who = np.repeat(np.arange(len(key)), more)
        at = last[who] + np.arange(len(who)) - np.repeat(np.cumsum(more) - more, more) + 1
        return mix(key[who] * np.uint64(3) + mix(h[start[own[who]] + at])), own[who], first[who], at, words[who] + 1

    own = np.repeat(np.arange(len(n)), prefix)
    pos = np.arange(len(own)) - np.repeat(np.cumsum(prefix) - prefix, prefix)
    words = h[start[own] + pos]
    often = hot[places(words)]
    held = (mix(words), own, pos, pos, np.ones(len(own), np.int64))
    if often.any():
        held = tuple(np.concatenate(c) for c in zip((c[~often] for c in held), longer(*(c[often] for c in held))))
    for bitmap in refined:
        deeper = in_bitmap(bitmap, key_name(*named(held[0])))
        held = longer(*(c[deeper] for c in held))
    key, bucket = named(held[0])
    return key, bucket, held[1], held[2]


SENT = "bucket int, doc_id {id}, h bigint, line array<int>, id array<bigint>, held binary"


def _send(rarity: np.ndarray, hot: np.ndarray, t: Fraction, min_words: int, buckets: int, refined: list[np.ndarray] | None = None):
    """A row for each text with its lines and their sets' ids, and for each bucket of keys the postings of a batch of texts.

    A posting tells where its line comes, as far as numbers can: the least of a set's postings is that of its first line. With ``refined`` keys no lines are sent.
    A task that meets a key too often sends it for refinement, and no more of its postings.
    """
    partly = bool(refined)

    def ranks(ids: pa.Array) -> tuple[np.ndarray, int]:
        """Numbers in the order of the ids, equal where the order is open; and 1 if lines of equal ones are in the order of their places."""
        if pa.types.is_integer(ids.type):
            return ids.cast(pa.int64()).fill_null(np.iinfo(np.int64).min).to_numpy(), 1
        if pa.types.is_string(ids.type):
            return np.array([int.from_bytes((x or "").encode()[:7].ljust(7, b"\0")) - (x is None) for x in ids.to_pylist()], np.int64), 0
        return np.zeros(len(ids), np.int64), 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, doc_of, line_of = np.zeros(SEEN, np.uint64), np.full(SEEN, np.iinfo(np.int64).max), np.zeros(SEEN, np.int32)
        held: list[tuple[np.ndarray, ...]] = []
        size = 0
        met = np.zeros(1 << 16, np.int64)
        last = len(refined or ()) >= rounds_of(t)

        def row(bucket: np.ndarray, ids: np.ndarray | None, blobs: list[bytes] | None) -> pa.RecordBatch:
            k = len(bucket)
            own = pa.nulls(k, LONGS) if ids is None else pa.ListArray.from_arrays(pa.array(np.arange(k + 1, dtype=np.int32)), pa.array(ids.view(np.int64)))
            return pa.RecordBatch.from_arrays([pa.array(bucket), pa.nulls(k, kind), pa.nulls(k, pa.int64()), pa.nulls(k, INTS), own, pa.nulls(k, pa.binary()) if blobs is None else pa.array(blobs, pa.binary())], names=["bucket", "doc_id", "h", "line", "id", "held"])

        def flush() -> Iterator[pa.RecordBatch]:
            cols = [np.concatenate(c) for c in zip(*held)]
            held.clear()
            bucket = cols.pop(1)
            if not last:
                # a place's count is an upper bound of its keys'; keys that are refined without need lose nothing
                place = (key_name(cols[0], bucket) >> np.uint64(48)).astype(np.int64)
                np.add(met, np.bincount(place, minlength=len(met)), out=met)
                over = met[place] > GROUP
                if over.any():
                    key, first = np.unique(key_name(cols[0], bucket)[over], return_index=True)
                    yield row(bucket[over][first], key, None)
                    bucket, cols = bucket[~over], [c[~over] for c in cols]
                if not len(bucket):
                    return
            order = np.argsort(bucket, kind="stable")
            bucket, cols = bucket[order], [c[order] for c in cols]
            cut = np.r_[np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]), len(order)]
            yield row(bucket[cut[:-1]], None, [pack_blob(*[c[i:j] for c in cols]) for i, j in zip(cut[:-1], cut[1:])])

        kind = pa.null()
        for batch in batches:
            at, kind, (order_of, exact) = 0, batch.column(0).type, ranks(batch.column(0))
            for part in byte_batches(batch.column(2)):
                h, start, n, doc, place, ids, sig = word_sets(part, rarity, min_words)
                rank, turn, base = order_of[doc + at], (place * exact).astype(np.int32), at
                at += len(part)
                if not len(n):
                    continue
                if not partly:
                    first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
                    docs, cuts = pa.array(doc[first] + base), pa.array(np.r_[first, len(doc)].astype(np.int32))
                    lists = pa.ListArray.from_arrays(cuts, pa.array(place.astype(np.int32))), pa.ListArray.from_arrays(cuts, pa.array(ids.view(np.int64)))
                    yield pa.RecordBatch.from_arrays([pa.array((ids[first] % np.uint64(buckets)).astype(np.int32)), batch.column(0).take(docs), batch.column(1).take(docs), *lists, pa.nulls(len(first), pa.binary())], names=["bucket", "doc_id", "h", "line", "id", "held"])
                # a set that this task has met before, not later in the order, has its postings already
                slot = (ids >> np.uint64(32)).astype(np.int64) % SEEN
                new = (seen[slot] != ids) | (doc_of[slot] > rank) | ((doc_of[slot] == rank) & (line_of[slot] > turn))
                seen[slot[new]], doc_of[slot[new]], line_of[slot[new]] = ids[new], rank[new], turn[new]
                key, bucket, own, pos = prefix_keys(h, start, n, new, hot, t, buckets, refined or [])
                if not len(key):
                    continue
                held.append((key, bucket, ids[own], sig[own], n[own].astype(np.int32), pos.astype(np.int32), turn[own], rank[own]))
                size += len(key)
                if size > POSTINGS:
                    yield from flush()
                    size = 0
        if size:
            yield from flush()

    return run


def pack_blob(key: np.ndarray, ids: np.ndarray, sig: np.ndarray, n: np.ndarray, pos: np.ndarray, turn: np.ndarray, rank: np.ndarray) -> bytes:
    long = sig[n > SHORT, 1]
    return len(key).to_bytes(4, "little") + len(long).to_bytes(4, "little") + key.tobytes() + ids.tobytes() + sig[:, 0].tobytes() + long.tobytes() + zstandard.compress(n.tobytes() + pos.tobytes() + turn.tobytes() + rank.tobytes(), 1)


def unpack_blob(x: bytes) -> tuple[np.ndarray, ...]:
    m, w = int.from_bytes(x[:4], "little"), int.from_bytes(x[4:8], "little")
    small = zstandard.decompress(x[8 + 20 * m + 8 * w :])
    n = np.frombuffer(small, np.int32, m)
    sig = np.zeros((m, 2), np.uint64)
    sig[:, 0] = np.frombuffer(x, np.uint64, m, 8 + 12 * m)
    sig[n > SHORT, 1] = np.frombuffer(x, np.uint64, w, 8 + 20 * m)
    return np.frombuffer(x, np.uint32, m, 8), np.frombuffer(x, np.uint64, m, 8 + 4 * m), sig, n, np.frombuffer(small, np.int32, m, 4 * m), np.frombuffer(small, np.int32, m, 8 * m), np.frombuffer(small, np.int64, m, 12 * m)


def bits_of(ids: DataFrame) -> DataFrame:
    """The words of the bitmap of the longs in column id that aren't empty; BITMAP rows at most."""
    return ids.groupBy((F.col("id").bitwiseAND(F.lit(BITMAP - 1))).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, int(shiftrightunsigned(id, 58)))")).alias("bits"))


def flagged(df: DataFrame, column: str, ids: DataFrame, to: str) -> DataFrame:
    """``df`` with a column that tells whether the bitmap of the ids has its column's long, by a broadcast of the bitmap's words, of which there are BITMAP at most.

    No Python worker is needed, so it doesn't add one to a stage that has one.
    """
    return _flagged(df, column, bits_of(ids), to)


def having(df: DataFrame, column: str, bitmap: np.ndarray) -> DataFrame:
    """The rows whose column's long the bitmap has, by the same join."""
    at = np.flatnonzero(bitmap)
    held = df.sparkSession.createDataFrame(pa.table({"word": at.astype(np.int64), "bits": bitmap[at].view(np.int64)}))
    to = fresh("bitmap_has", df)
    return _flagged(df, column, held, to).filter(F.col(to)).drop(to)


def _flagged(df: DataFrame, column: str, held: DataFrame, to: str) -> DataFrame:
    word, bits = fresh("bitmap_word", df), fresh("bitmap_bits", df)
    held = F.broadcast(held.toDF(word, bits))
    joined = df.join(held, F.col(f"`{column}`").bitwiseAND(F.lit(BITMAP - 1)) == F.col(word), "left")
    turn = F.shiftrightunsigned(F.col(f"`{column}`"), 58).cast("int")
    has = F.coalesce(F.call_function("shiftrightunsigned", F.col(bits), turn).bitwiseAND(F.lit(1)) == 1, F.lit(False))
    return joined.withColumn(to, has).drop(word, bits)


def bitmap_of(ids: DataFrame) -> np.ndarray:
    """A bitmap of the longs in column id, always of BITMAP words; others may share their bits."""
    bits = bits_of(ids).toPandas()
    bitmap = np.zeros(BITMAP, np.uint64)
    bitmap[bits["word"].to_numpy()] = bits["bits"].to_numpy(np.int64).view(np.uint64)
    return bitmap


def in_bitmap(bitmap: np.ndarray, ids: np.ndarray) -> np.ndarray:
    return ((bitmap[(ids & np.uint64(BITMAP - 1)).astype(np.int64)] >> (ids >> np.uint64(58))) & np.uint64(1)).astype(bool)


def may_have(bitmap: np.ndarray):
    """A column function: whether the bitmap has a long."""

    def run(ids: pa.Array) -> pa.Array:
        return pa.array(in_bitmap(bitmap, ids.fill_null(0).to_numpy().view(np.uint64)))

    run.__annotations__ = {"ids": pa.Array, "return": pa.Array}
    return arrow_udf(run, "boolean")


def _sets(rarity: np.ndarray, min_words: int, bitmap: np.ndarray):
    """Sets of the lines whose id the bitmap has; a set may come from several tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out_ids, out_words = [], []
        seen: set[int] = set()
        for batch in batches:
            for part in byte_batches(batch.column(0)):
                h, start, n, _, _, ids, _ = word_sets(part, rarity, min_words, False)
                want = np.flatnonzero(in_bitmap(bitmap, ids))
                if len(want):
                    if len(seen) > SEEN:
                        seen.clear()
                    for i, x in zip(want.tolist(), ids[want].tolist()):
                        if x not in seen:
                            seen.add(x)
                            out_ids.append(ids[i : i + 1])
                            out_words.append(h[start[i] : start[i] + n[i]])
                if out_ids:
                    offsets = np.r_[0, np.cumsum([len(w) for w in out_words])].astype(np.int32)
                    flat = np.concatenate(out_words)
                    words = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(np.int64)))
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_ids).view(np.int64)), words], names=["id", "words"])
                    out_ids, out_words = [], []

    return run


def _groups(rarity: np.ndarray, hot: np.ndarray, t: Fraction, min_words: int, buckets: int, refined: list[np.ndarray], wanted: np.ndarray):
    """Key, id and words of the sets under the keys that the bitmap ``wanted`` has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_batches(batch.column(0)):
                h, start, n, _, _, ids, _ = word_sets(part, rarity, min_words, False)
                key, bucket, own, _ = prefix_keys(h, start, n, np.ones(len(n), bool), hot, t, buckets, refined)
                name = key_name(key, bucket)
                some = np.flatnonzero(in_bitmap(wanted, name))
                if len(some):
                    own = own[some]
                    offsets = np.r_[0, np.cumsum(n[own])].astype(np.int32)
                    flat = np.concatenate([h[a : a + m] for a, m in zip(start[own], n[own])])
                    yield pa.RecordBatch.from_arrays([pa.array(name[some].view(np.int64)), pa.array(ids[own].view(np.int64)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(np.int64)))], names=["key", "id", "words"])

    return run


def _meet(t: Fraction, last: bool = False):
    """Candidates (a, b that may come before it, d: differing signature bits) among the postings of each bucket; rows of lines and of keys to refine pass.

    Sets of a large group take the closest of the candidates that the hints don't put behind them, and a row tells if there are further ones.
    A group over GROUP is refined, unless its keys are the ``last``.
    """
    tables: list[np.ndarray] = []

    def least_of(total: np.ndarray) -> np.ndarray:
        """Least number of common words by the sum of two sizes."""
        most = int(total.max(initial=0)) + 1
        if not tables or len(tables[0]) < most:
            tables[:] = [overlap(np.arange(2 * most), 0, t)]
        return tables[0][total]

    def sift(x: np.ndarray, y: np.ndarray, sig: np.ndarray, n: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The pairs (x, y) that can be similar, their differing bits and the most that they may have."""
        a, b = n[x], n[y]
        least = least_of(a + b)
        gap = a + b - 2 * least
        d = np.bitwise_count(sig[x, 0] ^ sig[y, 0]).astype(np.int64)
        ok = (least <= np.minimum(a, b)) & (np.minimum(a - pos[x], b - pos[y]) >= least) & ((d <= gap) | (a > SHORT) | (b > SHORT))
        x, y, d, gap, both = x[ok], y[ok], d[ok], gap[ok], (a > SHORT)[ok]
        # signatures of different lengths are compared folded to one word
        other = (b > SHORT)[ok]
        wide = np.flatnonzero(both | other)
        if len(wide):
            p, q = sig[x[wide]], sig[y[wide]]
            same = (both & other)[wide]
            d[wide] = np.where(same, np.bitwise_count(p ^ q).sum(axis=1), np.bitwise_count(np.bitwise_xor.reduce(p, axis=1) ^ np.bitwise_xor.reduce(q, axis=1)))
            ok = d <= gap
            x, y, d, gap = x[ok], y[ok], d[ok], gap[ok]
        return x, y, d, gap

    def ranked(one: np.ndarray, two: np.ndarray, d: np.ndarray, gap: np.ndarray) -> tuple[tuple[np.ndarray, ...], np.ndarray, np.ndarray]:
        """The rows by ``one``, the closest first; their ranks; whether the closest of each is doubtful."""
        order = np.lexsort((two, d, one))
        one, two, d, gap = one[order], two[order], d[order], gap[order]
        first = np.flatnonzero(np.r_[True, one[1:] != one[:-1]]) if len(one) else np.zeros(0, np.int64)
        sizes = np.diff(np.r_[first, len(one)])
        rank = np.arange(len(one)) - np.repeat(first, sizes)
        return (one, two, d, gap), rank, np.repeat(2 * d[first] > gap[first], sizes)

    class Found:
        """Pairs so far, of which each set keeps the closest; and the sets that have further ones."""

        def __init__(self, hint: np.ndarray):
            self.hint, self.parts, self.more, self.held, self.most = hint, [], [np.zeros(0, np.int64)], 0, 400_000

        def add(self, x: np.ndarray, y: np.ndarray, d: np.ndarray, gap: np.ndarray, both: bool) -> None:
            for one, two in ((x, y), (y, x)) if both else ((x, y),):
                behind = self.hint[two] <= self.hint[one]
                self.parts.append((one[behind], two[behind], d[behind], gap[behind]))
                self.held += len(self.parts[-1][0])
            if self.held > self.most:
                self.squeeze()
                self.most = max(400_000, 2 * self.held)

        def squeeze(self) -> tuple[tuple[np.ndarray, ...], np.ndarray]:
            """What is kept, and which of it is taken."""
            empty = np.zeros(0, np.int64)
            cols, rank, doubt = ranked(*(np.concatenate(c) for c in zip(*self.parts)) if self.parts else (empty,) * 4)
            stay = rank < np.where(doubt, DOUBTFUL, CLOSE + BESIDE)
            self.more.append(np.unique(cols[0][~stay]))
            cols = tuple(c[stay] for c in cols)
            self.parts, self.held = [cols], len(cols[0])
            return cols, (doubt | (rank < CLOSE))[stay]

        def result(self) -> tuple[np.ndarray, ...]:
            """Candidates taken, those beside, and the sets that have still more."""
            (one, two, d, _), taken = self.squeeze()
            return one[taken], two[taken], d[taken], one[~taken], two[~taken], np.unique(np.concatenate(self.more))

    def middle(at: np.ndarray, key: np.ndarray, sig: np.ndarray, n: np.ndarray, pos: np.ndarray, hint: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
        """Candidates within all groups of some size, each set with the one after it, then with the next, as far as sizes allow."""
        found = Found(hint)
        key, sizes = key[at], n[at]
        top = np.where(sizes > SHORT, np.bitwise_xor.reduce(sig[at], axis=1), sig[at, 0])
        most = 2 * sizes * t.denominator // t.numerator  # of the two sizes together, as far as they may be alike
        most = (most - 2 * overlap(most, 0, t) + 2).astype(np.int64)
        x = np.arange(len(at))
        for step in range(1, int(size[at].max(initial=1))):
            x = x[: np.searchsorted(x, len(at) - step)]
            y = x + step
            go = (key[y] == key[x]) & (t.numerator * sizes[y] <= t.denominator * sizes[x])
            x = x[go]
            if not len(x):
                break
            y = x + step
            some = np.bitwise_count(top[x] ^ top[y]) <= most[x]
            found.add(*sift(at[x[some]], at[y[some]], sig, n, pos), True)
        return found.result()

    def large(f: int, e: int, sig: np.ndarray, n: np.ndarray, pos: np.ndarray, hint: np.ndarray) -> tuple[np.ndarray, ...]:
        """Candidates among the sets f to e, in order of size."""
        found = Found(hint)
        top = np.where(n[f:e] > SHORT, np.bitwise_xor.reduce(sig[f:e], axis=1), sig[f:e, 0])

        def near(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, ...]:
            total = int(n[a].max() + n[b].max())
            most = total - 2 * int(overlap(np.int64(total), 0, t)) + 1
            x, y = np.nonzero(np.bitwise_count(top[a - f, None] ^ top[None, b - f]) <= most)
            x, y = a[x], b[y]
            apart = x != y
            return x[apart], y[apart]

        act = np.arange(f, e)
        if last and e - f > GROUP:
            # most of a group without end are copies of a pattern: the sets that come first are tried by all, and the rest only by those that they leave open
            lead = np.sort(f + np.argsort(hint[f:e], kind="stable")[:256])
            for at in range(0, len(act), 4096):
                found.add(*sift(*near(act[at : at + 4096], lead), sig, n, pos), False)
            (one, _, d, gap), _ = found.squeeze()
            sure = np.unique(one[2 * d <= gap])
            found.more.append(sure)
            act = np.setdiff1d(act, sure, assume_unique=True)
        if len(act) == e - f:
            for at in range(f, e, 512):
                a = np.arange(at, min(at + 512, e))
                for to in range(at, e, 2048):
                    if t.numerator * int(n[to]) > t.denominator * int(n[a[-1]]):
                        break  # sizes ascend
                    x, y = near(a, np.arange(to, min(to + 2048, e)))
                    found.add(*sift(x[x < y], y[x < y], sig, n, pos), True)
        else:
            for at in range(0, len(act), 512):
                a = act[at : at + 512]
                low, high = np.searchsorted(n[f:e], [-(-int(n[a[0]]) * t.numerator // t.denominator), int(n[a[-1]]) * t.denominator // t.numerator + 1])
                for to in range(f + int(low), f + int(high), 2048):
                    found.add(*sift(*near(a, np.arange(to, min(to + 2048, f + int(high)))), sig, n, pos), False)
        return found.result()

    def settle(bucket: int, held: list[bytes]) -> Iterator[pa.RecordBatch]:
        key, ids, sig, n, pos, turn, rank = (np.concatenate(c) for c in zip(*map(unpack_blob, held)))
        order = np.lexsort((turn, rank))
        ahead = (rank[order[1:]] != rank[order[:-1]]) | (turn[order[1:]] != turn[order[:-1]])
        hint = np.empty(len(key), np.int64)
        hint[order] = np.cumsum(np.r_[0, ahead])
        order = np.lexsort((hint, ids, (key.astype(np.uint64) << np.uint64(32)) | n.astype(np.uint64)))
        key, ids, sig, n, pos, hint = key[order], ids[order], sig[order], n[order].astype(np.int64), pos[order].astype(np.int64), hint[order]
        once = np.r_[True, (ids[1:] != ids[:-1]) | (key[1:] != key[:-1])]
        first = np.flatnonzero(np.r_[True, key[once][1:] != key[once][:-1]])
        sizes = np.diff(np.r_[first, int(once.sum())])
        many = np.repeat(sizes > 1, sizes)
        key, ids, sig, n, pos, hint, size = (c[once][many] for c in (key, ids, sig, n, pos, hint, np.repeat(sizes, sizes)[np.cumsum(once) - 1]))
        name = key_name(key, np.full(len(key), bucket))
        if not last and (size > GROUP).any():
            deeper = size > GROUP
            yield rows_of(np.unique(name[deeper]), None, REFINE)
            key, ids, sig, n, pos, hint, size, name = (c[~deeper] for c in (key, ids, sig, n, pos, hint, size, name))
        one, two, gap = [], [], []

        def tell(x: np.ndarray, y: np.ndarray, d: np.ndarray, also: np.ndarray, beside: np.ndarray, more: np.ndarray) -> Iterator[pa.RecordBatch]:
            one.append(x)
            two.append(y)
            gap.append(d)
            if len(also):
                first = np.flatnonzero(np.r_[True, also[1:] != also[:-1]])
                lists = pa.ListArray.from_arrays(pa.array(np.r_[first, len(also)].astype(np.int32)), pa.array(ids[beside].view(np.int64)))
                yield rows_of(ids[also[first]], None, ALSO, lists)
            if len(more):
                yield rows_of(ids[more], name[more], FURTHER)

        yield from tell(*middle(np.flatnonzero(size <= MIDDLE), key, sig, n, pos, hint, size))
        big = np.flatnonzero(size > MIDDLE)
        k = key[big]
        starts = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.zeros(0, np.int64)
        for f, e in zip(starts, np.r_[starts[1:], len(k)]):
            yield from tell(*large(int(big[f]), int(big[e - 1]) + 1, sig, n, pos, hint))
        x, y, d = np.concatenate(one), np.concatenate(two), np.concatenate(gap)
        a, b = ids[x].view(np.int64), ids[y].view(np.int64)
        order = np.lexsort((b, a))
        a, b, d = a[order], b[order], d[order]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        yield rows_of(a[new], b[new], d[new])

    def rows_of(a: np.ndarray, b: np.ndarray | None, d: np.ndarray | int, beside: pa.Array | None = None) -> pa.RecordBatch:
        k = len(a)
        d = np.full(k, d) if isinstance(d, int) else d
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.nulls(k, pa.int64()) if b is None else pa.array(b.view(np.int64)), pa.array(d.astype(np.int32)), pa.nulls(k, kind[0]), pa.nulls(k, pa.int64()), pa.nulls(k, INTS), pa.nulls(k, LONGS) if beside is None else beside], names=NAMES)

    kind: list[pa.DataType] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        now = None
        for batch in batches:
            kind[:] = [batch.column(1).type]
            passing = batch.filter(batch.column(5).is_null())
            lines, keys = passing.filter(passing.column(3).is_valid()), passing.filter(passing.column(3).is_null())
            if lines.num_rows:
                k = lines.num_rows
                yield pa.RecordBatch.from_arrays([pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int32()), *[lines.column(j) for j in (1, 2, 3, 4)]], names=NAMES)
            if keys.num_rows:
                yield rows_of(keys.column(4).flatten().to_numpy().view(np.uint64), None, REFINE)
            sent = batch.filter(batch.column(5).is_valid())
            for bucket, x in zip(sent.column(0).to_pylist(), sent.column(5).to_pylist()):
                if bucket != now and held:
                    yield from settle(now, held)
                    held = []
                now = bucket
                held.append(x)
        if held:
            yield from settle(now, held)

    return run


def similar_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", t: float = 0.8, min_words: int = 1) -> DataFrame:
    """One row for each different (doc_id, text) with a removed line: doc_id, h (hash of the text), removed (places of lines, from 0)."""
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark, "lines")
    exact = Fraction(t).limit_denominator(1000)
    if exact <= Fraction(1, 2):
        raise ValueError("two shared words are only certain for t over 0.5")
    min_words = max(min_words, 1)
    own = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")).filter("text is not null")
    often = frequencies(own, "text")
    rarity, hot = rarities(often), often > LIMIT
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(often.sum()) // BUCKET))
    kind = docs.schema[doc_id].dataType.simpleString()
    hashed = own.select("doc_id", F.xxhash64("text").alias("h"), "text")

    def met(last: bool, refined: list[np.ndarray]) -> DataFrame:
        sent = hashed.mapInArrow(trimmed(_send(rarity, hot, exact, min_words, buckets, refined)), SENT.format(id=kind))
        return scratch.write(sent.repartitionById(buckets, F.col("bucket")).mapInArrow(trimmed(_meet(exact, last)), f"a bigint, b bigint, d int, doc_id {kind}, h bigint, line array<int>, id array<bigint>"))

    rounds = rounds_of(exact)
    turns = [met(rounds == 0, [])]
    found = turns[0].filter("line is not null").select("doc_id", "h", F.inline(F.arrays_zip("line", "id")))
    refined: list[np.ndarray] = []
    while len(refined) < rounds:
        deeper = turns[-1].filter(F.col("d") == REFINE)
        if deeper.isEmpty():
            break
        refined.append(bitmap_of(deeper.select(F.col("a").alias("id"))))
        turns.append(met(len(refined) == rounds, list(refined)))
    line = F.struct("doc_id", "h", "line")
    first = scratch.write(found.groupBy("id").agg(F.min(line).alias("first"), F.count("*").alias("n")))

    def settled(pairs: DataFrame, beside: DataFrame) -> DataFrame:
        """Ids of the sets a with an earlier similar one among the candidates (a, b, d) or, where those fail, those beside (a, id); whether b is earlier is seen when it is verified.

        Of two similar sets the one that comes first as a line stands, and a set's lines after its first go anyway, so a set needs one earlier partner.
        """
        needed = bitmap_of(pairs.select(F.explode(F.array("a", "b")).alias("id")).unionByName(beside.select(F.explode("id").alias("id"))))
        known = having(first, "id", needed).select("id", "first")
        sets = own.select("text").mapInArrow(trimmed(_sets(rarity, min_words, needed)), "id bigint, words array<bigint>")
        sets = scratch.write(sets.groupBy("id").agg(F.first("words").alias("words")).join(known, "id"))
        # the likeliest partner is verified first, and the others for those sets only that it doesn't settle
        likely = scratch.write(pairs.groupBy("a").agg(F.min(F.struct("d", "b")).alias("best")).select("a", F.col("best.b").alias("b")))
        sure = scratch.write(_verified(likely, sets, exact))
        unsure = may_have(bitmap_of(likely.join(sure, "a", "left_anti").select(F.col("a").alias("id"))))
        rest = pairs.filter(unsure(F.col("a"))).select("a", "b").unionByName(beside.filter(unsure(F.col("a"))).select("a", F.explode("id").alias("b")))
        rest = scratch.write(rest.distinct().join(sure, "a", "left_anti").join(likely, ["a", "b"], "left_anti"))
        return scratch.write(sure.unionByName(_verified(rest, sets, exact)).distinct().select(F.col("a").alias("id")))

    def exhausted(open_: DataFrame) -> DataFrame:
        """The same of sets (id, key) among all sets under those keys; the words come with the keys."""
        keys = bitmap_of(open_.select(F.col("key").alias("id")))
        parts = [own.select("text").mapInArrow(_groups(rarity, hot, exact, min_words, buckets, refined[:k], keys), "key bigint, id bigint, words array<bigint>") for k in range(len(turns))]
        groups = scratch.write(reduce(DataFrame.unionByName, parts).groupBy("key", "id").agg(F.first("words").alias("words")))
        dated = groups.join(first.select("id", "first"), "id")
        x, y = (dated.select("key", *[F.col(c).alias(f"{c}_{o}") for c in ("id", "first", "words")]) for o in "ab")
        both = open_.withColumnRenamed("id", "id_a").join(x, ["key", "id_a"]).join(y, "key").filter("first_b < first_a")
        return both.filter(_alike("words_a", "words_b", exact)).select(F.col("id_a").alias("id")).distinct()

    pairs = reduce(DataFrame.unionByName, (x.filter("d >= 0").select("a", "b", "d") for x in turns))
    similar = settled(pairs, reduce(DataFrame.unionByName, (x.filter(F.col("d") == ALSO).select("a", "id") for x in turns)))
    # sets that none of these settled, though there were still more
    further = reduce(DataFrame.unionByName, (x.filter(F.col("d") == FURTHER).select(F.col("a").alias("id"), F.col("b").alias("key")) for x in turns))
    open_ = scratch.write(further.join(similar, "id", "left_anti").distinct())
    if not open_.isEmpty():
        similar = similar.unionByName(exhausted(open_))
    similar = scratch.write(similar.withColumn("similar", F.lit(True)))
    near = may_have(bitmap_of(similar.select("id")))
    hit = first.filter((F.col("n") > 1) | near(F.col("id"))).join(similar, "id", "left").filter((F.col("n") > 1) | F.col("similar")).drop("n")
    hit = scratch.write(hit)
    losing = may_have(bitmap_of(hit.select("id")))
    gone = found.filter(losing(F.col("id"))).join(hit, "id").filter((F.col("first") < line) | F.col("similar"))
    return settle(gone.groupBy("doc_id", "h").agg(F.sort_array(F.collect_set("line")).alias("removed")), "removed-lines", scratch)


def _verified(pairs: DataFrame, sets: DataFrame, t: Fraction) -> DataFrame:
    """The a of written pairs whose b is earlier and as similar as t; only the sets of the pairs move."""
    own = sets.filter(may_have(bitmap_of(pairs.select(F.explode(F.array("a", "b")).alias("id"))))(F.col("id")))
    x, y = (own.select(F.col("id").alias(c), F.col("first").alias(f"first_{c}"), F.col("words").alias(f"words_{c}")) for c in "ab")
    both = pairs.join(x, "a").join(y, "b").filter("first_b < first_a")
    return both.filter(_alike("words_a", "words_b", t)).select("a").distinct()


def _alike(x: str, y: str, t: Fraction) -> Column:
    common = F.size(F.array_intersect(x, y))
    return common * t.denominator >= t.numerator * (F.size(x) + F.size(y) - common)


def without(texts: pa.Array, removed: pa.Array) -> pa.Array:
    """The texts without the lines of the given places."""
    out = []
    for x, gone in zip(texts, removed):
        x, gone = x.as_py(), gone.as_py()
        if x is not None and gone:
            drop = set(gone)
            x = "\n".join(y for i, y in enumerate(x.split("\n")) if i not in drop)
        out.append(x)
    return pa.array(out, pa.string())


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", t: float = 0.8, min_words: int = 1) -> DataFrame:
    """The rows of ``docs`` with the removed lines taken out of the text."""
    names = [fresh(n, docs) for n in ("line_id", "line_hash", "line_removed")]
    gone = similar_lines(docs, doc_id, text, t, min_words)
    # texts that surely lose nothing needn't meet the removed lines
    lose = gone.select(F.col("h").alias("id"))
    gone = gone.toDF(*names)
    held = fresh("line_own", docs)
    same = F.col(f"`{doc_id}`").eqNullSafe(F.col(names[0])) & (F.col(held) == F.col(names[1]))
    hashed = docs.withColumn(held, F.xxhash64(F.col(f"`{text}`")))
    near = fresh("line_near", docs)
    marked = flagged(hashed, held, lose, near).withColumn(near, F.col(near) & F.col(f"`{text}`").isNotNull())
    both = marked.filter(F.col(near)).drop(near).join(gone, same, "left")
    new = F.when(F.col(names[2]).isNull(), F.col(f"`{text}`")).otherwise(arrow_udf(without, "string")(F.col(f"`{text}`"), F.col(names[2])))
    out = both.withColumn(held, new)
    cols = [F.col(held).alias(c) if c == text else F.when(F.col(names[2]).isNull(), F.col("`n_chars`")).otherwise(F.length(held)).cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns]
    return out.select(*cols).unionByName(marked.filter(~F.col(near)).select(*[F.col(f"`{c}`") for c in docs.columns]))
