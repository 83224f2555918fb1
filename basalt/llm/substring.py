"""Removal of passages that documents with smaller ids hold too, by recompression.

Words are named by hashes; then each round names maximal runs of one symbol, deals the
symbols to two sides by a bit of their names, and names each pair of a left and a right
neighbour. Names come from what they name, so they agree among all documents without a
table of names, and equal substrings get the same symbols but for their rims. After some
rounds a symbol stands for dozens of words: one that a document with a smaller id has too reveals a
long repeat, and all windows inside it are settled together.

What is left, the rims of long repeats and repeats of few words, is settled window by
window: ``width`` consecutive words, named in rounds too, by names of pairs, of pairs of pairs, and so
on. A document's windows are only left out where a smaller one has them, so the
smallest document with a window always shows it.

Either way names are dealt to buckets, one sort in a bucket shows which also start in a document
with a smaller id, and their places go back to the documents. A name travels once
for a batch of texts where several of its documents hold it: the smallest one's places go to the bucket,
the others are settled by it. So a passage in a third of all documents reaches its bucket once a batch.
Two different windows share a 64-bit name with a probability of 2**-64; among w different windows about w * w / 2**65 pairs do, one for 6e9 windows (30 GB of text), so
more than that asks for names of more bits.

Defined results: a null text has no words. Rows equal in doc_id and text are one document, so one
doesn't remove words of the other; neither do different texts of one doc_id. A null doc_id is smaller than any other,
and not than itself; ids that aren't integers are refused. Texts may be of any length. Further columns are left out. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import arrow_udf

from basalt.llm.words import mix, pack_texts, word_hashes
from basalt.plans.ship import ship

#: Bytes of text whose names are held at once.
BATCH = 8 << 20
#: Bytes of text for each bucket, by which their number is chosen.
BUCKET = 16 << 20
_NULL = np.iinfo(np.int64).min
#: Rounds of recompression after which symbols are compared; they stand for about 30, 100 and 300 words then.
ROUNDS = (12, 16, 20)


def window_names(words: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit name of each ``width`` consecutive words, from names of pairs, of pairs of pairs, and so on."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    name, span = words, 1
    while 2 * span <= width:
        name = mix(name[: len(name) - span] * np.uint64(0x9E3779B97F4A7C15) + name[span:] + np.uint64(span))
        span *= 2
    if span < width:
        name = mix(name[:n] * np.uint64(0xC2B2AE3D27D4EB4F) + name[width - span : width - span + n] + np.uint64(width))
    return name


def recompress(name: np.ndarray, start: np.ndarray, doc: np.ndarray, rounds: tuple[int, ...] = ROUNDS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(name, first word, number of words, document) of the symbols after each of the given rounds; words come with their place and document."""
    size = np.ones(len(name), np.int64)
    for r in range(1, max(rounds) + 1):
        inside = doc[1:] == doc[:-1]
        same = inside & (name[1:] == name[:-1])
        if same.any():
            head = np.flatnonzero(np.r_[True, ~same])
            count = np.diff(np.r_[head, len(name)])
            size = np.add.reduceat(size, head)
            name, start, doc = name[head], start[head], doc[head]
            name = np.where(count > 1, mix(name * np.uint64(0x94D049BB133111EB) + count.astype(np.uint64)), name)
            inside = doc[1:] == doc[:-1]
        left = (mix(name + np.uint64(r)) & np.uint64(1)).astype(bool)
        pair = np.flatnonzero(left[:-1] & ~left[1:] & inside)
        named = name.copy()
        named[pair] = mix(mix(name[pair]) * np.uint64(0x9E3779B97F4A7C15) + name[pair + 1])
        size[pair] += size[pair + 1]
        stay = np.ones(len(name), bool)
        stay[pair + 1] = False
        name, start, size, doc = named[stay], start[stay], size[stay], doc[stay]
        if r in rounds:
            yield name, start, size, doc


def _zip(*arrays: np.ndarray) -> bytes:
    return zstandard.compress(b"".join(a.tobytes() for a in arrays), 1)


def _blob(doc: np.ndarray, tag: np.ndarray, count: np.ndarray, place: np.ndarray, first: np.ndarray, windows: np.ndarray) -> bytes:
    """Documents, how many places each has, the places, as differences from the one before in a document, and how many windows begin there in a row."""
    step = np.diff(place, prepend=0)
    step[first] = place[first]
    return np.array([len(doc), len(place)], "<i8").tobytes() + _zip(np.diff(doc, prepend=0), tag, count.astype("<i4"), step.astype("<i4"), windows.astype("<i4"))


def _unblob(data: bytes) -> tuple[np.ndarray, ...]:
    docs, places = np.frombuffer(data[:16], "<i8")
    raw = zstandard.decompress(data[16:])
    a, b, c, e = 8 * docs, 12 * docs, 16 * docs, 16 * docs + 4 * places
    doc, tag, count, step = np.cumsum(np.frombuffer(raw[:a], "<i8")), np.frombuffer(raw[a:b], "<i4"), np.frombuffer(raw[b:c], "<i4"), np.frombuffer(raw[c:e], "<i4")
    total = np.cumsum(step.astype(np.int64))
    first = np.cumsum(count) - count
    base = np.repeat(np.where(first > 0, total[np.maximum(first - 1, 0)], 0), count)
    return doc, tag, count, total - base, np.frombuffer(raw[e:], "<i4")


def _runs(key: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)


def _grouped(doc: np.ndarray, tag: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of rows by document and place, and where documents begin."""
    order = np.lexsort((place, tag, doc))
    d, t = doc[order], tag[order]
    return order, np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | (t[1:] != t[:-1])]) if len(d) else np.zeros(0, np.int64), place[order]


def _smaller(name: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(in order of name, whether the row's name also starts in a smaller document; that order)."""
    order = np.argsort(name)
    first = _runs(name[order])
    least = np.repeat(np.minimum.reduceat(doc[order], first), np.diff(np.r_[first, len(name)]))
    return doc[order] > least, order


def tag_of(text: bytes) -> int:
    """Tells texts of one doc_id apart."""
    return int(np.uint32(xxhash.xxh32_intdigest(text)).view(np.int32))


SENT = "bucket int, doc bigint, tag int, names binary, held binary"


def _symbols(h: np.ndarray, begin: np.ndarray, n_words: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """Name, text, first window and number of windows of the symbols that hold several windows."""
    doc = np.repeat(np.arange(len(n_words)), n_words)
    place = np.arange(len(h)) - np.repeat(begin, n_words)
    found = [(name[long], d[long], start[long], size[long] - width + 1) for name, start, size, d in recompress(h, place, doc) for long in [size >= 2 * width]]
    name, d, start, windows = (np.concatenate(c) for c in zip(*found))
    order = np.lexsort((start, d))
    return name[order], d[order], start[order], windows[order]


def _windows(h: np.ndarray, begin: np.ndarray, n_words: np.ndarray, width: int, settled: list) -> tuple[np.ndarray, ...]:
    """The same of each window that isn't settled."""
    n = np.maximum(n_words - width + 1, 0)
    index = np.repeat(np.arange(len(n)), n)
    first = np.cumsum(n) - n
    place = np.arange(len(index)) - np.repeat(first, n)
    if len(index) and any(settled):
        step = np.zeros(len(index) + 1, np.int64)
        for k, answers in enumerate(settled):
            for x in answers or ():
                at, windows = spans(x)
                np.add.at(step, first[k] + at, 1)
                np.subtract.at(step, first[k] + at + windows, 1)
        open_ = np.cumsum(step[:-1]) == 0
        index, place = index[open_], place[open_]
    name = window_names(h, width)[begin[index] + place] if len(index) else np.zeros(0, np.uint64)
    return name, index, place, np.ones(len(index), np.int64)


def _send(width: int, buckets: int, symbols: bool):
    """For each bucket the names and places of a batch of texts; also places that the batch itself settles, by document and without names."""

    def settle(texts: list[bytes], ids: list[int], settled: list) -> Iterator[pa.RecordBatch]:
        data, ends = pack_texts(texts)
        h, start, _ = word_hashes(data)
        begin = np.searchsorted(start, np.r_[0, ends[:-1] + 1])
        n_words = np.diff(np.r_[begin, len(h)])
        name, index, place, windows = _symbols(h, begin, n_words, width) if symbols else _windows(h, begin, n_words, width, settled)
        if not len(name):
            return
        doc_ids, tags = np.array(ids, np.int64), np.array([tag_of(t) for t in texts], np.int32)
        gone, order = _smaller(name, doc_ids[index])
        own = np.sort(order[gone])
        if len(own):
            yield answer(doc_ids[index[own]], tags[index[own]], place[own], windows[own], buckets)
        left = np.ones(len(name), bool)
        left[own] = False
        at = np.flatnonzero(left)
        bucket = ((name[at] >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32)
        at = at[np.argsort(bucket, kind="stable")]
        bucket = np.sort(bucket)
        cuts = np.r_[_runs(bucket), len(bucket)]
        rows = []
        rank = np.empty(len(texts), np.int64)
        rank[np.argsort(doc_ids, kind="stable")] = np.arange(len(texts))
        for a, b in zip(cuts[:-1], cuts[1:]):
            part = at[a:b]
            part = part[np.argsort(rank[index[part]], kind="stable")]
            who = index[part]
            first = _runs(who)
            docs = who[first]
            rows.append((int(bucket[a]), name[part].tobytes(), _blob(doc_ids[docs], tags[docs], np.diff(np.r_[first, len(part)]), place[part], first, windows[part])))
        none = pa.nulls(len(rows), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), none, none.cast(pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], names=["bucket", "doc", "tag", "names", "held"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of id, text (zipped) and, for windows, settled spans."""
        texts, ids, settled, size = [], [], [], 0
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                part = batch.slice(k, 64)
                spans_ = [None] * part.num_rows if symbols else part.column(2).to_pylist()
                for i, x, a in zip(part.column(0).to_pylist(), part.column(1).cast(pa.binary()).to_pylist(), spans_):
                    texts.append(x or b"" if symbols else zstandard.decompress(x))
                    ids.append(_NULL if i is None else i)
                    settled.append(a)
                    size += len(texts[-1])
                    if size > BATCH:
                        yield from settle(texts, ids, settled)
                        texts, ids, settled, size = [], [], [], 0
        if texts:
            yield from settle(texts, ids, settled)

    return run


def answer(doc: np.ndarray, tag: np.ndarray, place: np.ndarray, windows: np.ndarray, buckets: int = 1) -> pa.RecordBatch:
    """A row for each document with its places and how many windows each stands for."""
    order, first, place = _grouped(doc, tag, place)
    windows = windows[order].astype("<i4")
    cuts = np.r_[first, len(place)]
    held = [np.diff(place[a:b], prepend=0).astype("<i4").tobytes() + windows[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])]
    n = len(held)
    return pa.RecordBatch.from_arrays([pa.array((np.arange(n) % buckets).astype(np.int32)), pa.array(doc[order][first]), pa.array(tag[order][first]), pa.nulls(n, pa.binary()), pa.array(held, pa.binary())], names=["bucket", "doc", "tag", "names", "held"])


def spans(x: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Places and numbers of windows of an answer."""
    both = np.frombuffer(x, "<i4")
    half = len(both) // 2
    return np.cumsum(both[:half], dtype=np.int64), both[half:].astype(np.int64)


def _settle_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come bucket by bucket; a bucket's names are held together, and what is settled passes."""
    names: list[bytes] = []
    held: list[bytes] = []
    now = None

    def settle() -> Iterator[pa.RecordBatch]:
        parts = [_unblob(x) for x in held]
        doc = np.concatenate([np.repeat(p[0], p[2]) for p in parts])
        name = np.frombuffer(b"".join(names), np.uint64)
        gone, order = _smaller(name, doc)
        hit = order[gone]
        if len(hit):
            tag = np.concatenate([np.repeat(p[1], p[2]) for p in parts])
            place, windows = np.concatenate([p[3] for p in parts]), np.concatenate([p[4] for p in parts])
            yield answer(doc[hit], tag[hit], place[hit], windows[hit])

    for batch in batches:
        passing = batch.filter(batch.column(3).is_null())
        if passing.num_rows:
            yield passing
        batch = batch.filter(batch.column(3).is_valid())
        for bucket, n, x in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_pylist()):
            if bucket != now and names:
                yield from settle()
                names, held = [], []
            now = bucket
            names.append(n)
            held.append(x)
    if names:
        yield from settle()


def covered(n_words: int, answers: list[bytes], width: int) -> np.ndarray:
    """Which words the windows at the answered places cover."""
    step = np.zeros(n_words + 1, np.int64)
    for x in answers:
        at, windows = spans(x)
        np.add.at(step, at, 1)
        np.subtract.at(step, np.minimum(at + windows - 1 + width, n_words), 1)
    return np.cumsum(step[:n_words]) > 0


def _keep(width: int):
    def run(zipped: pa.Array, one: pa.Array, two: pa.Array) -> pa.Array:
        n, gone, out = [], [], []
        for k in range(0, len(zipped), 64):
            for z, symbols, windows in zip(*(c.slice(k, 64).to_pylist() for c in (zipped, one, two))):
                words = zstandard.decompress(z).split()
                answers = [*(symbols or ()), *(windows or ())]
                n.append(len(words))
                if answers:
                    off = covered(len(words), answers, width)
                    gone.append(int(off.sum()))
                    words = [w for w, o in zip(words, off.tolist()) if not o]
                else:
                    gone.append(0)
                out.append(b" ".join(words))
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(out, pa.binary()).cast(pa.string())], names=["n_words", "n_removed", "kept"])

    run.__annotations__ = {"zipped": pa.Array, "one": pa.Array, "two": pa.Array, "return": pa.Array}
    return arrow_udf(run, "struct<n_words:bigint,n_removed:bigint,kept:string>")


def _packed(texts: pa.Array) -> pa.Array:
    out = []
    for k in range(0, len(texts), 64):
        out += [zstandard.compress(x or b"", 3) for x in texts.slice(k, 64).cast(pa.binary()).to_pylist()]
    return pa.array(out, pa.binary())


def _tags(texts: pa.Array) -> pa.Array:
    out = []
    for k in range(0, len(texts), 64):
        out += [tag_of(x or b"") for x in texts.slice(k, 64).cast(pa.binary()).to_pylist()]
    return pa.array(out, pa.int32())


def _both(texts: pa.Array) -> pa.Array:
    return pa.StructArray.from_arrays([_tags(texts), _packed(texts)], names=["tag", "zipped"])


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 13) -> DataFrame:
    """Per row: doc_id, n_words, n_removed and kept (the words that stay, joined by one space)."""
    spark = docs.sparkSession
    ship(spark)
    if docs.schema[doc_id].dataType.simpleString() not in ("tinyint", "smallint", "int", "bigint"):
        raise ValueError(f"{doc_id} must be an integer: ids are compared as longs")
    own = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    size = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET))

    def settled(sent: DataFrame, name: str) -> DataFrame:
        met = sent.repartitionById(buckets, F.col("bucket")).mapInArrow(_settle_buckets, SENT)
        return met.groupBy("doc", "tag").agg(F.collect_list("held").alias(name))

    revealed = settled(own.mapInArrow(_send(width, buckets, True), SENT), "symbols")
    made = own.withColumn("made", arrow_udf(_both, "struct<tag:int,zipped:binary>")(F.col("text"))).select(F.coalesce("doc_id", F.lit(_NULL)).alias("doc"), "made.tag", "made.zipped")
    # the texts move once: what follows joins by the same keys, and both uses share the exchange
    known = made.join(revealed, ["doc", "tag"], "left").select("doc", "zipped", "symbols", "tag")
    rest = settled(known.mapInArrow(_send(width, buckets, False), SENT), "windows")
    both = known.join(rest, ["doc", "tag"], "left")
    own_id = F.when(F.col("doc") != F.lit(_NULL), F.col("doc")).alias("doc_id")
    return both.withColumn("r", _keep(width)(F.col("zipped"), F.col("symbols"), F.col("windows"))).select(own_id, "r.*")
