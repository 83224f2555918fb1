"""Packing documents into sequences with a grouping genetic algorithm.

Documents are tokenized once; a piece is a document's ids with the end id, cut only where
they exceed the capacity. Blocks of pieces are bred by islands: an island keeps a few
packings of its block, at first best-fits in random orders, and crossover injects whole well-filled bins of one packing into
another, drops the bins that then hold something twice, and best-fits the displaced pieces.
Between epochs the best packing of each island migrates to its neighbour. Well-filled
bins of the best packing are final; what lies in the others goes on to a next round, where
it is dealt to fewer blocks, until one block is left or a round has settled less than a tenth.

Defined results: a null or empty text is one piece with the end id alone, a text of any length as many as it needs. Repeated rows are
packed as documents of their own. A piece of full capacity is a sequence by itself. Sequence
numbers are unique, not gapless. An empty table gives an empty table. Further columns are
left out.
"""

from __future__ import annotations

import random
import re
import unicodedata
import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basalt.llm.common import text_batches, trimmed
from basalt.plans.scratch import Scratch
from basalt.plans.ship import ship

#: Entries of a generation of a worker's tables.
CACHE = 600_000
LONG = 48


#: Words of other letters, or whose lower case or normal form could differ between libraries, go to the tokenizer whole.
_OTHER = re.compile("[^\x00-\u012f\u0131-\u024f]|[\x1c-\x1f\x85\xa0]|<\\|")
#: The same in texts of Latin-1.
_MARKS = ("<|", "\x1c", "\x1d", "\x1e", "\x1f", "\x85", "\xa0")
_LOWER = sorted({y for x in map(chr, range(0x250)) if not _OTHER.match(x) for y in x.lower()})
_LETTERS, _NUMBERS = ("".join(re.escape(x) for x in _LOWER if unicodedata.category(x)[0] == k) for k in "LN")
_ASCII = re.compile(r"[a-z]+|[0-9]|'(?:s|t|re|ve|m|ll|d)|[^\sa-z0-9]+", re.ASCII)
_LATIN = re.compile(rf"[{_LETTERS}]+|[{_NUMBERS}]|'(?:s|t|re|ve|m|ll|d)|[^\s{_LETTERS}{_NUMBERS}]+")


def _regular(text: str) -> bool:
    """Whether nothing of the text has to go to the tokenizer whole."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return not _OTHER.search(text) and unicodedata.is_normalized("NFC", text)
    return not any(x in text for x in _MARKS)


class _Table(dict):
    """What ``make`` returns for a word, kept in two generations: after ``turn`` a new one begins, and what is met again moves on."""

    def __init__(self, make: Callable[[bytes], bytes]):
        self.make, self.old = make, {}

    def __missing__(self, word: bytes) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            ids = self.make(word)
        if len(word) <= LONG:
            self[word] = ids
        return ids

    def turn(self) -> None:
        self.old = dict(self)
        self.clear()


class Encoder:
    """Token ids of whole texts, word by word.

    For vocabularies of lower-cased text whose pre-tokens are letters, single digits or other runs,
    never across white space. Words seen before come from a bounded table, and so do the pre-tokens of
    others, which are words themselves. Texts with a word that the library must cut have a table of their own.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.model = self.tok.model
        self.four = [k.to_bytes(4, "little") for k in range(max(self.tok.get_vocab().values()) + 1)]
        # what the byte-level pre-tokenizer writes for each byte
        printed = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [x for x in range(256) if x not in printed]
        self.byte = {**{x: chr(x) for x in printed}, **{x: chr(256 + k) for k, x in enumerate(others)}}
        self.words, self.others = _Table(self._word), _Table(self._other)
        probes = ["a b", "a  b", " a\tb ", "a\nb", "a\r\nb", "a\x0b\x0cb", "é \u0301b", "<|endoftext|> a <|endoftext|>b", "Don't!!'s x12 ÉÀß_ŉ²½ a-b", "we'll I'M They've \x00\x7f ¡­"]
        if [self.encode([x])[0] for x in probes] != [self._whole(x) for x in probes]:
            raise ValueError(f"{path} isn't a vocabulary that this encoder can cut")

    def _whole(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _word(self, word: bytes) -> bytes:
        text = word.decode()
        plain = text.isascii()
        if not text.isalpha():
            parts = (_ASCII if plain else _LATIN).findall(text)
            if len(parts) > 1:
                return b"".join([self.words[x.encode()] for x in parts])
            plain = plain and text.isprintable()
        four = self.four
        return b"".join([four[t.id] for t in self.model.tokenize(text if plain else "".join(map(self.byte.__getitem__, word)))])

    def _other(self, word: bytes) -> bytes:
        text = word.decode()
        return self.words[text.lower().encode()] if _regular(text) else self._whole(text)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        if len(self.words) + len(self.others) > CACHE:
            self.words.turn()
            self.others.turn()
        cut = [(self.words, x.lower()) if _regular(x) else (self.others, x) for x in texts]
        return [b"".join(map(table.__getitem__, x.encode().split())) for table, x in cut]


_loaded: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    return _loaded[path]


def cuts(batches: Iterable[list[str]], encode: Callable[[list[str]], list[bytes]], tail: bytes, capacity: int) -> Iterator[list[tuple[int, int, int, int]]]:
    """(piece, start, length, ids_crc32) of each text's pieces. A text beside an equal one isn't encoded again, as a mix has its copies side by side."""
    last, held = None, []
    for texts in batches:
        ids = iter(encode([x for x, before in zip(texts, [last, *texts]) if x != before]))
        for x in texts:
            if x != last:
                last, own = x, next(ids) + tail
                parts = [own[k : k + 4 * capacity] for k in range(0, len(own), 4 * capacity)]
                held = [(k, k * capacity, len(part) // 4, zlib.crc32(part)) for k, part in enumerate(parts)]
            yield held


PIECES = "doc_id {id}, piece int, start bigint, length bigint, ids_crc32 bigint"


def pieces(docs: DataFrame, path: str, end_id: int, capacity: int = 4096, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32."""
    ship(docs.sparkSession)
    tail = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            at, piece, start, length, crc = [], [], [], [], []
            for row, held in enumerate(cuts(text_batches(batch.column(1)), enc.encode, tail, capacity)):
                for k, begin, n, sum_ in held:
                    at.append(row)
                    piece.append(k)
                    start.append(begin)
                    length.append(n)
                    crc.append(sum_)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")).mapInArrow(trimmed(run), PIECES.format(id=kind))


@dataclass(frozen=True)
class Breeding:
    """block: pieces of a block; islands: islands of a block; epochs: with migration between; size: packings an island keeps; generations: most crossovers of an epoch, times size; full: fill from which a bin is final."""

    block: int = 6000
    islands: int = 2
    epochs: int = 2
    size: int = 4
    generations: int = 15
    full: float = 0.995


def best_fit(order: list[int], lens: list[int], capacity: int, bins: list[list[int]]) -> list[list[int]]:
    """Put each item of ``order`` into the bin it fills best, a new one where none has room. ``bins`` is added to."""
    room: dict[int, list[int]] = {}
    mask = 0
    for b, held in enumerate(bins):
        r = capacity - sum(map(lens.__getitem__, held))
        room.setdefault(r, []).append(b)
        mask |= 1 << r
    for i in order:
        n = lens[i]
        fits = mask >> n
        if fits:
            r = n + (fits & -fits).bit_length() - 1
            own = room[r]
            b = own.pop()
            if not own:
                mask ^= 1 << r
            bins[b].append(i)
        else:
            r, b = capacity, len(bins)
            bins.append([i])
        r -= n
        if r:
            room.setdefault(r, []).append(b)
            mask |= 1 << r
    return bins


def fitness(bins: list[list[int]], lens: list[int], capacity: int) -> tuple[int, float]:
    """Fewer bins first, then bins that are as unequal as can be."""
    return -len(bins), sum((sum(map(lens.__getitem__, b)) / capacity) ** 2 for b in bins)


def cross(a: list[list[int]], b: list[list[int]], lens: list[int], capacity: int, rng: random.Random) -> list[list[int]]:
    """``a`` with some of the best-filled bins of ``b`` injected."""
    ranked = sorted(b, key=lambda x: -sum(map(lens.__getitem__, x)))
    top = ranked[: max(1, len(ranked) // 2)]
    inject = [list(x) for x in top if rng.random() < 0.5] or [list(top[0])]
    taken = {i for x in inject for i in x}
    kept, displaced = [], []
    for x in a:
        if taken.isdisjoint(x):
            kept.append(list(x))
        else:
            displaced += [i for i in x if i not in taken]
    # the worst bins are opened too, so that their items get another chance
    kept.sort(key=lambda x: -sum(map(lens.__getitem__, x)))
    for x in kept[len(kept) - max(1, len(kept) // 50) :]:
        displaced += x
    kept = kept[: len(kept) - max(1, len(kept) // 50)]
    displaced.sort(key=lambda i: (-lens[i], i))
    return best_fit(displaced, lens, capacity, inject + kept)


def evolve(lens: list[int], capacity: int, given: list[list[list[int]]], seed: int, breeding: Breeding) -> tuple[list[list[int]], int]:
    """The best packing of one island after one epoch, and the number of crossovers that it took.

    An island begins with the packings given and best-fits its items in random orders; it breeds until a packing needs no
    more bins than the sum of the lengths does.
    """
    rng = random.Random(seed)
    least = -(-sum(lens) // capacity)
    people = [(fitness(g, lens, capacity), g) for g in given]
    while len(people) < max(2, breeding.size):
        order = list(range(len(lens)))
        rng.shuffle(order)
        own = best_fit(order, lens, capacity, [])
        people.append((fitness(own, lens, capacity), own))
    people.sort(key=lambda p: p[0], reverse=True)
    crossings = 0
    while crossings < breeding.generations * breeding.size and -people[0][0][0] > least:
        one, two = rng.sample(range(len(people)), 2)
        child = cross(people[min(one, two)][1], people[max(one, two)][1], lens, capacity, rng)
        crossings += 1
        people.append((fitness(child, lens, capacity), child))
        people.sort(key=lambda p: p[0], reverse=True)
        del people[max(2, breeding.size) :]
    return people[0][1], crossings


STATE = "block bigint, island int, item bigint, length bigint, bin int, elite int, bins int, crossings int"


def _epoch(capacity: int, epoch: int, breeding: Breeding):
    def run(key: tuple, held: pd.DataFrame) -> pd.DataFrame:
        """One island: its block's items, once, with up to two packings (bin by elite)."""
        block, island = int(key[0]), int(key[1])
        items = np.unique(held["item"].to_numpy())
        lens_of = np.zeros(len(items), np.int64)
        at = np.searchsorted(items, held["item"].to_numpy())
        lens_of[at] = held["length"].to_numpy()
        given = []
        for elite, own in held.assign(at=at).groupby("elite"):
            if elite >= 0:
                own = own.sort_values(["bin", "at"])
                cuts = np.flatnonzero(np.diff(own["bin"].to_numpy())) + 1
                given.append([x.tolist() for x in np.split(own["at"].to_numpy(), cuts)])
        bins, crossings = evolve(lens_of.tolist(), capacity, given, hash((block, island, epoch)), breeding)
        order = np.array([i for b in bins for i in b], np.int64)
        number = np.repeat(np.arange(len(bins)), [len(b) for b in bins])
        return pd.DataFrame({"block": block, "island": island, "item": items[order], "length": lens_of[order], "bin": number, "elite": island, "bins": len(bins), "crossings": crossings})

    return run


def pack(items: DataFrame, capacity: int = 4096, breeding: Breeding = Breeding(), scratch: Scratch | None = None) -> DataFrame:
    """(item, sequence_id, offset) for rows of item (a unique long) and length (at most capacity)."""
    spark = items.sparkSession
    ship(spark)
    scratch = scratch or Scratch(spark, "packing")
    final = []
    whole = items.filter(F.col("length") >= capacity).select("item", F.col("item").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    left = items.filter(F.col("length") < capacity).select("item", "length")
    n, before, turn = left.count(), 0, 0
    while n:
        blocks = max(1, -(-n // breeding.block))
        # another round is worth while unless the one before has left most pieces
        last = blocks == 1 or turn > 0 and n > 0.9 * before
        dealt = left.withColumn("block", F.pmod(F.xxhash64("item", F.lit(turn)), F.lit(blocks)))
        none = F.lit(-1)
        state = dealt.select("block", F.explode(F.sequence(F.lit(0), F.lit(breeding.islands - 1))).alias("island"), "item", "length", none.alias("bin"), none.alias("elite"), none.alias("bins"), F.lit(0).alias("crossings"))
        for epoch in range(breeding.epochs):
            if epoch:
                moved = state.withColumn("island", ((F.col("island") + 1) % breeding.islands).cast("int"))
                state = state.unionByName(moved)
            state = scratch.write(state.groupBy("block", "island").applyInPandas(_epoch(capacity, turn * 100 + epoch, breeding), STATE))
        best = state.groupBy("block").agg(F.min_by("island", F.struct("bins", "island")).alias("island"))
        chosen = state.join(best, ["block", "island"])
        filled = chosen.groupBy("block", "bin").agg(F.sum("length").alias("fill"), F.min("item").alias("sequence_id"), F.sort_array(F.collect_list(F.struct("item", "length"))).alias("held"))
        filled = scratch.write(filled)
        good = filled if last else filled.filter(F.col("fill") >= breeding.full * capacity)
        final.append(good.select("sequence_id", "held"))
        if last:
            break
        left = filled.filter(F.col("fill") < breeding.full * capacity).select(F.explode("held").alias("h")).select("h.item", "h.length")
        n, before, turn = left.count(), n, turn + 1
    by_bin = Window.partitionBy("sequence_id").orderBy("item")
    out = whole
    for part in final:
        placed = part.select("sequence_id", F.explode("held").alias("h")).select("h.item", "sequence_id", "h.length")
        out = out.unionByName(placed.select("item", "sequence_id", (F.sum("length").over(by_bin) - F.col("length")).alias("offset")))
    return out


def pack_documents(docs: DataFrame, path: str, end_id: int = 1, capacity: int = 4096, doc_id: str = "doc_id", text: str = "text", breeding: Breeding = Breeding()) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    scratch = Scratch(docs.sparkSession, "packing")
    made = scratch.write(pieces(docs, path, end_id, capacity, doc_id, text).withColumn("item", F.monotonically_increasing_id()))
    placed = pack(made, capacity, breeding, scratch)
    return made.join(placed, "item").drop("item")
