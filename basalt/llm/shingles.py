"""Sets of word shingles, and the Jaccard index of pairs of them.

A text is the set of its lower-cased shingles of ``width`` words, as 64-bit hashes. Fewer words than a shingle
has make one shingle; a text without words, or null, has the empty set, whose id is 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basalt.llm.common import byte_batches
from basalt.llm.line_dedup import SEEN, bitmap_of, in_bitmap, may_have
from basalt.llm.words import mix, pack_texts, word_hashes


def shingle_sets(texts: list[bytes], width: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The texts' sets of shingle hashes one after another, each sorted; start of each, its size, its id (0 for none)."""
    data, ends = pack_texts([t.lower() for t in texts])
    h, at, _ = word_hashes(data)
    words = np.bincount(np.searchsorted(ends, at), minlength=len(texts))
    first = np.cumsum(words) - words
    n = np.where(words >= width, words - width + 1, np.minimum(words, 1))
    owner = np.repeat(np.arange(len(texts)), n)
    at = first[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    size = np.minimum(words[owner], width)
    s = mix(size.astype(np.uint64))
    for j in range(width):
        s = np.where(j < size, mix(s * np.uint64(3) + h[np.minimum(at + j, len(h) - 1)]), s)
    order = np.lexsort((s, owner))
    s, owner = s[order], owner[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (owner[1:] != owner[:-1])
    s, n = s[new], np.bincount(owner[new], minlength=len(texts))
    start = np.cumsum(n) - n
    ids = np.zeros(len(texts), np.uint64)
    some = n > 0
    if some.any():
        ids[some] = mix(np.add.reduceat(mix(s + np.uint64(1)), start[some]) + n[some].astype(np.uint64))
    return s, start, n, ids


def set_rows(width: int, bitmap: np.ndarray):
    """Sets of the texts whose id the bitmap has; a set may come from several tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for part in byte_batches(batch.column(0)):
                s, start, n, ids = shingle_sets(part, width)
                if len(seen) > SEEN:
                    seen.clear()
                want = []
                for i in np.flatnonzero(in_bitmap(bitmap, ids) & (n > 0)).tolist():
                    if (x := int(ids[i])) not in seen:
                        seen.add(x)
                        want.append(i)
                if want:
                    offsets = np.r_[0, np.cumsum(n[want])].astype(np.int32)
                    flat = np.concatenate([s[start[i] : start[i] + n[i]] for i in want])
                    yield pa.RecordBatch.from_arrays([pa.array(ids[want].view(np.int64)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(np.int64)))], names=["id", "words"])

    return run


def verified(pairs: DataFrame, sets: DataFrame, t: Fraction) -> DataFrame:
    """The written pairs (a, b) whose sets are as similar as t; only the sets of the pairs move."""
    own = sets.filter(may_have(bitmap_of(pairs.select(F.explode(F.array("a", "b")).alias("id"))))(F.col("id")))
    both = pairs.join(own.select(F.col("id").alias("a"), F.col("words").alias("x")), "a").join(own.select(F.col("id").alias("b"), F.col("words").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    return both.filter(common * t.denominator >= t.numerator * (F.size("x") + F.size("y") - common)).select("a", "b")
