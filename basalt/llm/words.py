"""Words of many texts at once, as arrays."""

from __future__ import annotations

import numpy as np

_KEY = np.uint64(0x9E3779B97F4A7C15)
#: What to keep of 8 bytes of which the first n belong to a word.
_MASK = np.array([(1 << (8 * n)) - 1 for n in range(9)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(64-bit hash, first byte, end byte) of each word, alike in every process; blanks are those of ``bytes.split()``.

    A word is hashed 8 bytes at a time, all words' first 8 bytes together, then the next 8 of the longer ones.
    """
    raw = np.frombuffer(data, np.uint8)
    inside = ((raw - np.uint8(9)) >= 5) & (raw != 32)
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(raw) and inside[0]:
        edge = np.r_[0, edge]
    if len(raw) and inside[-1]:
        edge = np.r_[edge, len(raw)]
    start, end = edge[::2], edge[1::2]
    left = end - start
    h = mix(left.astype(np.uint64) + _KEY)
    padded = data + bytes(8)
    eight = np.ndarray((len(data) + 1,), "<u8", padded, 0, (1,))
    who, at = None, start
    while len(at):
        part = mix((eight[at] & _MASK[np.minimum(left, 8)]) + _KEY)
        if who is None:
            h = mix((h ^ part) * _KEY)
            who = np.flatnonzero(left > 8)
            at, left = at[who] + 8, left[who] - 8
        else:
            h[who] = mix((h[who] ^ part) * _KEY)
            more = left > 8
            who, at, left = who[more], at[more] + 8, left[more] - 8
    return h, start, end


def pack_texts(texts: list[bytes]) -> tuple[bytes, np.ndarray]:
    """The texts in one piece, each followed by a blank, and where each ends (its blank not counted)."""
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))) - 1
    return b"\n".join(texts) + b"\n", ends
