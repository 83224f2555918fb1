"""Quality rules: how much of a text is repetition.

Rolling hashes of the word sequence, one array pass for each n-gram length, tell which
words lie inside n-grams that the text holds twice or more; the verdict compares the
characters of those words, and of repeated lines, with all characters in words.

Defined results: a null or empty text, or one of blanks only, has no words, counts 0
everywhere and fails the base rule. Equal texts get equal verdicts. Rows are judged one
by one, so ties, repeated rows, empty tables and further columns have no influence.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basalt.llm.common import BLANK, fresh, per_text

SYMBOLS = "#*$%&|<>"
_rng = np.random.default_rng(20240229)
#: Odd multipliers of the rolling hash, one for each place in an n-gram.
_MULT = _rng.integers(0, 2**63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

FIELDS = [
    ("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()),
    ("base_failed", pa.bool_()), ("kept", pa.bool_()),
    ("top_share", pa.float64()), ("repeat_share", pa.float64()), ("dup_line_share", pa.float64()),
]


@dataclass(frozen=True)
class Limits:
    """Highest shares of a kept text's word characters.

    top: by n-gram length, in all places of the one n-gram that covers most.
    repeat: by n-gram length, in n-grams that occur twice or more, without their first places.
    lines: in lines equal to an earlier one.
    """

    min_words: int = 10
    repeat_percent: int = 20
    top: tuple[tuple[int, float], ...] = ((2, 0.30), (3, 0.25), (4, 0.20))
    repeat: tuple[tuple[int, float], ...] = ((5, 0.20), (8, 0.15), (10, 0.12))
    lines: float = 0.30


def ngram_hashes(ids: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of each n consecutive ids."""
    m = len(ids) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    h = ids[:m] * _MULT[0]
    for j in range(1, n):
        h = h + ids[j : j + m] * _MULT[j]
    return h


def covered(starts: np.ndarray, n: int, total: int) -> np.ndarray:
    """Which of ``total`` words an n-gram beginning at a marked place covers."""
    step = np.zeros(total + 1, np.int64)
    at = np.flatnonzero(starts)
    step[at] += 1
    np.subtract.at(step, at + n, 1)
    return np.cumsum(step[:total]) > 0


def groups(h: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """(places of the hashes that occur twice or more, by hash; where each hash's run begins among them)."""
    order = np.argsort(h)
    v = h[order]
    same = v[1:] == v[:-1]
    if not same.any():
        return None
    twice = np.r_[same, False] | np.r_[False, same]
    return order[twice], np.flatnonzero(np.r_[True, ~same][twice])


def measure(text: str, limits: Limits = Limits()) -> tuple:
    """One row of FIELDS for one text."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    word_chars = len(text) - sum(map(text.count, BLANK))
    n_symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    seen: set[bytes] = set()
    n_dup, dup_bytes = 0, 0
    if len(set(lines)) < len(lines):
        for x in lines:
            if x in seen:
                n_dup += 1
                dup_bytes += len(x.translate(None, BLANK.encode()))
            seen.add(x)
    joined = b"".join(words)
    ids = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n))
    if len(joined) == word_chars:
        lens = np.diff(ends, prepend=0)
    else:
        points = np.cumsum((np.frombuffer(joined, np.uint8) & 0xC0) != 0x80)
        lens = np.diff(points[ends - 1], prepend=0) if n else ends
    total = max(1, word_chars)

    n_repeat, failed, top_share, repeat_share = 0, n < limits.min_words, 0.0, 0.0
    bad = dup_bytes > limits.lines * max(1, len(joined))
    for k, limit in limits.repeat:
        found = groups(ngram_hashes(ids, k))
        if found is None:
            if k == 5:
                continue
            break  # a longer one would hold a shorter one twice
        at, first = found
        starts = np.zeros(n, bool)
        starts[at] = True
        if k == 5:
            n_repeat = int(covered(starts, k, n).sum())
        starts[np.minimum.reduceat(at, first)] = False
        share = float(lens[covered(starts, k, n)].sum()) / total
        repeat_share = max(repeat_share, share)
        bad = bad or share > limit
    failed = failed or 100 * n_repeat > limits.repeat_percent * n
    for k, limit in limits.top:
        found = groups(ngram_hashes(ids, k))
        if found is None:
            break
        at, first = found
        cum = np.r_[0, np.cumsum(lens)]
        runs = np.diff(np.r_[first, len(at)])
        chars = (cum[at[first] + k] - cum[at[first]]) * runs
        share = min(1.0, float(chars.max()) / total)
        top_share = max(top_share, share)
        bad = bad or (share > limit and int(runs[int(chars.argmax())]) > 2)
    return n, word_chars, n_symbols, n_dup, n_repeat, failed, not failed and not bad, top_share, repeat_share, dup_bytes / max(1, len(joined))


def judge(docs: DataFrame, text: str = "text", limits: Limits = Limits(), to: str = "quality") -> DataFrame:
    """Add the struct ``to`` with the fields of FIELDS."""
    return per_text(docs, text, lambda x: measure(x, limits), FIELDS, to)


def keep(docs: DataFrame, text: str = "text", limits: Limits = Limits()) -> DataFrame:
    """The rows whose text is kept, with their columns as they are."""
    to = fresh("quality", docs)
    return judge(docs, text, limits, to).filter(F.col(f"{to}.kept")).drop(to)
