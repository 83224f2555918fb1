"""Token counts of a byte-level BPE vocabulary by rank-synchronous merging of arrays.

A text is cut into chunks at places where a pre-token surely ends. Chunks met before are
counted from a bounded table; the others of a batch are cut into pre-tokens, held as one
ragged array of symbols, and merged together: in each step every sequence applies its own
lowest-rank pair, at all places from the left, and sequences without a pair leave. What
is counted is the symbols that survive.

Defined results: a null text counts as empty, with 0 tokens. Strings of special tokens in a
text count as that one token, as the library takes them. Equal texts get equal counts.
Other columns, repeated rows and empty tables have no influence.
"""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from basalt.llm.common import per_batch

_A, _N = r"[ \t\n\r\f\v]", r"[^ \t\n\r\f\v]"
#: Texts with white space or separators of other kinds are cut by the library alone.
_ODD = re.compile("[\x1c-\x1f\x85\xa0 ᠎ -​    　﻿]")
_CHUNK = re.compile(rf" ?{_N}+|{_A}+(?= {_N})|{_A}+{_N}*")
_ASCII = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+", re.ASCII)
#: Entries of the table of chunks; it starts anew beyond, so a worker's memory is bounded.
CACHE = 600_000
#: Longer chunks are counted each time, not kept.
LONG = 48
_NONE = np.iinfo(np.int32).max


class Vocabulary:
    """Merges and symbols of a ``tokenizers`` file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        spec = json.load(open(path, encoding="utf-8"))
        model, pre = spec["model"], spec["pre_tokenizer"] or {}
        if model["type"] != "BPE" or pre.get("type") != "ByteLevel" or not pre.get("use_regex") or pre.get("add_prefix_space") or spec["normalizer"] or model.get("ignore_merges") or model.get("end_of_word_suffix"):
            raise ValueError(f"{path} isn't a plain byte-level BPE vocabulary")
        vocab = model["vocab"]
        self.size = max(vocab.values()) + 1
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in merges], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        self.merged = np.array([vocab[a + b] for a, b in merges], np.int32)
        self.symbols = np.full(0x180, -1, np.int32)
        for c, i in vocab.items():
            if len(c) == 1 and ord(c) < len(self.symbols):
                self.symbols[ord(c)] = i
        self.pre = Tokenizer.from_file(path).pre_tokenizer
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.chunks: dict[str, int] = {}
        self.ascii = {bytes([b]).decode(): self.pre.pre_tokenize_str(bytes([b]).decode())[0][0] for b in range(128)}
        self.ascii_table = str.maketrans(self.ascii)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of the pairs, _NONE where there is none."""
        want = a.astype(np.int64) * self.size + b
        at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        return np.where(self.keys[at] == want, self.ranks[at], _NONE)

    def merge(self, sequences: list[str]) -> np.ndarray:
        """How many symbols are left of each sequence of byte symbols (none of them empty)."""
        counts = np.ones(len(sequences), np.int64)
        lens = np.fromiter(map(len, sequences), np.int64, len(sequences))
        points = np.frombuffer("".join(sequences).encode("utf-32-le"), np.uint32)
        sym = self.symbols[points]
        seq = np.repeat(np.arange(len(sequences)), lens)
        rank = self._ranks(sym, seq)
        while len(sym):
            first = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]])
            sizes = np.diff(np.r_[first, len(seq)])
            low = np.minimum.reduceat(rank, first)
            done = low == _NONE
            if done.any():
                counts[seq[first[done]]] = sizes[done]
                live = np.repeat(~done, sizes)
                sym, seq, rank = sym[live], seq[live], rank[live]
                low, sizes = low[~done], sizes[~done]
                if not len(sym):
                    break
            hit = np.flatnonzero(rank == np.repeat(low, sizes))
            # of pairs that overlap, as in a run of one symbol, every other one from the left
            head = np.r_[True, np.diff(hit) != 1]
            place = np.arange(len(hit))
            hit = hit[(place - np.maximum.accumulate(np.where(head, place, 0))) % 2 == 0]
            sym[hit] = self.merged[rank[hit]]
            stay = np.ones(len(sym), bool)
            stay[hit + 1] = False
            moved = np.cumsum(stay) - 1
            touched = moved[hit]
            sym, seq, rank = sym[stay], seq[stay], rank[stay]
            mark = np.zeros(len(sym), bool)
            mark[touched] = True
            mark[np.maximum(touched - 1, 0)] = True
            touched = np.flatnonzero(mark)
            rank[touched] = self._ranks(sym, seq, touched)
        return counts

    def _ranks(self, sym: np.ndarray, seq: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
        at = np.arange(len(sym)) if at is None else at
        after = np.minimum(at + 1, len(sym) - 1)
        inside = (after > at) & (seq[after] == seq[at])
        out = np.full(len(at), _NONE, np.int32)
        out[inside] = self.rank(sym[at[inside]], sym[after[inside]])
        return out

    def cut(self, chunk: str) -> list[str]:
        """The pre-tokens of a chunk, as byte symbols."""
        if chunk.isascii():
            return [x.translate(self.ascii_table) for x in _ASCII.findall(chunk)]
        return [x for x, _ in self.pre.pre_tokenize_str(chunk)]

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of each text."""
        if len(self.chunks) > CACHE:
            self.chunks.clear()
        known, own = self.chunks, [0] * len(texts)
        parts: list[tuple[int, list[str]]] = []
        missing: dict[str, int] = {}
        for k, text in enumerate(texts):
            pieces = [text]
            if self.special is not None and self.special.search(text):
                pieces = self.special.split(text)
                own[k] += len(pieces) - 1
            for piece in pieces:
                if not piece:
                    continue
                chunks = [piece] if _ODD.search(piece) else _CHUNK.findall(piece)
                found = list(map(known.get, chunks))
                if None in found:
                    late = [c for c, n in zip(chunks, found) if n is None]
                    missing.update(dict.fromkeys(late, 0))
                    parts.append((k, late))
                    own[k] += sum(n for n in found if n is not None)
                else:
                    own[k] += sum(found)
        if missing:
            cuts = [self.cut(c) for c in missing]
            distinct = dict.fromkeys(x for c in cuts for x in c)
            for x, n in zip(distinct, self.merge(list(distinct)).tolist()):
                distinct[x] = n
            for c, xs in zip(missing, cuts):
                missing[c] = n = sum(map(distinct.__getitem__, xs))
                if len(c) <= LONG:
                    known[c] = n
            for k, late in parts:
                own[k] += sum(map(missing.__getitem__, late))
        return own


_loaded: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """The file's vocabulary, read once in each worker."""
    if path not in _loaded:
        _loaded[path] = Vocabulary(path)
    return _loaded[path]


FIELDS = [("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())]


def count_tokens(docs: DataFrame, path: str, text: str = "text", limit: int = 512, to: str = "tokens") -> DataFrame:
    """Add the struct ``to``: n_bytes, n_tokens and over_limit (n_tokens > limit). The file must be at ``path`` on every machine."""

    def rows(batch: list[str]) -> list[tuple]:
        return [(len(x.encode()), n, n > limit) for x, n in zip(batch, vocabulary(path).count(batch))]

    return per_batch(docs, text, rows, FIELDS, to)
