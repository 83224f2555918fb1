"""The text queries against their SQL, or against brute force where SQL can't say it."""

import hashlib
import re
import zlib

import numpy as np
import pytest
import xxhash

from basalt.llm import queries as llm
from tests.compare import check

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.mark.parametrize("name", sorted(llm.SQL))
def test_agrees_with_sql(name, spark, sf, duck):
    check(name, llm.QUERIES, llm.SQL, spark, sf, duck)


@pytest.fixture(scope="module")
def docs(duck):
    return [(i, t or "") for i, t in duck.execute("SELECT doc_id, text FROM documents ORDER BY doc_id DESC").fetchall()]


def test_op1(spark, sf, docs):
    got = {r.doc_id: r for r in llm.op1_closed_syncmers(spark, sf).collect()}
    assert len(got) == len(docs)
    by_text = {}
    for k, (i, t) in enumerate(docs):
        after = docs[(k + 1) % len(docs)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and got[i].n_chars == len(t)
        assert by_text.setdefault(t, got[i].fingerprint) == got[i].fingerprint
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
    near = [(r.near_edited, r.near_next) for r in got.values() if r.n_chars > 200]
    assert sum(a > b for a, b in near) > 0.97 * len(near)


def test_op2(spark, sf, duck):
    pages = duck.execute("SELECT page_id, url FROM pages").fetchall()
    got = {r.page_id: r for r in llm.op2_association_rules(spark, sf).collect()}
    assert len(got) == len(pages)
    rules = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
    for i, url in pages:
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = re.split("[/?#]", rest, maxsplit=1)[0]
        path = re.split("[?#]", rest[len(host) :], maxsplit=1)[0]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
        fits = [r for r in rules if ("." + host).endswith("." + r[0].split("/")[0]) and path.startswith(r[0][r[0].index("/") :])]
        best = max(fits, key=lambda r: len(r[0]), default=None)
        assert (got[i].host, got[i].path) == (host, path)
        assert got[i].rule == (best and best[0]) and (best is None or got[i].verdict == best[1]) and got[i].verdict in ("allow", "block")


def simhash(text):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    if not w:
        return 0
    s = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << j for j in range(64) if 2 * sum(x >> j & 1 for x in h) > len(h))


def components(ids, prints, distance=3):
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    a = np.array(prints, np.uint64)
    for i in range(len(ids)):
        for j in np.flatnonzero(np.bitwise_count(a[i + 1 :] ^ a[i]) <= distance) + i + 1:
            x, y = find(i), find(int(j))
            root[max(x, y)] = min(x, y)
    least = {}
    for i in range(len(ids)):
        least[find(i)] = min(ids[i], least.get(find(i), ids[i]))
    return {ids[i]: least[find(i)] for i in range(len(ids))}


def test_op4(spark, sf, docs):
    got = {r.doc_id: r for r in llm.op4_deletion_variants(spark, sf).collect()}
    want = {i: simhash(t) for i, t in docs}
    assert {i: r.fingerprint for i, r in got.items()} == {i: f"{p:016x}" for i, p in want.items()}
    assert {i: r.component_id for i, r in got.items()} == components([i for i, _ in docs], [want[i] for i, _ in docs])


def test_op6(spark, sf, docs):
    rows = llm.op6_cube_mixing(spark, sf).collect()
    size = {i: len(WORD.findall(t)) for i, t in docs}
    assert {r.doc_id: r.size for r in rows} == size
    by = {}
    for r in rows:
        by.setdefault(r.source, []).append(r)
        assert r.taken <= 2 * r.size
    own = {s: sum(r.size for r in rs) for s, rs in by.items()}
    names = sorted(own, key=lambda s: (s is None, s))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    total, stopped = 1.5 * sum(own.values()), {}
    while True:
        rest, heavy = total - sum(stopped.values()), sum(weight[s] for s in names if s not in stopped)
        new = {s: 2.0 * own[s] for s in names if s not in stopped and rest * weight[s] / heavy > 2 * own[s]}
        if not new:
            break
        stopped |= new
    for s, rs in by.items():
        want = stopped.get(s, rest * weight[s] / heavy)
        assert abs(rs[0].target - want) < 1e-6 * want and abs(sum(r.taken for r in rs) - want) <= 0.02 * want + 5
    again = llm.op6_cube_mixing(spark, sf).repartition(3).collect()
    assert {(r.doc_id, r.taken) for r in again} == {(r.doc_id, r.taken) for r in rows}


def test_op7(spark, sf, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in llm.op7_rank_synchronous(spark, sf).collect()}
    for i, t in docs:
        n = len(tok.encode(t, add_special_tokens=False).ids)
        assert got[i] == (len(t.encode()), n, n > 512)


def test_op9(spark, sf, docs):
    got = {r.doc_id: r for r in llm.op9_repetition_coverage(spark, sf).collect()}
    for i, t in docs:
        w = WORD.findall(t)
        grams = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
        count = {}
        for g in grams:
            count[g] = count.get(g, 0) + 1
        inside = {k + j for k, g in enumerate(grams) if count[g] > 1 for j in range(5)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        failed = len(w) < 10 or 100 * len(inside) > 20 * len(w)
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(inside), failed)
        assert not (r.base_failed and r.kept)


def test_op10(spark, sf, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = llm.op10_grouping_genetic(spark, sf).collect()
    by, bins = {}, {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
        bins.setdefault(r.sequence_id, []).append(r)
    for i, t in docs:
        ids = [*tok.encode(t, add_special_tokens=False).ids, 1]
        want = [(k // 4096, k, len(ids[k : k + 4096]), zlib.crc32(np.array(ids[k : k + 4096], "<u4").tobytes())) for k in range(0, len(ids), 4096)]
        assert sorted((r.piece, r.start, r.length, r.ids_crc32) for r in by[i]) == want
    for held in bins.values():
        at = 0
        for r in sorted(held, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096
    assert len(bins) <= -(-sum(r.length for r in rows) // 4096) + 1
