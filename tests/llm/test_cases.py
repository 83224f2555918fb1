"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing names, by operator."""

import itertools
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from basalt.llm import chat_format, fingerprints, line_dedup, mixing, packing, quality, simhash, substring, token_counts, url_filter
from basalt.llm.components import components
from basalt.llm.words import word_hashes
from basalt.plans.scratch import Scratch

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, held string, size string, fp string, h string"
LONG = " ".join(f"w{i}" for i in range(30_000))


def row(i, text, source="a"):
    return (i, text, "en", source, None if text is None else len(text), "x", "y", "z", "q")


@pytest.fixture(scope="module")
def odd(spark):
    base = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    rows = [row(1, base), row(2, base), row(2, base), row(3, None), row(4, ""), row(5, " \t\n"), row(6, LONG), row(None, base + " fifteen"), row(7, "é 日本 <|endoftext|> x", None), row(8, LONG + " end"), row(9, "a" * 30_000)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def tok(name):
    import public_tokenizers

    return public_tokenizers.path(name)


def test_fingerprints(odd, none):
    got = fingerprints.compare_edits(odd).collect()
    assert len(got) == odd.count() and fingerprints.compare_edits(none).count() == 0
    same = {r.fingerprint for r in got if r.doc_id in (1, 2)}
    assert len(same) == 1 and {r.fingerprint for r in got if r.doc_id in (3, 4)} == {""}
    # ids descend, null last: after the row without an id comes the largest id again
    last = next(r for r in got if r.doc_id is None)
    assert last.n_chars == len("one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen")
    assert fingerprints.anchors(odd).filter("doc_id = 6").count() > 1000


def test_syncmers_are_context_free():
    rng = random.Random(3)
    text = bytes(rng.randrange(97, 123) for _ in range(400))
    at, h = fingerprints.syncmers(text)
    k, s = fingerprints.K, fingerprints.S
    moved, g = fingerprints.syncmers(b"some words before " + text + b" and after")
    shift = len(b"some words before ")
    inside = [(int(p) - shift, int(x)) for p, x in zip(moved, g) if shift <= p <= shift + len(text) - k]
    assert inside == [(int(p), int(x)) for p, x in zip(at, h)]
    word = np.ndarray((len(text) - s + 1,), "<u8", text, 0, (1,)).astype(np.uint64)
    own = fingerprints._mix(word)
    want = [i for i in range(len(text) - k + 1) if min(own[i : i + k - s + 1]) in (own[i], own[i + k - s])]
    assert at.tolist() == want


def test_url_rules(spark):
    pages = spark.createDataFrame([(1, "HTTP://A.Example.NET/en/x?y#z", "p"), (2, "x://example.net", "p"), (3, None, "p"), (4, "nothing", "p"), (5, "http://b.org/fr/", "p"), (5, "http://b.org/fr/", "p"), (6, "http://EXAMPLE.com/de/?q", "p"), (7, "http://notexample.com/de/", "p")], "page_id bigint, url string, items string")
    labelled = spark.createDataFrame([], "url string, verdict string")
    got = url_filter.judge(pages, labelled).select("page_id", "host", "path", "rule", "verdict").collect()
    assert len(got) == 8
    by = {r.page_id: tuple(r)[1:] for r in got}
    assert by == {1: ("a.example.net", "/en/x", "example.net/en/", "allow"), 2: ("example.net", "", None, "allow"), 3: ("", "", None, "allow"), 4: ("", "", None, "allow"), 5: ("b.org", "/fr/", "org/fr/", "allow"), 6: ("example.com", "/de/", "example.com/de/", "block"), 7: ("notexample.com", "/de/", None, "allow")}


def test_url_columns_may_clash(spark):
    names = ["host", "path", "rule", "verdict", "mined", "best", "found", "row", "URL2", "held", "anchor", "open_url", "items", "confidence", "none"]
    pages = spark.createDataFrame([(1, "http://a.net/", *names), (2, None, *names)], ["page_id", "url", *names])
    labelled = spark.createDataFrame([(f"http://spam.org/{'/'.join('abcdefghijklmnopqrstuvwxyz')}/{i}", "block") for i in range(6)] + [(f"http://a.org/{i}", "allow") for i in range(20)], "url string, verdict string")
    got = {r.page_id: r for r in url_filter.judge(pages, labelled).collect()}
    assert got[1].rule == "net/" and got[1].verdict == "block" and got[1].best == "best" and got[2].verdict == "allow" and got[2].host == "" and got[2].row == "row"
    assert url_filter.judge(pages.limit(0), labelled).count() == 0
    long = spark.createDataFrame([(1, "http://spam.org/" + "/".join("abcdefghijklmnopqrstuvwxyz" * 400))], "page_id bigint, url string")
    assert url_filter.judge(long, labelled).first().verdict == "block"


def test_long_urls_are_mined_whole(spark):
    """Urls of about 20 frequent tokens; what decides are two of the most frequent ones."""
    rng = random.Random(8)
    words = [chr(97 + k % 26) * (1 + k // 26) for k in range(34)]
    held = [sorted(w for k, w in enumerate(words) if rng.random() < (0.6 if k < 32 else 0.75)) for _ in range(90)]
    verdicts = ["block" if {words[-1], words[-2]} <= set(x) else "allow" for x in held]
    labelled = spark.createDataFrame([("http://a.org/" + "/".join(x), v) for x, v in zip(held, verdicts)], "url string, verdict string")
    got = {(tuple(r["items"]), r.verdict): (round(r.confidence, 9), round(r.support, 9)) for r in url_filter.mine(labelled, Scratch(spark, "urls")).collect()}
    seen = Counter()
    for x, v in zip(held, verdicts):
        own = sorted(["h:a", "h:org", *("p:" + w for w in x)])
        for k in (1, 2, 3):
            seen.update((c, v) for c in itertools.combinations(own, k))
    base, want = Counter(verdicts), {}
    for (c, v), hits in seen.items():
        sure = hits / (seen[c, "allow"] + seen[c, "block"])
        if hits >= 5 and sure >= 0.7 and sure / (base[v] / 90) >= 1.2:
            want[c, v] = (round(sure, 9), round(hits / 90, 9))
    assert sum(len(x) > 16 for x in held) > 60 and (tuple(sorted(("p:" + words[-1], "p:" + words[-2]))), "block") in want
    assert got == want


def test_mined_rules_match_brute_force(spark):
    rng = random.Random(5)
    urls = [f"http://{rng.choice(['blog', 'www'])}.{rng.choice(['spam', 'news'])}.example.org/{rng.choice(['a', 'b'])}/{i}" for i in range(400)]
    bad = lambda u: "blog.spam" in u
    labelled = spark.createDataFrame([(u, "block" if bad(u) else "allow") for u in urls[:200]], "url string, verdict string")
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id bigint, url string")
    got = {r.page_id: (r.verdict, r.mined) for r in url_filter.judge(pages, labelled).collect()}
    assert all((got[i][0] == "block") == bad(u) for i, u in enumerate(urls))
    assert {tuple(m) for v, m in got.values() if v == "block"} <= {m for m in [("h:blog", "h:spam")] + [tuple(sorted(["h:blog", "h:spam", x])) for x in ("p:a", "p:b", "h:example", "h:org", "p:0")]}


def test_chat_round_trip(spark):
    nasty = ["<|im_end|>\n", "<\\|", "<|im_turn|>x", "<", "|", "", None, "a\n<|im_start|>assistant\nb", "\\<\\\\|"]
    rows = [(1, t, r, x) for t, (r, x) in enumerate([(r, x) for x in nasty for r in ("user", "assistant", "assistant")])]
    rows += [(2, 0, "odd\nrole<|%0A", "x"), (3, None, None, None), (4, 1, "user", "b"), (4, 1, "user", "a"), (4, 1, "user", "a")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("segments", F.lit(1))
    made = chat_format.format_conversations(df)
    got = {r.conv_id: r for r in made.select("conv_id", "formatted", chat_format.read_back(F.col("formatted")).alias("turns"), chat_format.loss_text(F.col("segments")).alias("loss"), "segments").collect()}
    for c in (1, 2, 3, 4):
        own = sorted([(-1 if t is None else t, r or "", x or "") for k, t, r, x in rows if k == c])
        assert [(t.role, t.text) for t in got[c].turns] == [(r, x) for _, r, x in own]
        assert got[c].loss == "".join(x for _, r, x in own if r == "assistant")
        assert "".join(s.text for s in got[c].segments) == got[c].formatted
    assert got[1].formatted.count("<|im_start|>assistant") == len(nasty)
    assert chat_format.format_conversations(df.limit(0)).count() == 0


def test_simhash_cases(spark, odd, none):
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == odd.count() and simhash.near_duplicates(none).count() == 0
    assert {r.fp for r in got if r.doc_id in (3, 4, 5)} == {0} and {r.component_id for r in got if r.doc_id in (3, 4, 5)} == {3}
    kept = simhash.first_of_groups(odd)
    assert kept.columns == odd.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(1) == 1 and 2 not in ids and 4 not in ids and 7 in ids


@pytest.mark.parametrize("limit", [8, 2048])
def test_links_of_large_groups(spark, limit, monkeypatch):
    rng = random.Random(9)
    centre = rng.getrandbits(64)
    prints = {centre}
    while len(prints) < 150:
        prints.add(centre ^ (1 << rng.randrange(40)) ^ (1 << rng.randrange(40)) ^ (1 << rng.randrange(64)))
    prints |= {rng.getrandbits(64) for _ in range(200)}
    prints = sorted(prints)
    if limit == 8:  # executors have their own copy of the module, so a small limit is tried in this process
        monkeypatch.setattr(simhash, "LIMIT", limit)
        import pyarrow as pa

        own = np.array(prints, np.uint64)
        rows = pa.RecordBatch.from_arrays([pa.array(np.zeros(len(own), np.int64)), pa.array(own.view(np.int64)), pa.array(np.zeros(len(own), np.int32))], names=["key", "fp", "off"])
        a, b = [], []
        for width in (64, 32, 16):
            keyed = pa.Table.from_batches(list(simhash._index(width)(iter([rows])))).sort_by([("key", "ascending"), ("fp", "ascending")]).combine_chunks()
            done = pa.Table.from_batches(list(simhash._groups(3)(iter(keyed.to_batches(max_chunksize=50)))))
            mask = done.column("b").is_null()
            near = done.filter(__import__("pyarrow.compute").compute.invert(mask))
            a += near.column("a").to_pylist()
            b += near.column("b").to_pylist()
            left = done.filter(mask)
            if width == 64:
                assert left.num_rows
            rows = pa.RecordBatch.from_arrays([left.column("key").combine_chunks(), left.column("a").combine_chunks(), left.column("off").combine_chunks()], names=["key", "fp", "off"]) if left.num_rows else rows.slice(0, 0)
        pairs = set(zip(a, b))
    else:
        df = spark.createDataFrame([(int(np.uint64(p).view(np.int64)),) for p in prints], "fp bigint")
        pairs = {(r.a, r.b) for r in simhash.links(df, Scratch(spark, "test")).collect()}
    mask64 = (1 << 64) - 1
    assert all(bin((x ^ y) & mask64).count("1") <= 64 for x, y in pairs)
    root = {p: p for p in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x, y in pairs:
        x, y = find(x & mask64), find(y & mask64)
        root[max(x, y)] = min(x, y)
    got = {p: find(p) for p in prints}
    want = {p: p for p in prints}
    changed = True
    while changed:
        changed = False
        for i, x in enumerate(prints):
            for y in prints[i + 1 :]:
                if bin(x ^ y).count("1") <= 3 and want[x] != want[y]:
                    want[x] = want[y] = min(want[x], want[y])
                    changed = True
    assert got == want


def test_components(spark):
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(0, 200) if i % 50] + [(1000, x) for x in range(1001, 1400)] + [(rng.randrange(2000, 2100), rng.randrange(2000, 2100)) for _ in range(80)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a bigint, b bigint"), Scratch(spark, "test")).collect()}
    root = {}
    for a, b in links:
        root.setdefault(a, a), root.setdefault(b, b)
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(root[a], root[b])
            changed |= root[a] != m or root[b] != m
            root[a] = root[b] = m
    assert got == {n: r for n, r in root.items() if n != r}


def test_substring_cases(spark, odd, none):
    got = {}
    for r in substring.remove_repeats(odd).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert sum(map(len, got.values())) == odd.count() and substring.remove_repeats(none).count() == 0
    # the row without an id counts as the smallest, so 1 and 2 lose what it has
    assert [r.n_removed for r in got[1]] == [14] and [r.n_removed for r in got[2]] == [14, 14] and got[None][0].n_removed == 0
    assert got[8][0].kept == "end" and got[6][0].n_removed == 0 and got[3][0].n_words == got[4][0].n_words == got[5][0].n_words == 0


def test_substring_brute_force(spark):
    rng = random.Random(4)
    passages = [[rng.choice("abcdefgh") + str(rng.randrange(40)) for _ in range(rng.randrange(5, 30))] for _ in range(12)]
    rows = []
    for i in range(120):
        words = []
        for _ in range(rng.randrange(0, 5)):
            words += rng.choice(passages) if rng.random() < 0.6 else [f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(1, 9))]
        rows.append((rng.randrange(10**6), " ".join(words) if rng.random() < 0.95 else "zz " * 40))
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substring.remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    least = {}
    for i, t in rows:
        w = t.split()
        for k in range(len(w) - 12):
            least[tuple(w[k : k + 13])] = min(i, least.get(tuple(w[k : k + 13]), i))
    for i, t in rows:
        w = t.split()
        gone = {k + j for k in range(len(w) - 12) if least[tuple(w[k : k + 13])] < i for j in range(13)}
        assert got[i] == (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))


def test_mixing_cases(spark, odd, none):
    drawn = mixing.draw(odd)
    assert sum(r.n_rows for r in drawn.collect()) == odd.count()
    assert all(0 <= r.copies <= 2 for r in drawn.collect())
    assert mixing.draw(none).count() == 0 and mixing.mix(none).count() == 0
    mixed = mixing.mix(odd)
    assert mixed.columns == odd.columns and mixed.count() == sum(r.copies * r.n_rows for r in drawn.collect())


def test_mixing_in_many_blocks(spark):
    rng = random.Random(6)
    rows = [(i, "w " * rng.choice([1, 3, 50, 400]), rng.choice("aaab")) for i in range(3000)]
    drawn = mixing.draw(spark.createDataFrame(rows, "doc_id bigint, text string, source string"), block=100).collect()
    for s in "ab":
        own = [r for r in drawn if r.source == s]
        assert abs(sum(r.size * r.copies for r in own) - own[0].target) < 500


def test_mixing_keeps_every_id(spark):
    """A null id beside ids of 60 bits, and sources by hundreds with one that holds a third."""
    rows = [(2**60 + i, "w " * (i % 9 + 1), "a") for i in range(40)] + [(None, "w w w", "a")]
    drawn = mixing.draw(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect()
    assert sorted(str(r.doc_id) for r in drawn) == sorted(str(r[0]) for r in rows)
    rows = [(i, "w " * (i % 50 + 1), f"s{i % 211:03d}" if i % 3 else None) for i in range(3000)]
    drawn = mixing.draw(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect()
    sizes, taken, target = {}, {}, {}
    for r in drawn:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.size * r.copies
        target[r.source] = r.target
    names = sorted(sizes, key=lambda x: (x is None, x or ""))
    weight = {x: (3, 1, 2)[k % 3] for k, x in enumerate(names)}
    stop, total = set(), 1.5 * sum(sizes.values())
    while True:
        level = (total - sum(2 * sizes[x] for x in stop)) / sum(weight[x] for x in names if x not in stop)
        more = {x for x in names if x not in stop and weight[x] * level >= 2 * sizes[x]}
        if not more:
            break
        stop |= more
    for x in names:
        assert abs(target[x] - (2 * sizes[x] if x in stop else weight[x] * level)) < 1e-6 * total
        assert abs(taken[x] - target[x]) <= 50


def test_flight_keeps_both_balances():
    size = np.array([5, 9, 2, 2, 7, 30, 1, 1, 4, 4, 4, 12])
    p = np.full(len(size), 0.37)
    q = mixing.fly(size, p, random.Random(1))
    assert abs(q.sum() - p.sum()) < 1e-6 and abs((size * q).sum() - (size * p).sum()) < 1e-6
    assert ((q > 0) & (q < 1)).sum() <= 2


def test_token_counts_cases(odd, none):
    from tokenizers import Tokenizer

    path = tok("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    for r in token_counts.count_tokens(odd, path).collect():
        assert r.tokens.n_tokens == len(lib.encode(r.text or "", add_special_tokens=False).ids)
    assert token_counts.count_tokens(none, path).count() == 0


def strings(n, seed):
    pool = ["a", "The", " ", "  ", "\n", "\n\n", "\t", "é", "ß", "'s", "'LL", "\xa0", "\x85", "\x1c", "\u2003", "日本", "1", "22", "½", "²", "!", "...", "<|endoftext|>", "<|", "|>", "😀", "e\u0301", "\u0301", "X", "aaaa", "İ", "ΑΣ", "\r\n", "\u200b", "\ufeff", "\x0b", "\x0c", "\x00", "ǅ", "٣", "ŉ", "ſ", "_"]
    rng = random.Random(seed)
    return ["".join(rng.choice(pool) for _ in range(rng.randrange(20))) for _ in range(n)]


def test_counts_are_the_library_s():
    from tokenizers import Tokenizer

    path, texts = tok("byte_bpe_50k.json"), strings(4000, 1) + ["ab" * 5000, "  " * 2000]
    want = [len(e.ids) for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    assert token_counts.vocabulary(path).count(texts) == want


def test_ids_are_the_library_s():
    from tokenizers import Tokenizer

    path, texts = tok("word_bpe_49k.json"), strings(4000, 2)
    want = [np.array(e.ids, "<u4").tobytes() for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    assert packing.encoder(path).encode(texts) == want


def test_ids_by_a_small_table(monkeypatch):
    """Letters of every case and block in and beside words, with a table that turns over again and again; words that differ only in case are one entry."""
    from tokenizers import Tokenizer

    path = tok("word_bpe_49k.json")
    enc = packing.Encoder(path)
    enc.encode(["Stone, STONE stone"])
    assert b"stone" in enc.words and b"STONE" not in enc.words and b"Stone," not in enc.words
    monkeypatch.setattr(packing, "CACHE", 20)
    texts = [f"{c} a{c}b 1{c}'s {c}{c}'LL '{c} É{c.lower()}é!{c}" for c in [*map(chr, range(0x260)), *"’“…€ⱥⱦ\u2028\u3000ΣςſḰ\u0308"]]
    want = [np.array(e.ids, "<u4").tobytes() for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    assert [enc.encode([x])[0] for x in texts] == want and enc.words.old


def test_copies_side_by_side_are_encoded_once():
    seen = []

    def encode(texts):
        seen.extend(texts)
        return [x.encode("utf-32-le") for x in texts]

    batches, tail = [["a", "a", "", "bcdef"], ["bcdef", "a"], [], ["a", "", ""]], b"\1\0\0\0"
    got = list(packing.cuts(batches, encode, tail, 4))
    assert seen == ["a", "", "bcdef", "a", ""]
    for x, held in zip(sum(batches, []), got, strict=True):
        own = x.encode("utf-32-le") + tail
        assert held == [(k // 16, k // 4, len(own[k : k + 16]) // 4, zlib.crc32(own[k : k + 16])) for k in range(0, len(own), 16)]


def test_line_dedup_cases(spark, odd, none):
    out = line_dedup.dedup_lines(odd)
    assert out.columns == odd.columns and out.count() == odd.count() and line_dedup.dedup_lines(none).count() == 0
    got = {}
    for r in out.collect():
        got.setdefault(r.doc_id, []).append(r)
    assert got[3][0].text is None and got[4][0].text == "" and got[5][0].text == " \t\n"
    assert got[None][0].text.endswith("fifteen") and got[1][0].text == "" and got[1][0].n_chars == 0 and [r.text for r in got[2]] == ["", ""]
    assert got[8][0].text == "" and got[6][0].text == LONG


def brute_lines(rows, t=0.8, least=1):
    seen, gone = [], {}
    for i, text in sorted(rows):
        for k, line in enumerate(text.split("\n")):
            s = set(line.split())
            if len(s) < least:
                continue
            if any(5 * len(s & o) >= 4 * len(s | o) for o in seen):
                gone.setdefault(i, []).append(k)
            seen.append(s)
    return gone


def random_lines(n, seed, words):
    rng = random.Random(seed)
    base = [[rng.choice(words) for _ in range(rng.randrange(3, 16))] for _ in range(25)]
    rows = []
    for i in range(n):
        lines = []
        for _ in range(rng.randrange(1, 7)):
            w = list(rng.choice(base))
            for _ in range(rng.randrange(0, 3)):
                w[rng.randrange(len(w))] = rng.choice(words)
            lines.append(" ".join(w))
        rows.append((i, "\n".join(lines)))
    return rows


def test_line_dedup_brute_force(spark):
    rows = random_lines(150, 3, [f"w{i}" for i in range(60)])
    got = {r.doc_id: r.removed for r in line_dedup.similar_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == brute_lines(rows)


def test_hot_words_make_pair_keys():
    """With every word over the limit, keys are pairs of words, and no similar pair is lost."""
    from fractions import Fraction

    import pyarrow as pa

    rows = random_lines(60, 8, [f"w{i}" for i in range(25)])
    t, rarity, hot = Fraction(4, 5), np.zeros(line_dedup.PLACES, np.uint8), np.ones(line_dedup.PLACES, bool)
    batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows]), pa.array([0] * len(rows)), pa.array([x for _, x in rows])], names=["doc_id", "h", "text"])
    sent = [b for b in line_dedup._send(rarity, hot, t, 5, 3)(iter([batch]))]
    table = pa.Table.from_batches(sent).sort_by("bucket").combine_chunks()
    met = pa.Table.from_batches(list(line_dedup._meet(t)(iter(table.to_batches())))).to_pylist()
    pairs = {frozenset((r["a"], r["b"])) for r in met if r["a"] is not None and r["b"] is not None}
    sets = {}
    for part in ([x.encode() for _, x in rows],):
        h, start, n, _, _, ids, _ = line_dedup.word_sets(part, rarity, 5)
        for k in range(len(n)):
            sets[int(ids[k : k + 1].view(np.int64)[0])] = set(h[start[k] : start[k] + n[k]].tolist())
    names = sorted(sets)
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                assert frozenset((a, b)) in pairs


def test_quality_cases(odd, none):
    got = {}
    for r in quality.judge(odd, to="verdict").collect():
        got.setdefault(r.doc_id, []).append(r.verdict)
    assert all(got[i][0].base_failed and not got[i][0].kept and got[i][0].n_words == 0 for i in (3, 4, 5))
    assert got[6][0].kept and got[1][0].kept and not got[9][0].kept
    assert quality.keep(odd).columns == odd.columns and quality.keep(none).count() == 0
    assert not quality.measure("buy now cheap pills today " * 20)[6] and not quality.measure("\n".join(["one two three four five six"] * 5))[6]


def test_packing_cases(odd, none):
    rows = packing.pack_documents(odd, tok("word_bpe_49k.json")).collect()
    assert len({r.doc_id for r in rows}) == len({r.doc_id for r in odd.collect()})
    assert sorted(r.length for r in rows if r.doc_id in (3, 4, 5)) == [1, 1, 1]
    assert sum(r.piece == 0 for r in rows) == odd.count()
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append(r)
    assert all(sum(r.length for r in b) <= 4096 for b in bins.values())
    assert packing.pack_documents(none, tok("word_bpe_49k.json")).count() == 0


def test_crossover_holds_every_item_once():
    rng = random.Random(4)
    lens = [rng.choice([1400, 1366, 1365, 2048, 700, 3000]) for _ in range(200)]
    one = packing.best_fit(list(range(200)), lens, 4096, [])
    two = packing.best_fit(sorted(range(200), key=lambda i: -lens[i]), lens, 4096, [])
    child = packing.cross(one, two, lens, 4096, rng)
    assert sorted(i for b in child for i in b) == list(range(200)) and all(sum(lens[i] for i in b) <= 4096 for b in child)
    best, _ = packing.evolve(lens, 4096, [], 1, packing.Breeding())
    assert sorted(i for b in best for i in b) == list(range(200)) and len(best) <= len(two)


def test_breeding_beats_best_fit():
    """Bins of three that fill exactly: best-fit decreasing needs more of them than breeding, and so does every packing that breeding begins with."""
    rng = random.Random(3)
    lens = []
    for _ in range(40):
        a, b = rng.randrange(1100, 1500), rng.randrange(1100, 1500)
        lens += [a, b, 4096 - a - b]
    plain = packing.best_fit(sorted(range(len(lens)), key=lambda i: -lens[i]), lens, 4096, [])
    start, none = packing.evolve(lens, 4096, [], 5, packing.Breeding(generations=0))
    bred, crossings = packing.evolve(lens, 4096, [], 5, packing.Breeding(generations=100))
    assert none == 0 and crossings > 0 and sorted(i for b in bred for i in b) == list(range(len(lens)))
    assert max(sum(lens[i] for i in b) for b in bred) <= 4096 and len(bred) < min(len(plain), len(start))


def test_packing_breeds(spark, monkeypatch):
    """On the way from documents to sequences, crossovers happen and the bins come down to the bound."""
    seen = []
    write = packing.Scratch.write

    def watch(self, df, *how):
        out = write(self, df, *how)
        if "crossings" in out.columns:
            seen.append(out.groupBy("block").max("crossings").collect())
        return out

    monkeypatch.setattr(packing.Scratch, "write", watch)
    rng = random.Random(2)
    lens = [rng.choice((30, 200, 700, 1500, 2500)) + rng.randrange(60) for _ in range(1500)]
    packed = packing.pack(spark.createDataFrame(list(enumerate(lens)), "item bigint, length bigint")).collect()
    assert max(r[1] for rows in seen for r in rows) > 0
    assert len(packed) == len(lens) and len({r.sequence_id for r in packed}) <= -(-sum(lens) // 4096) + 1


def test_words():
    for x in (b"", b" ", b"a", b" a ", b"abcdefgh", b"abcdefghi abcdefgh  abcdefghijklmnopqrst\n", "é\xa0 ü".encode()):
        h, s, e = word_hashes(x)
        assert [x[i:j] for i, j in zip(s, e)] == x.split()
    words = [f"w{i}".encode() * (i % 9) + b"x" for i in range(5000)]
    assert len(set(word_hashes(b" ".join(words))[0].tolist())) == len(set(words))
