"""Line dedup on lines of every number and size."""

import random

import numpy as np
import pytest

from basalt.llm import line_dedup


def test_lines_beyond_a_million():
    """Sets are the same whatever the number of lines before them."""
    n = (1 << 20) + 50
    lines = [f"a{i} b{i} c{i % 7}" for i in range(n)]
    rarity = np.arange(line_dedup.PLACES, dtype=np.uint64).astype(np.uint8) % 60
    whole = line_dedup.word_sets(["\n".join(lines).encode()], rarity, 1)
    assert len(whole[2]) == n and (whole[2] == 3).all()
    for at in (0, n - 60):
        part = line_dedup.word_sets(["\n".join(lines[at : at + 60]).encode()], rarity, 1)
        assert (whole[5][at : at + 60] == part[5]).all() and (whole[6][at : at + 60] == part[6]).all()
        assert (whole[0][3 * at : 3 * at + 180] == part[0]).all()


def test_short_lines_of_the_stage(spark):
    """Equal word sets of any size go, and sets of four words meet those of five; others of few words stay."""
    import corpus_pipeline

    rows = [(1, "All rights reserved.\nHome\na b c d"), (2, "first\nreserved. All rights\nHome Home\na b c d e"), (3, "Home\na b c\na b\n\nb a a"), (4, "f g h i j\nf g h i")]
    docs = spark.createDataFrame([(i, t, len(t)) for i, t in rows], "doc_id bigint, text string, n_chars bigint")
    got = {r.doc_id: r.text for r in corpus_pipeline.lines(spark, docs, "").collect()}
    assert got == {1: rows[0][1], 2: "first", 3: "a b c\na b\n", 4: "f g h i j"}


def test_all_lines_match_brute_force(spark):
    from tests.llm.test_cases import brute_lines

    rng = random.Random(6)
    rows = [(i, "\n".join(" ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(0, 8))) for _ in range(rng.randrange(1, 6)))) for i in range(120)]
    got = {r.doc_id: r.removed for r in line_dedup.similar_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == brute_lines(rows, least=1)


def long_lines(n, seed, words=400):
    """Lines of 20 to 120 words out of a few patterns, many of them near copies of one another."""
    rng = random.Random(seed)
    base = [[f"w{rng.randrange(words)}" for _ in range(rng.choice((20, 45, 60, 120)))] for _ in range(12)]
    rows = []
    for i in range(n):
        lines = []
        for _ in range(rng.randrange(1, 5)):
            w = list(rng.choice(base))
            for _ in range(rng.randrange(0, len(w) // 6)):
                w[rng.randrange(len(w))] = f"w{rng.randrange(words)}"
            lines.append(" ".join(w))
        rows.append((i, "\n".join(lines)))
    return rows


@pytest.mark.parametrize("group, limit, close, beside, doubtful, middle", [(8192, 5000, 3, 128, 48, 256), (20, 10, 1, 2, 1, 6), (8192, 0, 1, 0, 2, 30), (8, 3, 1, 0, 1, 4)])
def test_large_groups_match_brute_force(spark, monkeypatch, group, limit, close, beside, doubtful, middle):
    """Refined keys, few candidates a set and groups without end lose no similar pair."""
    from tests.llm.test_cases import brute_lines

    for name, value in (("GROUP", group), ("LIMIT", limit), ("CLOSE", close), ("BESIDE", beside), ("DOUBTFUL", doubtful), ("MIDDLE", middle)):
        monkeypatch.setattr(line_dedup, name, value)
    rows = long_lines(150, 4)
    want = brute_lines(rows)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {r.doc_id: r.removed for r in line_dedup.similar_lines(docs).collect()} == want
    if group == 20:
        named = docs.selectExpr("format_string('same beginning %05d', doc_id) as doc_id", "text")
        assert {int(r.doc_id[-5:]): r.removed for r in line_dedup.similar_lines(named).collect()} == want
