"""Near copies at five-word Jaccard 0.8 or more, against brute force."""

import random

import pytest

import corpus_pipeline
from basalt.llm import similar_texts

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def brute(rows):
    sets = {}
    for i, text in rows:
        w = (text or "").lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and (5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i for i in sets if find(i) == i}


def families():
    rng = random.Random(4)
    rows = [(0, None), (1, ""), (2, " \n"), (3, "one two"), (4, "One two"), (5, "one two three")]
    for _ in range(40):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.choice((60, 300, 900)))]
        for edits in (0, 1, 1, 2, 3, 4):
            copy = list(words)
            for k in rng.sample(range(len(copy)), max(0, len(copy) * edits // 100)):
                copy[k] = f"x{rng.randrange(5000)}"
            rows.append((len(rows), " ".join(copy)))
    return rows


def test_stage_takes_all_near_copies(spark):
    rows = families()
    docs = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in rows], DOCS).repartition(3)
    kept = corpus_pipeline.near_duplicates(spark, docs, "")
    want = brute(rows)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == want
    assert 40 <= len(want) < 240


def test_copies_of_the_threshold_meet():
    """Texts of which 2 % of the words differ, 0.8 alike in shingles of five, share a key in all but a few of a hundred cases."""
    rng = random.Random(1)
    met = 0
    for _ in range(200):
        words = [f"w{rng.randrange(3000)}" for _ in range(300)]
        copy = list(words)
        for k in range(5, 300, 50):
            copy[k] = f"x{rng.randrange(3000)}"
        fp = similar_texts.word_prints([" ".join(words).encode(), " ".join(copy).encode()])
        keys = [{int(k) for key, rows, _ in similar_texts.variants(fp) for k, r in zip(key, rows) if r == i} for i in (0, 1)]
        met += bool(keys[0] & keys[1])
    assert met >= 190


@pytest.mark.parametrize("limit, close", [(32_768, 1), (4, 1)])
def test_large_groups_keep_their_links(spark, monkeypatch, limit, close):
    """Copies of a few patterns, more than a text takes partners, and groups that are indexed again."""
    monkeypatch.setattr(similar_texts, "LIMIT", limit)
    monkeypatch.setattr(similar_texts, "CLOSE", close)
    rng = random.Random(9)
    rows = []
    for _ in range(4):
        words = [f"w{rng.randrange(5000)}" for _ in range(400)]
        for _ in range(25):
            copy = list(words)
            copy[rng.randrange(400)] = f"x{rng.randrange(5000)}"
            rows.append((len(rows), " ".join(copy)))
    docs = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in rows], DOCS)
    assert {r.doc_id for r in similar_texts.first_of_groups(docs).collect()} == brute(rows)
