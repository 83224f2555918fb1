"""Checks and deletions over whole tables, against brute force."""

import random

import pytest

from basalt.plans import catalogue
from basalt.sources import files, logs


@pytest.mark.parametrize("parts", [1, 5, 64])
def test_order_carries_over_ranges(spark, parts):
    rng = random.Random(parts)
    rows = [(rng.choice([None, *range(40)]) if rng.random() < 0.5 else i, i) for i in range(300)]
    got = files.out_of_order(spark.createDataFrame(rows, "k int, pos int").repartition(4), parts=parts)
    want = [b for a, b in zip(rows, rows[1:]) if a[0] is not None and b[0] is not None and a[0] >= b[0]]
    assert got.columns == ["k", "pos"] and sorted(map(tuple, got.collect()), key=lambda r: r[1]) == want


def test_order_without_rows(spark):
    assert files.out_of_order(spark.createDataFrame([], "k int, pos int")).count() == 0


def test_whole_log_is_checked(spark, sf):
    log = sorted((r.seq, r.k) for r in logs.event_log(spark, sf).select("seq", "k").collect())
    got = {r.seq for r in catalogue.QUERIES["sorted_run_check"](spark, sf).collect()}
    assert got == {b[0] for a, b in zip(log, log[1:]) if a[1] >= b[1]} and max(got) > 500


def test_every_part_has_a_tombstone(spark, sf):
    stones = [(r.begin_k, r.end_k, r.seq) for r in catalogue.tombstones(spark, sf).collect()]
    assert len(stones) == logs.table(spark, sf, "part").count()
    newest = {}
    for r in logs.order_log(spark, sf).collect():
        newest[r.k] = max(newest.get(r.k, (r.seq, r.op, r.v)), (r.seq, r.op, r.v))
    live = {(k, seq, v) for k, (seq, op, v) in newest.items() if op not in (0, 7)}
    want = {(k, seq, v) for k, seq, v in live if not any(b <= k < e and s > seq for b, e, s in stones)}
    assert {tuple(r) for r in catalogue.QUERIES["kv_range_delete"](spark, sf).collect()} == want and want and want < live
    cover = lambda k: max((s for b, e, s in stones if b <= k < e), default=None)
    pieces = catalogue.QUERIES["kv_tombstone_fragments"](spark, sf).collect()
    assert {k: r.seq for r in pieces for k in range(r.begin_k, r.end_k)} == {k: cover(k) for k in range(1100) if cover(k) is not None}
