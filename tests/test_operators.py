"""Small hand-made cases of the log operators."""

import random

import pytest
from pyspark.sql import functions as F

from basalt.functions import codec, histogram
from basalt.operators import advisor, compact, manifest, merge, resolve, txn
from basalt.sources import files
from basalt.streaming import feeds

LOG = "k string, seq bigint, op int, v bigint"


def model(rows, s=None):
    out = {}
    for k, seq, op, v in sorted(rows, key=lambda r: r[1]):
        if s is None or seq <= s:
            out[k] = (op, v)
    return {k: v for k, (op, v) in out.items() if op not in (0, 7)}


def random_log(n=300, keys=20, seed=1, ops=(0, 1)):
    rng = random.Random(seed)
    return [(f"k{rng.randrange(keys):03d}", i, rng.choice(ops), rng.randrange(1000)) for i in range(n)]


def test_reads_match_a_dictionary(spark):
    rows = random_log()
    log = spark.createDataFrame(rows, LOG)
    for s in (None, 0, 57, 299):
        got = {r.k: r.v for r in resolve.resolve(log, snapshot=s).collect()}
        assert got == model(rows, s)


def test_compaction_keeps_what_snapshots_see(spark):
    rows = random_log(seed=5)
    log = spark.createDataFrame(rows, LOG)
    small = compact.compact(log, snapshots=(50, 200), bottom=True)
    assert small.count() < len(rows)
    for s in (50, 200, None):
        assert {r.k: r.v for r in resolve.resolve(small, snapshot=s).collect()} == model(rows, s)


@pytest.mark.parametrize(
    "stones, want",
    [
        ([("a", "b", 10), ("c", "d", 5)], {"": 0, "a": 10, "b": 0, "c": 5}),
        ([("a", "e", 10), ("c", "g", 15)], {"a": 10, "c": 15, "e": 15, "g": 0}),
        ([("a", "c", 10), ("c", "e", 20), ("c", "e", 5), ("e", "g", 15)], {"a": 10, "c": 20, "e": 15, "g": 0}),
    ],
)
def test_range_tombstones(spark, stones, want):
    t = spark.createDataFrame([("default", *s) for s in stones], "cf string, begin_k string, end_k string, seq bigint")
    pieces = [(r.begin_k, r.end_k, r.seq) for r in resolve.fragments(t).collect()]
    for k, seq in want.items():
        assert max([s for b, e, s in pieces if b <= k < e], default=0) == seq
    live = spark.createDataFrame([(k, 12, 1, 0) for k in want], LOG)
    assert {r.k for r in resolve.mask_ranges(live, t).collect()} == {k for k, s in want.items() if s <= 12}


def test_as_of_takes_rows_of_earlier_ranges(spark):
    table = spark.createDataFrame([(i * 100, i) for i in range(10)], "key bigint, x bigint")
    probes = spark.createDataFrame([(i,) for i in range(-5, 1000, 7)], "p bigint")
    for r in resolve.as_of(probes, table, "p", "key", parts=16).collect():
        assert r.at_key == (None if r.p < 0 else r.p // 100 * 100)


def test_string_append(spark):
    log = spark.createDataFrame([("k1", 1, 2, "v1"), ("k1", 2, 2, "v2"), ("k1", 3, 2, "v3"), ("k2", 4, 1, "a1"), ("k2", 5, 2, "a2"), ("k3", 6, 1, "x"), ("k3", 7, 0, None)], "k string, seq bigint, op int, v string")
    assert {r.k: r.v for r in merge.merged(log, "stringappend").collect()} == {"k1": "v1,v2,v3", "k2": "a1,a2"}


def test_addition_wraps_and_xor_keeps_tails(spark):
    log = spark.createDataFrame([("a", 1, 1, (1 << 63) - 1), ("a", 2, 2, (1 << 63) - 1), ("a", 3, 2, 5)], LOG)
    assert int(merge.merged(log, "uint64add").first().v) == (2 * ((1 << 63) - 1) + 5) % (1 << 64)
    raw = spark.createDataFrame([("a", 1, 1, b"\x01\x02"), ("a", 2, 2, b"\x03\x02\x07")], "k string, seq bigint, op int, v binary")
    assert bytes(merge.merged_by(raw, merge.xor_bytes, "k string, v binary").first().v) == b"\x02\x00\x07"


def test_wide_rows(spark):
    cells = [(1, 0, 5, "tombstone"), (1, 1, 8, "column"), (1, 2, 5, "expiring"), (1, 0, 2, "column"), (1, 1, 5, "expiring"), (1, 2, 7, "tombstone"), (1, 7, 17, "expiring"), (1, 0, 6, "expiring"), (1, 1, 5, "tombstone"), (1, 2, 4, "column"), (1, 11, 11, "tombstone")]
    df = spark.createDataFrame([(*c, 0) for c in cells], "row_id int, idx int, ts bigint, kind string, value int")
    got = {(r.idx, r.ts, r.kind) for r in merge.wide_rows(df).collect()}
    assert got == {(0, 6, "expiring"), (1, 8, "column"), (2, 7, "tombstone"), (7, 17, "expiring"), (11, 11, "tombstone")}


def test_store_survives_versions(spark, tmp_path):
    s = manifest.Store(spark, f"file://{tmp_path}/s")
    one, two = random_log(60, 10, 1), [(k, q + 1000, o, v) for k, q, o, v in random_log(60, 10, 2)]
    s.append(spark.createDataFrame(one, LOG))
    s.append(spark.createDataFrame(two, LOG))
    live = model(one + two)
    assert {r.k: r.v for r in resolve.resolve(s.read()).collect()} == live
    assert {r.k: r.v for r in resolve.resolve(s.read(version=1)).collect()} == model(one)
    other = manifest.backup(s, f"file://{tmp_path}/b")
    assert manifest.verify(s, other).count() == 0
    s.compact()
    assert {r.k: r.v for r in resolve.resolve(s.read()).collect()} == live
    assert len(s.vacuum()) == 2 and s.garbage() == []
    assert {r.k: r.v for r in resolve.resolve(s.read()).collect()} == live


def test_codecs(spark):
    xs = [0, 1, 127, 128, 300, -1, (1 << 63) - 1, -(1 << 63)]
    df = spark.createDataFrame([(x,) for x in xs], "x bigint")
    for r in df.select("x", codec.decode_fixed(codec.encode_fixed(F.col("x"), 8), 8).alias("a"), codec.decode_varint(codec.encode_varint(F.col("x"))).alias("b"), codec.unzigzag(codec.zigzag(F.col("x"))).alias("c")).collect():
        assert r.x == r.a == r.b == r.c
    assert codec.crc32c_of(b"123456789") == 0xE3069283
    c = spark.createDataFrame([(bytearray(b"hello"),)], "b binary").select(codec.crc32c(F.col("b")).alias("c"))
    assert c.select(codec.unmask_crc(codec.mask_crc(F.col("c"))).alias("d"), "c").filter("c = d").count() == 1
    assert codec.separator_of(b"abc1", b"abd9") == b"abc1" and codec.separator_of(b"abc", b"axz") == b"ac" and codec.successor_of(b"\xffa") == b"\xffb"
    s = spark.createDataFrame([("abcd", "abxd"), ("", "a"), ("ab", "ab")], "a string, b string")
    assert [r[0] for r in s.select(codec.common_prefix(F.col("a"), F.col("b"))).collect()] == [2, 0, 2]


def test_histograms_merge(spark):
    df = spark.createDataFrame([(i,) for i in range(1000)], "x bigint")
    h = histogram.histogram(df, "x")
    half = histogram.histogram(df.filter("x < 400"), "x").unionByName(histogram.histogram(df.filter("x >= 400"), "x"))
    back = half.groupBy("bucket").agg(F.sum("n").alias("n"))
    assert {(r.bucket, r.n) for r in back.collect()} == {(r.bucket, r.n) for r in h.collect()}
    p = {r.p: r.value for r in histogram.percentiles(h, [50, 100]).collect()}
    assert abs(p[50.0] - 500) < 60 and p[100.0] == 999


def test_text_and_runs(spark, tmp_path):
    live = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v bigint")
    files.dump_text(live, f"{tmp_path}/t")
    assert {(r.k, r.v) for r in files.load_text(spark, f"{tmp_path}/t").collect()} == {("a", "1"), ("b", "2")}
    files.write_run(spark.createDataFrame(random_log(), LOG), f"{tmp_path}/r", files=3, bloom=True)
    assert files.read_run(spark, f"{tmp_path}/r").count() == 300


def test_streamed_view(spark, tmp_path):
    rows = random_log(100, 8, 3)
    log = spark.createDataFrame(rows, LOG)
    log.filter("seq < 50").write.parquet(f"{tmp_path}/log", mode="append")
    log.filter("seq >= 50").write.parquet(f"{tmp_path}/log", mode="append")
    stream = feeds.read_log(spark, f"{tmp_path}/log", log.schema, 1)
    q = feeds.upsert_view(stream, f"{tmp_path}/view", f"{tmp_path}/cp")
    q.awaitTermination()
    last = max(int(p.name[1:]) for p in (tmp_path / "view").iterdir() if p.name.startswith("b"))
    got = {r.k: r.v for r in spark.read.parquet(f"{tmp_path}/view/b{last}").filter("op <> 0").collect()}
    assert got == model(rows)


def test_empty_log(spark):
    log = spark.createDataFrame([], LOG)
    assert resolve.resolve(log).count() == compact.compact(log).count() == merge.merged(log, "put").count() == 0
    assert resolve.as_of(log.select("k"), log, "k", "k").count() == 0


def test_batches_and_conflicts(spark):
    log = spark.createDataFrame([("a", 1, 1, 1), ("b", 2, 1, 2)], LOG)
    batch = spark.createDataFrame([("a", 0, 0, None), ("c", 1, 1, 3)], "k string, pos bigint, op int, v bigint")
    assert {(r.k, r.v) for r in txn.overlay(log, batch).collect()} == {("b", 2), ("c", 3)}
    writes = spark.createDataFrame([(1, "a", 0), (2, "b", 5)], "txn int, k string, snapshot int")
    assert [r.txn for r in txn.conflicts(writes, log).collect()] == [1]


def test_log_lines(spark):
    lines = spark.createDataFrame([("12 db1 block.cache.miss COUNT : 7",), ("noise",)], "value string")
    r = advisor.parse_log(lines).first()
    assert (r.ts, r.entity, r.stat, r.value) == (12, "db1", "block.cache.miss", 7.0)


def test_entry_without_text_operators(spark, sf):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    names = {n for n in e.queries() if not n.startswith("op") and n != "pipeline"}
    assert names and names - {"blk_policies", "blk_ghost", "trace_sampled"} <= set(e.oracle_sql())


def test_bytes_of_other_letters(spark):
    from basalt.functions import codec

    df = spark.createDataFrame([("日本x", "日木x"), ("éé", "é"), ("", "a"), (None, "a")], "a string, b string")
    a = F.col("a")
    got = df.select(codec.fixed_prefix(a, 4).alias("f"), codec.remove_suffix(a, 1).alias("s"), codec.remove_prefix(a, 2).alias("p"), codec.common_prefix(a, F.col("b")).alias("c")).collect()
    want = [x.encode() if x is not None else None for x in ("日本x", "éé", "", None)]
    for r, x in zip(got, want):
        assert (r.f and bytes(r.f)) == (None if x is None or len(x) < 4 else x[:4])
        assert (r.s is None) == (x is None) and (x is None or (bytes(r.s), bytes(r.p)) == (x[: max(0, len(x) - 1)], x[2:]))
    assert [r.c for r in got][:3] == [5, 2, 0]


def test_checksums_and_varints_of_many(spark):
    import random

    from basalt.functions import codec

    rng = random.Random(1)
    values = [rng.randbytes(rng.choice((0, 1, 7, 300))) for _ in range(50)]
    assert codec.crc32c_all(values).tolist() == [codec.crc32c_of(v) for v in values]
    longs = [0, 1, 127, 128, -1, (1 << 63) - 1, -(1 << 63)] + [rng.randrange(-(1 << 63), 1 << 63) for _ in range(50)]
    rows = spark.createDataFrame([(x,) for x in longs], "x bigint").select("x", codec.encode_varint(F.col("x")).alias("b")).collect()
    assert all(bytes(r.b) == codec.varint_of(r.x) for r in rows)
    x, ok = codec.of_varints([bytes(r.b) for r in rows] + [b"", b"\x80", b"\xff" * 11])
    assert x.tolist()[: len(rows)] == [r.x for r in rows] and ok.tolist() == [True] * len(rows) + [False] * 3


def test_compaction_keeps_what_is_read(spark, tmp_path):
    """Folded reads now and at snapshots are the same before and after each compaction."""
    import random

    from basalt.operators import compact, manifest, resolve

    rng = random.Random(7)
    rows = [(f"k{rng.randrange(8)}", i, rng.choice((0, 1, 2, 2, 2)), rng.randrange(50)) for i in range(200)]
    log = spark.createDataFrame(rows, "k string, seq bigint, op int, v bigint")
    read = lambda x, at: {(r.k, int(r.v)) for r in resolve.folded(x, "uint64add", snapshot=at).collect()}
    for own in (compact.compact(log, snapshots=(60, 120)), compact.compact_merged(log, "uint64add", snapshots=(60, 120)), compact.compact_merged(log, "uint64add", snapshots=(60, 120), bottom=True)):
        for at in (60, 120, 199):
            assert read(own, at) == read(log, at)
    store = manifest.Store(spark, f"file://{tmp_path}/s")
    store.append(log.filter("seq < 100"))
    store.append(log.filter("seq >= 100"))
    store.compact()
    assert read(store.read(), 199) == read(log, 199)
    store.append(spark.createDataFrame([("k1", 500, 2, 1)], "k string, seq bigint, op int, v bigint"))
    store.compact(operator="uint64add")
    assert store.read().filter("op = 2").count() == 0
    copy = manifest.restore(store, f"file://{tmp_path}/t")
    assert manifest.verify(store, copy).count() == 0
    with pytest.raises(ValueError):
        manifest.restore(store, f"file://{tmp_path}/t")


def test_fragments_over_ranges(spark):
    import random

    from basalt.operators import resolve

    rng = random.Random(3)
    rows = [("a" if i % 3 else "b", b, b + rng.randrange(0, 60), rng.randrange(1000)) for i in range(200) for b in [rng.randrange(500)]]
    stones = spark.createDataFrame(rows, "cf string, begin_k bigint, end_k bigint, seq bigint")
    for parts in (1, 2, 7, 64):
        pieces = resolve.fragments(stones, parts).collect()
        for cf in "ab":
            cover = {k: r.seq for r in pieces if r.cf == cf for k in range(r.begin_k, r.end_k)}
            assert sum(r.end_k - r.begin_k for r in pieces if r.cf == cf) == len(cover)
            assert cover == {k: max(s for c, b, e, s in rows if c == cf and b <= k < e) for k in range(600) if any(c == cf and b <= k < e for c, b, e, _ in rows)}


def test_listener_hears_streams(spark, tmp_path):
    import time

    from basalt.streaming import feeds

    heard = feeds.Listener()
    spark.streams.addListener(heard)
    try:
        spark.range(5).write.parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema("id bigint").parquet(f"{tmp_path}/in")
        feeds.run_to_memory(stream, "heard", "append")
        for _ in range(50):
            if any(e[0] == "ended" for e in heard.events):
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(heard)
    assert heard.events[0][0] == "started" and heard.events[-1][0] == "ended" and sum(e[3] for e in heard.events if e[0] == "batch") == 5
