"""Cases that only larger or odd tables have: small tables with such keys, and small chunks."""

import duckdb
import pytest

from basalt.plans import catalogue
from tests.compare import rows


def agree(name, spark, folder, **tables):
    """A query and its SQL over tables given as SELECTs."""
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t, select in tables.items():
        con.execute(f"COPY ({select}) TO '{folder}/{t}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    got, want = catalogue.QUERIES[name](spark, str(folder)).toPandas(), con.execute(catalogue.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
    return got


def test_times_beyond_four_bytes(spark, tmp_path):
    agree("fn_ttl_slices", spark, tmp_path, customer="SELECT unnest([1, 49710, 49711, 900000]::BIGINT[]) AS c_custkey, 'n' AS c_name")


def test_four_bytes_refuse_what_they_cannot_hold(spark):
    from pyspark.sql import functions as F

    from basalt.functions import codec

    df = spark.createDataFrame([((1 << 32) - 1,), (1 << 32,)], "t bigint")
    kept = df.filter("t < 4294967296").select(codec.ts_of(codec.append_ts(F.lit("v"), F.col("t"))).alias("t")).collect()
    assert kept[0].t == (1 << 32) - 1
    with pytest.raises(Exception, match="beyond 4 bytes"):
        df.select(codec.append_ts(F.lit("v"), F.col("t"))).collect()


EVENT = "TIMESTAMP '2024-01-01' AS ts, 1.5 AS value, '{}' AS props"


def test_ingested_files_keep_their_number(spark, tmp_path):
    """Events beyond the files' number are newer than the files."""
    events = f"SELECT unnest([5, 1000001, 1000002]::BIGINT[]) AS event_id, unnest([2, 2, 4]::BIGINT[]) AS user_id, unnest(['click', 'signup', 'error']) AS event_type, {EVENT}"
    got = agree("ingest_overlay", spark, tmp_path, events=events, customer="SELECT unnest([1, 2, 3]::BIGINT[]) AS c_custkey, 7.25 AS c_acctbal")
    assert {r.k: r.v for r in got.itertuples()} == {"u000002": 150, "u000006": 725}


def test_one_row_of_a_key_that_files_hold_twice(spark, tmp_path):
    """Keys are cut at six figures, so that customers 50,000 and 500,000 share one; the later row is taken."""
    con = duckdb.connect()
    con.execute(f"COPY (SELECT unnest([50000, 500000]::BIGINT[]) AS c_custkey, unnest([1.0, 2.0]) AS c_acctbal) TO '{tmp_path}/customer.parquet' (FORMAT parquet)")
    con.execute(f"COPY (SELECT 1000000::BIGINT AS event_id, 100000::BIGINT AS user_id, 'error' AS event_type, {EVENT}) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    assert [tuple(r) for r in catalogue.QUERIES["ingest_overlay"](spark, str(tmp_path)).collect()] == [("u100000", 200)]


def test_coverage_counts_entries_of_the_space(spark, tmp_path):
    events = f"SELECT unnest([1, 2, 3]::BIGINT[]) AS event_id, unnest([100000, 100000, 7]::BIGINT[]) AS user_id, 'view' AS event_type, {EVENT}"
    got = agree("trace_keyspace_coverage", spark, tmp_path, events=events, customer="SELECT unnest([33334, 333334, 333335, 2]::BIGINT[]) AS c_custkey")
    assert got.n_keys[0] == 4


def test_circles_longer_than_the_depth(spark):
    from basalt.operators import txn

    def circle(start, n):
        return [(start + i, start + (i + 1) % n) for i in range(n)]

    waits = spark.createDataFrame(circle(0, 9) + circle(100, 5) + circle(200, 1) + circle(300, 4) + [(400, 100), (401, 0), (402, None)], "txn long, waits_for long")
    whole = {r.txn for r in txn.deadlocked(waits).collect()}
    assert whole == {*range(9), *range(100, 105), 200, *range(300, 304)}
    assert {r.txn for r in txn.deadlocked(waits, depth=5).collect()} == whole - set(range(9))


def a_trace(n, blocks, seed):
    import random

    rng = random.Random(seed)
    return [(rng.choice([None, "a", "a", "b"]), i, rng.randrange(n // 2), rng.randrange(blocks), rng.randrange(1, 9)) for i in range(n)]


def test_distances_over_many_chunks(spark):
    """Blocks whose bytes change, equal times, a part without a name: as counted access by access."""
    from basalt.operators import blocks

    rows_ = a_trace(700, 60, 3)
    want, seen = {}, {}
    for part, seq, ts, block, size in sorted(rows_, key=lambda r: (r[2], r[1])):
        held = seen.setdefault(part, [])
        at = next((i for i in range(len(held) - 1, -1, -1) if held[i][0] == block), None)
        between = dict(held[at + 1 :]) if at is not None else None
        want[seq] = (part, block, *((None, None) if at is None else (len(between), sum(between.values()))))
        held.append((block, size))
    trace = spark.createDataFrame(rows_, "caller string, seq long, ts_us long, block long, bytes long")
    for chunk in (16, 1 << 17):
        got = {r.seq: (r.caller, r.block, r.unique_blocks, r.unique_bytes) for r in blocks.distances(trace, chunk=chunk).collect()}
        assert got == want


def test_no_task_holds_more_than_its_chunks(spark, monkeypatch):
    """Fails where a part's accesses are handed over whole."""
    from basalt.operators import blocks

    counted, called = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)
    inner = blocks._with_overtaken

    def noted(held, *rest):
        called.add(1)
        counted.add(held.num_rows > 32)
        return inner(held, *rest)

    monkeypatch.setattr(blocks, "_with_overtaken", noted)
    trace = spark.createDataFrame([("a", i, i, i % 7, 1) for i in range(500)], "caller string, seq long, ts_us long, block long, bytes long")
    assert blocks.distances(trace, chunk=16).count() == 500 and counted.value == 0 and called.value > 0


@pytest.mark.parametrize("name", ["lru", "mru", "lfu", "opt", "arc", "ghost"])
def test_caches_take_accesses_in_pieces(name):
    """The misses are those of one piece, and what a cache holds is as large as its capacity, not as its trace."""
    import random

    from basalt.operators import blocks

    rng = random.Random(5)
    trace = [min(rng.randrange(40), rng.randrange(40)) for _ in range(5000)]
    after, seen = [0] * len(trace), {}
    for i in range(len(trace) - 1, -1, -1):
        after[i] = seen.get(trace[i], blocks.NEVER)
        seen[trace[i]] = i
    make = blocks.POLICIES.get(name, blocks._ghost)
    whole, parts = make(8), make(8)
    misses = 0
    for i in range(0, len(trace), 7):
        misses += parts(trace[i : i + 7], after[i : i + 7])
        assert all(len(c.cell_contents) <= 96 for c in parts.__closure__ if hasattr(c.cell_contents, "__len__"))
    assert misses == whole(trace, after)


def test_pairs_of_locks_are_dealt(spark):
    """All pairs once, also those of one range, and no task has them all."""
    import random

    from basalt.operators import txn

    rng = random.Random(2)
    held = [(i, lo := rng.choice([3, 3, 3, rng.randrange(50)]), lo + rng.randrange(4)) for i in range(120)]
    locks = spark.createDataFrame(held, "txn long, lo long, hi long")
    from pyspark.sql import functions as F

    got = txn.lock_overlaps(locks, [10, 20, 30], cell=8).withColumn("task", F.spark_partition_id()).collect()
    want = sorted((a, b) for a, l, h in held for b, m, i in held if a < b and l <= i and m <= h)
    assert sorted((r.one, r.two) for r in got) == want
    tasks = [r.task for r in got]
    assert max(tasks.count(t) for t in set(tasks)) < len(want) * 0.6


def test_values_without_a_blob_are_dealt(spark):
    from pyspark.sql import functions as F

    from basalt.sources import files

    log = spark.range(4000).select(F.col("id").alias("k"), F.when(F.col("id") % 10 == 0, F.lit(None)).when(F.col("id") % 10 == 1, F.lit("long" * 9)).otherwise(F.concat(F.lit("v"), F.col("id"))).alias("v"))
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    old = {c: spark.conf.get(c) for c in conf}
    for c, v in conf.items():
        spark.conf.set(c, v)
    try:
        back = files.join_blobs(*files.split_blobs(log, 20))
        got = back.select("k", "v", F.spark_partition_id().alias("task")).collect()
        tasks = [r.task for r in got]
        assert max(tasks.count(t) for t in set(tasks)) < 2000
        assert sorted((r.k, str(r.v)) for r in got) == sorted((r.k, str(r.v)) for r in log.collect())
    finally:
        for c, v in old.items():
            spark.conf.set(c, v)


def test_curve_over_many_chunks_is_the_simulated_cache(spark):
    from basalt.operators import blocks

    trace = spark.createDataFrame(a_trace(600, 30, 9), "caller string, seq long, ts_us long, block long, bytes long")
    curve = {tuple(r) for r in blocks.lru_curve(blocks.distances(trace, chunk=16), [4, 16]).select("caller", "capacity", "accesses", "misses").collect()}
    assert curve == {tuple(r) for r in blocks.simulate(trace, ["lru"], [4, 16]).select("caller", "capacity", "accesses", "misses").collect()}
