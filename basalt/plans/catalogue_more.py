"""More registered queries: folded reads and compaction, column families, batches, analytics and byte functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from basalt.functions import codec
from basalt.operators import blocks, compact, manifest, merge, resolve, trace, txn
from basalt.plans.catalogue import WITH, files_of, q, tombstones
from basalt.plans.scratch import Scratch
from basalt.sources import files, logs

# merge operands in reads and compaction

NEWEST = "newest AS (SELECT k, max(seq) AS seq FROM ord GROUP BY k)"


@q(f"WITH {WITH['ord']}, {WITH['rest']}, {NEWEST} SELECT k, n.seq, sum(v)::BIGINT AS v FROM rest r JOIN newest n USING (k) GROUP BY k, n.seq")
def kv_get_merged(spark, d):
    return resolve.folded(logs.order_log(spark, d), "uint64add").select("k", "seq", F.col("v").cast("long").alias("v"))


@q(f"WITH old AS (SELECT * FROM ord WHERE seq <= 500), rest AS (SELECT * FROM (SELECT *, coalesce(max(CASE WHEN op <> 2 THEN seq END) OVER (PARTITION BY k), -1) AS base FROM old) WHERE seq >= base AND op IN (1, 2)) SELECT k, string_agg(v::VARCHAR, ',' ORDER BY seq) AS v FROM rest GROUP BY k".replace("WITH old", f"WITH {WITH['ord']}, old", 1))
def kv_scan_merged(spark, d):
    """An iterator at a snapshot, operands folded."""
    return resolve.scan(resolve.folded(logs.order_log(spark, d), "stringappend", snapshot=500)).select("k", "v")


STRIPED = "striped AS (SELECT *, CASE WHEN seq <= 300 THEN 1 WHEN seq <= 700 THEN 2 ELSE 3 END AS stripe FROM ord), kept AS (SELECT * FROM striped QUALIFY seq >= coalesce(max(CASE WHEN op <> 2 THEN seq END) OVER (PARTITION BY k, stripe), -1)), shaped AS (SELECT k, stripe, max(seq) AS seq, max(CASE WHEN op <> 2 THEN op END) AS base, bool_or(op = 2) AS merges, (sum(v) FILTER (op IN (1, 2)))::BIGINT AS v FROM kept GROUP BY k, stripe)"


@q(f"WITH {WITH['ord']}, {STRIPED} SELECT k, seq, CASE WHEN base = 1 OR (base = 0 AND merges) THEN 1 WHEN base = 0 THEN 0 ELSE 2 END AS op, v FROM shaped")
def compact_merge(spark, d):
    return compact.compact_merged(logs.order_log(spark, d), "uint64add", snapshots=(300, 700)).select("k", "seq", "op", F.col("v").cast("long").alias("v"))


@q(f"WITH {WITH['ord']}, {STRIPED}, low AS (SELECT *, stripe = min(stripe) OVER (PARTITION BY k) AS lowest FROM shaped) SELECT k, seq, CASE WHEN base = 1 OR (base = 0 AND merges) OR (base IS NULL AND lowest) THEN 1 WHEN base = 0 THEN 0 ELSE 2 END AS op, v FROM low WHERE NOT (lowest AND base = 0 AND NOT merges)")
def compact_merge_bottom(spark, d):
    return compact.compact_merged(logs.order_log(spark, d), "uint64add", snapshots=(300, 700), bottom=True).select("k", "seq", "op", F.col("v").cast("long").alias("v"))


# column families


def family_log(spark, d):
    """The event log with the hour's half as column family."""
    return logs.event_log(spark, d).withColumn("cf", F.concat(F.lit("cf"), (F.col("seq") % 3).cast("string")))


FAMILY = "cf AS (SELECT *, 'cf' || (seq % 3) AS cf FROM ev)"


@q(f"WITH {WITH['ev']}, {FAMILY} SELECT cf, k, seq, v FROM (SELECT * FROM cf WHERE seq <= 600 AND cf IN ('cf0', 'cf2') QUALIFY row_number() OVER (PARTITION BY cf, k ORDER BY seq DESC) = 1) WHERE op NOT IN (0, 7)")
def kv_multi_family(spark, d):
    """Iterators of two families at one snapshot."""
    return resolve.families(family_log(spark, d), ["cf0", "cf2"], snapshot=600).select("cf", "k", "seq", "v")


@q(f"WITH {WITH['ev']}, {FAMILY} SELECT 'copy' AS cf, k, seq, op, v FROM cf WHERE cf = 'cf1'")
def family_export_import(spark, d):
    """A family written to a folder of its own, and read back under another name."""
    at = f"{Scratch(spark, 'export').root}/cf1"
    files.export_family(family_log(spark, d).select("cf", "k", "seq", "op", "v"), "cf1", at)
    return files.import_family(spark, at, "copy").select("cf", "k", "seq", "op", "v")


# batches


@q("SELECT o_custkey % 50 AS batch, row_number() OVER (PARTITION BY o_custkey % 50 ORDER BY o_orderkey) - 1 AS pos, CASE o_orderstatus WHEN 'F' THEN 'delete ' || o_custkey WHEN 'P' THEN 'merge ' || o_custkey || ' ' || round(o_totalprice * 100)::BIGINT ELSE 'put ' || o_custkey || ' ' || round(o_totalprice * 100)::BIGINT END AS said FROM orders")
def batch_iterate(spark, d):
    """Batches as arrays of operations, each told to the handler of its kind."""
    log = logs.order_log(spark, d).withColumn("batch", F.col("k") % 50)
    row = F.struct(F.col("seq"), F.col("op"), F.col("k"), F.col("v"))
    batches = log.groupBy("batch").agg(F.sort_array(F.collect_list(row)).alias("ops"))
    k, v = F.col("k").cast("string"), F.col("v").cast("string")
    said = {0: F.concat(F.lit("delete "), k), 1: F.concat_ws(" ", F.lit("put"), k, v), 2: F.concat_ws(" ", F.lit("merge"), k, v)}
    return txn.iterate(batches, said).select("batch", F.col("pos").cast("long").alias("pos"), "said")


# planning


@q("SELECT number FROM fl a WHERE level = 1 AND NOT EXISTS (SELECT 1 FROM fl b WHERE b.level = 2 AND b.lo <= a.hi AND b.hi >= a.lo) AND (SELECT count(*) FROM fl c WHERE c.level = 3 AND c.lo <= a.hi AND c.hi >= a.lo) <= 10", "fl")
def trivial_move(spark, d):
    return compact.trivial_moves(files_of(spark, d), 1, 10).select("number")


@q(f"WITH {WITH['ev']}, runs AS (SELECT *, seq // 1000 AS run FROM ev) SELECT 'entries' AS name, count(*) AS value FROM runs UNION ALL SELECT 'deletions', count(*) FILTER (op = 0) FROM runs UNION ALL SELECT 'merges', count(*) FILTER (op = 2) FROM runs UNION ALL SELECT 'estimate-num-keys', count(*) - 2 * count(*) FILTER (op = 0) FROM runs UNION ALL SELECT 'raw-key-bytes', sum(strlen(k))::BIGINT FROM runs UNION ALL SELECT 'raw-value-bytes', sum(bytes)::BIGINT FROM runs UNION ALL SELECT 'num-runs', count(DISTINCT run) FROM runs UNION ALL SELECT 'last-sequence', max(seq) FROM runs UNION ALL SELECT 'largest-run', max(n) FROM (SELECT count(*) AS n FROM runs GROUP BY run)")
def db_properties(spark, d):
    props = manifest.properties(logs.event_log(spark, d).withColumn("run", F.floor(F.col("seq") / 1000).cast("long")))
    return manifest.store_properties(props)


@q("SELECT p_size % 4 AS file, count(*) AS n, min(p_partkey * 37 % 1000) AS lo, max(p_partkey * 37 % 1000 + p_size % 20) AS hi, max(p_partkey * 13 % 5000) AS last_seq FROM part WHERE p_size % 20 > 0 GROUP BY 1")
def file_range_deletes(spark, d):
    stones = tombstones(spark, d).withColumn("file", F.lit(0))
    p = F.col("p_partkey")
    stones = logs.table(spark, d, "part").select((F.col("p_size") % 4).alias("file"), (p * 37 % 1000).alias("begin_k"), (p * 37 % 1000 + F.col("p_size") % 20).alias("end_k"), (p * 13 % 5000).alias("seq"))
    return manifest.range_deletes(stones)


# traces


@q("WITH p AS (SELECT type, substr(k, 1, 6) AS prefix, count(*) AS n_keys, sum(accesses)::BIGINT AS accesses FROM st GROUP BY ALL), m AS (SELECT *, accesses::DOUBLE / n_keys AS mean_accesses FROM p) SELECT 'accesses' AS list, type, prefix, rank FROM (SELECT *, row_number() OVER (PARTITION BY type ORDER BY accesses DESC, prefix) AS rank FROM m) WHERE rank <= 3 UNION ALL SELECT 'average', type, prefix, rank FROM (SELECT *, row_number() OVER (PARTITION BY type ORDER BY mean_accesses DESC, prefix) AS rank FROM m) WHERE rank <= 3".replace("WITH p", f"WITH {WITH['tr']}, {WITH['st']}, p", 1))
def trace_topk_prefixes(spark, d):
    return trace.top_prefixes(trace.key_stats(logs.trace(spark, d)), 6, 3).select("list", "type", "prefix", "rank")


@q("SELECT type, (ts_us - (SELECT min(ts_us) FROM tr)) // 1000000 AS t, k FROM tr", "tr")
def trace_time_series(spark, d):
    return trace.time_series(logs.trace(spark, d)).select("type", "t", "k")


@q("SELECT seq, k, coalesce(o NOT IN (0), false) AS found, CASE WHEN o NOT IN (0) THEN w END AS v FROM (SELECT *, last_value(CASE WHEN op IS NOT NULL THEN op END IGNORE NULLS) OVER b AS o, last_value(CASE WHEN op IS NOT NULL THEN value_size END IGNORE NULLS) OVER b AS w FROM (SELECT *, CASE WHEN type IN ('signup', 'purchase') THEN 1 WHEN type = 'error' THEN 0 WHEN type = 'click' THEN 2 END AS op FROM tr) WINDOW b AS (PARTITION BY k ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) WHERE type = 'view'", "tr")
def trace_replay_reads(spark, d):
    return trace.replay_reads(logs.trace(spark, d)).select("seq", "k", "found", "v")


@q("WITH e AS (SELECT type, count(*) AS ops, sum(value_size)::BIGINT AS bytes, count(DISTINCT k) AS keys FROM tr GROUP BY ROLLUP (type)) SELECT coalesce(type, 'all') || '.ops' AS name, ops AS value FROM e UNION ALL SELECT coalesce(type, 'all') || '.bytes', bytes FROM e UNION ALL SELECT coalesce(type, 'all') || '.keys', keys FROM e".replace("WITH e", f"WITH {WITH['tr']}, e", 1))
def stat_tickers(spark, d):
    return trace.tickers(logs.trace(spark, d))


@q("SELECT caller, round(count(*) FILTER (level = 0) * 100.0 / count(*), 6) AS l0, round(count(*) FILTER (level = 1) * 100.0 / count(*), 6) AS l1, round(count(*) FILTER (level NOT IN (0, 1)) * 100.0 / count(*), 6) AS l2 FROM bl GROUP BY caller", "bl")
def blk_percent_access(spark, d):
    own = logs.block_trace(spark, d).withColumn("at", F.concat(F.lit("l"), F.least(F.col("level"), F.lit(2)).cast("string")))
    shares = blocks.percent_access(own, "at", ["l0", "l1", "l2"])
    return shares.select("caller", *[F.round(c, 6).alias(c) for c in ("l0", "l1", "l2")])


@q("SELECT caller, bytes // 128 * 128 AS size, count(DISTINCT block) AS n_blocks, count(*) AS accesses FROM bl GROUP BY ALL", "bl")
def blk_size_histogram(spark, d):
    return blocks.block_sizes(logs.block_trace(spark, d), 128)


@q("SELECT level, count(*) FILTER (seq % 5 > 0) AS existing, count(*) FILTER (seq % 5 = 0) AS missing, count(DISTINCT block) FILTER (seq % 5 > 0) AS blocks_existing, count(DISTINCT block) FILTER (seq % 5 = 0) AS blocks_missing, round(count(*) FILTER (seq % 5 > 0) * 100.0 / count(*), 6) AS percent_existing FROM bl GROUP BY level", "bl")
def blk_data_access(spark, d):
    return blocks.data_access(logs.block_trace(spark, d), F.col("seq") % 5 > 0).withColumn("percent_existing", F.round("percent_existing", 6))


# functions


@q("SELECT doc_id, hex(text::BLOB[1:7]) AS capped, hex(text::BLOB[4:]) AS tail, CASE WHEN strlen(text) >= 9 THEN hex(text::BLOB[1:9]) END AS fixed FROM (SELECT doc_id, encode(text) AS text FROM documents)".replace("::BLOB", "").replace("strlen(text)", "octet_length(text)"))
def fn_bytes(spark, d):
    t = F.col("text")
    return logs.table(spark, d, "documents").select("doc_id", F.hex(codec.capped_prefix(t, 7)).alias("capped"), F.hex(codec.remove_prefix(t, 3)).alias("tail"), F.hex(codec.fixed_prefix(t, 9)).alias("fixed"))


@q("SELECT c_custkey, c_name AS back, true AS sliced, true AS cut_is_null, c_custkey * 86400 AS ts, (c_custkey * 86400 + 100) < 500000 AS stale, true AS stripped FROM customer")
def fn_ttl_slices(spark, d):
    """Values with a time behind them, and slices behind their length; times of keys from 49,711 on need more than four bytes."""
    n, ts = F.col("c_name"), F.col("c_custkey") * 86400
    dated, slice_ = codec.append_ts(n, ts, 8), codec.encode_slice(n.cast("binary"))
    short = F.substring(slice_, F.lit(1), F.octet_length(slice_) - 1)
    return logs.table(spark, d, "customer").select(
        "c_custkey", codec.strip_ts(dated, 8).cast("string").alias("back"), (codec.decode_slice(slice_) == n.cast("binary")).alias("sliced"), codec.decode_slice(short).isNull().alias("cut_is_null"),
        codec.ts_of(dated, 8).alias("ts"), codec.is_stale(codec.ts_of(dated, 8), 100, 500_000).alias("stale"), (F.octet_length(dated) == F.octet_length(n) + 8).alias("stripped"),
    )


@q("SELECT event_id, strftime(ts, '%Y/%m/%d-%H:%M:%S') AS at FROM events")
def fn_time_text(spark, d):
    seconds = F.floor(logs.micros("ts") / 1_000_000).cast("long")
    return logs.table(spark, d, "events").select("event_id", codec.time_text(seconds).alias("at"))
