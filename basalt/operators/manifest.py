"""Stores of runs: versions of a manifest, recovery, backup, verification and vacuum.

A version is a Parquet table of files (number, level, path, n_rows, lo, hi, bytes, last_seq); the newest complete
version directory is current, so a failed writer leaves the one before in place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMA = "number bigint, level int, path string, n_rows bigint, lo string, hi string, bytes bigint, last_seq bigint"
LOG = "k string, seq bigint, op int, v bigint"


class Store:
    """A log as immutable runs under a shared folder."""

    def __init__(self, spark: SparkSession, path: str, log_schema: str = LOG):
        self.spark, self.path, self.log_schema = spark, path.rstrip("/"), log_schema

    def _fs(self):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _p(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def versions(self) -> list[int]:
        """Complete versions, ascending."""
        fs, at = self._fs(), self._p("manifest")
        if not fs.exists(at):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(at)]
        return sorted(int(n[1:]) for n in names if n[0] == "v" and fs.exists(self._p(f"manifest/{n}/_SUCCESS")))

    def files(self, version: int | None = None) -> DataFrame:
        v = self.versions()
        if not v:
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(f"{self.path}/manifest/v{v[-1] if version is None else version}")

    def commit(self, files: DataFrame) -> int:
        """Write a new version; the current one changes when it is complete."""
        new = (self.versions() or [0])[-1] + 1
        # of two writers of one version the second fails, and nothing of the first is lost
        files.select(*[c.split()[0] for c in SCHEMA.split(", ")]).coalesce(1).write.mode("errorifexists").parquet(f"{self.path}/manifest/v{new}")
        return new

    def append(self, rows: DataFrame, level: int = 0) -> int:
        """A run of rows, committed as one file entry."""
        from basalt.sources.files import write_run

        now = self.files()
        number = (now.agg(F.max("number")).first()[0] or 0) + 1
        name = f"{self.path}/run-{number}-{(self.versions() or [0])[-1] + 1}"
        write_run(rows, name)
        back = self.spark.read.parquet(name)
        entry = back.agg(F.count("*").alias("n_rows"), F.min("k").alias("lo"), F.max("k").alias("hi"), F.sum(F.octet_length("k") + 20).cast("long").alias("bytes"), F.max("seq").alias("last_seq"))
        entry = entry.select(F.lit(number).cast("long").alias("number"), F.lit(level).alias("level"), F.lit(name).alias("path"), "n_rows", "lo", "hi", "bytes", "last_seq")
        return self.commit(now.unionByName(entry))

    def read(self, version: int | None = None, lower: str | None = None, upper: str | None = None) -> DataFrame:
        """The log of a version; runs outside the bounds aren't opened."""
        files = self.files(version)
        if lower is not None:
            files = files.filter(F.col("hi") >= lower)
        if upper is not None:
            files = files.filter(F.col("lo") < upper)
        paths = [r[0] for r in files.select("path").collect()]  # runs, a handful by compaction
        return self.spark.read.parquet(*paths) if paths else self.spark.createDataFrame([], self.log_schema)

    def compact(self, level: int = 1, snapshots: tuple[int, ...] = (), operator: object = None) -> int:
        """All runs as one run at the bottom level; deletions with nothing below go. Merge operands stay, or are folded by the ``operator``."""
        from basalt.operators.compact import compact, compact_merged

        own = self.read()
        merged = compact(own, snapshots=snapshots, bottom=True) if operator is None else compact_merged(own, operator, snapshots=snapshots, bottom=True)
        merged = merged.select(*[F.col(c).cast(own.schema[c].dataType).alias(c) for c in merged.columns])
        now = self.files()
        number = (now.agg(F.max("number")).first()[0] or 0) + 1
        if now.count() == 1 and now.first()["level"] >= level and not snapshots:
            return self.versions()[-1]
        from basalt.sources.files import write_run

        name = f"{self.path}/run-{number}-{self.versions()[-1] + 1}"
        write_run(merged, name)
        entry = self.spark.read.parquet(name).agg(F.count("*").alias("n_rows"), F.min("k").alias("lo"), F.max("k").alias("hi"), F.sum(F.octet_length("k") + 20).cast("long").alias("bytes"), F.max("seq").alias("last_seq"))
        return self.commit(entry.select(F.lit(number).cast("long").alias("number"), F.lit(level).alias("level"), F.lit(name).alias("path"), "n_rows", "lo", "hi", "bytes", "last_seq"))

    def garbage(self, keep: int = 1) -> list[str]:
        """Runs that none of the newest ``keep`` versions lists."""
        live = {r[0] for v in self.versions()[-keep:] for r in self.files(v).select("path").collect()}
        found = [f"{self.path}/{s.getPath().getName()}" for s in self._fs().listStatus(self._p("")) if s.getPath().getName().startswith("run-")]
        return sorted(f for f in found if f not in live)

    def vacuum(self, keep: int = 1) -> list[str]:
        """Delete old versions and the runs that only they list."""
        gone, fs = self.garbage(keep), self._fs()
        for v in self.versions()[:-keep]:
            fs.delete(self._p(f"manifest/v{v}"), True)
        for name in gone:
            fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(name), True)
        return gone

    def checksums(self, version: int | None = None) -> DataFrame:
        """Rows and an order-free checksum of each run."""
        out = None
        for r in self.files(version).select("number", "path").collect():
            own = self.spark.read.parquet(r[1])
            own = own.agg(F.count("*").alias("n_rows"), F.bit_xor(F.xxhash64(*own.columns)).alias("checksum")).withColumn("number", F.lit(r[0]))
            out = own if out is None else out.unionByName(own)
        return out

    def destroy(self) -> None:
        self._fs().delete(self._p(""), True)


def backup(store: Store, path: str) -> Store:
    """A copy of the current version elsewhere."""
    other = Store(store.spark, path, store.log_schema)
    for r in store.files().orderBy("number").collect():
        other.append(store.spark.read.parquet(r["path"]), r["level"])
    return other


def restore(copy: Store, path: str) -> Store:
    """A new store elsewhere from a backup, which stays as it is; it fails where a store is already."""
    there = Store(copy.spark, path, copy.log_schema)
    if there.versions():
        raise ValueError(f"{path} holds a store")
    return backup(copy, path)


def verify(one: Store, two: Store) -> DataFrame:
    """Runs whose rows or checksums differ between two stores; none if they agree."""
    a, b = one.checksums().select("n_rows", "checksum"), two.checksums().select("n_rows", "checksum")
    return a.exceptAll(b).unionByName(b.exceptAll(a))


def vacuum_candidates(written: DataFrame, live: DataFrame, number: str = "number") -> DataFrame:
    """Files that were written and that no live version lists."""
    return written.join(live.select(number).distinct(), number, "left_anti")


def replay(records: DataFrame, applied: int = -1) -> DataFrame:
    """Log rows of write-ahead records in order of their sequence numbers, however they were written; repeated records count once."""
    return records.filter(F.col("seq") > applied).dropDuplicates(["seq"])


def stop_at(records: DataFrame, bad: object) -> DataFrame:
    """Replay up to the first record that a filter refuses."""
    first = records.filter(bad).agg(F.min("seq").alias("_stop"))
    return records.crossJoin(F.broadcast(first)).filter(F.col("_stop").isNull() | (F.col("seq") < F.col("_stop"))).drop("_stop")


def reassemble(pieces: DataFrame, stream: str = "log") -> DataFrame:
    """Records from fragments FULL, FIRST, MIDDLE, LAST in order of pos; a record without its LAST is dropped."""
    by = Window.partitionBy(stream).orderBy("pos")
    begun = pieces.withColumn("record", F.sum(F.col("kind").isin("FULL", "FIRST").cast("long")).over(by))
    whole = begun.groupBy(stream, "record").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "data"))), lambda x: x.data), "").alias("data"), F.max(F.col("kind").isin("FULL", "LAST")).alias("_ended"))
    return whole.filter("_ended").drop("_ended")


def properties(log: DataFrame, run: str = "run") -> DataFrame:
    """Entries, deletions, merges and raw sizes of each run."""
    return log.groupBy(run).agg(
        F.count("*").alias("entries"), F.sum((F.col("op") == 0).cast("long")).alias("deletions"), F.sum((F.col("op") == 2).cast("long")).alias("merges"),
        F.sum(F.octet_length("k")).alias("raw_key_bytes"), F.sum("bytes").alias("raw_value_bytes"), F.min("k").alias("lo"), F.max("k").alias("hi"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"),
    )


def approximate_sizes(files: DataFrame, ranges: DataFrame) -> DataFrame:
    """Bytes of the files that meet each range [begin_k, end_k); ranges: id, begin_k, end_k, a short list."""
    near = F.broadcast(ranges)
    return files.join(near, (F.col("lo") < F.col("end_k")) & (F.col("hi") >= F.col("begin_k"))).groupBy("id").agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n_files"))


def store_properties(props: DataFrame) -> DataFrame:
    """Names and values of the whole store from the properties of its runs: a row for each name."""
    one = props.agg(
        F.sum("entries").alias("entries"), F.sum("deletions").alias("deletions"), F.sum("merges").alias("merges"), (F.sum("entries") - 2 * F.sum("deletions")).alias("estimate-num-keys"),
        F.sum("raw_key_bytes").alias("raw-key-bytes"), F.sum("raw_value_bytes").alias("raw-value-bytes"), F.count("*").alias("num-runs"), F.max("last_seq").alias("last-sequence"), F.max("entries").alias("largest-run"),
    )
    return one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("name"), F.col(f"`{c}`").cast("long").alias("value")) for c in one.columns])))


def range_deletes(tombstones: DataFrame, file: str = "file") -> DataFrame:
    """The range tombstones of each file: how many, the range that they span, and the newest; empty ones don't count."""
    some = tombstones.filter(F.col("begin_k") < F.col("end_k"))
    return some.groupBy(file).agg(F.count("*").alias("n"), F.min("begin_k").alias("lo"), F.max("end_k").alias("hi"), F.max("seq").alias("last_seq"))
