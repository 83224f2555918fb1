"""Written tables that cut lineage.

Every multi-step operator materialises what it will read twice as Parquet in the
folder that all executors share (``spark.checkpoint.dir``). A lost executor then costs
a re-read, not a recomputation, and unlike ``checkpoint()`` the producing plan runs once.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; a temporary folder where it is unset and the master is local."""
    there = spark.conf.get("spark.checkpoint.dir", None)
    if there:
        return there.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="basalt-")
        atexit.register(_rmtree, _own[app])
    return "file://" + _own[app]


def _rmtree(path: str) -> None:
    import shutil

    shutil.rmtree(path, ignore_errors=True)


class Scratch:
    """A folder of written tables for one run of one operator."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/basalt/{name}-{uuid.uuid4().hex}"
        self.n = 0

    def write(self, df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
        """Run ``df`` once, and return what was written."""
        self.n += 1
        path = f"{self.root}/{self.n}"
        out = df.write.option("compression", "zstd")
        (out.partitionBy(*partition_by) if partition_by else out).parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        back.__dict__["_basalt_path"] = path
        return back

    def drop(self, df: DataFrame) -> None:
        """Delete a table that no plan reads any more."""
        path = df.__dict__.get("_basalt_path")
        if path:
            self._delete(path)

    def clear(self) -> None:
        """Delete all of the run's tables, when its result is written elsewhere."""
        self._delete(self.root)

    def _delete(self, path: str) -> None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)


def settle(df: DataFrame, name: str, working: Scratch) -> DataFrame:
    """The rows as a table of their own, after which the tables that they were worked out from go."""
    out = Scratch(working.spark, name).write(df)
    working.clear()
    return out
