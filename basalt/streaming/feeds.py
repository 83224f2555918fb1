"""Change feeds and views that follow a log, as Structured Streaming queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener
from pyspark.sql.types import StructType


def changes_since(log: DataFrame, seq: int) -> DataFrame:
    """Rows from a sequence number on; the same filter serves a table and a stream."""
    return log.filter(F.col("seq") >= seq)


def read_log(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int | None = None) -> DataFrame:
    """The log as a stream of its files; fewer files a trigger hold the source back."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).parquet(path)


def latest_stream(log: DataFrame) -> DataFrame:
    """The newest version of each key so far; run it in complete or update mode."""
    newest = F.max_by(F.struct("op", "v"), "seq")
    return log.groupBy("k").agg(F.max("seq").alias("seq"), newest.alias("n")).select("k", "seq", "n.op", "n.v")


def upsert_view(log: DataFrame, path: str, checkpoint: str):
    """Start a query that keeps a table of the newest versions, one complete directory for each batch; a batch that is run again gives the same directory."""
    spark = log.sparkSession

    def apply(batch: DataFrame, number: int) -> None:
        before = None
        for n in range(number - 1, -1, -1):
            try:
                before = spark.read.parquet(f"{path}/b{n}")
                break
            except Exception as e:  # noqa: BLE001
                if "PATH_NOT_FOUND" not in str(e):
                    raise
        rows = batch.select("k", "seq", "op", "v") if before is None else batch.select("k", "seq", "op", "v").unionByName(before)
        newest = Window.partitionBy("k").orderBy(F.col("seq").desc())
        rows.withColumn("_rn", F.row_number().over(newest)).filter("_rn = 1").drop("_rn").write.mode("overwrite").parquet(f"{path}/b{number}")

    return log.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def rates(events: DataFrame, time: str, width: str, late: str) -> DataFrame:
    """Operations in tumbling windows by type, with late rows let in for a while."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), "type").agg(F.count("*").alias("n"))


def run_to_memory(df: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Run a stream to the end of what is there, and return what it made."""
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


class Listener(StreamingQueryListener):
    """Events of the session's streams in order: (started, id), (batch, id, number, rows) and (ended, id, error).

    Register it with ``spark.streams.addListener``; ``on_event`` is called with each, too.
    """

    def __init__(self, on_event: Callable[[tuple], None] | None = None):
        self.events: list[tuple] = []
        self.on_event = on_event

    def _tell(self, *event: object) -> None:
        self.events.append(event)
        if self.on_event:
            self.on_event(event)

    def onQueryStarted(self, event) -> None:
        self._tell("started", str(event.id))

    def onQueryProgress(self, event) -> None:
        self._tell("batch", str(event.progress.id), event.progress.batchId, event.progress.numInputRows)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self._tell("ended", str(event.id), event.exception)
