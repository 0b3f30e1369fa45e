"""Structured Streaming over an event log of Parquet files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from ..sources.tables import new_path


class Changes(StreamingQueryListener):
    """Tells subscribers what streams do: each is called with (kind, query id, rows of the batch) when a stream starts
    (kind `started`), has done a batch (`progress`) or ends (`ended`). subscribe() returns a call that takes one off; a
    subscriber that fails doesn't keep others from being told."""

    def __init__(self, spark: SparkSession):
        self.subscribers: list[Callable[[str, str, int], None]] = []
        spark.streams.addListener(self)

    def subscribe(self, each: Callable[[str, str, int], None]) -> Callable[[], None]:
        self.subscribers.append(each)
        return lambda: self.subscribers.remove(each) if each in self.subscribers else None

    def _tell(self, kind: str, query: str, rows: int = 0) -> None:
        for each in list(self.subscribers):
            try:
                each(kind, query, rows)
            except Exception:  # noqa: BLE001, S112: a subscriber's own trouble
                continue

    def onQueryStarted(self, event) -> None:  # noqa: N802
        self._tell("started", str(event.id))

    def onQueryProgress(self, event) -> None:  # noqa: N802
        self._tell("progress", str(event.progress.id), event.progress.numInputRows)

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self._tell("ended", str(event.id))


def files(spark: SparkSession, path: str) -> DataFrame:
    """Parquet files as a stream, as they are."""
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)


def source(spark: SparkSession, path: str) -> DataFrame:
    """Event files as a stream; ts becomes an event time with a watermark of an hour."""
    schema = spark.read.parquet(path).schema
    found = spark.readStream.schema(schema).parquet(path)
    return found.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "1 hour")


def run_to_end(stream: DataFrame, name: str, mode: str, each: Callable[[DataFrame, str, int], None] | None = None, out: str | None = None) -> DataFrame:
    """Runs a stream over what is there now and returns what it wrote. Batches are written under their numbers, so
    one that runs again after a failure replaces itself; mode complete keeps the last batch only. out: the folder of an
    earlier run, from whose checkpoint this one goes on."""
    spark = stream.sparkSession
    out = out or new_path(spark, f"stream-{name}")

    def put(batch: DataFrame, number: int) -> None:
        at = 0 if mode == "complete" else number
        if each:
            each(batch, out, at)
        else:
            batch.write.mode("overwrite").parquet(f"{out}/rows/n={at}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).foreachBatch(put).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/rows/n=*")


def hourly(stream: DataFrame) -> DataFrame:
    return stream.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("hour"), "event_type", "n", "total")


def user_sessions(stream: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Sessions of each user that the watermark has closed."""
    s = stream.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return s.select("user_id", F.col("w.start").alias("begin"), "n")
