"""Structured Streaming front ends: the change feed merged batch by batch, and running counts of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from engramlake.operators import changefeed
from engramlake.session import shared_folder

OPLOG = T.StructType([
    T.StructField("device_id", T.StringType()), T.StructField("file_name", T.StringType()), T.StructField("line_no", T.LongType()),
    T.StructField("line", T.StringType()), T.StructField("received_at", T.TimestampType()),
])
STATE = "entity_type string, entity_id string, clock struct<wall_ms:bigint,counter:bigint,device_id:string>, applied boolean, alive boolean, op_id string"


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder on the storage that all executors share."""
    return f"{shared_folder(spark).rstrip('/')}/{name}"


def latest(images: DataFrame) -> DataFrame:
    """The image of each entity that decides; the same order as in the batch operator."""
    order = F.struct("clock", "applied", (~F.col("alive")).alias("deleted"), "op_id")
    return images.groupBy("entity_type", "entity_id").agg(F.max(order).alias("last")).select(
        "entity_type", "entity_id", "last.clock", "last.applied", (~F.col("last.deleted")).alias("alive"), "last.op_id"
    )


class StateTable:
    """A base of one image for each entity and, for each micro-batch, a folder with the latest images of its entities.

    A batch writes only what it brings, and one that is run again overwrites its own folder, so each change is applied once. The
    state is the latest image over the base and all batches; `compact` makes it the new base, from which later batches count.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.base, self.first, self.last = spark, path, f"{path}/base=0", 0, -1

    def start(self, state: DataFrame) -> None:
        state.write.mode("overwrite").parquet(self.base)

    def merge(self, lines: DataFrame, batch: int) -> None:
        images = changefeed.feed_images(lines.withColumn("file", F.lit("")).withColumn("position", F.lit(0).cast("bigint")))
        latest(images).write.mode("overwrite").parquet(self._at(batch))
        self.last = max(self.last, batch)

    def read(self) -> DataFrame:
        paths = [self.base, *(self._at(i) for i in range(self.first, self.last + 1))]
        return latest(self.spark.read.schema(STATE).parquet(*paths))

    def compact(self) -> None:
        new = f"{self.path}/base={self.last + 1}"
        self.read().write.mode("overwrite").parquet(new)
        self.base, self.first = new, self.last + 1

    def _at(self, batch: int) -> str:
        return f"{self.path}/batch={batch:010d}"


def base_state(hlc: DataFrame, tombstones: DataFrame) -> DataFrame:
    """The state before the feed, one image for each entity."""
    def placed(df, c):
        return df.select("entity_type", "entity_id", F.col(c).alias("line"), F.lit("").alias("file"), F.lit(0).cast("bigint").alias("position"))

    images = changefeed.state_images(placed(hlc, "last_hlc"), True).union(changefeed.state_images(placed(tombstones, "deleted_hlc"), False))
    return latest(images)


def merge_stream(lines: DataFrame, state: StateTable, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Merges a stream of log lines into the state: what has arrived, once, or for good at an interval ("30 seconds").

    No watermark: late operations are not dropped, they lose by their clock. The result does not depend on how lines fall into batches.
    """
    writer = lines.writeStream.foreachBatch(lambda df, i: state.merge(df, i)).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def oplog_stream(spark: SparkSession, path: str, files_per_batch: int = 4) -> DataFrame:
    """Lines of the oplog files under `path` as they appear. Files must be published whole; a file that still grows
    would be read once only, so writers rotate to a new file."""
    return spark.readStream.schema(OPLOG).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def replayed(spark: SparkSession, oplog: str, hlc: DataFrame, tombstones: DataFrame, folder: str) -> DataFrame:
    """The state after streaming all files under `oplog` once."""
    table = StateTable(spark, f"{folder}/state")
    table.start(base_state(hlc, tombstones))
    merge_stream(oplog_stream(spark, oplog), table, f"{folder}/checkpoint").awaitTermination()
    return table.read()


def event_windows(events: DataFrame, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(window_start, event_type, n, total) of an event stream. Written in append or update mode, events later than `late` are left
    out as the watermark passes; in complete mode all count and every window comes out."""
    w = F.window("ts", size)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")
