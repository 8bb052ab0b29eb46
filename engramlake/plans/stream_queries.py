"""Queries that run as streams over the given tables, with the same question in SQL."""

import uuid

from pyspark.sql import functions as F

from engramlake.plans.data_quality import ORACLE as QUALITY
from engramlake.sources import table
from engramlake.streaming import replay


def y3_stream_merge(spark, d):
    folder = replay.scratch(spark, f"stream-{uuid.uuid4().hex}")
    state = replay.replayed(spark, f"{d}/sync_oplog.parque[t]", table(spark, d, "sync_hlc"), table(spark, d, "sync_tombstones"), folder)
    return state.select("entity_type", "entity_id", "alive", "clock.wall_ms", "clock.counter", "clock.device_id", "op_id")


def y13_stream_windows(spark, d):
    folder = replay.scratch(spark, f"stream-{uuid.uuid4().hex}")
    lines = spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{d}/events.parque[t]").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    kept = lambda df, i: df.write.mode("overwrite").parquet(f"{folder}/out")  # noqa: E731  the counts so far, one row a window
    replay.event_windows(lines).writeStream.outputMode("complete").foreachBatch(kept).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out").select(F.unix_millis("window_start").alias("window_ms"), "event_type", "n", F.round("total", 4).alias("total"))


QUERIES = {"y3_stream_merge": y3_stream_merge, "y13_stream_windows": y13_stream_windows}
ORACLE = {
    "y3_stream_merge": QUALITY["p2_state"],
    "y13_stream_windows": """SELECT epoch_us(time_bucket(INTERVAL 1 hour, ts)) // 1000 AS window_ms, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events
 GROUP BY time_bucket(INTERVAL 1 hour, ts), event_type""",
}
