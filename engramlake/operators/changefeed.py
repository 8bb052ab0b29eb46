"""A feed of upserts and deletes brought onto a state, by delete vectors.

Every row of the state and of the feed is an image with a place: a file and a position in it. An
index by key finds the place of the latest image of each entity; all other places are superseded and
their bits are set in the delete vector of their file. A read of the files then filters positions by
the vectors, so that the images themselves are never shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engramlake.functions.bitmaps import RANGE_BITS, bit_is_set, raw_minus
from engramlake.functions.ids import canonical_id
from engramlake.session import checkpointed

UPSERTS = {"MemoryUpsert": "memory", "PersonUpsert": "person"}
DELETES = {"MemoryDelete": "memory", "PersonDelete": "person"}


@dataclass(frozen=True)
class FeedConfig:
    #: Delete vectors, of 4 KB for 32768 rows, are broadcast up to this number (32 MB); beyond it they are joined by a shuffle.
    broadcast_ranges: int = 8192


def placed(df: DataFrame) -> DataFrame:
    """`df`, read from Parquet files, with the place of every row: file and position."""
    return df.select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("position"))


#: What of a log line decides; numbers are read as text first, as some writers quote them.
_OPERATION = """op_id string, hlc struct<wall_ms string, counter string, device_id string>,
 payload struct<type string, id string, memory struct<id string>, person struct<id string>>, broken string"""
_CLOCK = "wall_ms string, counter string, device_id string, broken string"


def _parsed(line: Column, schema: str) -> Column:
    return F.from_json(line, schema, {"columnNameOfCorruptRecord": "broken"})


def _clock(c: Column) -> Column:
    """Clock as a struct that compares by wall_ms, counter, device_id; null without one of the two numbers."""
    wall, counter = (c.getField(k).try_cast("bigint") for k in ("wall_ms", "counter"))
    device = F.coalesce(c.getField("device_id"), F.lit(""))
    return F.when(
        wall.isNotNull() & counter.isNotNull(),
        F.struct(wall.alias("wall_ms"), counter.alias("counter"), device.alias("device_id")),
    )


def feed_images(oplog: DataFrame) -> DataFrame:
    """Images of the log lines: entity_type, entity_id, clock, applied (false: still to be applied),
    alive, op_id, file, position. Null lines, lines that are no complete JSON, lines without clock, id
    or operation id and operations of other types give no row."""
    kind = F.col("o.payload.type")
    types = F.create_map(*[F.lit(x) for kv in (UPSERTS | DELETES).items() for x in kv])
    return (
        oplog.select(_parsed(F.col("line"), _OPERATION).alias("o"), "file", "position")
        .where(kind.isin(*UPSERTS, *DELETES) & F.col("o.broken").isNull())
        .select(
            F.element_at(types, kind).alias("entity_type"),
            canonical_id(F.coalesce("o.payload.memory.id", "o.payload.person.id", "o.payload.id")).alias("entity_id"),
            _clock(F.col("o.hlc")).alias("clock"),
            F.lit(False).alias("applied"),
            kind.isin(*UPSERTS).alias("alive"),
            canonical_id(F.col("o.op_id")).alias("op_id"),
            "file",
            "position",
        )
        .where("entity_id is not null and clock is not null and op_id is not null")
    )


def state_images(state: DataFrame, alive: bool) -> DataFrame:
    """Images, as feed_images gives, of the state before the feed: rows with entity_type, entity_id and, as `line`, a JSON clock."""
    return (
        state.select("entity_type", "entity_id", _parsed(F.col("line"), _CLOCK).alias("o"), "file", "position")
        .where("o.broken is null")
        .select(
            F.lower(F.btrim("entity_type")).alias("entity_type"),
            canonical_id(F.col("entity_id")).alias("entity_id"),
            _clock(F.col("o")).alias("clock"),
            F.lit(True).alias("applied"),
            F.lit(alive).alias("alive"),
            F.lit(None).cast("string").alias("op_id"),
            "file",
            "position",
        )
        .where("entity_type is not null and entity_id is not null and clock is not null")
    )


def latest_places(images: DataFrame) -> DataFrame:
    """The key-to-place index after the feed: for every entity the place of the image that decides.

    The latest clock decides. Of equal clocks the state comes before the feed and a deletion before a
    row, as an operation counts only if it is later than the state; the last tie goes by place. The
    maximum is taken in part before the shuffle, so an entity that a third of the feed names is no
    heavier than another.
    """
    order = F.struct("clock", "applied", (~F.col("alive")).alias("deleted"), "op_id", "file", "position")
    return images.groupBy("entity_type", "entity_id").agg(F.max(order).alias("last")).select(
        "entity_type", "entity_id", F.col("last.file").alias("file"), F.col("last.position").alias("position")
    )


def _by_range(places: DataFrame, name: str) -> DataFrame:
    return places.groupBy("file", F.expr(f"position div {RANGE_BITS}").alias("file_range")).agg(
        F.bitmap_construct_agg((F.col("position") % RANGE_BITS).cast("bigint")).alias(name)
    )


def delete_vectors(rows: DataFrame, latest: DataFrame) -> DataFrame:
    """(file, file_range, deleted): a bitmap for every 32768 rows of a file, with a bit for each place
    that does not hold the latest image of an entity.

    rows, latest: file, position; partial bitmaps are built before the shuffle.
    """
    return (
        _by_range(rows.select("file", "position"), "stored")
        .join(_by_range(latest.select("file", "position"), "live"), ["file", "file_range"], "left")
        .select("file", "file_range", raw_minus("stored", "live").alias("deleted"))
    )


def not_deleted(rows: DataFrame, vectors: DataFrame) -> DataFrame:
    """The placed rows that no delete vector strikes out. `line` is null where the bit is set, so that
    nothing is parsed before the position is known to be read."""
    struck = bit_is_set(F.col("deleted"), (F.col("position") % RANGE_BITS).cast("int"))
    return (
        rows.withColumn("file_range", F.expr(f"position div {RANGE_BITS}"))
        .join(vectors, ["file", "file_range"])
        .withColumn("line", F.when(~struck, F.col("line")))
        .where("line is not null")
        .drop("file_range", "deleted")
    )


def apply_feed(oplog: DataFrame, hlc: DataFrame, tombstones: DataFrame, config: FeedConfig = FeedConfig()) -> DataFrame:
    """The state after the feed: entity_type, entity_id, alive, clock, applied, op_id.

    oplog (line), hlc (entity_type, entity_id, last_hlc), tombstones (entity_type, entity_id,
    deleted_hlc) are read from files. One row for every entity that the state or the feed names;
    op_id is null and applied true where the state before the feed still holds. Order and number of
    arrivals play no role. Null ids and broken clocks are left out; empty tables are allowed.
    """
    sources = (
        (placed(oplog.select("line")), feed_images),
        (placed(hlc.select("entity_type", "entity_id", F.col("last_hlc").alias("line"))), lambda rows: state_images(rows, True)),
        (placed(tombstones.select("entity_type", "entity_id", F.col("deleted_hlc").alias("line"))), lambda rows: state_images(rows, False)),
    )
    places = reduce(DataFrame.union, (rows.select("file", "position") for rows, _ in sources))
    latest = latest_places(reduce(DataFrame.union, (to_images(rows) for rows, to_images in sources)))
    vectors = checkpointed(delete_vectors(places, latest))
    if vectors.count() <= config.broadcast_ranges:
        vectors = F.broadcast(vectors)
    current = reduce(DataFrame.union, (to_images(not_deleted(rows, vectors)) for rows, to_images in sources))
    return current.select("entity_type", "entity_id", "alive", "clock", "applied", "op_id")


def set_by_feed(state: DataFrame) -> DataFrame:
    """(entity_type, entity_id, op_id) of the entities that an operation of the feed left alive."""
    return state.where("alive and not applied").select("entity_type", "entity_id", "op_id")


def feed_report(state: DataFrame) -> DataFrame:
    """(entity_type, set_by, alive, n): how many entities the feed or the state before it decides."""
    return state.groupBy("entity_type", F.when(F.col("applied"), "state").otherwise("feed").alias("set_by"), "alive").agg(F.count("*").alias("n"))
