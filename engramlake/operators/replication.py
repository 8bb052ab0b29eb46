"""Merging of replicated people, patterns and links, and clean-up of tombstones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engramlake.functions.ids import canonical_id
from engramlake.operators.knowledge import beliefs

OPERATION = """op_id string, hlc struct<wall_ms string, counter string, device_id string>, broken string,
 payload struct<type string, id string, source_id string, target_id string, relation string, strength double,
 person struct<id string, display_name string, interaction_count bigint, relationship_to_user string>,
 pattern struct<trigger string, actions array<string>, frequency bigint>,
 belief struct<key string, probability double, last_updated string, observations array<struct<timestamp string, evidence struct<supports boolean, strength double>>>>>"""


def operations(oplog: DataFrame) -> DataFrame:
    """Complete lines of the log, parsed: type, clock, payload, each operation once however often it was sent."""
    o = F.from_json("line", OPERATION, {"columnNameOfCorruptRecord": "broken"}).alias("o")
    rows = oplog.select(o, F.col("device_id").alias("dir_device")).where("o.broken is null and o.op_id is not null")
    clock = F.struct(F.col("o.hlc.wall_ms").try_cast("bigint").alias("wall_ms"), F.col("o.hlc.counter").try_cast("bigint").alias("counter"), F.col("o.hlc.device_id").alias("device_id"))
    parsed = rows.select(canonical_id(F.col("o.op_id")).alias("op_id"), F.col("o.payload.type").alias("type"), clock.alias("clock"), F.col("o.payload").alias("payload"), "dir_device")
    # of one sent again, that of the least folder
    return parsed.groupBy("op_id").agg(F.min_by(F.struct("type", "clock", "payload", "dir_device"), "dir_device").alias("x")).select("op_id", "x.*")


def merged_people(ops: DataFrame) -> DataFrame:
    """(id, display_name, interaction_count, n_ops): descriptions from the latest operation, counts never go back."""
    rows = ops.where("type = 'PersonUpsert'").select(canonical_id(F.col("payload.person.id")).alias("id"), "clock", "payload.person.display_name", "payload.person.interaction_count")
    return rows.where("id is not null").groupBy("id").agg(
        F.max_by("display_name", "clock").alias("display_name"), F.max("interaction_count").alias("interaction_count"), F.count("*").alias("n_ops")
    )


def merged_patterns(ops: DataFrame) -> DataFrame:
    """(trigger, frequency, actions): greatest frequency and all actions of a trigger."""
    rows = ops.where("type = 'PatternUpsert'").select("payload.pattern.trigger", "payload.pattern.actions", "payload.pattern.frequency")
    return rows.groupBy("trigger").agg(F.max("frequency").alias("frequency"), F.sort_array(F.array_distinct(F.flatten(F.collect_set("actions")))).alias("actions"))


def merged_beliefs(ops: DataFrame) -> DataFrame:
    """(key, probability, n, last_updated) of the beliefs: all observations of a key, one for each millisecond (the one of the
    earliest clock), folded anew; the greatest last_updated. Clocks decide nothing else. A key without observations keeps the
    probability of its earliest operation."""
    rows = ops.where("type = 'BeliefUpsert'").select(F.col("payload.belief.key").alias("key"), F.col("payload.belief").alias("b"), "clock", "op_id").where("key is not null")
    whole = rows.groupBy("key").agg(F.min_by("b.probability", F.struct("clock", "op_id")).alias("stored"), F.max(F.to_timestamp("b.last_updated")).alias("last_updated"))
    seen = rows.select("key", "clock", "op_id", F.posexplode("b.observations").alias("at", "o")).withColumn("ts", F.timestamp_millis(F.unix_millis(F.to_timestamp("o.timestamp"))))
    once = seen.where("ts is not null").groupBy("key", "ts").agg(F.min_by("o.evidence", F.struct("clock", "op_id", "at")).alias("e"))
    folded = beliefs(once.select("key", "ts", F.lit(0).alias("seq"), "e.supports", "e.strength"))
    return whole.join(folded, "key", "left").select("key", F.coalesce("probability", "stored").alias("probability"), F.coalesce("n", F.lit(0)).alias("n"), "last_updated")


def merged_links(ops: DataFrame) -> DataFrame:
    """(source_id, target_id, relation, strength): of a link the operation with the latest clock."""
    p = ops.where("type = 'LinkUpsert'").select(canonical_id(F.col("payload.source_id")).alias("source_id"), canonical_id(F.col("payload.target_id")).alias("target_id"), "payload.relation", "payload.strength", "clock", "op_id")
    return p.groupBy("source_id", "target_id", "relation").agg(F.max_by("strength", F.struct("clock", "op_id")).alias("strength"))


def device_report(ops: DataFrame) -> DataFrame:
    """(dir_device, type, n, n_foreign): operations by the folder they came in, and how many name another device."""
    return ops.groupBy("dir_device", "type").agg(F.count("*").alias("n"), F.count_if(F.col("clock.device_id") != F.col("dir_device")).alias("n_foreign"))


def live_tombstones(tombstones: DataFrame, now, days: int = 30) -> DataFrame:
    """Tombstones younger than the time to live, one row for each entity: the latest."""
    young = tombstones.where(F.unix_micros("created_at") >= F.unix_micros(now) - days * 86_400_000_000)
    return young.groupBy(F.lower(F.btrim("entity_type")).alias("entity_type"), canonical_id(F.col("entity_id")).alias("entity_id")).agg(F.max(F.unix_millis("created_at")).alias("created_ms"))


def captured(changes: DataFrame) -> DataFrame:
    """(id, operation) sent to other devices for changes (id, change, privacy): private memories are never sent, archiving is an upsert."""
    operation = F.when(F.col("change") == "deleted", "MemoryDelete").when(F.col("change").isin("stored", "updated", "archived"), "MemoryUpsert")
    return changes.where("privacy <> 'private'").select("id", operation.alias("operation")).where("operation is not null")
