"""Scans, lookups and writes of the memory store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def newest(df: DataFrame, limit: int, by: str = "created_at") -> DataFrame:
    """The `limit` rows with the latest `by`, nulls last, ties by id: a distributed top-k, no full sort."""
    return df.orderBy(F.desc_nulls_last(by), "id").limit(limit)


def by_tier(memories: DataFrame, tier: str, limit: int, by: str = "created_at", offset: int = 0) -> DataFrame:
    """Newest of a tier by creation or by ingestion time, with an offset for pages."""
    ordered = memories.where(F.col("tier") == tier).orderBy(F.desc_nulls_last(by), "id")
    return ordered.offset(offset).limit(limit) if offset else ordered.limit(limit)


def by_channel(memories: DataFrame, channel: str, limit: int) -> DataFrame:
    """Newest of a channel, all tiers."""
    return newest(memories.where(F.col("channel") == channel), limit)


def by_tier_and_namespace(memories: DataFrame, tier: str, namespace: str | None, limit: int) -> DataFrame:
    """Newest of a tier in a namespace; no namespace means the whole tier by ingestion time."""
    if namespace is None:
        return by_tier(memories, tier, limit, "ingestion_time")
    return newest(memories.where((F.col("tier") == tier) & (F.col("namespace") == namespace)), limit)


def in_time_range(memories: DataFrame, start: Column, end: Column) -> DataFrame:
    """Created within [start, end], both ends included."""
    return memories.where(F.col("created_at").between(start, end))


def salience_below(memories: DataFrame, threshold: float) -> DataFrame:
    """Strictly below; null scores are not below anything."""
    return memories.where(F.col("salience_score") < threshold)


def lookup(memories: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows whose id stands in `ids` (id)."""
    return memories.join(ids.select("id").distinct(), "id", "left_semi")


def by_content_hash(memories: DataFrame, hashes: DataFrame) -> DataFrame:
    """For each content_hash of `hashes` the least id with it."""
    return memories.join(hashes.select("content_hash").distinct(), "content_hash", "left_semi").groupBy("content_hash").agg(F.min("id").alias("id"))


def by_identity(memories: DataFrame, identity_id: str) -> DataFrame:
    return memories.where(F.col("identity_id") == identity_id)


def upsert(base: DataFrame, changes: DataFrame, key: str = "id") -> DataFrame:
    """`base` with the rows of `changes` in place of those with the same key, and new ones added."""
    return base.join(changes.select(key), key, "left_anti").unionByName(changes, allowMissingColumns=True).select(base.columns)


def delete(base: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return base.join(ids.select(key).distinct(), key, "left_anti")


def set_salience(memories: DataFrame, scores: DataFrame) -> DataFrame:
    """salience_score taken from scores (id, score) where there is one."""
    return memories.join(scores.groupBy("id").agg(F.max("score").alias("_new")), "id", "left").withColumn("salience_score", F.coalesce("_new", "salience_score")).drop("_new")


def upsert_links(links: DataFrame, changes: DataFrame) -> DataFrame:
    """Links (source_id, target_id, relation, strength) where a changed link takes the place of the stored one."""
    return (
        links.withColumn("_at", F.lit(0)).unionByName(changes.withColumn("_at", F.lit(1)))
        .groupBy("source_id", "target_id", "relation").agg(F.max_by("strength", F.struct("_at", "strength")).alias("strength"))
    )


def export_rows(memories: DataFrame, include_archived: bool = True, only_syncable: bool = False) -> DataFrame:
    """Rows of an export: live tiers, archived ones too unless left out, and for a copy to other devices only what is not private."""
    out = memories if include_archived else memories.where("tier <> 'archived'")
    return out.where("privacy <> 'private'") if only_syncable else out


def importable(memories: DataFrame, reserved: str) -> DataFrame:
    """Rows that an import accepts: all but those of the reserved namespace."""
    return memories.where(F.col("namespace").isNull() | (F.col("namespace") != reserved))


def recent_feed(memories: DataFrame, tiers: tuple, per_tier: int = 20) -> DataFrame:
    """Newest per tier, of these the newest overall."""
    w = Window.partitionBy("tier").orderBy(F.desc_nulls_last("created_at"), "id")
    return newest(memories.where(F.col("tier").isin(*tiers)).withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= per_tier).drop("_rn"), per_tier)
