"""Decay, salience, archiving, promotion and sessions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engramlake.operators.rendering import canonical_text


@dataclass(frozen=True)
class DecayConfig:
    rate: float = 0.693
    temporary: tuple = (12.0, 24.0)
    normal: tuple = (72.0, 144.0)
    permanent_floor: float = 0.8
    least_change: float = 0.001


def hours(later: Column, earlier: Column) -> Column:
    """Whole hours between two timestamps, cut off, 0 at least."""
    return F.greatest(F.lit(0), F.floor((F.unix_micros(later) - F.unix_micros(earlier)) / 3_600_000_000))


def unit(c: Column) -> Column:
    """A score within [0, 1]; NaN as 0.5."""
    return F.when(F.isnan(c), 0.5).otherwise(F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0)))


def effective_salience() -> Column:
    c = F.col
    return c("base_score") * c("emotional") * c("access_boost") * c("decay_factor")


def frecency(now: Column) -> Column:
    """How often and how recently a memory was recalled, half each."""
    return 0.5 * (1 - F.exp(-F.col("access_count") / 5.0)) + 0.5 * F.exp(-hours(now, F.col("last_accessed")) / 168.0)


def decayed(memories: DataFrame, now: Column, config: DecayConfig = DecayConfig()) -> DataFrame:
    """`memories` with new_factor and new_salience: exponential decay by hours since the last access, slower for
    salient ones; permanent memories are only lifted to the floor."""
    def life(p):
        return F.lit(p[0]) + F.lit(p[1]) * F.col("base_score")

    half = F.when(F.col("durability") == "temporary", life(config.temporary)).otherwise(life(config.normal))
    fading = F.greatest(F.lit(0.01), F.least(F.lit(1.0), F.exp(-hours(now, F.col("last_accessed")) * config.rate / half)))
    factor = F.when(F.col("durability") == "permanent", F.greatest(F.col("decay_factor"), F.lit(config.permanent_floor))).otherwise(fading)
    return memories.withColumn("new_factor", factor).withColumn("new_salience", F.col("base_score") * F.col("emotional") * F.col("access_boost") * F.col("new_factor"))


def decay_changes(memories: DataFrame, now: Column, config: DecayConfig = DecayConfig()) -> DataFrame:
    """Episodic memories whose factor changes by more than the least change."""
    return decayed(memories.where("tier = 'episodic'"), now, config).where(F.abs(F.col("new_factor") - F.col("decay_factor")) > config.least_change)


def touched(memories: DataFrame, now: Column) -> DataFrame:
    """Recalled once more: count + 1, boost 1 + ln(count) / 10, last access now."""
    n = F.col("access_count") + 1
    return memories.withColumn("access_boost", 1 + 0.1 * F.ln(n)).withColumn("access_count", n).withColumn("last_accessed", now).withColumn("effective", effective_salience())


def sweep(memories: DataFrame, threshold: float = 0.05) -> DataFrame:
    """Episodic memories that have faded below the threshold, as archived."""
    return memories.where((F.col("tier") == "episodic") & (F.col("effective") < threshold)).withColumn("tier", F.lit("archived"))


def auto_archive(memories: DataFrame, now: Column, days: int = 30, threshold: float = 0.3) -> DataFrame:
    """Faint, old, not permanent and not yet archived memories."""
    old = F.unix_micros(F.col("ingestion_time")) < F.unix_micros(now) - days * 86_400_000_000
    return memories.where((F.col("tier") != "archived") & (F.col("effective") < threshold) & old & (F.col("durability") != "permanent"))


def promotion_groups(memories: DataFrame, least: int = 3) -> DataFrame:
    """(group_key, n, template, base_score): episodic contents that occur at least `least` times, letter case aside; the oldest member is the template."""
    rows = memories.where("tier = 'episodic'").withColumn("group_key", F.lower(canonical_text())).where("group_key is not null")
    return (
        rows.groupBy("group_key").agg(F.count("*").alias("n"), F.min_by("id", F.struct("created_at", "id")).alias("template"), F.min_by("base_score", F.struct("created_at", "id")).alias("base"))
        .where(F.col("n") >= least).select("group_key", "n", "template", F.least(F.col("base") * 1.5, F.lit(1.0)).alias("base_score"))
    )


def promoted_links(memories: DataFrame, least: int = 3) -> DataFrame:
    """(source_id, target_id, relation) from each member of a promoted group to its template."""
    groups = promotion_groups(memories, least).select("group_key", "template")
    rows = memories.where("tier = 'episodic'").select("id", F.lower(canonical_text()).alias("group_key"))
    return rows.join(groups, "group_key").where("id <> template").select(F.col("id").alias("source_id"), F.col("template").alias("target_id"), F.lit("PartOf").alias("relation"))


def sessions(memories: DataFrame, before: Column, least: int = 3) -> DataFrame:
    """(channel, day, n, first_ms, last_ms, top_salience, n_tags): episodic memories of a channel and UTC day."""
    rows = memories.where(F.col("tier") == "episodic").where(F.col("ingestion_time") <= before)
    return (
        rows.groupBy("channel", F.date_format("ingestion_time", "yyyy-MM-dd").alias("day"))
        .agg(
            F.count("*").alias("n"), F.min(F.unix_millis("ingestion_time")).alias("first_ms"), F.max(F.unix_millis("ingestion_time")).alias("last_ms"),
            F.greatest(F.max("effective"), F.lit(0.3)).alias("top_salience"),
        ).where(F.col("n") >= least)
    )


def in_window(memories: DataFrame, now: Column, days: int) -> DataFrame:
    """Episodic memories ingested within the last days."""
    return memories.where((F.col("tier") == "episodic") & (F.unix_micros("ingestion_time") >= F.unix_micros(now) - days * 86_400_000_000))


def moved(memories: DataFrame, ids: DataFrame, tier: str) -> DataFrame:
    """`memories` with the rows of ids (id) in another tier: archived, or restored."""
    hit = ids.select("id", F.lit(True).alias("_hit")).distinct()
    return memories.join(hit, "id", "left").withColumn("tier", F.when(F.col("_hit"), tier).otherwise(F.col("tier"))).drop("_hit")


def compressed(memories: DataFrame, before: Column, least: int = 3) -> DataFrame:
    """One row for each session that is compressed: (channel, day, n, base_score, tags, event_ms). Only texts take part."""
    rows = memories.where("tier = 'episodic' and kind = 'Text'").where(F.col("ingestion_time") <= before).withColumn("day", F.date_format("ingestion_time", "yyyy-MM-dd"))
    tags = rows.select("channel", "day", F.explode("tags").alias("tag")).distinct().groupBy("channel", "day").agg(F.sort_array(F.collect_list("tag")).alias("tags"))
    by = rows.groupBy("channel", "day").agg(F.count("*").alias("n"), F.greatest(F.max("effective"), F.lit(0.3)).alias("base_score"), F.min(F.unix_millis("ingestion_time")).alias("event_ms")).where(F.col("n") >= least)
    return by.join(tags, ["channel", "day"], "left").withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))


def cycle_report(memories: DataFrame, now: Column) -> DataFrame:
    """One row on what a consolidation cycle would do: memories decayed, groups promoted, memories archived."""
    fading = decay_changes(memories, now).agg(F.count("*").alias("decayed"))
    groups = promotion_groups(memories).agg(F.count("*").alias("promoted"))
    faint = sweep(memories).agg(F.count("*").alias("archived"))
    return fading.crossJoin(groups).crossJoin(faint)  # one row each


def privacy_operations(memories: DataFrame, ids: DataFrame, level: str) -> DataFrame:
    """(id, operation) that a change of privacy sends to other devices: an upsert when a memory becomes shared, a delete when it becomes private."""
    rows = memories.join(ids.select("id").distinct(), "id", "left_semi").where(F.col("privacy") != level)
    if level == "private":
        return rows.select("id", F.lit("MemoryDelete").alias("operation"))
    return rows.where("privacy = 'private'").select("id", F.lit("MemoryUpsert").alias("operation"))
