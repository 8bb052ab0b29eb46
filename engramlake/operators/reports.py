"""Counts and health of the store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def stats(memories: DataFrame, people: DataFrame) -> DataFrame:
    """One row: memories per tier, all but archived ones, people."""
    per = [F.count_if(F.col("tier") == t).alias(t) for t in ("working", "episodic", "semantic", "procedural", "archived")]
    return memories.agg(*per, F.count_if(F.col("tier") != "archived").alias("total")).crossJoin(people.agg(F.count("*").alias("people")))  # one row each


def namespaces(memories: DataFrame) -> DataFrame:
    return memories.groupBy(F.coalesce("namespace", F.lit("(default)")).alias("namespace")).agg(F.count("*").alias("n"))


def tags(memories: DataFrame, tiers: tuple) -> DataFrame:
    """Uses of each tag over the given tiers, lower-cased."""
    return memories.where(F.col("tier").isin(*tiers)).select(F.explode("tags").alias("tag")).groupBy(F.lower("tag").alias("tag")).agg(F.count("*").alias("n"))


def health(counts: DataFrame, beliefs: DataFrame) -> DataFrame:
    """Score of 0 to 100 from `stats` and the number of beliefs: freshness, coverage, coherence, efficiency, reachability."""
    c = F.col
    everything = (c("episodic") + c("semantic") + c("procedural") + c("archived")).cast("double")
    joined = counts.crossJoin(beliefs.agg(F.count("*").alias("beliefs")))  # one row each
    parts = joined.select(
        F.when(c("episodic") > 0, 0.8).otherwise(0.0).alias("freshness"),
        F.least(c("semantic") / F.greatest(everything, F.lit(1.0)), F.lit(1.0)).alias("coverage"),
        F.when(c("beliefs") > 0, 0.7).otherwise(0.3).alias("coherence"),
        F.when(everything > 0, 1 - c("archived") / everything).otherwise(1.0).alias("efficiency"),
        F.when(c("people") > 0, 0.8).otherwise(0.4).alias("reachability"),
    )
    score = 100 * (0.25 * c("freshness") + 0.25 * c("coverage") + 0.2 * c("coherence") + 0.15 * c("efficiency") + 0.15 * c("reachability"))
    return parts.select(F.round(score, 2).alias("score"), *[F.round(x, 3).alias(x) for x in parts.columns])


def digest(memories: DataFrame, now: Column, days: int = 7) -> DataFrame:
    """(day, tier, n) of memories created and ingested within the last days."""
    since = F.unix_micros(now) - days * 86_400_000_000
    recent = memories.where((F.unix_micros("created_at") >= since) & (F.unix_micros("ingestion_time") >= since))
    return recent.groupBy(F.date_format("ingestion_time", "yyyy-MM-dd").alias("day"), "tier").agg(F.count("*").alias("n"))
