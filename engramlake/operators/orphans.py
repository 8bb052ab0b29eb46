"""References to records that do not exist.

Keys become integers through a dictionary, the references of a table and period become one
compressed bitmap for each range of integers, and reference AND NOT parent leaves the orphans, whose
bits are decoded through the dictionary again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engramlake.functions.bitmaps import RANGE_BITS, members, minus, pack
from engramlake.functions.ids import canonical_id
from engramlake.session import checkpointed


@dataclass(frozen=True)
class OrphanConfig:
    #: Keys, about, of a hash bucket of the dictionary, which is numbered in one task; there are as many buckets as that takes.
    keys_per_bucket: int = 100_000
    least_buckets: int = 256
    #: A target that more than one in so many references name is joined apart from the others; there cannot be more of them than this.
    hot_targets: int = 1000


def memory_links(memories: DataFrame) -> DataFrame:
    """(ref_table, ref_id, target_id, period) of links_json. Null or broken JSON and null targets give no row."""
    target = F.explode(F.from_json("links_json", "array<struct<target_id:string>>").getField("target_id"))
    return memories.select(
        F.lit("memories").alias("ref_table"),
        canonical_id(F.col("id")).alias("ref_id"),
        F.date_format("created_at", "yyyy-MM").alias("period"),
        target.alias("target"),
    ).select("ref_table", "ref_id", canonical_id(F.col("target")).alias("target_id"), "period").where("target_id is not null")


def context_references(contexts: DataFrame) -> DataFrame:
    """(ref_table, ref_id, target_id, period) of related_memories. Null elements give no row."""
    return contexts.select(
        F.lit("person_context").alias("ref_table"),
        canonical_id(F.col("context_id")).alias("ref_id"),
        F.date_format("captured_at", "yyyy-MM").alias("period"),
        F.explode("related_memories").alias("target"),
    ).select("ref_table", "ref_id", canonical_id(F.col("target")).alias("target_id"), "period").where("target_id is not null")


def dictionary(keys: DataFrame, most_keys: int, config: OrphanConfig) -> DataFrame:
    """(bucket, code, key): distinct keys, most_keys of them at most, numbered from 0 within their hash bucket. Buckets are
    numbered in parallel, so no task sees more than its share of the keys."""
    n_buckets = max(config.least_buckets, -(-most_keys // config.keys_per_bucket))
    w = Window.partitionBy("bucket").orderBy("key")
    return (
        keys.where("key is not null").distinct()
        .select(F.pmod(F.xxhash64("key"), F.lit(n_buckets)).cast("int").alias("bucket"), "key")
        .select("bucket", "key", (F.row_number().over(w) - 1).alias("code"))
    )


def _bitmaps(coded: DataFrame, *by: str) -> DataFrame:
    """A container for each `by` and range of codes; partial bitmaps are built before the shuffle."""
    return (
        coded.groupBy(*by, "bucket", F.expr(f"code div {RANGE_BITS}").alias("code_range"))
        .agg(F.bitmap_construct_agg((F.col("code") % RANGE_BITS).cast("bigint")).alias("raw"))
        .select(*by, "bucket", "code_range", pack("raw").alias("bits"))
    )


def orphan_keys(references: DataFrame, parents: DataFrame, config: OrphanConfig = OrphanConfig()) -> DataFrame:
    """(ref_table, period, target_id): the targets of a table and period that no parent has.

    references: ref_table, period, target_id; parents: key. Repeated references count once before
    anything is shuffled by key, so a target that a third of all rows name is as light as another.
    A null period is a period of its own. Empty references give no row; with empty parents all are orphans.
    """
    named = references.select("ref_table", "period", F.col("target_id").alias("key")).where("key is not null").distinct()
    most = references.count() + parents.count()
    codes = dictionary(named.select("key").union(parents.select("key")), most, config)
    has = named.join(codes, "key").select("ref_table", "period", "bucket", "code")
    stored = parents.where("key is not null").distinct().join(codes, "key").select("bucket", "code")
    left = (
        _bitmaps(has, "ref_table", "period").alias("r")
        .join(_bitmaps(stored).withColumnRenamed("bits", "parent"), ["bucket", "code_range"], "left")
        .select("ref_table", "period", "bucket", "code_range", minus("bits", "parent").alias("bits"))
    )
    positions = left.select("ref_table", "period", "bucket", "code_range", F.explode(members("bits")).alias("position"))
    codes_left = positions.select("ref_table", "period", "bucket", (F.col("code_range") * RANGE_BITS + F.col("position")).cast("int").alias("code"))
    return codes_left.join(codes, ["bucket", "code"]).select("ref_table", "period", F.col("key").alias("target_id"))


def orphan_references(references: DataFrame, parents: DataFrame, config: OrphanConfig = OrphanConfig()) -> DataFrame:
    """Distinct (ref_table, ref_id, target_id, period) whose target has no parent; see orphan_keys.

    A target that very many references name is looked up in a broadcast of at most hot_targets rows, so that no task gets all
    its references; the others are joined by key. Rows come out in no partitioning that a later step could rely on.
    """
    refs = checkpointed(references.select("ref_table", "ref_id", "target_id", "period").distinct())
    lost = orphan_keys(refs, parents, config).select("target_id").distinct()
    n = refs.count()
    hot = refs.groupBy("target_id").agg(F.count("*").alias("n")).where(F.col("n") * config.hot_targets > n).select("target_id")
    often = refs.join(F.broadcast(hot.join(lost, "target_id", "left_semi")), "target_id", "left_semi")
    seldom = refs.join(F.broadcast(hot), "target_id", "left_anti").join(lost, "target_id", "left_semi")
    return often.union(seldom).select("ref_table", "ref_id", "target_id", "period")


def orphan_counts(references: DataFrame, parents: DataFrame, config: OrphanConfig = OrphanConfig()) -> DataFrame:
    """(ref_table, period, n_refs, n_records, n_targets) of the orphan references."""
    return orphan_references(references, parents, config).groupBy("ref_table", "period").agg(
        F.count("*").alias("n_refs"), F.countDistinct("ref_id").alias("n_records"), F.countDistinct("target_id").alias("n_targets")
    )
