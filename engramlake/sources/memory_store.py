"""The memory store as flat columns: one row for each memory, person and identity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from engramlake.functions.ids import canonical_id
from engramlake.session import written
from engramlake.sources.tables import table

CONTENT = """Text string, Fact struct<subject string, predicate string, object string>, Preference struct<key string, value string, confidence double>,
 Relationship struct<person_a string, person_b string, relation string>, Pattern struct<trigger string, actions array<string>, frequency int>,
 Event struct<title string, start string, `end` string>"""
TEMPORAL = "event_time string, ingestion_time string, last_accessed string, access_count bigint, durability string"
SOURCE = "channel string, identity_id string, chat_id string, thread_id string, message_id string"
SALIENCE = "base double, emotional double, access_boost double, decay_factor double, effective double"
KINDS = ("Text", "Fact", "Preference", "Relationship", "Pattern", "Event")
LIVE_TIERS = ("episodic", "semantic", "procedural")


def newest_per(df: DataFrame, key: str, *order: Column) -> DataFrame:
    """One row for each key, the first by `order`."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_rn = 1").drop("_rn")


def flatten(raw: DataFrame) -> DataFrame:
    """Exported memories with their JSON parts as columns, rows delivered twice reduced to the one updated last.

    Only the JSON columns that a query uses are parsed, as the unused ones are pruned. Null ids are left out.
    """
    c, t, s, b = F.col("c"), F.col("t"), F.col("s"), F.col("b")
    # parsed below the window, so that each document is parsed once and not once for each of its fields
    parsed = raw.withColumn("id", canonical_id(F.col("id"))).where("id is not null").select(
        "*",
        F.from_json("content_json", CONTENT).alias("c"), F.from_json("temporal_json", TEMPORAL).alias("t"),
        F.from_json("source_json", SOURCE).alias("s"), F.from_json("salience_json", SALIENCE).alias("b"),
    )
    once = newest_per(parsed, "id", F.desc_nulls_last("updated_at"), F.desc_nulls_last("temporal_json"), F.desc_nulls_last("salience_json"))
    kind = F.coalesce(*[F.when(c.getField(k).isNotNull(), k) for k in KINDS])
    return once.select(
        "id", "tier", kind.alias("kind"), c.Text.alias("text"),
        c.Fact.subject.alias("subject"), c.Fact.predicate.alias("predicate"), c.Fact["object"].alias("object"),
        c.Preference.key.alias("key"), c.Preference.value.alias("value"), c.Preference.confidence.alias("confidence"),
        canonical_id(c.Relationship.person_a).alias("person_a"), canonical_id(c.Relationship.person_b).alias("person_b"), c.Relationship.relation.alias("relation"),
        c.Pattern.trigger.alias("trigger"), c.Pattern.actions.alias("actions"), c.Pattern.frequency.alias("frequency"),
        c.Event.title.alias("title"), c.Event.start.alias("start"), c.Event["end"].alias("end"),
        F.to_timestamp(t.event_time).alias("event_time"), F.to_timestamp(t.ingestion_time).alias("ingestion_time"), F.to_timestamp(t.last_accessed).alias("last_accessed"),
        t.access_count.alias("access_count"), F.coalesce(t.durability, F.lit("normal")).alias("durability"),
        s.channel.alias("channel"), canonical_id(s.identity_id).alias("identity_id"), s.chat_id.alias("chat_id"),
        b.base.alias("base_score"), b.emotional.alias("emotional"), b.access_boost.alias("access_boost"), b.decay_factor.alias("decay_factor"),
        b.effective.alias("effective"), "salience_score",
        F.when(F.col("privacy_json").contains("Shared"), "shared").when(F.col("privacy_json").contains("Public"), "public").otherwise("private").alias("privacy"),
        F.get_json_object("privacy_json", "$.Shared.scope").alias("privacy_scope"),
        F.from_json("tags_json", "array<string>").alias("tags"), "metadata_json",
        F.lower(F.btrim("content_hash")).alias("content_hash"), "namespace", "created_at", "updated_at",
    )


_stores: dict[tuple, DataFrame] = {}


def compacted(raw: DataFrame) -> DataFrame:
    """The flat store of `raw`, written once to the shared folder with the rows of a file in order of tier and creation.

    Rows delivered twice are settled and JSON is parsed here and not by every query; what is asked of the store reaches its
    scan, as do the columns. The same files are not read again within an application; rewritten files have other names.
    """
    spark = raw.sparkSession
    key = (spark.sparkContext.applicationId, *sorted(raw.inputFiles()))
    if key not in _stores:
        _stores[key] = written(flatten(raw).sortWithinPartitions("tier", "created_at"))
    return _stores[key]


def memories(spark: SparkSession, d: str) -> DataFrame:
    return compacted(table(spark, d, "memories"))


def links(spark: SparkSession, d: str) -> DataFrame:
    """(source_id, target_id, relation, strength) of links_json; of links repeated with another strength the strongest."""
    link = F.explode(F.from_json("links_json", "array<struct<target_id:string,relation:string,strength:double>>")).alias("l")
    return (
        table(spark, d, "memories").select(canonical_id(F.col("id")).alias("source_id"), link)
        .select("source_id", canonical_id(F.col("l.target_id")).alias("target_id"), "l.relation", "l.strength")
        .where("target_id is not null").groupBy("source_id", "target_id", "relation").agg(F.max("strength").alias("strength"))
    )


def people(spark: SparkSession, d: str) -> DataFrame:
    """People, one row for each id: the one seen last; relationship in lower case without blanks around it."""
    raw = table(spark, d, "people").withColumn("id", canonical_id(F.col("id"))).where("id is not null")
    once = newest_per(raw, "id", F.desc_nulls_last("last_seen"), F.desc_nulls_last("interaction_count"), F.desc_nulls_last("display_name"))
    return once.select(
        "id", "display_name", F.lower(F.btrim("relationship")).alias("relationship"), "first_seen", "last_seen", F.col("interaction_count").cast("bigint").alias("interaction_count"),
        F.from_json("tags_json", "array<string>").alias("tags"), F.from_json("notes_json", "array<string>").alias("notes"),
    )


def identities(spark: SparkSession, d: str) -> DataFrame:
    """(channel, channel_user_id, person_id, username, display_name), one row for each channel and user id."""
    return table(spark, d, "channel_identities").groupBy("channel", "channel_user_id").agg(
        F.min(canonical_id(F.col("person_id"))).alias("person_id"), F.max("username").alias("username"), F.max("display_name").alias("display_name")
    )
