"""The store under one roof: operations by the names that its users know, each a DataFrame."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from engramlake.operators import changefeed, extraction, ingest, knowledge, lifecycle, plugins, reports, scans, search
from engramlake.session import ship
from engramlake.sources import memory_store, table


@dataclass
class Engine:
    """Operations over the tables in a folder. `now` is explicit, so that results can be repeated."""

    spark: SparkSession
    folder: str
    now: Column | None = None
    plugins: list = field(default_factory=lambda: [plugins.TagClassifier()])

    def __post_init__(self):
        ship(self.spark)
        self.now = F.current_timestamp() if self.now is None else self.now

    @property
    def memories(self) -> DataFrame:
        return memory_store.memories(self.spark, self.folder)

    @property
    def people(self) -> DataFrame:
        return memory_store.people(self.spark, self.folder)

    @property
    def identities(self) -> DataFrame:
        return memory_store.identities(self.spark, self.folder)

    def memory_search(self, text: str, **options) -> DataFrame:
        return plugins.run(self.plugins, "pre_retrieve", search.retrieve(self.memories, search.Query(text, **options), self.now))

    def memory_context(self, max_tokens: int = 2000) -> DataFrame:
        return ingest.context(ingest.context_lines(self.memories), max_tokens)

    def memory_ingest_batch(self, batch: DataFrame) -> DataFrame:
        """batch (seq, text), marked as stored or duplicate, with tags."""
        marked = ingest.first_copies(batch, self.memories.where("content_hash is not null"))
        return plugins.run(self.plugins, "pre_ingest", batch.withColumn("tags", F.lit(None).cast("array<string>")).join(marked, "seq"))

    def memory_infer(self, texts: DataFrame) -> DataFrame:
        return extraction.knowledge(texts)

    def relationship_extract(self, texts: DataFrame) -> DataFrame:
        return extraction.with_inverses(extraction.relations(texts))

    def memory_stats(self) -> DataFrame:
        return reports.stats(self.memories, self.people)

    def memory_decay(self) -> DataFrame:
        return lifecycle.decay_changes(self.memories, self.now)

    def memory_archive(self, days: int = 30, threshold: float = 0.3) -> DataFrame:
        return lifecycle.auto_archive(self.memories, self.now, days, threshold)

    def memory_restore(self, ids: DataFrame) -> DataFrame:
        return lifecycle.moved(self.memories, ids, "episodic")

    def memory_delete(self, ids: DataFrame) -> DataFrame:
        return scans.delete(self.memories, ids)

    def memory_set_privacy(self, ids: DataFrame, level: str) -> DataFrame:
        return lifecycle.privacy_operations(self.memories, ids, level)

    def memory_consolidate(self) -> DataFrame:
        return lifecycle.cycle_report(self.memories, self.now)

    def memory_compress(self, least: int = 3) -> DataFrame:
        return lifecycle.compressed(self.memories, self.now, least)

    def fact_query(self, entity: str) -> DataFrame:
        return knowledge.facts(self.memories).where(F.col("s").contains(entity.lower()) | F.col("o").contains(entity.lower()))

    def preference_query(self, key: str = "") -> DataFrame:
        return self.memories.where("kind = 'Preference'").where(F.lower("key").contains(key.lower())).select("id", "key", "value", "confidence")

    def contradiction_check(self) -> DataFrame:
        return knowledge.contradictions(self.memories)

    def belief_list(self, observations: DataFrame, threshold: float = 0.8) -> DataFrame:
        return knowledge.confident(knowledge.beliefs(observations), threshold)

    def person_resolve(self) -> DataFrame:
        return knowledge.resolved_people(self.identities, self.people)

    def person_list(self) -> DataFrame:
        return knowledge.listed_people(self.people, self.identities)

    def person_merge(self, same: DataFrame) -> DataFrame:
        return knowledge.merged_people(self.people, same)

    def namespace_list(self) -> DataFrame:
        return reports.namespaces(self.memories)

    def tag_list_taxonomy(self) -> DataFrame:
        return self.spark.createDataFrame([(t, w) for t, w in extraction.TAXONOMY.items()], "tag string, words array<string>")

    def sync_pull(self) -> DataFrame:
        return changefeed.apply_feed(*(table(self.spark, self.folder, t) for t in ("sync_oplog", "sync_hlc", "sync_tombstones")))

    def sync_status(self) -> DataFrame:
        return changefeed.feed_report(self.sync_pull())
