"""Hooks of plugins around ingest, retrieval and upkeep, each a function from DataFrame to DataFrame."""

from __future__ import annotations

import logging
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engramlake.operators import extraction

log = logging.getLogger(__name__)


class Plugin(Protocol):
    name: str

    def pre_ingest(self, batch: DataFrame) -> DataFrame: ...

    def pre_retrieve(self, scored: DataFrame) -> DataFrame: ...


class TagClassifier:
    """Adds a column of tags found by words."""

    name = "tag-classifier"

    def __init__(self, taxonomy: dict | None = None):
        self.taxonomy = taxonomy or extraction.TAXONOMY

    def pre_ingest(self, batch: DataFrame) -> DataFrame:
        return batch.withColumn("tags", F.array_distinct(F.concat(F.coalesce("tags", F.array().cast("array<string>")), extraction.tags(F.col("text"), self.taxonomy))))

    def pre_retrieve(self, scored: DataFrame) -> DataFrame:
        return scored


def run(plugins: list[Plugin], hook: str, df: DataFrame) -> DataFrame:
    """`df` through a hook of all plugins in order; a plugin that fails to build its plan is skipped and logged."""
    for p in plugins:
        try:
            df = getattr(p, hook)(df)
        except Exception:
            log.exception("plugin %s failed in %s", p.name, hook)
    return df
