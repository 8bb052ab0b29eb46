"""Scoped stores: validity, validation of input, revision fences and scoped search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def valid_at(now: Column, start: Column, until: Column) -> Column:
    """start <= now < until, nulls open."""
    return (start.isNull() | (start <= now)) & (until.isNull() | (now < until))


def clamped(c: Column, default: int, least: int, most: int) -> Column:
    """A request's number within its limits; the default where there is none."""
    return F.least(F.greatest(F.coalesce(c, F.lit(default)), F.lit(least)), F.lit(most))


def problems(identifier: Column, text: Column, max_chars: int = 12_000, max_bytes: int = 48_000) -> Column:
    """What is wrong with an input, null if nothing: identifiers of 1 to 256 bytes without control characters, texts within limits."""
    return (
        F.when(identifier.isNull() | (F.octet_length(identifier) < 1), "no identifier")
        .when(F.octet_length(identifier) > 256, "identifier too long")
        .when(identifier.rlike(r"[\x00-\x1f\x7f]"), "control character in identifier")
        .when(text.isNull() | (F.btrim(text) == ""), "no text")
        .when((F.length(text) > max_chars) | (F.octet_length(text) > max_bytes), "text too long")
    )


def fenced(mutations: DataFrame) -> DataFrame:
    """mutations (key, revision, seq, at) with their outcome when applied by seq: "applied" if the revision is above all before it,
    "replayed" if it equals the highest, else "stale".

    The highest before is taken within a month of a key and over the months before it, so that a key with very many mutations is
    ordered in parts.
    """
    m = mutations.withColumn("month", F.date_format("at", "yyyy-MM"))
    before = Window.partitionBy("key", "month").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    inside = m.withColumn("inside", F.max("revision").over(before))
    months = m.groupBy("key", "month").agg(F.max("revision").alias("top"))
    earlier = months.withColumn("earlier", F.max("top").over(Window.partitionBy("key").orderBy("month").rowsBetween(Window.unboundedPreceding, -1))).select("key", "month", "earlier")
    high = F.greatest("inside", "earlier")
    outcome = F.when(high.isNull() | (F.col("revision") > high), "applied").when(F.col("revision") == high, "replayed").otherwise("stale")
    return inside.join(earlier, ["key", "month"]).select("key", "revision", "seq", outcome.alias("outcome"))


def scoped_search(memories: DataFrame, scopes: list[str], terms: list[str], most: int = 1000) -> DataFrame:
    """(id, matched, truncated): newest live rows of the given privacy scopes, whether all terms stand in their text, and
    whether there were more candidates than `most`."""
    from engramlake.operators.search import tokens

    rows = memories.where(F.col("privacy_scope").isin(*scopes) & (F.col("tier") != "archived"))
    n = rows.agg((F.count("*") > most).alias("truncated"))
    top = rows.orderBy(F.desc_nulls_last("created_at"), "id").limit(most)
    matched = F.size(F.array_except(F.array(*map(F.lit, terms)), tokens(F.coalesce("text", F.lit(""))))) == 0
    return top.select("id", matched.alias("matched")).join(F.broadcast(n))  # one row
