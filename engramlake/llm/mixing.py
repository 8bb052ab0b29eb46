"""Mixing of sources to target shares of all tokens, by entropy balancing.

Among all document rates that reach the token targets, the one closest to the unchanged corpus in
relative entropy is exponential in the document's tokens: rate = exp(lambda_source * tokens / unit), cut
off at the source's cap of repeats. The lambdas solve a convex dual, whose gradient and curvature
are one aggregation per Newton step; only those few numbers per source reach the driver.
Systematic rounding turns rates into whole copies.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engramlake.session import checkpointed


@dataclass(frozen=True)
class MixConfig:
    #: Tokens to reach; None takes the most for which every source can reach its share within its cap.
    total_tokens: int | None = None
    max_steps: int = 60
    #: Relative error of a source's tokens at which the dual counts as solved.
    tolerance: float = 1e-6
    #: Documents rounded in one task.
    rounding_block: int = 50_000
    #: Bound of the number of sources, whose figures the driver holds.
    max_sources: int = 10_000


def source_name(c: Column) -> Column:
    """Source as its targets spell it: letter case, blanks around it and '-' or ' ' for '_' carry no meaning."""
    return F.regexp_replace(F.lower(F.btrim(c, F.lit(" \t\r\n "))), r"[\s\-]+", "_")


def _rate(tilt: Column, tokens: Column, unit: Column, cap: Column) -> Column:
    return F.least(cap.cast("double"), F.exp(F.least(F.lit(700.0), tilt * tokens / unit)))


def solve_tilts(histogram: DataFrame, goals: dict[str, float], config: MixConfig) -> dict[str, float]:
    """The tilt of each source by safeguarded Newton steps on the dual.

    histogram: source, n_tokens, n_docs, cap, unit. A step is one aggregation over it: the tokens
    reached by each source and their slope. Infinite for a source that must use every document as often as it may.
    """
    spark = histogram.sparkSession
    tilt = {s: 0.0 for s in goals}
    low, high = dict.fromkeys(goals, -math.inf), dict.fromkeys(goals, math.inf)
    open_sources = {s for s in goals}
    for _ in range(config.max_steps):
        if not open_sources:
            break
        now = spark.createDataFrame([(s, tilt[s]) for s in sorted(open_sources)], "source string, tilt double")
        rate = _rate(F.col("tilt"), F.col("n_tokens"), F.col("unit"), F.col("cap"))
        mass = F.col("n_docs") * rate * F.col("n_tokens")
        free = F.when(rate < F.col("cap"), mass * F.col("n_tokens") / F.col("unit")).otherwise(0.0)
        found = (
            histogram.join(F.broadcast(now), "source")  # at most max_sources rows
            .groupBy("source")
            .agg(F.sum(mass).alias("got"), F.sum(free).alias("slope"))
            .collect()
        )
        for r in found:
            s, gap = r.source, r.got - goals[r.source]
            if abs(gap) <= config.tolerance * goals[s]:
                open_sources.discard(s)
                continue
            (high if gap > 0 else low)[s] = tilt[s]
            step = tilt[s] - gap / r.slope if r.slope > 0 else math.inf
            if not low[s] < step < high[s] or abs(step - tilt[s]) > 4:
                if math.isinf(low[s]) or math.isinf(high[s]):
                    step = tilt[s] + (4 if gap < 0 else -4)
                else:
                    step = (low[s] + high[s]) / 2
            tilt[s] = step
    return tilt


def mix(documents: DataFrame, targets: DataFrame, config: MixConfig = MixConfig()) -> DataFrame:
    """(doc_id, source, n_tokens, rate, copies): how often each document is used.

    documents: doc_id, source, n_tokens; targets: source, target_share, max_repeats. Documents of
    no target source, of a null source or without tokens get no copies and are left out of the result's mass but kept as rows with
    rate 0. Shares are of the sum over target sources; a target source without tokens cannot contribute and the others
    keep their relation. No document gets more than max_repeats copies. Copies depend only on the
    rows, not on their order. Empty documents or targets give no copies.
    """
    wanted = targets.select(
        source_name(F.col("source")).alias("source"), F.col("target_share").alias("share"), F.col("max_repeats").alias("cap")
    ).where("source is not null and share > 0 and cap > 0").groupBy("source").agg(F.sum("share").alias("share"), F.max("cap").alias("cap"))
    docs = checkpointed(documents.select("doc_id", source_name(F.col("source")).alias("source"), F.coalesce("n_tokens", F.lit(0)).alias("n_tokens")))
    counted = docs.where("n_tokens > 0 and source is not null").groupBy("source", "n_tokens").agg(F.count("*").alias("n_docs"))
    if (n_sources := wanted.count()) > config.max_sources:
        raise ValueError(f"{n_sources} target sources, more than max_sources ({config.max_sources})")
    histogram = checkpointed(counted.join(F.broadcast(wanted), "source"))  # at most max_sources rows
    totals = histogram.groupBy("source").agg(
        F.sum(F.col("n_docs") * F.col("n_tokens")).alias("tokens"), F.sum("n_docs").alias("docs"), F.first("share").alias("share"), F.first("cap").alias("cap")
    ).collect()
    shares = sum(r.share for r in totals) or 1.0
    reach = min((r.cap * r.tokens / (r.share / shares) for r in totals), default=0.0)
    total = min(reach, config.total_tokens) if config.total_tokens else reach
    goals = {r.source: total * r.share / shares for r in totals}
    full = {r.source for r in totals if goals[r.source] >= r.cap * r.tokens * (1 - 1e-9)}
    units = {r.source: r.tokens / r.docs for r in totals}
    spark = docs.sparkSession
    unit_rows = spark.createDataFrame([*units.items()], "source string, unit double") if units else None
    tilts = {} if unit_rows is None else solve_tilts(
        histogram.join(F.broadcast(unit_rows), "source"), {s: g for s, g in goals.items() if s not in full}, config
    )
    solved = spark.createDataFrame(
        [(r.source, r.cap, units[r.source], tilts.get(r.source, 0.0), r.source in full, max(1, math.ceil(r.docs / config.rounding_block))) for r in totals],
        "source string, cap int, unit double, tilt double, is_full boolean, blocks int",
    )
    rate = F.when((F.col("n_tokens") <= 0) | F.col("cap").isNull(), 0.0).otherwise(
        F.when(F.col("is_full"), F.col("cap").cast("double")).otherwise(_rate(F.col("tilt"), F.col("n_tokens"), F.col("unit"), F.col("cap")))
    )
    rated = docs.join(F.broadcast(solved), "source", "left").select(
        "doc_id", "source", "n_tokens", rate.alias("rate"), F.pmod(F.xxhash64("doc_id"), F.coalesce("blocks", F.lit(1))).alias("block")
    )
    return rounded(rated)


def rounded(rated: DataFrame) -> DataFrame:
    """Whole copies of (doc_id, source, n_tokens, rate, block): floor(C) of the running sum C of rates within a
    block, less that before. Blocks are hash slices of a source, ordered by tokens, so that each length is met in
    proportion, and every copy number is the rate rounded up or down."""
    used = rated.where("rate > 0")
    order = Window.partitionBy("source", "block").orderBy("n_tokens", F.xxhash64("doc_id", F.lit("round")), "doc_id")
    start = F.pmod(F.xxhash64("source", "block"), F.lit(1000)) / 1000
    upto = F.round(F.sum("rate").over(order.rowsBetween(Window.unboundedPreceding, 0)) + start, 6)
    copies = used.withColumn("upto", upto).withColumn("before", F.coalesce(F.lag("upto").over(order), F.round(start, 6)))
    some = copies.select("doc_id", "source", "n_tokens", "rate", (F.floor("upto") - F.floor("before")).cast("int").alias("copies"))
    none = rated.where("rate <= 0 or rate is null").select("doc_id", "source", "n_tokens", F.lit(0.0).alias("rate"), F.lit(0).alias("copies"))
    return some.union(none)


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, actual_share, n_docs, n_used, n_copies, most_copies, tokens) of a mix."""
    wanted = targets.select(source_name(F.col("source")).alias("source"), "target_share").groupBy("source").agg(F.sum("target_share").alias("target_share"))
    by = mixed.groupBy("source").agg(
        F.count("*").alias("n_docs"),
        F.sum((F.col("copies") > 0).cast("long")).alias("n_used"),
        F.sum("copies").alias("n_copies"),
        F.max("copies").alias("most_copies"),
        F.sum(F.col("copies").cast("long") * F.col("n_tokens")).alias("tokens"),
    )
    total = by.agg(F.sum("tokens").alias("all_tokens"))
    return (
        by.join(wanted, "source", "left")
        .join(F.broadcast(total))  # one row
        .select("source", "target_share", (F.col("tokens") / F.col("all_tokens")).alias("actual_share"), "n_docs", "n_used", "n_copies", "most_copies", "tokens")
    )
