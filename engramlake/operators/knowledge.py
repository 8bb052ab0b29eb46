"""Facts, beliefs, people and procedures."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def facts(memories: DataFrame) -> DataFrame:
    """Facts with the lower-cased key that contradictions are judged by."""
    return memories.where("kind = 'Fact' and subject is not null and predicate is not null and object is not null").select(
        "id", F.lower("subject").alias("s"), F.lower("predicate").alias("p"), F.lower("object").alias("o"), "base_score", "effective", "created_at"
    )


def contradictions(memories: DataFrame) -> DataFrame:
    """(id, n_rivals, rival, rival_salience): for each fact how many other objects its subject and predicate have, and
    the most salient fact with another object. Facts without a rival are left out.

    Objects are pre-aggregated for each key and only the two strongest of a key are kept, so a subject that a third of all facts
    speak of costs no more than its facts: pairs are never built.
    """
    f = facts(memories)
    best = f.groupBy("s", "p", "o").agg(F.max(F.struct("effective", "id")).alias("top"))
    keyed = best.groupBy("s", "p").agg(F.count("*").alias("n"), F.max(F.struct("top.effective", "top.id", "o")).alias("first"))
    second = (
        best.join(keyed.select("s", "p", F.col("first.o").alias("fo")), ["s", "p"]).where("o <> fo")
        .groupBy("s", "p").agg(F.max(F.struct("top.effective", "top.id", "o")).alias("second"))
    )
    tops = keyed.where("n > 1").join(second, ["s", "p"])
    rival = F.when(F.col("o") == F.col("first.o"), F.col("second")).otherwise(F.col("first"))
    return f.join(tops, ["s", "p"]).select("id", (F.col("n") - 1).alias("n_rivals"), rival.alias("r")).select("id", "n_rivals", F.col("r.id").alias("rival"), F.col("r.effective").alias("rival_salience"))


def superseded(memories: DataFrame, factor: float = 0.3) -> DataFrame:
    """(id, times, base_score): how often the object of a fact's subject and predicate changed after it, its base score
    times the factor for each change. The latest object stands.

    Changes are counted within a month of a key, and months are summed up by their first and last object, so that no task
    orders all facts of a key.
    """
    f = facts(memories).withColumn("month", F.date_format("created_at", "yyyy-MM"))
    inside = Window.partitionBy("s", "p", "month").orderBy(F.asc_nulls_first("created_at"), "id")
    after = Window.partitionBy("s", "p", "month").orderBy(F.desc_nulls_last("created_at"), F.desc("id"))
    stepped = f.withColumn("step", F.coalesce((F.lead("o").over(inside) != F.col("o")).cast("int"), F.lit(0)))
    counted = stepped.withColumn("later", F.sum("step").over(after.rowsBetween(Window.unboundedPreceding, 0)))
    order = F.struct(F.coalesce(F.unix_micros("created_at"), F.lit(0)), "id")
    months = counted.groupBy("s", "p", "month").agg(F.min_by("o", order).alias("first_o"), F.max_by("o", order).alias("last_o"), F.sum("step").alias("steps"))
    by_month = Window.partitionBy("s", "p").orderBy("month")
    edge = months.withColumn("edge", F.coalesce((F.lead("first_o").over(by_month) != F.col("last_o")).cast("int"), F.lit(0)))
    back = Window.partitionBy("s", "p").orderBy(F.desc("month"))
    total = F.sum(F.col("steps") + F.col("edge")).over(back.rowsBetween(Window.unboundedPreceding, 0))
    later = edge.select("s", "p", "month", (total - F.col("steps")).alias("beyond"))
    joined = counted.join(later, (counted.s == later.s) & (counted.p == later.p) & counted.month.eqNullSafe(later.month)).select(counted.id, (F.col("later") + F.col("beyond")).alias("times"), counted.base_score)
    return joined.select("id", F.col("times").cast("bigint").alias("times"), (F.col("base_score") * F.pow(F.lit(factor), F.col("times"))).alias("base_score"))


LOW, HIGH = 0.001, 0.999


def _logit(p: Column) -> Column:
    return F.ln(p / (1 - p))


def _fold(steps: Column) -> Column:
    """Composition of functions x -> min(hi, max(lo, x + a)), in order; such functions are closed under it."""
    start = F.struct(F.lit(0.0).alias("a"), F.lit(-1e9).alias("lo"), F.lit(1e9).alias("hi"))

    def then(f, g):
        def held(x):
            return F.least(g["hi"], F.greatest(g["lo"], x + g["a"]))

        return F.struct((f["a"] + g["a"]).alias("a"), held(f["lo"]).alias("lo"), held(f["hi"]).alias("hi"))

    return F.aggregate(steps, start, then)


def beliefs(observations: DataFrame, prior: float = 0.5) -> DataFrame:
    """(key, probability, n): observations (key, ts, seq, supports, strength) folded in order of ts and seq.

    Each moves the odds by (1 + s) / (1 - s), or its inverse, and the result is held within 0.001 and 0.999, so that order
    counts. In log-odds a step is an addition held within bounds, and such steps compose: each day of a key is folded in its
    own task and the days' functions are folded then. Null strengths count as 0; a key of nulls only keeps the prior.
    """
    limit = math.log(HIGH / LOW)
    s = F.least(F.coalesce("strength", F.lit(0.0)), F.lit(1 - 1e-9))
    move = F.ln((1 + s) / (1 - s)) * F.when(F.col("supports"), 1).otherwise(-1)
    step = F.struct(move.alias("a"), F.lit(-limit).alias("lo"), F.lit(limit).alias("hi"))
    days = (
        observations.select("key", F.to_date("ts").alias("day"), F.struct("ts", "seq", step.alias("step")).alias("x"))
        .groupBy("key", "day").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["step"]).alias("steps"), F.count("*").alias("n"))
        .select("key", "day", _fold(F.col("steps")).alias("f"), "n")
    )
    folded = days.groupBy("key").agg(_fold(F.transform(F.array_sort(F.collect_list(F.struct("day", "f"))), lambda x: x["f"])).alias("f"), F.sum("n").alias("n"))
    x = F.least(F.col("f.hi"), F.greatest(F.col("f.lo"), F.lit(math.log(prior / (1 - prior))) + F.col("f.a")))
    return folded.select("key", (1 / (1 + F.exp(-x))).alias("probability"), "n")


def confident(folded: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Beliefs of at least the threshold, either way, with their label."""
    label = F.when(F.col("probability") > 0.7, "confident").when(F.col("probability") > 0.3, "uncertain").otherwise("unlikely")
    return folded.where((F.col("probability") >= threshold) | (F.col("probability") <= 1 - threshold)).withColumn("status", label)


def resolved_people(identities: DataFrame, people: DataFrame) -> DataFrame:
    """(channel, channel_user_id, person_id, name): the person behind an identity, or a new id made from channel and user id;
    the name is the person's, else the identity's display name, user name or user id."""
    known = people.select(F.col("id").alias("person_id"), F.col("display_name").alias("person_name"))
    made = F.concat(F.lit("new-"), F.substring(F.sha2(F.concat_ws("|", "channel", "channel_user_id"), 256), 1, 16))
    return identities.join(known, "person_id", "left").select(
        "channel", "channel_user_id", F.coalesce("person_id", made).alias("person_id"), F.coalesce("person_name", "display_name", "username", "channel_user_id").alias("name")
    )


def merged_people(people: DataFrame, same: DataFrame) -> DataFrame:
    """People with those of a pair (source, target) merged: least first and greatest last time, counts added, tags united."""
    to = same.groupBy("source").agg(F.min("target").alias("target"))
    rows = people.join(to, people.id == to.source, "left").withColumn("id", F.coalesce("target", "id"))
    return rows.groupBy("id").agg(
        F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.sum("interaction_count").alias("interaction_count"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_set("tags")))).alias("tags"), F.count("*").alias("n_merged"),
    )


def relationship_graph(memories: DataFrame, people: DataFrame) -> DataFrame:
    """(name_a, relation, name_b, n) of the relationships between known people."""
    names = people.select("id", "display_name")
    r = memories.where("kind = 'Relationship'").select("person_a", "person_b", "relation")
    a, b = names.toDF("person_a", "name_a"), names.toDF("person_b", "name_b")
    return r.join(a, "person_a").join(b, "person_b").groupBy("name_a", "relation", "name_b").agg(F.count("*").alias("n"))


def person_activity(memories: DataFrame, people: DataFrame) -> DataFrame:
    """(id, display_name, n_memories, last_ms) of every person, counted before the join so that a busy owner is one row."""
    by = memories.where("identity_id is not null").groupBy(F.col("identity_id").alias("id")).agg(F.count("*").alias("n"), F.max(F.unix_millis("ingestion_time")).alias("last_ms"))
    return people.join(by, "id", "left").select("id", "display_name", F.coalesce("n", F.lit(0)).alias("n_memories"), "last_ms")


def patterns(actions: DataFrame, least: int = 1) -> DataFrame:
    """(trigger, frequency, actions, last_ms) of (trigger, action, ts): how often a trigger was met, and its different actions."""
    return actions.groupBy("trigger").agg(
        F.count("*").alias("frequency"), F.sort_array(F.collect_set("action")).alias("actions"), F.max(F.unix_millis("ts")).alias("last_ms")
    ).where(F.col("frequency") >= least)


def working_ring(events: DataFrame, capacity: int = 100) -> DataFrame:
    """The newest `capacity` rows of each session (session, seq)."""
    w = Window.partitionBy("session").orderBy(F.desc("seq"))
    return events.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= capacity)


def listed_people(people: DataFrame, identities: DataFrame) -> DataFrame:
    """(id, display_name, n_identities, channels) of every person."""
    own = identities.groupBy(F.col("person_id").alias("id")).agg(F.count("*").alias("n"), F.sort_array(F.collect_set("channel")).alias("channels"))
    return people.join(own, "id", "left").select("id", "display_name", F.coalesce("n", F.lit(0)).alias("n_identities"), F.coalesce("channels", F.array().cast("array<string>")).alias("channels"))


def promoted_pattern(found: DataFrame) -> DataFrame:
    """Procedural memories of frequent patterns: (trigger, tier, base_score, line)."""
    return found.select("trigger", F.lit("procedural").alias("tier"), F.lit(0.7).alias("base_score"), F.concat(F.lit("When "), "trigger", F.lit(": "), F.concat_ws(", ", "actions")).alias("line"))


def speculative(confidence: Column) -> Column:
    """Confidence of a fact that was only guessed from another: below the floor of what a context shows."""
    return F.least(confidence * 0.3, F.lit(0.29))


def fact_rows(found: DataFrame, base: float = 0.6) -> DataFrame:
    """Memories of facts (subject, predicate, object): semantic rows whose id and hash follow from the content, so that the same
    fact is one row however often it was found. Facts with a null part give none."""
    whole = found.where("subject is not null and predicate is not null and object is not null").select("subject", "predicate", "object").distinct()
    digest = F.sha2(F.concat_ws(":", F.lit("fact"), "subject", "predicate", "object"), 256)
    return whole.select(
        F.substring(digest, 1, 32).alias("id"), F.lit("semantic").alias("tier"), F.lit("Fact").alias("kind"), "subject", "predicate", "object", F.lit(base).alias("base_score"), digest.alias("content_hash")
    )


def listed_facts(memories: DataFrame, pattern: str = "", most: int = 10_000) -> DataFrame:
    """Facts and preferences whose subject, object or key holds the pattern; with an empty one the newest `most` of the semantic tier."""
    rows = memories.where("kind in ('Fact', 'Preference')")
    if not pattern:
        return rows.where("tier = 'semantic'").orderBy(F.desc_nulls_last("created_at"), "id").limit(most)
    holds = lambda c: F.coalesce(F.contains(F.lower(c), F.lit(pattern.lower())), F.lit(False))
    return rows.where(holds("subject") | holds("object") | holds("key"))


def merge_facts(memories: DataFrame, merges: DataFrame, factor: float = 0.3) -> tuple[DataFrame, DataFrame]:
    """(memories, links) after merges (keeper, merged): a Supersedes link for each, and the merged facts' base score times the
    factor with their salience worked out again. A fact merged into several is weakened once."""
    once = merges.where("keeper <> merged").groupBy(F.col("merged").alias("id")).agg(F.lit(True).alias("weaker"))
    base = F.when(F.col("weaker"), F.col("base_score") * factor).otherwise(F.col("base_score"))
    rows = memories.join(once, "id", "left").withColumn("base_score", base)
    rows = rows.withColumn("effective", F.when(F.col("weaker"), F.col("base_score") * F.col("emotional") * F.col("access_boost") * F.col("decay_factor")).otherwise(F.col("effective"))).drop("weaker")
    links = merges.where("keeper <> merged").select(F.col("keeper").alias("source_id"), F.col("merged").alias("target_id"), F.lit("Supersedes").alias("relation"), F.lit(1.0).alias("strength")).distinct()
    return rows, links


def update_confidence(memories: DataFrame, changes: DataFrame) -> DataFrame:
    """Preferences with the confidence of changes (id, confidence), as it is; of several changes the greatest."""
    new = changes.groupBy("id").agg(F.max("confidence").alias("_new"))
    return memories.join(new, "id", "left").withColumn("confidence", F.when(F.col("kind") == "Preference", F.coalesce("_new", "confidence")).otherwise(F.col("confidence"))).drop("_new")


def strongest_beliefs(folded: DataFrame, least: float, most: int) -> DataFrame:
    """Beliefs of at least a probability, the most probable first."""
    return folded.where(F.col("probability") >= least).orderBy(F.desc("probability"), "key").limit(most)


def record_interactions(people: DataFrame, interactions: DataFrame) -> DataFrame:
    """People with interactions (id, ts) counted in and the last one seen. Ids that are no person's count for nothing."""
    new = interactions.groupBy("id").agg(F.count("*").alias("_n"), F.max("ts").alias("_ts"))
    return people.join(new, "id", "left").withColumns({
        "interaction_count": F.coalesce("interaction_count", F.lit(0)) + F.coalesce("_n", F.lit(0)), "last_seen": F.greatest("last_seen", "_ts"),
    }).drop("_n", "_ts")


def disclosure_budget(reads: DataFrame, budget: int) -> DataFrame:
    """(day, client, n_reads, n_items, over): reads (ts, client, item) of a day, the different items among them, and whether
    those exceed the budget."""
    by = reads.groupBy(F.to_date("ts").alias("day"), "client").agg(F.count("*").alias("n_reads"), F.countDistinct("item").alias("n_items"))
    return by.withColumn("over", F.col("n_items") > budget)
