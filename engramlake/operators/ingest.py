"""Batches of new texts against the store: exact duplicates, report, sessions' summaries and context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engramlake.session import checkpointed


def first_copies(batch: DataFrame, store: DataFrame | None = None) -> DataFrame:
    """batch (seq, text) with content_hash, `stored` (the first of its text, and not in the store) and `first_seq`.

    The first of each text is an aggregate, so a text that a third of the batch repeats is no heavier than another.
    """
    hashed = batch.withColumn("content_hash", F.sha2("text", 256))
    first = hashed.where("text is not null").groupBy("content_hash").agg(F.min("seq").alias("first_seq"))
    if store is not None:
        first = first.join(store.select("content_hash", F.lit(True).alias("known")).distinct(), "content_hash", "left")
    else:
        first = first.withColumn("known", F.lit(None).cast("boolean"))
    return hashed.join(first, "content_hash", "left").select("seq", "content_hash", "first_seq", F.coalesce((F.col("seq") == F.col("first_seq")) & F.col("known").isNull(), F.lit(False)).alias("stored"))


def batch_report(marked: DataFrame) -> DataFrame:
    """One row: submitted, stored, deduplicated, skipped (null texts)."""
    skipped = F.col("content_hash").isNull()
    return marked.agg(
        F.count("*").alias("submitted"), F.count_if("stored").alias("stored"), F.count_if(~F.col("stored") & ~skipped).alias("deduplicated"), F.count_if(skipped).alias("skipped")
    )


def tfidf(texts: DataFrame) -> DataFrame:
    """(session, id, score): how telling each text (session, id, text) is within its session: the sum over its words of
    frequency times ln(texts of the session / texts with the word). Counted by session and word, so long sessions are split."""
    split = F.filter(F.split(F.lower(F.btrim("text", F.lit(" \t\r\n"))), r"\s+"), lambda w: w != "")
    told = texts.where("text is not null").select("session", "id", split.alias("words")).where("size(words) > 0")
    n = told.groupBy("session").agg(F.count("*").alias("n"))
    words = told.select("session", "id", F.size("words").alias("total"), F.explode("words").alias("word"))
    counts = words.groupBy("session", "id", "total", "word").agg(F.count("*").alias("tf"))
    df = counts.groupBy("session", "word").agg(F.count("*").alias("df")).join(n, "session")
    joined = counts.join(df, ["session", "word"])
    return joined.groupBy("session", "id").agg(F.sum(F.col("tf") / F.col("total") * F.ln(F.col("n") / F.col("df"))).alias("score"))


def telling(scored: DataFrame, per_session: int) -> DataFrame:
    """The texts of each session that say most, numbered from 1."""
    w = Window.partitionBy("session").orderBy(F.desc(F.round("score", 9)), "id")
    return scored.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= per_session)


#: Sections of a context and their weights, fixed values.
SECTIONS = {"profile": 25, "facts": 25, "partner": 10, "recent": 20, "patterns": 10, "beliefs": 10}


def context_lines(memories: DataFrame, least_confidence: float = 0.3, include_private: bool = False) -> DataFrame:
    """(section, rank_by, id, line) of what a context may hold of the memories: preferences and facts held with some
    confidence, episodes by time, and the five patterns seen most, three times at least."""
    rows = memories.where("tier <> 'archived'") if include_private else memories.where("tier <> 'archived' and privacy <> 'private'")
    percent = lambda c: F.format_string(" (confidence: %.0f%%)", c * 100)
    prefs = rows.where((F.col("kind") == "Preference") & (F.col("tier") == "semantic") & (F.col("confidence") >= least_confidence))
    facts = rows.where((F.col("kind") == "Fact") & (F.col("tier") == "semantic") & (F.col("base_score") >= least_confidence))
    recent = rows.where("kind = 'Text' and tier = 'episodic' and text is not null")
    habits = rows.where("kind = 'Pattern' and frequency >= 3").orderBy(F.desc("frequency"), "id").limit(5)
    habit = F.concat(F.lit('- When "'), "trigger", F.lit('": '), F.concat_ws(", ", "actions"), F.format_string(" (seen %dx)", F.col("frequency")))
    return (
        prefs.select(F.lit("profile").alias("section"), F.col("base_score").alias("rank_by"), "id", F.concat(F.lit("- "), "key", F.lit(" = "), "value", percent(F.col("confidence"))).alias("line"))
        .union(facts.select(F.lit("facts"), "base_score", "id", F.concat(F.lit("- "), F.concat_ws(" ", "subject", "predicate", "object"), percent(F.col("base_score")))))
        .union(recent.select(F.lit("recent"), F.unix_millis("ingestion_time").cast("double"), "id", F.concat(F.lit("- ["), F.date_format("ingestion_time", "yyyy-MM-dd HH:mm"), F.lit("] "), F.substring("text", 1, 300))))
        .union(habits.select(F.lit("patterns"), F.col("frequency") / 100.0, "id", habit))
    )


def partner_lines(people: DataFrame, memories: DataFrame, person_id: str, include_private: bool = False) -> DataFrame:
    """The lines of one person: name, relationship, interactions, tags and the three newest texts of theirs."""
    one = people.where(F.col("id") == person_id)
    said = F.array(
        F.struct(F.lit(1.0).alias("rank_by"), F.concat(F.lit("- Name: "), "display_name").alias("line")),
        F.struct(F.lit(0.9).alias("rank_by"), F.when(F.col("relationship") != "", F.concat(F.lit("- Relationship: "), "relationship")).alias("line")),
        F.struct(F.lit(0.5).alias("rank_by"), F.concat(F.lit("- Interactions: "), F.col("interaction_count").cast("string")).alias("line")),
        F.struct(F.lit(0.4).alias("rank_by"), F.when(F.size("tags") > 0, F.concat(F.lit("- Tags: "), F.array_join("tags", ", "))).alias("line")),
    )
    about = one.select("id", F.explode(said).alias("s")).select(F.lit("partner").alias("section"), "s.rank_by", "id", "s.line").where("line is not null")
    texts = memories.where((F.col("identity_id") == person_id) & (F.col("kind") == "Text") & (F.col("tier") != "archived"))
    texts = (texts if include_private else texts.where("privacy <> 'private'")).where("text is not null").orderBy(F.desc_nulls_last("created_at"), "id").limit(3)
    return about.union(texts.select(F.lit("partner"), "base_score", "id", F.concat(F.lit("  - "), F.substring("text", 1, 300))))


def belief_lines(beliefs: DataFrame) -> DataFrame:
    """The lines of confident beliefs (key, probability), the furthest from even first."""
    side = F.when(F.col("probability") > 0.5, "likely").otherwise("unlikely")
    line = F.concat(F.lit("- "), "key", F.lit(" ("), side, F.format_string(", %.0f%%)", F.col("probability") * 100))
    return beliefs.select(F.lit("beliefs").alias("section"), (F.abs(F.col("probability") - 0.5) * 2).alias("rank_by"), F.col("key").alias("id"), line.alias("line"))


def plain_words(line: Column) -> Column:
    """The different words of a line in lower case without punctuation, in the order of the line."""
    return F.array_distinct(F.split(F.btrim(F.regexp_replace(F.lower(line), r"[^\p{L}\p{N}]+", " ")), " "))


def near_lines(a: Column, b: Column) -> Column:
    """Whether two lines, as their plain words, say nearly the same: the same words, or more than four fifths of the shorter's, where both have three."""
    common = F.size(F.array_intersect(a, b))
    return (a == b) | ((F.size(a) >= 3) & (F.size(b) >= 3) & (common > 0.8 * F.least(F.size(a), F.size(b))))


def context(lines: DataFrame, max_tokens: int = 2000) -> DataFrame:
    """(section, line_no, line): the best lines of each section within its share of the budget of four bytes a token.

    A line that says nearly what a better one of its section says is left out; this is judged among the lines that would fill two
    budgets, of which a line takes eight bytes at least. Sections without lines give their share to the others, and in a second pass all get an even part of what was
    not used, if that is more than a hundred bytes.
    """
    budget = 4 * max_tokens
    w = Window.partitionBy("section").orderBy(F.desc("rank_by"), "id")
    best = lines.where("line is not null").withColumn("at", F.row_number().over(w)).where(F.col("at") <= budget // 8)
    upto = Window.partitionBy("section").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    some = best.withColumn("size", F.sum(F.octet_length("line")).over(upto)).where(F.col("size") <= 2 * budget)
    numbered = checkpointed(some.select("section", "at", "line", plain_words(F.col("line")).alias("words")))
    x, y = numbered.alias("x"), numbered.alias("y")
    same = (F.col("x.section") == F.col("y.section")) & (F.col("x.at") > F.col("y.at")) & near_lines(F.col("x.words"), F.col("y.words"))
    kept = checkpointed(x.join(y, same, "left_anti").withColumn("used", F.sum(F.octet_length("line")).over(upto)))
    weight = F.element_at(F.create_map(*[F.lit(v) for kv in SECTIONS.items() for v in kv]), F.col("section"))
    present = kept.groupBy("section").agg(F.first(weight).alias("weight"))
    shares = present.join(F.broadcast(present.agg(F.sum("weight").alias("all"), F.count("*").alias("n")))).select(  # one row
        "section", "n", F.floor(F.col("weight") * budget / F.col("all")).alias("share")
    )
    filled = shares.join(kept, "section").groupBy("section", "share", "n").agg(F.coalesce(F.max(F.when(F.col("used") <= F.col("share"), F.col("used"))), F.lit(0)).alias("taken"))
    left = filled.agg(F.sum(F.col("share") - F.col("taken")).alias("left"), F.first("n").alias("n")).select(F.when(F.col("left") > 100, F.floor(F.col("left") / F.col("n"))).otherwise(0).alias("bonus"))
    room = shares.join(F.broadcast(left)).select("section", (F.col("share") + F.col("bonus")).alias("room"))  # one row
    line_no = F.row_number().over(Window.partitionBy("section").orderBy("at"))
    return kept.join(F.broadcast(room), "section").where("used <= room").select("section", line_no.alias("line_no"), "line")  # one row a section
