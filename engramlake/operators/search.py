"""Keyword search and ranked retrieval."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from engramlake.operators import scans, vectors
from engramlake.operators.lifecycle import frecency, hours
from engramlake.operators.rendering import rendered
from engramlake.session import checkpointed

WORD = r"[\p{L}\p{N}]+"
#: Question words and the like that carry no meaning of their own, fixed values.
STOP_WORDS = (
    "a about am an and are as at be by can do does for from have how i in is it me my of on or our so that the their this to was we what when "
    "where which who why will with you your 的 了 是 我 你 吗 什么"
).split()
#: Words that tell the temporal intent of a query, in order of precedence; fixed values.
INTENTS = {
    "recent": "last time|recently|latest|most recent|just now|yesterday|today|this week|last week|this month|last month|the other day|最近|上次|昨天|今天|刚才|这周|上周|这个月|上个月|前几天|最新",
    "first": "first time|the first|originally|initially|at first|when did|earliest|began|started|第一次|最初|一开始|起初|最早|什么时候开始",
    "sequence": "before|after|then|followed by|in order|timeline|sequence|chronolog|when was|what happened|how many times|how often|之前|之后|然后|顺序|时间线|多少次|什么时候|先后",
}
#: Words that tell what a query asks for, in order of precedence; fixed values.
QUERY_TYPES = {
    "preference": "what do i like|my preference|do i prefer|my favorite|my favourite|我喜欢什么|我的偏好|我偏好|我喜欢的",
    "person": "who is|who was|who are|about him|about her|about them|^who |谁",
    "fact": "what is|what are|where does|where is|what does|是什么|哪里|在哪|做什么",
}
#: What ends a name after 关于, and words that are no name there; fixed values.
NAME_ENDS = r"[\s的了吗呢吧？！，。]"
NO_NAMES = "这个|那个|什么|哪个|一些|所有|我们|他们|项目|问题|情况|事情"
#: Capitalised words that begin a question and lower-case words of four letters that name nothing, fixed values.
NO_ENTITIES = "I The A An What Where When Who How Tell Do Does Is Are Was Were Can Could Will Would Should My Your His Her Their".split()
NO_TOPICS = "what where when about know tell does have".split()
#: A run of words that begin with a capital.
CAPITALS = r"(?:^|\s)([^\p{L}\p{N}\s]*\p{Lu}\S*(?:\s+[^\p{L}\p{N}\s]*\p{Lu}\S*)*)"


@dataclass(frozen=True)
class Weights:
    similarity: float = 0.30
    temporal: float = 0.18
    salience: float = 0.22
    social: float = 0.08
    channel: float = 0.07
    fts: float = 0.15
    frecency: float = 0.10

    def adapted(self, intent: str, kind: str) -> Weights:
        """Weights for a query's temporal intent and type."""
        w = self
        if intent != "none":
            w = replace(w, similarity=w.similarity * 0.6, temporal=w.temporal * 2.5, salience=w.salience * 0.8, frecency=0.0 if intent == "first" else w.frecency)
        if kind == "person":
            w = replace(w, temporal=w.temporal * 0.5, social=w.social * 3)
        elif kind == "fact":
            w = replace(w, similarity=w.similarity * 1.3, temporal=w.temporal * 0.7, fts=w.fts * 1.2)
        elif kind == "preference":
            w = replace(w, salience=w.salience * 1.5, social=w.social * 0.5)
        return w


@dataclass(frozen=True)
class Query:
    text: str
    entities: tuple = ()
    limit: int = 10
    namespace: str | None = None
    channel: str | None = None
    identity_id: str | None = None
    embedding: tuple | None = None
    #: Read from the text unless given.
    intent: str | None = None
    kind: str | None = None
    weights: Weights = field(default_factory=Weights)

    def resolved(self, spark: SparkSession) -> Query:
        """The query with its intent and type read from the text."""
        if self.intent and self.kind:
            return self
        r = spark.range(1).select(intent(F.lit(self.text)).alias("intent"), query_type(F.lit(self.text)).alias("kind")).first()
        return replace(self, intent=self.intent or r.intent, kind=self.kind or r.kind)

    @property
    def terms(self) -> list[str]:
        import re

        return sorted(set(re.findall(r"[^\W_]+", self.text.lower())))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), 0)


def _among(text: Column, table: dict[str, str], otherwise: str) -> Column:
    c = F.lower(text)
    out = None
    for name, pattern in table.items():
        out = F.when(c.rlike(pattern), name) if out is None else out.when(c.rlike(pattern), name)
    return out.otherwise(otherwise)


def intent(text: Column) -> Column:
    """Temporal intent of a query: recent, first, sequence or none; substrings count."""
    return _among(text, INTENTS, "none")


def _after_about(text: Column) -> Column:
    """What follows the first 关于, up to a blank or a particle."""
    return F.regexp_extract(text, f"关于([^{NAME_ENDS[1:]}*)", 1)


def query_type(text: Column) -> Column:
    """temporal, preference, person, fact or general. "about" before a capital and 关于 before a short name ask for a person."""
    name = _after_about(text)
    person = text.rlike(r"(?i:about )\p{Lu}") | (F.length(name).between(2, 4) & ~name.rlike(NO_NAMES))
    kinds = _among(text, QUERY_TYPES, "general")
    return F.when(intent(text) != "none", "temporal").when(kinds.isin("preference", "person"), kinds).when(person, "person").otherwise(kinds)


def query_entities(text: Column) -> Column:
    """What a query may be about: runs of capitalised words, what follows 关于 or "about ", and its words of four bytes and more."""
    bare = lambda w: F.regexp_replace(w, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")
    runs = F.transform(F.regexp_extract_all(text, F.lit(CAPITALS), 1), lambda r: F.array_join(F.transform(F.split(r, r"\s+"), bare), " "))
    runs = F.filter(runs, lambda r: ~r.isin(NO_ENTITIES))
    marked = F.filter(F.array(_after_about(text), F.regexp_extract(text, f"about ([^{NAME_ENDS[1:]}*)", 1)), lambda n: F.length(n).between(2, 6))
    named = F.concat(runs, marked)
    words = F.transform(F.split(F.lower(text), r"\s+"), lambda w: F.regexp_replace(w, r"[^\p{L}\p{N}]", ""))
    words = F.filter(words, lambda w: (F.octet_length(w) >= 4) & ~w.isin(NO_TOPICS) & ~F.exists(named, lambda n: F.lower(n) == w))
    return F.array_distinct(F.concat(named, words))


def weights_of(questions: DataFrame) -> DataFrame:
    """(id, intent, query_type and the weights) of questions (id, text): the adapted weights of all intents and types are one small table."""
    kinds = ["temporal", "preference", "person", "fact", "general"]
    rows = []
    for i in [*INTENTS, "none"]:
        for k in kinds:
            w = Weights().adapted(i, k)
            rows.append((i, k, *(round(x, 6) for x in (w.similarity, w.temporal, w.salience, w.social, w.fts, w.frecency))))
    table = questions.sparkSession.createDataFrame(rows, "intent string, query_type string, similarity double, temporal double, salience double, social double, fts double, frecency double")
    asked = questions.select("id", intent(F.col("text")).alias("intent"), query_type(F.col("text")).alias("query_type"))
    return asked.join(F.broadcast(table), ["intent", "query_type"])  # 20 rows


def _occurrences(words: Column, term: str) -> Column:
    return F.size(F.filter(words, lambda x: x == F.lit(term)))


def bm25(documents: DataFrame, terms: list[str], every: bool = True, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(id, score, norm) of the documents (id, text) with all, or any, of the terms.

    Only the query's terms are counted, in one pass without exploding texts, and the counts are kept for the steps that follow; the corpus statistics are one row. norm puts the
    best at 1 and the worst at 0, all at 1 if they are equal. Null texts are no documents.
    """
    terms = sorted(set(terms))
    w = tokens(F.col("text"))
    words = documents.where("text is not null").select("id", w.alias("w"))
    counted = checkpointed(words.select("id", F.size("w").alias("len"), *[_occurrences(F.col("w"), t).alias(f"tf{i}") for i, t in enumerate(terms)]))
    facts = counted.agg(F.count("*").alias("n"), F.avg("len").alias("avg_len"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))])
    has = [F.col(f"tf{i}") > 0 for i in range(len(terms))]
    matched = counted.where(reduce((lambda x, y: x & y) if every else (lambda x, y: x | y), has))
    part = []
    for i in range(len(terms)):
        tf, df = F.col(f"tf{i}"), F.col(f"df{i}")
        idf = F.ln(1 + (F.col("n") - df + 0.5) / (df + 0.5))
        part.append(idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("len") / F.col("avg_len"))))
    scored = matched.join(F.broadcast(facts)).select("id", reduce(lambda x, y: x + y, part).alias("score"))  # one row
    ends = scored.agg(F.min("score").alias("lo"), F.max("score").alias("hi"))
    norm = F.when(F.col("hi") > F.col("lo"), (F.col("score") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(1.0)
    return scored.join(F.broadcast(ends)).select("id", "score", norm.alias("norm"))  # one row


def with_all_terms(documents: DataFrame, terms: list[str]) -> DataFrame:
    """Documents whose words hold every term."""
    return documents.where(F.size(F.array_except(F.array(*map(F.lit, terms)), tokens(F.col("text")))) == 0)


def keyword_rank(documents: DataFrame, question: str, limit: int) -> DataFrame:
    """(id, score): share of the question's meaningful words that a document has, best first."""
    import re

    terms = sorted({t for t in re.findall(r"[^\W_]+", question.lower()) if len(t) > 1 and t not in STOP_WORDS})
    score = F.size(F.array_intersect(F.array(*map(F.lit, terms)), tokens(F.col("text")))) / float(len(terms))
    return documents.where("text is not null").select("id", score.alias("score")).where("score > 0").orderBy(F.desc("score"), "id").limit(limit)


def byte_budget(lines: DataFrame, budget: int, *order: Column) -> DataFrame:
    """The first lines by `order` that together fit the budget, in bytes. A line takes a byte at least, so no more than
    `budget` lines are ever put in order."""
    first = lines.orderBy(*order).limit(budget)
    used = F.sum(F.octet_length("line")).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return first.withColumn("used", used).where(F.col("used") <= budget)


def overlap_rank(documents: DataFrame, text: str, limit: int) -> DataFrame:
    """(id, score): share of the query's words plus a half if the whole query stands in the text."""
    terms = sorted(set(text.lower().split()))
    share = F.size(F.filter(F.array(*map(F.lit, terms)), lambda t: F.lower(F.col("text")).contains(t))) / float(len(terms))
    score = share + F.when(F.lower("text").contains(text.lower()), 0.5).otherwise(0.0)
    return documents.where("text is not null").select("id", score.alias("score")).where("score > 0").orderBy(F.desc("score"), "id").limit(limit)


def expansion_terms(memories: DataFrame, asked: Query, most: int = 64) -> DataFrame:
    """(term): what the store says about a query's entities, the `most` most frequent terms: of facts the other side and the
    predicate, and key and value of preferences whose key holds the whole query. The entities are read from the text unless given."""
    entities = F.array(*map(F.lit, asked.entities)) if asked.entities else query_entities(F.lit(asked.text))
    named = memories.sparkSession.range(1).select(F.explode(entities).alias("e")).select(F.lower("e").alias("e")).distinct()
    s, o = F.lower("subject"), F.lower("object")
    said = memories.where("kind = 'Fact'").select(s.alias("s"), F.lower("predicate").alias("p"), o.alias("o")).join(
        F.broadcast(named), F.contains("s", "e") | F.contains("o", "e")  # no more rows than the query has words
    ).select(F.explode(F.array(F.when(F.contains("s", "e"), F.col("o")).otherwise(F.col("s")), "p")).alias("term"))
    liked = memories.where("kind = 'Preference'").where(F.contains(F.lower("key"), F.lit(asked.text.lower()))).select(F.explode(F.array(F.lower("key"), F.lower("value"))).alias("term"))
    hits = said.union(liked).where("length(term) > 1 and term <> 'user'")
    return hits.groupBy("term").count().orderBy(F.desc("count"), "term").limit(most).select("term")


def expanded(memories: DataFrame, terms: DataFrame, limit: int) -> DataFrame:
    """Newest episodic memories whose text holds any of the terms (at most 64 rows, broadcast)."""
    rows = memories.where("tier = 'episodic' and text is not null")
    return scans.newest(rows.join(F.broadcast(terms), F.lower("text").contains(F.col("term")), "left_semi"), limit)


def multi_hop(memories: DataFrame, seeds: DataFrame, limit: int) -> DataFrame:
    """Newest facts that share a subject or an object, either way, with the facts among the seeds; "user" counts for nothing.

    seeds (id) are the first few candidates of a query and are broadcast, as are the two ends of each.
    """
    f = memories.where("kind = 'Fact'").select("id", F.lower("subject").alias("s"), F.lower("object").alias("o"), "created_at")
    ends = f.join(F.broadcast(seeds.select("id")), "id", "left_semi").select(F.explode(F.array("s", "o")).alias("e")).where("e <> 'user'").distinct()
    near = f.join(F.broadcast(ends), (F.col("s") == F.col("e")) | (F.col("o") == F.col("e")), "left_semi")
    return scans.newest(near.join(F.broadcast(seeds.select("id")), "id", "left_anti"), limit)


def temporal_candidates(memories: DataFrame, asked: str, limit: int) -> DataFrame:
    """Episodic memories by ingestion for a temporal intent: the newest, twice as many for a sequence, and the oldest for "first"."""
    rows = memories.where("tier = 'episodic'")
    if asked == "first":
        return rows.orderBy(F.asc_nulls_last("ingestion_time"), "id").limit(limit)
    return scans.newest(rows, limit * 2 if asked == "sequence" else limit, "ingestion_time")


def signals(memories: DataFrame, query: Query, now: Column) -> DataFrame:
    """`memories` (with similarity and fts) and the seven signals of a query."""
    query = query.resolved(memories.sparkSession)
    h = hours(now, F.col("ingestion_time"))
    temporal = {"recent": F.exp(-h / 48.0), "first": F.least(h / 8760.0, F.lit(1.0)), "sequence": F.when(F.col("event_time").isNotNull(), 0.7).otherwise(0.4)}.get(query.intent, F.exp(-h / 168.0))
    person = F.lit(query.identity_id)
    social = F.when((F.col("identity_id") == person) | (F.col("person_a") == person) | (F.col("person_b") == person), 1.0).otherwise(0.0)
    return memories.select(
        "*", temporal.alias("s_temporal"), F.col("effective").alias("s_salience"), social.alias("s_social"),
        F.when(F.col("channel") == F.lit(query.channel), 1.0).otherwise(0.0).alias("s_channel"), frecency(now).alias("s_frecency"),
    )


def ranked(candidates: DataFrame, query: Query, now: Column) -> DataFrame:
    """(id, score): the best by the weighted sum of signals; archived rows and those of other namespaces never count."""
    query = query.resolved(candidates.sparkSession)
    rows = candidates.where("tier <> 'archived'")
    if query.namespace:
        rows = rows.where(F.col("namespace") == query.namespace)
    w = query.weights.adapted(query.intent, query.kind)
    c = F.col
    score = (
        w.similarity * c("similarity") + w.temporal * c("s_temporal") + w.salience * c("s_salience") + w.social * c("s_social")
        + w.channel * c("s_channel") + w.fts * c("fts") + w.frecency * c("s_frecency")
    )
    return signals(rows, query, now).select("id", score.alias("score")).orderBy(F.desc("score"), "id").limit(query.limit)


def retrieve(memories: DataFrame, query: Query, now: Column, embedded: DataFrame | None = None) -> DataFrame:
    """(id, score) of the memories that answer a query best.

    Candidates come from phases, and the first phase that names a memory sets its similarity: the nearest by vector with
    their cosine, if the query has an embedding; only where that gives none, the newest (0.5); those the facts and preferences
    about the query's entities lead to (0.30), memories by time if the query asks about time (0.3), facts one hop from
    the five best candidates so far (0.25) and keyword matches (0.2). Every phase ends in a top-k, so few rows are ever joined.

    embedded: (id, embedding) of memories; those of another dimension than the query's count for nothing.
    """
    spark, k = memories.sparkSession, query.limit
    query = query.resolved(spark)
    phases = []
    newest = scans.newest(memories.where("tier = 'episodic'"), 3 * k).select("id").union(scans.newest(memories.where("tier = 'semantic'"), 3 * k).select("id"))
    if query.embedding is not None and embedded is not None:
        near = vectors.top_k_of(embedded, query.embedding, 5 * k)
        phases.append((1, F.col("score"), near))
        newest = newest.join(F.broadcast(near.agg((F.count("*") == 0).alias("none")))).where("none")  # one row
    phases.append((2, F.lit(0.5), newest))
    phases.append((3, F.lit(0.30), expanded(memories, expansion_terms(memories, query), k)))
    if query.intent != "none":
        phases.append((4, F.lit(0.3), temporal_candidates(memories, query.intent, 3 * k)))
    named = lambda ps: reduce(DataFrame.union, [df.select("id", F.lit(p).alias("phase"), s.alias("sim")) for p, s, df in ps])
    first = lambda df: df.groupBy("id").agg(F.min_by("sim", "phase").alias("similarity"))
    early = checkpointed(named(phases))  # a few rows, asked for three times below
    seeds = checkpointed(first(early).orderBy(F.desc("similarity"), "id").limit(5))
    phases = [(5, F.lit(0.25), multi_hop(memories, seeds, k))]
    matches = bm25(memories.where("privacy <> 'private'").select("id", rendered().alias("text")), query.terms)
    best = matches.orderBy(F.desc("score"), "id").limit(3 * k)
    phases.append((6, F.lit(0.2), best))
    rows = memories.join(F.broadcast(first(early.union(named(phases)))), "id").join(F.broadcast(best.select("id", F.col("norm").alias("fts"))), "id", "left")  # less than 20 rows for each one asked for
    return ranked(rows.withColumn("fts", F.coalesce("fts", F.lit(0.0))), query, now)
