"""Queries over keyword search, retrieval, extraction, ingest and context, with the same question in SQL."""

from pyspark.sql import functions as F

from engramlake.operators import extraction, ingest, search, vectors
from engramlake.operators.lifecycle import frecency, hours
from engramlake.sources import memory_sql as sq
from engramlake.sources import memory_store as ms
from engramlake.sources import table

QUERIES, ORACLE = {}, {}
_NOW = "TIMESTAMPTZ '2026-07-01 00:00:00+00'"


def now():
    return F.to_timestamp(F.lit("2026-07-01 00:00:00"))


def query(name: str, sql: str | None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return register


def _documents(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _bm25_sql(source: str, terms: list[str], every: bool = True, name: str = "bm") -> str:
    tf = ", ".join(f"len(list_filter(w, lambda x: x = {quoted(t)})) AS tf{i}" for i, t in enumerate(terms))
    df = ", ".join(f"count(*) FILTER (tf{i} > 0) AS df{i}" for i in range(len(terms)))
    part = " + ".join(f"ln(1 + (n - df{i} + 0.5) / (df{i} + 0.5)) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * len / avg_len))" for i in range(len(terms)))
    has = (" AND " if every else " OR ").join(f"tf{i} > 0" for i in range(len(terms)))
    return f"""{name}_c AS (SELECT id, len(w) AS len, {tf} FROM (SELECT id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS w FROM ({source}) WHERE text IS NOT NULL)),
 {name}_s AS (SELECT id, {part} AS score FROM {name}_c, (SELECT count(*) AS n, avg(len) AS avg_len, {df} FROM {name}_c) WHERE {has}),
 {name} AS (SELECT id, score, CASE WHEN max(score) OVER () > min(score) OVER () THEN (score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()) ELSE 1.0 END AS norm FROM {name}_s)"""


_DOCS = "SELECT doc_id AS id, text FROM documents"


@query("t1_bm25", "WITH " + _bm25_sql(_DOCS, ["ferry", "terminal"]) + " SELECT id, round(score, 6) AS score, round(norm, 6) AS norm FROM bm ORDER BY score DESC, id LIMIT 100")
def t1(spark, d):
    return search.bm25(_documents(spark, d), ["ferry", "terminal"]).orderBy(F.desc("score"), "id").limit(100).select("id", F.round("score", 6).alias("score"), F.round("norm", 6).alias("norm"))


@query("t1_bm25_any", "WITH " + _bm25_sql(_DOCS, ["garage", "lentil", "risotto"], False) + " SELECT id, round(score, 6) AS score FROM bm")
def t1a(spark, d):
    return search.bm25(_documents(spark, d), ["garage", "lentil", "risotto"], every=False).select("id", F.round("score", 6).alias("score"))


@query("t2_all_terms", f"SELECT id FROM ({_DOCS}) WHERE list_has_all(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+'), ['the', 'garden', 'pump'])")
def t2(spark, d):
    return search.with_all_terms(_documents(spark, d), ["the", "garden", "pump"]).select("id")


@query("t3_keyword_rank", f"SELECT id, round(n / 3.0, 6) AS score FROM (SELECT id, len(list_intersect(['pump', 'garden', 'library'], regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+'))) AS n FROM ({_DOCS})) WHERE n > 0 ORDER BY n DESC, id LIMIT 200")
def t3(spark, d):
    return search.keyword_rank(_documents(spark, d), "where is the garden pump of the library", 200).select("id", F.round("score", 6).alias("score"))


@query("t4_overlap", f"SELECT id, round(score, 6) AS score FROM (SELECT id, (contains(lower(text), 'garden')::INT + contains(lower(text), 'pump')::INT) / 2.0 + CASE WHEN contains(lower(text), 'garden pump') THEN 0.5 ELSE 0 END AS score FROM ({_DOCS})) WHERE score > 0 ORDER BY score DESC, id LIMIT 200")
def t4(spark, d):
    return search.overlap_rank(_documents(spark, d), "garden pump", 200).select("id", F.round("score", 6).alias("score"))


@query("t3_byte_budget", f"SELECT id FROM (SELECT id, sum(octet_length(encode(line))) OVER (ORDER BY id ROWS UNBOUNDED PRECEDING) AS used FROM (SELECT doc_id AS id, text AS line FROM documents WHERE text IS NOT NULL)) WHERE used <= 4096")
def t3b(spark, d):
    return search.byte_budget(_documents(spark, d).where("text is not null").withColumnRenamed("text", "line"), 4096, F.col("id")).select("id")


def _case(table: dict, column: str, otherwise: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(lower({column}), {quoted(p)}) THEN {quoted(k)}" for k, p in table.items()) + f" ELSE {quoted(otherwise)} END"


_INTENT = _case(search.INTENTS, "text", "none")


@query("r9_intent", sq.with_m(f"SELECT intent, count(*) AS n FROM (SELECT {_INTENT} AS intent FROM m WHERE kind = 'Text') GROUP BY 1"))
def r9(spark, d):
    return ms.memories(spark, d).where("kind = 'Text'").groupBy(search.intent(F.col("text")).alias("intent")).agg(F.count("*").alias("n"))


_ABOUT = "regexp_extract(text, '关于([^\\s的了吗呢吧？！，。]*)', 1)"
_TYPE = f"""CASE WHEN {_INTENT} <> 'none' THEN 'temporal' WHEN regexp_matches(lower(text), 'what do i like|my preference|do i prefer|my favou?rite|我喜欢什么|我的偏好|我偏好|我喜欢的') THEN 'preference'
 WHEN regexp_matches(lower(text), 'who (is|was|are)|about (him|her|them)|^who |谁') OR regexp_matches(text, '[aA][bB][oO][uU][tT] \\p{{Lu}}') THEN 'person'
 WHEN length({_ABOUT}) BETWEEN 2 AND 4 AND NOT regexp_matches({_ABOUT}, '这个|那个|什么|哪个|一些|所有|我们|他们|项目|问题|情况|事情') THEN 'person'
 WHEN regexp_matches(lower(text), 'what (is|are|does)|where (is|does)|是什么|哪里|在哪|做什么') THEN 'fact' ELSE 'general' END""".replace("\\\\", "\\")


@query("r10_query_type", f"SELECT id, {_TYPE} AS query_type FROM ({_DOCS}) WHERE text IS NOT NULL")
def r10(spark, d):
    return _documents(spark, d).where("text is not null").select("id", search.query_type(F.col("text")).alias("query_type"))


_WORDS = "list_transform(regexp_split_to_array(lower(text), '\\s+'), lambda w: regexp_replace(w, '[^\\p{L}\\p{N}]', '', 'g'))"
_RUNS = "list_transform(regexp_extract_all(text, '(?:^|\\s)([^\\p{L}\\p{N}\\s]*\\p{Lu}\\S*(?:\\s+[^\\p{L}\\p{N}\\s]*\\p{Lu}\\S*)*)', 1), lambda r: array_to_string(list_transform(regexp_split_to_array(r, '\\s+'), lambda w: regexp_replace(w, '^[^\\p{L}\\p{N}]+|[^\\p{L}\\p{N}]+$', '', 'g')), ' '))"
_ENTITIES = f"""e1 AS (SELECT id, text, list_concat(list_filter({_RUNS}, lambda r: r NOT IN ('I', 'The', 'A', 'An', 'What', 'Where', 'When', 'Who', 'How', 'Tell', 'Do', 'Does', 'Is', 'Are', 'Was', 'Were', 'Can', 'Could', 'Will', 'Would', 'Should', 'My', 'Your', 'His', 'Her', 'Their')),
 list_filter([{_ABOUT}, regexp_extract(text, 'about ([^\\s的了吗呢吧？！，。]*)', 1)], lambda n: length(n) BETWEEN 2 AND 6)) AS named FROM lines),
e2 AS (SELECT id, text, list_concat(named, list_filter({_WORDS}, lambda w: octet_length(encode(w)) >= 4 AND w NOT IN ('what', 'where', 'when', 'about', 'know', 'tell', 'does', 'have') AND NOT list_contains(list_transform(named, lambda n: lower(n)), w))) AS entities FROM e1)"""


@query("r11_entities", f"WITH lines AS (SELECT doc_id AS id, unnest(string_split(text, chr(10))) AS text FROM documents WHERE text IS NOT NULL), {_ENTITIES} SELECT entity, count(*) AS n FROM (SELECT unnest(list_distinct(entities)) AS entity FROM e2) GROUP BY 1")
def r11(spark, d):
    """How many lines of the documents name each entity."""
    found = _lines(spark, d).select(F.explode(search.query_entities(F.col("text"))).alias("entity"))
    return found.groupBy("entity").agg(F.count("*").alias("n"))


@query("r12_weights", f"""SELECT intent, query_type, count(*) AS n, round(0.30::DOUBLE * CASE WHEN intent <> 'none' THEN 0.6 ELSE 1 END * CASE query_type WHEN 'fact' THEN 1.3 ELSE 1 END, 6) AS similarity,
 round(0.18::DOUBLE * CASE WHEN intent <> 'none' THEN 2.5 ELSE 1 END * CASE query_type WHEN 'person' THEN 0.5 WHEN 'fact' THEN 0.7 ELSE 1 END, 6) AS temporal, round(0.22::DOUBLE * CASE WHEN intent <> 'none' THEN 0.8 ELSE 1 END * CASE query_type WHEN 'preference' THEN 1.5 ELSE 1 END, 6) AS salience,
 round(0.08::DOUBLE * CASE query_type WHEN 'person' THEN 3 WHEN 'preference' THEN 0.5 ELSE 1 END, 6) AS social, round(0.15::DOUBLE * CASE query_type WHEN 'fact' THEN 1.2 ELSE 1 END, 6) AS fts, CASE intent WHEN 'first' THEN 0.0 ELSE 0.1 END::DOUBLE AS frecency
 FROM (SELECT {_INTENT} AS intent, {_TYPE} AS query_type FROM ({_DOCS}) WHERE text IS NOT NULL) GROUP BY 1, 2""")
def r12(spark, d):
    """The weights that each document, taken for a question, would be ranked with."""
    return search.weights_of(_documents(spark, d).where("text is not null")).groupBy("intent", "query_type", "similarity", "temporal", "salience", "social", "fts", "frecency").agg(F.count("*").alias("n"))


_H = "greatest(0, floor((epoch_us({0}) - epoch_us({1})) / 3600000000))"
_FRECENCY = f"0.5 * (1 - exp(-access_count / 5.0)) + 0.5 * exp(-{_H.format(_NOW, 'last_accessed')} / 168.0)"


@query("r13_signals", sq.with_m(f"SELECT id, round(exp(-{_H.format(_NOW, 'ingestion_time')} / 168.0), 6) AS s_temporal, round({_FRECENCY}, 6) AS s_frecency, CASE WHEN channel = 'slack' THEN 1.0 ELSE 0.0 END::DOUBLE AS s_channel FROM m"))
def r13(spark, d):
    q = search.Query("garden pump", channel="slack")
    return search.signals(ms.memories(spark, d), q, now()).select("id", F.round("s_temporal", 6).alias("s_temporal"), F.round("s_frecency", 6).alias("s_frecency"), "s_channel")


def _score(similarity: str, fts: str, channel: str = "0") -> str:
    return f"0.30 * {similarity} + 0.18 * exp(-{_H.format(_NOW, 'ingestion_time')} / 168.0) + 0.22 * effective + 0.07 * {channel} + 0.15 * {fts} + 0.10 * ({_FRECENCY})"


@query("r14_rank", sq.with_m(f"SELECT id, round({_score('0.5', '0.0', '(CASE WHEN channel = ' + quoted('slack') + ' THEN 1 ELSE 0 END)')}, 6) AS score FROM m WHERE tier <> 'archived' AND namespace = 'work' ORDER BY {_score('0.5', '0.0', '(CASE WHEN channel = ' + quoted('slack') + ' THEN 1 ELSE 0 END)')} DESC, id LIMIT 50"))
def r14(spark, d):
    rows = ms.memories(spark, d).withColumn("similarity", F.lit(0.5)).withColumn("fts", F.lit(0.0))
    q = search.Query("anything", limit=50, namespace="work", channel="slack")
    return search.ranked(rows, q, now()).select("id", F.round("score", 6).alias("score"))


def _terms_sql(entities: list[str], text: str) -> str:
    names = ", ".join(f"({quoted(e)})" for e in entities)
    return f"""terms AS (SELECT term FROM (SELECT unnest([CASE WHEN contains(lower(subject), e) THEN lower(object) ELSE lower(subject) END, lower(predicate)]) AS term
 FROM m, (VALUES {names}) v(e) WHERE kind = 'Fact' AND (contains(lower(subject), e) OR contains(lower(object), e))
 UNION ALL SELECT unnest([lower(key), lower(value)]) FROM m WHERE kind = 'Preference' AND contains(lower(key), {quoted(text)}))
 WHERE length(term) > 1 AND term <> 'user' GROUP BY 1 ORDER BY count(*) DESC, term LIMIT 64)"""


@query("r4_expand", sq.with_m("SELECT id FROM m WHERE tier = 'episodic' AND text IS NOT NULL AND EXISTS (SELECT 1 FROM terms WHERE contains(lower(text), term)) ORDER BY created_at DESC NULLS LAST, id LIMIT 50", _terms_sql(["garden"], "plan")))
def r4(spark, d):
    m = ms.memories(spark, d)
    return search.expanded(m, search.expansion_terms(m, search.Query("plan", ("garden",))), 50).select("id")


_HOP = """seeds AS (SELECT id FROM m WHERE tier = 'semantic' AND kind = 'Fact' ORDER BY created_at DESC NULLS LAST, id LIMIT 5),
 hops AS (SELECT DISTINCT e FROM (SELECT unnest([lower(subject), lower(object)]) AS e FROM m WHERE kind = 'Fact' AND id IN (SELECT id FROM seeds)) WHERE e <> 'user')"""


@query("r6_multihop", sq.with_m("SELECT id FROM m WHERE kind = 'Fact' AND id NOT IN (SELECT id FROM seeds) AND (lower(subject) IN (SELECT e FROM hops) OR lower(object) IN (SELECT e FROM hops)) ORDER BY created_at DESC NULLS LAST, id LIMIT 30", _HOP))
def r6(spark, d):
    from engramlake.operators import scans

    m = ms.memories(spark, d)
    return search.multi_hop(m, scans.newest(m.where("tier = 'semantic' and kind = 'Fact'"), 5), 30).select("id")


_LINE = """CASE kind WHEN 'Text' THEN text WHEN 'Fact' THEN concat_ws(' ', subject, predicate, object) WHEN 'Preference' THEN key || ' = ' || value
 WHEN 'Relationship' THEN concat_ws(' ', person_a, relation, person_b) WHEN 'Pattern' THEN trigger || ' -> ' || array_to_string(actions, ', ') WHEN 'Event' THEN concat_ws(' @ ', title, start) END"""
_VECTORS = sq.VECTORS
_AGE = _H.format(_NOW, "ingestion_time")


def _retrieve_sql(text: str, entities: list[str], intent: str = "none", vector: int | None = None) -> str:
    words = sorted(set(text.split()))
    temporal = {"none": f"0.18 * exp(-{_AGE} / 168.0)", "recent": f"0.45 * exp(-{_AGE} / 48.0)", "first": f"0.45 * least({_AGE} / 8760.0, 1.0)", "sequence": "0.45 * CASE WHEN event_time IS NOT NULL THEN 0.7 ELSE 0.4 END"}[intent]
    s, e, f = (0.30, 0.22, 0.10) if intent == "none" else (0.18, 0.176, 0.0 if intent == "first" else 0.10)
    score = f"{s} * similarity + {temporal} + {e} * effective + 0.15 * coalesce(fts, 0.0) + {f} * ({_FRECENCY})"
    by_time = {"none": None, "recent": "DESC NULLS LAST, id LIMIT 30", "sequence": "DESC NULLS LAST, id LIMIT 60", "first": "ASC NULLS LAST, id LIMIT 30"}[intent]
    newest = """SELECT id, 2 AS phase, 0.5::DOUBLE AS sim FROM (SELECT id FROM m WHERE tier = 'episodic' ORDER BY created_at DESC NULLS LAST, id LIMIT 30)
 UNION ALL SELECT id, 2, 0.5 FROM (SELECT id FROM m WHERE tier = 'semantic' ORDER BY created_at DESC NULLS LAST, id LIMIT 30)"""
    cosine = f"list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = {vector}))"
    start = newest if vector is None else f"SELECT id, 1 AS phase, sim FROM (SELECT id, {cosine} AS sim FROM v ORDER BY sim DESC, id LIMIT 50)"
    timed = f" UNION ALL SELECT id, 4, 0.3 FROM (SELECT id FROM m WHERE tier = 'episodic' ORDER BY ingestion_time {by_time})" if by_time else ""
    return sq.with_m(
        f"""SELECT id, round(score, 6) AS score FROM (SELECT m.id, {score} AS score
 FROM m JOIN (SELECT id, arg_min(sim, phase) AS similarity FROM named GROUP BY 1) USING (id) LEFT JOIN (SELECT id, norm AS fts FROM best) USING (id) WHERE tier <> 'archived') ORDER BY score DESC, id LIMIT 10""",
        _VECTORS,
        _terms_sql(entities, text),
        f"""early AS ({start} UNION ALL SELECT id, 3, 0.3 FROM (SELECT id FROM m WHERE tier = 'episodic' AND text IS NOT NULL AND EXISTS (SELECT 1 FROM terms WHERE contains(lower(text), term)) ORDER BY created_at DESC NULLS LAST, id LIMIT 10){timed})""",
        "seeds AS (SELECT id FROM (SELECT id, arg_min(sim, phase) AS sim FROM early GROUP BY 1) ORDER BY sim DESC, id LIMIT 5)",
        "hops AS (SELECT DISTINCT e FROM (SELECT unnest([lower(subject), lower(object)]) AS e FROM m WHERE kind = 'Fact' AND id IN (SELECT id FROM seeds)) WHERE e <> 'user')",
        _bm25_sql(f"SELECT id, {_LINE} AS text FROM m WHERE privacy <> 'private'", words),
        "best AS (SELECT * FROM bm ORDER BY score DESC, id LIMIT 30)",
        """named AS (SELECT * FROM early
 UNION ALL SELECT id, 5, 0.25 FROM (SELECT id FROM m WHERE kind = 'Fact' AND id NOT IN (SELECT id FROM seeds) AND (lower(subject) IN (SELECT e FROM hops) OR lower(object) IN (SELECT e FROM hops)) ORDER BY created_at DESC NULLS LAST, id LIMIT 10)
 UNION ALL SELECT id, 6, 0.2 FROM best)""",
    )


def _memory_vectors(spark, d):
    """(id, embedding): memories with the test vector that the first digits of their id point to."""
    at = F.pmod(F.conv(F.substring("id", 1, 8), 16, 10).cast("bigint"), F.lit(500))
    return ms.memories(spark, d).where(F.col("id").rlike("^[0-9a-f]{8}")).select("id", at.alias("vec_id")).join(table(spark, d, "embeddings").select("vec_id", "embedding"), "vec_id").select("id", "embedding")


def _vector(spark, d, vec_id: int) -> tuple:
    return tuple(table(spark, d, "embeddings").where(F.col("vec_id") == vec_id).first().embedding)


def _retrieved(spark, d, asked, embedded=None):
    return search.retrieve(ms.memories(spark, d), asked, now(), embedded).select("id", F.round("score", 6).alias("score"))


@query("r1_retrieve", _retrieve_sql("garden pump", ["garden", "pump"]))
def r1(spark, d):
    return _retrieved(spark, d, search.Query("garden pump"))


@query("r2_vector_retrieve", _retrieve_sql("garden pump", ["garden", "pump"], vector=7))
def r2(spark, d):
    return _retrieved(spark, d, search.Query("garden pump", embedding=_vector(spark, d, 7)), _memory_vectors(spark, d))


@query("r5_first", _retrieve_sql("originally garden", ["originally", "garden"], "first"))
def r5a(spark, d):
    return _retrieved(spark, d, search.Query("originally garden"))


@query("r5_sequence", _retrieve_sql("garden timeline", ["garden", "timeline"], "sequence"))
def r5b(spark, d):
    return _retrieved(spark, d, search.Query("garden timeline"))


@query("r5_recent", _retrieve_sql("garden yesterday", ["garden", "yesterday"], "recent"))
def r5c(spark, d):
    return _retrieved(spark, d, search.Query("garden yesterday"))


_COSINE = "list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 11))"


@query("v6_tier_time", sq.with_m(f"SELECT id, round({_COSINE}, 6) AS score FROM v WHERE id IN (SELECT id FROM m WHERE tier = 'episodic' AND ingestion_time BETWEEN TIMESTAMPTZ '2025-06-01 00:00:00+00' AND TIMESTAMPTZ '2025-12-01 00:00:00+00') ORDER BY {_COSINE} DESC, id LIMIT 25", _VECTORS))
def v6(spark, d):
    some = ms.memories(spark, d).where("tier = 'episodic'").where(F.col("ingestion_time").between(F.to_timestamp(F.lit("2025-06-01")), F.to_timestamp(F.lit("2025-12-01"))))
    return vectors.restricted_top_k(_memory_vectors(spark, d), some, _vector(spark, d, 11), 25).select("id", F.round("score", 6).alias("score"))


def _lines(spark, d):
    """Lines of the documents, each a text of its own."""
    docs = table(spark, d, "documents")
    return docs.where("text is not null").select(F.col("doc_id").alias("id"), F.explode(F.split("text", "\n")).alias("text"))


_LINES = "lines AS (SELECT doc_id AS id, unnest(string_split(text, chr(10))) AS text FROM documents WHERE text IS NOT NULL)"


def _rules_sql() -> str:
    parts = []
    for pattern, kind, predicate, confidence, capital, *unless in extraction.RULES:
        value = f"trim(split_part(regexp_extract(regexp_extract(t, {quoted('(?i)^' + pattern + '(.*)')}, 1), '^({extraction.CLAUSE})', 1), ' and ', 1), ' ')"
        if capital:
            value = f"upper(substr({value}, 1, 1)) || substr({value}, 2)"
        but = "".join(f" AND NOT regexp_matches(t, {quoted(u)})" for u in unless)
        parts.append(f"SELECT id, '{kind}' AS rule_kind, '{predicate}' AS predicate, {value} AS value, {confidence} AS confidence FROM t WHERE regexp_matches(t, {quoted('(?i)^' + pattern)}){but}")
    for pattern, kind, predicate, confidence, value, key, unless, *needs in extraction.PATTERNS:
        said = quoted(value) if isinstance(value, str) else f"trim(regexp_extract(t, {quoted(pattern)}, {value}), ' ')"
        named = f"'{predicate}'" + (f" || trim(regexp_extract(t, {quoted(pattern)}, {key}), ' ')" if key else "")
        but = (f" AND NOT regexp_matches(t, {quoted(unless)})" if unless else "") + "".join(f" AND regexp_matches(t, {quoted(n)})" for n in needs)
        parts.append(f"SELECT id, '{kind}', {named}, {said}, {confidence} FROM t WHERE regexp_matches(t, {quoted(pattern)}){but}")
    return " UNION ALL ".join(parts)


@query("i8_knowledge", f"""WITH {_LINES}, t AS (SELECT id, trim(regexp_replace(text, '^(user|assistant|[*#-]|[[][^]]*[]]) ?:? ?', ''), ' ' || chr(9) || chr(13) || chr(10)) AS t FROM lines),
 found AS ({_rules_sql().replace(' FROM t WHERE', ' FROM t WHERE NOT regexp_matches(lower(t), ' + quoted(extraction.NEGATIONS) + ') AND')})
 SELECT rule_kind, predicate, value, count(*) AS n FROM found WHERE value <> '' AND octet_length(encode(value)) < 80 GROUP BY 1, 2, 3""")
def i8(spark, d):
    text = F.regexp_replace("text", r"^(user|assistant|[*#-]|\[[^\]]*\]) ?:? ?", "")
    return extraction.knowledge(_lines(spark, d).select("id", text.alias("text"))).groupBy("rule_kind", "predicate", "value").agg(F.count("*").alias("n"))


def _count_sql(words) -> str:
    return " + ".join(f"contains(lower(text), {quoted(w)})::INT" for w in words)


@query("i12_hint", sq.with_m(f"SELECT id, CASE WHEN a > b THEN 'temporary' WHEN b > a THEN 'permanent' ELSE 'unknown' END AS hint FROM (SELECT id, {_count_sql(extraction.TEMPORARY)} AS a, {_count_sql(extraction.PERMANENT)} AS b FROM m WHERE kind = 'Text')"))
def i12(spark, d):
    return ms.memories(spark, d).where("kind = 'Text'").select("id", extraction.hint(F.col("text")).alias("hint"))


#: Sentences of the relationship rows, as the given tables hold none that states a relation in words.
_NAMED = """n AS (SELECT m.id, a.display_name AS a, b.display_name AS b FROM m JOIN p a ON m.person_a = a.id JOIN p b ON m.person_b = b.id
 WHERE kind = 'Relationship' AND a.display_name IS NOT NULL AND b.display_name IS NOT NULL)"""
_SENTENCES = (
    "{a} works with {b}", "{a} and {b} are colleagues.", "{a} is {b}'s friend.", "{a} reports to {b}", "{a} is {b}'s sister, they say", "{a} is married to {b}", "{a}是{b}的同事", "{a}和{b}是朋友",
)
_RELATED = "r AS (SELECT id, CASE ascii(substr(id, 36, 1)) % 8 " + " ".join(
    f"WHEN {i} THEN {' || '.join(quoted(x) if x not in ('a', 'b') else x for x in parts if x)}" for i, parts in enumerate([x.replace("{", "|").replace("}", "|").split("|") for x in _SENTENCES])
) + " END AS text FROM n)"


def _related(spark, d):
    """Sentences that state the relationship rows, in one of eight ways by the last digit of their id."""
    p = ms.people(spark, d).select("id", "display_name").where("display_name is not null")
    r = ms.memories(spark, d).where("kind = 'Relationship'").select("id", "person_a", "person_b")
    named = r.join(p.toDF("person_a", "a"), "person_a").join(p.toDF("person_b", "b"), "person_b")
    ways = [F.concat(*[F.col(x) if x in ("a", "b") else F.lit(x) for x in s.replace("{", "|").replace("}", "|").split("|") if x]) for s in _SENTENCES]
    return named.select("id", F.element_at(F.array(*ways), F.ascii(F.substring("id", 36, 1)) % 8 + 1).alias("text"))


_EN = "([A-Z][\\w'-]*(?: [A-Z][\\w'-]*)*)"
_ZH_ONE = "([^\\s，。！？；：、,.!?;:的是和与跟]{1,8})"
_REL_SQL = " UNION ALL ".join(
    f"SELECT id, regexp_extract(hit, {quoted(p)}, {a}) AS person_a, '{rel}' AS relation, regexp_extract(hit, {quoted(p)}, {b}) AS person_b FROM (SELECT id, unnest(regexp_extract_all(text, {quoted(p)}, 0)) AS hit FROM r)"
    for p, a, b, rel in (
        (f"{_EN} works with {_EN}", 1, 2, "colleague_of"), (f"{_EN} and {_EN} are colleagues\\b", 1, 2, "colleague_of"), (f"{_EN} is {_EN}['’]s friend\\b", 1, 2, "friend_of"),
        (f"{_EN} reports to {_EN}", 1, 2, "reports_to"), (f"{_EN} is {_EN}['’]s sister\\b", 1, 2, "sibling_of"), (f"{_EN} (?:is )?married to {_EN}", 1, 2, "spouse_of"),
        (f"{_ZH_ONE}是{_ZH_ONE}的同事", 1, 2, "colleague_of"), (f"{_ZH_ONE}[和与跟]{_ZH_ONE}是朋友", 1, 2, "friend_of"),
    )
)


@query("i15_relations", sq.with_m(_REL_SQL, sq.PEOPLE, _NAMED, _RELATED))
def i15(spark, d):
    return extraction.relations(_related(spark, d)).select("id", "person_a", "relation", "person_b")


@query("i18_inverse", sq.with_m(f"SELECT id, person_a, relation, person_b FROM rel UNION ALL SELECT id, person_b, inv, person_a FROM rel JOIN (VALUES {', '.join(f'({quoted(a)}, {quoted(b)})' for a, b in extraction.INVERSES.items())}) i(relation, inv) USING (relation)", sq.PEOPLE, _NAMED, _RELATED, f"rel AS ({_REL_SQL})"))
def i18(spark, d):
    return extraction.with_inverses(extraction.relations(_related(spark, d))).select("id", "person_a", "relation", "person_b")


@query("i22_tags", sq.with_m("SELECT id, list_filter([" + ", ".join(f"CASE WHEN regexp_matches(lower(text), {quoted('|'.join(w))}) THEN '{t}' END" for t, w in extraction.TAXONOMY.items()) + "], lambda x: x IS NOT NULL) AS tags FROM m WHERE kind = 'Text'"))
def i22(spark, d):
    return ms.memories(spark, d).where("kind = 'Text'").select("id", extraction.tags(F.col("text")).alias("tags"))


@query("i3_exact_dedup", "SELECT doc_id AS seq, sha256(text) AS content_hash, doc_id = min(doc_id) OVER (PARTITION BY text) AS stored FROM documents WHERE text IS NOT NULL")
def i3(spark, d):
    batch = table(spark, d, "documents").select(F.col("doc_id").alias("seq"), "text")
    return ingest.first_copies(batch).where("content_hash is not null").select("seq", "content_hash", "stored")


@query("i2_batch_report", sq.with_m("SELECT count(*) AS submitted, count(*) FILTER (fresh) AS stored, count(*) FILTER (NOT fresh AND text IS NOT NULL) AS deduplicated, count(*) FILTER (text IS NULL) AS skipped FROM (SELECT text, doc_id = min(doc_id) OVER (PARTITION BY text) AND text IS NOT NULL AND sha256(text) NOT IN (SELECT content_hash FROM m WHERE content_hash IS NOT NULL) AS fresh FROM documents)"))
def i2(spark, d):
    batch = table(spark, d, "documents").select(F.col("doc_id").alias("seq"), "text")
    return ingest.batch_report(ingest.first_copies(batch, ms.memories(spark, d).where("content_hash is not null")))


_SESS = "x AS (SELECT channel || ' ' || strftime(ingestion_time AT TIME ZONE 'UTC', '%Y-%m') AS session, id, text FROM m WHERE tier = 'episodic' AND kind = 'Text')"
_TFIDF = """tw AS (SELECT session, id, word, count(*) AS tf FROM (SELECT session, id, unnest(list_filter(regexp_split_to_array(lower(trim(text, ' ' || chr(9) || chr(13) || chr(10))), '\\s+'), lambda w: w <> '')) AS word FROM x) GROUP BY 1, 2, 3),
 ti AS (SELECT session, id, sum(tf / total * ln(n / df)) AS score FROM tw JOIN (SELECT session, word, count(*) AS df FROM tw GROUP BY 1, 2) USING (session, word) JOIN (SELECT session, id, sum(tf) AS total FROM tw GROUP BY 1, 2) USING (session, id) JOIN (SELECT session, count(DISTINCT id) AS n FROM tw GROUP BY 1) USING (session) GROUP BY 1, 2)"""


def _sessions(spark, d):
    m = ms.memories(spark, d).where("tier = 'episodic' and kind = 'Text'")
    return m.select(F.concat_ws(" ", "channel", F.date_format("ingestion_time", "yyyy-MM")).alias("session"), "id", "text").where("session is not null and text is not null")


@query("l14_tfidf", sq.with_m("SELECT session, id, round(score, 6) AS score FROM ti", _SESS, _TFIDF))
def l14(spark, d):
    return ingest.tfidf(_sessions(spark, d)).select("session", "id", F.round("score", 6).alias("score"))


@query("l14_telling", sq.with_m("SELECT session, id, nth FROM (SELECT session, id, row_number() OVER (PARTITION BY session ORDER BY round(score, 9) DESC, id) AS nth FROM ti) WHERE nth <= 3", _SESS, _TFIDF))
def l14b(spark, d):
    return ingest.telling(ingest.tfidf(_sessions(spark, d)), 3).select("session", "id", "nth")


_PERSON = "(SELECT max(identity_id) FROM m WHERE identity_id IN (SELECT id FROM p))"
_CTX = f"""b AS (SELECT user_id::VARCHAR AS key, list_reduce(list_prepend(0.5::DOUBLE, list(CASE WHEN event_type <> 'error' THEN 0.5 + value / (value + 50) / 2 ELSE 0.5 - value / (value + 50) / 2 END ORDER BY ts, event_id)),
 lambda p, l: least(0.999, greatest(0.001, l * p / (l * p + (1 - l) * (1 - p))))) AS probability FROM events GROUP BY 1),
 vis AS (SELECT * FROM m WHERE tier <> 'archived' AND privacy <> 'private'),
 lines AS (SELECT 'profile' AS section, base_score AS rank_by, id, format('- {{}} = {{}} (confidence: {{:.0f}}%)', key, value, confidence * 100) AS line FROM vis WHERE kind = 'Preference' AND tier = 'semantic' AND confidence >= 0.3
 UNION ALL SELECT 'facts', base_score, id, format('- {{}} {{}} {{}} (confidence: {{:.0f}}%)', subject, predicate, object, base_score * 100) FROM vis WHERE kind = 'Fact' AND tier = 'semantic' AND base_score >= 0.3
 UNION ALL SELECT 'recent', epoch_us(ingestion_time) // 1000, id, '- [' || strftime(ingestion_time AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M') || '] ' || substr(text, 1, 300) FROM vis WHERE kind = 'Text' AND tier = 'episodic' AND text IS NOT NULL
 UNION ALL SELECT * FROM (SELECT 'patterns', frequency / 100.0, id, format('- When "{{}}": {{}} (seen {{}}x)', trigger, array_to_string(actions, ', '), frequency) FROM vis WHERE kind = 'Pattern' AND frequency >= 3 ORDER BY frequency DESC, id LIMIT 5)
 UNION ALL SELECT 'partner', 1.0, id, '- Name: ' || display_name FROM p WHERE id = {_PERSON}
 UNION ALL SELECT 'partner', 0.9, id, '- Relationship: ' || relationship FROM p WHERE id = {_PERSON} AND relationship <> ''
 UNION ALL SELECT 'partner', 0.5, id, '- Interactions: ' || interaction_count FROM p WHERE id = {_PERSON}
 UNION ALL SELECT 'partner', 0.4, id, '- Tags: ' || array_to_string(tags, ', ') FROM p WHERE id = {_PERSON} AND len(tags) > 0
 UNION ALL SELECT * FROM (SELECT 'partner', base_score, id, '  - ' || substr(text, 1, 300) FROM vis WHERE kind = 'Text' AND identity_id = {_PERSON} AND text IS NOT NULL ORDER BY created_at DESC NULLS LAST, id LIMIT 3)
 UNION ALL SELECT 'beliefs', abs(probability - 0.5) * 2, key, format('- {{}} ({{}}, {{:.0f}}%)', key, CASE WHEN probability > 0.5 THEN 'likely' ELSE 'unlikely' END, probability * 100) FROM b WHERE probability >= 0.8 OR probability <= 0.2),
 filled AS (SELECT *, sum(octet_length(encode(line))) OVER w AS sized, row_number() OVER w AS pos, list_distinct(string_split(trim(regexp_replace(lower(line), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' ')) AS words
  FROM lines WHERE line IS NOT NULL WINDOW w AS (PARTITION BY section ORDER BY rank_by DESC, id ROWS UNBOUNDED PRECEDING)),
 kept AS (SELECT section, pos, line, sum(octet_length(encode(line))) OVER (PARTITION BY section ORDER BY pos ROWS UNBOUNDED PRECEDING) AS used FROM filled x WHERE sized <= 16000 AND pos <= 1000 AND NOT EXISTS (SELECT 1 FROM filled y WHERE y.sized <= 16000 AND y.pos <= 1000 AND x.section = y.section AND x.pos > y.pos
  AND ((len(x.words) = len(y.words) AND len(list_intersect(x.words, y.words)) = len(x.words)) OR (len(x.words) >= 3 AND len(y.words) >= 3 AND len(list_intersect(x.words, y.words)) > 0.8 * least(len(x.words), len(y.words)))))),
 shares AS (SELECT section, floor(weight * 8000 / sum(weight) OVER ()) AS share FROM (SELECT DISTINCT section FROM kept) JOIN (VALUES ('profile', 25), ('facts', 25), ('partner', 10), ('recent', 20), ('patterns', 10), ('beliefs', 10)) v(section, weight) USING (section)),
 spare AS (SELECT sum(share - coalesce((SELECT max(used) FROM kept k WHERE k.section = s.section AND used <= share), 0)) AS spare, count(*) AS n FROM shares s),
 room AS (SELECT section, share + CASE WHEN spare > 100 THEN floor(spare / n) ELSE 0 END AS room FROM shares, spare)"""


@query("c2_context", sq.with_m("SELECT section, row_number() OVER (PARTITION BY section ORDER BY pos) AS line_no, line FROM kept JOIN room USING (section) WHERE used <= room", sq.PEOPLE, _CTX))
def c2(spark, d):
    from engramlake.operators import knowledge
    from engramlake.plans.knowledge_queries import _observations

    m, people = ms.memories(spark, d), ms.people(spark, d)
    person = m.select(F.col("identity_id").alias("id")).join(people, "id", "left_semi").agg(F.max("id")).first()[0]
    held = knowledge.beliefs(_observations(spark, d)).where("probability >= 0.8 or probability <= 0.2")
    return ingest.context(ingest.context_lines(m).union(ingest.partner_lines(people, m, person)).union(ingest.belief_lines(held)))
