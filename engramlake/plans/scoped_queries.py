"""Further queries over scopes, fences, sessions, privacy and capture, with the same question in SQL."""

from pyspark.sql import functions as F

from engramlake.functions.id_sql import canon_sql
from engramlake.operators import extraction, knowledge, lifecycle, replication, scoped
from engramlake.plans.search_queries import quoted
from engramlake.sources import memory_sql as sq
from engramlake.sources import memory_store as ms
from engramlake.sources import table

QUERIES, ORACLE = {}, {}
_NOW = "TIMESTAMPTZ '2026-03-01 00:00:00+00'"


def now():
    return F.to_timestamp(F.lit("2026-03-01 00:00:00"))


def query(name: str, sql: str):
    def register(f):
        QUERIES[name], ORACLE[name] = f, sql
        return f

    return register


@query("f9_validity", sq.with_m("""SELECT id FROM m WHERE kind = 'Event' AND (start IS NULL OR start::TIMESTAMPTZ <= TIMESTAMPTZ '2025-09-01 00:00:00+00') AND ("end" IS NULL OR TIMESTAMPTZ '2025-09-01 00:00:00+00' < "end"::TIMESTAMPTZ)"""))
def f9(spark, d):
    at = F.to_timestamp(F.lit("2025-09-01"))
    return ms.memories(spark, d).where("kind = 'Event'").where(scoped.valid_at(at, F.to_timestamp("start"), F.to_timestamp("end"))).select("id")


@query("f10_validate", "SELECT doc_id, CASE WHEN text IS NULL OR trim(text, ' ') = '' THEN 'no text' WHEN length(text) > 2000 OR octet_length(encode(text)) > 4000 THEN 'text too long' END AS problem FROM documents")
def f10(spark, d):
    return table(spark, d, "documents").select("doc_id", scoped.problems(F.col("doc_id").cast("string"), F.col("text"), 2000, 4000).alias("problem"))


@query("f13_clamps", sq.with_m("SELECT id, least(greatest(coalesce(access_count, 10), 1), 20) AS n FROM m"))
def f13(spark, d):
    return ms.memories(spark, d).select("id", scoped.clamped(F.col("access_count"), 10, 1, 20).alias("n"))


@query("r16_scoped", sq.with_m("SELECT id, list_has_all(regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+'), ['the', 'garden']) AS matched, (SELECT count(*) > 500 FROM m WHERE privacy_scope IN ('family', 'team') AND tier <> 'archived') AS truncated FROM m WHERE privacy_scope IN ('family', 'team') AND tier <> 'archived' ORDER BY created_at DESC NULLS LAST, id LIMIT 500"))
def r16(spark, d):
    return scoped.scoped_search(ms.memories(spark, d), ["family", "team"], ["the", "garden"], 500)


_MUT = f"""mut AS (SELECT {canon_sql("j->>'$.payload.memory.id'")} AS key, (j->>'$.hlc.wall_ms')::BIGINT AS revision, received_at, concat_ws('/', epoch_us(received_at), device_id, file_name, lpad(line_no::VARCHAR, 8, '0')) AS seq
 FROM (SELECT CASE WHEN json_valid(line) THEN line::JSON END AS j, * EXCLUDE (line) FROM sync_oplog) WHERE (j->>'$.payload.type') = 'MemoryUpsert')"""


@query("y14_fences", f"WITH {_MUT} SELECT key, revision, seq, CASE WHEN high IS NULL OR revision > high THEN 'applied' WHEN revision = high THEN 'replayed' ELSE 'stale' END AS outcome FROM (SELECT *, max(revision) OVER (PARTITION BY key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS high FROM mut)")
def y14(spark, d):
    o = F.from_json("line", "hlc struct<wall_ms string>, payload struct<type string, memory struct<id string>>, broken string", {"columnNameOfCorruptRecord": "broken"})
    log = table(spark, d, "sync_oplog").select(o.alias("o"), "received_at", F.concat_ws("/", F.unix_micros("received_at").cast("string"), "device_id", "file_name", F.lpad(F.col("line_no").cast("string"), 8, "0")).alias("seq"))
    rows = log.where("o.broken is null and o.payload.type = 'MemoryUpsert'")
    return scoped.fenced(rows.select(scoped_id(), F.col("o.hlc.wall_ms").cast("bigint").alias("revision"), "seq", F.col("received_at").alias("at")))


def scoped_id():
    from engramlake.functions.ids import canonical_id

    return canonical_id(F.col("o.payload.memory.id")).alias("key")


@query("i5_durability", sq.with_m("SELECT durability, count(*) AS n FROM (SELECT CASE WHEN a > b THEN 'temporary' WHEN b > a THEN 'permanent' ELSE 'normal' END AS durability FROM (SELECT "
       + " + ".join(f"contains(lower(text), {quoted(w)})::INT" for w in extraction.TEMPORARY) + " AS a, " + " + ".join(f"contains(lower(text), {quoted(w)})::INT" for w in extraction.PERMANENT) + " AS b FROM m WHERE kind = 'Text')) GROUP BY 1"))
def i5(spark, d):
    return ms.memories(spark, d).where("kind = 'Text'").groupBy(extraction.durability(F.col("text")).alias("durability")).agg(F.count("*").alias("n"))


@query("i11_employment", sq.with_m(f"SELECT id, regexp_extract(hit, {quoted(extraction.EMPLOYMENT)}, 1) AS person, regexp_extract(hit, {quoted(extraction.EMPLOYMENT)}, 2) AS company FROM (SELECT id, unnest(regexp_extract_all(display_name || ' now works at Acme Works.', {quoted(extraction.EMPLOYMENT)})[1:2]) AS hit FROM p)", sq.PEOPLE))
def i11(spark, d):
    return extraction.employment(ms.people(spark, d).select("id", F.concat("display_name", F.lit(" now works at Acme Works.")).alias("text")))


@query("i19_speculative", sq.with_m("SELECT id, round(least(confidence * 0.3, 0.29), 6) AS confidence FROM m WHERE kind = 'Preference'"))
def i19(spark, d):
    return ms.memories(spark, d).where("kind = 'Preference'").select("id", F.round(knowledge.speculative(F.col("confidence")), 6).alias("confidence"))


@query("k16_list_people", "WITH " + sq.PEOPLE + " SELECT p.id, p.display_name, count(ci.channel_user_id) AS n_identities, list_sort(list(DISTINCT ci.channel) FILTER (ci.channel IS NOT NULL)) AS channels FROM p LEFT JOIN ci ON ci.person_id = p.id GROUP BY 1, 2")
def k16(spark, d):
    return knowledge.listed_people(ms.people(spark, d), ms.identities(spark, d)).withColumn("channels", F.when(F.size("channels") > 0, F.col("channels")))


@query("k19_promote_pattern", "SELECT 'user-' || user_id AS trigger, 'procedural' AS tier, 0.7::DOUBLE AS base_score, 'When user-' || user_id || ': ' || array_to_string(list_sort(list(DISTINCT event_type)), ', ') AS line FROM events GROUP BY user_id HAVING count(*) >= 3")
def k19(spark, d):
    e = table(spark, d, "events").select(F.concat(F.lit("user-"), "user_id").alias("trigger"), F.col("event_type").alias("action"), F.col("ts").cast("timestamp").alias("ts"))
    return knowledge.promoted_pattern(knowledge.patterns(e, 3))


@query("l3_window", sq.with_m(f"SELECT id, access_count FROM m WHERE tier = 'episodic' AND epoch_us(ingestion_time) >= epoch_us({_NOW}) - 45 * 86400000000"))
def l3(spark, d):
    return lifecycle.in_window(ms.memories(spark, d), now(), 45).select("id", "access_count")


@query("l8_cycle", sq.with_m(f"""SELECT (SELECT count(*) FROM (SELECT CASE WHEN durability = 'permanent' THEN greatest(decay_factor, 0.8) ELSE greatest(0.01, least(1.0, exp(-greatest(0, floor((epoch_us({_NOW}) - epoch_us(last_accessed)) / 3600000000)) * 0.693 /
 CASE WHEN durability = 'temporary' THEN 12 + 24 * base_score ELSE 72 + 144 * base_score END))) END AS f, decay_factor FROM m WHERE tier = 'episodic') WHERE abs(f - decay_factor) > 0.001) AS decayed,
 (SELECT count(*) FROM (SELECT 1 FROM m WHERE tier = 'episodic' GROUP BY lower(CASE kind WHEN 'Text' THEN text WHEN 'Fact' THEN concat_ws(':', 'fact', subject, predicate, object) WHEN 'Preference' THEN concat_ws(':', 'pref', key, value)
 WHEN 'Relationship' THEN concat_ws(':', 'rel', person_a, person_b, relation) WHEN 'Pattern' THEN concat_ws(':', 'pattern', trigger, array_to_string(actions, ',')) WHEN 'Event' THEN concat_ws(':', 'event', title, start) END) HAVING count(*) >= 3)) AS promoted,
 (SELECT count(*) FROM m WHERE tier = 'episodic' AND effective < 0.05) AS archived"""))
def l8(spark, d):
    return lifecycle.cycle_report(ms.memories(spark, d), now())


@query("l10_archive", sq.with_m("SELECT id, CASE WHEN id IN (SELECT target_id FROM links) THEN 'archived' ELSE tier END AS tier FROM m", sq.LINKS))
def l10(spark, d):
    return lifecycle.moved(ms.memories(spark, d), ms.links(spark, d).select(F.col("target_id").alias("id")), "archived").select("id", "tier")


@query("l13_compress", sq.with_m("""SELECT s.*, coalesce(t.tags, []) AS tags FROM (SELECT channel, strftime(ingestion_time AT TIME ZONE 'UTC', '%Y-%m-%d') AS day, count(*) AS n, greatest(max(effective), 0.3) AS base_score, min(epoch_us(ingestion_time) // 1000) AS event_ms
 FROM m WHERE tier = 'episodic' AND kind = 'Text' AND ingestion_time <= TIMESTAMPTZ '2026-03-01 00:00:00+00' GROUP BY 1, 2 HAVING count(*) >= 2) s
 LEFT JOIN (SELECT channel, day, list_sort(list(DISTINCT tag)) AS tags FROM (SELECT channel, strftime(ingestion_time AT TIME ZONE 'UTC', '%Y-%m-%d') AS day, unnest(tags) AS tag FROM m WHERE tier = 'episodic' AND kind = 'Text' AND ingestion_time <= TIMESTAMPTZ '2026-03-01 00:00:00+00') GROUP BY 1, 2) t ON s.channel = t.channel AND s.day = t.day"""))
def l13(spark, d):
    return lifecycle.compressed(ms.memories(spark, d), now(), 2)


@query("l16_privacy", sq.with_m("SELECT id, 'MemoryUpsert' AS operation FROM m WHERE privacy = 'private' AND id IN (SELECT target_id FROM links) UNION ALL SELECT id, 'MemoryDelete' FROM m WHERE privacy <> 'private' AND id IN (SELECT source_id FROM links)", sq.LINKS))
def l16(spark, d):
    m, links = ms.memories(spark, d), ms.links(spark, d)
    up = lifecycle.privacy_operations(m, links.select(F.col("target_id").alias("id")), "public")
    return up.union(lifecycle.privacy_operations(m, links.select(F.col("source_id").alias("id")), "private"))


@query("y12_capture", sq.with_m("SELECT id, CASE WHEN tier = 'archived' THEN 'MemoryUpsert' WHEN effective < 0.01 THEN 'MemoryDelete' ELSE 'MemoryUpsert' END AS operation FROM m WHERE privacy <> 'private'"))
def y12(spark, d):
    change = F.when(F.col("tier") == "archived", "archived").when(F.col("effective") < 0.01, "deleted").otherwise("stored")
    return replication.captured(ms.memories(spark, d).select("id", change.alias("change"), "privacy"))
