"""The flat memory store as SQL, for the side-by-side comparison of results."""

from engramlake.functions.id_sql import canon_sql

M = f"""m0 AS (SELECT *, row_number() OVER (PARTITION BY {canon_sql('id')} ORDER BY updated_at DESC NULLS LAST, temporal_json DESC NULLS LAST, salience_json DESC NULLS LAST) AS rn_ FROM memories WHERE id IS NOT NULL),
m1 AS (SELECT * REPLACE ({canon_sql('id')} AS id), content_json::JSON AS c, temporal_json::JSON AS t, source_json::JSON AS s, salience_json::JSON AS b FROM m0 WHERE rn_ = 1),
m AS (SELECT id, tier,
 CASE WHEN (c->'$.Text') IS NOT NULL THEN 'Text' WHEN (c->'$.Fact') IS NOT NULL THEN 'Fact' WHEN (c->'$.Preference') IS NOT NULL THEN 'Preference'
  WHEN (c->'$.Relationship') IS NOT NULL THEN 'Relationship' WHEN (c->'$.Pattern') IS NOT NULL THEN 'Pattern' WHEN (c->'$.Event') IS NOT NULL THEN 'Event' END AS kind,
 c->>'$.Text' AS text, c->>'$.Fact.subject' AS subject, c->>'$.Fact.predicate' AS predicate, c->>'$.Fact.object' AS object,
 c->>'$.Preference.key' AS key, c->>'$.Preference.value' AS value, (c->>'$.Preference.confidence')::DOUBLE AS confidence,
 {canon_sql("c->>'$.Relationship.person_a'")} AS person_a, {canon_sql("c->>'$.Relationship.person_b'")} AS person_b, c->>'$.Relationship.relation' AS relation,
 c->>'$.Pattern.trigger' AS trigger, from_json(c->'$.Pattern.actions', '["VARCHAR"]') AS actions, (c->>'$.Pattern.frequency')::INT AS frequency,
 c->>'$.Event.title' AS title, c->>'$.Event.start' AS start, c->>'$.Event.end' AS "end",
 (t->>'$.event_time')::TIMESTAMPTZ AS event_time, (t->>'$.ingestion_time')::TIMESTAMPTZ AS ingestion_time, (t->>'$.last_accessed')::TIMESTAMPTZ AS last_accessed,
 (t->>'$.access_count')::BIGINT AS access_count, coalesce(t->>'$.durability', 'normal') AS durability,
 s->>'$.channel' AS channel, {canon_sql("s->>'$.identity_id'")} AS identity_id, s->>'$.chat_id' AS chat_id,
 (b->>'$.base')::DOUBLE AS base_score, (b->>'$.emotional')::DOUBLE AS emotional, (b->>'$.access_boost')::DOUBLE AS access_boost, (b->>'$.decay_factor')::DOUBLE AS decay_factor,
 (b->>'$.effective')::DOUBLE AS effective, salience_score,
 CASE WHEN contains(privacy_json, 'Shared') THEN 'shared' WHEN contains(privacy_json, 'Public') THEN 'public' ELSE 'private' END AS privacy,
 CASE WHEN json_valid(privacy_json) THEN privacy_json::JSON->>'$.Shared.scope' END AS privacy_scope,
 from_json(tags_json, '["VARCHAR"]') AS tags, lower(trim(content_hash)) AS content_hash, namespace, created_at, updated_at FROM m1)"""

LINKS = f"""links AS (SELECT source_id, {canon_sql("l->>'$.target_id'")} AS target_id, l->>'$.relation' AS relation, max((l->>'$.strength')::DOUBLE) AS strength
 FROM (SELECT {canon_sql('id')} AS source_id, unnest(from_json(links_json, '["JSON"]')) AS l FROM memories WHERE json_valid(links_json))
 WHERE (l->>'$.target_id') IS NOT NULL GROUP BY 1, 2, 3)"""

PEOPLE = f"""p0 AS (SELECT * REPLACE ({canon_sql('id')} AS id, lower(trim(relationship)) AS relationship, interaction_count::BIGINT AS interaction_count),
  row_number() OVER (PARTITION BY {canon_sql('id')} ORDER BY last_seen DESC NULLS LAST, interaction_count DESC NULLS LAST, display_name DESC NULLS LAST) AS rn_ FROM people WHERE id IS NOT NULL),
p AS (SELECT id, display_name, relationship, first_seen, last_seen, interaction_count, from_json(tags_json, '["VARCHAR"]') AS tags, from_json(notes_json, '["VARCHAR"]') AS notes FROM p0 WHERE rn_ = 1),
ci AS (SELECT channel, channel_user_id, min({canon_sql('person_id')}) AS person_id, max(username) AS username, max(display_name) AS display_name FROM channel_identities GROUP BY 1, 2)"""


def with_m(sql: str, *more: str) -> str:
    return "WITH " + ", ".join((M, *more)) + " " + sql


#: Memories with the test vector that the first digits of their id point to.
VECTORS = "v AS (SELECT m.id, embedding FROM m JOIN embeddings ON ('0x' || substr(id, 1, 8))::BIGINT % 500 = vec_id WHERE regexp_matches(id, '^[0-9a-f]{8}'))"
