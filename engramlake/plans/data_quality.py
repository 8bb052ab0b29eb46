"""Queries of the general training-data problems, with the same question in SQL."""

from pyspark.sql import DataFrame, SparkSession

from engramlake.functions.id_sql import canon_sql
from engramlake.operators import changefeed, orphans
from engramlake.sources import table

def _references(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    memories = table(spark, d, "memories")
    refs = orphans.memory_links(memories).union(orphans.context_references(table(spark, d, "person_context")))
    return refs, memories.select(orphans.canonical_id(memories.id).alias("key"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_references(*_references(spark, d)).select("ref_table", "ref_id", "target_id").distinct()


def p1_counts(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_counts(*_references(spark, d))


def _state(spark: SparkSession, d: str) -> DataFrame:
    return changefeed.apply_feed(table(spark, d, "sync_oplog"), table(spark, d, "sync_hlc"), table(spark, d, "sync_tombstones"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return changefeed.set_by_feed(_state(spark, d))


def p2_state(spark: SparkSession, d: str) -> DataFrame:
    return _state(spark, d).select("entity_type", "entity_id", "alive", "clock.wall_ms", "clock.counter", "clock.device_id", "op_id")


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    return changefeed.feed_report(_state(spark, d))


_REFS = f"""WITH refs AS (
 SELECT 'memories' AS ref_table, {canon_sql('id')} AS ref_id, strftime(created_at AT TIME ZONE 'UTC', '%Y-%m') AS period,
  {canon_sql("t.target")} AS target_id
 FROM (SELECT id, created_at, unnest(json_extract_string(links_json, '$[*].target_id')) AS target FROM memories WHERE json_valid(links_json)) t WHERE t.target IS NOT NULL
 UNION ALL
 SELECT 'person_context', {canon_sql('context_id')}, strftime(captured_at AT TIME ZONE 'UTC', '%Y-%m'), {canon_sql("t.target")}
 FROM (SELECT context_id, captured_at, unnest(related_memories) AS target FROM person_context) t WHERE t.target IS NOT NULL),
lost AS (SELECT DISTINCT * FROM refs WHERE target_id NOT IN (SELECT {canon_sql('id')} FROM memories WHERE id IS NOT NULL))"""

_STATE = f"""WITH raw AS (
 SELECT line::JSON AS j FROM (SELECT CASE WHEN json_valid(line) THEN line END AS line FROM sync_oplog) WHERE line IS NOT NULL),
feed AS (
 SELECT CASE WHEN j->>'$.payload.type' LIKE 'Memory%' THEN 'memory' ELSE 'person' END AS entity_type,
  {canon_sql("coalesce(j->>'$.payload.memory.id', j->>'$.payload.person.id', j->>'$.payload.id')")} AS entity_id,
  (j->>'$.hlc.wall_ms')::BIGINT AS wall_ms, (j->>'$.hlc.counter')::BIGINT AS counter, coalesce(j->>'$.hlc.device_id', '') AS device_id,
  false AS applied, j->>'$.payload.type' LIKE '%Upsert' AS alive, {canon_sql("j->>'$.op_id'")} AS op_id
 FROM raw WHERE j->>'$.payload.type' IN ('MemoryUpsert', 'PersonUpsert', 'MemoryDelete', 'PersonDelete')),
base AS (
 SELECT lower(trim(entity_type)) AS entity_type, {canon_sql('entity_id')} AS entity_id, (c->>'$.wall_ms')::BIGINT AS wall_ms,
  (c->>'$.counter')::BIGINT AS counter, coalesce(c->>'$.device_id', '') AS device_id, true AS applied, alive, NULL::VARCHAR AS op_id
 FROM (SELECT entity_type, entity_id, last_hlc::JSON AS c, true AS alive FROM sync_hlc WHERE json_valid(last_hlc)
  UNION ALL SELECT entity_type, entity_id, deleted_hlc::JSON, false FROM sync_tombstones WHERE json_valid(deleted_hlc))),
ranked AS (
 SELECT *, row_number() OVER (PARTITION BY entity_type, entity_id
  ORDER BY wall_ms DESC, counter DESC, device_id DESC, applied DESC, alive ASC, op_id DESC) AS rn
 FROM (SELECT * FROM feed UNION ALL SELECT * FROM base)
 WHERE entity_id IS NOT NULL AND wall_ms IS NOT NULL AND counter IS NOT NULL AND (applied OR op_id IS NOT NULL)),
state AS (SELECT * FROM ranked WHERE rn = 1)"""

QUERIES = {
    "p1_found": p1_found,
    "p1_counts": p1_counts,
    "p2_found": p2_found,
    "p2_state": p2_state,
    "p2_report": p2_report,
}

ORACLE = {
    "p1_found": _REFS + " SELECT DISTINCT ref_table, ref_id, target_id FROM lost",
    "p1_counts": _REFS + " SELECT ref_table, period, count(*) AS n_refs, count(DISTINCT ref_id) AS n_records, count(DISTINCT target_id) AS n_targets FROM lost GROUP BY 1, 2",
    "p2_found": _STATE + " SELECT entity_type, entity_id, op_id FROM state WHERE alive AND NOT applied",
    "p2_state": _STATE + " SELECT entity_type, entity_id, alive, wall_ms, counter, device_id, op_id FROM state",
    "p2_report": _STATE + " SELECT entity_type, CASE WHEN applied THEN 'state' ELSE 'feed' END AS set_by, alive, count(*) AS n FROM state GROUP BY 1, 2, 3",
}
