"""Queries over facts, beliefs, people, replication and vectors, with the same question in SQL."""

from pyspark.sql import functions as F

from engramlake.operators import knowledge, replication, vectors
from engramlake.sources import memory_sql as sq
from engramlake.sources import memory_store as ms
from engramlake.sources import table
from engramlake.functions.id_sql import canon_sql

QUERIES, ORACLE = {}, {}


def query(name: str, sql: str | None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return register


_F = "f AS (SELECT id, lower(subject) AS s, lower(predicate) AS p, lower(object) AS o, base_score, effective, created_at FROM m WHERE kind = 'Fact' AND subject IS NOT NULL AND predicate IS NOT NULL AND object IS NOT NULL)"


@query("k2_facts", sq.with_m("SELECT id, s, p, o FROM f WHERE contains(s, 'user')", _F))
def k2(spark, d):
    return knowledge.facts(ms.memories(spark, d)).where(F.contains("s", F.lit("user"))).select("id", "s", "p", "o")


@query("k2_preferences", sq.with_m("SELECT id, key, value, confidence FROM m WHERE kind = 'Preference' AND contains(lower(key), 'plan')"))
def k2p(spark, d):
    return ms.memories(spark, d).where("kind = 'Preference'").where(F.lower("key").contains("plan")).select("id", "key", "value", "confidence")


@query("k3_contradictions", sq.with_m("""SELECT f.id, n - 1 AS n_rivals, (SELECT arg_max(g.id, (g.effective, g.id)) FROM f g WHERE g.s = f.s AND g.p = f.p AND g.o <> f.o) AS rival,
 (SELECT max(g.effective) FROM f g WHERE g.s = f.s AND g.p = f.p AND g.o <> f.o) AS rival_salience FROM f JOIN (SELECT s, p, count(DISTINCT o) AS n FROM f GROUP BY 1, 2) c USING (s, p) WHERE n > 1""", _F))
def k3(spark, d):
    return knowledge.contradictions(ms.memories(spark, d))


@query("i20_supersede", sq.with_m("""SELECT id, times::BIGINT AS times, base_score * pow(0.3, times) AS base_score FROM (
 SELECT *, coalesce(sum(step) OVER (PARTITION BY s, p ORDER BY created_at NULLS FIRST, id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS times
 FROM (SELECT *, (coalesce(lead(o) OVER (PARTITION BY s, p ORDER BY created_at NULLS FIRST, id) <> o, false))::INT AS step FROM f))""", _F))
def i20(spark, d):
    return knowledge.superseded(ms.memories(spark, d))


def _observations(spark, d):
    e = table(spark, d, "events")
    return e.select(F.col("user_id").cast("string").alias("key"), "ts", F.col("event_id").alias("seq"), (F.col("event_type") != "error").alias("supports"), (F.col("value") / (F.col("value") + 50)).alias("strength"))


_BELIEFS = """b AS (SELECT user_id::VARCHAR AS key, count(*) AS n, list_reduce(list_prepend(0.5::DOUBLE, list(CASE WHEN event_type <> 'error' THEN 0.5 + value / (value + 50) / 2 ELSE 0.5 - value / (value + 50) / 2 END ORDER BY ts, event_id)),
 lambda p, l: least(0.999, greatest(0.001, l * p / (l * p + (1 - l) * (1 - p))))) AS probability FROM events GROUP BY 1)"""


@query("k7_belief_fold", f"WITH {_BELIEFS} SELECT key, round(probability, 6) AS probability, n FROM b")
def k7(spark, d):
    return knowledge.beliefs(_observations(spark, d)).select("key", F.round("probability", 6).alias("probability"), "n")


@query("k8_confident", f"WITH {_BELIEFS} SELECT key, round(probability, 6) AS probability, CASE WHEN probability > 0.7 THEN 'confident' WHEN probability > 0.3 THEN 'uncertain' ELSE 'unlikely' END AS status FROM b WHERE probability >= 0.8 OR probability <= 0.2")
def k8(spark, d):
    return knowledge.confident(knowledge.beliefs(_observations(spark, d)), 0.8).select("key", F.round("probability", 6).alias("probability"), "status")


@query("k11_identities", "WITH " + sq.PEOPLE + """ SELECT channel, channel_user_id, coalesce(person_id, 'new-' || substr(sha256(concat_ws('|', channel, channel_user_id)), 1, 16)) AS person_id,
 coalesce(p.display_name, ci.display_name, ci.username, channel_user_id) AS name FROM ci LEFT JOIN p ON ci.person_id = p.id""")
def k11(spark, d):
    return knowledge.resolved_people(ms.identities(spark, d), ms.people(spark, d))


_SAME = "same AS (SELECT id AS source, min(id) OVER (PARTITION BY lower(trim(display_name))) AS target FROM p)"


@query("k13_merge_people", "WITH " + sq.PEOPLE + ", " + _SAME + """ SELECT target AS id, epoch_us(min(first_seen)) // 1000 AS first_ms, epoch_us(max(last_seen)) // 1000 AS last_ms, sum(interaction_count)::BIGINT AS interaction_count,
 list_sort(list_distinct(flatten(list(tags)))) AS tags, count(*) AS n_merged FROM p JOIN same ON p.id = same.source GROUP BY 1""")
def k13(spark, d):
    p = ms.people(spark, d)
    least = p.groupBy(F.lower(F.btrim("display_name")).alias("n")).agg(F.min("id").alias("target"))
    same = p.join(least, F.lower(F.btrim("display_name")).eqNullSafe(F.col("n"))).select(F.col("id").alias("source"), "target")
    return knowledge.merged_people(p, same).select("id", F.unix_millis("first_seen").alias("first_ms"), F.unix_millis("last_seen").alias("last_ms"), "interaction_count", "tags", "n_merged")


@query("k14_person_activity", sq.with_m("SELECT p.id, display_name, coalesce(n, 0) AS n_memories, last_ms FROM p LEFT JOIN (SELECT identity_id, count(*) AS n, max(epoch_us(ingestion_time) // 1000) AS last_ms FROM m GROUP BY 1) a ON a.identity_id = p.id", sq.PEOPLE))
def k14(spark, d):
    return knowledge.person_activity(ms.memories(spark, d), ms.people(spark, d))


@query("k15_graph", sq.with_m("SELECT a.display_name AS name_a, relation, b.display_name AS name_b, count(*) AS n FROM m JOIN p a ON m.person_a = a.id JOIN p b ON m.person_b = b.id WHERE kind = 'Relationship' GROUP BY 1, 2, 3", sq.PEOPLE))
def k15(spark, d):
    return knowledge.relationship_graph(ms.memories(spark, d), ms.people(spark, d))


@query("k17_patterns", "SELECT 'user-' || user_id AS trigger, count(*) AS frequency, list_sort(list(DISTINCT event_type)) AS actions, max(epoch_us(ts) // 1000) AS last_ms FROM events GROUP BY 1")
def k17(spark, d):
    return knowledge.patterns(table(spark, d, "events").select(F.concat(F.lit("user-"), "user_id").alias("trigger"), F.col("event_type").alias("action"), F.col("ts").cast("timestamp").alias("ts")))


@query("k18_frequent", sq.with_m("SELECT trigger, count(*) AS frequency FROM m WHERE kind = 'Pattern' GROUP BY 1 HAVING count(*) >= 2"))
def k18(spark, d):
    m = ms.memories(spark, d).where("kind = 'Pattern'").select("trigger", F.lit("").alias("action"), F.col("created_at").alias("ts"))
    return knowledge.patterns(m, 2).select("trigger", "frequency")


@query("k20_ring", "SELECT user_id AS session, event_id AS seq, nth FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS nth FROM events) WHERE nth <= 25")
def k20(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("session"), F.col("event_id").alias("seq"))
    return knowledge.working_ring(e, 25)


_OPS = f"""o AS (SELECT DISTINCT ON ({canon_sql("j->>'$.op_id'")}) {canon_sql("j->>'$.op_id'")} AS op_id, j->>'$.payload.type' AS type, (j->>'$.hlc.wall_ms')::BIGINT AS wall_ms, (j->>'$.hlc.counter')::BIGINT AS counter,
 j->>'$.hlc.device_id' AS hlc_device, j->'$.payload' AS payload, device_id AS dir_device
 FROM (SELECT CASE WHEN json_valid(line) THEN line::JSON END AS j, device_id FROM sync_oplog) WHERE (j->>'$.op_id') IS NOT NULL)"""


@query("y5_person_merge", f"""WITH {_OPS} SELECT {canon_sql("payload->>'$.person.id'")} AS id, arg_max(payload->>'$.person.display_name', (wall_ms, counter, hlc_device)) AS display_name,
 max((payload->>'$.person.interaction_count')::BIGINT) AS interaction_count, count(*) AS n_ops FROM o WHERE type = 'PersonUpsert' GROUP BY 1""")
def y5(spark, d):
    return replication.merged_people(replication.operations(table(spark, d, "sync_oplog")))


@query("y8_pattern_union", f"""WITH {_OPS} SELECT payload->>'$.pattern.trigger' AS trigger, max((payload->>'$.pattern.frequency')::BIGINT) AS frequency,
 list_sort(list_distinct(flatten(list(from_json(payload->'$.pattern.actions', '["VARCHAR"]'))))) AS actions FROM o WHERE type = 'PatternUpsert' GROUP BY 1""")
def y8(spark, d):
    return replication.merged_patterns(replication.operations(table(spark, d, "sync_oplog")))


@query("y9_link_upsert", f"""WITH {_OPS} SELECT {canon_sql("payload->>'$.source_id'")} AS source_id, {canon_sql("payload->>'$.target_id'")} AS target_id, payload->>'$.relation' AS relation,
 arg_max((payload->>'$.strength')::DOUBLE, (wall_ms, counter, hlc_device, op_id)) AS strength FROM o WHERE type = 'LinkUpsert' GROUP BY 1, 2, 3""")
def y9(spark, d):
    return replication.merged_links(replication.operations(table(spark, d, "sync_oplog")))


@query("y10_device_report", f"WITH {_OPS} SELECT type, count(*) AS n, count(*) FILTER (hlc_device <> dir_device) AS n_foreign FROM o GROUP BY 1")
def y10(spark, d):
    r = replication.device_report(replication.operations(table(spark, d, "sync_oplog")))
    return r.groupBy("type").agg(F.sum("n").alias("n"), F.sum("n_foreign").alias("n_foreign"))


@query("y11_gc", f"SELECT lower(trim(entity_type)) AS entity_type, {canon_sql('entity_id')} AS entity_id, max(epoch_us(created_at) // 1000) AS created_ms FROM sync_tombstones WHERE epoch_us(created_at) >= epoch_us(TIMESTAMPTZ '2026-04-01 00:00:00+00') - 90 * 86400000000 GROUP BY 1, 2")
def y11(spark, d):
    return replication.live_tombstones(table(spark, d, "sync_tombstones"), F.to_timestamp(F.lit("2026-04-01")), 90)


_COS = "list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"


@query("v1_cosine", f"SELECT b.vec_id, round({_COS}, 6) AS score FROM embeddings a, embeddings b WHERE a.vec_id = 0")
def v1(spark, d):
    e = table(spark, d, "embeddings")
    q = e.where("vec_id = 0").limit(1).select(F.col("embedding").alias("q"))
    return e.join(F.broadcast(q)).select("vec_id", F.round(vectors.cosine(F.col("embedding"), F.col("q")), 6).alias("score"))  # one row


@query("v2_topk", f"SELECT b.vec_id, round({_COS}, 6) AS score FROM embeddings a, embeddings b WHERE a.vec_id = 0 ORDER BY {_COS} DESC, b.vec_id LIMIT 20")
def v2(spark, d):
    e = table(spark, d, "embeddings")
    return vectors.top_k(e, e.where("vec_id = 0"), 20).select("vec_id", F.round("score", 6).alias("score"))


@query("v4_dim_guard", "SELECT vec_id, label FROM embeddings WHERE len(embedding) = 64")
def v4(spark, d):
    return vectors.of_dimension(table(spark, d, "embeddings"), 64).select("vec_id", "label")


@query("v6_batch_topk", f"SELECT a.vec_id AS query_id, b.vec_id, round({_COS}, 6) AS score FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY {_COS} DESC, b.vec_id) <= 10")
def v6(spark, d):
    e = table(spark, d, "embeddings")
    return vectors.nearest(e, e.where("vec_id % 50 = 0"), 10).select("query_id", "vec_id", F.round("score", 6).alias("score"))


_NEAR = "SELECT a.vec_id AS query_id, b.id AS vec_id, {0} AS score FROM embeddings a, v b WHERE a.vec_id % 50 = 0 AND {0} >= 0.95".format(_COS)


def _near_duplicates(spark, d, k):
    """Incoming vectors, one in fifty, against those of the stored memories."""
    from engramlake.plans.search_queries import _memory_vectors

    stored = _memory_vectors(spark, d).select(F.col("id").alias("vec_id"), "embedding")
    incoming = table(spark, d, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").cast("string").alias("vec_id"), "embedding")
    return vectors.nearest(stored, incoming, k, 0.95)


@query("v7_near_dup", sq.with_m(f"SELECT query_id, vec_id FROM ({_NEAR} QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY round({_COS}, 9) DESC, b.id) <= 8)", sq.VECTORS))
def v7(spark, d):
    return _near_duplicates(spark, d, 8).select(F.col("query_id").cast("bigint").alias("query_id"), "vec_id")


@query("i4_reinforce", sq.with_m(f"SELECT m.id, access_count + hits AS access_count, hits FROM m JOIN (SELECT vec_id, count(*) AS hits FROM (SELECT query_id, min(vec_id) AS vec_id FROM ({_NEAR}) GROUP BY 1) GROUP BY 1) h ON m.id = h.vec_id", sq.VECTORS))
def i4(spark, d):
    return vectors.reinforced(ms.memories(spark, d), _near_duplicates(spark, d, 8), F.to_timestamp(F.lit("2026-07-01"))).select("id", "access_count", "hits")


@query("v3_ann", None)
def v3(spark, d):
    e = table(spark, d, "embeddings")
    centres = vectors.centroids(e)
    return vectors.approximate(vectors.indexed(e, centres), e.where("vec_id % 50 = 0"), centres, 10)


@query("v3_recall", None)
def v3r(spark, d):
    e = table(spark, d, "embeddings")
    return vectors.recall(v3(spark, d), vectors.nearest(e, e.where("vec_id % 50 = 0"), 10))


@query("s27_quantise", """SELECT vec_id, round(list_aggregate(list_transform(generate_series(1, len(embedding)), lambda i: abs(embedding[i]::DOUBLE - (lo + CASE WHEN hi > lo THEN floor((embedding[i]::DOUBLE - lo) * 255 / (hi - lo) + 0.5) ELSE 128 END * (hi - lo) / 255))), 'max'), 6) AS worst
 FROM (SELECT *, list_min(embedding)::DOUBLE AS lo, list_max(embedding)::DOUBLE AS hi FROM embeddings)""")
def s27(spark, d):
    back = vectors.dequantised(vectors.quantised(F.col("embedding")))
    worst = F.array_max(F.zip_with("embedding", back, lambda a, b: F.abs(a.cast("double") - b)))
    return table(spark, d, "embeddings").select("vec_id", F.round(worst, 6).alias("worst"))


@query("k1_fact_rows", "SELECT substr(h, 1, 32) AS id, subject, predicate, object, h AS content_hash FROM (SELECT DISTINCT display_name AS subject, 'is_on' AS predicate, channel AS object, sha256(concat_ws(':', 'fact', display_name, 'is_on', channel)) AS h FROM channel_identities WHERE display_name IS NOT NULL AND channel IS NOT NULL)")
def k1(spark, d):
    found = table(spark, d, "channel_identities").select(F.col("display_name").alias("subject"), F.lit("is_on").alias("predicate"), F.col("channel").alias("object"))
    return knowledge.fact_rows(found).select("id", "subject", "predicate", "object", "content_hash")


@query("f8_all_facts", sq.with_m("SELECT id, kind FROM m WHERE kind IN ('Fact', 'Preference') AND tier = 'semantic' ORDER BY created_at DESC NULLS LAST, id LIMIT 300"))
def f8(spark, d):
    return knowledge.listed_facts(ms.memories(spark, d), most=300).select("id", "kind")


_MERGES = f"""{_F}, g AS (SELECT *, first_value(id) OVER (PARTITION BY s, p ORDER BY created_at DESC NULLS LAST, id DESC) AS keeper, first_value(o) OVER (PARTITION BY s, p ORDER BY created_at DESC NULLS LAST, id DESC) AS last_o FROM f)"""


@query("k4_merge_facts", sq.with_m("SELECT id, round(base_score * 0.3, 9) AS base_score, round(base_score * 0.3 * emotional * access_boost * decay_factor, 9) AS effective FROM m WHERE id IN (SELECT id FROM g WHERE o <> last_o)", _MERGES))
def k4(spark, d):
    m = ms.memories(spark, d)
    f = knowledge.facts(m)
    last = f.groupBy("s", "p").agg(F.max_by(F.struct("id", "o"), F.struct("created_at", "id")).alias("k"))
    merges = f.join(last, ["s", "p"]).where("o <> k.o").select(F.col("k.id").alias("keeper"), F.col("id").alias("merged"))
    rows, links = knowledge.merge_facts(m, merges)
    return rows.join(links.select(F.col("target_id").alias("id")), "id", "left_semi").select("id", F.round("base_score", 9).alias("base_score"), F.round("effective", 9).alias("effective"))


@query("k5_confidence", sq.with_m("SELECT id, round(confidence + 0.25, 9) AS confidence FROM m WHERE kind = 'Preference'"))
def k5(spark, d):
    m = ms.memories(spark, d)
    changes = m.where("kind = 'Preference'").select("id", (F.col("confidence") + 0.25).alias("confidence"))
    return knowledge.update_confidence(m, changes).where("kind = 'Preference'").select("id", F.round("confidence", 9).alias("confidence"))


@query("k9_strongest", f"WITH {_BELIEFS} SELECT key, round(probability, 6) AS probability FROM b WHERE probability >= 0.6 ORDER BY b.probability DESC, key LIMIT 40")
def k9(spark, d):
    return knowledge.strongest_beliefs(knowledge.beliefs(_observations(spark, d)), 0.6, 40).select("key", F.round("probability", 6).alias("probability"))


@query("k12_interactions", sq.with_m("SELECT p.id, coalesce(interaction_count, 0) + coalesce(n, 0) AS interaction_count, epoch_us(greatest(last_seen, ts)) // 1000 AS last_ms FROM p LEFT JOIN (SELECT identity_id, count(*) AS n, max(ingestion_time) AS ts FROM m WHERE identity_id IS NOT NULL GROUP BY 1) x ON p.id = identity_id", sq.PEOPLE))
def k12(spark, d):
    met = ms.memories(spark, d).where("identity_id is not null").select(F.col("identity_id").alias("id"), F.col("ingestion_time").alias("ts"))
    return knowledge.record_interactions(ms.people(spark, d), met).select("id", "interaction_count", F.unix_millis("last_seen").alias("last_ms"))


@query("a7_disclosures", "SELECT strftime(ts, '%Y-%m-%d') AS day, user_id AS client, count(*) AS n_reads, count(DISTINCT props) AS n_items, count(DISTINCT props) > 3 AS over FROM events GROUP BY 1, 2")
def a7(spark, d):
    reads = table(spark, d, "events").select("ts", F.col("user_id").alias("client"), F.col("props").alias("item"))
    return knowledge.disclosure_budget(reads, 3).select(F.date_format("day", "yyyy-MM-dd").alias("day"), "client", "n_reads", "n_items", "over")


@query("y7_beliefs", f"""WITH {_OPS} SELECT payload->>'$.belief.key' AS key, arg_min((payload->>'$.belief.probability')::DOUBLE, (wall_ms, counter, hlc_device, op_id)) AS probability, 0::BIGINT AS n
 FROM o WHERE type = 'BeliefUpsert' GROUP BY 1 HAVING sum(json_array_length(payload->'$.belief.observations')) = 0""")
def y7(spark, d):
    return replication.merged_beliefs(replication.operations(table(spark, d, "sync_oplog"))).select("key", "probability", "n")
