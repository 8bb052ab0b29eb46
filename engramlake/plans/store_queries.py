"""Queries over scans, renderings, lifecycle and reports, with the same question in SQL."""

from pyspark.sql import functions as F

from engramlake.operators import lifecycle, rendering, reports, scans
from engramlake.sources import memory_store as ms
from engramlake.sources import memory_sql as sq
from engramlake.sources import table


def now():
    return F.to_timestamp(F.lit("2026-07-01 00:00:00"))


_NOW = "TIMESTAMPTZ '2026-07-01 00:00:00+00'"
_PERSON = "(SELECT max(identity_id) FROM m)"
_HOURS = "greatest(0, floor((epoch_us({0}) - epoch_us({1})) / 3600000000))"
_CANONICAL = """CASE kind WHEN 'Text' THEN text WHEN 'Fact' THEN concat_ws(':', 'fact', subject, predicate, object) WHEN 'Preference' THEN concat_ws(':', 'pref', key, value)
 WHEN 'Relationship' THEN concat_ws(':', 'rel', person_a, person_b, relation) WHEN 'Pattern' THEN concat_ws(':', 'pattern', trigger, array_to_string(actions, ','))
 WHEN 'Event' THEN concat_ws(':', 'event', title, start) END"""
_LIVE = ("episodic", "semantic", "procedural")

QUERIES, ORACLE = {}, {}


def query(name: str, sql: str):
    def register(f):
        QUERIES[name], ORACLE[name] = f, sql
        return f

    return register


_TOP = "SELECT id, tier, kind, epoch_us({0}) // 1000 AS at_ms FROM m WHERE {1} ORDER BY {0} DESC NULLS LAST, id LIMIT {2}"


def _shown(df, by="created_at"):
    return df.select("id", "tier", "kind", F.unix_millis(by).alias("at_ms"))


@query("s2_tier_newest", sq.with_m(_TOP.format("created_at", "tier = 'episodic'", 50)))
def s2(spark, d):
    return _shown(scans.by_tier(ms.memories(spark, d), "episodic", 50))


@query("s3_tier_by_ingestion", sq.with_m(_TOP.format("ingestion_time", "tier = 'semantic'", 50)))
def s3(spark, d):
    return _shown(scans.by_tier(ms.memories(spark, d), "semantic", 50, "ingestion_time"), "ingestion_time")


@query("s4_tier_page", sq.with_m(_TOP.format("created_at", "tier = 'semantic'", "30 OFFSET 60")))
def s4(spark, d):
    return _shown(scans.by_tier(ms.memories(spark, d), "semantic", 30, offset=60))


@query("s5_channel_newest", sq.with_m(_TOP.format("created_at", "channel = 'telegram'", 40)))
def s5(spark, d):
    return _shown(scans.by_channel(ms.memories(spark, d), "telegram", 40))


@query("s6_tier_namespace", sq.with_m(_TOP.format("created_at", "tier = 'episodic' AND namespace = 'work'", 40)))
def s6(spark, d):
    return _shown(scans.by_tier_and_namespace(ms.memories(spark, d), "episodic", "work", 40))


@query("s7_time_range", sq.with_m("SELECT id, tier FROM m WHERE created_at BETWEEN TIMESTAMPTZ '2025-06-01 00:00:00+00' AND TIMESTAMPTZ '2025-09-01 00:00:00+00'"))
def s7(spark, d):
    return scans.in_time_range(ms.memories(spark, d), F.to_timestamp(F.lit("2025-06-01")), F.to_timestamp(F.lit("2025-09-01"))).select("id", "tier")


@query("s8_low_salience", sq.with_m("SELECT id, salience_score FROM m WHERE salience_score < 0.1"))
def s8(spark, d):
    return scans.salience_below(ms.memories(spark, d), 0.1).select("id", "salience_score")


@query("s9_batch_lookup", sq.with_m("SELECT id, kind FROM m WHERE id IN (SELECT target_id FROM links)", sq.LINKS))
def s9(spark, d):
    return scans.lookup(ms.memories(spark, d), ms.links(spark, d).select(F.col("target_id").alias("id"))).select("id", "kind")


@query("s10_hash_lookup", sq.with_m("SELECT content_hash, min(id) AS id FROM m WHERE content_hash IN (SELECT content_hash FROM m WHERE tier = 'semantic') GROUP BY 1"))
def s10(spark, d):
    m = ms.memories(spark, d)
    return scans.by_content_hash(m, m.where("tier = 'semantic'")).select("content_hash", "id")


@query("s11_by_identity", sq.with_m("SELECT identity_id, id, row_number() OVER (PARTITION BY identity_id ORDER BY created_at DESC NULLS LAST, id) AS nth FROM m WHERE identity_id IS NOT NULL QUALIFY nth <= 5"))
def s11(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("identity_id").orderBy(F.desc_nulls_last("created_at"), "id")
    rows = ms.memories(spark, d).where("identity_id is not null").select("identity_id", "id", F.row_number().over(w).cast("bigint").alias("nth"))
    return rows.where("nth <= 5")


@query("s13_upsert", sq.with_m("SELECT id, CASE WHEN tier = 'working' THEN 'episodic' ELSE tier END AS tier, salience_score FROM m"))
def s13(spark, d):
    m = ms.memories(spark, d).select("id", "tier", "salience_score")
    return scans.upsert(m, m.where("tier = 'working'").withColumn("tier", F.lit("episodic")))


@query("s14_set_salience", sq.with_m("SELECT m.id, coalesce(CASE WHEN l.n IS NOT NULL THEN 1.0 END, salience_score) AS salience_score FROM m LEFT JOIN (SELECT target_id, count(*) AS n FROM links GROUP BY 1) l ON m.id = l.target_id", sq.LINKS))
def s14(spark, d):
    return scans.set_salience(ms.memories(spark, d), ms.links(spark, d).select(F.col("target_id").alias("id"), F.lit(1.0).alias("score"))).select("id", "salience_score")


@query("s15_delete_anti", sq.with_m("SELECT id FROM m WHERE id NOT IN (SELECT source_id FROM links)", sq.LINKS))
def s15(spark, d):
    return scans.delete(ms.memories(spark, d), ms.links(spark, d).select(F.col("source_id").alias("id"))).select("id")


@query("s16_link_upsert", "WITH " + sq.LINKS + " SELECT source_id, target_id, relation, CASE WHEN relation = 'RelatedTo' THEN 1.0 ELSE strength END AS strength FROM links")
def s16(spark, d):
    links = ms.links(spark, d)
    return scans.upsert_links(links, links.where("relation = 'RelatedTo'").withColumn("strength", F.lit(1.0)))


@query("s17_export", sq.with_m("SELECT id, tier, kind, privacy FROM m WHERE tier <> 'archived'"))
def s17(spark, d):
    return scans.export_rows(ms.memories(spark, d), include_archived=False).select("id", "tier", "kind", "privacy")


@query("s18_sync_safe", sq.with_m("SELECT id, tier, privacy, privacy_scope FROM m WHERE privacy <> 'private'"))
def s18(spark, d):
    return scans.export_rows(ms.memories(spark, d), only_syncable=True).select("id", "tier", "privacy", "privacy_scope")


@query("s19_import", sq.with_m("SELECT id, namespace FROM m WHERE namespace IS NULL OR namespace <> 'travel'"))
def s19(spark, d):
    return scans.importable(ms.memories(spark, d), "travel").select("id", "namespace")


@query("r17_recent_feed", sq.with_m("SELECT id, tier, epoch_us(created_at) // 1000 AS at_ms FROM (SELECT *, row_number() OVER (PARTITION BY tier ORDER BY created_at DESC NULLS LAST, id) AS r FROM m WHERE tier IN ('episodic', 'semantic', 'procedural')) WHERE r <= 20 ORDER BY created_at DESC NULLS LAST, id LIMIT 20"))
def r17(spark, d):
    return scans.recent_feed(ms.memories(spark, d), _LIVE).select("id", "tier", F.unix_millis("created_at").alias("at_ms"))


@query("f1_content_hash", sq.with_m(f"SELECT id, sha256({_CANONICAL}) AS computed, content_hash IS NOT DISTINCT FROM sha256({_CANONICAL}) AS up_to_date FROM m"))
def f1(spark, d):
    return ms.memories(spark, d).select("id", rendering.content_hash().alias("computed"), F.col("content_hash").eqNullSafe(rendering.content_hash()).alias("up_to_date"))


@query("f2_render", sq.with_m("""SELECT id, CASE kind WHEN 'Text' THEN text WHEN 'Fact' THEN concat_ws(' ', subject, predicate, object) WHEN 'Preference' THEN key || ' = ' || value
 WHEN 'Relationship' THEN concat_ws(' ', person_a, relation, person_b) WHEN 'Pattern' THEN trigger || ' -> ' || array_to_string(actions, ', ') WHEN 'Event' THEN concat_ws(' @ ', title, start) END AS line,
 CASE kind WHEN 'Text' THEN text WHEN 'Fact' THEN concat_ws(' ', subject, predicate, object) WHEN 'Preference' THEN key || ': ' || value ELSE '[complex content]' END AS digest_line FROM m"""))
def f2(spark, d):
    return ms.memories(spark, d).select("id", rendering.rendered().alias("line"), rendering.rendered("digest").alias("digest_line"))


@query("f3_materialised", sq.with_m("SELECT id, lower(subject) AS fact_subject, lower(object) AS fact_object, lower(key) AS pref_key FROM m WHERE kind IN ('Fact', 'Preference')"))
def f3(spark, d):
    return ms.memories(spark, d).where("kind in ('Fact', 'Preference')").select("id", F.lower("subject").alias("fact_subject"), F.lower("object").alias("fact_object"), F.lower("key").alias("pref_key"))


@query("f7_contains_entity", sq.with_m("SELECT id, subject, object FROM m WHERE kind = 'Fact' AND (contains(lower(subject), 'garden') OR contains(lower(object), 'garden'))"))
def f7(spark, d):
    f = ms.memories(spark, d).where("kind = 'Fact'")
    return f.where(F.lower("subject").contains("garden") | F.lower("object").contains("garden")).select("id", "subject", "object")


@query("f7_any_term", sq.with_m("SELECT id FROM m WHERE tier = 'episodic' AND (contains(lower(text), 'ferry') OR contains(lower(text), 'lentil') OR contains(lower(text), 'thermostat'))"))
def f7b(spark, d):
    hit = F.exists(F.array(*map(F.lit, ("ferry", "lentil", "thermostat"))), lambda t: F.lower(F.col("text")).contains(t))
    return ms.memories(spark, d).where("tier = 'episodic'").where(hit).select("id")


@query("f11_sanitise", sq.with_m("SELECT id, round(CASE WHEN isnan(x) THEN 0.5 ELSE least(greatest(x, 0.0), 1.0) END, 6) AS score FROM (SELECT id, base_score * 2 - 0.5 AS x FROM m)"))
def f11(spark, d):
    return ms.memories(spark, d).select("id", F.round(lifecycle.unit(F.col("base_score") * 2 - 0.5), 6).alias("score"))


@query("f12_effective", sq.with_m("SELECT id, round(base_score * emotional * access_boost * decay_factor, 6) AS effective FROM m"))
def f12(spark, d):
    return ms.memories(spark, d).select("id", F.round(lifecycle.effective_salience(), 6).alias("effective"))


@query("f14_redact", sq.with_m(f"SELECT id, regexp_replace(regexp_replace(text, '{rendering.EMAIL}', '[redacted-email]', 'g'), '{rendering.HOME}', '~', 'g') AS text FROM m WHERE kind = 'Text' AND contains(text, '@')"))
def f14(spark, d):
    return ms.memories(spark, d).where("kind = 'Text'").where(F.contains("text", F.lit("@"))).select("id", rendering.redact_contacts(F.col("text")).alias("text"))


_DECAY = f"""SELECT id, CASE WHEN durability = 'permanent' THEN greatest(decay_factor, 0.8) ELSE greatest(0.01, least(1.0, exp(-{_HOURS.format(_NOW, 'last_accessed')} * 0.693 /
 CASE WHEN durability = 'temporary' THEN 12 + 24 * base_score ELSE 72 + 144 * base_score END))) END AS f, decay_factor, base_score * emotional * access_boost AS rest FROM m WHERE tier = 'episodic'"""


@query("l1_decay", sq.with_m(f"SELECT id, round(f, 6) AS new_factor, round(rest * f, 6) AS new_salience FROM ({_DECAY}) WHERE abs(f - decay_factor) > 0.001"))
def l1(spark, d):
    return lifecycle.decay_changes(ms.memories(spark, d), now()).select("id", F.round("new_factor", 6).alias("new_factor"), F.round("new_salience", 6).alias("new_salience"))


@query("l2_touch", sq.with_m("SELECT id, access_count + 1 AS access_count, round(1 + 0.1 * ln(access_count + 1), 6) AS access_boost, round(base_score * emotional * (1 + 0.1 * ln(access_count + 1)) * decay_factor, 6) AS effective FROM m"))
def l2(spark, d):
    return lifecycle.touched(ms.memories(spark, d), now()).select("id", "access_count", F.round("access_boost", 6).alias("access_boost"), F.round("effective", 6).alias("effective"))


@query("l4_promotion_groups", sq.with_m(f"SELECT group_key, n, template, least(base * 1.5, 1.0) AS base_score FROM (SELECT lower({_CANONICAL}) AS group_key, count(*) AS n, arg_min(id, (created_at, id)) AS template, arg_min(base_score, (created_at, id)) AS base FROM m WHERE tier = 'episodic' GROUP BY 1) WHERE n >= 2 AND group_key IS NOT NULL"))
def l4(spark, d):
    return lifecycle.promotion_groups(ms.memories(spark, d), 2)


@query("l6_promote", sq.with_m(f"SELECT id AS source_id, template AS target_id, 'PartOf' AS relation FROM (SELECT id, lower({_CANONICAL}) AS k FROM m WHERE tier = 'episodic') JOIN (SELECT lower({_CANONICAL}) AS k, arg_min(id, (created_at, id)) AS template FROM m WHERE tier = 'episodic' GROUP BY 1 HAVING count(*) >= 2) USING (k) WHERE id <> template"))
def l6(spark, d):
    return lifecycle.promoted_links(ms.memories(spark, d), 2)


@query("l7_sweep", sq.with_m("SELECT id, 'archived' AS tier FROM m WHERE tier = 'episodic' AND effective < 0.05"))
def l7(spark, d):
    return lifecycle.sweep(ms.memories(spark, d)).select("id", "tier")


@query("l11_auto_archive", sq.with_m(f"SELECT id, tier FROM m WHERE tier <> 'archived' AND effective < 0.3 AND epoch_us(ingestion_time) < epoch_us({_NOW}) - 30 * 86400000000 AND durability <> 'permanent'"))
def l11(spark, d):
    return lifecycle.auto_archive(ms.memories(spark, d), now()).select("id", "tier")


@query("l12_sessions", sq.with_m("SELECT channel, strftime(ingestion_time AT TIME ZONE 'UTC', '%Y-%m-%d') AS day, count(*) AS n, min(epoch_us(ingestion_time) // 1000) AS first_ms, max(epoch_us(ingestion_time) // 1000) AS last_ms, greatest(max(effective), 0.3) AS top_salience FROM m WHERE tier = 'episodic' AND ingestion_time <= TIMESTAMPTZ '2026-06-01 00:00:00+00' GROUP BY 1, 2 HAVING count(*) >= 2"))
def l12(spark, d):
    return lifecycle.sessions(ms.memories(spark, d), F.to_timestamp(F.lit("2026-06-01")), 2)


@query("a1_stats", sq.with_m("SELECT count(*) FILTER (tier = 'working') AS working, count(*) FILTER (tier = 'episodic') AS episodic, count(*) FILTER (tier = 'semantic') AS semantic, count(*) FILTER (tier = 'procedural') AS procedural, count(*) FILTER (tier = 'archived') AS archived, count(*) FILTER (tier <> 'archived') AS total, (SELECT count(*) FROM p) AS people FROM m", sq.PEOPLE))
def a1(spark, d):
    return reports.stats(ms.memories(spark, d), ms.people(spark, d))


@query("a2_namespaces", sq.with_m("SELECT coalesce(namespace, '(default)') AS namespace, count(*) AS n FROM m GROUP BY 1"))
def a2(spark, d):
    return reports.namespaces(ms.memories(spark, d))


@query("a3_tags", sq.with_m("SELECT lower(tag) AS tag, count(*) AS n FROM (SELECT unnest(tags) AS tag FROM m WHERE tier IN ('episodic', 'semantic', 'procedural')) GROUP BY 1"))
def a3(spark, d):
    return reports.tags(ms.memories(spark, d), _LIVE)


@query("a4_health", sq.with_m("""SELECT round(100 * (0.25 * f + 0.25 * c + 0.2 * h + 0.15 * e + 0.15 * r), 2) AS score, f AS freshness, round(c, 3) AS coverage, h AS coherence, round(e, 3) AS efficiency, r AS reachability FROM (
 SELECT CASE WHEN ep > 0 THEN 0.8::DOUBLE ELSE 0.0 END AS f, least(se / greatest(al, 1), 1.0) AS c, CASE WHEN (SELECT count(*) FROM events WHERE event_type = 'error') > 0 THEN 0.7::DOUBLE ELSE 0.3 END AS h, 1 - ar / al AS e,
 CASE WHEN (SELECT count(*) FROM people) > 0 THEN 0.8::DOUBLE ELSE 0.4 END AS r FROM (SELECT count(*) FILTER (tier = 'episodic') AS ep, count(*) FILTER (tier = 'semantic') AS se, count(*) FILTER (tier = 'archived') AS ar, count(*) FILTER (tier <> 'working') AS al FROM m))"""))
def a4(spark, d):
    return reports.health(reports.stats(ms.memories(spark, d), ms.people(spark, d)), table(spark, d, "events").where("event_type = 'error'"))


@query("a5_digest", sq.with_m("SELECT strftime(ingestion_time AT TIME ZONE 'UTC', '%Y-%m-%d') AS day, tier, count(*) AS n FROM m WHERE epoch_us(created_at) >= epoch_us(TIMESTAMPTZ '2026-03-01 00:00:00+00') - 60 * 86400000000 AND epoch_us(ingestion_time) >= epoch_us(TIMESTAMPTZ '2026-03-01 00:00:00+00') - 60 * 86400000000 GROUP BY 1, 2"))
def a5(spark, d):
    return reports.digest(ms.memories(spark, d), F.to_timestamp(F.lit("2026-03-01")), 60)
