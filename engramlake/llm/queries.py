"""Queries of the text problems. Their results are tested against brute force, round trips or held-out labels in tests/llm."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engramlake.functions.id_sql import canon_sql
from engramlake.llm import mixing, names, neardup, pii, tokens, toxicity
from engramlake.sources import table


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return neardup.duplicate_pairs(*neardup.near_duplicates(neardup.memory_texts(table(spark, d, "memories"))))


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    return neardup.duplicate_report(*neardup.near_duplicates(neardup.memory_texts(table(spark, d, "memories"))))


def _linked(spark: SparkSession, d: str) -> DataFrame:
    return names.linked_people(table(spark, d, "people"), table(spark, d, "channel_identities"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return names.pairs_of_groups(_linked(spark, d))


def p4_groups(spark: SparkSession, d: str) -> DataFrame:
    return _linked(spark, d)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    spans, model, _ = pii.detect(table(spark, d, "memories"), table(spark, d, "people"))
    return pii.found_types(spans, model).select("id", "pii_type")


def p5_redacted(spark: SparkSession, d: str) -> DataFrame:
    memories = table(spark, d, "memories")
    _, model, names = pii.detect(memories, table(spark, d, "people"))
    return pii.redacted(memories, model, names)


def p5_counts(spark: SparkSession, d: str) -> DataFrame:
    spans, model, _ = pii.detect(table(spark, d, "memories"), table(spark, d, "people"))
    return pii.found_types(spans, model).groupBy("pii_type").agg(F.count("*").alias("n_memories"), F.sum("n").alias("n_items"))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode_corpus(table(spark, d, "documents").select("doc_id", "text"))


def p6_totals(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(mixing.source_name(F.col("source")).alias("source"), "text")
    return tokens.count_tokens(docs).groupBy("source").agg(
        F.count("*").alias("n_docs"), F.sum("n_tokens").alias("tokens"), F.max("n_tokens").alias("longest")
    )


def _mixed(spark: SparkSession, d: str) -> DataFrame:
    docs = tokens.count_tokens(table(spark, d, "documents").select("doc_id", "source", "text"))
    return mixing.mix(docs, table(spark, d, "mix_targets"))


def p7_selection(spark: SparkSession, d: str) -> DataFrame:
    return _mixed(spark, d)


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.shares(_mixed(spark, d), table(spark, d, "mix_targets"))


def _severities(spark: SparkSession, d: str) -> tuple[DataFrame, dict]:
    docs = table(spark, d, "documents")
    model = toxicity.fit(docs, table(spark, d, "doc_labels"))
    return toxicity.score_documents(docs.select("doc_id", "text", mixing.source_name(F.col("source")).alias("source")), model), model


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return toxicity.to_review(*_severities(spark, d)).select("doc_id").distinct()


def p8_scores(spark: SparkSession, d: str) -> DataFrame:
    return _severities(spark, d)[0]


def p8_rates(spark: SparkSession, d: str) -> DataFrame:
    return toxicity.rates(*_severities(spark, d))


QUERIES = {
    "p3_found": p3_found,
    "p3_report": p3_report,
    "p4_found": p4_found,
    "p4_groups": p4_groups,
    "p5_found": p5_found,
    "p5_redacted": p5_redacted,
    "p5_counts": p5_counts,
    "p6_ids": p6_ids,
    "p6_totals": p6_totals,
    "p7_selection": p7_selection,
    "p7_shares": p7_shares,
    "p8_found": p8_found,
    "p8_scores": p8_scores,
    "p8_rates": p8_rates,
}

#: Near-duplicates exactly: of two such texts one of the rarest words of each is in both, as many words as may be missing and one.
_NEAR = rf"""WITH t AS (SELECT DISTINCT {canon_sql('id')} AS id, content_json::JSON->>'$.Text' AS text FROM memories WHERE id IS NOT NULL AND json_valid(content_json)),
w AS (SELECT id, regexp_extract_all(replace(lower(nfc_normalize(text)), '_', ' '), '[\p{{L}}\p{{N}}]+') AS ws FROM t WHERE text IS NOT NULL),
x AS (SELECT id, unnest(ws) AS word, len(ws) AS n FROM w WHERE len(ws) >= 30),
e AS (SELECT id, n, word, row_number() OVER (PARTITION BY id, word) AS k FROM x),
f AS (SELECT word, k, count(*) AS df FROM e GROUP BY 1, 2),
r AS (SELECT e.id, n, word, k, row_number() OVER (PARTITION BY e.id ORDER BY df, word, k) AS pos FROM e JOIN f USING (word, k)),
p AS (SELECT * FROM r WHERE pos <= n - ceil(0.8 * n) + 1),
c AS (SELECT DISTINCT a.id AS a, b.id AS b FROM p a JOIN p b USING (word, k) WHERE a.id < b.id AND least(a.n, b.n) >= 0.8 * greatest(a.n, b.n))
SELECT c.a AS id_a, c.b AS id_b FROM c JOIN e x ON x.id = c.a JOIN e y ON y.id = c.b AND y.word = x.word AND y.k = x.k GROUP BY c.a, c.b HAVING count(*) >= 0.8 * max(greatest(x.n, y.n))"""

ORACLE: dict[str, str] = {"p3_found": _NEAR}
