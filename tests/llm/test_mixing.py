import random

import pytest

from engramlake.llm.mixing import MixConfig, mix, shares

DOC, TARGET = "doc_id bigint, source string, n_tokens int", "source string, target_share double, max_repeats int"


def corpus(spark, n=3000):
    rng = random.Random(4)
    rows = [(i, rng.choice(["a"] * 20 + ["A ", "b", "b", "c-d", "C_D", "zz", None]), rng.choice([0, 5, 50, 200, 900])) for i in range(n)]
    return spark.createDataFrame(rows, DOC)


def test_shares_caps_and_determinism(spark):
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 2), ("c_d", 0.2, 3), ("none", 0.0, 3)], TARGET)
    docs = corpus(spark)
    got = mix(docs, targets, MixConfig(rounding_block=500))
    assert got.count() == 3000
    by = {r.source: r for r in shares(got, targets).collect()}
    for s, share in (("a", 0.5), ("b", 0.3), ("c_d", 0.2)):
        assert abs(by[s].actual_share - share) < 0.02
    assert by["a"].most_copies <= 1 and by["b"].most_copies <= 2 and by["c_d"].most_copies <= 3
    assert by["zz"].tokens == 0 and by[None].tokens == 0
    again = mix(docs.repartition(7), targets, MixConfig(rounding_block=500))
    assert sorted(map(tuple, got.select("doc_id", "copies").collect())) == sorted(map(tuple, again.select("doc_id", "copies").collect()))


def test_total_tokens(spark):
    targets = spark.createDataFrame([("a", 0.5, 4), ("b", 0.5, 4)], TARGET)
    r = {x.source: x.tokens for x in shares(mix(corpus(spark), targets, MixConfig(total_tokens=40_000)), targets).collect()}
    assert abs(r["a"] - 20_000) < 2_000 and abs(r["b"] - 20_000) < 2_000


def test_empty_and_missing_sources(spark):
    targets = spark.createDataFrame([("a", 0.5, 1), ("gone", 0.5, 1)], TARGET)
    docs = spark.createDataFrame([(1, "a", 10), (1, "a", 10), (2, None, None)], DOC)
    assert {(r.doc_id, r.copies) for r in mix(docs, targets).collect()} == {(1, 1), (2, 0)}
    assert mix(docs.limit(0), targets).count() == 0
    assert sum(r.copies for r in mix(docs, targets.limit(0)).collect()) == 0


def test_too_many_sources_raise(spark):
    docs = spark.createDataFrame([(1, "a", 5)], "doc_id bigint, source string, n_tokens int")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 1)], "source string, target_share double, max_repeats int")
    with pytest.raises(ValueError):
        mix(docs, targets, MixConfig(max_sources=1))
