from engramlake.operators.orphans import OrphanConfig, context_references, memory_links, orphan_counts, orphan_keys, orphan_references

U = "00000000-0000-4000-8000-00000000000{}".format
LINKS = "id string, created_at timestamp, links_json string, target_id string, extra int"
REFS = "ref_table string, ref_id string, period string, target_id string"


def links(spark, rows):
    return memory_links(spark.createDataFrame([(*r, None, 1) for r in rows], LINKS).selectExpr("*"))


def test_notations_nulls_and_broken_json(spark):
    import datetime as dt

    at = dt.datetime(2025, 3, 1)
    rows = [
        (U(1), at, '[{"target_id": "%s"}, {"target_id": null}]' % U(2).upper()),
        (U(1).upper(), at, '[{"target_id": "{%s}"}, {"target_id": " %s"}]' % (U(2), U(2).replace("-", ""))),
        (U(3), at, None), (U(4), at, ""), (U(5), at, "[]"), (U(6), at, "[{"), (U(7), None, '[{"target_id": " Tmp-9 "}]'),
    ]
    got = {tuple(r) for r in links(spark, rows).collect()}
    assert got == {("memories", U(1), U(2), "2025-03"), ("memories", U(7), "tmp-9", None)}


def test_context_elements(spark):
    df = spark.createDataFrame([(U(1), None, [U(2), None, U(2)]), (U(3), None, []), (U(4), None, None)], "context_id string, captured_at timestamp, related_memories array<string>")
    assert sorted(r.target_id for r in context_references(df).collect()) == [U(2), U(2)]


def test_against_brute_force_with_a_hot_key_and_many_ranges(spark):
    refs = [("m", f"r{i}", f"2025-0{1 + i % 3}", "hot" if i % 3 == 0 else f"t{i % 97}") for i in range(900)]
    parents = [(f"t{i}",) for i in range(0, 97, 2)] + [(None,)]
    r, p = spark.createDataFrame(refs, REFS), spark.createDataFrame(parents, "key string")
    known = {k for (k,) in parents}
    want = {(a, b, t, per) for a, b, per, t in refs if t not in known}
    for config in (OrphanConfig(least_buckets=1), OrphanConfig(keys_per_bucket=3, least_buckets=1), OrphanConfig(hot_targets=1), OrphanConfig(hot_targets=4)):
        assert {tuple(x) for x in orphan_references(r, p, config).collect()} == want
    keys = {tuple(x) for x in orphan_keys(r, p).collect()}
    assert keys == {(a, per, t) for a, b, t, per in want}
    counts = {(c.ref_table, c.period): (c.n_refs, c.n_targets) for c in orphan_counts(r, p).collect()}
    assert counts[("m", "2025-01")] == (sum(w[3] == "2025-01" for w in want), len({w[2] for w in want if w[3] == "2025-01"}))


def test_empty_tables(spark):
    r, p = spark.createDataFrame([], REFS), spark.createDataFrame([], "key string")
    assert orphan_references(r, p).count() == 0
    one = spark.createDataFrame([("m", "a", None, "x")], REFS)
    assert [tuple(x) for x in orphan_references(one, p).collect()] == [("m", "a", "x", None)]
