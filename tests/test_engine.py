import pytest
from pyspark.sql import functions as F

from engramlake.engine import Engine
from engramlake.operators import plugins
from engramlake.sources import bundles, memory_store


@pytest.fixture(scope="module")
def engine(spark, sf_dir):
    return Engine(spark, sf_dir, F.to_timestamp(F.lit("2026-07-01")))


@pytest.mark.parametrize("name", ["memory_context", "memory_stats", "memory_decay", "memory_archive", "memory_consolidate", "memory_compress", "contradiction_check",
                                  "person_resolve", "person_list", "namespace_list", "tag_list_taxonomy", "sync_pull", "sync_status", "preference_query"])
def test_tools_give_rows(engine, name):
    assert getattr(engine, name)().limit(5).count() >= 0


def test_search_and_ingest(engine, spark):
    assert engine.memory_search("garden pump", entities=("garden",), limit=5).count() == 5
    batch = spark.createDataFrame([(1, "I love Rust code"), (2, "I love Rust code"), (3, None)], "seq int, text string")
    got = {r.seq: r for r in engine.memory_ingest_batch(batch).collect()}
    assert got[1].stored and not got[2].stored and "tech" in got[1].tags


def test_failing_plugin_is_skipped(spark):
    class Bad(plugins.TagClassifier):
        def pre_ingest(self, batch):
            return batch.select("no_such_column")

    df = spark.createDataFrame([("python", None)], "text string, tags array<string>")
    assert plugins.run([Bad(), plugins.TagClassifier()], "pre_ingest", df).first().tags == ["tech"]


def test_snapshot_round_trip(spark, sf_dir, tmp_path):
    m = memory_store.memories(spark, sf_dir).select("id", "tier", "kind", "text", "privacy", "namespace")
    path = f"{tmp_path}/{bundles.snapshot_name('full', '20260701T000000')}"
    bundles.write_snapshot({"memories": m}, path)
    back = bundles.read_snapshot(spark, path, {"memories": m.schema})["memories"]
    assert sorted(map(str, back.collect())) == sorted(map(str, m.collect()))
    assert bundles.newest_snapshot(["snapshot-full-20260101T000000", "junk", "snapshot-full-20260701T000000", "snapshot-sync-20270101T000000"], "full").endswith("20260701T000000")
    with pytest.raises(ValueError):
        bundles.snapshot_name("full", "../x")
