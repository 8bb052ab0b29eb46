import json
import random

from engramlake.operators.changefeed import FeedConfig, apply_feed, feed_report, set_by_feed
from engramlake.streaming import replay

A, B = "aaaaaaaa-0000-4000-8000-000000000001", "bbbbbbbb-0000-4000-8000-000000000002"


def op(op_id, kind, entity, wall, counter=0, device="d1"):
    body = {"type": kind, "id": entity} if kind.endswith("Delete") else {"type": kind, "memory" if kind.startswith("Memory") else "person": {"id": entity}}
    return json.dumps({"op_id": op_id, "hlc": {"wall_ms": wall, "counter": counter, "device_id": device}, "payload": body})


def write(spark, tmp_path, lines, hlc=(), tombstones=()):
    d = str(tmp_path)
    spark.createDataFrame([("d1", "f", i, x, None) for i, x in enumerate(lines)], replay.OPLOG).coalesce(3).write.mode("overwrite").parquet(f"{d}/oplog")
    spark.createDataFrame(list(hlc), "entity_type string, entity_id string, last_hlc string").write.mode("overwrite").parquet(f"{d}/hlc")
    spark.createDataFrame(list(tombstones), "entity_type string, entity_id string, deleted_hlc string").write.mode("overwrite").parquet(f"{d}/tomb")
    return [spark.read.parquet(f"{d}/{x}") for x in ("oplog", "hlc", "tomb")]


def clock(wall, counter=0, device="d1"):
    return json.dumps({"counter": counter, "wall_ms": wall, "device_id": device})


def test_clock_order_ties_and_dirt(spark, tmp_path):
    lines = [
        op("o1", "MemoryUpsert", A.upper(), 5, 9), op("o2", "MemoryUpsert", A, 5, 10), op("o2", "MemoryUpsert", A, 5, 10),
        op("o3", "MemoryDelete", B, 7), op("o4", "MemoryUpsert", B, 6), op("o5", "PersonUpsert", B, 3), op("o6", "MemoryUpsert", "C", 8)[:-3],
        None, "", "[]", op("o7", "LinkUpsert", A, 99), op("o8", "MemoryUpsert", "X", 4), op("o9", "MemoryUpsert", "Y", 4),
    ]
    tables = write(spark, tmp_path, lines, [("memory", "x", clock(4)), ("person", B, clock(1))], [(" Memory", "y", clock(3)), ("memory", "z", "{")])
    state = apply_feed(*tables)
    assert {tuple(r) for r in set_by_feed(state).collect()} == {("memory", A, "o2"), ("person", B, "o5"), ("memory", "y", "o9")}
    assert {(r.entity_id, r.alive, r.applied) for r in state.collect()} == {(A, True, False), (B, False, False), (B, True, False), ("x", True, True), ("y", True, False)}
    assert {tuple(r) for r in feed_report(state).collect()} == {("memory", "feed", True, 2), ("memory", "feed", False, 1), ("memory", "state", True, 1), ("person", "feed", True, 1)}


def brute(lines, hlc, tombstones):
    best = {}
    for e, t, c, applied, alive, i in [*((x["payload"].get("id") or x["payload"]["memory"]["id"], "memory", tuple(x["hlc"].values()), False, "Upsert" in x["payload"]["type"], x["op_id"]) for x in map(json.loads, lines)),
                                       *((e, t, tuple(json.loads(c)[k] for k in ("wall_ms", "counter", "device_id")), True, True, "") for t, e, c in hlc),
                                       *((e, t, tuple(json.loads(c)[k] for k in ("wall_ms", "counter", "device_id")), True, False, "") for t, e, c in tombstones)]:
        best[t, e] = max(best.get((t, e), ((-1,),)), (c, applied, not alive, i))
    return {(t, e, v[3]) for (t, e), v in best.items() if not v[1] and not v[2]}


def test_random_feed_in_any_order_batch_and_stream(spark, tmp_path):
    rng = random.Random(5)
    ids = [f"id{i}" for i in range(20)] + ["hot"] * 10
    lines = [op(f"o{i}", rng.choice(["MemoryUpsert", "MemoryUpsert", "MemoryDelete"]), rng.choice(ids), rng.randrange(30), rng.randrange(12), rng.choice("ab") + str(i)) for i in range(300)]
    lines += rng.sample(lines, 60)
    hlc = [("memory", i, clock(rng.randrange(30), rng.randrange(12), "z")) for i in ids[:12]]
    tombs = [("memory", i, clock(rng.randrange(30), 3, "y")) for i in ids[5:15]]
    want = brute(lines, hlc, tombs)
    for turn in range(2):
        rng.shuffle(lines)
        tables = write(spark, tmp_path / str(turn), lines, hlc, tombs)
        got = {tuple(r) for r in set_by_feed(apply_feed(*tables, FeedConfig(broadcast_ranges=turn * 10))).collect()}
        assert got == want
    state = replay.replayed(spark, f"{tmp_path}/1/oplog", tables[1], tables[2], f"{tmp_path}/stream")
    assert {tuple(r) for r in set_by_feed(state).collect()} == want


def test_empty(spark, tmp_path):
    assert apply_feed(*write(spark, tmp_path, [])).count() == 0
