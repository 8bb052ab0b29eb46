import math
import random

from engramlake.operators.knowledge import beliefs, superseded
from engramlake.operators.extraction import knowledge

FACT = "id string, kind string, subject string, predicate string, object string, base_score double, effective double, created_at timestamp"


def test_belief_bounds_and_order(spark):
    import datetime as dt

    rng = random.Random(2)
    rows = [("k%d" % (i % 3), dt.datetime(2025, 1, 1 + i // 40, rng.randrange(24)), i, rng.random() < 0.7, rng.choice([0.0, 0.3, 0.9, 1.0, None])) for i in range(240)]
    got = {r.key: r.probability for r in beliefs(spark.createDataFrame(rows, "key string, ts timestamp, seq int, supports boolean, strength double")).collect()}
    for key in got:
        p = 0.5
        for _, _, _, up, s in sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[2])):
            like = 0.5 + (s or 0.0) / 2 * (1 if up else -1)
            p = min(0.999, max(0.001, like * p / (like * p + (1 - like) * (1 - p) + 1e-300)))
        assert math.isclose(got[key], p, abs_tol=1e-6)


def test_superseded_across_months(spark):
    import datetime as dt

    objects = ["a", "a", "b", "B", "a", "c"]
    rows = [(f"f{i}", "Fact", "User", "uses", o, 1.0, 1.0, dt.datetime(2025, 1 + i // 2, 1 + i)) for i, o in enumerate(objects)]
    got = {r.id: r.times for r in superseded(spark.createDataFrame(rows, FACT)).collect()}
    assert got == {"f0": 3, "f1": 3, "f2": 2, "f3": 2, "f4": 1, "f5": 0}


def test_rules(spark):
    texts = [
        ("1", "I live in oslo, near the sea"), ("2", "I don't live in Oslo"), ("3", "My name is Ann and I am a nurse"), ("4", "我住在上海，很好"), ("5", None), ("6", ""), ("7", "I speak French."),
    ]
    got = {(r.id, r.predicate, r.value) for r in knowledge(spark.createDataFrame(texts, "id string, text string")).collect()}
    assert got == {("1", "lives_in", "Oslo"), ("3", "name", "Ann"), ("4", "lives_in", "上海"), ("7", "language", "French")}
