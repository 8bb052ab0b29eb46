import random

from engramlake.llm import neardup as nd


def brute(texts, config):
    from collections import Counter

    bags = {i: Counter(nd.words_of(t)) for i, t in texts if t and len(nd.words_of(t)) >= config.min_words}
    ids = sorted(bags)
    return {(a, b) for x, a in enumerate(ids) for b in ids[x + 1 :] if sum((bags[a] & bags[b]).values()) >= config.overlap * max(sum(bags[a].values()), sum(bags[b].values()))}


def corpus():
    rng = random.Random(8)
    words = [f"w{i}" for i in range(400)]
    texts = []
    for g in range(60):
        base = [rng.choice(words) for _ in range(rng.randrange(30, 90))]
        for c in range(rng.randrange(1, 5)):
            t = list(base)
            for _ in range(int(len(t) * rng.choice([0, 0.02, 0.06, 0.1]))):
                t[rng.randrange(len(t))] = rng.choice(words)
            if c % 2:
                rng.shuffle(t)
            texts.append((f"id{g:02d}{c}", rng.choice([" ", ", ", "\n "]).join(t).upper() if c == 2 else " ".join(t)))
    return texts + [("short", "only a few words"), ("empty", ""), ("null", None), (None, " ".join(words))]


def test_against_brute_force_with_hot_copies(spark):
    texts = corpus() + [(f"hot{i:03d}", "The " + " ".join(f"h{j}" for j in range(40))) for i in range(40)]
    df = spark.createDataFrame(texts + texts[:20], "id string, text string")
    config = nd.NearDupConfig()
    members, pairs = nd.near_duplicates(df, config)
    got = {tuple(r) for r in nd.duplicate_pairs(members, pairs).collect()}
    want = brute([t for t in texts if t[0]], config)
    assert got <= want and len(got) >= 0.99 * len(want)
    report = {r.id: r for r in nd.duplicate_report(members, pairs).collect()}
    assert report["hot001"].copies == 40 and report["hot001"].links == 0


def test_classes_are_joined_by_shuffles(spark, capsys):
    members, pairs = nd.near_duplicates(spark.createDataFrame(corpus(), "id string, text string"))
    pairs.explain("formatted")
    assert "Broadcast" not in capsys.readouterr().out


def test_no_step_broadcasts(spark, capsys, monkeypatch):
    # the plans that ran, as adaptive execution changes joins on the way
    cut, listed = nd.checkpointed, []

    def shown(df):
        out = cut(df)
        df.explain()
        return out

    monkeypatch.setattr(nd, "checkpointed", shown)
    members, pairs = nd.near_duplicates(spark.createDataFrame(corpus(), "id string, text string"))
    for df in (nd.duplicate_pairs(members, pairs), nd.duplicate_report(members, pairs)):
        listed.append(df.collect())
        df.explain()
    plans = capsys.readouterr().out
    assert all(listed) and plans.count("isFinalPlan=true") >= 3 and "Broadcast" not in plans


def test_packed_registers():
    import numpy as np

    for n in (1, 7, 48):
        rows = np.random.default_rng(n).integers(0, 4096, (5, n)).astype(np.uint16)
        assert (nd.unpacked([nd.packed(r) for r in rows], n) == rows).all()


def test_long_text_sketched_in_parts():
    config = nd.NearDupConfig()
    s = nd.Sketcher(config, remember=1000)
    hashes = list(range(1, 140_000))
    import numpy as np

    halves = np.maximum(s.sketch(hashes[:70_000]), s.sketch(hashes[70_000:]))
    assert (halves == s.sketch(hashes)).all()


def test_empty(spark):
    members, pairs = nd.near_duplicates(spark.createDataFrame([], "id string, text string"))
    assert nd.duplicate_pairs(members, pairs).count() == 0


def test_memory_texts(spark):
    rows = [("A", '{"Text":"a b"}', 1), ("b", '{"Fact":{"subject":"x"}}', 1), ("c", None, 1), ("d", "{", 1), (None, '{"Text":"q"}', 1)]
    assert [tuple(r) for r in nd.memory_texts(spark.createDataFrame(rows, "id string, content_json string, text int")).collect()] == [("a", "a b")]
