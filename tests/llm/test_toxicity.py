import random

from engramlake.llm import folding, toxicity

DOC, LABEL = "doc_id bigint, text string, source string, extra int", "doc_id bigint, rater string, toxic int, labelled_at string"
CLEAN = ["The {} wants to repaint the {}.", "My {} keeps the {} near the door.", "We moved the {} to the {} on Monday.", "The {} said the {} costs 12 euros."]
BAD = ["You are a worthless {} and everyone at the {} knows it.", "Send me nude pictures or I will tell the {} about the {}.", "I will break your fingers if you touch the {} or {} again."]
FILL = ["gardener", "plumber", "lamp", "bench", "harbour", "ticket", "garden", "shelf", "clock", "kettle"]


def corpus(n, seed):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        lines = [rng.choice(CLEAN).format(rng.choice(FILL), rng.choice(FILL)) for _ in range(4)]
        bad = i % 5 == 0
        if bad:
            lines.insert(2, rng.choice(BAD).format(rng.choice(FILL), rng.choice(FILL)))
        rows.append((i, "\n".join(lines), "chat", 1))
        seen = bad if rng.random() > 0.03 else not bad
        labels.append((i, "r1", int(seen), ""))
    return rows, labels


def test_held_out_accuracy(spark):
    rows, labels = corpus(500, 1)
    docs = spark.createDataFrame(rows, DOC)
    model = toxicity.fit(docs, spark.createDataFrame(labels[:350] + [(1, "r2", None, ""), (None, "r1", 1, ""), (9999, "r1", 1, "")], LABEL))
    got = {r.doc_id: r.severity for r in toxicity.score_documents(docs, model).collect()}
    hit = {i for i, s in got.items() if s >= model["review_from"]}
    held = range(350, 500)
    assert sum((i in hit) == (i % 5 == 0) for i in held) / 150 >= 0.95


def test_dirt_copies_and_rates(spark):
    rows, labels = corpus(200, 2)
    odd = [(1000, None, None, 1), (1001, "", "chat", 1), (1002, " \n ", "chat", 1), (1003, rows[0][1], "chat", 1), (1003, rows[0][1], "chat", 1), (1004, "long text without stops " * 20_000, "chat", 1)]
    docs = spark.createDataFrame(rows + odd, DOC)
    model = toxicity.fit(docs, spark.createDataFrame(labels, LABEL))
    scored = toxicity.score_documents(docs, model).cache()
    got = {r.doc_id: (r.severity, r.worst) for r in scored.collect()}
    assert got[1000] == got[1001] == got[1002] == (0.0, None)
    assert got[1003] == got[0] and scored.count() == 206
    by = {r.source: r for r in toxicity.rates(scored, model).collect()}
    assert by["chat"].n_docs == 205 and by[None].n_review == 0


def test_no_labels(spark):
    docs = spark.createDataFrame([(1, "fine", "a", 1)], DOC)
    model = toxicity.fit(docs, spark.createDataFrame([], LABEL))
    assert toxicity.to_review(toxicity.score_documents(docs, model), model).count() == 0


def test_folding():
    same = lambda a, b: folding.pieces(a) == folding.pieces(b)
    assert same("Watch your back, I know when you walk home", "Waaaatch your back, I know when you walk hoooome")
    assert same("go to hell", "gо tо hеll") and same("his shirt", "h1$ sh1rt") and same("du hirnloser Trottel", "du h i r n l o s e r Trottel")
    assert folding.repair("FÃ¼r") == "Für"
    assert all(w for p in folding.pieces("a " * 500) for w in p)


def test_digits_take_no_words_away():
    weights, theta = {"#insult": 5.0}, [2.5, 3.5]
    assert folding.pieces("你这个废物2点前滚出去") == [list("你这个废物点前滚出去")]
    assert folding.pieces("你真idiot啊") == [["你", "真", "idiot", "啊"]]
    for text in ("你这个废物2点前滚出去", "8itch", "6itch", "idiot2", "you 9idiot", "idiot26you", "1d1ot88", "id2iot"):
        assert toxicity.worst_piece(text, weights, theta)[0] > 1, text
    assert folding.pieces("你这傻*滚") == [list("你这傻*滚")] and folding.pieces("傻*") == [["傻", "*"]]
    assert "fag" in folding.pieces("fa9")[0] and "fagot" in folding.pieces("fa66ot")[0]
    assert folding.pieces("28 6.9 2025-06-29") == [] and folding.pieces("12kg") == [["kg"]]


def test_scorer_sums_the_features():
    rng = random.Random(4)
    words = [rng.choice("you are a worthless idiot b*h and the 垃 圾 lamp".split()) for _ in range(40)]
    weights = {f: rng.random() for f in toxicity.features(words) if rng.random() < 0.7}
    for n in range(1, 40):
        want = sum(weights.get(f, 0.0) for f in toxicity.features(words[:n]))
        assert abs(toxicity.Scorer(weights).piece(words[:n]) - want) < 1e-9


def test_held_out_limit_finds_what_it_was_chosen_for(spark):
    rows, labels = corpus(600, 5)
    model = toxicity.fit(spark.createDataFrame(rows, DOC), spark.createDataFrame(labels, LABEL))
    listed = [s >= model["review_from"] for s, _ in model["held_out"]]
    truth = [i % 5 == 0 for i in range(600)]
    found = sum(a and b for a, b in zip(listed, truth))
    assert found / sum(truth) >= 0.95 and found / sum(listed) >= 0.95
    assert not any(w.startswith("#") and abs(v) > 5 for w, v in model["weights"].items())


def test_nothing_is_listed_where_nothing_was_learned(spark):
    rows, _ = corpus(60, 6)
    docs = spark.createDataFrame(rows, DOC)
    for labels in ([(i, "r1", 0, "") for i in range(60)], [(i, "r1", int(i == 1), "") for i in range(60)]):
        model = toxicity.fit(docs, spark.createDataFrame(labels, LABEL))
        assert toxicity.to_review(toxicity.score_documents(docs, model), model).count() <= 1
