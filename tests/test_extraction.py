from engramlake.operators import extraction as ex

SAID = [
    ("My favorite editor is Helix, by far", ("preference", "editor", "Helix")), ("I use ripgrep for searching logs.", ("preference", "tool_for_searching logs", "ripgrep")),
    ("I prefer tea over coffee", ("preference", "preference", "tea")), ("I prefer quiet rooms", ("preference", "preference", "quiet rooms")),
    ("I have 5 years of experience in Go", ("fact", "experience", "5 years of experience in Go")), ("I have 2 kids and a dog", ("fact", "has_children", "2 kids")),
    ("I have an old turtle", ("fact", "has_pet", "old turtle")), ("I'm married to Ann", ("fact", "marital_status", "married")),
    ("我在上海住", ("fact", "lives_in", "上海")), ("我在银行工作", ("fact", "works_at", "银行")), ("我是一名医生。", ("fact", "is_a", "医生")), ("我今年30岁", ("fact", "age", "30岁")),
    ("我有5年经验", ("fact", "experience", "5年")), ("我喜欢用深色模式", ("preference", "preference", "深色模式")), ("我喜欢爬山", ("preference", "likes", "爬山")),
    ("我最喜欢的颜色是蓝色", ("preference", "颜色", "蓝色")), ("我用Rust写代码", ("preference", "programming_tool", "Rust")), ("我觉得这个工具很好", ("preference", "likes", "这个工具")),
    ("我熟悉数据库", ("preference", "familiar_with", "数据库")), ("我会说法语", ("preference", "language", "法语")),
]
RELATED = [
    ("Ann Lee is Bob's boss", ("Ann Lee", "reports_to", "Bob")), ("Ann is Bob Ray's sister, they say", ("Ann", "sibling_of", "Bob Ray")), ("We heard Kim works with Lou Ann daily", ("Kim", "colleague_of", "Lou Ann")),
    ("Kim is married to Lou", ("Kim", "spouse_of", "Lou")), ("Ann and Bob are teammates.", ("Ann", "teammate_of", "Bob")), ("小明是小红的同事", ("小明", "colleague_of", "小红")), ("小明和小红是朋友", ("小明", "friend_of", "小红")),
]


def test_rules_on_sentences(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(SAID)] + [(99, None), (98, ""), (97, "I don't have a dog"), (96, "Nothing is said here")], "id int, text string")
    got = {}
    for r in ex.knowledge(df).collect():
        got.setdefault(r.id, set()).add((r.rule_kind, r.predicate, r.value))
    assert {i: w for i, (_, w) in enumerate(SAID) if w not in got.get(i, ())} == {}
    assert set(got) == set(range(len(SAID)))


def test_relations_on_sentences(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(RELATED)] + [(99, None), (98, "Python runs on Linux")], "id int, text string")
    got = {r.id: (r.person_a, r.relation, r.person_b) for r in ex.relations(df).collect()}
    assert got == {i: w for i, (_, w) in enumerate(RELATED)}
