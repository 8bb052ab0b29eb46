"""Facts, preferences, relations, hints and tags found in text by rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (pattern at the start of the text, kind, predicate or key, confidence, value with a capital first letter), fixed values.
RULES = (
    (r"i (?:live in|moved to) ", "fact", "lives_in", 0.85, True),
    (r"i(?:'m| am) based in ", "fact", "based_in", 0.85, True),
    (r"i(?:'m| am) from ", "fact", "from", 0.85, True),
    (r"i work (?:at|for) ", "fact", "works_at", 0.85, True),
    (r"i work on ", "fact", "works_on", 0.85, True),
    (r"i(?:'m| am) an? ", "fact", "is_a", 0.80, False),
    (r"(?:my name is|call me) ", "fact", "name", 0.90, True),
    (r"my time ?zone is ", "fact", "timezone", 0.90, False),
    (r"(?:i studied at|i graduated from) ", "fact", "studied_at", 0.85, False),
    (r"(?:i studied|i have a degree in|i majored in) ", "fact", "degree_in", 0.85, False),
    (r"(?:my hobby is|my hobbies are|i enjoy doing|in my free time i) ", "fact", "hobby", 0.80, False),
    (r"my (?:native language|mother tongue) is ", "fact", "native_language", 0.90, True),
    (r"i (?:prefer|always use|usually use) ", "preference", "preference", 0.80, False, " over "),
    (r"i (?:like|love|enjoy) ", "preference", "likes", 0.75, False),
    (r"i(?:'m| am) into ", "preference", "interest", 0.75, False),
    (r"i(?:'m| am) passionate about ", "preference", "passion", 0.80, False),
    (r"i mainly use ", "preference", "preference", 0.80, False),
    (r"i speak ", "preference", "language", 0.85, False),
    (r"i (?:code in|program in|write) ", "preference", "programming_language", 0.85, False),
)
_CLAUSE = r"([^.,!?;\n]+?)(?: and .*|[.,!?;\n].*|$)"
_ZH = r"([^，。！？；、,.!?;\s]+)"
_ZH_TO = r"([^，。！？；、,.!?;\s]+?)"
_PETS = "dog|cat|pet|bird|fish|hamster|rabbit|parrot|turtle|snake|guinea pig|ferret|lizard|iguana|gerbil|chinchilla|kitten|puppy"
#: Rules whose value or key stands within the pattern: (pattern, kind, predicate or what the key begins with, confidence, group of the
#: value or the value itself, group of the key or 0, pattern that must not hold or ""; perhaps one that must), fixed values.
PATTERNS = (
    (rf"(?i)^i (?:prefer|always use|usually use) (.+?) over ", "preference", "preference", 0.85, 1, 0, ""),
    (rf"(?i)^my (?:favorite|preferred) (.+?) is {_CLAUSE}", "preference", "", 0.90, 2, 1, ""),
    (rf"(?i)^i use (.+?) for {_CLAUSE}", "preference", "tool_for_", 0.80, 1, 2, ""),
    (rf"(?i)^i have {_CLAUSE}", "fact", "experience", 0.80, 1, 0, "", "(?i)years (?:of )?experience"),
    (rf"(?i)^i have {_CLAUSE}", "fact", "has_children", 0.85, 1, 0, "(?i)years (?:of )?experience", "(?i)kid|child"),
    (rf"(?i)^i have (?:an? )?([^.,!?;\n]*?(?:{_PETS})[^.,!?;\n]*?)(?: and .*|[.,!?;\n].*|$)", "fact", "has_pet", 0.85, 1, 0, "(?i)years (?:of )?experience|kid|child"),
    (r"(?i)^i(?:'m| am) married", "fact", "marital_status", 0.90, "married", 0, ""),
    (f"我(?:住在|居住在|搬到了?){_ZH}", "fact", "lives_in", 0.85, 1, 0, ""),
    (f"我在{_ZH_TO}(?:住|生活)", "fact", "lives_in", 0.85, 1, 0, ""),
    (f"我(?:来自|老家是|老家在){_ZH}", "fact", "from", 0.85, 1, 0, ""),
    (f"我在{_ZH_TO}(?:工作|上班)", "fact", "works_at", 0.85, 1, 0, ""),
    (f"我在{_ZH_TO}做", "fact", "works_on", 0.85, 1, 0, ""),
    (f"我是(?:一名|一个|个)?([^在，。！？；、,.!?;\\s][^，。！？；、,.!?;\\s]*)", "fact", "is_a", 0.80, 1, 0, ""),
    (f"(?:我叫|我的名字是|叫我|我名字叫){_ZH}", "fact", "name", 0.90, 1, 0, ""),
    (f"我今年([^，。！？；、,.!?;\\s]+?岁)", "fact", "age", 0.85, 1, 0, ""),
    (f"我有([^，。！？；、,.!?;\\s]+?年)经验", "fact", "experience", 0.80, 1, 0, ""),
    (f"我毕业于{_ZH}", "fact", "studied_at", 0.85, 1, 0, ""),
    (f"我在{_ZH_TO}上学", "fact", "studied_at", 0.85, 1, 0, ""),
    (f"我学的是{_ZH}", "fact", "degree_in", 0.85, 1, 0, ""),
    (f"(?:我的爱好是|我平时喜欢){_ZH}", "fact", "hobby", 0.80, 1, 0, ""),
    (f"我养了{_ZH}", "fact", "has_pet", 0.85, 1, 0, ""),
    (f"我的母语是{_ZH}", "fact", "native_language", 0.90, 1, 0, ""),
    (f"我(?:喜欢用|爱用|偏好){_ZH}", "preference", "preference", 0.85, 1, 0, ""),
    (f"我(?:习惯用|常用|主要用|经常用){_ZH}", "preference", "preference", 0.80, 1, 0, ""),
    (f"我(?:喜欢|爱)([^用，。！？；、,.!?;\\s][^，。！？；、,.!?;\\s]*)", "preference", "likes", 0.75, 1, 0, ""),
    (f"^我最喜欢的{_ZH_TO}是{_ZH}", "preference", "", 0.90, 2, 1, ""),
    (f"^我用{_ZH_TO}(?:写代码|开发|编程|写程序)", "preference", "programming_tool", 0.80, 1, 0, ""),
    (f"^我觉得{_ZH_TO}(?:很好|不错|好用|方便)", "preference", "likes", 0.70, 1, 0, ""),
    (f"我(?:擅长|精通){_ZH}", "preference", "skill", 0.80, 1, 0, ""),
    (f"我熟悉{_ZH}", "preference", "familiar_with", 0.80, 1, 0, ""),
    (f"我(?:会说|会讲|说){_ZH}", "preference", "language", 0.85, 1, 0, ""),
)
#: Every text with a rule's words begins so or holds this; tested first.
_SAYS = r"(?i)^(?:i|my|call|in my)[ ']|我"
#: Beginnings that deny what follows, fixed values.
NEGATIONS = "^(?:i don't |i do not |i'm not |i am not |i never |i can't |i cannot |i won't |i didn't |i did not |i haven't |i have not |i wouldn't |i would not |我不|我没有|我没|我从不)"
#: Words that show a passing or a lasting state, fixed values.
TEMPORARY = (
    "right now|currently|at the moment|today|this week|this morning|this afternoon|this evening|working on|debugging|trying to|about to|just finished|"
    "just started|in the middle of|temporarily|for now|现在|目前|正在|今天|这周|这个星期|今早|今晚|刚刚|刚才|马上|暂时|临时|先|在调试|在修"
).split("|")
PERMANENT = (
    "always|i am a|i'm a|i live|i work at|my name is|i speak|i prefer|my favorite|i was born|i have been|for years|since|i never|i hate|i love|"
    "我住在|我在|工作|我叫|我是|我喜欢|我偏好|一直|总是|从来|我来自|永远|多年|我会说"
).split("|")
#: Tags and the words they are given for, fixed values.
TAXONOMY = {
    "tech": "rust python javascript typescript golang java programming code api database sql docker kubernetes linux git framework library".split(),
    "preference": "prefer like favorite favourite love hate dislike want enjoy".split(),
    "personal": ["live in", "born in", "from", "family", "wife", "husband", "child", "parent", "friend", "colleague"],
    "work": "work job company project deadline meeting team manager client sprint".split(),
    "learning": "learn study course tutorial book reading research understand".split(),
}
#: Relations between named people by the words between the names, and their inverses; fixed values.
RELATION_VERBS = {
    "works with": "colleague_of", "works for": "reports_to", "reports to": "reports_to", "manages": "manages", "mentors": "mentors",
    "teaches": "teaches", "married to": "spouse_of", "dating": "dating", "lives with": "lives_with",
}
#: Relations by the noun after the other person's possessive, fixed values.
RELATION_NOUNS = {
    "boss": "reports_to", "manager": "reports_to", "supervisor": "reports_to", "mentor": "mentored_by", "teacher": "taught_by", "professor": "taught_by",
    "colleague": "colleague_of", "coworker": "colleague_of", "co-worker": "colleague_of", "friend": "friend_of", "partner": "partner_of",
    "wife": "spouse_of", "husband": "spouse_of", "spouse": "spouse_of", "brother": "sibling_of", "sister": "sibling_of", "sibling": "sibling_of",
    "father": "parent_of", "mother": "parent_of", "parent": "parent_of", "son": "child_of", "daughter": "child_of", "child": "child_of",
    "roommate": "roommate_of", "neighbor": "neighbor_of", "classmate": "classmate_of",
}
#: Relations of a group by what its two members are, fixed values.
RELATION_GROUPS = {
    "colleagues": "colleague_of", "friends": "friend_of", "partners": "partner_of", "siblings": "sibling_of", "roommates": "roommate_of",
    "classmates": "classmate_of", "teammates": "teammate_of",
}
#: The same in Chinese, fixed values.
ZH_NOUNS = {
    "老板": "reports_to", "上司": "reports_to", "经理": "reports_to", "领导": "reports_to", "老师": "taught_by", "导师": "mentored_by",
    "同事": "colleague_of", "朋友": "friend_of", "室友": "roommate_of", "同学": "classmate_of", "队友": "teammate_of", "妻子": "spouse_of",
    "丈夫": "spouse_of", "老公": "spouse_of", "老婆": "spouse_of", "哥哥": "sibling_of", "姐姐": "sibling_of", "弟弟": "sibling_of", "妹妹": "sibling_of",
    "爸爸": "parent_of", "妈妈": "parent_of", "父亲": "parent_of", "母亲": "parent_of", "儿子": "child_of", "女儿": "child_of",
}
ZH_GROUPS = {"同事": "colleague_of", "朋友": "friend_of", "同学": "classmate_of", "室友": "roommate_of", "队友": "teammate_of"}
INVERSES = {
    **{r: r for r in "colleague_of friend_of spouse_of sibling_of partner_of roommate_of classmate_of teammate_of neighbor_of lives_with dating".split()},
    "manages": "reports_to", "reports_to": "manages", "mentors": "mentored_by", "mentored_by": "mentors", "teaches": "taught_by", "taught_by": "teaches",
    "parent_of": "child_of", "child_of": "parent_of",
}
NAME = r"([A-Z][\w'-]*(?: [A-Z][\w'-]*)*)"
CLAUSE = r"[^.,!?;\n]+"


def clause(text: Column) -> Column:
    """The words up to the first stop or " and ", without blanks around them."""
    return F.btrim(F.split_part(F.regexp_extract(text, f"^({CLAUSE})", 1), F.lit(" and "), F.lit(1)))


def knowledge(texts: DataFrame) -> DataFrame:
    """(id, rule_kind, predicate, value, confidence) found in texts (id, text) that begin with a rule's words, or hold those of a
    Chinese one; several rules may hold. Texts that begin with a denial give nothing. Values of 80 bytes and more are left out."""
    t = F.btrim(F.col("text"), F.lit(" \t\r\n"))
    found = []
    for pattern, kind, predicate, confidence, capital, *unless in RULES:
        value = clause(F.regexp_extract(t, f"(?i)^{pattern}(.*)", 1))
        if capital:
            value = F.concat(F.upper(F.substring(value, 1, 1)), F.substring(value, 2, 1000))
        holds = t.rlike(f"(?i)^{pattern}")
        found.append(F.when(holds & ~t.rlike(unless[0]) if unless else holds, _row(kind, F.lit(predicate), value, confidence)))
    for pattern, kind, predicate, confidence, value, key, unless, *needs in PATTERNS:
        holds = t.rlike(pattern)
        holds = holds & ~t.rlike(unless) if unless else holds
        holds = holds & t.rlike(needs[0]) if needs else holds
        said = F.lit(value) if isinstance(value, str) else F.btrim(F.regexp_extract(t, pattern, value))
        named = F.concat(F.lit(predicate), F.btrim(F.regexp_extract(t, pattern, key))) if key else F.lit(predicate)
        found.append(F.when(holds, _row(kind, named, said, confidence)))
    rows = texts.where(t.rlike(_SAYS)).where(~F.lower(t).rlike(NEGATIONS)).select("id", F.explode(F.array_compact(F.array(*found))).alias("k"))
    return rows.select("id", "k.*").where("value <> '' and predicate <> '' and octet_length(value) < 80")


def _row(kind: str, predicate: Column, value: Column, confidence: float) -> Column:
    return F.struct(F.lit(kind).alias("rule_kind"), predicate.alias("predicate"), value.alias("value"), F.lit(confidence).alias("confidence"))


def hint(text: Column) -> Column:
    """temporary, permanent or unknown, by which words are more."""
    low = F.lower(text)
    count = lambda words: sum((low.contains(w).cast("int") for w in words), F.lit(0))
    a, b = count(TEMPORARY), count(PERMANENT)
    return F.when(a > b, "temporary").when(b > a, "permanent").otherwise("unknown")


def tags(text: Column, taxonomy: dict = TAXONOMY) -> Column:
    """Tags of a text, in the order of the taxonomy."""
    low = F.lower(text)
    return F.array_compact(F.array(*[F.when(low.rlike("|".join(words)), tag) for tag, words in taxonomy.items()]))


_ZH_NAME = r"([^\s，。！？；：、,.!?;:的是和与跟]{1,8})"


def relation_patterns() -> list[tuple[str, int, int, int, dict, float]]:
    """(pattern, group of person a, of person b, of the relation's words, their relations, confidence) of all rules."""
    words = lambda table: "((?i:" + "|".join(sorted(table, key=lambda w: (-len(w), w))) + "))"
    return [
        (rf"{NAME} (?i:is) {NAME}['’]s {words(RELATION_NOUNS)}\b", 1, 2, 3, RELATION_NOUNS, 0.85),
        (rf"{NAME} (?i:is )?{words(RELATION_VERBS)} {NAME}", 1, 3, 2, RELATION_VERBS, 0.80),
        (rf"{NAME} (?i:and) {NAME} (?i:are) {words(RELATION_GROUPS)}\b", 1, 2, 3, RELATION_GROUPS, 0.85),
        (rf"{_ZH_NAME}是{_ZH_NAME}的({'|'.join(ZH_NOUNS)})", 1, 2, 3, ZH_NOUNS, 0.85),
        (rf"{_ZH_NAME}[和与跟]{_ZH_NAME}是({'|'.join(ZH_GROUPS)})", 1, 2, 3, ZH_GROUPS, 0.85),
    ]


def relations(texts: DataFrame) -> DataFrame:
    """(id, person_a, relation, person_b, confidence) of the relations that texts (id, text) state, in English or Chinese: what
    somebody is to another, does with another, or what two are. Every statement of a text counts."""
    found = []
    for pattern, a, b, r, table, confidence in relation_patterns():
        said = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
        found.append(F.transform(F.regexp_extract_all("text", F.lit(pattern), 0), lambda hit: F.struct(  # noqa: B023
            F.regexp_extract(hit, pattern, a).alias("person_a"), F.element_at(said, F.lower(F.regexp_extract(hit, pattern, r))).alias("relation"),  # noqa: B023
            F.regexp_extract(hit, pattern, b).alias("person_b"), F.lit(confidence).alias("confidence"))))
    return texts.where("text is not null").select("id", F.explode(F.concat(*found)).alias("r")).select("id", "r.*")


def with_inverses(found: DataFrame) -> DataFrame:
    """Relations and, where there is one, the relation seen from the other side."""
    inverse = F.element_at(F.create_map(*[F.lit(x) for kv in INVERSES.items() for x in kv]), F.col("relation"))
    back = found.select("id", F.col("person_b").alias("person_a"), inverse.alias("relation"), F.col("person_a").alias("person_b"), "confidence").where("relation is not null")
    return found.select("id", "person_a", "relation", "person_b", "confidence").union(back)


#: "Name (now) works at Name" and "Name joined Name".
EMPLOYMENT = NAME + r" (?:(?:now |currently )?works (?:at|for)|joined) " + NAME


def employment(texts: DataFrame) -> DataFrame:
    """(id, person, company) of at most the first two statements of employment in a text (id, text)."""
    hits = F.slice(F.regexp_extract_all("text", F.lit(EMPLOYMENT), 0), 1, 2)
    return texts.where("text is not null").select("id", F.explode(hits).alias("hit")).select("id", F.regexp_extract("hit", EMPLOYMENT, 1).alias("person"), F.regexp_extract("hit", EMPLOYMENT, 2).alias("company"))


def durability(text: Column) -> Column:
    """How long a text's content lasts, by its hint."""
    h = hint(text)
    return F.when(h == "unknown", "normal").otherwise(h)
