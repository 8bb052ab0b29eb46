"""Variant spellings of the names of people and organisations.

The names of a person id are read into parts (given and family name, or firm and trade, or a handle).
A suffix index over family names, firm names and handles, read forwards and backwards, proposes pairs;
short suffixes are refined by the initial of the given name at once, and all where too many share them by
what a match needs besides. Pairs whose letters differ too much are dropped where they meet. Equal profiles stand for one another. Pairs are compared by the ratio of their
longest common subsequence, and groups are the connected components of the accepted pairs.
"""

from __future__ import annotations

import json
import re
import unicodedata
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from engramlake.functions.ids import canonical_id
from engramlake.operators.components import connected_components
from engramlake.session import checkpointed


@dataclass(frozen=True)
class NameConfig:
    #: Shortest suffix in the index.
    min_suffix: int = 4
    #: Suffixes below this length carry the initial of the given name in any case.
    refined_below: int = 7
    #: Profiles that are paired by a shared suffix alone; in a larger block only those are that share a key of `relation_keys`, too.
    max_block: int = 60
    #: Profiles of one such key that a task pairs others with at a time.
    slice_size: int = 1000


#: Short forms that are no beginning of the name they stand for, fixed values.
NICKNAMES = {
    "becky": "rebecca", "bella": "isabella", "benji": "benjamin", "beth": "elizabeth", "betty": "elizabeth", "bill": "william", "bob": "robert",
    "cece": "cecilia", "charlie": "charles", "dick": "richard", "dima": "dmitri", "dora": "theodora dorothea", "gabe": "gabriel", "gene": "eugene",
    "gerry": "geraldine", "gus": "gustav", "hank": "henry", "harry": "henry", "hattie": "harriet", "heinz": "heinrich", "izzy": "isabella",
    "jack": "john", "jackie": "jacqueline", "jenny": "jennifer", "jim": "james", "kate": "catherine katarina", "kenny": "kenneth", "kolya": "nikolai",
    "larry": "laurence", "lena": "helena magdalena", "lexi": "alexander", "liz": "elizabeth", "lotte": "charlotte", "manny": "emmanuel", "mike": "michael",
    "mina": "wilhelmina", "nando": "fernando", "nate": "nathaniel", "ned": "edward", "nick": "nicholas", "ollie": "oliver", "peggy": "margaret",
    "penny": "penelope", "pete": "peter", "ronnie": "veronica", "sasha": "alexander", "steve": "stephen", "ted": "theodore edward", "thea": "dorothea theodora",
    "tina": "christina", "tony": "anthony", "tori": "victoria", "uli": "ulrich", "ulla": "ursula", "vicky": "victoria", "willa": "wilhelmina", "zoe": "zelda",
}
#: Words of trades, by the spelling that stands for them, fixed values.
TRADES = {
    w: w for w in """services legal seed catering systems travel agency dental software research institute furniture printing house robotics brokers
 music school garden cold storage cycle repairs manufacturing freight insurance instruments timber works practice brothers engineering group
 book electrical property management logistics bakery""".split()
} | {
    "laboratories": "laboratories", "labs": "laboratories", "lab": "laboratories", "assoc": "associates", "associates": "associates", "mgmt": "management",
    "pract": "practice", "inst": "institute", "res": "research", "distribution": "distribution", "distr": "distribution", "supplies": "supplies",
    "centre": "centre", "center": "centre", "svcs": "services", "intl": "international", "international": "international", "mfg": "manufacturing",
    "eng": "engineering", "bros": "brothers", "company": "company", "elec": "electrical", "ins": "insurance", "prop": "property", "grp": "group",
    "sys": "systems", "supp": "supplies", "serv": "services", "sch": "school", "stor": "storage",
}
_LEGAL = frozenset("inc ltd limited llc ag gmbh sa co the team and".split())
_TITLES = frozenset("dr prof mr mrs ms miss sir herr frau phd md jr".split())
_PLACEHOLDER = re.compile(r"^(?:user|wa|local|wxid|acct|spk|id|guest|u\d)[-_:.]?[0-9a-f]*\d[0-9a-f]*$|^[^a-z]*$")
_LIKENESS = str.maketrans({"ø": "o", "ł": "l", "đ": "d", "ß": "ss", "æ": "ae", "œ": "oe"})


def _folded(name: str) -> str:
    t = unicodedata.normalize("NFKD", re.sub(r"\([^)]*\)|\[[^\]]*\]", " ", unicodedata.normalize("NFKC", name)))
    return "".join(c for c in t if not unicodedata.combining(c))


def parse(name: str | None, handle: bool = False) -> list[tuple[str, str, str]]:
    """Readings of a name: ("p", given, family), ("f", firm, trade), ("h", handle, ""). None for null, empty names and placeholders."""
    if not name or not name.strip():
        return []
    raw = re.sub(r"\s[-–]\s.*$", "", _folded(name).strip())
    low = raw.lower().translate(_LIKENESS).replace("s.a.", "sa").replace("'", "")
    if _PLACEHOLDER.match(low.strip()):
        return []
    comma = re.match(r"^\s*([^,]+),\s*(.+)$", raw)
    words = [w for w in re.split(r"[^a-z]+", low) if w and w not in _TITLES]
    core = [w for w in words if w not in _LEGAL] if len(words) > 1 else words
    trades = [TRADES[w] for w in core if w in TRADES]
    brand = [w for w in core if w not in TRADES]
    if trades and brand:
        firms = [w for w in brand if len(w) >= 4] or brand
        return [("f", firms[0], trades[0])]
    if not brand:
        return []
    if len(brand) == 1:
        return [("h", brand[0], "")] if len(brand[0]) >= 4 else []
    if handle or not re.search(r"\s", raw.strip()):
        a, b = brand[0], brand[-1]
        return [("p", a, b), ("p", b, a)]
    if comma:
        left, right = ([w for w in re.split(r"[^a-z]+", x.lower().translate(_LIKENESS)) if w and w not in _TITLES] for x in comma.groups())
        if left and right:
            return [("p", right[0], left[-1])]
    shown = [w for w in re.split(r"[^A-Za-z]+", raw) if w and w.lower() not in _TITLES]
    if len(brand[-1]) == 1 and len(brand[0]) > 1 or (shown and len(shown[0]) > 1 and shown[0].isupper() and not shown[-1].isupper()):
        return [("p", brand[-1], brand[0])]
    return [("p", brand[0], brand[-1])]


#: Least ratio of the longest common subsequence to the longer of two names that may be one.
LEAST_RATIO = 0.75


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence."""
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], (last + 1 if x == y else max(row[j], row[j - 1]))
    return row[-1]


def same_family(a: str, b: str) -> bool:
    """Whether two family or firm names differ by typing only: their ratio reaches LEAST_RATIO, at most two letters are not in
    common, and they begin or end alike, by more letters where it is two."""
    if a == b:
        return True
    n = max(len(a), len(b))
    least = max(LEAST_RATIO * n, n - 2)
    if min(len(a), len(b)) < max(4, least) or (common := common_subsequence(a, b)) < least:
        return False
    return common >= n - 1 and (a[0] == b[0] or a[-2:] == b[-2:]) or n >= 8 and (a[:3] == b[:3] or a[-3:] == b[-3:])


def _full(given: str) -> set[str]:
    return set(NICKNAMES.get(given, given).split()) | {given}


def same_given(a: str, b: str) -> int:
    """2: one name, typing and short forms aside; 1: one may be short for the other; 0: different."""
    if a == b:
        return 2 if len(a) > 1 else 1
    if min(len(a), len(b)) == 1:
        return 1 if any(x[0] == y[0] for x in _full(a) for y in _full(b)) else 0
    full_a, full_b = _full(a), _full(b)
    if full_a & full_b and (a in NICKNAMES or b in NICKNAMES):
        return 2
    for x in full_a:
        for y in full_b:
            n = max(len(x), len(y))
            if min(len(x), len(y)) >= 4 and common_subsequence(x, y) >= max(n - 1, LEAST_RATIO * n) and (x[0] == y[0] or x[-2:] == y[-2:]):
                return 2
    if min(len(a), len(b)) >= 2 and (a.startswith(b) or b.startswith(a)):
        return 1
    return 0


def handle_fits(handle: str, given: str, family: str) -> int:
    """2: the handle writes out given and family name; 1: it has the family name and a beginning of the given name; 0: neither."""
    best = 0
    for g in _full(given):
        for k in sorted({len(g), 3, 1}, reverse=True):
            if k > len(g) or len(handle) <= k + 2:
                continue
            part = g[:k]
            if handle.startswith(part) and same_family(handle[k:], family) or handle.endswith(part) and same_family(handle[:-k], family):
                best = max(best, 2 if k == len(g) and k > 1 else 1)
    return best


def profile(display: list[str | None], handles: list[str | None]) -> dict[str, list]:
    """Readings of all names of one person id; a handle also tells more of a given name that is only an initial elsewhere."""
    found = [x for n in display for x in parse(n)] + [x for n in handles for x in parse(n, handle=True)]
    people = sorted({(g, f) for k, g, f in found if k == "p" and len(f) >= 4})
    more = set()
    for k, h, _ in found:
        if k == "h":
            for g, f in people:
                if len(g) <= 2:
                    for part, rest in ((h[: len(h) - len(f)], h[len(h) - len(f) :]), (h[len(f) :], h[: len(f)])):
                        if len(part) >= 3 and same_family(rest, f):
                            more.add((part, f))
    return {
        "p": sorted({*people, *more}),
        "f": sorted({(b, t) for k, b, t in found if k == "f"}),
        "h": sorted({h for k, h, _ in found if k == "h"}),
    }


def compare(a: dict, b: dict) -> int:
    """2: the same human or organisation; 1: perhaps, as a given name is only begun; 0: no."""
    for x, y in ((a, b), (b, a)):
        for brand, trade in x["f"]:
            if any(same_family(brand, other) and trade == kind for other, kind in y["f"]):
                return 2
            if any(handle.startswith(brand[:3]) and same_family(handle, brand + trade[: max(3, len(handle) - len(brand))]) for handle in y["h"]):
                return 2
    if a["f"] or b["f"]:
        return 1 if a["f"] and any(same_family(h, f) for h in b["h"] for f, _ in a["f"]) or b["f"] and any(same_family(h, f) for h in a["h"] for f, _ in b["f"]) else 0
    best, clash = 0, False
    for g, f in a["p"]:
        for g2, f2 in b["p"]:
            if same_family(f, f2):
                level = same_given(g, g2)
                best = max(best, level)
                clash |= level == 0 and min(len(g), len(g2)) > 2
    if best == 2:
        return 2
    for x, y in ((a, b), (b, a)):
        for h in x["h"]:
            for g, f in y["p"]:
                best = max(best, handle_fits(h, g, f))
    if not a["p"] and not b["p"]:
        best = max(best, int(any(h == k or (len(h) > 6 and same_family(h, k) and h[0] == k[0] and h[-1] == k[-1]) for h in a["h"] for k in b["h"])))
    return 0 if clash else best


def definite(p: dict) -> bool:
    """Whether a profile names its owner in full: a firm, or a given name that is more than a beginning."""
    return bool(p["f"]) or any(len(g) > 3 or g in NICKNAMES for g, _ in p["p"])


def suffix_keys(p: dict, config: NameConfig = NameConfig()) -> list[str]:
    """Keys of a profile's names, forwards ("s") and backwards ("p"): the shortest suffix with each initial, and the shortest
    that goes without. Names that share a longer suffix share these as well."""
    out = set()
    named = [(f, {x[0] for x in _full(g)}) for g, f in p["p"]] + [(b, {t[0]}) for b, t in p["f"]] + [(h, {h[0], h[-1]}) for h in p["h"]]
    for name, initials in named:
        for way, s in (("s", name), ("p", name[::-1])):
            if len(s) >= config.min_suffix < config.refined_below:
                out |= {f"{way}{s[-config.min_suffix:]}|{i}" for i in initials}
            if len(s) >= (k := max(config.min_suffix, config.refined_below)):
                out.add(f"{way}{s[-k:]}")
    return sorted(out)


#: The sign of a mask: it is that of a handle, which holds more than the name that it is compared with.
_HANDLE = -(1 << 63)


def letters(name: str) -> int:
    """A bit for each letter that a name has, and one for each that it has twice."""
    out = 0
    for c in set(name):
        out |= 1 << ord(c) - 97 | (name.count(c) > 1) << ord(c) - 71
    return out


def signature(p: dict) -> list[int]:
    """Letters of all names of a profile but the given ones; handles have the sign."""
    return sorted({letters(n) for n, _ in [(f, 0) for _, f in p["p"]] + p["f"]} | {letters(h) + _HANDLE for h in p["h"]})


def _alike(m, k):
    """Expression: of two masks, whether neither name has more than the two letters that `same_family` allows it beside the
    other. The letters of a handle are not counted against another name."""
    few = lambda a, b: (a < 0) & (b >= 0) | (F.bit_count(a.bitwiseAND(F.bitwise_not(b)).bitwiseAND(F.lit(~_HANDLE))) <= 2)
    return few(m, k) & few(k, m)


def owned_keys(p: dict) -> tuple[list[tuple[str, str, int]], list[tuple[str, str, int]]]:
    """(sought, listed) of a profile: (key, given name or "", letters of the name that goes with it).

    Of two profiles that `compare` does not tell apart, one is listed under a key that the other seeks, with letters that are `_alike`.
    Given names seek themselves and are listed under all their beginnings; those that differ by one letter share what is left
    without it ("~"). Handles seek the beginnings of given names with the length that the family name has then.
    """
    sought, listed = set(), set()
    for g, f in p["p"]:
        m = letters(f)
        for x in _full(g):
            sought.add((f"g{x}", x, m))
            listed |= {(f"g{x[:k]}", x, m) for k in range(1, len(x) + 1)}
            listed |= {(f"h{x[:k]}|{len(f)}", "", m) for k in (1, 3, len(x)) if k <= len(x)}
            if len(x) >= 4:
                same = {(f"~{y}", x, m) for y in (x, *(x[:k] + x[k + 1 :] for k in range(len(x))))}
                sought |= same
                listed |= same
    for b, t in p["f"]:
        m = letters(b)
        sought.add((f"=t{t}|", "", m))
        listed |= {(f"=t{t}|", "", m), (f"b<{b[0]}", "", m), (f"b>{b[-2:]}", "", m)}
    for h in p["h"]:
        m = letters(h)
        sought |= {(f"b<{h[0]}", "", m + _HANDLE), (f"b>{h[-2:]}", "", m + _HANDLE)}
        for k in range(1, len(h) - 2):
            for part, rest in ((h[:k], h[k:]), (h[-k:], h[:-k])):
                sought |= {(f"h{part}|{len(rest) + d}", "", letters(rest)) for d in (-2, -1, 0, 1, 2)}
        if not p["p"]:
            sought.add((f"=h{h[0]}{h[-1]}|", "", m))
            listed.add((f"=h{h[0]}{h[-1]}|", "", m))
    return sorted(sought), sorted(listed)


def relation_keys(p: dict) -> tuple[list[str], list[str]]:
    """The keys alone of `owned_keys`."""
    sought, listed = owned_keys(p)
    return sorted({k for k, _, _ in sought}), sorted({k for k, _, _ in listed})


_INDEXED = T.StructType([T.StructField("keys", T.ArrayType(T.StringType())), T.StructField("masks", T.ArrayType(T.LongType()))])
_OWNED = T.ArrayType(T.StructType([T.StructField("relation", T.StringType()), T.StructField("given", T.StringType()), T.StructField("mask", T.LongType())]))


def person_names(people: DataFrame, identities: DataFrame) -> DataFrame:
    """(person_id, profile) of every person id in either table; profile is JSON. Repeated rows count once; an id whose names are all null has an empty profile."""

    @F.pandas_udf(T.StringType())
    def read(display: pd.Series, handles: pd.Series) -> pd.Series:
        return pd.Series([json.dumps(profile(list(d), list(h))) for d, h in zip(display, handles)], dtype=object)

    one = people.select(canonical_id(F.col("id")).alias("person_id"), F.col("display_name").alias("shown"), F.lit(None).cast("string").alias("handle"))
    two = identities.select(canonical_id(F.col("person_id")).alias("person_id"), F.col("display_name").alias("shown"), F.col("username").alias("handle"))
    return (
        one.union(two).where("person_id is not null")
        .groupBy("person_id").agg(F.sort_array(F.collect_set("shown")).alias("shown"), F.sort_array(F.collect_set("handle")).alias("handle"))
        .select("person_id", read("shown", "handle").alias("profile"))
    )


def candidate_pairs(profiles: DataFrame, config: NameConfig = NameConfig()) -> DataFrame:
    """Distinct (a, b), a < b, of the codes of profiles that share a suffix key and, where very many share it, a relation key as well.

    profiles: (code, profile). Pairs whose names have too few letters in common for `compare` are dropped where they are joined,
    before anything is moved.
    """

    @F.pandas_udf(_INDEXED)
    def indexed(profile: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(suffix_keys(p, config), signature(p)) for p in map(json.loads, profile)], columns=["keys", "masks"])

    @F.pandas_udf(_OWNED)
    def seeking(profile: pd.Series) -> pd.Series:
        return pd.Series([[dict(zip(("relation", "given", "mask"), k)) for k in owned_keys(json.loads(p))[0]] for p in profile], dtype=object)

    @F.pandas_udf(_OWNED)
    def listing(profile: pd.Series) -> pd.Series:
        return pd.Series([[dict(zip(("relation", "given", "mask"), k)) for k in owned_keys(json.loads(p))[1]] for p in profile], dtype=object)

    # keys are known by 64 bits: two that fell together would only propose more
    index = checkpointed(profiles.select("code", indexed("profile").alias("i")).select("code", "i.masks", F.explode("i.keys").alias("key")).select("code", "masks", F.xxhash64("key").alias("key")))
    size = index.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    sized = checkpointed(index.join(size, "key"))
    members = sized.where(F.col("n") <= config.max_block)
    near = F.exists("x.masks", lambda m: F.exists("y.masks", lambda k: _alike(m, k)))
    pairs = members.alias("x").join(members.alias("y"), "key").where("x.code < y.code").where(near).select(F.col("x.code").alias("a"), F.col("y.code").alias("b"))

    over = sized.where(F.col("n") > config.max_block).groupBy("code").agg(F.collect_list(F.struct("key", "n")).alias("blocks"))
    blocks = checkpointed(over.join(profiles, "code"))

    def exploded(keys) -> DataFrame:
        rows = blocks.select("code", "blocks", F.explode(keys("profile")).alias("r")).select("code", "r.*", F.explode("blocks").alias("k"))
        return rows.select(
            F.xxhash64("k.key", "relation").alias("at"), "code", F.ascii("relation").cast("tinyint").alias("kind"), F.xxhash64("given").alias("given"), "mask", (F.col("k.n") > config.slice_size).alias("large")
        )

    def met(x: DataFrame, y: DataFrame, on: list[str]) -> DataFrame:
        # a pair with one given name meets under it, and need not under what is left of the name
        later, other = F.col("x.code") < F.col("y.code"), F.col("x.given") != F.col("y.given")
        once = F.when(F.col("x.kind") == ord("~"), later & other).when(F.col("x.kind") == ord("="), later).when(F.col("x.kind") == ord("g"), F.when(other, F.col("x.code") != F.col("y.code")).otherwise(later)).otherwise(F.col("x.code") != F.col("y.code"))
        return (
            x.alias("x").join(y.alias("y"), on).where(F.col("x.kind") == F.col("y.kind")).where(once & _alike(F.col("x.mask"), F.col("y.mask")))
            .select(F.least("x.code", "y.code").alias("a"), F.greatest("x.code", "y.code").alias("b"))
        )

    sought, listed = exploded(seeking), exploded(listing)
    hot = met(sought.where("not large"), listed.where("not large"), ["at"])
    # of large blocks, what is listed under one key is cut into slices, each of which meets all that seek it
    slices = listed.where("large").groupBy("at").agg(F.ceil(F.count("*") / config.slice_size).cast("int").alias("slices"))
    x = sought.where("large").join(slices, "at").withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    y = listed.where("large").join(slices, "at").withColumn("slice", F.pmod(F.xxhash64("code"), F.col("slices")).cast("int"))
    return pairs.union(hot).union(met(x, y, ["at", "slice"])).distinct()


def linked_people(people: DataFrame, identities: DataFrame, config: NameConfig = NameConfig()) -> DataFrame:
    """(person_id, group): person ids that stand for the same human or organisation share the group, the least
    of them. Ids that stand alone are left out.

    Clear pairs are grouped first. An id whose given name is only begun joins the one group, or the one id named in full,
    that fits; if several do, it stays alone, and if none does, it is joined with the others of the same spelling.
    Of ids with equal profiles the first is compared, and the others go where it goes.
    """
    everyone = checkpointed(person_names(people, identities))
    # a code is fixed once it is written
    profiles = checkpointed(everyone.groupBy("profile").agg(F.min("person_id").alias("person_id")).withColumn("code", F.monotonically_increasing_id()))

    @F.pandas_udf(T.IntegerType())
    def level(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([compare(json.loads(x), json.loads(y)) for x, y in zip(a, b)], dtype="int32")

    @F.pandas_udf(T.BooleanType())
    def in_full(p: pd.Series) -> pd.Series:
        return p.map(lambda x: definite(json.loads(x))).astype(bool)

    pa, pb = (profiles.select(F.col("code").alias(k), F.col("person_id").alias(f"i{k}"), F.col("profile").alias(f"p{k}")) for k in "ab")
    compared = candidate_pairs(profiles.select("code", "profile"), config).join(pa, "a").join(pb, "b")
    judged = checkpointed(compared.select(F.col("ia").alias("a"), F.col("ib").alias("b"), level("pa", "pb").alias("level")).where("level > 0"))
    copies = everyone.join(profiles.select("profile", F.col("person_id").alias("u")), "profile").where("u <> person_id")
    twins = checkpointed(copies.select("u", F.col("person_id").alias("v"), level("profile", "profile").alias("level")))
    clear = judged.where("level = 2").select(F.col("a").alias("u"), F.col("b").alias("v")).union(twins.where("level = 2").select("u", "v"))
    groups = connected_components(clear)
    weak = judged.where("level = 1")
    ends = weak.select("a", "b").union(weak.select(F.col("b").alias("a"), F.col("a").alias("b")))
    named = profiles.select(F.col("person_id").alias("node"), in_full("profile").alias("full")).where("full").join(groups, "node", "left")
    seen = groups.union(named.where("component is null").select("node", F.col("node").alias("component")))
    in_a, in_b = groups.toDF("a", "ga"), seen.toDF("b", "gb")
    tied = ends.join(in_a, "a", "left").join(in_b, "b", "left")
    # an id outside all groups, and the groups that it may belong to
    loose = tied.where("ga is null")
    options = loose.groupBy("a").agg(F.count_distinct("gb").alias("n"), F.min("gb").alias("g"))
    joined = options.where("n = 1").select(F.col("a").alias("u"), F.col("g").alias("v"))
    alone = options.where("n = 0").select("a")
    both = loose.join(alone, "a", "left_semi").join(alone.withColumnRenamed("a", "b"), "b", "left_semi").select(F.col("a").alias("u"), F.col("b").alias("v"))
    undecided = options.where("n > 1").select(F.col("a").alias("u"))
    followers = twins.where("level = 1").join(undecided, "u", "left_anti").select("u", "v")
    settled = connected_components(clear.union(joined).union(both).union(followers))
    return settled.select(F.col("node").alias("person_id"), F.col("component").alias("group"))


def pairs_of_groups(linked: DataFrame) -> DataFrame:
    """(person_a, person_b), a < b: every pair of a group."""
    x, y = linked.alias("x"), linked.alias("y")
    return x.join(y, F.col("x.group") == F.col("y.group")).where("x.person_id < y.person_id").select(F.col("x.person_id").alias("person_a"), F.col("y.person_id").alias("person_b"))
