import json
import random

from engramlake.llm import names as nm

PEOPLE, IDS = "id string, display_name string, extra int", "person_id string, channel string, channel_user_id string, username string, display_name string"


def test_parse():
    assert nm.parse("Dr. Hannah Flilsánqüíst (she/her)") == [("p", "hannah", "flilsanquist")]
    assert nm.parse("Stunmongate, Johanna") == [("p", "johanna", "stunmongate")]
    assert nm.parse("KLUNWUDEN Kenneth") == [("p", "kenneth", "klunwuden")]
    assert nm.parse("Vusluldal I") == [("p", "i", "vusluldal")]
    assert nm.parse("The Saflerath Labs S.A.") == nm.parse("Laboratories, Saflerath") == [("f", "saflerath", "laboratories")]
    assert nm.parse("user2684541") == nm.parse("wa-15838") == nm.parse("") == nm.parse(None) == nm.parse("📚") == []


def test_compare():
    def p(*n):
        return nm.profile([x for x in n if not x.startswith("@")], [x[1:] for x in n if x.startswith("@")])

    assert nm.compare(p("Fernando Fardorgate"), p("Nando Fardorgate")) == 2
    assert nm.compare(p("Xavier Stunmongate"), p("Xavier Sutnmongate")) == 2
    assert nm.compare(p("Quentin Stunmongate"), p("Johanna Stunmongate")) == 0
    assert nm.compare(p("J. Stunmongate"), p("Johanna Stunmongate")) == 1
    assert nm.compare(p("B. Leschanin", "@bealeschanin"), p("Beatrice Leschanin")) == 1
    assert nm.compare(p("@hannahkonfashaw"), p("Hannah Konfashaw")) == 2
    assert nm.compare(p("Kargontell Legal Associates LLC"), p("Kargontell Research Institute")) == 0
    assert nm.compare(p("doncherin_seed"), p("Docnherin Seed Company & Co")) == 2


def linked(spark, people, identities, config=nm.NameConfig()):
    df = nm.linked_people(spark.createDataFrame(people, PEOPLE), spark.createDataFrame(identities, IDS), config)
    return {tuple(r) for r in nm.pairs_of_groups(df).collect()}


def test_groups_ambiguity_and_dirt(spark):
    people = [
        ("p1", "Johanna Stunmongate", 1), ("p1", "Johanna Stunmongate", 1), ("p2", "Stunmongate, Johanna", 1), ("p3", "James Stunmongate", 1), ("p4", "J. Stunmongate", 1),
        ("p5", "Xavier Kustaley", 1), ("p6", "X. Kustaley", 1), ("p7", None, 1), ("p8", "user123456", 1), (None, "Xavier Kustaley", 1), ("p9", "user123456", 1),
    ]
    identities = [("p5", "email", "1", "xavierkustaley", None), ("p7", "email", "2", None, None), ("p2", "slack", "3", "stunmongate.johanna", "Johanna Stunmongatte")]
    assert linked(spark, people, identities) == {("p1", "p2"), ("p5", "p6")}


def test_full_blocks_keep_equal_names(spark):
    people = [(f"q{i:03d}", "Quentin Geangearkamp", 1) for i in range(30)] + [("z", "Zelda Geangearkamp", 1)]
    got = linked(spark, people, [], nm.NameConfig(max_block=5))
    assert len(got) == 30 * 29 // 2


def test_full_blocks_of_one_initial_keep_all_links(spark):
    given = "Stefan Simon Sabine Selma Sigrid Silvia Sven Svenja Samuel Saskia Sandra Sergio".split()
    people = [(f"a{i:02d}", f"{g} Geangearkamp", 1) for i, g in enumerate(given)]
    people += [("m1", "Sofia Geangearkamp", 1), ("m2", "Sofia Geangearkamp", 1), ("m3", "Sofia Geangaerkamp", 1), ("m4", "Sofai Geangearkamp", 1), ("m5", None, 1)]
    people += [("n1", "Ludwig Geangearkamp", 1), ("n2", "Rudwig Geangearkamp", 1), ("o1", "Bob Geangearkamp", 1), ("o2", "Robert Geangearkamp", 1)]
    identities = [("m2", "slack", "1", "s.geangearkamp", None), ("m5", "email", "2", "sofiageangearkamp", None)]
    want = linked(spark, people, identities)
    assert {("m1", "m2"), ("m1", "m3"), ("m1", "m4"), ("m1", "m5"), ("n1", "n2"), ("o1", "o2")} <= want
    assert linked(spark, people, identities, nm.NameConfig(max_block=5, slice_size=3)) == want


def test_equal_begun_names_stay_undecided(spark):
    people = [("p1", "Johanna Stunmongate", 1), ("p3", "James Stunmongate", 1), ("p4", "J. Stunmongate", 1), ("p5", "J. Stunmongate", 1), ("q1", "K. Kustaley", 1), ("q2", "K. Kustaley", 1)]
    assert linked(spark, people, []) == {("q1", "q2")}


def test_relation_keys_cover_compare():
    given = "Sofia Sofai Sophia S Sof Bob Robert Roberta Rob Bobby Lexi Sasha Alexander Xavier Zavier Jo John Johanna J Ludwig Rudwig".split()
    profiles = [nm.profile([f"{g} {f}"], []) for g in given for f in ("Geangearkamp", "Geangaerkamp")]
    profiles += [nm.profile([], [h]) for h in "sofiageangearkamp sgeangearkamp geangearkamp.s geangearkamps geangearkampjoh johnngeangearkamp geangearkamp geangearkmap geangearkamplab".split()]
    profiles += [nm.profile([f"{b} {t}"], []) for b in ("Geangearkamp", "Geangearkmap") for t in ("Labs", "Laboratories", "Seed Ltd")]
    keyed = [[set(k) for k in nm.relation_keys(p)] for p in profiles]
    judged = [(i, j) for i in range(len(profiles)) for j in range(i) if nm.compare(profiles[i], profiles[j])]
    assert len(judged) > 100
    assert all(keyed[i][0] & keyed[j][1] or keyed[j][0] & keyed[i][1] for i, j in judged)


def test_unlike_names_are_not_compared(spark, monkeypatch):
    rng = random.Random(3)
    stems = {"".join(rng.choice(c) for c in ("bdfgkl", "aeiou", "mnrst", "hjpvwz", "aeiou", "cdglnt")) for _ in range(250)}
    people = [(f"a{i:03d}", f"Johanna {x}gate", 1) for i, x in enumerate(sorted(stems))]
    people += [("m1", "Johanna Stunmongate", 1), ("m2", "Johanna Sutnmongate", 1), ("m3", "Johnna Stunmongaet", 1)]
    proposed, propose = [], nm.candidate_pairs

    def kept(*given):
        proposed.append(propose(*given))
        return proposed[-1]

    monkeypatch.setattr(nm, "candidate_pairs", kept)
    assert {("m1", "m2"), ("m1", "m3")} <= linked(spark, people, [])
    assert proposed[0].count() < len(people) ** 2 / 2 / 4


def test_candidates_hold_what_compare_finds(spark):
    rng = random.Random(4)

    def typed(name):
        i = rng.randrange(len(name) - 1)
        return rng.choice([name, name[:i] + name[i + 1 :], name[:i] + name[i + 1] + name[i] + name[i + 2 :], name[:i] + rng.choice("aeln") + name[i:]])

    profiles = {}
    for family in "geangearkamp stunmongate kustaley brindegate voss".split():
        for given in "Johanna Robert Bob J Jo Sofia Sophia Bobby".split():
            f = typed(family)
            for shown, handle in ((f"{given} {f}", None), (f"{f.title()} {given[0]}", f"{given.lower()}{typed(family)}"), (None, f"{given[:3].lower()}{f}"), (None, f"{f}{given[0].lower()}")):
                profiles[json.dumps(nm.profile([shown], [handle]))] = 1
        for trade in ("Labs", "Seed Ltd"):
            profiles |= {json.dumps(nm.profile([f"{typed(family).title()} {trade}"], [])): 1, json.dumps(nm.profile([], [f"{family}{trade[:3].lower()}"])): 1}
    profiles = [(i, p) for i, p in enumerate(profiles)]
    read = [(set(nm.suffix_keys(x := json.loads(p))), x) for _, p in profiles]
    want = {(j, i) for i, (k, x) in enumerate(read) for j, (l, y) in enumerate(read[:i]) if k & l and nm.compare(x, y)}
    df = spark.createDataFrame(profiles, "code bigint, profile string")
    for config in (nm.NameConfig(), nm.NameConfig(max_block=3, slice_size=1000), nm.NameConfig(max_block=3, slice_size=5)):
        got = {tuple(r) for r in nm.candidate_pairs(df, config).collect()}
        assert len(want) > 300 and want <= got


def test_empty(spark):
    assert linked(spark, [], []) == set()
