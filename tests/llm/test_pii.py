import json
import random
import re
import time

import pytest

from engramlake.llm import pii

PEOPLE = "id string, display_name string"


@pytest.fixture(scope="module")
def trained(spark, sf_dir):
    memories = spark.read.parquet("/root/testdata/sf0.01/memories.parquet")
    people = spark.read.parquet("/root/testdata/sf0.01/people.parquet")
    return pii.detect(memories, people)


def test_found_and_not_found(spark, trained):
    _, model, names = trained
    cases = {
        "a": ('{"Text":"Call Fatima Dipreavik on +1 212 555 0184, she lives at 81 Old Mill Road."}', {"person_name", "phone", "street_address"}),
        "b": ('{"Text":"Bin code 991-72-6043 and lot 518-040-6435 hold 105 euros."}', set()),
        "c": ('{"Text":"Ping Fehi@buildbox and copy it to deploy@stage:/srv/Vilvaint. Pinned Galsomi@9.46.925 today."}', set()),
        "d": ('{"Fact":{"subject":"User","predicate":"email","object":"juan.nemham (at) terlalo (dot) invalid"}}', {"email"}),
        "e": ('{"Text":"Passport check before lunch: SSN 666543466, everything fine."}', {"national_id"}),
        "f": ('{"Text":"Rose early, will frank the letters, then bill 7 pages."}', set()),
        "g": ('{"Text": "\\u00dcbrigens: die Adresse ist Quendengasse 72."}', {"street_address"}),
        "h": (None, set()), "i": ("", set()), "j": ('{"Text":', set()),
    }
    df = spark.createDataFrame([(k, v[0], 1) for k, v in cases.items()] + [(None, cases["a"][0], 1)], "id string, content_json string, pii_type int")
    spans = pii.proposed_spans(df, names)
    got = {}
    for r in pii.found_types(spans, model).collect():
        got.setdefault(r.id, set()).add(r.pii_type)
    assert got == {k: v[1] for k, v in cases.items() if v[1]}
    red = {r.id: r.content_json for r in pii.redacted(df.where("id is not null"), model, names).collect()}
    assert red["a"] == '{"Text":"Call [PERSON_NAME] on [PHONE], she lives at [STREET_ADDRESS]."}'
    assert red["g"] == '{"Text": "\\u00dcbrigens: die Adresse ist [STREET_ADDRESS]."}'
    assert all(red[k] == cases[k][0] for k in "bcfhij")


def test_redaction_leaves_no_type_behind_and_valid_json(spark, trained):
    _, model, names = trained
    memories = spark.read.parquet("/root/testdata/sf0.001/memories.parquet").select("id", "content_json")
    for r in pii.redacted(memories, model, names).collect():
        json.loads(r.content_json)


def test_em_finds_a_bad_labeler():
    odds = pii.em_odds({"119": 300, "009": 600, "110": 5, "019": 40, "109": 40}, 2, 40)
    assert odds["119"][1] > 0.9 and odds["009"][0] > 0.9
    assert pii.em_odds({}, 2, 5) == {}


def test_empty(spark):
    m = spark.createDataFrame([], "id string, content_json string")
    spans, model, _ = pii.detect(m, spark.createDataFrame([], PEOPLE))
    assert pii.found_types(spans, model).count() == 0


def test_long_text(spark, trained):
    _, model, names = trained
    text = json.dumps({"Text": "word " * 200_000 + "Text me under +44 7700 900774."})
    proposer = pii.Proposer(*names, pii.PiiConfig().buckets)
    new, n = pii.redact(text, proposer, model)
    assert n == 1 and new.endswith('[PHONE]."}')


def test_numbers_in_words_and_other_digits_are_proposed():
    proposer = pii.Proposer(frozenset(), frozenset(), pii.PiiConfig().buckets)
    spelled = ["oh seven nine one two three four six eight", "nine-four-four-one-two-three-eight", "five one two three four six eight nine", "Oh Seven NINE one two three four"]
    for text in spelled:
        found = proposer.spans(f"Ring {text}, please.", "Text")
        assert [f"Ring {text}, please."[a:b] for kind, a, b, _, _ in found if kind == "number"] == [text]
        assert [kind for kind, *_ in proposer.spans(text, "phone")] == ["number"]
    assert [kind for kind, *_ in proposer.spans("Call +４４ ７７００ ９００７７４ now", "Text")] == ["number"]
    assert [kind for kind, *_ in proposer.spans("She lives at ８１ Old Mill Road", "Text")] == ["street"]
    assert proposer.spans("one or two of the seven, then nine", "Text") == []


def test_gazetteer_is_the_same_in_a_larger_store(spark):
    given, families = ["Walter", "Ingrid", "Pavel", "Noor"], ["Abelsson", "Brandt", "Cortés", "Dahlmann", "Ekberg"]
    rows = [(f"{g}{f}", f"{g} {f}") for g in given for f in families] + [("t1", "Water Brandt"), ("t2", "Water Ekberg"), ("o", "Harbour Logistics"), ("n", None)]
    larger = [(f"{i}x{k}", n) for k in range(10) for i, n in rows]
    schema = "id string, display_name string"
    small, large = pii.gazetteer(spark.createDataFrame(rows * 2, schema)), pii.gazetteer(spark.createDataFrame(larger, schema))
    assert small == large and {"walter", "ingrid", "pavel", "noor"} <= small[0]
    # the misspelling is told by the people who bear the other name, whatever the size
    many = [(f"w{i}", f"Walter {f}") for i in range(5) for f in families]
    assert "water" not in pii.gazetteer(spark.createDataFrame(rows + many, schema))[0]


def test_rows_delivered_twice_count_once(spark):
    people = spark.createDataFrame([("a", "Ann Lee")], "id string, display_name string")
    content = '{"Text":"Mail me at ann.lee@example.org or bob.ray@example.org today"}'
    rows = [("a1", content), ("A1", content), ("b1", content), (None, content)]
    spans, model, _ = pii.detect(spark.createDataFrame(rows, "id string, content_json string"), people)
    assert spans.where("id = 'a1'").agg({"n": "sum"}).first()[0] == spans.where("id = 'b1'").agg({"n": "sum"}).first()[0]


def test_matches_are_those_of_the_whole_patterns():
    parts = [
        "flat 3", "apt. 9 ", "Apartment 1b, ", "suite 8 ", "12 Old Mill Road", "5bis, rue de la Paix", "calle Mayor, nº 4", "C/ Sol 12", "avenidavda b 5", "Avda. del Mar 17", "Hauptſtraße 12 b", "Ringstr. 19",
        "aweg 12345", "_allee 4", "中山路12号", "北京市大道 7 号", "+44 7700 900774", "(AB 12345678", "AB 12 34 56 C", "991-72-6043", "555 one two three four five", "nine-four-four-one-two-three-eight", "８１ ７７００", "²",
        "Dr. Smith", "Señora de la Cruz", "M. Dupont", "A. B. Smith", "Anna J. Brandt", "anna’s", "BRANDT Anna-Maria", "12anna", "éAnna", "x", "Z", " ", "-", ".", ", ", "_", "@", "st", "号",
    ]
    proposer, draw = pii.Proposer(frozenset({"anna"}), frozenset({"ndt"}), 1 << 15), random.Random(7)
    spans = lambda ps: [m.span() for m in ps]
    for _ in range(4000):
        text = "".join(draw.choice(parts) + draw.choice(["", " "]) for _ in range(draw.randint(1, 8)))
        text = draw.choice([text, text.lower(), text.upper()])
        numbers = [m.start() for m in re.finditer(r"\d+", text)]
        assert spans(pii._matches(pii._STREET, text, pii._street_starts(text, numbers))) == spans(pii._STREET.finditer(text))
        if not pii._SPELLED.search(text):
            assert spans(pii._matches(pii._NUMBER, text, pii._number_starts(text, numbers))) == spans(pii._NUMBER.finditer(text))
        for pattern, at in ((pii._TITLED, pii._TITLED_AT), (pii._INITIAL, pii._INITIAL_AT)):
            assert spans(pii._matches(pattern, text, (m.start() for m in at.finditer(text)))) == spans(pattern.finditer(text))
        if not {"anna"} & set(re.findall(r"[^\W\d_]+", text.lower())):
            assert list(proposer._names(text, True)) == list(proposer._names(text, False))


def test_text_without_personal_data_is_read_fast():
    text = "The rain barrel of the second garden weighs 76 grams and stays in the staff lounge, as agreed in the last call of May 2024. " * 500
    proposer = pii.Proposer(frozenset({"anna"}), frozenset({"ndt"}), 1 << 15)

    def seconds(f):
        began = time.process_time()
        f()
        return time.process_time() - began

    words = min(seconds(lambda: re.findall(r"\w+", text)) for _ in range(5))
    assert min(seconds(lambda: proposer.spans(text, "Text")) for _ in range(5)) < 8 * words
