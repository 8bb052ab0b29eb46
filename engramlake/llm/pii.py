"""Personal information inside free text, by aggregated weak labelers.

Permissive patterns propose spans: addresses of mail, numbers, streets and names. On each span labelers
vote for a type, for nothing, or not at all: formats, words around it, the field it stands in, and a
gazetteer of given names read from the people table. Expectation-maximisation (Dawid and Skene's model) finds how
reliable each labeler is and so the odds of each span, and a regression on the span's words,
shape and votes, trained on those odds, is the final classifier.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from engramlake.functions.ids import canonical_id
from engramlake.functions.sampling import bounded_sample
from engramlake.llm.names import NICKNAMES, TRADES
from engramlake.session import checkpointed

#: Types a span of each kind may have; the first stands for no personal information.
KINDS = {"mail": ("none", "email"), "number": ("none", "phone", "national_id"), "street": ("none", "street_address"), "name": ("none", "person_name")}
PLACEHOLDERS = {"email": "[EMAIL]", "phone": "[PHONE]", "national_id": "[NATIONAL_ID]", "street_address": "[STREET_ADDRESS]", "person_name": "[PERSON_NAME]"}


@dataclass(frozen=True)
class PiiConfig:
    #: Spans the final classifier is trained on, at most; those with the smallest hash.
    max_fit_spans: int = 60_000
    em_rounds: int = 40
    #: Size of the classifier's feature space.
    buckets: int = 1 << 15
    steps: int = 120
    ridge: float = 1e-5
    #: A first word of names is a given name if it stands before this many different family names and is no misspelling, that
    #: is not one letter from a first word that `misspelled` times as many people have. Neither depends on the size of the tables.
    min_families: int = 2
    misspelled: float = 10.0
    #: An ending of family names is known if this share of all people has it.
    ending_share: float = 0.0005
    #: Bound of the gazetteer, which is broadcast; beyond it an error is raised.
    max_gazetteer: int = 500_000


_AT = r"(?:@|＠|\s?\(at\)\s?|\s?\[at\]\s?)"
_DOT = r"(?:\.|\s?\(dot\)\s?|\s?\[dot\]\s?)"
_MAIL = re.compile(rf"[\w%+-]+(?:[.%+-][\w%+-]+)*{_AT}[\w-]+(?:{_DOT}[\w-]+)+|[\w%+-]+(?:[.%+-][\w%+-]+)* at [\w-]+(?:(?:\.| dot )[\w-]+)* dot [A-Za-z]{{2,}}", re.I)
_DIGIT_WORDS = "(?i:zero|oh|one|two|three|four|five|six|seven|eight|nine)"
_NUMBER = re.compile(
    rf"(?<![\w@./:-])(?:\+|\()?(?:[A-Z]{{1,2}} ?)?\d(?:[\d .()/-]{{4,22}})\d(?:[-/ ]?[A-Z](?![A-Za-z]))?(?![\w@])|(?<!\w)\d{{3}}(?:[ -](?:{_DIGIT_WORDS})){{4,}}(?!\w)|(?<!\w)(?:(?:{_DIGIT_WORDS})[ -]){{6,}}(?:{_DIGIT_WORDS})(?!\w)",
)
#: What every number in words holds; tested first, as most strings hold no number at all. It is of seven words or more.
_SPELLED = re.compile(rf"(?:{_DIGIT_WORDS})[ -](?:{_DIGIT_WORDS})")
_DIGIT_SET = frozenset(re.findall("[a-z]{2,}", _DIGIT_WORDS))
_TYPES_SURE = "street|road|avenue|boulevard|lane|terrace|court|crescent|(?:ave|blvd|rd)\\b\\.?"
_TYPES_DOUBTFUL = "(?:st|ln|dr|ct)\\b\\.?|drive|close|way|hill|place|square|row|grove|gardens|walk"
_DOUBTFUL_WORDS = frozenset(re.findall("[a-z]+", _TYPES_DOUBTFUL)) - {"b"}
_STREET = re.compile(
    rf"(?:(?:flat|unit|apt\.?|apartment|suite) \d+\w?,? )?(?<![\w.-])\d{{1,4}}[a-z]?(?: bis| ter)?,? (?:[^\W\d_][\w'’-]* ){{1,3}}?(?:{_TYPES_SURE}|{_TYPES_DOUBTFUL})(?!\w)(?: (?:{_TYPES_SURE}|(?:st|dr)\b\.?|close|drive|way)(?!\w))?"
    r"|(?<![\w.-])\d{1,4}[a-z]?(?: ?(?:bis|ter))?,? (?:rue|avenue|impasse|boulevard|chemin|allée|place|quai|route)(?: (?:de|du|des|la|le|les|d'|l'))* ?[^\W\d_][\w'’-]*"
    r"|(?:(?:calle|avenida|avda\.?|plaza|paseo|camino|carrera) |\bC[/.] ?)(?:[^\W\d_][\w'’-]* ){0,4}?[^\W\d_][\w'’-]*,? (?:n[ºo°]\.? ?)?\d{1,4}[a-z]?\b"
    r"|[^\W\d_][\w-]*(?:straße|strasse|str\.|gasse|weg|allee|platz|ufer|damm) \d{1,4} ?[a-z]?\b"
    r"|[一-鿿]{2,6}(?:路|街|巷|大道)\s?\d+\s?号",
    re.I,
)
_TITLE = r"(?:Dr|Prof|Mr|Mrs|Ms|Miss|Herr|Frau|Mme|M|Sr|Sra|Señor|Señora)\.?"
_PARTICLE = r"(?:van der|van|von|de la|de|del|di|al|el|la|bin|ibn)"
_CAP = r"[^\W\d_a-zß-öø-ÿ][\w'’]*(?:-[^\W\d_][\w'’]*)*"
_TITLED = re.compile(rf"(?<!\w){_TITLE} (?:{_CAP} )?(?:{_PARTICLE} )?{_CAP}")
_INITIAL = re.compile(rf"(?<![\w.])[A-Z]\. (?:[A-Z]\. )?(?:{_PARTICLE} )?{_CAP}(?!\w)")
#: Where matches may begin. The engine skips to a first character of a class, but tries a pattern that begins with a look behind or
#: ignores case at every character, so these are found first and the pattern is tried there only.
_TITLED_AT = re.compile(r"[DFHMPS](?=(?:rof|rs|rau|ra|r|s|iss|me|err|eñora|eñor|)\.? )")
_INITIAL_AT = re.compile(r"[A-Z](?=\. )")
_DIGITS = re.compile(r"\d+")
_CALLE_AT = re.compile(r"[AaCcPp](?=(?i:alle|venida|vda|laza|aseo|amino|arrera|[/.]))")
_JOINED = re.compile(r"(?:straße|strasse|str\.|gasse|weg|allee|platz|ufer|damm)\Z", re.I)
_LETTERS = re.compile(r"[^\W\d_]+")
#: Translates an ASCII text to its runs of letters, faster than the pattern does.
_BLANKED = "".join(c if c.isalpha() else " " for c in map(chr, range(128)))
_TOKEN = re.compile(r"[^\W\d_][\w'’]*(?:-[^\W\d_][\w'’]*)*\.?")
_LITERAL = re.compile(r'"([^"\\]*+(?:\\.[^"\\]*+)*+)"(\s*:)?', re.S)

_CTX = {
    "phone": r"\b(?:call|text me|phone|tel|telefon|teléfono|téléphone|mobile|number changed|number is|ring|dial|dial-in|appelez|llama|llame|anruf|ruf|whatsapp|sms|contact|reach)|电话|手机|致电",
    "national_id": r"\b(?:ssn|passport|tax|identity|identidad|identité|ausweis|steuer|insurance record|social security|dni|nie|nino|id)\b|身份证|护照|税号",
    "not_number": r"\b(?:bin|lot|order|ticket|invoice|part|shelf|version|build|checksum|measured|serial|sku|batch|isbn)(?: (?:code|number|no\.?|nr\.?|is|id))*[ :#]*$",
    "mail": r"\b(?:mail|e-mail|email|write|reach|cc|contact|courriel|correo|schreib|reply)|邮",
    "street": r"\b(?:live|lives|address|moved|new place|find|send|deliver|delivery|vive|habite|wohnt|adresse|dirección|pickup|visit)|住|地址|寄",
    "not_street": r"\b(?:playlist|album|lamp)\b",
    "name": r"\b(?:met|ask|signed|call|under|record of|i am|sag|appelez|dinner|contact for|dile|avisa|frag|demande|moved|lives|vive|habite|wohnt|number changed|wants|birthday|lunch|mr|mrs|dear)\b|告诉|问",
    "not_name": r"\b(?:bakery|module|project|reminder|playlist|album|ltd|inc|gmbh|river|lake|see|version|harbour)\b",
}
_CTX = {k: re.compile(v, re.I) for k, v in _CTX.items()}
_FIELDS = {
    "email": "email mail reply_to newsletter", "phone": "phone mobile reachable_at call", "national_id": "tax_id passport has_id ssn national_id",
    "street_address": "lives_at address delivery_address pickup", "person_name": "name",
}
_FIELD_TYPE = {f: t for t, fs in _FIELDS.items() for f in fs.split()}
_PHONE_FORMS = re.compile(
    rf"\+\d{{1,3}}[ .(]\s?[\d .()-]{{7,16}}\d|\+\d{{9,14}}|\(\d{{3}}\) ?\d{{3}}[-. ]\d{{4}}|\d{{3}}([.-])\d{{3}}\1\d{{4}}|\d{{3}} \d{{3}} \d{{4}}|0\d{{9,10}}|0\d{{2,4}}[ /]\d{{5,7}}(?:[ -]\d{{1,4}})?|00 ?\d{{2}}[\d ()]{{8,14}}|0[1-9](?: \d\d){{4}}|1\d{{10}}|.*(?:{_DIGIT_WORDS}).*"
)
_ID_FORMS = re.compile(
    r"\d{3}[- ]\d{2}[- ]\d{4}|\d{9}|[A-Z]{2} ?\d\d ?\d\d ?\d\d ?[A-Z]|[A-Z]{1,2}\d{6,8}|[A-Z]\d{3}\.\d{3}\.\d{3}/?[A-Z]?|\d{8}[- ]?[A-Z]|\d{3}\.\d{3}\.\d{3}-?\d\d|\d{17}[\dX]|[12] ?\d\d ?\d\d ?\d\d ?\d{3} ?\d{3}(?: ?\d\d)?"
)
#: Given names that are common words, too; fixed values.
_WORD_NAMES = frozenset("rose will bill frank mark grace may june april hope faith joy ray gene pat rich art dean sky max penny val mal ben rob dom sol".split())
_AFTER = re.compile(r"\s*[^\W\d_][\w'’]*")


def strings_of(content: str) -> Iterator[tuple[int, int, str, str]]:
    """(start, end, text, field) of each string value of a JSON text, in order; field is its key, or the predicate or key that the record names."""
    key, named = "", ""
    for m in _LITERAL.finditer(content):
        if m[2]:
            key = m[1]
            continue
        text = m[1]
        if "\\" in text:
            try:
                text = json.loads(f'"{text}"', strict=False)
            except ValueError:
                continue
        if key in ("predicate", "key"):
            named = text.strip().lower().replace(" ", "_")
        yield m.start(1), m.end(1), text, named if key in ("object", "value") and named else key


def _matches(pattern: re.Pattern, text: str, starts: Iterable[int]) -> Iterator[re.Match]:
    """What finditer gives, if the ascending `starts` hold every place where a match begins."""
    end = 0
    for at in starts:
        if at >= end and (m := pattern.match(text, at)):
            yield m
            end = m.end()


def _street_starts(text: str, numbers: list[int]) -> list[int]:
    """Where a street may begin; `numbers` are the first digits of all numbers."""
    starts = {*numbers, *(m.start() for m in _CALLE_AT.finditer(text))}
    for at in numbers:
        one, two = text[max(0, at - 1) : at], text[max(0, at - 2) : max(0, at - 1)]
        if one == " " and two:
            if two in "TtEe.":  # of apartment, suite, apt., flat and unit, apt
                starts.update(range(max(0, at - 10), at - 3))
            if two in "EeGgMmRrZz." and _JOINED.search(text, max(0, at - 8), at - 1):
                first = at - 2
                while first and (text[first - 1].isalnum() or text[first - 1] in "_-"):
                    first -= 1
                starts.update(range(first, at - 1))
        if one and (one in "路街巷道" or one.isspace() and two and two in "路街巷道"):
            starts.update(range(max(0, at - 9), at))
    return sorted(starts)


def _number_starts(text: str, numbers: list[int]) -> list[int]:
    """Where a number that isn't all words may begin."""
    starts = set(numbers)
    for at in numbers:
        one, two = text[max(0, at - 1) : at], text[max(0, at - 2) : max(0, at - 1)]
        if one and one in "+(":
            starts.add(at - 1)
        elif "A" <= one <= "Z" or one == " " and "A" <= two <= "Z":
            starts.update(range(max(0, at - 4), at))
    return sorted(starts)


def _lowered_family(word: str, tails: frozenset) -> bool:
    return len(word) >= 4 and word[-3:].lower() in tails


class Proposer:
    """Spans of a text with their votes and features."""

    def __init__(self, given: frozenset, tails: frozenset, buckets: int):
        self.given, self.tails, self.buckets = given, tails, buckets
        self.first = frozenset(m[0] for g in given if (m := _LETTERS.match(g)))
        self.hashed: dict[str, int] = {}

    def _h(self, f: str) -> int:
        h = self.hashed.get(f)
        if h is None:
            if len(self.hashed) > 200_000:
                self.hashed.clear()
            h = self.hashed[f] = zlib.crc32(f.encode("utf-8", "replace")) % self.buckets
        return h

    def spans(self, text: str, field: str) -> list[tuple[str, int, int, str, list[int]]]:
        """(kind, start, end, votes, features); votes is a digit per labeler, 9 where it abstains."""
        out: list[tuple[str, int, int, str, list[int]]] = []
        taken: list[tuple[int, int]] = []
        by_field = _FIELD_TYPE.get(field)
        low = text.lower()
        words = low.translate(_BLANKED).split() if text.isascii() else _LETTERS.findall(low)
        numbers = [m.start() for m in _DIGITS.finditer(text)]
        if "@" in text or "＠" in text or "at)" in low or "at]" in low or " dot " in low:
            for m in _MAIL.finditer(text):
                out.append(self._mail(text, m.start(), m.end(), by_field, field))
                taken.append(m.span())
        if numbers:
            for m in _matches(_STREET, text, _street_starts(text, numbers)):
                if not any(a < m.end() and m.start() < b for a, b in taken):
                    out.append(self._street(text, m.start(), m.end(), by_field, field))
                    taken.append(m.span())
        spelled = (not text.isascii() or sum(map(_DIGIT_SET.__contains__, words)) > 6) and _SPELLED.search(text)
        if numbers or spelled:
            for m in _NUMBER.finditer(text) if spelled else _matches(_NUMBER, text, _number_starts(text, numbers)):
                start, end = m.span()
                digits = sum(c.isdigit() for c in m[0])
                if digits < 6 and not re.search(_DIGIT_WORDS, m[0]):
                    continue
                if not any(a < end and start < b for a, b in taken):
                    out.append(self._number(text, start, end, by_field, field))
                    taken.append((start, end))
        for start, end, why in self._names(text, not self.first.isdisjoint(words)):
            if not any(a < end and start < b for a, b in taken):
                out.append(self._name(text, start, end, why, by_field, field))
                taken.append((start, end))
        return out

    def _around(self, text: str, start: int, end: int) -> tuple[list[str], list[str], str, str]:
        left, right = text[max(0, start - 48) : start], text[end : end + 32]
        stop = max(left.rfind(". "), left.rfind("\n"), left.rfind("; "))
        left = left[stop + 1 :]
        return re.findall(r"[^\W\d_]+|[^\w\s]", left.lower())[-3:], re.findall(r"[^\W\d_]+|[^\w\s]", right.lower())[:2], left, right

    def _row(self, kind, text, start, end, votes, field, more=()):
        before, after, _, _ = self._around(text, start, end)
        shape = re.sub(r"(.)\1+", r"\1", re.sub(r"[^\W\d_]", "a", re.sub(r"\d", "9", text[start:end].lower())))[:24]
        feats = [f"{kind} bias", f"{kind} s {shape}", f"{kind} f {field}", f"{kind} p1 {before[-1:]}", f"{kind} p2 {before[-2:]}", f"{kind} n1 {after[:1]}", f"{kind} n2 {after}"]
        feats += [f"{kind} w {w}" for w in before if w.isalpha()] + [f"{kind} v{i} {v}" for i, v in enumerate(votes)] + [f"{kind} {m}" for m in more]
        return kind, start, end, "".join("9" if v is None else str(v) for v in votes), sorted({self._h(f) for f in feats})

    def _mail(self, text, start, end, by_field, field):
        span = text[start:end]
        _, _, left, right = self._around(text, start, end)
        tail = re.split(rf"{_DOT}| dot ", span, flags=re.I)[-1]
        votes = (
            1 if re.fullmatch(r"[A-Za-z]{2,}", tail) else 0,
            0 if re.search(r"\d$", tail) or right.startswith((":", "/")) else None,
            1 if _CTX["mail"].search(left) else None,
            1 if by_field == "email" else None,
            1 if re.search(rf"{_DOT}|dot", span.rsplit("@")[-1], re.I) else 0,
        )
        return self._row("mail", text, start, end, votes, field)

    def _number(self, text, start, end, by_field, field):
        span = text[start:end]
        _, _, left, right = self._around(text, start, end)
        digits = re.sub(r"\D", "", span)
        phone, ident = bool(_PHONE_FORMS.fullmatch(span)), bool(_ID_FORMS.fullmatch(span))
        words = left.split()
        near = " ".join(words[-6:])
        no = bool(_CTX["not_number"].search(" ".join(words[-4:])))
        votes = (
            1 if phone and not ident else None,
            2 if ident and not phone else None,
            1 if _CTX["phone"].search(near) and not no else None,
            2 if _CTX["national_id"].search(near) and not no else None,
            0 if no else None,
            {"phone": 1, "national_id": 2}.get(by_field),
            0 if not phone and not ident else None,
            1 if span[0] in "+(" or span.startswith("00") else (2 if re.search(r"[A-Z]", span) else None),
        )
        return self._row("number", text, start, end, votes, field, (f"len {len(digits)}", f"lead {span[:2]}", f"no {no}"))

    def _street(self, text, start, end, by_field, field):
        span = text[start:end]
        _, _, left, right = self._around(text, start, end)
        words = re.findall(r"[^\W\d_]+", span)
        last = words[-1].lower() if words else ""
        doubtful = last in _DOUBTFUL_WORDS
        capital = bool(words) and words[-1][:1].isupper()
        votes = (
            None if doubtful and not capital else 1,
            1 if _CTX["street"].search(left) else None,
            0 if _CTX["not_street"].search(right) else None,
            1 if by_field == "street_address" else None,
            0 if doubtful and not capital and by_field != "street_address" else None,
        )
        return self._row("street", text, start, end, votes, field, (f"t {last}", f"c {capital}"))

    def _names(self, text: str, given_there: bool) -> Iterator[tuple[int, int, str]]:
        """given_there: one of its runs of letters may begin a given name."""
        found: list[tuple[int, int, str]] = []
        for why, pattern, at in (("title", _TITLED, _TITLED_AT), ("initial", _INITIAL, _INITIAL_AT)):
            found += [(*m.span(), why) for m in _matches(pattern, text, (m.start() for m in at.finditer(text)))]
        tokens = [(m.start(), m.end(), m[0].rstrip(".")) for m in _TOKEN.finditer(text)] if given_there else []
        given, i = self.given, 0
        while i < len(tokens):
            start, end, word = tokens[i]
            base = word[:-2] if word[-2:] in ("'s", "’s") else word
            if base.lower() not in given and (("-" not in base) or base.split("-")[0].lower() not in given):
                i += 1
                continue
            end = start + len(base)
            shown = base[:1].isupper()
            j, why = i, "lone"
            if base == word:
                k, at = i + 1, end
                while k < len(tokens) and text[at : tokens[k][0]] in ((" ",) if k == i + 1 else (" ", ". ")) and (
                    len(tokens[k][2]) == 1 and tokens[k][2].isupper() or tokens[k][2].lower() in ("van", "von", "de", "al", "el", "la", "del", "di", "der", "bin")
                ) and k < i + 4:
                    at = tokens[k][0] + len(tokens[k][2])
                    k += 1
                if k < len(tokens) and text[at : tokens[k][0]] in ((" ", "  ") if k == i + 1 or len(tokens[k - 1][2]) > 1 else (" ", ". ")):
                    nxt = tokens[k][2]
                    core = nxt[:-2] if nxt[-2:] in ("'s", "’s") else nxt
                    if (shown and nxt[:1].isupper() and len(core) > 1) or (not shown and nxt[:1].islower() and _lowered_family(core, self.tails)):
                        j, end, why = k, tokens[k][0] + len(core), "pair"
                    elif k > i + 1 and text[tokens[k - 1][1] - 1] == ".":
                        j, end, why = k - 1, tokens[k - 1][0] + len(tokens[k - 1][2]), "begun"
                elif k > i + 1:
                    j, end, why = k - 1, tokens[k - 1][0] + len(tokens[k - 1][2]), "begun"
            if i and why == "lone" and shown:
                s0, e0, w0 = tokens[i - 1]
                between = text[e0:start]
                if between == ", " and w0[:1].isupper() and len(w0) > 3 and _lowered_family(w0, self.tails):
                    start, why = s0, "comma"
                elif between == " " and w0.isupper() and len(w0) > 3 and not base.isupper():
                    start, why = s0, "capital"
            found.append((start, end, why))
            i = j + 1
        found.sort(key=lambda x: (x[0], -x[1]))
        reach = -1
        for start, end, why in found:
            if start >= reach:
                yield start, end, why
                reach = end

    def _name(self, text, start, end, why, by_field, field):
        span = text[start:end]
        _, _, left, right = self._around(text, start, end)
        words = [w.lower().rstrip(".") for w in re.split(r"[\s,]+", span) if w]
        capital = span[:1].isupper()
        after = _AFTER.match(right)
        next_word = after[0].strip() if after else ""
        family = any(_lowered_family(w, self.tails) for w in words)
        common = why == "lone" and words[0] in _WORD_NAMES
        trade = next_word.lower() in TRADES or any(w in TRADES for w in words)
        votes = (
            1 if why in ("pair", "comma", "title", "capital", "begun") and capital else None,
            1 if family and why != "lone" else None,
            0 if not capital and why == "lone" else None,
            0 if common and not _CTX["name"].search(left[-14:]) else None,
            1 if _CTX["name"].search(left[-18:]) or re.match(r"['’]s number|,? (?:moved|wants|lives|likes|vive|et|and) ", right) else None,
            1 if field in ("subject", "name", "title") and capital else None,
            0 if trade or _CTX["not_name"].search(right[:12]) or left.rstrip()[-1:] in ("&", "/", "_") or right[:1] in ("_", "/") else None,
            1 if words[0] in self.given and why == "lone" and capital and not common else None,
        )
        return self._row("name", text, start, end, votes, field, (f"why {why}", f"g {words[0]}", f"c {capital}", f"fam {family}", f"nw {next_word.lower()}", f"up {next_word[:1].isupper()}"))


def gazetteer(people: DataFrame, config: PiiConfig = PiiConfig()) -> tuple[frozenset, frozenset]:
    """(given names, last three letters of family names), counted over all names "Given Family" of the people table; a person
    of several rows counts once for a name. The fixed short forms of given names are added. More names than max_gazetteer raise ValueError."""
    pair = r"^([A-Z][a-z]+) ([A-Z][a-z]+)$"
    names = people.select(canonical_id(F.col("id")).alias("id"), F.lower(F.regexp_extract("display_name", pair, 1)).alias("g"), F.lower(F.regexp_extract("display_name", pair, 2)).alias("f")).where(
        (F.col("g") != "") & ~F.col("f").isin(*TRADES) & ~F.col("g").isin(*TRADES)
    ).distinct()
    counted = names.groupBy("g", "f").agg(F.count("*").alias("n"))
    first = counted.groupBy("g").agg(F.sum("n").alias("people"), F.count("*").alias("families"))
    # words that differ by one letter, or by two that are swapped, share what is left without a letter
    left = F.transform(F.sequence(F.lit(1), F.length("g")), lambda i: F.concat(F.substring(F.col("g"), F.lit(1), i - 1), F.substring(F.col("g"), i + 1, F.length("g"))))
    spelled = first.select("g", "people", F.explode(F.array_distinct(F.concat(F.array("g"), left))).alias("key"))
    wrong = spelled.alias("x").join(spelled.groupBy("key").agg(F.max("people").alias("most")), "key").where(F.col("most") >= config.misspelled * F.col("people")).select("g").distinct()
    given = first.where(F.col("families") >= config.min_families).join(wrong, "g", "left_anti").select("g")
    all_people = names.agg(F.count("*").alias("all"))
    tails = (
        counted.where(F.length("f") > 4).groupBy(F.substring("f", -3, 3).alias("t")).agg(F.sum("n").alias("people"), F.countDistinct("f").alias("families"))
        .join(F.broadcast(all_people)).where((F.col("families") >= config.min_families) & (F.col("people") >= config.ending_share * F.col("all")))  # one row
    )
    fixed = {w for w in NICKNAMES if len(w) > 3} | {w for v in NICKNAMES.values() for w in v.split()}
    known = [r.g for r in given.limit(config.max_gazetteer + 1).collect()]
    if len(known) > config.max_gazetteer:
        raise ValueError(f"more than {config.max_gazetteer} given names; raise max_gazetteer")
    return frozenset({*known, *fixed}), frozenset(r.t for r in tails.select("t").collect())  # at most 26 ** 3 endings


_SPANS = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("votes", T.StringType()),
    T.StructField("features", T.ArrayType(T.IntegerType())), T.StructField("n", T.IntegerType()),
])


def proposed_spans(memories: DataFrame, names: tuple[frozenset, frozenset], config: PiiConfig = PiiConfig()) -> DataFrame:
    """(id, kind, votes, features, n) of all proposed spans; equal ones of one memory are one row, counted, whether it was
    delivered once or more often. Whole contents are read; only the spans are shuffled."""
    sent = memories.sparkSession.sparkContext.broadcast(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        proposer = Proposer(*sent.value, config.buckets)
        for batch in batches:
            found: list[tuple] = []
            counts: list[int] = []
            for i, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows: dict[tuple, int] = {}
                for _, _, text, field in strings_of(content) if content else ():
                    for kind, _, _, votes, feats in proposer.spans(text, field):
                        row = (i, kind, votes, tuple(feats))
                        rows[row] = rows.get(row, 0) + 1
                found += rows
                counts += rows.values()
            cols = list(zip(*found)) if found else [[], [], [], []]
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string()), pa.array([list(x) for x in cols[3]], pa.list_(pa.int32())), pa.array(counts, pa.int32())],
                names=[f.name for f in _SPANS],
            )

    return memories.select(canonical_id(F.col("id")).alias("id"), "content_json").mapInArrow(run, _SPANS).distinct()


#: Labelers that know what a span is not; they are held to be wrong about a span with a type once in 200 times, with the weight of half the spans.
ANCHORED = {"mail": (1,), "number": (4,), "street": (2,), "name": (3, 6)}


def em_odds(patterns: dict[str, int], n_types: int, rounds: int, anchored: tuple = ()) -> dict[str, list[float]]:
    """Odds of each type for each vote pattern, by expectation-maximisation over counted patterns.

    A labeler is a matrix of how it votes, or abstains, on spans of each type. Labelers start out as mostly right.
    """
    keys = sorted(patterns)
    if not keys:
        return {}
    counts = np.array([patterns[k] for k in keys], float)
    votes = np.array([[int(c) for c in k] for k in keys])
    m = votes.shape[1]
    codes = np.where(votes == 9, n_types, votes)
    start = np.zeros((len(keys), n_types))
    for t in range(n_types):
        start[:, t] = (votes == t).sum(1)
    start[:, 0] += 0.5
    post = (start + 0.1) ** 2
    post /= post.sum(1, keepdims=True)
    for _ in range(rounds):
        weighted = post * counts[:, None]
        prior = (weighted.sum(0) + 1) / (weighted.sum() + n_types)
        log = np.tile(np.log(prior), (len(keys), 1))
        for j in range(m):
            table = np.full((n_types, n_types + 1), 0.5)
            for t in range(n_types):
                table[t, t] += 1.0
            for c in range(n_types + 1):
                table[:, c] += weighted[codes[:, j] == c].sum(0)
            if j in anchored:
                held = np.full(n_types + 1, 0.005 / n_types)
                held[n_types] = 0.995
                table[1:] += 0.5 * counts.sum() * held
            table /= table.sum(1, keepdims=True)
            log += np.log(table[:, codes[:, j]]).T
        log -= log.max(1, keepdims=True)
        post = np.exp(log)
        post /= post.sum(1, keepdims=True)
    return {k: post[i].tolist() for i, k in enumerate(keys)}


def fit(spans: DataFrame, config: PiiConfig = PiiConfig()) -> dict:
    """{kind: weights [types, buckets]} of the final classifier. Vote patterns are counted over all spans; the
    regression sees at most max_fit_spans of them."""
    counted = spans.groupBy("kind", "votes").agg(F.sum("n").alias("n")).collect()  # a few hundred patterns
    odds = {kind: em_odds({r.votes: r.n for r in counted if r.kind == kind}, len(types), config.em_rounds, ANCHORED[kind]) for kind, types in KINDS.items()}
    sample = bounded_sample(spans.select("id", "kind", "votes", "features"), ["id", "votes", "features"], config.max_fit_spans).collect()
    sample.sort(key=lambda r: (r.kind, r.votes, r.features))
    model = {}
    for kind, types in KINDS.items():
        rows = [r for r in sample if r.kind == kind]
        w = np.zeros((len(types), config.buckets))
        if rows:
            y = np.array([odds[kind][r.votes] for r in rows])
            at = np.repeat(np.arange(len(rows)), [len(r.features) for r in rows])
            cols = np.concatenate([np.array(r.features, int) for r in rows])
            m, v = np.zeros_like(w), np.zeros_like(w)
            for step in range(1, config.steps + 1):
                s = np.stack([np.bincount(at, wt[cols], len(rows)) for wt in w], 1)
                p = np.exp(s - s.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                err = (p - y) / len(rows)
                g = np.stack([np.bincount(cols, err[at, t], config.buckets) for t in range(len(types))]) + config.ridge * w
                m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
                w -= 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
        model[kind] = w.astype(np.float32)
    return model


def classify(kind: str, features: list[int], model: dict) -> str:
    """The most likely type of a span."""
    return KINDS[kind][int(model[kind][:, features].sum(1).argmax())]


def found_types(spans: DataFrame, model: dict) -> DataFrame:
    """(id, pii_type, n) of the memories with personal information; null ids are left out."""
    sent = spans.sparkSession.sparkContext.broadcast(model)  # 9 x buckets floats

    @F.pandas_udf(T.StringType())
    def kind_of(kind, features):
        import pandas as pd

        return pd.Series([classify(k, f, sent.value) for k, f in zip(kind, features)], dtype=object)

    typed = spans.where("id is not null").select("id", kind_of("kind", "features").alias("pii_type"), "n").where("pii_type <> 'none'")
    return typed.groupBy("id", "pii_type").agg(F.sum("n").cast("long").alias("n"))


def detect(memories: DataFrame, people: DataFrame, config: PiiConfig = PiiConfig()) -> tuple[DataFrame, dict, tuple]:
    """(spans, model, names) for `memories` (id, content_json); spans of rows delivered twice count once. Null and broken
    content gives no span; empty tables give an empty result."""
    names = gazetteer(people, config)
    spans = checkpointed(proposed_spans(memories, names, config))
    return spans, fit(spans, config), names


def redacted(memories: DataFrame, model: dict, names: tuple, config: PiiConfig = PiiConfig()) -> DataFrame:
    """(id, content_json, n_found): contents with typed placeholders in place of personal information; all else,
    blanks and escapes included, stays as it was. One row for each row given, so one delivered twice comes twice. A null content stays null. No shuffle."""
    sent = memories.sparkSession.sparkContext.broadcast((model, names))
    schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("content_json", T.StringType()), T.StructField("n_found", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, names = sent.value
        proposer = Proposer(*names, config.buckets)
        for batch in batches:
            contents, counts = [], []
            for content in batch.column(1).to_pylist():
                new, n = redact(content, proposer, model) if content else (content, 0)
                contents.append(new)
                counts.append(n)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(contents, pa.string()), pa.array(counts, pa.int32())], names=schema.names)

    return memories.select(canonical_id(F.col("id")).alias("id"), "content_json").mapInArrow(run, schema)


def redact(content: str, proposer: Proposer, model: dict) -> tuple[str, int]:
    """A content with placeholders, and how many."""
    out, done, n = [], 0, 0
    for start, end, text, field in strings_of(content):
        hits = [(a, b, t) for kind, a, b, _, f in proposer.spans(text, field) if (t := classify(kind, f, model)) != "none"]
        if not hits:
            continue
        parts, at = [], 0
        for a, b, t in sorted(hits):
            parts += [text[at:a], PLACEHOLDERS[t]]
            at = b
        new = "".join([*parts, text[at:]])
        raw = content[start:end]
        out += [content[done:start], json.dumps(new, ensure_ascii="\\u" in raw or raw.isascii())[1:-1]]
        done, n = end, n + len(hits)
    return "".join([*out, content[done:]]), n
