"""Plain spelling of disguised text, and its pieces."""

from __future__ import annotations

import re
import unicodedata

#: Letters of other scripts that look like Latin ones, fixed values.
_LOOKALIKES = str.maketrans(
    "абвгеёзикмнопрстухчьіїјѕԁһԛԝαβεικνορτυχϲ", "abbreezukmhonpctyx4biijsdhqwabeiknoptuxc"
)
#: Digits and signs written for letters, fixed values.
_LEET = str.maketrans("013457@$!€+", "oieastasiet")
_HIDDEN = re.compile("[­​-‏⁠-⁤﻿]")
_SPACED = re.compile(r"(?<![^\W_])[^\W\d_]([ .·\-_*]{1,3})[^\W\d_](?:\1[^\W\d_])+(?![^\W_])")
_GAPS = re.compile(r"[ .·\-_*]")
#: Signs without which no word is changed by `_word`.
_SIGNS = re.compile("[0-9@$!€+*'’]")
#: Digits that stand for letters only in words, in both readings of 6, fixed values.
_RARE_LEET = (str.maketrans("2689", "zgbg"), str.maketrans("2689", "zbbg"))
_SIGNED = re.compile(r"(?<=[぀-ヿ㐀-鿿])\*+(?=[぀-ヿ㐀-鿿])|(?<=(?<!\w)[぀-ヿ㐀-鿿])\*+|[^\W0-9぀-ヿ㐀-鿿]*+[0-9@$!€+*'’](?:[^\W぀-ヿ㐀-鿿]|[@$!€+*'’])*")
_NUMBER = re.compile(r"[0-9]*[2689][0-9]*")
_REPEATED = re.compile(r"([^\W\d_])\1+")
_MASKED = re.compile(r"^([^\W\d_])\*+([^\W\d_]?)\W*$")
#: Sounds between the sentences of spoken text, fixed values.
_FILLERS = frozenset(("um", "uh", "ah", "euh", "eh", "em"))
_LATIN = re.compile(r"[a-z]")
_WORDS = re.compile(r"[^\W\d_]+\*?[^\W\d_]*|(?<=[぀-ヿ㐀-鿿] )\*")
_ENDS = re.compile("[\n\r\t\v\f  |;]+|[.!?…]+(?=[\\s\"'»)\\]]|$)|[。！？；]+")
_CJK = re.compile("[぀-ヿ㐀-鿿]")


def repair(text: str) -> str:
    """UTF-8 that was read as Latin-1 set right; other text as it is."""
    if "Ã" not in text and "â€" not in text:
        return text

    def fix(m: re.Match) -> str:
        try:
            return m[0].encode("cp1252").decode("utf-8")
        except UnicodeError:
            return m[0]

    return re.sub(r"[Â-ô][\x80-¿Œ-ž–-™€]{1,3}", fix, text)


def _word(m: re.Match) -> str:
    w = m[0]
    if set(w) == {"*"} and _CJK.match(m.string, m.start() - 1):
        return "*"
    if (masked := _MASKED.match(w)):
        return f"{masked[1]}*{masked[2]}"
    core = w.rstrip("!+*'’")
    if any(c in "2689" for c in core):
        return f" {' '.join(_around_digits(core))} "
    return _letters(core)


def _around_digits(core: str) -> list[str]:
    """Readings of a word with digits that are no usual letters: its parts without them, apart and together, and, if it is
    rather a word than a number, with letters for them. A mere number has none."""
    letters = sum(c.isalpha() for c in core)
    if not letters:
        return []
    parts = [_letters(x) for x in _NUMBER.split(core)]
    found = [*(x for x in parts if len(x) > 1), "".join(parts)]
    if letters > sum(c.isdigit() for c in core) and _LATIN.search(core):
        found += [_letters(core.translate(t)) for t in _RARE_LEET]
    return list(dict.fromkeys(found))


def _letters(core: str) -> str:
    if _LATIN.search(core) and not core.isalpha() and any(c in "013457@$!€+" for c in core):
        core = core.translate(_LEET)
    elif core and core in ("@7", "!7", "7o", "!t"):
        core = core.translate(_LEET)
    return core


def fold(text: str) -> str:
    """Lower-case text without accents, hidden characters, look-alike letters and spaces between the letters
    of a word; line breaks and sentence ends stay."""
    if text.isascii():
        t = text.lower()
    else:
        t = _HIDDEN.sub("", unicodedata.normalize("NFKC", repair(text))).lower().translate(_LOOKALIKES)
        t = "".join(c for c in unicodedata.normalize("NFD", t) if not unicodedata.combining(c))
    return _SPACED.sub(lambda m: _GAPS.sub("", m[0]), t)


def _plain(sentence: str) -> str:
    """A folded sentence with letters for the signs in its words and single letters for stretched ones."""
    if _SIGNS.search(sentence):
        sentence = _SIGNED.sub(_word, sentence)
    return _REPEATED.sub(r"\1", sentence)


def line_pieces(line: str, words: int = 16, step: int = 6) -> list[list[str]]:
    """Words of each sentence of one line; see `pieces`."""
    out = []
    for part in _ENDS.split(fold(line)):
        part = _plain(part)
        found = _WORDS.findall(part if part.isascii() else _CJK.sub(r" \g<0> ", part))
        if len(found) <= words and _FILLERS.isdisjoint(found):
            if found:
                out.append(found)
            continue
        start = 0
        for i, w in enumerate([*found, "um"]):
            if w in _FILLERS:
                out += _windows(found[start:i], words, step)
                start = i + 1
    return out


def pieces(text: str, words: int = 16, step: int = 6) -> list[list[str]]:
    """Words of each sentence or line of the folded text. Text without such ends is cut into windows of
    `words` words that overlap, and at the fillers of speech, Chinese into its characters. Every word is in some piece."""
    return [p for line in text.splitlines() for p in line_pieces(line, words, step)]


def _windows(found: list[str], words: int, step: int) -> list[list[str]]:
    if not found:
        return []
    if len(found) <= words:
        return [found]
    return [found[i : i + words] for i in range(0, len(found) - words + step, step)]
