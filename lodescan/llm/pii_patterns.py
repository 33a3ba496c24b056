"""Tokens of texts, forms of numbers, addresses and mail addresses, and what is known of words: evidence the field weighs.

Everything works on the look-alike-mapped text (ordinary width, no invisible characters) and keeps the
place of each character in the text as written.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import numpy as np

from lodescan.llm.lookalike import mapping

TYPES = ["EMAIL", "PHONE", "ID_NUMBER", "ADDRESS", "NAME"]

# Words that name streets, flats, organisations, particles and titles.
STREETS = (
    "street road avenue drive lane close terrace gardens crescent mews place court way boulevard blvd square hill grove row walk park rise view parade st rd "
    "ave dr ln rue chemin quai allée impasse route cours straße strasse weg gasse platz allee ring damm ufer calle avenida plaza via corso"
).split()
SOUTHERN = "calle avenida plaza paseo via viale corso piazza rua".split()
GERMAN_ENDS = "straße strasse str. weg gasse platz allee ring damm ufer".split()
UNITS = "flat apt apartment suite unit room wohnung app appt".split()
ORGANISATIONS = "ltd llc inc gmbh ag ab sarl sa se bv plc corp kg oy ooo ao oao zao holdings group partners bank company university foundation".split()
PARTICLES = "de da di del della du des la le van von der den al bin ibn ter zu".split()
TITLES = "mr mrs ms miss dr prof sir madam herr frau m mme sr sra señor señora".split()
# Common given names of many countries, in lower case and without accents.
GIVEN = """
james mary john patricia robert jennifer michael linda william elizabeth david barbara richard susan joseph jessica thomas sarah charles karen emily emma
olivia daniel matthew anna andrew laura peter paul mark julia george helen alice henry lucy jack grace oliver sophie hans peter klaus jurgen wolfgang ursula
monika sabine heike anke lukas leon felix lena lea pierre jean marie claire julien camille antoine louise chloe jose juan carlos luis miguel maria carmen
lucia sofia pablo diego joao pedro ana rita tiago giovanni marco luca giulia francesca paolo chiara jan piet kees anneke sanne lars erik ingrid astrid
bjorn freja soren mikkel jakub piotr katarzyna agnieszka zofia mehmet ayse fatma mustafa emre zeynep ivan olga dmitri natalia sergei tatiana hiroshi yuki
kenji sakura haruto wei li ming jing xin hui chen raj rajesh priya amit sunita anil deepa arjun fatima mohammed ahmed ali hassan aisha omar layla yusuf
kwame ama chidi ngozi thabo zanele min-jun ji-woo somchai nguyen
""".split()
# Labels of identity numbers, in lower case.
ID_LABELS = (
    r"ssn|soc(?:ial|\.)?\s?sec(?:urity|\.)?(?:\s?(?:number|no\.?|nr\.?))?|pesel|dni\s?/\s?nif|dni|nif|nie|aadhaar|uid(?:\s?no\.?)?|"
    r"nhs(?:[ _](?:number|no\.?|nr\.?))?|steuer-?\s?id(?:nr\.?)?|idnr\.?|tax\s?(?:id|no\.?|number)(?:\s?\([a-z]{2}\))?|"
    r"(?:travel\s?document\s?\(?)?passport\)?(?:\s?(?:number|no\.?|nr\.?))?|travel\s?document|reisepass(?:nr\.?)?|"
    r"national\s?(?:id|insurance)(?:\s?(?:number|no\.?))?|sozialversicherungsnummer|id\s?card(?:\s?no\.?)?"
)
# Words that join a number to the one before it.
JOINING = r"and|or|und|oder|et|ou|y|e|o|i|lub"

#: parts texts of a batch are joined with; the mapping removes it from texts
BREAK = "\0"
TOKEN = re.compile(r"[^\W\d_]+(?:[̀-ͯ]+[^\W\d_]*)*|\d+|[^\s\0]")
#: the same with what stands between tokens, so that the pieces together are the whole text
PIECE = re.compile(r"[^\W\d_]+(?:[̀-ͯ]+[^\W\d_]*)*|\d+|[^\s\0]|\0|\s+")
_CONTROL = re.compile(r"[\x00-\x09\x0b\x0c\x0e-\x1f\x7f]")


@lru_cache(1)
def _table() -> dict[int, str]:
    return {ord(c): to for c, to in mapping().items()}


def flattened(text: str) -> tuple[str, list[int] | None]:
    """Look-alike-mapped text and, unless nothing changed, the place of each of its characters."""
    if text.isascii() and not _CONTROL.search(text):
        return text, None
    table = _table()
    flat = text.translate(table)
    if flat == text:
        return text, None
    at: list[int] = []
    for i, c in enumerate(text):
        at += [i] * len(table.get(ord(c), c))
    return flat, at


def name_key(word: str) -> str:
    """Word without case and accents, for look-up and for ties."""
    if word.isascii():
        return word.lower()
    return "".join(c for c in unicodedata.normalize("NFD", word.casefold()) if not unicodedata.combining(c))


_BRACKET_AT = r"\s?[\[({<]\s?(?:at|@)\s?[\])}>]\s?"
_WORD_DOT = r"(?:\s?[\[({<]\s?(?:dot|\.)\s?[\])}>]\s?|\sdot\s)"
_DOT = rf"(?:\.|{_WORD_DOT})"
_PART, _HOST = r"[\w%+-]+", r"[^\W_](?:[^\W_]|-)*"
_BEFORE, _AFTER = r"(?<![\w%+.-])", r"(?![\w-])"
_B, _E = r"(?<![\w#/.@-])", r"(?!\w|[-/.]\d)"
_CAP = r"[^\W\d_a-zß-ÿ](?:[^\W\d_]|['’-])*"
_UK = r"[A-Z]{1,2}\d[A-Z\d]?\s?\d[A-Z]{2}"
_UNIT = rf"(?:(?:{'|'.join(UNITS)})\.?\s?\w{{1,5}}|#\s?\w{{1,5}})"
_NO = r"\d{1,4}[a-z]?(?:\s(?:bis|ter))?"
_ENGLISH = "Street|Road|Avenue|Drive|Lane|Close|Terrace|Gardens|Crescent|Mews|Place|Court|Way|Boulevard|Blvd|Square|Hill|Grove|Row|Walk|Park|Rise|View|Parade|St|Rd|Ave|Dr|Ln"
_V = (
    r"(?:[A-Z]{1,2}\d{6,8}|[XYZ]\d{7}[ -]?[A-Z]|\d{8}[ -]?[A-Z]|\d{3}[ .-]\d{2}[ .-]\d{4}|\d{3}[ .-]\d{3}[ .-]\d{3,4}|\d{2}[ .]\d{3}[ .]\d{3}[ .]\d{3}|"
    r"\d{4}[ -]\d{4}[ -]\d{4}|[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D]|\d{9,13})"
)
# what a token can begin: the forms are tried only where their first token stands
NUMBER, UNIT, ID_LABEL, SIGN, CODE, GERMAN, CUE, WAY = (1 << i for i in range(8))
_LABEL_STARTS = frozenset("ssn soc social pesel dni nif nie aadhaar uid nhs steuer steuerid idnr tax travel passport reisepass reisepassnr national sozialversicherungsnummer id".split())
#: forms by group with the kinds of tokens they begin with
FORMS: dict[str, tuple[int, list[re.Pattern]]] = {
    "abroad": (NUMBER | SIGN, [re.compile(rf"{_B}(?:\+|00)\d{{1,3}}[ .\-/]?(?:\(0\))?[ .\-/]?(?:\(?\d{{1,5}}\)?[ .\-/]?){{2,6}}(?<=\d){_E}")]),
    "national": (NUMBER | SIGN, [re.compile(_B + "(?:" + "|".join((
        r"(?:1[ .-])?\(\d{3}\)[ ]?\d{3}[ .-]\d{4}", r"(?:1[ .-])?\d{3}(?P<s>[ .-])\d{3}(?P=s)\d{4}", r"0\d{4}[ ./-]\d{6}", r"0\d{2}[ ./-]\d{4}[ .-]\d{4}",
        r"0\d{3}[ -]\d{3}[ -]\d{4}", r"0\d{1,4}[ ./-]\d{4,6}[ .-]\d{2,4}", r"0\d(?P<t>[ .-])\d{2}(?:(?P=t)\d{2}){3}",
    )) + ")" + _E)]),
    "labelled": (ID_LABEL, [re.compile(rf"(?i)(?<!\w)(?:{ID_LABELS})(?:\s?[:=.#]\s?|\s(?:is|ist|es|no\.?|nr\.?)\s|\s){{1,2}}(?P<v>{_V})(?!\w|[-/.]\d)")]),
    "number": (NUMBER | CODE, [re.compile(rf"{_B}{_V}{_E}")]),
    "english": (NUMBER | UNIT, [re.compile(
        rf"{_B}(?:(?i:{_UNIT}),?\s)?{_NO},?[ ]{_CAP}(?:[ ]{_CAP})??[ ](?:{_ENGLISH})\b\.?(?:,?[ ](?i:{_UNIT})\b)?(?:,\s{_CAP}(?:[ ]{_CAP})?(?:,?[ ]{_UK}\b|,[ ][A-Z]{{2}}[ ]\d{{5}}\b)?)?{_E}"
    )]),
    "french": (NUMBER, [re.compile(
        rf"{_B}{_NO},?[ ](?i:rue|avenue|boulevard|chemin|place|quai|allée|impasse|route|cours)[ ](?:(?:du|des|de la|de|de l['’]|la|le)[ ]?)?{_CAP}(?:[ ]{_CAP})?(?:,?\s\d{{5}}[ ]{_CAP}(?:[ ]{_CAP})?)?{_E}"
    )]),
    "southern": (WAY, [re.compile(
        rf"(?<!\w)(?i:calle|avenida|plaza|paseo|via|viale|corso|piazza|rua)[ ](?:(?:de la|del|de|della|di|da|do)[ ])?{_CAP}(?:[ ]{_CAP})?,?[ ](?:n[.º°]?[ ]?)?\d{{1,4}}[a-z]?(?:,?\s\d{{5}}[ ]{_CAP}(?:[ ]{_CAP})?)?{_E}"
    )]),
}
_LOCAL, _DOMAIN = re.compile(rf"{_BEFORE}{_PART}(?:\.{_PART})*$"), re.compile(rf"@{_HOST}(?:\.{_HOST})*\.[^\W\d_]{{2,}}{_AFTER}")
_SPELLED = [
    re.compile(rf"(?i){_BEFORE}{_PART}(?:{_DOT}{_PART})*{_BRACKET_AT}{_HOST}(?:{_DOT}{_HOST})*{_DOT}[^\W\d_]{{2,}}{_AFTER}"),
    re.compile(rf"(?i){_BEFORE}{_PART}(?:{_DOT}{_PART})*(?:@|\sat\s){_HOST}(?:{_DOT}{_HOST})*{_WORD_DOT}[^\W\d_]{{2,}}{_AFTER}"),
]
_GERMAN = re.compile(
    rf"{_B}(?:(?i:am|an der|im|auf der|zum|zur)[ ])?[^\W\d_a-zß-ÿ](?:[^\W\d_]|-)*?(?i:{'|'.join(map(re.escape, GERMAN_ENDS))})[ ]?\d{{1,4}}[ ]?[a-z]?\b(?:,?\s\d{{5}}[ ]{_CAP}(?:[ ]{_CAP})?)?{_E}"
)
GROUPS = ["mail", "spelled", *FORMS, "german"]
NUMBERS = ("abroad", "national", "number")
JOINED = re.compile(rf"(?i)\s*(?:[,;/&|]|[,;]?\s(?:{JOINING})\s)\s*")
#: characters around a sign of a spelled or mail address that are looked at
REACH = 120


def beginnings(token: str) -> int:
    """Which forms a token can begin or give a sign of."""
    if token[0].isdigit():
        return NUMBER
    low = token.lower()
    return (
        UNIT * (low in UNITS or token == "#") | ID_LABEL * (low in _LABEL_STARTS) | SIGN * (token in "+(") | CODE * (len(token) <= 2 and token.isupper())
        | GERMAN * low.endswith(("straße", "strasse", "str", "weg", "gasse", "platz", "allee", "ring", "damm", "ufer")) | CUE * (low in ("dot", "at")) | WAY * (low in SOUTHERN)
    )


def _windows(places: list[int], reach: int) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for p in places:
        if out and p - reach <= out[-1][1]:
            out[-1] = (out[-1][0], p + reach)
        else:
            out.append((max(0, p - reach), p + reach))
    return out


def matches(joined: str, start: np.ndarray, kinds: np.ndarray) -> dict[str, list[tuple[int, int]]]:
    """Spans of every group of forms in the joined texts of a batch, whose tokens begin at ``start`` and have the ``kinds`` of ``beginnings``.

    A labelled number's span is the number's. No form reaches over the break between two texts.
    """
    out: dict[str, list[tuple[int, int]]] = {g: [] for g in GROUPS}
    for group, (mask, patterns) in FORMS.items():
        places = start[np.flatnonzero(kinds & mask)].tolist()
        name = "v" if group == "labelled" else 0
        for pattern in patterns:
            match, done = pattern.match, 0
            for p in places:
                if p >= done:
                    m = match(joined, p)
                    if m:
                        done = m.end()
                        out[group].append(m.span(name))
    at = joined.find("@")
    while at >= 0:
        right = _DOMAIN.match(joined, at)
        left = _LOCAL.search(joined, max(0, at - REACH), at) if right else None
        if left:
            out["mail"].append((left.start(), right.end()))
        at = joined.find("@", right.end() if right else at + 1)
    for a, z in _windows(start[np.flatnonzero(kinds & CUE)].tolist(), REACH):
        for pattern in _SPELLED:
            out["spelled"] += [m.span() for m in pattern.finditer(joined, a, z)]
    for a, z in _windows(start[np.flatnonzero(kinds & GERMAN)].tolist(), REACH):
        out["german"] += [m.span() for m in _GERMAN.finditer(joined, a, z)]
    return out


def form(value: str) -> str:
    """Lengths of the runs of digits of a number and the marks between them."""
    return re.sub(r"[A-Za-z]+", "A", re.sub(r"[0-9]+", lambda m: str(len(m.group())), value))


def shape(token: str) -> str:
    if token.isdigit():
        return f"d{min(len(token), 5)}"
    if not token[:1].isalpha():
        return "punct"
    if len(token) == 1:
        return "X" if token.isupper() else "x"
    return "XX" if token.isupper() else "Xx" if token[:1].isupper() else "xx"


#: what a word is, as far as a list tells; classes of neighbours are weighed together
CLASSES = ["none", "given", "initial", "particle", "title", "organisation", "street", "unit", "capital", "upper", "lower", "number", "punct", "stop"]
_KIND = {w: c for c, words in (("given", GIVEN), ("particle", PARTICLES), ("title", TITLES), ("organisation", ORGANISATIONS), ("street", STREETS), ("unit", UNITS)) for w in words}


def word_class(token: str, given: frozenset[str]) -> str:
    kind = shape(token)
    if kind[0] == "d":
        return "number"
    if kind == "punct":
        return "stop" if token in ".!?;:" else "punct"
    key = name_key(token)
    listed = _KIND.get(key) or _KIND.get(token.lower())
    if listed and listed != "given":
        return listed
    if listed == "given" or key in given:
        return "given"
    return {"X": "initial", "x": "lower", "XX": "upper", "Xx": "capital", "xx": "lower"}[kind]
