"""Personal data in single values: mail addresses, phone numbers, dates of birth, postal addresses, names."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

from lodescan.engine import tokens as tk
from lodescan.engine.reading import Hit, Reading, Vocabulary

PII = "PII"
# Words beside a value that speak for its detector.
MAIL_WORDS = Vocabulary("email, e-mail, mail, contact")
PHONE_WORDS = Vocabulary("phone, mobile, cell, telephone, tel, whatsapp, fax, msisdn, call, contact")
BIRTH_WORDS = Vocabulary("birth, born, dob, birthday, birthdate")
ADDRESS_WORDS = Vocabulary("address, street, city, zip, zipcode, postal, postcode, pincode, shipping, billing, residence, resides")

# Domains and endings of demonstration addresses, names of mailboxes that belong to no person.
DEMO_DOMAINS = frozenset("""
example.com example.org example.net example.edu example.co.uk test.com domain.com yourdomain.com yourcompany.com mydomain.com mycompany.com company.com
sample.com foo.com bar.com foo.bar abc.com xyz.com test.test tempuri.org localhost localhost.localdomain domain.tld email.tld host.com site.com
server.com e.mail no.reply noreply.com nowhere.com nothing.com fake.com dummy.com placeholder.com invalid.com none.com null.com changeme.com mailinator.com
""".split())
DEMO_ENDINGS = (".example", ".test", ".invalid", ".localhost", ".local", ".internal", ".lan", ".example.com", ".example.org", ".example.net")
ROLES = frozenset("""
mailer-daemon bounce bounces devnull nobody postmaster notification notifications alert alerts newsletter github-actions dependabot renovate
firstname.lastname first.last youremail your.email yourname your.name name@example email e-mail
""".split())
ROLE_OPENINGS = ("noreply", "no-reply", "donotreply", "donot-reply", "do-notreply", "do-not-reply", "bounce+", "bounces+", "bounce-", "bounces-")

_ATOM = r"A-Za-z0-9!#$%&'*+/=?^_`{|}~-"
_LABEL = r"[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?"
MAIL = re.compile(rf"[.{_ATOM}]{{1,64}}@(?:{_LABEL}\.)+[A-Za-z]{{2,24}}(?![A-Za-z0-9])")


def email_problem(address: str, endings: frozenset[str] = frozenset()) -> str | None:
    """Why an address is no person's: malformed, demo, tld, numeric-label, no-letter, role or message-id; ``endings`` are the known top-level domains, if given."""
    local, at, domain = address.rpartition("@")
    if not (local and at and domain):
        return "malformed"
    labels = domain.lower().split(".")
    base = local.casefold()
    opaque = len(local) >= 20 and re.fullmatch(r"[\w+=-]+", local, re.ASCII) and re.search(r"\d", local) and local != base
    checks = {
        "demo": domain.lower() in DEMO_DOMAINS or domain.lower().endswith(DEMO_ENDINGS),
        "tld": bool(endings) and labels[-1] not in endings,
        "numeric-label": any(not set(x) - set("0123456789-") for x in labels[:-1]),
        "no-letter": local.upper() == base.lower() == local.lower(),
        "malformed": "" in local.split("."),
        "role": base in ROLES or base.startswith(ROLE_OPENINGS) or base.endswith(("[bot]", "-bot")),
        "message-id": bool(opaque),
    }
    return next((reason for reason, holds in checks.items() if holds), None)


def mail_addresses(r: Reading, endings: frozenset[str]) -> Iterator[Hit]:
    if "@" not in r.text:
        return
    for m in MAIL.finditer(r.text):
        dots = len(m.group()) - len(m.group().lstrip("."))
        value, span = m.group()[dots:], (m.start() + dots, m.end())
        problem = email_problem(value, endings)
        if problem not in (None, "role", "message-id"):
            continue
        hint = "Email" in r.field.hints
        word = None if problem else r.near(MAIL_WORDS, *span)
        score = 0.6 if problem else 0.95 if word or hint else 0.85
        yield Hit("Email", PII, "Medium", value, *span, score, word=word, hint=hint and not problem)


# --- phone numbers ---------------------------------------------------------------------------------------------

CALLING_CODES = frozenset("""
1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98 211 212 213 216 218
220 221 222 223 224 225 226 227 228 229 230 231 232 233 234 235 236 237 238 239 240 241 242 243 244 245 248 249 250 251 252 253 254 255 256 257 258 260 261
262 263 264 265 266 267 268 269 290 291 297 298 299 350 351 352 353 354 355 356 357 358 359 370 371 372 373 374 375 376 377 378 380 381 382 383 385 386 387
389 420 421 423 500 501 502 503 504 505 506 507 508 509 590 591 592 593 594 595 596 597 598 599 670 672 673 674 675 676 677 678 679 680 681 682 683 685 686
687 688 689 690 691 692 850 852 853 855 856 880 886 960 961 962 963 964 965 966 967 968 970 971 972 973 974 975 976 977 992 993 994 995 996 998
""".split())
# Endings of numbers that documentation uses.
DOCUMENTED = ("1234567890", "0123456789", "0000000000", "1111111111", "800123456")
_NANP = r"(?:1[ .-])?\(?[2-9]\d{2}\)?[ .-]?[2-9]\d{2}[ .-]?\d{4}"
#: national forms by region, from the public numbering plans
NATIONAL = {region: re.compile(rf"(?<![\w+.-])(?:{form})(?![\w-])") for region, form in {
    "US": _NANP, "CA": _NANP, "GB": r"\(?0[1237]\d{1,4}\)?[ -]?\d{3,4}[ -]?\d{3,4}", "IN": r"(?:0[ -]?)?[6-9]\d{4}[ -]?\d{5}",
    "DE": r"0[1-9]\d{1,4}[ /-]?\d{3,8}(?:[ -]?\d{1,4})?", "FR": r"0[1-9](?:[ .-]?\d{2}){4}", "ES": r"[6-9]\d{2}(?:[ -]?\d{3}){2}|[6-9]\d{2}(?:[ -]?\d{2}){3}",
    "IT": r"(?:3\d{2}|0\d{1,3})[ -]?\d{5,8}", "AU": r"\(?0[2-578]\)?[ -]?\d{4}[ -]?\d{4}|04\d{2}[ -]?\d{3}[ -]?\d{3}", "PL": r"[4-8]\d{2}[ -]?\d{3}[ -]?\d{3}",
    "SE": r"0\d{1,3}[ -]\d{2,3}[ -]?\d{2,3}[ -]?\d{2}", "SG": r"[3689]\d{3}[ -]?\d{4}", "KR": r"01\d[ -]?\d{3,4}[ -]?\d{4}", "ZA": r"0[1-8]\d[ -]?\d{3}[ -]?\d{4}",
}.items()}
NATIONAL_DIGITS = {"GB": (10, 11), "DE": (7, 12)}
_ABROAD = re.compile(r"(?<![\w.+-])(?:\+|00)[1-9]\d{0,2}[ .()/-]*(?:\d[ .()/-]*){6,12}(?<=\d)(?!\w)")
_ANY_PHONE = re.compile(r"\+?\(?\d[\d\s().\-/]{5,22}\d")


def _digits(text: str) -> str:
    return "".join(c for c in text if c.isdigit())


def _dialled(number: str) -> bool:
    """A calling code and a length that numbers abroad have; for code 1 the form of its plan as well."""
    number = number.removeprefix("00")
    code = next((number[:k] for k in (3, 2, 1) if number[:k] in CALLING_CODES), None)
    if code is None or not 8 <= len(number) <= 15:
        return False
    return code != "1" or (len(number) == 11 and number[1] not in "01" and number[4] not in "01")


def _for_show(text: str, start: int, end: int) -> bool:
    """A number from documentation, or the digits behind a decimal point."""
    return _digits(text[start:end]).endswith(DOCUMENTED) or (start > 1 and text[start - 1] == "." and text[start - 2].isdigit())


def phones(r: Reading, regions: tuple[str, ...]) -> Iterator[Hit]:
    """Numbers abroad stand alone; national ones need a region and a word or a field that speaks for them."""
    hint, used = "Phone Number" in r.field.hints, []
    if r.n_digits < 7:
        return

    def fresh(start: int, end: int) -> bool:
        return all(end <= a or b <= start for a, b in used)

    for m in _ABROAD.finditer(r.text):
        if _dialled(_digits(m.group())):
            used.append(m.span())
            if not _for_show(r.text, *m.span()):
                yield Hit("Phone Number", PII, "Medium", m.group(), *m.span(), 0.85, word=r.near(PHONE_WORDS, *m.span()), hint=hint)
    for region in regions:
        least, most = NATIONAL_DIGITS.get(region, (7, 15))
        for m in NATIONAL[region].finditer(r.text) if region in NATIONAL else ():
            if not fresh(*m.span()) or not least <= len(_digits(m.group())) <= most:
                continue
            word = r.near(PHONE_WORDS, *m.span())
            used.append(m.span())
            if (word or hint) and not _for_show(r.text, *m.span()):
                yield Hit("Phone Number", PII, "Medium", m.group(), *m.span(), 0.85, word=word, hint=hint, marks=(f"region:{region}",))
    whole = r.text.strip()
    if hint and not used and _ANY_PHONE.fullmatch(whole) and 7 <= r.n_digits <= 15 and len(set(_digits(whole))) > 2:
        yield Hit("Phone Number", PII, "Medium", whole, 0, len(r.text), 0.6, hint=True, exempt=True)


# --- dates of birth --------------------------------------------------------------------------------------------

BIRTH_YEARS = range(1930, 2013)
_MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
_NUMERIC_DATE = re.compile(r"(?<!\w)(?:(?P<y>\d{4})[-/.](?P<m>\d\d)[-/.](?P<d>\d\d)|(?P<d2>\d\d?)[-/.](?P<m2>\d\d?)[-/.](?P<y2>\d{4}))(?!\w)")
_WRITTEN_DATE = re.compile(
    r"(?i)(?<!\w)(?:(?P<d>\d\d?)(?:st|nd|rd|th)?\s+(?P<m>[a-z]{3,9})\.?,?|(?P<m2>[a-z]{3,9})\.?\s+(?P<d2>\d\d?)(?:st|nd|rd|th)?,?)\s+(?P<y>\d{4})(?!\w)"
)


def dates(text: str) -> Iterator[tuple[int, int, int]]:
    """(start, end, year) of plain dates, year first or last, month as number or word."""
    for m in _NUMERIC_DATE.finditer(text):
        year, month, day = (int(m[a] or m[b]) for a, b in (("y", "y2"), ("m", "m2"), ("d", "d2")))
        if 1 <= month <= 12 and 1 <= day <= 31:
            yield *m.span(), year
    for m in _WRITTEN_DATE.finditer(text):
        if (m["m"] or m["m2"])[:3].lower() in _MONTHS and 1 <= int(m["d"] or m["d2"]) <= 31:
            yield *m.span(), int(m["y"])


def births(r: Reading) -> Iterator[Hit]:
    hint = "Date of Birth" in r.field.hints
    for start, end, year in dates(r.text):
        if year in BIRTH_YEARS:
            word = r.near(BIRTH_WORDS, start, end)
            yield Hit("Date of Birth", PII, "Medium", r.text[start:end], start, end, 0.85 if word or hint else 0.4, word=word, hint=hint)


# --- postal addresses ------------------------------------------------------------------------------------------

# Kinds of streets, the telling ones first.
SURE_STREETS = frozenset("""
street road avenue lane boulevard drive sector apartment suite highway parkway crescent terrace nagar marg colony enclave vihar expressway bypass
strasse straße avenida calle piazza corso gardens estate heights
""".split())
STREETS = SURE_STREETS | frozenset("""
st rd ave ln blvd dr court ct place pl square sq ter way hwy pkwy circle cir cres close trail trl apt ste floor fl layout chowk gali cross alley row
walk grove park hill hills mews quay wharf plaza str allee platz weg gasse rue via
""".split())
# Words before a number that make it a count, a port or a version; names of address fields; owners of addresses that are no postal ones.
COUNTED = ("port", "version", "line", "page", "chapter", "section", "step", "error", "status", "code", "level", "v", "http", "tcp", "udp", "id", "no", "no.",
           "number", "#", "size", "count", "total", "x")
ADDRESS_KEYS = (
    r"street(?:_?address|_?name|_?\d)?|address_?line_?\d?|addr(?:ess)?(?:_?\d)?|(?:shipping|billing|home|postal|mailing|residential)_?address|"
    r"zip(?:_?code)?|postal_?code|post_?code|pin_?code"
)
NOT_POSTAL = tuple("""
advertise api secure insecure tls etcd master cert metrics health admin external loopback http https ip ipv4 ipv6 mac email e-mail wallet contract memory
server host remote client bind listen local public private elastic network gateway dns url web site proxy source dest destination sender receiver from to
reply return origin target endpoint peer node cluster service pod container virtual physical base start end load stack heap bus register io i/o hex byte
block sector ldap smtp ntp ipaddr ip_addr
""".split())
UNIT_WORDS = r"sector|block|plot|flat|house|h\.?\s?no|apartment|apt|suite|unit|floor|phase|pocket|door no|shop no"
#: words of a street's name at most, characters a reported value has at most (the reported value, not what is searched)
NAME_WORDS, MOST_REPORTED = 4, 200

_HOUSE = re.compile(r"(?<![\w/.-])\d{1,6}[A-Za-z]?(?:[/-]\d{1,5})?(?=[ \t,])")
_STEP = re.compile(r"[ \t]+([^\W\d_][^\W\d_'.-]*(?:['.-]+[^\W\d_]*)*)")
_FIRST_STEP = re.compile(r"[ \t,]+([^\W\d_][^\W\d_'.-]*(?:['.-]+[^\W\d_]*)*)")
_REST = re.compile(r"(?:[ \t,]+(?:[^\W\d_](?:[^\W\d_]|['.-])*|#\s?\d+|\d{3,10}))*")
_STREET_WORD = re.compile(rf"(?i)\b(?:{'|'.join(sorted(STREETS, key=len, reverse=True))})\b")
_POSTCODE = re.compile(r"\b(?:\d{5}(?:-\d{4})?|\d{6}|[A-Z]{1,2}\d[A-Z\d]?\s?\d[A-Z]{2}|[A-Z]\d[A-Z]\s?\d[A-Z]\d)\b")
_KEYED = re.compile(rf"(?i)(?<![A-Za-z0-9_])[\"']?(?P<key>{ADDRESS_KEYS})[\"']?\s*[:=]\s*[\"']?(?P<val>[^\"'\n,;{{}}\[\]]{{2,120}})")
_UNIT = re.compile(rf"(?i)\b(?:{UNIT_WORDS})\.?\s?(?:no\.?\s?)?#?\s?\d{{1,5}}[A-Za-z]?\b")


def _street(text: str, at: int) -> tuple[str, bool, int] | None:
    """Kind of street, whether it has a name, and its end, of the words that follow a house number."""
    for n in range(NAME_WORDS + 1):
        m = (_STEP if n else _FIRST_STEP).match(text, at)
        if not m:
            return None
        word = m.group(1).lower()
        kind = word.rstrip(".") if word.rstrip(".") in STREETS else None
        if kind:
            dotted = word.endswith(".")
            return kind, n > 0, m.end() - (len(word) - len(kind) - 1 if dotted else 0)
        at = m.end()
    return None


def _numbered_streets(r: Reading) -> Iterator[Hit]:
    text, at, hint = r.text, 0, "Address" in r.field.hints
    if not r.has_digit or not _STREET_WORD.search(text):
        return
    for m in _HOUSE.finditer(text):
        found = _street(text, m.end()) if m.start() >= at else None
        if not found:
            continue
        kind, named, end = found
        whole = _REST.match(text, end).end()
        before = r.lowered[max(0, m.start() - 24):m.start()].rstrip()
        sure = kind in SURE_STREETS
        if not (named or sure and text[end:whole].strip(" ,\t.")) or before.endswith(COUNTED):
            continue
        at = whole
        word = r.near(ADDRESS_WORDS, m.start(), whole)
        backed = hint or word or _POSTCODE.search(text, whole, whole + 80)
        value = text[m.start():whole].strip(" ,")[:MOST_REPORTED]
        yield Hit("Address", PII, "Medium", value, m.start(), m.start() + len(value), 0.85 if backed or sure and named else 0.6, word=word, hint=hint)


def _postal_value(key: str, value: str) -> bool:
    digits, letters = any(c.isdigit() for c in value), any(c.isalpha() for c in value)
    if key.startswith(("zip", "postal", "post", "pin")) and "address" not in key:
        return digits and re.fullmatch(r"[A-Za-z0-9 -]{3,10}", value) is not None
    plain = not value.startswith(("http", "0x", "/", "arn:", "--")) and "://" not in value
    return letters and plain and len(value) >= 4 and (digits or len(value.split()) > 1)


def _keyed_addresses(r: Reading) -> Iterator[Hit]:
    for m in _KEYED.finditer(r.text):
        owner = r.lowered[max(0, m.start("key") - 14):m.start("key")]
        owner = owner[:-1] if owner.endswith((" ", "_", ".", "-")) else owner
        value = m["val"].strip()
        if owner.endswith(NOT_POSTAL) or tk.placeholder(value) or not _postal_value(m["key"].lower(), value):
            continue
        yield Hit("Address", PII, "Medium", f"{m['key']}: {value}"[:MOST_REPORTED], m.start("key"), m.end("val"), 0.85, marks=(f"key:{m['key']}",))


def addresses(r: Reading) -> Iterator[Hit]:
    """Numbered streets, address keys with their values, whole address fields, and units beside any of these."""
    found = [*_numbered_streets(r), *_keyed_addresses(r)]
    whole = r.text.strip()
    if "Address" in r.field.hints and not found and 4 <= len(whole) <= MOST_REPORTED and not tk.placeholder(whole):
        parts = any(c.isdigit() for c in whole) or "," in whole or len(whole.split()) >= 3
        if parts and "://" not in whole and whole[0] not in "{[":
            found.append(Hit("Address", PII, "Medium", whole, 0, len(r.text), 0.85, hint=True, marks=(f"key:{r.name}",)))
    yield from found
    for m in _UNIT.finditer(r.text) if found else ():
        beside = any(abs(h.start - m.start()) < 80 for h in found)
        if beside and not any(h.start <= m.start() and m.end() <= h.end for h in found):
            yield Hit("Address", PII, "Medium", m.group(), *m.span(), 0.85)


# --- names -----------------------------------------------------------------------------------------------------

# Labels of names, owners of names that are no people, openers that are no names, values that stand for nobody, endings of organisations.
NAME_LABELS = """
first name, last name, surname, given name, family name, middle name, full name, patient name, customer name, employee name, applicant name,
account holder, cardholder name, contact name, name, borrower, co-borrower, guarantor, insured, consignee, shipper, buyer, seller, tenant, landlord,
beneficiary, shareholder, signatory, attorney, client, patient, employee, customer, applicant, holder, spouse, dependent, witness
"""
QUOTED_LABELS = "full first last sur given family middle customer employee person display contact holder patient legal real applicant cardholder owner"
NO_PERSON = frozenset("""
company business employer farm bank account campaign product project brand store vendor supplier organisation organization institution fund trust school
hospital clinic team group plan policy file user host domain server table column field display screen model device app application service agency firm
corporation entity branch merchant issuer carrier insurer ship vessel property estate building street road chemical strategy scheme programme program
portfolio index asset security bond stock ticker template report document dataset method process procedure task event item material substance compound
drug medication species variety breed trade dba
""".split())
NO_OPENING = frozenset("""
not applicable none sure yes no unknown see please thank thanks dear hello hi the this that same other various multiple any all each per as to be n/a ok
okay pending confirmed approved declined unavailable available required
""".split())
NOBODY = frozenset("""
null none test admin user unknown n/a na root guest anonymous default system name desc string value true false undefined
""".split())
ORGANISATION_ENDS = frozenset("""
bank trust holding holdings group ltd limited inc llc llp plc corp corporation company co gmbh ag sa pvt pty enterprise enterprises industries partners
associates solutions services systems technologies labs motors farm farms foundation institute university college hospital clinic insurance capital
investment investments ventures fund agency council ministry department authority association federation union church school store market hotel airline
airlines logistics consulting
""".split())
SINGLE = frozenset("first last given family middle sur surname".split())

_NAME_WORD = re.compile(r"[^\W\d_](?:[^\W\d_]|['’.-]){0,30}")
_CAPITAL = r"(?:[^\W\d_a-zß-ÿ]\.|[^\W\d_a-zß-ÿ](?:[^\W\d_]|['’-])+)"
_SAID_NAME = re.compile(
    rf"(?<![A-Za-z])\**(?P<key>(?i:{'|'.join(sorted((x.strip() for x in NAME_LABELS.split(',')), key=len, reverse=True))}))\**\s*[:\-]\s*\**\s*"
    rf"(?P<val>{_CAPITAL}(?:[ \t]{_CAPITAL}){{0,3}})(?![^\W_])"
)
_QUOTED_NAME = re.compile(
    rf"(?i)(?<![A-Za-z0-9_])[\"']?(?P<key>(?:{'|'.join(QUOTED_LABELS.split())})_?name)[\"']?\s*[:=]\s*[\"'](?P<val>[^\"'\n]{{2,80}})[\"']"
)
#: a function of a text that yields (start, end, word that speaks for it or None) of names in prose
NamesInProse = Callable[[str], list[tuple[int, int, str | None]]]


def like_person(value: str) -> bool:
    """One to four words of letters that can name a person: none of them a stand-in, the last no organisation's ending."""
    words = value.strip().split()
    if not 1 <= len(words) <= 4 or len(value.strip()) > 80 or not all(_NAME_WORD.fullmatch(w) for w in words) or len(words[0]) < 2:
        return False
    low = value.strip().lower()
    voiced = any(set(w) & set("aeiouyAEIOUY") or not w.isascii() for w in words)
    return voiced and low not in NOBODY and low.split()[-1].rstrip(".") not in ORGANISATION_ENDS and not re.search(r"(.)\1{3}", low)


def names(r: Reading, in_prose: NamesInProse | None = None) -> Iterator[Hit]:
    """A name field's value, quoted and labelled names, and what a model given by the caller finds in prose."""

    def named(value: str, start: int, end: int, **more) -> Hit:
        return Hit("PII.PersonName", PII, "Low", value, start, end, more.pop("score", 0.85), **more)

    secret = r.field.kind == "credential"
    whole = r.text.strip()
    if "PII.PersonName" in r.field.hints and not secret and like_person(whole):
        if len(whole.split()) > 1 or not SINGLE.isdisjoint(r.field.words.split()):
            yield named(whole, 0, len(r.text), hint=True)
            return
    taken: list[tuple[int, int]] = []
    for pattern in (_QUOTED_NAME, _SAID_NAME) if ":" in r.text or "=" in r.text or "-" in r.text else ():
        for m in pattern.finditer(r.text):
            key, value, start = m["key"].lower(), m["val"].strip(), m.start("val")
            value = value.rstrip(".") if pattern is _SAID_NAME else value
            single = not SINGLE.isdisjoint(re.split(r"[ _]|(?=name)", key))
            owner = re.findall(r"[A-Za-z]+", r.lowered[max(0, m.start("key") - 40):m.start("key")])
            if (
                any(a <= start < b for a, b in taken) or not like_person(value) or not (single or len(value.split()) > 1)
                or pattern is _SAID_NAME and (value.split()[0].lower().rstrip(",.") in NO_OPENING or key == "name" and owner and owner[-1] in NO_PERSON)
            ):
                continue
            taken.append((start, start + len(value)))
            yield named(value, start, start + len(value), marks=(f"key:{m['key']}",))
    if in_prose and not secret and len(r.text) >= 30 and sum(any(c.isalpha() for c in w) for w in r.text.split()) >= 6:
        for start, end, word in in_prose(r.text):
            value = r.text[start:end]
            if not any(a <= start and end <= b for a, b in taken) and 2 <= len(value.split()) <= 4 and like_person(value):
                yield named(value, start, end, score=0.85 if word else 0.6, word=word)


def personal(r: Reading, regions: tuple[str, ...] = (), endings: frozenset[str] = frozenset(), in_prose: NamesInProse | None = None) -> Iterator[Hit]:
    yield from mail_addresses(r, endings)
    if r.has_digit:
        yield from phones(r, regions)
        yield from births(r)
    yield from addresses(r)
    yield from names(r, in_prose)
