"""Financial and health data in single values."""

from __future__ import annotations

import re
from collections.abc import Iterator

from lodescan.engine import tokens as tk
from lodescan.engine.checks import compact, digits, luhn, mod97
from lodescan.engine.reading import Hit, Reading, Vocabulary

MONEY, HEALTH = "Financial Data", "Healthcare Data (PHI)"
# Words beside a value that speak for or against its detector; capitalised words that are no bank codes; countries.
CARD_WORDS = Vocabulary("card, credit, visa, mastercard, amex, cc, cvv, cvc, expiry, expiration, debit, pan, cardholder, payment")
BANK_CODE_SAID = Vocabulary("swift, bic, swift code, bic code, bank identifier")
BANK_CODE_WORDS = Vocabulary("swift, bic, iban, bank identifier, swift code, bic code, bank code")
ACCOUNT_WORDS = Vocabulary("account number, account no, acct, acc no, a/c, bank account, iban, routing, beneficiary, ifsc, sort code, bank")
NO_ACCOUNT = Vocabulary("aws, arn, subscription, project, tenant, account id, accountid, customer id, order, invoice, transaction id, cluster, namespace")
HEALTH_WORDS = (
    "patient", "diagnosis", "treatment", "prescription", "hospital", "medical", "doctor", "insurance", "health record", "icd-10", "icd10", "clinical",
    "medication", "dosage", "symptoms", "allergies", "blood type", "physician",
)
NO_BANK_CODE = frozenset("""
CERTIFICATE DESCRIPTION AUTHORITY PARAMETERS APPLICATION PROPERTIES IDENTIFIER INFORMATION DEVELOPMENT DEPRECATED REQUIREMENT ENVIRONMENT TRANSACTION
DESTINATION INSTRUCTION CONSTRUCTION METADATA CERT RESPONSE STANDARD TEMPLATE LANGUAGE SEQUENCE REGIONAL RESOLVED SOFTWARE STARTTLS MANAGERS POLICIES
EXCEEDED FAKECODE DISCOUNT WELCOME SNAPSHOT REJECTED ACCEPTED FIREWALL REPORTED
""".split())
COUNTRIES = frozenset("""
AD AE AF AG AI AL AM AO AQ AR AS AT AU AW AX AZ BA BB BD BE BF BG BH BI BJ BL BM BN BO BQ BR BS BT BV BW BY BZ CA CC CD CF CG CH CI CK CL CM CN CO CR CU CV
CW CX CY CZ DE DJ DK DM DO DZ EC EE EG EH ER ES ET FI FJ FK FM FO FR GA GB GD GE GF GG GH GI GL GM GN GP GQ GR GS GT GU GW GY HK HM HN HR HT HU ID IE IL IM
IN IO IQ IR IS IT JE JM JO JP KE KG KH KI KM KN KP KR KW KY KZ LA LB LC LI LK LR LS LT LU LV LY MA MC MD ME MF MG MH MK ML MM MN MO MP MQ MR MS MT MU MV MW
MX MY MZ NA NC NE NF NG NI NL NO NP NR NU NZ OM PA PE PF PG PH PK PL PM PN PR PS PT PW PY QA RE RO RS RU RW SA SB SC SD SE SG SH SI SJ SK SL SM SN SO SR SS
ST SV SX SY SZ TC TD TF TG TH TJ TK TL TM TN TO TR TT TV TW TZ UA UG UM US UY UZ VA VC VE VG VI VN VU WF WS XK YE YT ZA ZM ZW
""".split())
# Issuers in order of precedence, as ranges of leading digits and the lengths their numbers have.
NETWORKS = (
    ("visa", "4", (13, 16, 19)), ("amex", "34 37", (15,)), ("mastercard", "51-55 2221-2720", (16,)), ("discover", "6011 65 644-649", (16, 19)),
    ("jcb", "35", (16, 19)), ("rupay", "81 82 60 50", (16,)), ("diners", "36 38 39 300-305", (14, 16, 19)), ("unionpay", "62", (16, 17, 18, 19)),
)
#: groups of digits that cards are written in
CARD_GROUPS = {(4, 4, 4, 4), (4, 4, 4, 4, 3), (4, 6, 5), (4, 4, 5)}

_DIGIT_RUN = re.compile(r"(?<![\d-])\d+(?:[ -]\d+)*(?![\d-])")
_BANK_CODE = re.compile(r"\b[A-Z]{4}(?P<country>[A-Z]{2})[A-Z0-9]{2}(?:[A-Z0-9]{3})?\b")
_ACCOUNT = re.compile(r"(?<![\d-])\d{8,18}(?![\d-])")
_UNKNOWN_IBAN = re.compile(r"\b[A-Z]{2}\d{2}(?:[ -]?[A-Z0-9]{1,4}){3,8}\b")
_HEALTH = re.compile(r"(?i)\b(?:" + "|".join(map(re.escape, HEALTH_WORDS)) + r")\b")


def leading(ranges: str) -> list[tuple[int, int, int]]:
    """(digits, first, last) of each range of leading digits."""
    out = []
    for part in ranges.split():
        a, _, b = part.partition("-")
        out.append((len(a), int(a), int(b or a)))
    return out


_RULES = [(name, leading(ranges), lengths) for name, ranges, lengths in NETWORKS]


def card_network(number: str) -> str | None:
    """The issuer whose range a number begins in, if the number has a length of that issuer's."""
    for name, ranges, lengths in _RULES:
        if any(first <= int(number[:k]) <= last for k, first, last in ranges):
            return name if len(number) in lengths else None
    return None


def _card_spans(text: str) -> Iterator[tuple[int, int]]:
    """Runs of digits written like a card: in one piece, or in a card's groups."""
    for m in _DIGIT_RUN.finditer(text):
        groups = [(g.start(), g.end()) for g in re.finditer(r"\d+", m.group())]
        sizes = [b - a for a, b in groups]
        at = 0
        while at < len(groups):
            fit = next((k for k in (5, 4, 3) if at + k <= len(sizes) and tuple(sizes[at:at + k]) in CARD_GROUPS), 1 if 13 <= sizes[at] <= 19 else 0)
            last = m.start() + groups[at + fit - 1][1] if fit else 0
            if fit and text[last:last + 1] != "-" and not (at and text[m.start() + groups[at][0] - 1] == "-"):
                yield m.start() + groups[at][0], last
            at += max(fit, 1)


def cards(r: Reading) -> Iterator[Hit]:
    hint = "Credit Card" in r.field.hints
    for start, end in _card_spans(r.text) if r.n_digits >= 13 else ():
        written = r.text[start:end]
        number = re.sub(r"\D", "", written)
        if not luhn(digits(number)) or card_network(number) is None:
            continue
        word = r.near(CARD_WORDS, start, end)
        test = number in tk.TEST_CARDS
        score = 0.3 if test else 0.95 if word or hint else 0.6 if written == number else 0.85
        yield Hit("Credit Card", MONEY, "Critical", written, start, end, score, validated=True, word=word, hint=hint, marks=("test_card",) if test else ())


def bank_codes(r: Reading, inside: list[tuple[int, int]]) -> Iterator[Hit]:
    hint = "SWIFT/BIC" in r.field.hints
    for m in _BANK_CODE.finditer(r.text):
        if m["country"] not in COUNTRIES or m.group() in NO_BANK_CODE or any(a <= m.start() and m.end() <= b for a, b in inside):
            continue
        said = r.near(BANK_CODE_SAID, *m.span(), 40, 10)
        word = said or (any(c.isdigit() for c in m.group()) and r.near(BANK_CODE_WORDS, *m.span())) or None
        yield Hit("SWIFT/BIC", MONEY, "High", m.group(), *m.span(), 0.85 if word or hint else 0.5, word=word, hint=hint)


def bank_accounts(r: Reading, inside: list[tuple[int, int]]) -> Iterator[Hit]:
    hint = "Bank Account" in r.field.hints
    for m in _ACCOUNT.finditer(r.text) if r.n_digits >= 8 else ():
        if any(a <= m.start() and m.end() <= b for a, b in inside) or r.near(NO_ACCOUNT, *m.span(), 60, 30):
            continue
        word = r.near(ACCOUNT_WORDS, *m.span(), 80, 40)
        if word or hint:
            yield Hit("Bank Account", MONEY, "High", m.group(), *m.span(), 0.85 if hint or word != "bank" else 0.6, word=word, hint=hint)


def unknown_ibans(text: str) -> Iterator[Hit]:
    """Account numbers whose remainder is right, whatever their country's form; for sets of rules without one for IBAN."""
    for m in _UNKNOWN_IBAN.finditer(text):
        value = compact(m.group())
        if 15 <= len(value) <= 34 and mod97(value[4:] + value[:4]) == 1:
            yield Hit("IBAN", MONEY, "High", m.group(), *m.span(), 0.85, validated=True)


def financial(r: Reading, ibans: list[Hit]) -> Iterator[Hit]:
    """Cards, then bank codes and accounts outside of cards and of the account numbers found by rule."""
    found = list(cards(r))
    inside = [h.span for h in (*found, *ibans)]
    yield from found
    codes = list(bank_codes(r, inside))
    yield from codes
    yield from bank_accounts(r, inside + [h.span for h in codes])


def health(r: Reading) -> Iterator[Hit]:
    words = sorted({m.group().lower() for m in _HEALTH.finditer(r.text)})
    if len(words) > 2:
        yield Hit("Healthcare Data Detection", HEALTH, "High", f"Matched PHI Keywords: {words}", 0, len(r.text), 0.85)
