"""Scalar functions as expressions of the engine itself: checks, fingerprints, shapes, places."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodescan.engine.money import NETWORKS, leading

# Rows of the Verhoeff multiplication and permutation tables, as one string each.
_MULTIPLY = "0123456789123406789523401789563401289567401239567859876043216598710432765982104387659321049876543210"
_PERMUTE = "01234567891576283094580379614289160435279453126870428657390127938064157046913258"


def digits_only(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def sanitized(value: Column) -> Column:
    return F.translate(value, " -.", "")


def digit_array(value: Column) -> Column:
    """Digits of an all-digit text as integers; empty for the empty text."""
    return F.transform(F.filter(F.split(value, ""), lambda c: c != ""), lambda c: c.try_cast("int"))


def luhn(value: Column, least: int = 13, most: int = 19) -> Column:
    """Luhn check of a value's digits, false unless their number lies in the bounds."""
    line = digits_only(value)
    return F.length(line).between(least, most) & _luhn_sum(line)


def _luhn_sum(line: Column) -> Column:
    ds = digit_array(F.reverse(line))
    doubled = F.transform(ds, lambda d, i: F.when(i % 2 == 0, d).when(d > 4, d * 2 - 9).otherwise(d * 2))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + d) % 10 == 0


def weighted_sum(value: Column, weights: list[int]) -> Column:
    pairs = F.zip_with(digit_array(value), F.array(*[F.lit(w) for w in weights]), lambda d, w: d * w)
    return F.aggregate(F.filter(pairs, lambda x: x.isNotNull()), F.lit(0), lambda a, x: a + x)


def weighted_check(value: Column, weights: list[int], modulus: int, remainder: int = 0) -> Column:
    return (F.length(value) == len(weights)) & (weighted_sum(value, weights) % modulus == remainder)


def iban_mod97(value: Column) -> Column:
    """ISO 13616 check of an account number: letters become numbers, the remainder by 97 is taken piece by piece."""
    flat = F.upper(F.translate(value, " -", ""))
    turned = F.concat(F.substr(flat, F.lit(5)), F.substring(flat, 1, 4))
    step = lambda a, c: (a * F.when(c.rlike("[0-9]"), 10).otherwise(100) + F.when(c.rlike("[0-9]"), c.try_cast("int")).otherwise(F.ascii(c) - 55)) % 97
    rest = F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), lambda a, c: step(a, c).try_cast("int"))
    return F.coalesce(flat.rlike("^[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}$") & (rest == 1), F.lit(False))


def verhoeff(value: Column) -> Column:
    """Verhoeff check of an all-digit text; false for the empty one."""
    ds = F.transform(digit_array(F.reverse(value)), lambda d, i: F.struct((i % 8).try_cast("int").alias("i"), d.alias("d")))
    permuted = F.transform(ds, lambda x: F.substring(F.lit(_PERMUTE), x["i"] * 10 + x["d"] + 1, F.lit(1)).try_cast("int"))
    state = F.aggregate(permuted, F.lit(0), lambda a, d: F.substring(F.lit(_MULTIPLY), a * 10 + d + 1, F.lit(1)).try_cast("int"))
    return (F.length(value) > 0) & (state == 0)


def entropy(value: Column) -> Column:
    """Shannon entropy of the characters in bits; 0 for the empty text."""
    chars = F.filter(F.split(value, ""), lambda c: c != "")
    n = F.size(chars)
    counts = F.transform(F.array_distinct(chars), lambda c: F.size(F.filter(chars, lambda x: x == c)))
    return F.aggregate(counts, F.lit(0.0), lambda a, k: a - (k / n) * F.log2(k / n))


def fingerprint(value: Column) -> Column:
    return F.substring(F.sha2(value, 256), 1, 16)


def card_network(number: Column) -> Column:
    """The issuer whose range a number of digits begins in, if it has a length of that issuer's: the same table as the detector's."""
    out = None
    for name, ranges, lengths in NETWORKS:
        begins = F.lit(False)
        for k, first, last in leading(ranges):
            begins = begins | F.substring(number, 1, k).try_cast("int").between(first, last)
        mine = F.when(F.length(number).isin(*lengths), name)
        out = F.when(begins, mine) if out is None else out.when(begins, mine)
    return out


def private_ipv4(value: Column) -> Column:
    """Whether a dotted quad is private, loopback, link-local, shared, multicast, reserved or unspecified."""
    a, b = F.split_part(value, F.lit("."), F.lit(1)).try_cast("int"), F.split_part(value, F.lit("."), F.lit(2)).try_cast("int")
    return a.isin(0, 10, 127) | (a >= 224) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168)) | ((a == 169) & (b == 254))


def like_epoch(value: Column) -> Column:
    seconds = F.when(F.length(value) == 13, F.substring(value, 1, 10)).otherwise(value)
    return value.rlike("^([0-9]{10}|[0-9]{13})$") & seconds.try_cast("long").between(1_300_000_000, 2_200_000_000)


def repeated_digits(value: Column) -> Column:
    line = digits_only(value)
    groups = F.filter(F.split(value, "[^0-9]+"), lambda g: g != "")
    same = F.forall(groups, lambda g: F.size(F.array_distinct(F.filter(F.split(g, ""), lambda c: c != ""))) == 1)
    return (F.length(line) >= 6) & (same | F.lit("01234567890123456789").contains(line) | F.lit("98765432109876543210").contains(line))


def plausible_birth_year(year: Column) -> Column:
    return year.between(1930, 2012)


def email_reason(address: Column, demo_endings: tuple[str, ...], demo_domains: list[str]) -> Column:
    """Why an address is no person's address, or null."""
    local, domain = F.regexp_extract(address, "^(.*)@[^@]*$", 1), F.lower(F.regexp_extract(address, "@([^@]*)$", 1))
    ends = F.lit(False)
    for e in demo_endings:
        ends = ends | domain.endswith(e)
    return (
        F.when((local == "") | (domain == ""), "malformed")
        .when(ends | domain.isin(*demo_domains), "demo")
        .when(F.exists(F.slice(F.split(domain, r"\."), 1, F.greatest(F.size(F.split(domain, r"\.")) - 1, F.lit(0))), lambda x: x.rlike("^[0-9-]+$")), "numeric-label")
        .when(~local.rlike("[A-Za-z]"), "no-letter")
        .when(local.contains("..") | local.startswith(".") | local.endswith("."), "malformed")
    )


def line_of(text: Column, start: Column) -> Column:
    """1-based line of a 0-based place."""
    before = F.substring(text, F.lit(1), start)
    return F.length(before) - F.length(F.translate(before, "\n", "")) + 1


def column_of(text: Column, start: Column) -> Column:
    """1-based column of a 0-based place in its line."""
    return F.length(F.substring_index(F.substring(text, F.lit(1), start), "\n", -1)) + 1


def singular(word: Column) -> Column:
    """Singular of a plural in -ies or -s; short words and those in -ss stay."""
    n = F.length(word)
    plain = (n > 3) & word.endswith("s") & ~word.endswith("ss")
    return F.when((n > 4) & word.endswith("ies"), F.regexp_replace(word, "ies$", "y")).when(plain, F.regexp_replace(word, "s$", "")).otherwise(word)


def masked_name(name: Column) -> Column:
    """The first letter of each word of a name, the rest as stars."""
    words = F.split(F.trim(name), r"\s+")
    return F.array_join(F.transform(words, lambda w: F.concat(F.substring(w, 1, 1), F.repeat(F.lit("*"), F.length(w) - 1))), " ")


def palindrome(value: Column) -> Column:
    return value == F.reverse(value)


def same_digit(value: Column) -> Column:
    """Whether all digits of a value are one and the same; false where there is none."""
    line = digits_only(value)
    return (F.length(line) > 0) & (F.replace(line, F.substring(line, 1, 1), F.lit("")) == "")


def masked_account_key(text: Column) -> Column:
    """Account keys and signatures in connection strings replaced by stars."""
    return F.regexp_replace(F.regexp_replace(text, r"(?i)(AccountKey=)[^;\s]+", "$1***"), r"(?i)([?&]sig=)[^&\s]+", "$1***")


def utc_timestamp(text: Column) -> Column:
    return F.try_to_timestamp(text)


def keyword_count(text: Column, words: tuple[str, ...]) -> Column:
    """Different keywords in a text."""
    lowered = F.concat(F.lit(" "), F.lower(text), F.lit(" "))
    return sum((lowered.rlike(rf"(?s)(?<![a-z0-9_]){w}(?![a-z0-9_])").try_cast("int") for w in words), F.lit(0))
