"""Checks of identifiers: True passes, False fails, None cannot tell.

Most are one of a few families: a weighted sum under a modulus, Luhn, Verhoeff, ISO 7064, mod 97, a date.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import ipaddress
import re
from collections.abc import Callable, Iterable

#: date against which time-dependent checks are made; set from the configuration, not from the clock
REFERENCE_DATE = dt.date(2026, 1, 1)




def _dihedral(a: int, b: int) -> int:
    if a < 5:
        return (a + b) % 5 if b < 5 else 5 + (a + b - 5) % 5
    return 5 + (a - 5 - b) % 5 if b < 5 else (a - b) % 5


_PERMUTED = [1, 5, 7, 6, 2, 8, 3, 0, 9, 4]


def digits(text: str) -> list[int]:
    return [int(c) for c in text if c in "0123456789"]


def compact(text: str) -> str:
    return re.sub(r"[^0-9A-Za-z]", "", text).upper()


def luhn(ds: list[int]) -> bool:
    total = 0
    for i, d in enumerate(reversed(ds)):
        d = d * 2 if i % 2 else d
        total += d - 9 if d > 9 else d
    return bool(ds) and total % 10 == 0


def verhoeff(ds: list[int]) -> bool:
    state = 0
    for i, d in enumerate(reversed(ds)):
        for _ in range(i % 8):
            d = _PERMUTED[d]
        state = _dihedral(state, d)
    return bool(ds) and state == 0


def weighted(ds: Iterable[int], weights: Iterable[int]) -> int:
    return sum(d * w for d, w in zip(ds, weights))


def mod97(text: str) -> int:
    rest = 0
    for c in text:
        rest = int(f"{rest}{int(c, 36)}") % 97
    return rest


def iso7064_11_10(ds: list[int]) -> bool:
    p = 10
    for d in ds[:-1]:
        s = (d + p) % 10 or 10
        p = s * 2 % 11
    return (11 - p) % 10 == ds[-1]


def icao(text: str) -> int:
    return sum((0 if c == "<" else int(c, 36)) * (7, 3, 1)[i % 3] for i, c in enumerate(text)) % 10


def day_month(day: int, month: int) -> bool:
    return 1 <= month <= 12 and 1 <= day <= (29 if month == 2 else 30 if month in (4, 6, 9, 11) else 31)


def number(*lengths: int) -> Callable[[str], list[int] | None]:
    """Digits of a value if it has one of the lengths."""
    return lambda v: ds if len(ds := digits(v)) in lengths else None


def _sum_check(length: int, weights: list[int], modulus: int, ok: Callable[[int, list[int]], bool]):
    def check(v: str) -> bool:
        ds = digits(v)
        return len(ds) == length and ok(weighted(ds, weights) % modulus, ds)

    return check


def _eleven(length: int, weights: list[int], last: int = -1):
    """Check digit (11 - sum) mod 11; ten is invalid."""
    return _sum_check(length, weights, 11, lambda r, ds: (11 - r) % 11 == ds[last])


def _mod11_digits(ds: list[int], weights: list[int]) -> int:
    r = weighted(ds, weights) % 11
    return 0 if r < 2 else 11 - r


def br_cpf(v: str) -> bool:
    ds = digits(v)
    return (len(ds) == 11 and len(set(ds)) > 1 and _mod11_digits(ds, list(range(10, 1, -1))) == ds[9]
            and _mod11_digits(ds, list(range(11, 1, -1))) == ds[10])


def br_cnpj(v: str) -> bool:
    ds, w = digits(v), [6, 5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2]
    return len(ds) == 14 and len(set(ds)) > 1 and _mod11_digits(ds, w[1:]) == ds[12] and _mod11_digits(ds, w) == ds[13]


def ru_inn(v: str) -> bool:
    ds = digits(v)
    a, b = [7, 2, 4, 10, 3, 5, 9, 4, 6, 8], [3, 7, 2, 4, 10, 3, 5, 9, 4, 6, 8]
    return len(ds) == 12 and weighted(ds, a) % 11 % 10 == ds[10] and weighted(ds, b) % 11 % 10 == ds[11]


def baltic(v: str) -> bool:
    ds = digits(v)
    if len(ds) != 11:
        return False
    r = weighted(ds, [1, 2, 3, 4, 5, 6, 7, 8, 9, 1]) % 11
    if r == 10:
        r = weighted(ds, [3, 4, 5, 6, 7, 8, 9, 1, 2, 3]) % 11 % 10
    return r == ds[10]


def nz_ird(v: str) -> bool:
    ds = digits(v)
    if len(ds) not in (8, 9) or not 10_000_000 <= int("".join(map(str, ds))) <= 150_000_000:
        return False
    ds = [0] * (9 - len(ds)) + ds
    for w in ([3, 2, 7, 6, 5, 4, 3, 2], [7, 4, 3, 2, 5, 2, 7, 6]):
        r = (11 - weighted(ds, w) % 11) % 11
        if r < 10:
            return r == ds[8]
    return False


def no_fnr(v: str) -> bool:
    ds = digits(v)
    if len(ds) != 11:
        return False
    day, month = ds[0] * 10 + ds[1], ds[2] * 10 + ds[3]
    if not day_month(day - 40 if day > 40 else day, month - 40 if month > 40 else month):
        return False
    a = (11 - weighted(ds, [3, 7, 6, 1, 8, 9, 4, 5, 2]) % 11) % 11
    b = (11 - weighted(ds, [5, 4, 3, 2, 7, 6, 5, 4, 3, 2]) % 11) % 11
    return a == ds[9] and b == ds[10]


def uk_nhs(v: str) -> bool:
    ds = digits(v)
    return len(ds) == 10 and weighted(ds, range(10, 0, -1)) % 11 == 0


def fr_nir(v: str) -> bool:
    text = compact(v).replace("2A", "19", 1).replace("2B", "18", 1)
    return len(text) == 15 and text.isdigit() and 97 - int(text[:13]) % 97 == int(text[13:])


def be_rrn(v: str) -> bool:
    text = "".join(map(str, digits(v)))
    return len(text) == 11 and any(97 - int(c + text[:9]) % 97 == int(text[9:]) for c in ("", "2"))


def es_letter(number_text: str, letter: str) -> bool:
    return "TRWAGMYFPDXBNJZSQVHLCKE"[int(number_text) % 23] == letter


def es_nif(v: str) -> bool:
    text = compact(v)
    return text[:-1].isdigit() and 7 <= len(text[:-1]) <= 8 and es_letter(text[:-1], text[-1])


def es_nie(v: str) -> bool:
    text = compact(v)
    return len(text) == 9 and text[0] in "XYZ" and text[1:8].isdigit() and es_letter(str("XYZ".index(text[0])) + text[1:8], text[8])


def ie_pps(v: str) -> bool:
    text = compact(v)
    total = weighted(digits(text[:7]), range(8, 1, -1)) + (9 * (ord(text[8]) - 64) if len(text) > 8 and text[8] != "W" else 0)
    return text[:7].isdigit() and "WABCDEFGHIJKLMNOPQRSTUV"[total % 23] == text[7]


def fi_hetu(v: str) -> bool:
    m = re.fullmatch(r"(\d\d)(\d\d)(\d\d)([-+A-FYXWVU])(\d{3})(\w)", v.upper())
    if not m:
        return False
    century = 1800 if m[4] == "+" else 1900 if m[4] in "-YXWVU" else 2000
    try:
        dt.date(century + int(m[3]), int(m[2]), int(m[1]))
    except ValueError:
        return False
    return "0123456789ABCDEFHJKLMNPRSTUVWXY"[int(m[1] + m[2] + m[3] + m[5]) % 31] == m[6]


def it_fiscal(v: str) -> bool | None:
    text = compact(v)
    odd = dict(zip("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ", [1, 0, 5, 7, 9, 13, 15, 17, 19, 21] + [
        1, 0, 5, 7, 9, 13, 15, 17, 19, 21, 2, 4, 18, 20, 11, 3, 6, 8, 12, 14, 16, 10, 22, 25, 24, 23]))
    total = sum(odd[c] if i % 2 == 0 else int(c) if c.isdigit() else ord(c) - 65 for i, c in enumerate(text[:15]))
    return True if len(text) == 16 and chr(65 + total % 26) == text[15] else None


def tr_id(v: str) -> bool:
    ds = digits(v)
    return (len(ds) == 11 and ds[0] > 0 and (sum(ds[0:9:2]) * 7 - sum(ds[1:8:2])) % 10 == ds[9] and sum(ds[:10]) % 10 == ds[10])


def cn_id(v: str) -> bool:
    text = compact(v)
    return len(text) == 18 and text[:17].isdigit() and "10X98765432"[weighted(digits(text[:17]), [7, 9, 10, 5, 8, 4, 2, 1, 6, 3, 7, 9, 10, 5, 8, 4, 2]) % 11] == text[17]


def hk_id(v: str) -> bool:
    text = compact(v).rjust(9)
    values = [36 if c == " " else int(c, 36) for c in text]
    return len(text) == 9 and weighted(values[:8], range(9, 1, -1)) % 11 == (11 - values[8]) % 11


def tw_id(v: str) -> bool:
    text = compact(v)
    order = "ABCDEFGHJKLMNPQRSTUVXYWZIO".index(text[0]) + 10
    return len(text) == 10 and (order // 10 + order % 10 * 9 + weighted(digits(text[1:]), [8, 7, 6, 5, 4, 3, 2, 1, 1])) % 10 == 0


def rodne_cislo(v: str) -> bool | None:
    ds = digits(v)
    month = ds[2] * 10 + ds[3] if len(ds) in (9, 10) else 0
    for off in (70, 50, 20):
        if month > off:
            month -= off
            break
    if len(ds) not in (9, 10) or not day_month(ds[4] * 10 + ds[5], month):
        return False
    return None if len(ds) == 9 else int("".join(map(str, ds))) % 11 == 0


def iban(v: str) -> bool | None:
    text = compact(v)
    if not 15 <= len(text) <= 34 or mod97(text[4:] + text[:4]) != 1:
        return False
    return True if v.upper() == v else None


def vin(v: str) -> bool:
    text = compact(v)
    if text.isdigit() or text.isalpha() or len(text) != 17:
        return False
    value = {c: int(c) for c in "0123456789"} | dict(zip("ABCDEFGH", range(1, 9))) | dict(zip("JKLMN", range(1, 6))) | {"P": 7, "R": 9} | dict(zip("STUVWXYZ", range(2, 10)))
    return all(c in value for c in text) and "0123456789X"[sum(value[c] * w for c, w in zip(text, [8, 7, 6, 5, 4, 3, 2, 10, 0, 9, 8, 7, 6, 5, 4, 3, 2])) % 11] == text[8]


def base58_bitcoin(v: str) -> bool:
    alphabet = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
    if v.lower().startswith("bc1"):
        return _bech32(v)
    n = 0
    for c in v:
        if c not in alphabet:
            return False
        n = n * 58 + alphabet.index(c)
    raw = n.to_bytes(max(25, (n.bit_length() + 7) // 8), "big")
    return len(raw) == 25 and hashlib.sha256(hashlib.sha256(raw[:-4]).digest()).digest()[:4] == raw[-4:]


def _bech32(v: str) -> bool:
    charset = "qpzry9x8gf2tvdw0s3jn54khce6mua7l"
    if v != v.lower() and v != v.upper():
        return False
    data = v.lower()[3:]
    if any(c not in charset for c in data):
        return False
    state = 1
    for value in [3, 3, 0, 2, 3] + [charset.index(c) for c in data]:
        top = state >> 25
        state = (state & 0x1FFFFFF) << 5 ^ value
        for i, g in enumerate((0x3B6A57B2, 0x26508E6D, 0x1EA119FA, 0x3D4233DD, 0x2A1462B3)):
            state ^= g if top >> i & 1 else 0
    return state in (1, 0x2BC830A3)


def aadhaar(v: str) -> bool:
    ds = digits(v)
    return len(ds) == 12 and ds[0] >= 2 and ds != ds[::-1] and verhoeff(ds)


def mrz(v: str) -> bool | None:
    if v[:1] == "P":
        return None
    text = v.replace(" ", "").upper()
    return len(text) >= 28 and all(text[i].isdigit() and icao(text[a:b]) == int(text[i]) for a, b, i in ((0, 9, 9), (13, 19, 19), (21, 27, 27)))


def geo(v: str) -> bool | None:
    found = [float(x) for x in re.findall(r"-?\d+\.\d+", v)]
    if len(found) == 2:
        return None if abs(found[0]) <= 90 and abs(found[1]) <= 180 and any(found) else False
    return None if found and abs(found[0]) <= 180 else False


def is_dated(v: str, day: slice, month: slice) -> bool:
    ds = "".join(map(str, digits(v)))
    return day_month(int(ds[day] or 0), int(ds[month] or 0))


def _luhn_with(*lengths: int, prefix: str = "", also: Callable[[list[int]], bool] = lambda ds: True):
    def check(v: str) -> bool:
        ds = digits(v)
        return len(ds) in lengths and "".join(map(str, ds)).startswith(prefix) and also(ds) and luhn(ds)

    return check


def _dated(check: Callable[[str], bool | None], day: slice, month: slice):
    return lambda v: check(v) if is_dated(v, day, month) else False


def _none_for_false(check: Callable[[str], bool]):
    return lambda v: True if check(v) else None


def de_vat(v: str) -> bool | None:
    return True if len(ds := digits(v)) == 9 and iso7064_11_10(ds) else None


def de_tax(v: str) -> bool:
    ds = digits(v)
    return len(ds) == 11 and ds[0] > 0 and max(ds[:10].count(d) for d in range(10)) <= 3 and iso7064_11_10(ds)


def de_kvnr(v: str) -> bool:
    text = compact(v)
    ds = digits(f"{ord(text[0]) - 64:02d}") + digits(text[1:])
    return sum(sum(divmod(d * (1 + i % 2), 10)) for i, d in enumerate(ds[:10])) % 10 == ds[10]


def de_rvnr(v: str) -> bool:
    text = compact(v)
    ds = digits(text[:8]) + digits(f"{ord(text[8]) - 64:02d}") + digits(text[9:11])
    return sum(sum(divmod(d * w, 10)) for d, w in zip(ds, [2, 1, 2, 5, 7, 1, 2, 1, 2, 1, 2, 1])) % 10 == int(text[11])


def au_abn(v: str) -> bool:
    ds = digits(v)
    return len(ds) == 11 and weighted([ds[0] - 1, *ds[1:]], [10, 1, 3, 5, 7, 9, 11, 13, 15, 17, 19]) % 89 == 0


def kr_resident(base: int):
    def check(v: str) -> bool | None:
        ds = digits(v)
        if len(ds) != 13 or ds[7] * 10 + ds[8] > 95:
            return None
        return True if (base - weighted(ds, [2, 3, 4, 5, 6, 7, 8, 9, 2, 3, 4, 5]) % 11) % 10 == ds[12] else None

    return check


def kr_brn(v: str) -> bool:
    ds = digits(v)
    return len(ds) == 10 and (weighted(ds, [1, 3, 7, 1, 3, 7, 1, 3, 5]) + ds[8] * 5 // 10 + ds[9]) % 10 == 0


def dea(v: str) -> bool:
    ds = digits(v)[-7:]
    return len(ds) == 7 and (ds[0] + ds[2] + ds[4] + 2 * (ds[1] + ds[3] + ds[5])) % 10 == ds[6]


def il_id(v: str) -> bool:
    ds = digits(v)
    return len(ds) == 9 and sum(sum(divmod(d * (1 + i % 2), 10)) for i, d in enumerate(ds)) % 10 == 0


def cl_rut(v: str) -> bool:
    text = compact(v)
    r = 11 - sum(int(c) * (2 + i % 6) for i, c in enumerate(reversed(text[:-1]))) % 11 if text[:-1].isdigit() else -1
    return "-" in v and text[-1] == {11: "0", 10: "K"}.get(r, str(r))


def ch_ahv(v: str) -> bool:
    ds = digits(v)
    return len(ds) == 13 and ds[:3] == [7, 5, 6] and weighted(ds, [1, 3] * 6 + [1]) % 10 == 0


def pt_nif(v: str) -> bool:
    ds = digits(v)
    return len(ds) == 9 and ds[0] in (1, 2, 3, 5, 6, 8, 9) and _mod11_digits(ds, list(range(9, 1, -1))) == ds[8]


def ru_snils(v: str) -> bool | None:
    ds = digits(v)
    if len(ds) != 11:
        return False
    if int("".join(map(str, ds[:9]))) <= 1_001_998:
        return None
    return weighted(ds, range(9, 0, -1)) % 101 % 100 == ds[9] * 10 + ds[10]


def ro_cnp(v: str) -> bool:
    ds = digits(v)
    r = weighted(ds, [2, 7, 9, 1, 4, 6, 3, 5, 8, 2, 7, 9]) % 11
    return len(ds) == 13 and (1 if r == 10 else r) == ds[12]


def mx_curp(v: str) -> bool:
    text, order = v.upper(), "0123456789ABCDEFGHIJKLMNÑOPQRSTUVWXYZ"
    return len(text) == 18 and (10 - sum(order.index(c) * (18 - i) for i, c in enumerate(text[:17])) % 10) % 10 == int(text[17])


def us_ssn_wrong(v: str) -> bool:
    seps = {c for c in v if not c.isdigit()}
    text = "".join(map(str, digits(v)))
    return (len(seps) > 1 or len(set(text)) == 1 or text[3:5] == "00" or text[5:] == "0000" or text[:3] in ("000", "666")
            or text in ("123456789", "987654320", "078051120"))


def za_id(v: str) -> bool:
    ds = digits(v)
    if len(ds) != 13 or ds[10] > 2 or ds[11] not in (8, 9) or not luhn(ds):
        return False
    text = "".join(map(str, ds))
    for century in (19, 20):
        try:
            if dt.date(int(f"{century}{text[:2]}"), int(text[2:4]), int(text[4:6])) <= REFERENCE_DATE:
                return True
        except ValueError:
            continue
    return False


def ip_wrong(v: str) -> bool:
    try:
        ipaddress.ip_interface(v.split("%")[0] + (v[v.index("/"):] if "%" in v and "/" in v else ""))
    except ValueError:
        return True
    return False


def mac_wrong(v: str) -> bool:
    return compact(v) in ("F" * 12, "0" * 12)


def uuid_wrong(v: str) -> bool:
    text = compact(v)
    return set(text) == {"0"} or text[12] not in "12345678" or text[16] not in "89AB"


_YYMMDD, _DDMM = (slice(4, 6), slice(2, 4)), (slice(0, 2), slice(2, 4))
_jmbg = _dated(_eleven(13, [7, 6, 5, 4, 3, 2] * 2), *_DDMM)
_id_card = lambda v: True if icao(compact(v)[:-1]) == int(compact(v)[-1]) else False

VALIDATORS: dict[str, Callable[[str], bool | None]] = {
    "ABA_ROUTING_NUMBER": _sum_check(9, [3, 7, 1] * 3, 10, lambda r, ds: r == 0),
    "MEDICAL_LICENSE": dea, "US_NPI": lambda v: luhn([8, 0, 8, 4, 0, *digits(v)]),
    "UK_NHS": uk_nhs, "ES_NIF": es_nif, "ES_NIE": es_nie, "IT_FISCAL_CODE": it_fiscal,
    "IT_VAT_CODE": _luhn_with(11, also=any), "TR_NATIONAL_ID": tr_id, "TR_LICENSE_PLATE": lambda v: 1 <= int(v[:2]) <= 81,
    "DE_HEALTH_INSURANCE": de_kvnr, "DE_ID_CARD": lambda v: None if re.fullmatch(r"[Tt]\d{8}", v) else _id_card(v), "DE_PASSPORT": _id_card,
    "DE_LANR": _sum_check(9, [4, 9] * 3, 10, lambda r, ds: (10 - r) % 10 == ds[6]), "DE_SOCIAL_SECURITY": de_rvnr, "DE_TAX_ID": de_tax, "DE_VAT_ID": de_vat,
    "SE_ORGANISATIONSNUMMER": lambda v: len(ds := digits(v)) == 10 and ds[2] >= 2 and luhn(ds),
    "SE_PERSONNUMMER": lambda v: len(ds := digits(v)[-10:]) == 10 and day_month((ds[4] * 10 + ds[5] - 1) % 60 + 1, ds[2] * 10 + ds[3]) and luhn(ds),
    "FI_PERSONAL_IDENTITY_CODE": fi_hetu, "PL_PESEL": _sum_check(11, [1, 3, 7, 9] * 2 + [1, 3], 10, lambda r, ds: (10 - r) % 10 == ds[10]),
    "IN Aadhaar": aadhaar, "IN GST": lambda v: v[13].upper() == "Z" and re.fullmatch(r"[A-Z]{5}\d{4}[A-Z]", v[2:12].upper()) is not None and 1 <= int(v[:2]) <= 37,
    "AU_ABN": au_abn, "AU_ACN": _sum_check(9, list(range(8, 0, -1)), 10, lambda r, ds: (10 - r) % 10 == ds[8]),
    "AU_MEDICARE": _sum_check(10, [1, 3, 7, 9] * 2, 10, lambda r, ds: r == ds[8]), "AU_TFN": _sum_check(9, [1, 4, 3, 7, 5, 8, 6, 9, 10], 11, lambda r, ds: r == 0),
    "KR_BRN": kr_brn, "KR_RRN": kr_resident(11), "KR_FRN": kr_resident(13), "KR_DRIVER_LICENSE": lambda v: 11 <= int("".join(map(str, digits(v)[:2]))) <= 28 or None,
    "TH_TNIN": _sum_check(13, list(range(13, 1, -1)), 11, lambda r, ds: (11 - r) % 10 == ds[12]),
    "ZA_ID_NUMBER": za_id, "ZA_TRAFFIC_REGISTER_NUMBER": lambda v: len(digits(v)) == 13 and not za_id(v), "NG_NIN": lambda v: verhoeff(digits(v)),
    "IBAN": iban, "CRYPTO": base58_bitcoin, "FR_NIR": fr_nir,
    "NL_BSN": lambda v: len(ds := digits(v)) == 9 and len(set(ds)) > 1 and (weighted(ds[:8], range(9, 1, -1)) - ds[8]) % 11 == 0,
    "BE_NATIONAL_NUMBER": be_rrn, "CH_AHV": ch_ahv, "AT_SVNR": _dated(_sum_check(10, [3, 7, 9, 0, 5, 8, 4, 2, 1, 6], 11, lambda r, ds: r == ds[3]), slice(4, 6), slice(6, 8)),
    "IE_PPS": ie_pps, "PT_NIF": pt_nif, "LU_NATIONAL_ID": lambda v: len(ds := digits(v)) == 13 and luhn(ds[:12]) and verhoeff(ds[:11] + ds[12:]),
    "DK_CPR": _dated(_none_for_false(_sum_check(10, [4, 3, 2, 7, 6, 5, 4, 3, 2, 1], 11, lambda r, ds: r == 0)), *_DDMM),
    "NO_FODSELSNUMMER": no_fnr, "IS_KENNITALA": _sum_check(10, [3, 2, 7, 6, 5, 4, 3, 2], 11, lambda r, ds: (11 - r) % 11 == ds[8] and ds[9] in (0, 8, 9)),
    "CZ_RODNE_CISLO": rodne_cislo, "SK_RODNE_CISLO": rodne_cislo, "HU_TAJ": _sum_check(9, [3, 7] * 4, 10, lambda r, ds: r == ds[8]), "RO_CNP": ro_cnp,
    "GR_AMKA": _dated(_luhn_with(11), *_DDMM), "BG_EGN": _sum_check(10, [2, 4, 8, 5, 10, 9, 7, 3, 6], 11, lambda r, ds: r % 10 == ds[9]),
    "HR_OIB": lambda v: len(ds := digits(v)) == 11 and iso7064_11_10(ds), "RS_JMBG": _jmbg, "SI_EMSO": _jmbg, "LT_ASMENS_KODAS": baltic, "EE_ISIKUKOOD": baltic,
    "LV_PERSONAS_KODS": lambda v: None if v.startswith("32") else (True if (1101 - weighted(digits(v), [1, 6, 3, 7, 9, 10, 5, 8, 4, 2])) % 11 == digits(v)[10] else None),
    "RU_INN": ru_inn, "RU_SNILS": ru_snils, "UA_RNTRC": _sum_check(10, [-1, 5, 7, 9, 4, 6, 10, 5, 7], 11, lambda r, ds: r % 10 == ds[9]),
    "ES_NUSS": lambda v: len(ds := digits(v)) == 12 and int("".join(map(str, ds[:10]))) % 97 == ds[10] * 10 + ds[11],
    "GB_UTR": _none_for_false(_sum_check(10, [0, 6, 7, 8, 9, 10, 5, 4, 3, 2], 11, lambda r, ds: [2, 1, 9, 8, 7, 6, 5, 4, 3, 2, 1][r] == ds[0])),
    "BR_CPF": br_cpf, "BR_CNPJ": br_cnpj, "MX_CURP": mx_curp, "AR_CUIT": _sum_check(11, [5, 4, 3, 2, 7, 6, 5, 4, 3, 2], 11, lambda r, ds: (11 - r) % 11 == ds[10]),
    "CL_RUT": cl_rut, "CA_OHIP": _luhn_with(10), "JP_MY_NUMBER": lambda v: len(ds := digits(v)) == 12 and (0 if (r := weighted(ds, [6, 5, 4, 3, 2, 7, 6, 5, 4, 3, 2]) % 11) <= 1 else 11 - r) == ds[11],
    "CN_RESIDENT_ID": cn_id, "HK_HKID": hk_id, "TW_NATIONAL_ID": tw_id, "NZ_IRD": nz_ird, "AU_IHI": _luhn_with(16, prefix="800360"),
    "MY_MYKAD": lambda v: None if is_dated(v, *_YYMMDD) else False, "ID_NIK": lambda v: None if is_dated(v, slice(6, 8), slice(8, 10)) or digits(v)[6] >= 4 else False,
    "AE_EMIRATES_ID": _luhn_with(15, prefix="784"), "SA_NATIONAL_ID": _luhn_with(10, also=lambda ds: ds[0] in (1, 2)), "IL_TEUDAT_ZEHUT": il_id,
    "IMEI": _luhn_with(15, also=lambda ds: len(set(ds)) > 2), "ICCID": _luhn_with(19, 20, prefix="89"), "VIN": vin, "PASSPORT_MRZ": mrz, "GEO_COORDINATES": geo,
}
INVALIDATORS: dict[str, Callable[[str], bool]] = {
    "US SSN": us_ssn_wrong, "US_NPI": lambda v: len(set(digits(v))) == 1, "CA SIN": lambda v: not luhn(digits(v)), "PII.IPAddress": ip_wrong,
    "MAC_ADDRESS": mac_wrong, "UUID": uuid_wrong,
    "PH_TIN": lambda v: len(ds := digits(v)) not in (9, 12) or weighted(ds, range(9, 1, -1)) % 11 != ds[8],
}
