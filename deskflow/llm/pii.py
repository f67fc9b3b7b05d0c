"""Format-preserving pseudonyms for personal data (operator 4).

Card numbers, phone numbers, account numbers (IBAN), national numbers, IPv4
addresses, dates and e-mail addresses are found by pattern and validated (check
digits, ranges, calendar). A valid value is replaced by another valid value of
the same format: a keyed Feistel network permutes the values of that format
(cycle walking keeps it inside), check digits are recomputed, and separators
stay. The permutation depends on the key alone, so equal values get equal
pseudonyms in all documents, different values different ones, and who has the
key can invert it.
"""

from __future__ import annotations

import datetime
import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean

ROUNDS = 8
# FIXED VALUES: characters of an IBAN by country (SWIFT registry).
IBAN_LENGTHS = {x[:2]: int(x[2:]) for x in (
    "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BI27 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DJ27 DK18 DO28 EE20 EG29 ES24 FI18 FK18 "
    "FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 HN28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 "
    "LY25 MC27 MD24 ME22 MK19 MN20 MR27 MT31 MU30 NI28 NL18 NO15 OM23 PK24 PL28 PS29 PT25 QA29 RO24 RS22 RU33 SA24 SC31 SD18 SE24 "
    "SI19 SK24 SM27 SO23 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20 YE30").split()}
FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()


class Feistel:
    """A keyed permutation of the integers below any bound."""

    def __init__(self, key: bytes):
        self.key = key

    def _round(self, tweak: str, i: int, value: int) -> int:
        digest = hashlib.blake2b(f"{tweak}|{i}|{value}".encode(), key=self.key, digest_size=16).digest()
        return int.from_bytes(digest, "big")

    def _halves(self, bound: int) -> int:
        side = 1
        while side * side < bound:
            side <<= 1
        return side

    def permute(self, value: int, bound: int, tweak: str, inverse: bool = False) -> int:
        """The place of ``value`` (below ``bound``) in the permutation named ``tweak``, or what has that place."""
        side = self._halves(bound)
        while True:
            left, right = divmod(value, side)
            for i in reversed(range(ROUNDS)) if inverse else range(ROUNDS):
                if inverse:
                    left, right = (right - self._round(tweak, i, left)) % side, left
                else:
                    left, right = right, (left + self._round(tweak, i, right)) % side
            value = left * side + right
            if value < bound:
                return value


def luhn_digit(payload: str) -> str:
    """The check digit that follows the payload."""
    total = 0
    for i, c in enumerate(reversed(payload)):
        d = int(c) * (2 - i % 2)
        total += d - 9 * (d > 9)
    return str(-total % 10)


def iban_check(country: str, rest: str) -> str:
    return f"{98 - int(''.join(str(int(c, 36)) for c in rest + country + '00')) % 97:02d}"


def _refill(shape: str, digits: str) -> str:
    """``shape`` with its digits replaced one by one."""
    new = iter(digits)
    return "".join(next(new) if c.isdigit() else c for c in shape)


def _digits(text: str) -> str:
    return re.sub(r"\D", "", text)


def _is_card(digits: str) -> bool:
    return 13 <= len(digits) <= 19 and len(set(digits)) > 1 and luhn_digit(digits[:-1]) == digits[-1]


def card(m: str, f: Feistel, inverse: bool) -> str | None:
    """Whether a beginning of the number is a card too stays as it is, so that the pseudonym is read to the same end."""
    digits = _digits(m)
    if not _is_card(digits):
        return None
    n = len(digits) - 2  # the first digit (the network) stays, the last is the check digit
    begins = [_is_card(digits[:i]) for i in range(13, len(digits))]
    new = digits
    while True:
        payload = digits[0] + str(f.permute(int(new[1:-1]), 10 ** n, f"card{n}{digits[0]}", inverse)).zfill(n)
        new = payload + luhn_digit(payload)
        if _is_card(new) and [_is_card(new[:i]) for i in range(13, len(new))] == begins:
            return _refill(m, new)


def phone(m: str, f: Feistel, inverse: bool) -> str | None:
    """Ten digits marked by +1 or a bracketed area code are a number, whatever they are; unmarked ones only if they can be dialled.

    Area codes and exchanges stay below 200 or not, so that a pseudonym is found as its value was.
    """
    digits = _digits(m)
    if m[0] == "+" and digits[0] != "1":
        if not 8 <= len(digits) <= 15:
            return None
        n = len(digits) - 2  # the country code's first two digits stay
        return _refill(m, digits[:2] + str(f.permute(int(digits[2:]), 10 ** n, f"phone{n}{digits[:2]}", inverse)).zfill(n))
    area, exchange, line = digits[-10:-7], digits[-7:-4], digits[-4:]
    if len(digits) != (11 if m[0] == "+" else 10):
        return None
    low = [200 if part[0] >= "2" else 0 for part in (area, exchange)]
    if low != [200, 200] and m[0] not in "+(":
        return None
    areas, exchanges = (800 if x else 200 for x in low)
    value = ((int(area) - low[0]) * exchanges + int(exchange) - low[1]) * 10_000 + int(line)
    tweak = "phone" if low == [200, 200] else f"phone{low[0]},{low[1]}"
    value, last = divmod(f.permute(value, areas * exchanges * 10_000, tweak, inverse), 10_000)
    return _refill(m, digits[:-10] + f"{value // exchanges + low[0]:03d}{value % exchanges + low[1]:03d}{last:04d}")


def national(m: str, f: Feistel, inverse: bool) -> str | None:
    area, group, serial = (int(x) for x in m.split("-"))
    if not 0 < area < 900 or area == 666 or not group or not serial:
        return None
    areas = [a for a in range(1, 900) if a != 666]
    value = (areas.index(area) * 99 + group - 1) * 9999 + serial - 1
    value, serial = divmod(f.permute(value, len(areas) * 99 * 9999, "national", inverse), 9999)
    return f"{areas[value // 99]:03d}-{value % 99 + 1:02d}-{serial + 1:04d}"


def address(m: str, f: Feistel, inverse: bool) -> str | None:
    """Octets keep their number of digits, so the text keeps its length."""
    octets = m.split(".")
    if any(int(o) > 255 or (len(o) > 1 and o[0] == "0") for o in octets):
        return None
    low = {1: (0, 10), 2: (10, 90), 3: (100, 156)}
    value, bound = 0, 1
    for o in octets:
        first, size = low[len(o)]
        value, bound = value * size + int(o) - first, bound * size
    value = f.permute(value, bound, "ip" + "".join(str(len(o)) for o in octets), inverse)
    out = []
    for o in reversed(octets):
        first, size = low[len(o)]
        value, part = divmod(value, size)
        out.append(str(part + first))
    return ".".join(reversed(out))


def date(m: str, f: Feistel, inverse: bool) -> str | None:
    """Year first, or day first with a four-digit year last, or month first where no month is in its place; 1900 to 2099.

    Days beyond the twelfth stay beyond it, so that a pseudonym is read in the order of its value.
    """
    a, sep, b, c = re.fullmatch(r"(\d+)([-/.])(\d+)[-/.](\d+)", m).groups()
    month_first = len(a) == 2 and int(b) > 12
    year, month, day = (a, b, c) if len(a) == 4 else (c, a, b) if month_first else (c, b, a)
    try:
        ordinal = datetime.date(int(year), int(month), int(day)).toordinal()
    except ValueError:
        return None
    if not FIRST_DAY <= ordinal <= LAST_DAY:
        return None
    while True:
        ordinal = FIRST_DAY + f.permute(ordinal - FIRST_DAY, LAST_DAY - FIRST_DAY + 1, "date", inverse)
        new = datetime.date.fromordinal(ordinal)
        if (new.day > 12) == (int(day) > 12):
            break
    year, month, day = f"{new.year}", f"{new.month:02d}", f"{new.day:02d}"
    return sep.join((year, month, day) if len(a) == 4 else (month, day, year) if month_first else (day, month, year))


def _is_iban(plain: str) -> bool:
    return 15 <= len(plain) <= 34 and iban_check(plain[:2], plain[4:]) == plain[2:4]


def iban(m: str, f: Feistel, inverse: bool) -> str | None:
    """Digits of the account part are permuted; letters stay; the check digits are recomputed.

    Whether a beginning of the country's length is an IBAN too stays as it is.
    """
    plain = m.replace(" ", "")
    n = sum(c.isdigit() for c in plain[4:])
    if not n or not _is_iban(plain):
        return None
    shape = plain[:2] + re.sub(r"\d", "0", plain[4:])
    usual = IBAN_LENGTHS.get(plain[:2], len(plain))
    begins = usual < len(plain) and _is_iban(plain[:usual])
    new = plain
    while True:
        rest = _refill(plain[4:], str(f.permute(int(_digits(new[4:])), 10 ** n, f"iban{shape}", inverse)).zfill(n))
        new = plain[:2] + iban_check(plain[:2], rest) + rest
        if (usual < len(plain) and _is_iban(new[:usual])) == begins:
            break
    at = iter(new)
    return "".join(" " if c == " " else next(at) for c in m)


def email(m: str, f: Feistel, inverse: bool) -> str | None:
    """Letters and digits of the name are permuted within their kind and place; the domain stays."""
    name, domain = m.rsplit("@", 1)
    sizes = [26 if c.isascii() and c.isalpha() else 10 if c.isdigit() and c.isascii() else 1 for c in name]
    value, bound = 0, 1
    for c, size in zip(name, sizes):
        value, bound = value * size + (ord(c.lower()) - 97 if size == 26 else int(c) if size == 10 else 0), bound * size
    if bound < 2:
        return None
    shape = "".join({26: "a", 10: "0"}.get(s, c) for c, s in zip(name, sizes))
    value = f.permute(value, bound, f"email{shape}@{domain.lower()}", inverse)
    out = []
    for c, size in zip(reversed(name), reversed(sizes)):
        value, part = divmod(value, size)
        new = chr(97 + part) if size == 26 else str(part) if size == 10 else c
        out.append(new.upper() if c.isupper() else new)
    return "".join(reversed(out)) + "@" + domain


KINDS: dict[str, tuple[str, Callable[[str, Feistel, bool], str | None]]] = {
    "email": (r"[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,24}(?![\w@])", email),
    "ip": (r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?![\w]|\.\d)", address),
    "date": (r"(?:(?:\d{4}(?:-\d{2}-|/\d{2}/|\.\d{2}\.)\d{2})|(?:\d{2}([/.-])\d{2}\2\d{4}))(?![\w]|[-/.]\d)", date),
    "national": (r"\d{3}-\d{2}-\d{4}(?![\w]|-\d)", national),
    "iban": (r"[A-Z]{2}\d{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,4})?)(?!\w)", iban),
    "card": (r"\d(?:[ -]?\d){12,18}(?![\w]|[-.]\d)", card),
    "phone": (r"(?:\+1[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\w|-\d)|\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?!\w)", phone),
}


def _pattern() -> re.Pattern:
    """All kinds in one pattern; a match starts where no word, number or address goes on."""
    groups = []
    for kind, (pattern, _) in KINDS.items():
        groups.append(f"(?P<{kind}>{pattern.replace(chr(92) + '2', '(?P=sep)').replace('([/.-])', '(?P<sep>[/.-])')})")
    return re.compile(r"(?<![\w.@+-])(?:" + "|".join(groups) + ")")


PATTERN = _pattern()


def _readings(kind: str, value: str) -> list[str]:
    """The match, and for cards and IBANs what ends at a separator of it, in the order in which they are tried.

    Other digits or words may follow a value. A card is the shortest reading
    that is valid (none of the usual groupings has a card inside a card, but a
    security code may follow); numbers that do not begin with a group of four
    or more digits are read whole. An IBAN has its country's length, or else is
    the longest reading that is valid.
    """
    if kind not in ("card", "iban"):
        return [value]
    parts = [value[:m.start()] for m in re.finditer("[ -]", value)] + [value]
    if kind == "card":
        return parts if len(parts[0]) >= 4 else [value]
    return sorted(parts[::-1], key=lambda p: len(p.replace(" ", "")) != IBAN_LENGTHS.get(value[:2]))


def _pseudonym(kind: str, value: str, feistel: Feistel, inverse: bool) -> str | None:
    """None if the value is not valid; digits of other scripts stay in their script."""
    if value.isascii():
        return KINDS[kind][1](value, feistel, inverse)
    new = KINDS[kind][1]("".join(str(int(c)) if c.isdecimal() else c for c in value), feistel, inverse)
    return new and "".join(chr(ord(c) - int(c) + int(x)) if c.isdecimal() else x for c, x in zip(value, new))


def find(text: str, feistel: Feistel, inverse: bool = False) -> Iterator[tuple[str, int, str, str]]:
    """(kind, start, value, pseudonym) of every valid value, from left to right without overlap.

    A match that fails its validation is tried again in its shorter readings, then as the later kinds at the same place.
    """
    at = 0
    while m := PATTERN.search(text, at):
        kind = m.lastgroup if m.lastgroup != "sep" else "date"
        names = list(KINDS)
        hit = None
        for k in names[names.index(kind):]:
            part = m if k == kind else re.compile(KINDS[k][0].replace("\\2", "\\1")).match(text, m.start())
            for value in _readings(k, part[0]) if part else ():
                if (new := _pseudonym(k, value, feistel, inverse)) is not None:
                    hit = (k, m.start(), value, new)
                    break
            if hit:
                break
        if hit:
            yield hit
            at = hit[1] + len(hit[2])
        else:
            at = m.start() + 1


def rewrite(text: str, feistel: Feistel, inverse: bool = False) -> str:
    """The text with every valid value replaced."""
    out, at = [], 0
    for _, start, value, new in find(text, feistel, inverse):
        out += [text[at:start], new]
        at = start + len(value)
    return "".join(out) + text[at:]


def _suspects(texts: pa.Array) -> list[int]:
    """Rows that hold a digit of any script or an @; no other can hold a value."""
    return pc.indices_nonzero(pc.fill_null(pc.match_substring_regex(texts, r"[\p{Nd}@]"), False)).to_pylist()


def findings(docs: DataFrame, key: bytes) -> DataFrame:
    """(doc_id, kind, start, length, pseudonym) for every value found in ``docs(doc_id, text)``.

    start and length are code points of the original text, which is not given
    out. Documents without personal data give no row, nor do null and empty
    texts. Repeated rows each give theirs; a null id stays null. An empty table
    gives an empty result; other columns are ignored.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("kind", pa.string()), ("start", pa.int64()), ("length", pa.int64()),
                        ("pseudonym", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        feistel = Feistel(key)
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text")
            rows = [(ids[i].as_py(), kind, start, len(value), new) for i in _suspects(texts)
                    for kind, start, value, new in find(texts[i].as_py(), feistel)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        lean(run), "doc_id long, kind string, start long, length long, pseudonym string")


def pseudonymize(docs: DataFrame, key: bytes, inverse: bool = False) -> DataFrame:
    """``docs`` with every value in ``text`` replaced (or, with ``inverse``, restored); all other columns unchanged.

    Same definitions as ``findings``; null texts stay null.
    """
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        feistel = Feistel(key)
        for batch in batches:
            texts = batch.column(at)
            values = texts.to_pylist()
            for i in _suspects(texts):
                values[i] = rewrite(values[i], feistel, inverse)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:at], pa.array(values, texts.type), *batch.columns[at + 1:]], schema=batch.schema)

    return docs.mapInArrow(lean(run), docs.schema)
