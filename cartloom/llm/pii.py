"""PII: format-preserving pseudonyms by a keyed Feistel network.

Numbers that pass their check (payment cards by Luhn, IBAN by remainder 97, social security
numbers, phone numbers, IP addresses), dates that exist, mail addresses and quoted secrets
are replaced by values of the same format: digits stay digits, letters keep their case, and
separators, country codes and the mail domain's last two labels stay. The replacement is a
permutation of all values of the format under a key, so equal values stay equal across
documents, different ones stay different, and the replaced numbers pass the same checks.

Numbers that fail their check are no personal data and stay as they are. Defined results: null
text stays null with zero counts; texts without a match come back unchanged; repeated rows are
replaced alike.
"""

from __future__ import annotations

import datetime
import hashlib
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
KINDS = ("mail", "secret", "iban", "card", "ssn", "date", "ip", "phone")
_FIRST_DAY = datetime.date(1900, 1, 1).toordinal()
_DAYS = datetime.date(2100, 1, 1).toordinal() - _FIRST_DAY

_PATTERN = re.compile(
    r"(?P<mail>(?<![\w.+-])[A-Za-z0-9_][\w.+-]*@[A-Za-z0-9][A-Za-z0-9-]*(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}(?!\w))"
    r"|(?P<secret>\b(?:token|key|secret|password|passwd|apikey|api_key)\s*[=:]\s*\"[^\"\s]{8,}\")"
    r"|(?P<iban>(?<!\w)[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?(?!\w))"
    r"|(?P<ssn>(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-]))"
    r"|(?P<date>(?<![\w./-])(?:[0-9]{4}([-/.])[0-9]{2}\6[0-9]{2}|[0-9]{2}([-/.])[0-9]{2}\7[0-9]{4})(?![\w/-]|\.[0-9]))"
    r"|(?P<ip>(?<![\w.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\w|\.[0-9]))"
    r"|(?P<phone>(?<!\w)\+[0-9]{1,3}[ -]?\(?[0-9]{2,4}\)?(?:[ -]?[0-9]{2,4}){2,3}(?!\w))"
    r"|(?P<card>(?<!\w)(?<![0-9][.-])(?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\11[0-9]{4}\11[0-9]{1,7}"
    r"|[0-9]{4}([ -])[0-9]{6}\12[0-9]{5})(?!\w)(?!-[0-9]))",
    re.ASCII,
)
_MAYBE = re.compile(r"[0-9@]|[=:]\s*\"")


def permuted(value: int, size: int, key: bytes, kind: str) -> int:
    """A keyed permutation of ``range(size)``: Feistel rounds on two halves, walked until inside.

    All bytes of the key count; a key of more than 64 is hashed first.
    """
    if size < 2:
        return value
    if len(key) > 64:
        key = hashlib.blake2b(key).digest()
    left_size = 1
    while left_size * left_size < size:
        left_size *= 2
    half = left_size.bit_length() - 1
    width = max(1, (half + 7) // 8)
    while True:
        left, right = value >> half, value & (left_size - 1)
        for k in range(ROUNDS):
            seen = f"{kind}:{size}:{k}:{right}".encode()
            mixed = hashlib.blake2b(seen, key=key, digest_size=min(64, width + 8)).digest()
            left, right = right, left ^ (int.from_bytes(mixed, "big") & (left_size - 1))
        value = left << half | right
        if value < size:
            return value


def _by_class(text: str, key: bytes, kind: str) -> str:
    """All ASCII letters and digits of a text permuted together, each inside its class."""
    bases = [(10, 48) if c.isdigit() else (26, 65) if c.isupper() else (26, 97) for c in text if c.isascii() and c.isalnum()]
    value, size = 0, 1
    letters = [c for c in text if c.isascii() and c.isalnum()]
    for c, (base, zero) in zip(letters, bases, strict=True):
        value, size = value * base + ord(c) - zero, size * base
    value = permuted(value, size, key, kind)
    out = []
    for base, zero in reversed(bases):
        value, digit = divmod(value, base)
        out.append(chr(zero + digit))
    return "".join(out.pop() if c.isascii() and c.isalnum() else c for c in text)


def luhn_digit(digits: str) -> str:
    """The check digit that follows ``digits``."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 - i % 2)
        total += d - 9 * (d > 9)
    return str(-total % 10)


def _refill(shape: str, digits: str) -> str:
    rest = iter(digits)
    return "".join(next(rest) if c.isdigit() else c for c in shape)


def _card(text: str, key: bytes) -> str | None:
    digits = re.sub(r"\D", "", text)
    if luhn_digit(digits[:-1]) != digits[-1] or len(set(digits)) == 1:
        return None
    body = str(permuted(int(digits[:-1]), 10 ** (len(digits) - 1), key, "card")).zfill(len(digits) - 1)
    return _refill(text, body + luhn_digit(body))


def _iban_rest(compact: str) -> int:
    return int("".join(str(int(c, 36)) for c in compact[4:] + compact[:4])) % 97


def _iban(text: str, key: bytes) -> str | None:
    compact = text.replace(" ", "")
    if not 15 <= len(compact) <= 34 or _iban_rest(compact) != 1:
        return None
    body = _by_class(compact[4:], key, "iban" + compact[:2])
    check = 98 - _iban_rest(compact[:2] + "00" + body)
    rest = iter(f"{compact[:2]}{check:02d}{body}")
    return "".join(c if c == " " else next(rest) for c in text)


def _ssn(text: str, key: bytes) -> str | None:
    area, group, serial = map(int, text.split("-"))
    areas = [a for a in range(1, 900) if a != 666]
    if area not in areas or not group or not serial:
        return None
    value = (areas.index(area) * 99 + group - 1) * 9999 + serial - 1
    value, serial = divmod(permuted(value, len(areas) * 99 * 9999, key, "ssn"), 9999)
    area, group = divmod(value, 99)
    return f"{areas[area]:03d}-{group + 1:02d}-{serial + 1:04d}"


def _date(text: str, key: bytes) -> str | None:
    a, b, c = re.split(r"\D", text)
    orders = [(a, b, c)] if len(a) == 4 else [(c, b, a), (c, a, b)]  # day first, or else month first
    for k, (year, month, day) in enumerate(orders):
        try:
            number = datetime.date(int(year), int(month), int(day)).toordinal() - _FIRST_DAY
        except ValueError:
            continue
        if not 0 <= number < _DAYS:
            return None
        new = datetime.date.fromordinal(_FIRST_DAY + permuted(number, _DAYS, key, "date"))
        y, m, d = f"{new.year:04d}", f"{new.month:02d}", f"{new.day:02d}"
        return _refill(text, y + m + d if len(a) == 4 else d + m + y if k == 0 else m + d + y)
    return None


def _ip(text: str, key: bytes) -> str | None:
    parts = text.split(".")
    if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
        return None
    new = permuted(int.from_bytes(bytes(map(int, parts)), "big"), 1 << 32, key, "ip")
    return ".".join(map(str, new.to_bytes(4, "big")))


#: Country codes of one and two digits; all others have three.
_ONE_DIGIT = ("1", "7")
_TWO_DIGITS = (
    "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 "
    "90 91 92 93 94 95 98"
).split()


def _phone(text: str, key: bytes) -> str | None:
    """The country code is read from the digits, so a number is the same with any separators."""
    every = re.sub(r"\D", "", text)
    size = 1 if every[:1] in _ONE_DIGIT else 2 if every[:2] in _TWO_DIGITS else 3
    country = re.match(rf"\+(?:[0-9][ ()-]*?){{{size}}}", text)[0]
    digits = every[size:]
    if not 6 <= len(digits) <= 14:
        return None
    new = permuted(int(digits), 10 ** len(digits), key, "phone+" + every[:size])
    return country + _refill(text[len(country) :], str(new).zfill(len(digits)))


def _mail(text: str, key: bytes) -> str:
    kept = re.search(r"(?:\.[^.@]+)?\.[^.@]+$|\.[^.@]+$", text)[0]
    if "@" not in text[: -len(kept)]:
        kept = text[text.rindex(".") :]
    return _by_class(text[: -len(kept)], key, "mail" + kept) + kept


def _secret(text: str, key: bytes) -> str:
    at = text.index('"')
    return text[:at] + _by_class(text[at:], key, "secret")


_REPLACE: dict[str, Callable[[str, bytes], str | None]] = {
    "mail": _mail, "secret": _secret, "iban": _iban, "card": _card, "ssn": _ssn, "date": _date, "ip": _ip, "phone": _phone,
}


def pseudonymised(text: str, key: bytes) -> tuple[str, dict[str, int]]:
    """The text with all personal data replaced, and how often each kind was."""
    counts = dict.fromkeys(KINDS, 0)
    if not _MAYBE.search(text):
        return text, counts

    def new(match: re.Match) -> str:
        kind = match.lastgroup if match.lastgroup in _REPLACE else next(k for k in KINDS if match[k] is not None)
        out = _REPLACE[kind](match[0], key)
        if out is None:
            return match[0]
        counts[kind] += 1
        return out

    return _PATTERN.sub(new, text), counts


def with_pseudonyms(documents: DataFrame, key: bytes, text: str = "text") -> DataFrame:
    """Columns ``row`` (all of ``documents``) and ``pii``: the new text and a count per kind."""
    fields = ", ".join(f"n_{k} long" for k in KINDS)

    @F.arrow_udf(f"text string, {fields}")
    def replace(texts: pa.Array) -> pa.Array:
        done = [(None, dict.fromkeys(KINDS, 0)) if t is None else pseudonymised(t, key) for t in texts.to_pylist()]
        columns = [pa.array([t for t, _ in done], pa.string())]
        columns += [pa.array([n[k] for _, n in done], pa.int64()) for k in KINDS]
        return pa.StructArray.from_arrays(columns, ["text", *[f"n_{k}" for k in KINDS]])

    rows: Column = F.struct(*documents.columns)
    return documents.select(rows.alias("row"), replace(F.col(text)).alias("pii"))
