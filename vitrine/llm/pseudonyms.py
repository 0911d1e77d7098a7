"""Personal data replaced by keyed values of the same format.

Numbers that pass their own checks (cards, IBANs, social security numbers,
phone numbers, IPv4 addresses), calendar dates, the local parts of e-mail
addresses and secrets next to their names are found in whole texts. Each is
written as a number below the count of values of its format, sent through a
keyed Feistel network on exactly that range (values that fall outside the
range, or that the format forbids, are sent through again) and written back in
the same format, check digits included. It is a permutation: equal values get
equal pseudonyms in every document, and different ones different pseudonyms.

Defined results: NULL stays NULL and empty stays empty; a text without personal
data comes back byte by byte; repeated rows get the same text; other columns
pass through.
"""

from __future__ import annotations

import datetime
import hashlib
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitrine.llm.common import free_name

ROUNDS = 8
CHUNK = 64  # characters of a secret in one permutation; a half of it is within a round's 384 bits
# A stand-in for tests and queries; a deployment passes its own.
KEY = b"replace this key"
DIGITS, LOWER, UPPER, HEX_LOWER, HEX_UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789abcdef", "0123456789ABCDEF"


class Permutation:
    """Keyed permutations of ranges 0 .. size - 1, one per kind and size."""

    def __init__(self, key: bytes, rounds: int = ROUNDS):
        self.key, self.rounds = hashlib.blake2b(key, digest_size=32).digest(), rounds

    def _round(self, kind: str, size: int, i: int, value: int, modulus: int) -> int:
        block = f"{kind}|{size}|{i}|{value}".encode()
        return int.from_bytes(hashlib.blake2b(block, key=self.key, digest_size=48).digest(), "big") % modulus

    def once(self, kind: str, size: int, value: int) -> int:
        """One pass, walking on until the value is in the range again."""
        root = int(size**0.5) if size < 1 << 50 else 1 << (size.bit_length() + 1) // 2
        a = max(1, root)
        b = -(-size // a)
        while True:
            left, right = divmod(value, b)
            for i in range(self.rounds):
                if i % 2:
                    right = (right + self._round(kind, size, i, left, b)) % b
                else:
                    left = (left + self._round(kind, size, i, right, a)) % a
            value = left * b + right
            if value < size:
                return value

    def valid(self, kind: str, size: int, value: int, allowed: Callable[[int], bool]) -> int:
        """Walk on until an allowed value; the start is allowed, so this ends."""
        value = self.once(kind, size, value)
        while not allowed(value):
            value = self.once(kind, size, value)
        return value


def pack(text: str, alphabets: list[str]) -> int:
    """Characters, each from its own alphabet, as one number."""
    value = 0
    for c, alphabet in zip(text, alphabets):
        value = value * len(alphabet) + alphabet.index(c)
    return value


def unpack(value: int, alphabets: list[str]) -> str:
    out = []
    for alphabet in reversed(alphabets):
        value, at = divmod(value, len(alphabet))
        out.append(alphabet[at])
    return "".join(reversed(out))


def _size(alphabets: list[str]) -> int:
    size = 1
    for alphabet in alphabets:
        size *= len(alphabet)
    return size


def _alike(c: str) -> str:
    return DIGITS if c in DIGITS else LOWER if c in LOWER else UPPER if c in UPPER else c


def _within(p: Permutation, kind: str, text: str, alphabets: list[str], allowed: Callable[[str], bool] = lambda t: True) -> str:
    return unpack(p.valid(kind, _size(alphabets), pack(text, alphabets), lambda v: allowed(unpack(v, alphabets))), alphabets)


def _fill(shape: str, chars: str) -> str:
    """The shape with its letters and digits replaced in turn."""
    new = iter(chars)
    return "".join(next(new) if c.isalnum() else c for c in shape)


def luhn_digit(payload: str) -> str:
    total = sum(sum(divmod(int(c) * (2 - i % 2), 10)) for i, c in enumerate(reversed(payload)))
    return str(-total % 10)


def card(p: Permutation, text: str) -> str | None:
    digits = re.sub(r"\D", "", text)
    if not 13 <= len(digits) <= 19 or luhn_digit(digits[:-1]) != digits[-1] or len(set(digits)) == 1:
        return None
    body = _within(p, "card", digits[:-1], [DIGITS] * (len(digits) - 1))
    return _fill(text, body + luhn_digit(body))


def _iban_check(country: str, body: str) -> str:
    number = "".join(str(int(c, 36)) for c in body + country + "00")
    return f"{98 - int(number) % 97:02d}"


def iban(p: Permutation, text: str) -> str | None:
    raw = re.sub(r"[^A-Z0-9]", "", text)
    country, check, body = raw[:2], raw[2:4], raw[4:]
    if not 15 <= len(raw) <= 34 or _iban_check(country, body) != check:
        return None
    new = _within(p, "iban", body, [_alike(c) for c in body])
    return _fill(text, country + _iban_check(country, new) + new)


def _ssn_allowed(d: str) -> bool:
    return d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"


def ssn(p: Permutation, text: str) -> str | None:
    digits = text.replace("-", "")
    return _fill(text, _within(p, "ssn", digits, [DIGITS] * 9, _ssn_allowed)) if _ssn_allowed(digits) else None


# Where no separator ends it: one digit, one of the two-digit codes, or three digits.
_CALLING_CODE = re.compile(r"\+(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})")


def phone(p: Permutation, text: str) -> str | None:
    """The country code stays, and leading digits that no number may start with do not come up."""
    compact = re.fullmatch(r"\+\d{8,15}", text)
    code = _CALLING_CODE.match(text) if compact else re.match(r"\+\d{1,3}", text)
    head = text[:code.end()] if code else ""
    rest = text[len(head):]
    digits = re.sub(r"\D", "", rest)
    if not compact and not 7 <= len(digits) <= 12:
        return None
    alphabets = [DIGITS] * len(digits)
    if len(digits) == 10 and digits[0] > "1" and digits[3] > "1":
        alphabets[0] = alphabets[3] = DIGITS[2:]
    return head + _fill(rest, _within(p, "phone", digits, alphabets))


# Octets keep their number of digits, and so the address its length.
_OCTETS = {1: range(10), 2: range(10, 100), 3: range(100, 256)}


def ipv4(p: Permutation, text: str) -> str | None:
    octets = text.split(".")
    ranges = [_OCTETS[len(o)] for o in octets]
    if any(int(o) not in r for o, r in zip(octets, ranges)):
        return None
    value, size = 0, 1
    for o, r in zip(octets, ranges):
        value, size = value * len(r) + int(o) - r.start, size * len(r)
    value, out = p.once("ip", size, value), []
    for r in reversed(ranges):
        value, at = divmod(value, len(r))
        out.append(str(r.start + at))
    return ".".join(reversed(out))


_FIRST_DAY = datetime.date(1900, 1, 1).toordinal()
_DAYS = datetime.date(2100, 1, 1).toordinal() - _FIRST_DAY


def date(p: Permutation, text: str) -> str | None:
    """A day of 1900 to 2099 becomes another; year first, day first or month first as written."""
    a, sep, b, _, c = re.match(r"(\d+)([-./])(\d+)([-./])(\d+)", text).groups()
    orders = ["ymd"] if len(a) == 4 else ["dmy", "mdy"]
    for order in orders:
        try:
            parts = dict(zip(order, map(int, (a, b, c))))
            day = datetime.date(parts["y"], parts["m"], parts["d"]).toordinal() - _FIRST_DAY
        except ValueError:
            continue
        if not 0 <= day < _DAYS:
            return None
        fits = lambda d: order != "mdy" or d.day > 12  # noqa: E731  else it would be read day first
        new = datetime.date.fromordinal(_FIRST_DAY + p.valid(
            "date" + order, _DAYS, day, lambda v: fits(datetime.date.fromordinal(_FIRST_DAY + v))))
        values = {"y": f"{new.year:04d}", "m": f"{new.month:02d}", "d": f"{new.day:02d}"}
        return sep.join(values[k] for k in order)
    return None


def email(p: Permutation, text: str) -> str:
    local, _, domain = text.rpartition("@")
    return f"{_within(p, 'email', local, [_alike(c) for c in local])}@{domain}"


def _in_chunks(p: Permutation, kind: str, text: str, alphabets: list[str]) -> str:
    """A long text piece by piece; a piece's permutation depends on its number and on all text before it."""
    out, before = [], hashlib.blake2b(digest_size=16)
    for i in range(0, len(text), CHUNK):
        part = text[i:i + CHUNK]
        out.append(_within(p, f"{kind}|{i}|{before.hexdigest()}" if i else kind, part, alphabets[i:i + CHUNK]))
        before.update(part.encode())
    return "".join(out)


def secret(p: Permutation, text: str) -> str:
    """Hexadecimal stays hexadecimal; other letters and digits keep their class."""
    for alphabet in (HEX_LOWER, HEX_UPPER):
        if all(c in alphabet for c in text):
            return _in_chunks(p, "hex", text, [alphabet] * len(text))
    return _in_chunks(p, "secret", text, [_alike(c) for c in text])


# The patterns in order of precedence; where there is a group, it alone is replaced.
_EMAIL = re.compile(r"(?<![\w.%+-])[A-Za-z0-9](?:[A-Za-z0-9._%+-]{0,62}[A-Za-z0-9_%+-])?@(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.)+[A-Za-z]{2,}")
_NAMED = re.compile(r"(?i)\b(?:password|passwd|pwd|token|secret|api[_-]?key|access[_-]?key)\b[\"']?\s{0,3}[:=]\s{0,3}[\"']?([A-Za-z0-9+/_.~-]{8,})")
_CLOUD_KEY = re.compile(r"\b(?:AKIA|ASIA)([A-Z0-9]{16})\b")
_DATE = re.compile(r"(?<![\d./-])(?:\d{4}([-./])\d{1,2}\1\d{1,2}|\d{1,2}([-./])\d{1,2}\2\d{4})(?![\d/-]|\.\d)")
_IP = re.compile(r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?![\d]|\.\d)")
_IBAN = re.compile(r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b")
_IBAN_HEAD = re.compile(r"\b[A-Z]{2}\d{2}(?= ?[A-Z0-9])")
_CARD = re.compile(r"(?<![\d.,+-])\d(?:[ -]?\d){12,}(?!\d)")  # a whole run of groups; candidates() cuts it
_GROUP = re.compile(r"\d+")
# Lengths of IBANs by country.
_IBAN_LENGTHS = {c: n for n, countries in {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL FK SD", 19: "MK SI", 20: "AT BA EE KZ LT LU XK MN", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE",
    31: "MT SC", 32: "LC", 33: "RU"}.items() for c in countries.split()}
_SSN = re.compile(r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])")
_PHONE = re.compile(r"(?<![\w.+-])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{3}[ .-])\d{3}[ .-]?\d{4}(?![\w-]|\.\d)|(?<![\w.+-])\+\d{1,3}(?:[ .-]\d{2,4}){2,5}(?![\w-]|\.\d)|(?<![\w.+-])\+\d{8,15}(?![\w-]|\.\d)")
_DETECTORS: list[tuple[re.Pattern, Callable, bool]] = [
    (_EMAIL, email, False), (_NAMED, secret, True), (_CLOUD_KEY, secret, True), (_IBAN, iban, False), (_DATE, date, False),
    (_IP, ipv4, False), (_SSN, ssn, False), (_CARD, card, False), (_PHONE, phone, False),
]
_MAYBE = re.compile(r"[0-9@=:]")
_DIGIT = re.compile(r"[0-9]")
_NUMERIC = {_CLOUD_KEY, _IBAN, _DATE, _IP, _SSN, _CARD, _PHONE}


@lru_cache(maxsize=64)
def _iban_of(length: int) -> re.Pattern:
    return re.compile(rf"[A-Z]{{2}}\d{{2}}(?: ?[A-Z0-9]){{{length - 4}}}(?!\w)")


def _card_candidates(text: str) -> Iterator[tuple[int, int]]:
    """Every stretch of 13 to 19 digits that begins and ends at a group's border, by its start, longest first."""
    for run in _CARD.finditer(text):
        groups = [m.span() for m in _GROUP.finditer(text, *run.span())]
        whole = not re.match(r"[.,-]\d", text[run.end():run.end() + 2])
        for i, (start, _) in enumerate(groups):
            n, ends = 0, []
            for k in range(i, len(groups)):
                n += groups[k][1] - groups[k][0]
                if n > 19:
                    break
                if n >= 13 and (whole or k + 1 < len(groups)):
                    ends.append(groups[k][1])
            for end in reversed(ends):
                yield start, end


def _iban_candidates(text: str) -> Iterator[tuple[int, int]]:
    """From every head the country's length, else the longest match and what ends at a space inside it."""
    for head in _IBAN_HEAD.finditer(text):
        start = head.start()
        length = _IBAN_LENGTHS.get(text[start:start + 2])
        own = length and _iban_of(length).match(text, start)
        if own:
            yield own.span()
        longest = _IBAN.match(text, start)
        if longest:
            yield longest.span()
            for at in range(longest.end() - 1, start, -1):
                if text[at] == " ":
                    yield start, at


def candidates(pattern: re.Pattern, text: str, group: bool) -> Iterator[tuple[int, int]]:
    """Where a value of the pattern may be, by start; of the same start the likeliest first."""
    if pattern is _CARD:
        return _card_candidates(text)
    if pattern is _IBAN:
        return _iban_candidates(text)
    return (m.span(1) if group else m.span() for m in pattern.finditer(text))


def spans(text: str, p: Permutation) -> list[tuple[int, int, str]]:
    """(start, end, pseudonym) of what is replaced, in order and apart from each other."""
    digits = bool(_DIGIT.search(text))
    found: list[tuple[int, int, str]] = []
    for pattern, change, group in _DETECTORS:
        if pattern in _NUMERIC and not digits or pattern is _EMAIL and "@" not in text:
            continue
        for start, end in candidates(pattern, text, group):
            at = bisect_left(found, (start,))
            if at < len(found) and found[at][0] < end or at and found[at - 1][1] > start:
                continue
            new = change(p, text[start:end])
            if new is not None:
                found.insert(at, (start, end, new))
    return found


def replace(text: str, p: Permutation) -> tuple[str, int]:
    """The text with pseudonyms, and how many there are."""
    found = spans(text, p) if _MAYBE.search(text) else []
    if not found:
        return text, 0
    out, at = [], 0
    for start, end, new in found:
        out += [text[at:start], new]
        at = end
    return "".join([*out, text[at:]]), len(found)


@lru_cache(maxsize=4)
def _permutation(key: bytes) -> Permutation:
    return Permutation(key)


def pseudonymise(docs: DataFrame, key: bytes = KEY) -> DataFrame:
    """``docs`` with ``text`` replaced and ``_replaced`` (how many) added; n_chars, if there, follows the text.

    Where ``docs`` has a column ``_replaced`` of its own, the count gets one more underscore.
    """
    counter = free_name(docs, "_replaced")
    names = [*docs.columns, counter]
    schema = T.StructType([*docs.schema.fields, T.StructField(counter, T.IntegerType())])

    def batches(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = _permutation(key)
        for batch in given:
            done = [(None, 0) if t is None else replace(t, p) for t in batch.column("text").cast(pa.string()).to_pylist()]
            columns = dict(zip(batch.schema.names, batch.columns))
            columns["text"] = pa.array([d[0] for d in done], pa.string()).cast(columns["text"].type)
            columns[counter] = pa.array([d[1] for d in done], pa.int32())
            yield pa.RecordBatch.from_arrays([columns[n] for n in names], names=names)

    out = docs.mapInArrow(batches, schema)
    if "n_chars" in docs.columns:
        counted = F.when(F.col(counter) > 0, F.length("text")).otherwise(F.col("n_chars"))
        out = out.withColumn("n_chars", counted.cast(docs.schema["n_chars"].dataType))
    return out
