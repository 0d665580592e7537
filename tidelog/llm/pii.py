"""Format-preserving pseudonyms for personal data, by a keyed Feistel permutation.

A value is found by pattern and then validated: card numbers by their check digit and IBANs by theirs, dates by
the calendar, social security numbers, phone numbers and IPv4 addresses by the ranges that are in use. The
value's place among all valid values of its format goes through a Feistel network (ROUNDS rounds of keyed
BLAKE2b; results outside the range are permuted again until they fall inside), and the value at the new place,
written with the same separators, takes its stead. The mapping is one to one for each format and key, so
equal values stay linked across documents however they are spaced, and `reverse` undoes it. E-mail names
and hosts and secrets (access keys, passwords, tokens) are permuted letter for letter, digit for digit.

A value of more than CHUNK characters is permuted in chunks of so many, forwards and then backwards, and a chunk's
permutation depends on its place and on all that was made before it. So every character of the result
depends on every character of the value, and the time follows its length. A secret is permuted again until
the result is of its own kind (access key, digits, hexadecimal, other), which is what `reverse` goes by.

Only values change; a text without any stays as it is, byte for byte. Texts without a digit, '@' or '=' never
leave the JVM. Defined results: null stays null and empty stays empty; numbers that fail validation stay; the
same row twice gives the same text twice; empty tables give no rows; other columns pass unchanged.
"""

from __future__ import annotations

import datetime
import hashlib
import re
from bisect import bisect_left
from collections.abc import Callable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 10

#: Characters of a value that one permutation takes.
CHUNK = 64

#: A key for tests and examples; a deployment passes its own.
EXAMPLE_KEY = b"an example key, not for production"

FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()


class Feistel:
    """A permutation of 0 ... size - 1 for every (format, size) under one key."""

    def __init__(self, key: bytes, reverse: bool = False):
        self.key, self.reverse = hashlib.blake2b(key, digest_size=32).digest(), reverse

    def _round(self, tweak: bytes, i: int, half: int, bits: int) -> int:
        out, need = b"", (bits + 7) // 8
        block = 0
        while len(out) < need:
            message = tweak + bytes([i, block]) + half.to_bytes(need, "big")
            out += hashlib.blake2b(message, key=self.key, digest_size=64).digest()
            block += 1
        return int.from_bytes(out[:need], "big") & ((1 << bits) - 1)

    def __call__(self, value: int, size: int, form: str) -> int:
        if size < 2:
            return value
        bits = max(1, ((size - 1).bit_length() + 1) // 2)
        tweak = f"{form}:{size}:".encode()
        mask = (1 << bits) - 1
        while True:
            left, right = value >> bits, value & mask
            if self.reverse:
                for i in reversed(range(ROUNDS)):
                    left, right = right ^ self._round(tweak, i, left, bits), left
            else:
                for i in range(ROUNDS):
                    left, right = right, left ^ self._round(tweak, i, right, bits)
            value = left << bits | right
            if value < size:
                return value


def luhn(digits: str) -> bool:
    """The last digit checks the others."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _refill(shape: str, digits: str) -> str:
    """shape with its digits taken from `digits` in order."""
    it = iter(digits)
    return "".join(next(it) if "0" <= c <= "9" else c for c in shape)


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _chunked(text: str, form: str, permute: Feistel, one: Callable[[str, str, Feistel], str]) -> str:
    """`one` over a text of any length."""
    if len(text) <= CHUNK:
        return one(text, form, permute)
    parts = [text[i : i + CHUNK] for i in range(0, len(text), CHUNK)]
    forwards = range(len(parts))
    for way, places in reversed([("on", forwards), ("back", forwards[::-1])]) if permute.reverse else (("on", forwards), ("back", forwards[::-1])):
        made = hashlib.blake2b(f"{form}:{way}:{len(text)}".encode(), key=permute.key, digest_size=16)
        for i in places:
            before, old = made.hexdigest(), parts[i]
            parts[i] = one(old, f"{form}:{way}:{i}:{before}", permute)
            made.update((old if permute.reverse else parts[i]).encode())
    return "".join(parts)


def _letters(text: str, form: str, permute: Feistel) -> str:
    """Letters for letters of their case, digits for digits; anything else stays."""
    return _chunked(text, form, permute, _few_letters)


def _hexadecimal(text: str, form: str, permute: Feistel) -> str:
    return _chunked(text, form, permute, lambda x, f, p: format(p(int(x, 16), 16 ** len(x), f"{f}{len(x)}"), f"0{len(x)}x"))


def _few_letters(text: str, form: str, permute: Feistel) -> str:
    ranges = {c: (base, n) for base, n, chars in ((97, 26, "abcdefghijklmnopqrstuvwxyz"), (65, 26, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), (48, 10, "0123456789")) for c in chars}
    value, size = 0, 1
    for c in text:
        if c in ranges:
            base, n = ranges[c]
            value, size = value * n + ord(c) - base, size * n
    shape = "".join("aA0"[(97, 65, 48).index(ranges[c][0])] if c in ranges else c for c in text)
    value = permute(value, size, f"{form}:{shape}")
    out = []
    for c in reversed(text):
        if c in ranges:
            base, n = ranges[c]
            value, d = divmod(value, n)
            c = chr(base + d)
        out.append(c)
    return "".join(reversed(out))


def _card(m: re.Match, permute: Feistel) -> str | None:
    d = _digits(m[0])
    if not luhn(d) or d[0] not in "23456":
        return None
    n = len(d) - 2
    body = d[0] + str(permute(int(d[1:-1]), 10**n, f"card{d[0]}")).zfill(n)
    return _refill(m[0], body + next(c for c in "0123456789" if luhn(body + c)))


def _iban(m: re.Match, permute: Feistel) -> str | None:
    flat = m[0].replace(" ", "")
    number = lambda s: int("".join(str(int(c, 36)) for c in s))
    if not 15 <= len(flat) <= 34 or number(flat[4:] + flat[:4]) % 97 != 1:
        return None
    bank = _letters(flat[4:], "iban" + flat[:2], permute)
    new = flat[:2] + str(98 - number(bank + flat[:2] + "00") % 97).zfill(2) + bank
    it = iter(new)
    return "".join(c if c == " " else next(it) for c in m[0])


def _ssn(m: re.Match, permute: Feistel) -> str | None:
    area, group, serial = int(m[0][:3]), int(m[0][4:6]), int(m[0][7:])
    if area in (0, 666) or area >= 900 or not group or not serial:
        return None
    place = ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1
    place, serial = divmod(permute(place, 898 * 99 * 9999, "ssn"), 9999)
    area, group = divmod(place, 99)
    return f"{area + 1 + (area >= 665):03d}-{group + 1:02d}-{serial + 1:04d}"


def _phone(m: re.Match, permute: Feistel) -> str | None:
    """North American: area code and exchange begin with 2 to 9."""
    d = _digits(m[0])
    lead, d = d[:-10], d[-10:]
    if d[0] in "01" or d[3] in "01":
        return None
    place = ((int(d[:3]) - 200) * 800 + int(d[3:6]) - 200) * 10_000 + int(d[6:])
    place, line = divmod(permute(place, 800 * 800 * 10_000, "phone"), 10_000)
    area, exchange = divmod(place, 800)
    return _refill(m[0], f"{lead}{area + 200}{exchange + 200}{line:04d}")


def _abroad(m: re.Match, permute: Feistel) -> str | None:
    """International: the country code and one digit stay."""
    d = _digits(m[0])
    if not 8 <= len(d) <= 15:
        return None
    n = len(d) - 3
    return _refill(m[0], d[:3] + str(permute(int(d[3:]), 10**n, f"phone{d[:3]}")).zfill(n))


def _ip(m: re.Match, permute: Feistel) -> str | None:
    parts = [int(x) for x in m[0].split(".")]
    if max(parts) > 255 or any(len(x) > 1 and x[0] == "0" for x in m[0].split(".")) or parts[0] in (0, 127):
        return None
    place = (((parts[0] - 1 - (parts[0] > 127)) * 256 + parts[1]) * 256 + parts[2]) * 256 + parts[3]
    place = permute(place, 254 << 24, "ip")
    first = (place >> 24) + 1
    return ".".join(map(str, (first + (first >= 127), place >> 16 & 255, place >> 8 & 255, place & 255)))


def _date(m: re.Match, permute: Feistel) -> str | None:
    """Year first with hyphens; else day and month around dots (day first) or slashes (month first if that is a date, else day first)."""
    a, b, c = (int(x) for x in re.split(r"[-./]", m[0]))
    mark = m[0][4] if m[0][:4].isdigit() else m[0][len(m[0]) - 5]
    y, mo, d, month_first = (a, b, c, False) if mark == "-" else (c, b, a, False) if mark == "." or a > 12 else (c, a, b, True)
    try:
        day = datetime.date(y, mo, d).toordinal()
    except ValueError:
        return None
    if not FIRST_DAY <= day <= LAST_DAY:
        return None
    # Days that fit both slash orders and days that fit one only keep apart, so that reading the new date back finds its order.
    if mark == "/":
        days = _slash_days(month_first)
        new = datetime.date.fromordinal(days[permute(_slash_place(month_first)[day], len(days), f"date/{month_first}")])
    else:
        new = datetime.date.fromordinal(FIRST_DAY + permute(day - FIRST_DAY, LAST_DAY - FIRST_DAY + 1, "date"))
    if mark == "-":
        return new.isoformat()
    parts = (new.month, new.day) if month_first else (new.day, new.month)
    return f"{parts[0]:02d}{mark}{parts[1]:02d}{mark}{new.year}"


@lru_cache
def _slash_days(month_first: bool) -> list[int]:
    """Every day, where the month is first; days after the 12th, where the day is."""
    return [x for x in range(FIRST_DAY, LAST_DAY + 1) if month_first or datetime.date.fromordinal(x).day > 12]


@lru_cache
def _slash_place(month_first: bool) -> dict[int, int]:
    return {x: i for i, x in enumerate(_slash_days(month_first))}


def _email(m: re.Match, permute: Feistel) -> str:
    name, _, host = m[0].partition("@")
    *labels, top = host.split(".")
    return _letters(name, "name", permute) + "@" + ".".join([*(_letters(x, "host", permute) for x in labels), top])


def _kind(value: str) -> str:
    """What a secret is by its look; empty if it is none."""
    if not any("0" <= c <= "9" for c in value):
        return ""
    if re.fullmatch("[0-9]+", value):
        return "digits"
    return "hex" if re.fullmatch("[0-9a-f]+", value) else "key" if value.startswith(("AKIA", "ASIA")) else "secret"


def _secret(m: re.Match, permute: Feistel) -> str | None:
    value, kind = m["value"], _kind(m["value"])
    if not kind:
        return None
    fixed, new = 4 if kind == "key" else 0, value
    while True:
        new = new[:fixed] + (_hexadecimal if kind == "hex" else _letters)(new[fixed:], kind if kind == "hex" else "secret", permute)
        if _kind(new) == kind:
            return (m["lead"] or "") + new


#: Fixed patterns, tried in this order at each place of a text; a group's name is the format.
FORMS: dict[str, tuple[str, Callable[[re.Match, Feistel], str | None]]] = {
    "secret": (r"(?<!\w)(?:(?P<lead>(?i:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)\s{0,3}[=:]\s{0,3}[\"']?)(?=[\w+/-]{8})|(?=A[KS]IA[0-9A-Z]{16}(?!\w)))(?P<value>[\w+/-]+)", _secret),
    "email": (r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9-])", _email),
    "iban": (r"(?<!\w)[A-Z]{2}\d\d(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)", _iban),
    "card": (r"(?<![\w+-])\d(?:[ -]?\d){12,18}(?![\w-])", _card),
    "ssn": (r"(?<![\w-])\d{3}-\d\d-\d{4}(?![\w-])", _ssn),
    "ip": (r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?!\w|\.\d)", _ip),
    "date": (r"(?<![\w./-])(?:\d{4}-\d\d-\d\d|\d{1,2}\.\d{1,2}\.\d{4}|\d{1,2}/\d{1,2}/\d{4})(?!\w|[./-]\d)", _date),
    "phone": (r"(?<![\w+-])(?:\+?1[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?![\w-])", _phone),
    "abroad": (r"(?<![\w+])\+[2-9]\d{0,2}(?:[ .-]?\(?\d{1,4}\)?){2,5}(?!\w)", _abroad),
}

#: The places where a form can begin or that it holds; texts without any are passed over.
HINT = "[0-9@=]"


class Pseudonyms:
    """Replaces the values of a text; reverse: the other way round."""

    def __init__(self, key: bytes, reverse: bool = False):
        self.permute = Feistel(key, reverse)
        self.forms = [(re.compile(p, re.ASCII), f, need) for (p, f), need in zip(FORMS.values(), ("=:", "@", "", "", "-", ".", "-./", "", "+"), strict=True)]
        self.access = "KIA", "SIA"

    def __call__(self, text: str) -> tuple[str, int]:
        """(text, values replaced). Of values that overlap the first form's stays."""
        spans: list[tuple[int, int, str]] = []  # by place
        starts: list[int] = []
        for pattern, new, need in self.forms:
            if need and not any(c in text for c in need) and not (new is _secret and any(a in text for a in self.access)):
                continue
            found = []
            for m in pattern.finditer(text):
                i = bisect_left(starts, m.end())  # what was taken begins before its end, or behind it
                if i and spans[i - 1][1] > m.start():
                    continue
                made = new(m, self.permute)
                if made is not None:
                    found.append((m.start(), m.end(), made))
            if found:
                spans = sorted(spans + found)
                starts = [a for a, _, _ in spans]
        if not spans:
            return text, 0
        out, at = [], 0
        for a, z, made in spans:
            out += [text[at:a], made]
            at = z
        return "".join([*out, text[at:]]), len(spans)


def pseudonymised(text: Column, key: bytes, reverse: bool = False) -> Column:
    """A struct of the text with its values replaced, and their number."""

    def run(texts: pa.Array) -> pa.Array:
        replace = Pseudonyms(key, reverse)
        pairs = [(None, 0) if t is None else replace(t) for t in texts.to_pylist()]
        return pa.StructArray.from_arrays([pa.array([p[0] for p in pairs], pa.string()), pa.array([p[1] for p in pairs], pa.int32())], ["text", "n"])

    found = F.arrow_udf(run, "struct<text:string,n:int>")(F.when(text.rlike(HINT), text))
    return F.struct(F.coalesce(found["text"], text).alias("text"), found["n"].alias("n"))


def pseudonymise(docs: DataFrame, key: bytes, reverse: bool = False) -> DataFrame:
    """docs with its text column replaced."""
    return docs.withColumn("text", pseudonymised(F.col("text"), key, reverse)["text"])


def report(docs: DataFrame, key: bytes) -> DataFrame:
    """doc_id, text, n_values of every row."""
    return docs.select("doc_id", pseudonymised(F.col("text"), key).alias("p")).select("doc_id", "p.text", F.col("p.n").alias("n_values"))
