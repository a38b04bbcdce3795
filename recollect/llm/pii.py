"""Personal data replaced by format-preserving pseudonyms.

A match is validated (check digits, calendar dates, octets, numbering rules), read as a
number below the count of values of its format, and permuted by a keyed Feistel network
with cycle walking. Equal values thus get equal pseudonyms in every document, different
values different ones, and the pseudonym passes the same validation. Layout (spaces,
dashes, separators) stays as it was, and so does the script of decimal digits.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import re
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes

ROUNDS = 8
FIRST_DAY, LAST_DAY = dt.date(1900, 1, 1).toordinal(), dt.date(2099, 12, 31).toordinal()
DIGITS, LETTERS, HEX = "0123456789", "abcdefghijklmnopqrstuvwxyz", "0123456789abcdef"
OTHER_DIGIT = re.compile(r"(?![0-9])\d")
SPANS = "array<struct<kind string, start int, length int>>"

# Formats that are looked for, most specific first; digits of other scripts are read as 0-9 before.
PATTERNS = (
    ("email", r"(?<![\w.+-])[A-Za-z0-9][\w.+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}(?![\w@])"),
    ("access_key", r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])"),
    ("secret", r"(?i:(?<![a-z])(?:password|passwd|pwd|token|secret|api_?key)\s?[=:]\s?[\"']?)(?P<secret>[A-Za-z0-9_\-]{8,})"),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    ("date", r"(?<![\w.-])(?:\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}\.\d{1,2}\.\d{4})(?![\w-]|\.\d)"),
    ("ssn", r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"),
    ("ip", r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?!\w|\.\d)"),
    ("card", r"(?<![\w-])\d(?:[ -]?\d){12,18}(?![\w-])"),
    ("phone", r"(?<![\w+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4}|(?<=[\d][ .-])\d{3} \d{3} \d{4})(?!\w)"),
    ("phone", r"(?<![\w+])\+\d(?:[ .-]?\d){8,13}(?!\w)"),
)


class Feistel:
    """A keyed permutation of ``range(n)`` for any ``n``; ``kind`` gives each format its own."""

    def __init__(self, key: bytes, kind: str) -> None:
        self.key, self.kind = key, kind.encode()

    def _round(self, i: int, half: int, bits: int, n: int) -> int:
        size = bits // 8 + 1
        seed = b"%d|%d|%d" % (i, n, half)
        out = hashlib.blake2b(seed, key=self.key, person=self.kind[:16], digest_size=min(size + 8, 64)).digest()
        while len(out) < size:
            out += hashlib.blake2b(out[-64:], key=self.key, digest_size=64).digest()
        return int.from_bytes(out, "big") & ((1 << bits) - 1)

    def _once(self, x: int, n: int, bits: int) -> int:
        left, right = x >> bits, x & ((1 << bits) - 1)
        for i in range(ROUNDS):
            left, right = right, left ^ self._round(i, right, bits, n)
        return left << bits | right

    def permute(self, x: int, n: int, valid: Callable[[int], bool] = lambda _: True) -> int:
        """The image of ``x``; ``valid`` holds for ``x`` and so for a later point of its cycle."""
        bits = max(1, ((n - 1).bit_length() + 1) // 2)
        while True:
            x = self._once(x, n, bits)
            if x < n and valid(x):
                return x


def luhn_digit(payload: str) -> str:
    total = 0
    for i, c in enumerate(reversed(payload)):
        d = int(c) * (2 - i % 2)
        total += d - 9 * (d > 9)
    return str(-total % 10)


def iban_valid(text: str) -> bool:
    return 15 <= len(text) <= 34 and int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97 == 1


def _by_class(f: Feistel, text: str) -> str:
    """Digits become digits and letters letters of the same case; other characters stay."""
    radices = [10 if c in DIGITS else 26 if c.lower() in LETTERS else 1 for c in text]
    value, n = 0, 1
    for c, r in zip(text, radices):
        value, n = value * r + (0 if r == 1 else (DIGITS if r == 10 else LETTERS).index(c.lower())), n * r
    value, out = f.permute(value, n), []
    for c, r in zip(reversed(text), reversed(radices)):
        value, d = divmod(value, r)
        new = c if r == 1 else (DIGITS if r == 10 else LETTERS)[d]
        out.append(new.upper() if c.isupper() else new)
    return "".join(reversed(out))


def _laid_out(layout: str, values: str) -> str:
    """``values`` in place of the letters and digits of ``layout``."""
    it = iter(values)
    return "".join(next(it) if c.isalnum() else c for c in layout)


def _digits(text: str) -> str:
    return "".join(c for c in text if c in DIGITS)


def _read(text: str) -> str:
    """``text`` with 0-9 for the decimal digits of any script."""
    return text if text.isascii() else OTHER_DIGIT.sub(lambda m: str(unicodedata.decimal(m[0])), text)


def _in_script(old: str, new: str) -> str:
    """``new`` with its digits in the scripts that ``old`` has at their places."""
    if old.isascii() or len(old) != len(new):
        return new
    return "".join(chr(ord(o) - unicodedata.decimal(o) + int(c)) if c in DIGITS and o.isdecimal() else c for o, c in zip(old, new))


def _card(key: bytes, text: str) -> str | None:
    d = _digits(text)
    if luhn_digit(d[:-1]) != d[-1]:
        return None
    n = len(d) - 1
    new = str(Feistel(key, "card").permute(int(d[:-1]), 10**n)).zfill(n)
    return _laid_out(text, new + luhn_digit(new))


def _phone(key: bytes, text: str) -> str | None:
    d = _digits(text)
    local = d[-10:] if len(d) >= 10 else d
    good = lambda x: str(x).zfill(len(local))[0] in "23456789" and str(x).zfill(len(local))[3] in "23456789"
    n = 10 ** len(local)
    valid = good if len(local) == 10 and good(int(local)) else lambda _: True
    new = str(Feistel(key, "phone").permute(int(local), n, valid)).zfill(len(local))
    return _laid_out(text, d[: len(d) - len(local)] + new)


def _ssn(key: bytes, text: str) -> str | None:
    def good(x: int) -> bool:
        s = str(x).zfill(9)
        return s[:3] not in ("000", "666") and s[0] != "9" and s[3:5] != "00" and s[5:] != "0000"

    d = _digits(text)
    return _laid_out(text, str(Feistel(key, "ssn").permute(int(d), 10**9, good)).zfill(9)) if good(int(d)) else None


def _ip(key: bytes, text: str) -> str | None:
    parts = [int(p) for p in text.split(".")]
    if max(parts) > 255:
        return None
    if any(len(p) > 1 and p[0] == "0" for p in text.split(".")):
        return None
    ranges = [((0, 10), (10, 90), (100, 156))[len(p) - 1] for p in text.split(".")]  # first value, count
    value = n = 0
    for p, (low, count) in zip(parts, ranges):
        value, n = value * count + p - low, max(n, 1) * count

    def shown(x: int) -> list[int]:
        out = []
        for low, count in reversed(ranges):
            x, d = divmod(x, count)
            out.append(d + low)
        return out[::-1]

    good = (lambda x: 0 < shown(x)[0] < 224) if 0 < parts[0] < 224 else lambda _: True
    return ".".join(map(str, shown(Feistel(key, "ip").permute(value, n, good))))


def _date(key: bytes, text: str) -> str | None:
    parts = re.split(r"[-/.]", text)
    order = (0, 1, 2) if len(parts[0]) == 4 else (2, 1, 0)
    year, month, day = (int(parts[i]) for i in order)
    if "/" in text and order[0] and month > 12:  # month first
        order, month, day = (2, 0, 1), day, month
    try:
        at = dt.date(year, month, day).toordinal() - FIRST_DAY
    except ValueError:
        return None
    if not 0 <= at <= LAST_DAY - FIRST_DAY:
        return None

    def short(x: int) -> tuple[bool, bool]:
        date = dt.date.fromordinal(x + FIRST_DAY)
        return date.month < 10, date.day < 10

    # in every layout, so that equal dates with and without leading zeros stay linked
    fits = lambda x: short(x) == short(at)

    def shown(x: int) -> list[str]:
        date = dt.date.fromordinal(x + FIRST_DAY)
        out = ["", "", ""]
        for i, v in zip(order, (date.year, date.month, date.day)):
            out[i] = str(v).zfill(2)
        for i, w in enumerate(parts):
            if len(w) == 1:
                out[i] = out[i].lstrip("0")
        return out

    mark = next(c for c in text if c in "-/.")
    return mark.join(shown(Feistel(key, "date").permute(at, LAST_DAY - FIRST_DAY + 1, fits)))


def _iban(key: bytes, text: str) -> str | None:
    flat = text.replace(" ", "")
    if not iban_valid(flat):
        return None
    body = _by_class(Feistel(key, "iban"), flat[4:])
    check = 98 - int("".join(str(int(c, 36)) for c in body + flat[:2] + "00")) % 97
    return _laid_out(text, f"{flat[:2]}{check:02d}{body}")


def _email(key: bytes, text: str) -> str | None:
    local, _, domain = text.lower().partition("@")
    name, _, top = domain.rpartition(".")
    return f"{_by_class(Feistel(key, 'email'), local)}@{_by_class(Feistel(key, 'domain'), name)}.{top}"


def _secret(key: bytes, text: str) -> str | None:
    if all(c in HEX for c in text):
        n = len(text)
        return f"{Feistel(key, 'hex').permute(int(text, 16), 16**n):x}".zfill(n)
    return _by_class(Feistel(key, "secret"), text)


def _access_key(key: bytes, text: str) -> str | None:
    return text[:4] + _by_class(Feistel(key, "access_key"), text[4:])


# Characters at which a match of these kinds may end early, if as a whole it isn't valid or runs into another.
ENDS = {"card": " -", "iban": " ", "phone": " .-"}
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB PL SV", 29: "BR EG PS QA UA",
    30: "JO KW MU", 31: "MT SC", 32: "LC", 33: "RU",
}
IBAN_LENGTH = {country: n for n, countries in IBAN_LENGTHS.items() for country in countries.split()}


def _ends(kind: str, text: str, start: int, end: int) -> list[int]:
    """Where a match at ``start:end`` may end: the longest first, before all an IBAN of its country's length."""
    ends = [end, *(i for i in range(end - 1, start, -1) if text[i] in ENDS.get(kind, ""))]
    if kind == "iban":
        ends.sort(key=lambda e: e - start - text.count(" ", start, e) != IBAN_LENGTH.get(text[start : start + 2]))
    return ends


PSEUDONYMS = {
    "email": _email, "access_key": _access_key, "secret": _secret, "iban": _iban, "date": _date,
    "ssn": _ssn, "ip": _ip, "card": _card, "phone": _phone,
}


def pseudonymizer(key: bytes) -> Callable[[str], tuple[str, list[tuple[str, int, int]]]]:
    """``text -> (text, spans)``; spans are (kind, start, length) in the new text."""
    finders = [(kind, re.compile(p)) for kind, p in PATTERNS]
    gate = re.compile(r"[0-9@=:]")

    def apply(original: str) -> tuple[str, list[tuple[str, int, int]]]:
        text = _read(original)
        if not gate.search(text):
            return original, []
        found: list[tuple[int, int, str, str]] = []
        taken = bytearray(len(text))
        for kind, finder in finders:
            at = 0
            while m := finder.search(text, at):
                start, end = m.span("secret") if kind == "secret" else m.span()
                at = m.start() + 1  # a valid value may start inside of what is not one
                for stop in _ends(kind, text, start, end):
                    if any(taken[start:stop]) or (stop < end and not finder.fullmatch(text, start, stop)):
                        continue
                    new = PSEUDONYMS[kind](key, text[start:stop])
                    if new is not None:
                        found.append((start, stop, kind, new))
                        taken[start:stop] = b"\x01" * (stop - start)
                        at = stop
                        break
        if not found:
            return original, []
        out, spans, at, size = [], [], 0, 0
        for start, end, kind, new in sorted(found):
            out += [original[at:start], _in_script(original[start:end], new)]
            size += start - at
            spans.append((kind, size, len(new)))
            size, at = size + len(new), end
        return "".join([*out, original[at:]]), spans

    return apply


def pseudonymize(docs: DataFrame, key: bytes, text: str = "text", spans: str = "pii") -> DataFrame:
    """``docs`` with pseudonyms in ``text`` and the places of them in ``spans``.

    Every row stays, with all its columns; a column named ``spans`` is replaced. Null texts
    stay null with null spans, empty ones stay empty with none. Equal values of a kind
    always have equal pseudonyms, whatever their layout.
    """

    @F.pandas_udf(f"text string, spans {SPANS}")
    def replace(texts: pd.Series) -> pd.DataFrame:
        apply = pseudonymizer(key)
        done = [(None, None) if t is None else apply(t) for t in texts]
        spans = [None if s is None else [{"kind": k, "start": a, "length": n} for k, a, n in s] for _, s in done]
        return pd.DataFrame({"text": [t for t, _ in done], "spans": spans})

    made = by_bytes(docs).withColumn(spans, replace(F.col(text)))
    return made.withColumns({text: F.col(f"{spans}.text"), spans: F.col(f"{spans}.spans")})
