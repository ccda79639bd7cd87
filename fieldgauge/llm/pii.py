"""Format-preserving pseudonyms for personal data.

A value is recognised by its form and validated (checksum, calendar, ranges). It is then numbered
within the set of all valid values of its format, the number is permuted with a key, and the result is
written in the same format. A permutation keeps different values apart and equal values linked, in every
document and on every machine, and the holder of the key can undo it.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from datetime import date
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from fieldgauge.llm.common import fields_without
from fieldgauge.llm.feistel import permute, round_keys

_FIRST_YEAR, _LAST_YEAR = 1900, 2100
_DAY_CLASSES = [(1, 9), (10, 12), (13, 28), (29, 29), (30, 30), (31, 31)]
#: Country codes of one and two digits; those that begin otherwise have three, in these tens.
_COUNTRIES = {"7", *"20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()}
_THREE_DIGITS = set("21 22 23 24 25 26 29 35 37 38 42 50 59 67 68 69 85 88 96 97 99".split())
_LOWER, _UPPER, _DIGIT = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
_FORMS = [
    ("email", r"(?<![\w.+-])[A-Za-z0-9][\w.+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"),
    ("secret", r"(?i:(?<=password)|(?<=passwd)|(?<=token)|(?<=secret)|(?<=api_key)|(?<=api-key)|(?<=api key)|(?<=apikey)|(?<=access_key)|(?<=secret_key))(?:\s?[=:]\s?[\"']?)[0-9A-Za-z](?:[0-9A-Za-z_-]{6,}[0-9A-Za-z])"),
    ("iban", r"(?<![A-Za-z\d])[A-Z]{2}\d{2}(?: ?[A-Z\d]{4}){2,7}(?: ?[A-Z\d]{1,3})?(?![A-Za-z\d])"),
    ("ip", r"(?<![\w.])(?<!version )(?<!Version )(?:\d{1,3}\.){3}\d{1,3}(?![\d]|\.\d)"),
    ("iso_date", r"(?<![\d-])\d{4}-\d{2}-\d{2}(?![\d-])|(?<![\d/])\d{4}/\d{2}/\d{2}(?![\d/])"),
    ("date", r"(?<![\d/.])\d{1,2}([/.])\d{1,2}\1\d{4}(?![\d/])"),
    ("ssn", r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"),
    ("card", r"(?<![\d-])(?:\d{13,19}|\d{4}(?:[ -]\d{4}){2,3}(?:[ -]\d{1,3})?|\d{4}[ -]\d{6}[ -]\d{5})(?!\d|-\d)"),
    ("phone", r"(?<![\d(+])(?:\+(?:1|(?![0-9])\d)[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\d)"),
    ("intl_phone", r"(?<![\d+])\+(?![01])\d{1,3}(?:[ .-]?\(?\d{1,4}\)?){2,5}(?!\d)"),
]
_ANY = re.compile("|".join(f"(?P<{k}>{p.replace('([/.])', '(?P<sep>[/.])').replace(chr(92) + '1', '(?P=sep)')})" for k, p in _FORMS))
_HINT = re.compile(r"[\d@]|password|passwd|token|secret|api[_ -]?key|access_key", re.I)


def luhn(digits: str) -> int:
    """What the weighted digits leave when divided by 10; 0 for a valid number."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10


class Pseudonyms:
    """Keyed permutations of the valid values of each format. ``back`` undoes them."""

    def __init__(self, key: str, back: bool = False):
        self.key, self.back = key, back
        self.of = lru_cache(100_000)(self._in_script)

    def _move(self, value: int, n: int, name: str) -> int:
        return int(permute(np.array([value]), n, round_keys(f"{self.key}/{name}/{n}"), self.back)[0])

    def _refill(self, text: str, digits: str) -> str:
        it = iter(digits)
        return "".join(next(it) if c in _DIGIT else c for c in text)

    def _letters(self, text: str, name: str, hexadecimal: bool = False) -> str:
        """Each ASCII letter and digit by one of its own class, in blocks that one number can hold."""
        out, block, n, value = list(text), [], 1, 0

        def flush():
            nonlocal block, n, value
            if block:
                value = self._move(value, n, f"{name}/{len(block)}")
                for i, chars in reversed(block):
                    value, d = divmod(value, len(chars))
                    out[i] = chars[d]
            block, n, value = [], 1, 0

        for i, c in enumerate(text):
            chars = "0123456789abcdef" if hexadecimal else next((k for k in (_LOWER, _UPPER, _DIGIT) if c in k), None)
            if chars is None:
                continue
            if n * len(chars) >= 1 << 60:
                flush()
            block.append((i, chars))
            n, value = n * len(chars), value * len(chars) + chars.index(c)
        flush()
        return "".join(out)

    def _in_script(self, kind: str, text: str) -> str | None:
        """As `_of`, for values in the digits of any script; the pseudonym has digits of that script."""
        if text.isascii():
            return self._of(kind, text)
        values = [unicodedata.decimal(c, None) for c in text]
        new = self._of(kind, "".join(c if v is None else str(v) for c, v in zip(text, values, strict=True)))
        zeros = [None if v is None else ord(c) - v for c, v in zip(text, values, strict=True)]
        if new is None or not any(zeros):
            return new
        if len(new) != len(text) or any((v is None) == (c in _DIGIT) for c, v in zip(new, values, strict=True)):
            zeros = [next(z for z in zeros if z)] * len(new)
        return "".join(chr(z + int(c)) if z and c in _DIGIT else c for c, z in zip(new, zeros, strict=True))

    def _of(self, kind: str, text: str) -> str | None:
        """The pseudonym of a value with ASCII digits, or None where the value is not valid."""
        digits = "".join(c for c in text if c in _DIGIT)
        if kind == "email":
            local, _, host = text.partition("@")
            return f"{self._letters(local, 'email')}@{host}"
        if kind == "secret":
            m = re.match(r"(\s?[=:]\s?[\"']?)(.*)", text, re.S)
            return m[1] + self._letters(m[2], "secret", bool(re.fullmatch(r"[0-9a-f]+", m[2])))
        if kind == "iban":
            plain = text.replace(" ", "")
            if int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 != 1:
                return None
            body = self._letters(plain[4:], "iban/" + plain[:2])
            check = 98 - int("".join(str(int(c, 36)) for c in body + plain[:2] + "00")) % 97
            it = iter(plain[:2] + f"{check:02d}" + body)
            return "".join(c if c == " " else next(it) for c in text)
        if kind == "ip":
            parts = text.split(".")
            if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
                return None
            v = self._move(int.from_bytes(bytes(map(int, parts)), "big"), 1 << 32, "ip")
            return ".".join(map(str, v.to_bytes(4, "big")))
        if kind in ("iso_date", "date"):
            parts = re.split(r"([-/.])", text)
            first = int(parts[0])
            order = "ymd" if kind == "iso_date" else "dmy" if parts[1] == "." or first > 12 else "mdy"
            named = dict(zip(order, map(int, parts[::2]), strict=True))
            if not (_FIRST_YEAR <= named["y"] < _LAST_YEAR and _has(**named)):
                return None
            new = self._date(**named)
            return "".join(p if i % 2 else f"{new[order[i // 2]]:0{len(p)}d}" for i, p in enumerate(parts))
        if kind == "ssn":
            a, g, s = int(digits[:3]), int(digits[3:5]), int(digits[5:])
            if not 0 < a < 900 or a == 666 or not g or not s:
                return None
            v = self._move(((a - 1 - (a > 666)) * 99 + g - 1) * 9999 + s - 1, 898 * 99 * 9999, "ssn")
            v, s = divmod(v, 9999)
            a, g = divmod(v, 99)
            a += 1 + (a >= 665)
            return f"{a:03d}-{g + 1:02d}-{s + 1:04d}"
        if kind == "card":
            if luhn(digits):
                return None
            body = f"{self._move(int(digits[1:-1]), 10 ** (len(digits) - 2), 'card/' + digits[0]):0{len(digits) - 2}d}"
            body = digits[0] + body
            return self._refill(text, body + str((10 - luhn(body + "0")) % 10))
        if kind == "phone" and digits[:-10] in ("", "1"):
            lead, own = digits[:-10], digits[-10:]
            if own[0] in "01" or own[3] in "01":
                return None
            v = ((int(own[:3]) - 200) * 800 + int(own[3:6]) - 200) * 10_000 + int(own[6:])
            v, line = divmod(self._move(v, 800 * 800 * 10_000, "phone"), 10_000)
            a, x = divmod(v, 800)
            return self._refill(text, f"{lead}{a + 200}{x + 200}{line:04d}")
        # other numbers keep the country in front
        lead = next((digits[:k] for k in (1, 2) if digits[:k] in _COUNTRIES), digits[:3] if digits[:2] in _THREE_DIGITS else None)
        if not lead or not 8 <= len(digits) <= 15:
            return None
        n = len(digits) - len(lead)
        return self._refill(text, lead + f"{self._move(int(digits[len(lead):]), 10**n, 'phone/' + lead):0{n}d}")

    def _date(self, y: int, m: int, d: int) -> dict[str, int]:
        """The pseudonym of a day, the same in every way of writing it.

        Days and months keep their number of digits, and days that no month can be stay so: a date that is
        written without zeros, or with the day in front, is then read the same way again.
        """
        low, high = next(x for x in _DAY_CLASSES if x[0] <= d <= x[1])
        months, width = _months(m < 10, high), high - low + 1
        v = self._move(months.index((y, m)) * width + d - low, len(months) * width, f"date/{low}/{m < 10}")
        y, m = months[v // width]
        return {"y": y, "m": m, "d": low + v % width}

    def apply(self, text: str | None) -> tuple[str | None, list[str]]:
        """The text with pseudonyms, and the kind of each value that was replaced, in order."""
        if not text or not _HINT.search(text):
            return text, []
        kinds: list[str] = []

        def put(m: re.Match) -> str:
            new = self.of(m.lastgroup if m.lastgroup != "sep" else "date", m[0])
            if new is None:
                return m[0]
            kinds.append("date" if m.lastgroup in ("sep", "iso_date") else "phone" if m.lastgroup == "intl_phone" else m.lastgroup)
            return new

        return _ANY.sub(put, text), kinds


def _has(y: int, m: int, d: int) -> bool:
    try:
        date(y, m, d)
    except ValueError:
        return False
    return True


@lru_cache(16)
def _months(short: bool, day: int) -> list[tuple[int, int]]:
    """The years and months, of one digit or of two, that have such a day."""
    return [(y, m) for y in range(_FIRST_YEAR, _LAST_YEAR) for m in (range(1, 10) if short else range(10, 13)) if _has(y, m, day)]


def pseudonymized(docs: DataFrame, key: str, text_col: str = "text", maker: Callable[[str], Pseudonyms] = Pseudonyms) -> DataFrame:
    """The rows with pseudonyms in their whole texts and ``kinds array<string>`` of what was replaced.

    Hosts of mail addresses and signs within secrets are kept. Null and empty texts stay as they are, with no kinds. One pass, no shuffle; equal values get equal
    pseudonyms wherever they stand. Values that fail validation stay. A column named ``kinds``, in letters of any case, is replaced.
    """
    keep = fields_without(docs, ["kinds"])
    schema = T.StructType([*keep, T.StructField("kinds", T.ArrayType(T.StringType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = maker(key)
        for batch in batches:
            done = [names.apply(t) for t in batch.column(text_col).to_pylist()]
            texts, kinds = pa.array([t for t, _ in done], pa.string()), pa.array([k for _, k in done], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([*(texts if f.name == text_col else batch.column(f.name) for f in keep), kinds], names=schema.names)

    return docs.mapInArrow(run, schema)
