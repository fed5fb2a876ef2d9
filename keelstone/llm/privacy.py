"""Format-preserving pseudonyms of personal numbers, dates and addresses.

A finding is validated first (Luhn sum, IBAN remainder, calendar, address ranges), then
permuted inside its own format by a keyed Feistel network: a card stays a card number of
that length with a right check digit, a date stays a date in that notation. The network is
a bijection of ``0 .. size - 1``, so equal values have equal pseudonyms in all documents,
different ones differ, and whoever has the key can reverse it.
"""

from __future__ import annotations

import bisect
import datetime
import hashlib
import hmac
import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from keelstone.llm.batches import byte_view, keyed, slices, texts_of

ROUNDS = 8
#: Letters beyond ASCII in addresses: of alphabets written with spaces, and of any script.
_ALPHABETS = "\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u058f\u1e00-\u1fff"
_SCRIPTS = "\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u1fff\u2c00-\u2dff\u3040-\ud7ff\uf900-\ufdff\ufe70-\ufefc\uff10-\uffdc\U00010000-\U0001efff\U00020000-\U0003ffff"
#: Country calling codes; no one begins another. What is not listed has three digits.
_CALLING = r"\+(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"
_FIRST_DAY, _DAYS = datetime.date(1900, 1, 1).toordinal(), 73_049  # up to 2099-12-31


def _round_value(key: bytes, tweak: bytes, number: int, half: int, size: int) -> int:
    message = tweak + b"|%d|%d" % (number, half)
    return int.from_bytes(hmac.digest(key, message, hashlib.sha256), "big") % size


def permute(value: int, size: int, key: bytes, tweak: bytes, backwards: bool = False) -> int:
    """A keyed bijection of ``0 .. size - 1``.

    The network works on ``a * b >= size`` with near equal halves; results outside the
    range are permuted again until they fall into it. Sizes under 2 have one value only.
    """
    if size < 2:
        return value
    a = math.isqrt(size) + 1
    b = -(-size // a)
    while True:
        left, right = divmod(value, b)
        rounds = range(ROUNDS - 1, -1, -1) if backwards else range(ROUNDS)
        for number in rounds:
            sign = -1 if backwards else 1
            if number % 2 == 0:
                left = (left + sign * _round_value(key, tweak, number, right, a)) % a
            else:
                right = (right + sign * _round_value(key, tweak, number, left, b)) % b
        value = left * b + right
        if value < size:
            return value


def luhn_digit(body: str) -> int:
    """Check digit that follows the digits."""
    total = 0
    for place, digit in enumerate(reversed(body)):
        value = int(digit) * (2 if place % 2 == 0 else 1)
        total += value - 9 if value > 9 else value
    return -total % 10


def _email_pattern(letters: str) -> str:
    """Addresses with these letters beside the ASCII ones."""
    word = rf"\w{letters}"
    plain = f"A-Za-z0-9{letters}"
    return rf"(?<![{word}.+-])[{plain}][{word}.+-]{{0,63}}@(?:[{plain}-]+\.)+[A-Za-z{letters}]{{2,}}"


def _refill(text: str, digits: str) -> str:
    """The digits of a text replaced one by one, everything else kept."""
    following = iter(digits)
    return re.sub(r"\d", lambda _: next(following), text)


class Pseudonyms:
    """Findings of one text and their replacements under a key.

    Kinds, in the order in which they claim a place: ``email``, ``iban``, ``card``, ``ssn``,
    ``phone``, ``date``, ``ipv4``. ``backwards`` restores.

    Addresses may have letters beyond ASCII, which stay as they are; scripts written without
    spaces are part of an address only where no other address is found. Dates are written
    with the year first (a time may follow after a ``T``) or last, their days and months
    with one digit or two. Phones are North American ones, or begin with ``+`` and have 7
    to 15 digits in any grouping, of which the longest run counts.
    """

    def __init__(self, key: bytes, backwards: bool = False) -> None:
        self.key, self.backwards = key, backwards
        # Notations of personal data.
        kinds: list[tuple[str, str, Callable[[str], str | None | list[tuple[int, int, str]]]]] = [
            ("email", _email_pattern(_ALPHABETS), self._email),
            ("email", _email_pattern(_SCRIPTS), self._email),
            ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", self._iban),
            ("card", r"(?<![\w.])\d(?:[ -]?\d){12,}(?!\w)", self._cards),
            ("ssn", r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])", self._ssn),
            ("phone", r"(?<!\w)\+?\d{1,3}[ .-]?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\w)", self._phone),
            ("phone", r"(?<![\w(])\(\d{3}\) ?\d{3}-\d{4}(?!\w)", self._phone),
            ("phone", r"(?<![\w.+-])(?:\+\d{1,3}[ .-])?\d{3}[ .-]\d{3}[ .-]\d{4}(?![\w-])", self._phone),
            ("date", r"(?<![\w./-])\d{4}([-/.])\d{2}\1\d{2}(?=[Tt]\d\d|(?![\w/-]))", self._iso_date),
            ("date", r"(?<![\w./-])\d{2}([-/.])\d{2}\1\d{4}(?![\w/-])", self._day_date),
            ("ipv4", r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?![\w]|\.\d)", self._ipv4),
            ("date", r"(?<![\w./-])\d{4}([-/.])\d{1,2}\1\d{1,2}(?=[Tt]\d\d|(?![\w/-]|\.\d))", self._short_iso_date),
            ("date", r"(?<![\w./-])\d{1,2}([-/.])\d{1,2}\1\d{4}(?![\w/-]|\.\d)", self._short_day_date),
            ("phone", r"(?<![\w+])\+\(?\d(?:(?:[ ./-]|[ .-]?\(|\)[ .-]?)?\d){6,14}(?!\w)", self._international),
        ]
        self.kinds = [(name, re.compile(pattern, re.ASCII), rule) for name, pattern, rule in kinds]

    def _number(self, value: int, size: int, kind: str) -> int:
        return permute(value, size, self.key, kind.encode(), self.backwards)

    def _digits(self, digits: str, kind: str) -> str:
        return f"{self._number(int(digits), 10 ** len(digits), f'{kind}{len(digits)}'):0{len(digits)}d}"

    def _email(self, text: str) -> str:
        """Letters and digits of the local part; the domain stays."""
        local, _, domain = text.rpartition("@")
        lower = [c for c in local if c.isascii() and c.islower()]
        upper = [c for c in local if c.isascii() and c.isupper()]
        digit = [c for c in local if c.isascii() and c.isdigit()]
        shape = re.sub("[0-9]", "0", re.sub("[A-Z]", "A", re.sub("[a-z]", "a", local)))
        value = 0
        for c in local:
            if c.isascii() and c.isalnum():
                base, first = (10, "0") if c.isdigit() else (26, "A" if c.isupper() else "a")
                value = value * base + ord(c) - ord(first)
        size = 26 ** (len(lower) + len(upper)) * 10 ** len(digit)
        value = self._number(value, size, f"email|{shape}|{domain.lower()}")
        out = []
        for c in reversed(local):
            if c.isascii() and c.isalnum():
                base, first = (10, "0") if c.isdigit() else (26, "A" if c.isupper() else "a")
                value, rest = divmod(value, base)
                c = chr(ord(first) + rest)
            out.append(c)
        return "".join(reversed(out)) + "@" + domain

    def _iban(self, text: str) -> str | None:
        plain = text.replace(" ", "")
        number = lambda s: int("".join(str(int(c, 36)) for c in s))
        if not 15 <= len(plain) <= 34 or number(plain[4:] + plain[:4]) % 97 != 1:
            return None
        country, body = plain[:2], plain[4:]
        digits = "".join(c for c in body if c.isdigit())
        if digits:
            body = _refill(body, self._digits(digits, f"iban{country}{re.sub('[0-9]', '0', body)}"))
        check = 98 - number(body + country + "00") % 97
        plain = iter(f"{country}{check:02d}{body}")
        return re.sub("[A-Z0-9]", lambda _: next(plain), text)

    def _cards(self, text: str) -> list[tuple[int, int, str]]:
        """Card numbers among groups of digits: each the longest one that starts at its group."""
        groups = [m.span() for m in re.finditer("[0-9]+", text)]
        found, at = [], 0
        while at < len(groups):
            start, step = groups[at][0], 1
            for to in range(at, min(at + 19, len(groups))):
                digits = re.sub("[^0-9]", "", text[start : groups[to][1]])
                if len(digits) > 19:
                    break
                if len(digits) >= 13 and luhn_digit(digits[:-1]) == int(digits[-1]):
                    step = to + 1 - at
            end = groups[at + step - 1][1]
            if step > 1 or 13 <= end - start <= 19:
                best = re.sub("[^0-9]", "", text[start:end])
                if luhn_digit(best[:-1]) == int(best[-1]):
                    body = self._digits(best[:-1], "card")
                    found.append((start, end, _refill(text[start:end], body + str(luhn_digit(body)))))
            at += step
        return found

    def _ssn(self, text: str) -> str | None:
        """Areas 001-665 and 667-899, groups 01-99, serials 0001-9999."""
        area, group, serial = map(int, text.split("-"))
        if area in (0, 666) or area > 899 or not group or not serial:
            return None
        place = area - 1 - (area > 666)
        value = self._number((place * 99 + group - 1) * 9999 + serial - 1, 898 * 99 * 9999, "ssn")
        value, serial = divmod(value, 9999)
        area, group = divmod(value, 99)
        return f"{area + 1 + (area >= 665):03d}-{group + 1:02d}-{serial + 1:04d}"

    def _phone(self, text: str) -> str:
        """The country code of an international number stays."""
        code = re.match(r"\+\d{1,3}(?=\D)", text)
        kept = code.group() if code else ""
        rest = text[len(kept) :]
        return kept + _refill(rest, self._digits(re.sub(r"[^0-9]", "", rest), f"phone{kept}"))

    def _international(self, text: str) -> str:
        """The country code stays.

        A number that no other kind takes becomes such a number, so that no other kind takes
        it on the way back.
        """
        code = re.match(r"\+\(?\d{1,3}(?=[^0-9])", text) or re.match(_CALLING, text) or re.match(r"\+\(", text)
        kept, rest = code.group(), text[code.end() :]
        shape = f"phone{kept}|{re.sub('[0-9]', '0', rest)}|"
        digits, other = re.sub("[^0-9]", "", rest), self._other_kind(text)
        while True:
            digits = self._digits(digits, shape)
            new = kept + _refill(rest, digits)
            if self._other_kind(new) == other:
                return new

    def _other_kind(self, text: str) -> bool:
        """Whether a kind before the last takes some of a text."""
        return any(rule(m.group()) for _, pattern, rule in self.kinds[:-1] for m in pattern.finditer(text))

    def _dated(self, year: str, month: str, day: str) -> datetime.date | None:
        try:
            value = datetime.date(int(year), int(month), int(day)).toordinal() - _FIRST_DAY
        except ValueError:
            return None
        if not 0 <= value < _DAYS:
            return None
        return datetime.date.fromordinal(_FIRST_DAY + self._number(value, _DAYS, "date"))

    def _iso_date(self, text: str) -> str | None:
        sign = text[4]
        found = self._dated(*text.split(sign))
        return found and f"{found.year:04d}{sign}{found.month:02d}{sign}{found.day:02d}"

    def _day_date(self, text: str) -> str | None:
        """Day first; where that is no date, month first. Pseudonyms of the first kind may
        not read as the second, so both notations have permutations of their own."""
        sign = text[2]
        a, b, year = text.split(sign)
        if not 1900 <= int(year) <= 2099:
            return None
        first = int(b) <= 12
        day, month = (a, b) if first else (b, a)
        try:
            own = datetime.date(int(year), int(month), int(day))
        except ValueError:
            return None
        if first:
            found = self._dated(year, month, day)
            return f"{found.day:02d}{sign}{found.month:02d}{sign}{found.year:04d}"
        # Days 13 and later written month first: permuted among such dates of all years.
        own = self._among(own, range(1, 13), range(13, 32), "month first")
        return f"{own.month:02d}{sign}{own.day:02d}{sign}{own.year:04d}"

    def _among(self, own: datetime.date, months: range, days: range, kind: str) -> datetime.date:
        """Permuted among the dates of these months and days of all years."""
        value = ((own.year - 1900) * len(months) + own.month - months[0]) * len(days) + own.day - days[0]
        while True:
            value = self._number(value, 200 * len(months) * len(days), kind)
            rest, day_at = divmod(value, len(days))
            year_at, month_at = divmod(rest, len(months))
            try:
                return datetime.date(1900 + year_at, months[month_at], days[day_at])
            except ValueError:
                continue

    def _short(self, year: str, month: str, day: str, kind: str, least_day: int = 1) -> datetime.date | None:
        """Permuted among the dates of which day and month have as many digits.

        One digit is 1 to 9; two digits may begin with a zero.
        """
        try:
            own = datetime.date(int(year), int(month), int(day))
        except ValueError:
            return None
        if not 1900 <= own.year <= 2099:
            return None
        months = range(1, 10 if len(month) == 1 else 13)
        days = range(least_day, 10 if len(day) == 1 else 32)
        return self._among(own, months, days, f"{kind}{len(month)}{len(day)}")

    def _short_iso_date(self, text: str) -> str | None:
        sign = text[4]
        year, month, day = text.split(sign)
        found = self._short(year, month, day, "year first")
        return found and f"{found.year:04d}{sign}{found.month:0{len(month)}d}{sign}{found.day:0{len(day)}d}"

    def _short_day_date(self, text: str) -> str | None:
        """Day first; where the second number is no month, month first."""
        sign = re.search("[^0-9]", text).group()
        a, b, year = text.split(sign)
        if int(b) <= 12:
            found = self._short(year, b, a, "day first")
            return found and f"{found.day:0{len(a)}d}{sign}{found.month:0{len(b)}d}{sign}{found.year:04d}"
        found = self._short(year, a, b, "month first", 13)
        return found and f"{found.month:0{len(a)}d}{sign}{found.day:0{len(b)}d}{sign}{found.year:04d}"

    def _ipv4(self, text: str) -> str | None:
        parts = text.split(".")
        if any(int(p) > 255 or p != str(int(p)) for p in parts):
            return None
        # Each part keeps its number of digits.
        ranges = [((0, 10), (10, 90), (100, 156))[len(p) - 1] for p in parts]
        value, size = 0, 1
        for p, (low, count) in zip(parts, ranges, strict=True):
            value, size = value * count + int(p) - low, size * count
        value = self._number(value, size, "ipv4" + ".".join(str(len(p)) for p in parts))
        out = []
        for low, count in reversed(ranges):
            value, rest = divmod(value, count)
            out.append(str(low + rest))
        return ".".join(reversed(out))

    def replace(self, text: str) -> tuple[str, Counter]:
        """The text with its findings permuted, and how many of each kind."""
        found: Counter = Counter()
        taken: list[tuple[int, int, str]] = []
        for name, pattern, rule in self.kinds:
            for match in pattern.finditer(text):
                new = rule(match.group())
                parts = new if isinstance(new, list) else [(0, len(match.group()), new)] if new else []
                for low, high, part in parts:
                    a, b = match.start() + low, match.start() + high
                    after = bisect.bisect(taken, (a, b, ""))
                    if after and taken[after - 1][1] > a or after < len(taken) and taken[after][0] < b:
                        continue
                    found[name] += 1
                    taken.insert(after, (a, b, part))
        out, at = [], 0
        for a, b, new in taken:
            out += [text[at:a], new]
            at = b
        return "".join([*out, text[at:]]), found


def may_hold(texts: pa.Array) -> np.ndarray:
    """Whether a text has a digit or an ``@`` at all, which every kind has."""
    data, ends = byte_view(texts_of(texts))
    marks = np.r_[0, np.cumsum(((data >= 48) & (data <= 57)) | (data == 64))]
    return marks[ends[1:]] > marks[ends[:-1]]


RESULT = "doc_id long, text string, n_found int, kinds string"


def pseudonymise(docs: DataFrame, key: str, backwards: bool = False) -> DataFrame:
    """``doc_id, text, n_found, kinds`` of every document, personal values permuted in place.

    ``kinds`` lists the kinds found with their counts, in alphabetical order. The work on a
    text is independent of all others: equal values meet because the permutation is a
    function of key, kind and format alone. Null texts stay null, empty ones empty; repeated
    rows stay; an empty table gives no rows; extra columns are ignored.
    """
    secret = key.encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = Pseudonyms(secret, backwards)
        for batch in slices(batches):
            texts, counts, kinds = [], [], []
            worth = may_hold(batch.column("text"))
            for text, look in zip(batch.column("text").to_pylist(), worth, strict=True):
                new, found = work.replace(text) if look else (text, Counter())
                texts.append(new)
                counts.append(found.total())
                kinds.append(",".join(f"{k}:{found[k]}" for k in sorted(found)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(texts, pa.string()), pa.array(counts, pa.int32()), pa.array(kinds, pa.string())],
                names=["doc_id", "text", "n_found", "kinds"],
            )

    return keyed(docs, "doc_id", "text").mapInArrow(run, RESULT)


def pseudonymised(docs: DataFrame, key: str) -> DataFrame:
    """The rows with personal values of their text permuted in place, all columns kept.

    Formats and so lengths stay as they are. A null text stays null; rows that repeat, or
    have no id, are each treated alike; an empty table stays empty.
    """
    secret = key.encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = Pseudonyms(secret)
        for batch in slices(batches):
            worth = may_hold(batch.column("text"))
            texts = [
                work.replace(text)[0] if look else text
                for text, look in zip(batch.column("text").to_pylist(), worth, strict=True)
            ]
            yield batch.set_column(batch.schema.get_field_index("text"), "text", pa.array(texts, pa.string()))

    return docs.mapInArrow(run, docs.schema)
