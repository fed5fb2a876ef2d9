"""Pseudonyms against a second, plain version: Feistel networks as tables, a scanner by hand."""

from __future__ import annotations

import calendar
import hashlib
import hmac
import random
from itertools import count

import pytest

from keelstone.llm import privacy
from tests.llm.data import documents, no_documents

KEY = "secret"


def least_side(size):
    return next(a for a in count(1) if a * a > size)


def round_value(key, kind, number, half, size):
    text = kind.encode() + b"|" + str(number).encode() + b"|" + str(half).encode()
    mac = hmac.new(key.encode(), text, hashlib.sha256).hexdigest()
    return int(mac, 16) % size


def network(value, size, key, kind):
    """One pass over left * b + right, and again while the result is out of range."""
    a = int(size**0.5)
    while a * a <= size:
        a += 1
    while (a - 1) * (a - 1) > size:
        a -= 1
    b = (size + a - 1) // a
    while True:
        left, right = value // b, value % b
        for number in range(8):
            if number % 2:
                right = (right + round_value(key, kind, number, left, b)) % b
            else:
                left = (left + round_value(key, kind, number, right, a)) % a
        value = left * b + right
        if value < size:
            return value


@pytest.mark.parametrize("size", [2, 3, 7, 10, 97, 256, 1000])
def test_permutations_equal_tables(size):
    a = least_side(size)
    b = -(-size // a)
    step = {}
    for left in range(a):
        for right in range(b):
            x, y = left, right
            for number in range(8):
                if number % 2:
                    y = (y + round_value(KEY, "kind", number, x, b)) % b
                else:
                    x = (x + round_value(KEY, "kind", number, y, a)) % a
            step[left * b + right] = x * b + y
    table = []
    for value in range(size):
        value = step[value]
        while value >= size:
            value = step[value]
        table.append(value)
    assert sorted(table) == list(range(size))
    assert table == [network(v, size, KEY, "kind") for v in range(size)]
    assert table == [privacy.permute(v, size, KEY.encode(), b"kind") for v in range(size)]
    assert [privacy.permute(v, size, KEY.encode(), b"kind", backwards=True) for v in table] == list(range(size))


def luhn(digits):
    total = 0
    for k, d in enumerate(reversed(digits)):
        doubled = int(d) * (1 + k % 2)
        total += doubled // 10 + doubled % 10
    return total % 10 == 0


def days_before(year, month, day):
    """Days from the first of 1900, counted month by month."""
    total = 0
    for y in range(1900, year):
        total += 366 if calendar.isleap(y) else 365
    for m in range(1, month):
        total += calendar.monthrange(year, m)[1]
    return total + day - 1


def date_after(days):
    year, month = 1900, 1
    while days >= (size := 366 if calendar.isleap(year) else 365):
        days, year = days - size, year + 1
    while days >= (size := calendar.monthrange(year, month)[1]):
        days, month = days - size, month + 1
    return year, month, days + 1


def plain_card(token):
    if not (token.isdigit() and 13 <= len(token) <= 19 and luhn(token)):
        return None
    n = len(token) - 1
    body = str(network(int(token[:-1]), 10**n, KEY, f"card{n}")).zfill(n)
    return next(body + str(d) for d in range(10) if luhn(body + str(d)))


def plain_ssn(token):
    parts = token.split("-")
    if [len(p) for p in parts] != [3, 2, 4] or not all(p.isdigit() for p in parts):
        return None
    areas = [a for a in range(1, 900) if a != 666]
    area, group, serial = map(int, parts)
    if area not in areas or not group or not serial:
        return None
    value = (areas.index(area) * 99 + group - 1) * 9999 + serial - 1
    value = network(value, len(areas) * 99 * 9999, KEY, "ssn")
    return f"{areas[value // (99 * 9999)]:03d}-{value // 9999 % 99 + 1:02d}-{value % 9999 + 1:04d}"


def plain_date(token):
    parts = token.split("-")
    if [len(p) for p in parts] != [4, 2, 2] or not all(p.isdigit() for p in parts):
        return None
    year, month, day = map(int, parts)
    if not (1900 <= year <= 2099 and 1 <= month <= 12 and 1 <= day <= calendar.monthrange(year, month)[1]):
        return None
    days = days_before(2100, 1, 1)
    year, month, day = date_after(network(days_before(year, month, day), days, KEY, "date"))
    return f"{year:04d}-{month:02d}-{day:02d}"


def plain_ipv4(token):
    parts = token.split(".")
    if len(parts) != 4 or not all(p.isdigit() and len(p) < 4 and str(int(p)) == p and int(p) < 256 for p in parts):
        return None
    choices = [[n for n in range(256) if len(str(n)) == len(p)] for p in parts]
    value, size = 0, 1
    for p, own in zip(parts, choices, strict=True):
        value, size = value * len(own) + own.index(int(p)), size * len(own)
    value = network(value, size, KEY, "ipv4" + ".".join(str(len(p)) for p in parts))
    out = []
    for own in reversed(choices):
        out.append(str(own[value % len(own)]))
        value //= len(own)
    return ".".join(reversed(out))


def plain_phone(token):
    parts = token.split("-")
    if [len(p) for p in parts] != [3, 3, 4] or not all(p.isdigit() for p in parts):
        return None
    new = str(network(int("".join(parts)), 10**10, KEY, "phone10")).zfill(10)
    return f"{new[:3]}-{new[3:6]}-{new[6:]}"


def plain_email(token):
    local, at, domain = token.partition("@")
    if not at or not local or "." not in domain or not domain.rpartition(".")[2].isalpha():
        return None
    kinds = ["0" if c.isdigit() else "A" if c.isupper() else "a" if c.islower() else c for c in local]
    alphabets = {"0": "0123456789", "a": "abcdefghijklmnopqrstuvwxyz", "A": "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
    value, size = 0, 1
    for c, k in zip(local, kinds, strict=True):
        if k in alphabets:
            value = value * len(alphabets[k]) + alphabets[k].index(c)
            size *= len(alphabets[k])
    value = network(value, size, KEY, f"email|{''.join(kinds)}|{domain.lower()}")
    out = []
    for c, k in reversed(list(zip(local, kinds, strict=True))):
        if k in alphabets:
            c = alphabets[k][value % len(alphabets[k])]
            value //= len(alphabets[k])
        out.append(c)
    return "".join(reversed(out)) + "@" + domain


PLAIN = (plain_email, plain_card, plain_ssn, plain_phone, plain_date, plain_ipv4)


def brute(text):
    out, found = [], 0
    for token in (text or "").split(" "):
        new = next((x for x in (rule(token) for rule in PLAIN) if x), None)
        found += new is not None
        out.append(new or token)
    return " ".join(out), found


def tokens(made):
    digits = lambda n: "".join(made.choice("0123456789") for _ in range(n))
    year = made.choice([1899, 1900, 1999, 2000, 2024, 2099, 2100])
    body = digits(made.choice([13, 15, 16]))
    return [
        made.choice(["word", "Straße", "mail", "x1", "3", "12345"]),
        body + next(str(d) for d in range(10) if luhn(body + str(d))),
        digits(16),
        f"{digits(3)}-{digits(2)}-{digits(4)}",
        made.choice(["666-12-3456", "000-12-3456", "123-00-4567", "899-99-9999", "001-01-0001"]),
        f"{digits(3)}-{digits(3)}-{digits(4)}",
        f"{year}-{made.randrange(0, 14):02d}-{made.randrange(0, 33):02d}",
        ".".join(str(made.choice([0, 7, 42, 99, 100, 255, 256, 300])) for _ in range(4)),
        made.choice(["10.0.0.01", "1.2.3", "1.2.3.4.5"]),
        f"{made.choice(['ann', 'Bob.Z', 'c_d-9', 'E'])}{digits(made.randrange(3))}@mail{digits(1)}.example.com",
        made.choice(["a@b", "@x.de", "nobody@nowhere"]),
    ]


def test_whole_texts_equal_the_plain_version(spark):
    made = random.Random(8)
    texts = [None, "", " ", "no numbers at all"]
    for _ in range(150):
        own = [t for _ in range(4) for t in made.sample(tokens(made), 5)]
        texts.append(" ".join(x for t in own for x in (t, "and")))
    rows = {r.doc_id: r for r in privacy.pseudonymise(documents(spark, texts), KEY).collect()}
    for i, text in enumerate(texts):
        wanted, found = brute(text)
        assert (rows[i].text or "") == wanted
        assert rows[i].n_found == found
    assert sum(r.n_found for r in rows.values()) > 500
    kept = {r.doc_id: r.text for r in privacy.pseudonymised(documents(spark, texts), KEY).collect()}
    assert {i: t or "" for i, t in kept.items()} == {i: brute(t)[0] for i, t in enumerate(texts)}
    assert privacy.pseudonymise(no_documents(spark), KEY).count() == 0
