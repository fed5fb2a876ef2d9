from __future__ import annotations

import hashlib
import math
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import assume, given, settings
from hypothesis import strategies as st

from keelstone.llm import contamination, fingerprints, privacy, revisits, toxicity
from tests.llm.data import documents, edge_texts, no_documents, prose


def distance(pattern, text):
    row = [0] * (len(text) + 1)
    for i, a in enumerate(pattern, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


@settings(max_examples=200, deadline=None)
@given(st.text("abc", min_size=1, max_size=12), st.text("abc", max_size=25))
def test_bit_parallel_distance(pattern, text):
    found, end = contamination.best_match(pattern, text)
    assert found == distance(pattern, text)
    assert found == distance(pattern, text[:end]) or found == len(pattern)


def test_items_equal_brute_force(spark):
    item = prose(5, 30)
    edited = item.replace(item.split()[7], "other", 1)
    texts = [
        *edge_texts(),
        prose(6, 50) + " " + item.upper().replace(" ", "\n ") + " " + prose(7, 50),
        prose(8, 40) + " " + edited + " end",
        item[: len(item) // 2],
        item + " " + prose(9, 10) + " " + item,
        "Short\n one",
        "a short one, and (short one) again",
        "unshort one or short ones",
        prose(10, 9) + " twenty-four small lettars and more",
        prose(11, 9) + " twenty-four small lettars!",
    ]
    items = [(1, item), (2, "short one"), (3, None), (4, " "), (5, item), (6, prose(77, 40)), (7, "twenty-four small letters")]
    frame = spark.createDataFrame(items, "item_id long, text string")
    wanted = []
    for i, text in enumerate(texts):
        plain = contamination.normal(text)
        for number, raw in items:
            own = contamination.normal(raw)
            if own and not contamination.budget(len(own)):
                wanted += [(i, number, 0)] * bool(re.search(rf"\b{re.escape(own)}\b", plain))
            elif own and len(plain) < 5000 and (d := distance(own, plain)) <= contamination.budget(len(own)):
                wanted.append((i, number, d))
    for block in (1 << 20, 200):
        rows = contamination.find_items(documents(spark, texts), frame, block).collect()
        assert sorted((r.doc_id, r.item_id, r.distance) for r in rows) == sorted(wanted)
        assert all(r.end - r.start > 0 for r in rows)
        kept = contamination.without_items(documents(spark, texts), frame, block)
        assert {r.doc_id for r in kept.collect()} == set(range(len(texts))) - {w[0] for w in wanted}
    assert contamination.find_items(no_documents(spark), frame).count() == 0
    assert contamination.find_items(documents(spark, texts), frame.limit(0)).count() == 0
    assert len({w[0] for w in wanted}) == 7
    assert sum(w[1] == 2 for w in wanted) == 2 and sum(w[1:] == (7, 1) for w in wanted) == 2
    # Another rate: no edits at all.
    exact = contamination.find_items(documents(spark, texts), frame, rate=0.0).collect()
    assert sorted((r.doc_id, r.item_id) for r in exact) == sorted(w[:2] for w in wanted if not w[2])


def test_the_driver_holds_one_block_of_items_at_a_time(spark, monkeypatch):
    frame = spark.createDataFrame([(k, prose(k, 20)) for k in range(40)], "item_id long, text string")
    blocks = contamination._blocks(frame, 1000)
    assert iter(blocks) is blocks
    sizes = [sum(len(t) for _, t in block) for block in blocks]
    assert len(sizes) > 3 and max(sizes) < 4000


def test_fingerprints_equal_brute_force(spark):
    texts = edge_texts()
    docs = documents(spark, texts)
    rows = sorted(fingerprints.fingerprint_edits(docs, ranges=6).collect(), key=lambda r: r.doc_id)
    assert [r.doc_id for r in rows] == list(range(len(texts)))
    for i, row in enumerate(rows):
        text, following = texts[i] or "", texts[i - 1] or ""
        edited = text[: len(text) - len(text) // 3] + following[: len(text) // 3]
        assert row.n_chars == len(text)
        assert row.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert row.fingerprint == fingerprints.fingerprint(text)
        assert row.edited_fingerprint == fingerprints.fingerprint(edited)
        assert row.near_edited == fingerprints.likeness(row.fingerprint, row.edited_fingerprint)
        assert row.near_next == fingerprints.likeness(row.fingerprint, fingerprints.fingerprint(following))
        pairs = zip(text, edited, strict=False)
        assert row.common_prefix == next((k for k, (a, b) in enumerate(pairs) if a != b), min(len(text), len(edited)))


def test_fingerprints_of_one_none_repeated_and_unnamed_rows(spark):
    one = fingerprints.fingerprint_edits(documents(spark, ["abcdef"])).collect()
    assert [(r.n_chars, r.near_next) for r in one] == [(6, 1.0)]
    assert fingerprints.fingerprint_edits(no_documents(spark)).count() == 0
    twice = documents(spark, edge_texts(), repeat=True).selectExpr("nullif(doc_id, 3) AS doc_id", "text")
    assert fingerprints.fingerprint_edits(twice, ranges=9).count() == len(edge_texts()) + 2


def test_edits_of_short_texts_leave_a_likeness(spark):
    # Other letters in the text that the replaced third comes from.
    letters = [chr(0x4E00 + 7919 * k % 20000) for k in range(2000)]
    texts = [t for n in range(1, 121) for t in ("".join(letters[1000 : 1000 + n]), "".join(letters[:n]))]
    rows = {r.doc_id: r for r in fingerprints.fingerprint_edits(documents(spark, texts), ranges=27).collect()}
    for i, text in enumerate(texts[1:], 1):
        row, n = rows[i], len(text)
        width = next(w for w in (24, 6, 2, 0) if n >= 4 * w or w == 2)
        edited = text[: n - n // 3] + texts[i - 1][: n // 3]
        one, other = ({t[k : k + width] for k in range(max(1, len(t) - width + 1))} for t in (text, edited))
        dice = 2 * len(one & other) / (len(one) + len(other))
        assert row.near_edited == fingerprints.likeness(row.fingerprint, row.edited_fingerprint)
        assert abs(row.near_edited - dice) < (1e-9 if len(one | other) <= fingerprints.SAMPLES else 0.25)
        assert row.near_edited >= 0.4 and row.near_edited > row.near_next
        assert row.edited_fingerprint == fingerprints.fingerprint(edited)
    # A short text beside a long one: nothing shared, some shared.
    long = fingerprints.fingerprint(prose(3, 3000) + " q7z9k")
    assert fingerprints.likeness(fingerprints.fingerprint("Q7Z9K"), long) == 0
    assert fingerprints.likeness(fingerprints.fingerprint("q7z9k"), fingerprints.fingerprint("see q7z9k")) > 0.5


@settings(max_examples=100, deadline=None)
@given(st.text("ab", max_size=30), st.text("ab", max_size=30))
def test_prefix_hashes(a, b):
    x, y = (fingerprints.PrefixHash(fingerprints.codes_of(t)) for t in (a, b))
    for i in range(len(a)):
        for j in range(len(b)):
            n = 0
            while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                n += 1
            assert x.common(i, y, j) == n


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 3000), st.binary(max_size=8))
def test_permutations_are_bijections(size, key):
    found = [privacy.permute(v, size, key, b"t") for v in range(min(size, 200))]
    assert len(set(found)) == len(found)
    assert all(0 <= f < size for f in found)
    assert [privacy.permute(f, size, key, b"t", backwards=True) for f in found] == list(range(len(found)))


PERSONAL = [
    "a.b7@mail.example.com", "4952935900253052", "4952 9359 0025 3052", "123-45-6789", "+1 (017) 555-7713",
    "(212) 555-0123", "2024-02-29", "31/12/1999", "12/31/1999", "169.122.221.182", "GB82 WEST 1234 5698 7654 32",
]
HARMLESS = ["4952935900253051", "2023-02-30", "999.1.1.1", "1.2.3.4.5", "000-12-3456", "v4.0.", "GB83 WEST 1234 5698 7654 32", "a@b"]


def test_pseudonyms_keep_formats_and_links(spark):
    texts = [*edge_texts(), *(f"see {v}, please" for v in PERSONAL), *(f"see {v}, please" for v in HARMLESS), " ".join(PERSONAL)]
    rows = sorted(privacy.pseudonymise(documents(spark, texts), "k").collect(), key=lambda r: r.doc_id)
    assert [(r.text is None, len(r.text or "")) for r in rows] == [(t is None, len(t or "")) for t in texts]
    at = len(edge_texts())
    new = [r.text[4:-8] for r in rows[at : at + len(PERSONAL)]]
    assert all(a != b for a, b in zip(new, PERSONAL, strict=True))
    assert [r.n_found for r in rows[at : at + len(PERSONAL)]] == [1] * len(PERSONAL)
    assert rows[-1].text == " ".join(new)  # equal values have equal pseudonyms
    for row, text in zip(rows[at + len(PERSONAL) : -1], texts[at + len(PERSONAL) : -1], strict=True):
        assert (row.text, row.n_found) == (text, 0)
    back = privacy.pseudonymise(documents(spark, [r.text for r in rows]), "k", backwards=True)
    assert [r.text for r in sorted(back.collect(), key=lambda r: r.doc_id)] == texts
    assert privacy.pseudonymise(no_documents(spark), "k").count() == 0


NOTATIONS = [
    "2024-02-29T10:00:00Z", "2024-2-9", "2024/12/5", "3/14/1999", "14/3/1999", "1/2/1999", "1.12.1999", "05.3.1999", "3/05/1999",
    "+34 612 345 678", "+44 20 7946 0958", "+4915112345678", "+44 (0)20 7946 0958", "+33 6 12 34 56 78", "+353-1-234-5678", "+1234567", "+49151 1234567",
    "josé.34@mail7.example.com", "x@münchen.de", "jose\u0301phine@example.com", "éa1@example.com", "ольга7@почта.рф", "用户1@例子.广告",
]
NOT_PERSONAL = ["2024-2-30T10:00", "0/3/1999", "32/1/1999", "1/2/1899", "1/2-1999", "1/2/1999/3", "+123456", "+12345678901234567", "a+491511234567", "2024-1-2x"]


def test_pseudonyms_of_further_notations():
    there, back = privacy.Pseudonyms(b"k"), privacy.Pseudonyms(b"k", backwards=True)
    for text in NOTATIONS:
        new, found = there.replace(f"see {text}, please")
        assert new != f"see {text}, please" and found.total() == 1, text
        assert len(new) == len(text) + 12 and there.replace(f"and {text}")[0] == f"and {new[4:-8]}"
        # What is no ASCII letter or digit stays where it is.
        assert all(a == b or (a + b).isascii() and (a + b).isalnum() for a, b in zip(new[4:-8], text, strict=True))
        assert back.replace(new)[0] == f"see {text}, please"
    for text in NOT_PERSONAL:
        assert there.replace(f"see {text} please") == (f"see {text} please", {}), text
    # Letters before an address without a space: scripts that have none are not part of it.
    assert there.replace("请联系abc@example.com谢谢")[0] == f"请联系{there.replace('abc@example.com')[0]}谢谢"
    assert there.replace("on 2024-02-29T10:00:00Z")[0].endswith("T10:00:00Z")
    assert there.replace("+4915112345679")[0].startswith("+49")


@settings(max_examples=300, deadline=None)
@given(st.from_regex(r"\+[1-9][0-9]([ .-]?[0-9]{1,5}){2,4}", fullmatch=True))
def test_phones_in_any_grouping_come_back(text):
    there, back = privacy.Pseudonyms(b"k"), privacy.Pseudonyms(b"k", backwards=True)
    new, found = there.replace(text)
    assume(7 <= sum(c.isdigit() for c in text) <= 15)
    assert found
    if set(found) == {"phone"}:
        assert found.total() == 1 and new[:2] == text[:2]
        assert back.replace(new)[0] == text


@settings(max_examples=200, deadline=None)
@given(st.dates(min_value=__import__("datetime").date(1900, 1, 1), max_value=__import__("datetime").date(2099, 12, 31)))
def test_dates_of_one_digit_parts_come_back(day):
    there, back = privacy.Pseudonyms(b"k"), privacy.Pseudonyms(b"k", backwards=True)
    for text in (f"{day.day}/{day.month}/{day.year}", f"{day.month}.{day.day}.{day.year}", f"{day.year}-{day.month}-{day.day}"):
        new, found = there.replace(text)
        assert (len(new), found.total()) == (len(text), 1)
        assert back.replace(new)[0] == text


@settings(max_examples=200, deadline=None)
@given(st.dates(min_value=__import__("datetime").date(1900, 1, 1), max_value=__import__("datetime").date(2099, 12, 31)))
def test_dates_come_back(day):
    there, back = privacy.Pseudonyms(b"k"), privacy.Pseudonyms(b"k", backwards=True)
    for text in (day.isoformat(), day.strftime("%d/%m/%Y"), day.strftime("%m.%d.%Y")):
        assert back.replace(there.replace(text)[0])[0] == text


def toxic_texts(count):
    rng = np.random.default_rng(3)
    texts, toxic = [], []
    for i in range(count):
        words = prose(i, int(rng.integers(20, 200))).split()
        bad = i % 5 == 0
        for k in range(3 * bad):
            words[int(rng.integers(len(words)))] = f"vile{('ness', 'st', 'r')[k]}"
        texts.append(" ".join(words))
        toxic.append(int(bad))
    return texts, toxic


def test_toxicity_is_learnt_from_positive_and_unlabelled_rows(spark):
    texts, toxic = toxic_texts(600)
    docs = documents(spark, texts)
    labels = spark.createDataFrame([(i, 1, t) for i, t in enumerate(toxic)] + [(9999, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, labels)
    rows = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    held = [i for i in range(600) if toxicity.held_out(i)]
    assert np.mean([rows[i].predicted == toxic[i] for i in held]) > 0.95
    kept = toxicity.without_toxic(docs, model)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, r in rows.items() if not r.predicted}
    edge = toxicity.score(documents(spark, edge_texts(), repeat=True), model).collect()
    assert len(edge) == len(edge_texts()) + 2
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in edge)
    assert toxicity.score(no_documents(spark), model).count() == 0


def test_labels_of_held_out_rows_change_nothing(spark):
    texts, toxic = toxic_texts(200)
    docs = documents(spark, texts)

    def fitted(values):
        return toxicity.fit(docs, spark.createDataFrame(list(enumerate(values)), "doc_id long, toxic int"))

    a = fitted(toxic)
    b = fitted([1 - t if toxicity.held_out(i) else t for i, t in enumerate(toxic)])
    assert a.bias == b.bias
    assert np.array_equal(a.weights, b.weights)


def test_only_confirmed_labels_are_used(spark):
    texts, toxic = toxic_texts(200)
    docs = documents(spark, texts)

    def fitted(rows):
        return toxicity.fit(docs, spark.createDataFrame(rows, "doc_id long, toxic int"))

    a = fitted(list(enumerate(toxic)))
    b = fitted([(i, t) for i, t in enumerate(toxic) if t])  # no negative label at all
    assert a.bias == b.bias
    assert np.array_equal(a.weights, b.weights)


def small_rows():
    rng = np.random.default_rng(5)
    length = np.array([3, 1, 0, 4, 2, 2])
    total = int(length.sum())
    return toxicity.Rows(rng.integers(0, 4, total), rng.random(total), np.cumsum(length) - length, length), rng.normal(size=4)


@pytest.mark.parametrize(("prior", "bias"), [(0.1, 0.3), (0.9, 3.0), (0.4, -1.0)])
def test_risk_and_gradient(prior, bias):
    rows, weights = small_rows()
    p, u = np.array([0, 3]), np.array([0, 1, 2, 4, 5])

    def margin(k):
        own = range(int(rows.begin[k]), int(rows.begin[k] + rows.length[k]))
        return sum(weights[rows.column[i]] * rows.value[i] for i in own) + bias

    def mean(ks, sign):
        return sum(math.log1p(math.exp(-sign * margin(k))) for k in ks) / len(ks)

    corrected = mean(u, -1) - prior * mean(p, -1)
    step, risk, part = rows.risk(p, u, prior, weights, bias)
    assert part == pytest.approx(corrected)
    assert risk == pytest.approx(prior * mean(p, 1) + max(0, corrected))

    def value(w, b):
        _, whole, inner = rows.risk(p, u, prior, w, b)
        return whole if corrected >= 0 else -inner

    for k in range(5):
        up, down = (np.r_[weights, bias] + np.eye(5)[k] * h for h in (1e-6, -1e-6))
        slope = (value(up[:4], up[4]) - value(down[:4], down[4])) / 2e-6
        assert step[k] == pytest.approx(slope, abs=1e-6)


def test_the_correction_turns_negative_in_one_of_the_cases():
    rows, weights = small_rows()
    p, u = np.array([0, 3]), np.array([0, 1, 2, 4, 5])
    signs = {rows.risk(p, u, prior, weights, bias)[2] < 0 for prior, bias in [(0.1, 0.3), (0.9, 3.0), (0.4, -1.0)]}
    signs |= {rows.risk(np.array([3]), np.array([2]), 0.99, np.full(4, 3.0), 0.0)[2] < 0}
    assert signs == {True, False}


@pytest.mark.parametrize("share", [0.05, 0.3])
def test_class_prior_is_found_without_negatives(share):
    rng = np.random.default_rng(11)
    texts, positive, unlabelled = [], [], []
    for k in range(1600):
        bad = k < 400 or rng.random() < share
        words = prose(k, 40).split() + [f"vile{'ness' if rng.random() < 0.5 else 'st'}"] * (3 if bad else 0)
        texts.append(" ".join(words))
        positive.append(k < 400)
        unlabelled.append(k >= 400)
    features = toxicity.featurise(pa.array(texts))
    found = toxicity.class_prior(features, np.array(positive), np.array(unlabelled))
    assert abs(found - share) < 0.04


def test_scores_equal_a_plain_loop():
    texts = ["", "Vile vileness, VILE", "ünkind wörds and kindness " * 3, prose(4, 50), "x"]
    rng = np.random.default_rng(2)
    model = toxicity.Model(rng.normal(size=toxicity.DIMENSIONS).astype(np.float32), -0.4)
    found = model.scores(toxicity.featurise(pa.array(texts)))
    for text, score in zip(texts, found.tolist(), strict=True):
        lowered = bytes(b + 32 if 65 <= b <= 90 else b for b in text.encode())
        words = set(re.findall(rb"[a-z\x80-\xff]+", lowered))
        counts: dict[int, int] = {}
        for word in words:
            for length in [0, *toxicity.BEGINNINGS]:
                if length < len(word):
                    piece = word[:length] if length else word
                    data = np.frombuffer(piece, np.uint8)
                    whole = toxicity.span_hashes(toxicity.rolling(data), np.array([0]), np.array([len(data)]))[0]
                    bucket = (int(whole) + length) % (1 << 64) % toxicity.DIMENSIONS
                    counts[bucket] = counts.get(bucket, 0) + 1
        total = sum(float(model.weights[b]) * float(np.float32(math.log1p(30 * n / math.sqrt(len(words) + 20)))) for b, n in counts.items())
        assert score == pytest.approx(1 / (1 + math.exp(-(total - 0.4))), rel=1e-5)


@pytest.mark.parametrize("toxic", [[], [0, 0, 0, 0], [1, 1, 1, 1]])
def test_toxicity_without_one_class(spark, toxic):
    docs = documents(spark, ["a b", "c d", "e f", "g h"])
    labels = spark.createDataFrame(list(enumerate(toxic)), "doc_id long, toxic int")
    assert toxicity.score(docs, toxicity.fit(docs, labels)).count() == 4


def test_features_do_not_depend_on_the_slice():
    texts = [t for t in edge_texts() if t is not None]
    together = toxicity.featurise(pa.array(texts))
    for i, text in enumerate(texts):
        alone = toxicity.featurise(pa.array([text]))
        a, b = together.first[i : i + 2]
        assert np.array_equal(alone.bucket, together.bucket[a:b])
        assert np.array_equal(alone.value, together.value[a:b])


RECORDS = "record_id long, uri string, captured long, kind string, headers map<string,string>, payload_digest string, _key int, status int"


def test_revisits(spark):
    tag = {"etag": '"1"', "content-type": "text/html", "server": "s"}
    rows = [
        (1, "http://www.A.com/x/?b=2&a=1#f", 10, "response", tag, "d1"),
        (2, "https://a.com/x?a=1&b=2&utm_id=3", 20, "revisit", {"etag": 'W/"1"', "content-type": "no", "age": "5"}, "d1"),
        (3, "a.com:80/x?a=1&b=2", 5, "revisit", {"etag": '"1"'}, "d1"),
        (4, "a.com/x?a=1&b=2", 30, "response", {"etag": '"2"'}, "d2"),
        (5, "a.com/x?a=1&b=2", 40, "revisit", {"etag": '"1"'}, "d1"),
        (6, "a.com/x?a=1&b=2", 50, "revisit", None, "d2"),
        (7, None, 60, "revisit", {"etag": '"1"'}, "d1"),
        (8, None, 55, "response", {"etag": '"1"'}, "d1"),
        (9, "a.com/x?a=1&b=2", None, "revisit", None, None),
        (6, "a.com/x?a=1&b=2", 50, "revisit", None, "d2"),
        (10, "a.com/x?a=1&b=2", 60, "request", None, None),
    ]
    frame = spark.createDataFrame([(*r, 0, 0) for r in rows], RECORDS)
    for ranges in (1, 7):
        found = {r.record_id: r for r in revisits.resolve_revisits(frame, ranges).collect()}
        assert {k: (r.status, r.base_record_id) for k, r in found.items()} == {
            2: ("resolved", 1), 3: ("missing", None), 5: ("changed", None),
            6: ("resolved", 4), 7: ("missing", None), 9: ("missing", None),
        }
        assert found[2].headers == {"etag": 'W/"1"', "content-type": "text/html", "server": "s", "age": "5"}
        assert found[2].url_key == "a.com/x?a=1&b=2"
        assert found[5].headers == {"etag": '"1"'}
        assert revisits.resolve_revisits(frame, ranges).count() == 7
    assert revisits.resolve_revisits(frame.limit(0)).count() == 0


def test_a_hot_url_spans_many_ranges(spark):
    rows = [(i, "a.com/", i, "response" if i % 50 == 0 else "revisit", {"etag": f'"{i // 50}"'}, None, 0, 0) for i in range(1000)]
    frame = spark.createDataFrame(rows, RECORDS).repartition(5)
    found = revisits.resolve_revisits(frame, 16).collect()
    assert {(r.record_id, r.base_record_id, r.status) for r in found} == {
        (i, i // 50 * 50, "resolved") for i in range(1000) if i % 50
    }
