from __future__ import annotations

import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from keelstone.llm import components, neardup, substrings
from tests.llm.data import documents, edge_texts, no_documents, prose

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if len(words) < 5:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def classes(texts):
    sets = [shingles(t) for t in texts]
    label = list(range(len(sets)))
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a and b and 100 * len(a & b) >= 75 * len(a | b) and label[i] > label[j]:
                    label[i], changed = label[j], True
    return [(i, len(s), label[i], label[i] == i) for i, s in enumerate(sets)]


def copies():
    """Chains of edits, so that classes hold documents that are not similar themselves."""
    texts = []
    for seed in range(4):
        words = prose(seed + 10, 120).split()
        for step in range(12):
            texts.append(" ".join(words))
            words[(step * 9) % len(words)] = f"edit{step}"
    return texts


@pytest.mark.parametrize(("rows", "weight"), [(4096, 2_000_000), (3, 200)])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, rows, weight):
    monkeypatch.setattr(neardup, "BUCKET_ROWS", rows)
    monkeypatch.setattr(neardup, "CLASS_SHINGLES", weight)
    texts = edge_texts() + copies()
    found = neardup.near_duplicates(documents(spark, texts)).collect()
    assert sorted(tuple(r) for r in found) == classes(texts)


def test_near_duplicates_of_repeated_and_missing_rows(spark):
    texts = edge_texts()
    found = neardup.near_duplicates(documents(spark, texts, repeat=True)).collect()
    assert sorted(tuple(r) for r in found) == sorted([*classes(texts), classes(texts)[-1], classes(texts)[1]])
    assert neardup.near_duplicates(no_documents(spark)).count() == 0
    nobody = documents(spark, ["a b c d e", "a b c d e"]).selectExpr("cast(null as long) AS doc_id", "text")
    assert [tuple(r) for r in neardup.near_duplicates(nobody).collect()] == [(None, 1, None, True)] * 2


def test_sketches_estimate_high_similarities():
    rng = np.random.default_rng(1)
    for share in (0.5, 0.75, 0.9, 1.0):
        common = int(2000 * share / (1 + share))
        errors = []
        for _ in range(20):
            pool = rng.integers(0, 1 << 63, 2000 - common, dtype=np.uint64)
            a, b = np.sort(pool[:1000]), np.sort(np.r_[pool[:common], pool[1000:]])
            values = neardup.samples(np.r_[a, b], np.array([0, len(a), len(a) + len(b)]))
            x, y = neardup.odd_sketches(values)
            errors.append(neardup.estimate(np.bitwise_count(x ^ y).sum()) - len(np.intersect1d(a, b)) / len(np.union1d(a, b)))
        assert abs(np.mean(errors)) < 0.04
        assert np.max(np.abs(errors)) < 0.2


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12)), max_size=12))
def test_components(spark, pairs):
    links = spark.createDataFrame(pairs, "a long, b long")
    label = {x: x for p in pairs for x in p if p[0] != p[1]}
    for _ in label:
        for a, b in pairs:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
    assert {r.id: r.component for r in components.components(links).collect()} == label


def repeats(texts, length=substrings.LENGTH):
    """n_bytes, n_removed, n_spans and kept bytes by definition."""
    seen, out = set(), []
    for text in texts:
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        for i in range(len(data) - length + 1):
            window = data[i : i + length]
            if window in seen:
                gone[i : i + length] = True
            seen.add(window)
        runs = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        out.append((len(data), int(gone.sum()), runs, bytes(b for b, g in zip(data, gone, strict=True) if not g)))
    return out


@pytest.mark.parametrize("group", [8192, 2])
def test_repeats_equal_brute_force(spark, monkeypatch, group):
    monkeypatch.setattr(substrings, "GROUP_SNIPPETS", group)
    passage = prose(99, 80)
    texts = edge_texts() + [prose(k, 20) + passage[k:] + prose(k + 50, 20) for k in range(9)]
    found = substrings.remove_repeats(documents(spark, texts, repeat=True)).distinct().collect()
    found = sorted(found, key=lambda r: r.doc_id)
    wanted = repeats(texts)
    assert [(r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in found] == wanted
    assert [r.kept_sha256 for r in found] == [hashlib.sha256(w[3]).hexdigest() for w in wanted]


def test_copies_stay_away_from_the_task_of_their_anchor(spark, monkeypatch):
    monkeypatch.setattr(substrings, "REMEMBERED", 1 << 12)
    passage = prose(98, 40)
    # One long run of a byte has one anchor; a passage is in many texts.
    texts = [*edge_texts(), "x" * 3000, *(prose(k, 15) + passage + prose(k + 70, 15) for k in range(60))]
    docs = documents(spark, texts).repartition(2)
    places = docs.selectExpr("doc_id", "coalesce(text, '') AS text").mapInArrow(substrings._places, substrings.PLACES)
    counted = [r["count"] for r in places.groupBy("anchor").count().collect()]
    copies = places.filter("place < 0").count()
    assert copies > 3000
    # An anchor meets its own snippets only: as many as there are, once for each task.
    assert max(counted) < 400
    found = sorted(substrings.remove_repeats(docs).collect(), key=lambda r: r.doc_id)
    assert [(r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in found] == repeats(texts)


def test_matches_do_not_depend_on_the_batches():
    rng = np.random.default_rng(7)
    rows = {(int(a), int(s), int(d), int(p)) for a, s, d, p in rng.integers(0, [6, 3, 5, 40], (300, 4))}
    # A place has one anchor and one snippet.
    place = {(d, p): (a, s, d, p) for a, s, d, p in rows}
    rows = sorted(place.values()) + sorted(place.values())[:1]
    rows = sorted([*rows, *[(9, 9, 9, -1 - k) for k in range(4)]])
    firsts, wanted = {}, set()
    for a, s, d, p in rows:
        if p < 0:
            wanted.add((0, a, d, -1 - p))
        elif firsts.setdefault((a, s), (d, p)) != (d, p):
            wanted.add((0, a, d, p))
    for (a, s), (d, p) in firsts.items():
        if sum(b == a for b, _ in firsts) > 1:
            wanted.add((1, a, d, p))
    for size in (1, 2, 7, 1000):
        columns = [np.array(c, t) for c, t in zip(zip(*rows, strict=True), (np.int64,) * 3 + (np.int32,), strict=True)]
        batches = [
            substrings.pa.RecordBatch.from_arrays([substrings.pa.array(c[k : k + size]) for c in columns], names=["anchor", "snippet", "doc_id", "place"])
            for k in range(0, len(rows), size)
        ]
        found = [tuple(r.values()) for b in substrings._matches(iter(batches)) for r in b.to_pylist()]
        assert sorted(found) == sorted(wanted)


def test_long_texts_are_anchored_in_stretches():
    data = np.frombuffer((prose(5, 3000) * 2 + "y" * 500).encode(), np.uint8)
    ends, ids = np.array([0, len(data)]), np.array([3])
    whole = substrings._snippets(data, ends, ids)
    parts = [np.concatenate(c) for c in zip(*substrings._places_of(data, ends, ids, 1000), strict=True)]
    assert all((a == b).all() for a, b in zip(whole, parts, strict=True))


def test_repeats_of_nothing(spark):
    assert substrings.remove_repeats(no_documents(spark)).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.binary(max_size=40).map(lambda b: bytes(x % 3 for x in b)))
def test_longest_previous_factors(data):
    def match(i, j):
        n = 0
        while j + n < len(data) and data[i + n] == data[j + n]:
            n += 1
        return n

    wanted = [max((match(j, i) for j in range(i)), default=0) for i in range(len(data))]
    assert substrings.longest_previous_factors(np.frombuffer(data, np.uint8)).tolist() == wanted


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 9), max_size=40))
def test_nearest_smaller_values(values):
    wanted = [max((j for j in range(i) if values[j] < v), default=-1) for i, v in enumerate(values)]
    assert substrings.smaller_before(np.array(values, np.int64)).tolist() == wanted


def test_windows_repeat_by_their_previous_factors(monkeypatch):
    asked = []

    def seen(classes, order, real=substrings.neighbours):
        asked.append(len(classes))
        return real(classes, order)

    monkeypatch.setattr(substrings, "neighbours", seen)
    rng = np.random.default_rng(4)
    passage = rng.integers(97, 100, 130).astype(np.uint8)
    data = np.concatenate([np.r_[rng.integers(97, 123, 60).astype(np.uint8), passage[k:]] for k in range(9)])
    starts = np.arange(len(data) - substrings.LENGTH + 1)
    # The corpus has these windows in another order, one of them twice.
    order = rng.permutation(len(starts))
    starts, order = np.r_[starts, starts[7]], np.r_[order, order[7]]
    found = substrings.repeated_windows(data, starts, order)
    first: dict[bytes, int] = {}
    windows = [data[s : s + substrings.LENGTH].tobytes() for s in starts]
    for window, place in zip(windows, order.tolist(), strict=True):
        first[window] = min(place, first.get(window, place))
    assert found.tolist() == [place > first[w] for w, place in zip(windows, order.tolist(), strict=True)]
    assert found.any()
    assert len(asked) == 1 and 0 < asked[0] < len(starts)
