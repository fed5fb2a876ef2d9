from __future__ import annotations

import hashlib
import json
import random
import re
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from keelstone.llm import codes, fingerprints, forced, middles, pieces, records, segments, words
from keelstone.llm.catalog import vocabulary
from tests.llm.data import CLASHING, documents, edge_texts, no_documents, prose

WORDS = vocabulary("word_bpe_49k.json")


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


# Vector codes ------------------------------------------------------------------------------


def brute_codes(rows, parts, entries, rounds):
    """Plain loops over rows of (vec_id, label, vector)."""
    usable = [r for r in rows if r[2] is not None and all(x is not None and np.isfinite(x) for x in r[2])]
    usable.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    if not usable:
        return []
    dim = len(usable[0][2])
    usable = [r for r in usable if len(r[2]) == dim]
    width = dim // parts
    whole = [[Fraction(float(x)) * 256 // 1 for x in r[2]] for r in usable]
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for v in whole]
    books = [[list(v[p]) for v in cut[:entries]] for p in range(parts)]

    def near(p, part):
        found = [(sum((a - b) ** 2 for a, b in zip(part, e, strict=True)), k) for k, e in enumerate(books[p])]
        return min(found)

    for _ in range(rounds):
        given = [[near(p, v[p])[1] for p in range(parts)] for v in cut]
        for p in range(parts):
            moved = []
            for k, entry in enumerate(books[p]):
                own = [v[p] for v, g in zip(cut, given, strict=True) if g[p] == k]
                moved.append([sum(x) // len(own) for x in zip(*own, strict=True)] if own else entry)
            books[p] = moved
    digest = sha(",".join(str(x) for b in books for e in b for x in e).encode())
    out = []
    for r, v in zip(usable, cut, strict=True):
        found = [near(p, v[p]) for p in range(parts)]
        out.append([r[0], r[1], bytes(k for _, k in found).hex(), sum(d for d, _ in found)])
    sums = {}
    for _, label, _, error in out:
        sums[label] = sums.get(label, 0) + error

    def long(value):
        return value if value < 1 << 63 else None

    return sorted(((i, code, long(e), long(sums[label]), digest) for i, label, code, e in out), key=repr)


def vectors(spark, rows):
    schema = "vec_id long, label int, embedding array<float>, " + ", ".join(f"`{c}` int" for c in (*CLASHING, "code", "error"))
    return spark.createDataFrame([(*r, *range(len(CLASHING) + 2)) for r in rows], schema).repartition(3)


def vector_rows():
    rng = np.random.default_rng(3)
    rows = [(i, i % 5 if i % 7 else None, rng.normal(0, 0.3, 8).astype(np.float32).tolist()) for i in range(120)]
    rows += [(500, 1, None), (501, 1, [0.1] * 7 + [None]), (502, 2, [0.1] * 7 + [float("nan")]), (503, 2, [float("inf")] * 8)]
    # Ties: equal vectors, whole and half steps, and a row twice; ids that are missing.
    rows += [(600 + k, 3, [k % 2 / 256] * 8) for k in range(6)] + [rows[5], rows[5], (None, 4, [-0.5 / 256] * 8), (None, None, [2.5] * 8)]
    # Another length, an empty vector, and components beyond the narrow numbers.
    return [*rows, (700, 1, [0.5] * 4), (701, 1, []), (702, 6, [1e9, -1e9] * 4)]


@pytest.mark.parametrize(("parts", "entries", "rounds"), [(4, 8, 2), (2, 200, 1), (8, 3, 0)])
def test_codes_equal_brute_force(spark, parts, entries, rounds):
    rows = vector_rows()
    found = codes.compress(vectors(spark, rows), parts, entries, rounds).collect()
    assert sorted((tuple(r) for r in found), key=repr) == brute_codes(rows, parts, entries, rounds)


def test_codes_of_nothing(spark):
    rows = vector_rows()
    assert codes.compress(vectors(spark, rows).limit(0)).count() == 0
    assert codes.compress(vectors(spark, [r for r in rows if r[0] in (500, 501, 502, 503)])).count() == 0
    with pytest.raises(ValueError, match="equal parts"):
        codes.compress(vectors(spark, rows), parts=3)


def test_codes_need_no_broadcast(spark, monkeypatch):
    monkeypatch.setattr(codes, "fits_broadcast", lambda df: False)
    rows = vector_rows()
    found = codes.compress(vectors(spark, rows), 4, 8, 2).collect()
    assert sorted((tuple(r) for r in found), key=repr) == brute_codes(rows, 4, 8, 2)


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 4), st.integers(1, 12), st.integers(1, 30), st.integers(0, 1 << 30), st.sampled_from([3, 1 << 19, 1 << 50]))
def test_nearest_entries(width, entries, rows, seed, most):
    rng = np.random.default_rng(seed)
    books = codes.exact(rng.integers(-most, most, (entries, width)))
    parts = codes.exact(rng.integers(-most, most, (rows, width)))
    if books.dtype != parts.dtype:
        books, parts = books.astype(object), parts.astype(object)
    best, distance = codes.nearest(parts, books)
    for k, part in enumerate(parts.tolist()):
        wanted = min((sum((a - b) ** 2 for a, b in zip(part, e, strict=True)), i) for i, e in enumerate(books.tolist()))
        assert (distance[k], best[k]) == wanted


def test_search_ends_at_the_gap(monkeypatch):
    rounds = []
    real = np.where

    def seen(*given):
        if len(given) == 3 and given[1].ndim == 1 and len(given[0]) <= 3:
            rounds.append(len(given[0]))
        return real(*given)

    monkeypatch.setattr(codes.np, "where", seen)
    entries = np.arange(64)[:, None] * np.full((1, 4), 100)
    parts = entries[[3, 40, 63]] + 1
    best, distance = codes.nearest(parts, entries)
    assert best.tolist() == [3, 40, 63] and distance.tolist() == [4, 4, 4]
    # A few entries for each part, not all 64.
    assert 0 < sum(rounds) < 24


# Fill in the middle ------------------------------------------------------------------------

UNIT = {"line": r"[^\n]*\n|[^\n]+", "sentence": r"[^\n.!?]*[\n.!?]|[^\n.!?]+", "word": r"[^\n\t\v\f\r ]*[\n\t\v\f\r ]|[^\n\t\v\f\r ]+"}


def brute_middle(doc_id, text, rule):
    text = text or ""
    units = re.findall(UNIT[rule.unit], text)
    assert "".join(units) == text
    digest = sha(f"{rule.seed}:{'' if doc_id is None else doc_id}".encode())
    h = [int(digest[k : k + 8], 16) for k in (0, 8, 16, 24)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rule.percent:
        return (doc_id, len(units), "plain", None, None, text)
    if h[3] % 100 < rule.spm:
        return (doc_id, len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}")
    return (doc_id, len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def middle_texts():
    lines = [prose(k, k % 7) for k in range(40)]
    odd = ["\n", "\n\n\n", "a\n", "\na", "a", "é\n漢字\n\U0001f600", "has <M> inside\nand more", "ends in <", "a\n<S", "<<P\n>", "x. y! z?\n\r\n\tq"]
    return [*edge_texts(), *odd, "\n".join(lines), "\n".join(lines) + "\n", ("é漢" * 50 + "\n") * 300]


@pytest.mark.parametrize("rule", [middles.Rule(), middles.Rule("s", "sentence", 70, 30), middles.Rule("w", "word", 100, 100)])
def test_middles_equal_brute_force(spark, monkeypatch, rule):
    texts = middle_texts()
    docs = documents(spark, texts, repeat=True).unionByName(documents(spark, ["a\nb\nc\nd"]).withColumn("doc_id", F.lit(None).cast("long")))
    wanted = [brute_middle(i, t, rule) for i, t in enumerate(texts)]
    wanted += [wanted[-1], wanted[1], brute_middle(None, "a\nb\nc\nd", rule)]
    found = middles.fill_in_middle(docs, rule).collect()
    assert sorted((tuple(r) for r in found), key=repr) == sorted(wanted, key=repr)
    digests = [(*w[:5], sha(w[5].encode()), sha((t or "").encode())) for w, t in zip(wanted, [*texts, texts[-1], texts[1], "a\nb\nc\nd"], strict=True)]
    found = middles.middle_digests(docs, rule).collect()
    assert sorted((tuple(r) for r in found), key=repr) == sorted(digests, key=repr)
    assert {w[2] for w in wanted} >= ({"plain", "spm", "psm"} if rule.spm < 100 else {"plain", "spm"})


def test_middles_of_nothing(spark):
    assert middles.middle_digests(no_documents(spark)).count() == 0
    assert middles.fill_in_middle(no_documents(spark)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 7), max_size=300), st.integers(0, 7))
def test_wavelet_ranks(values, asked):
    matrix = middles.WaveletMatrix(np.array(values, np.uint8))
    found = matrix.rank(asked, np.arange(len(values) + 1))
    assert found.tolist() == [values[:k].count(asked) for k in range(len(values) + 1)]


# Byte-pair encoding ------------------------------------------------------------------------


def odd_texts():
    made = random.Random(1)

    def letter():
        kind = made.randrange(7)
        if kind < 3:
            return chr(made.randrange(32, 127))
        if kind < 5:
            return made.choice(" \t\n\x00\x1c\x1f\x85  　́᪰ͅé漢")
        return chr(made.choice([made.randrange(0x80, 0x3000), made.randrange(0xE000, 0x1FFFF)]))

    fixed = [
        "it's DON'T we'LL 's", "<|endoftext|>x<|startoftext|>", "a<|endoftext|", "<|endoftext|><|endoftext|>b<|",
        "ΑΣ Σ İ ß ﬁ ǆ", "x" * 700, "ab" * 4000, "abcdefghij" * 50, "́́ ́", "12 34５６", "'" * 99,
    ]
    return fixed + ["".join(letter() for _ in range(made.randrange(60))) for _ in range(400)]


def test_forced_cuts_equal_the_library(spark, monkeypatch):
    monkeypatch.setattr(forced, "WORDS", 7)
    texts = [*edge_texts(), *odd_texts()]
    library = Tokenizer.from_file(WORDS)
    wanted = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    decoded = [library.decode(ids, skip_special_tokens=False) for ids in wanted]
    rows = sorted(forced.encode_words(documents(spark, texts), WORDS).collect(), key=lambda r: r.doc_id)
    assert [r.ids for r in rows] == wanted
    assert [r.decoded for r in rows] == decoded
    found = forced.word_digests(documents(spark, texts, repeat=True), WORDS).collect()
    expected = [
        (i, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(d.encode())) for i, (ids, d) in enumerate(zip(wanted, decoded, strict=True))
    ]
    assert sorted(tuple(r) for r in found) == sorted([*expected, expected[-1], expected[1]])
    assert forced.word_digests(no_documents(spark), WORDS).count() == 0


def small_merges():
    letters = forced.byte_letters()
    vocabulary_ = {c: k for k, c in enumerate(letters)} | {c + "$": 256 + k for k, c in enumerate(letters)}
    merges = [("a", "b"), ("b", "c"), ("ab", "c$"), ("a", "a"), ("aa", "aa"), ("c", "a"), ("ca", "b$"), ("b", "b$")]
    for a, b in merges:
        vocabulary_[a + b] = len(vocabulary_)
    return forced.Merges(vocabulary_, merges, "$"), vocabulary_, merges


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("abcd", min_size=1, max_size=60), min_size=1, max_size=8))
def test_fragments_merge_as_whole_words(words):
    own, vocabulary_, merges = small_merges()
    ranks = {pair: k for k, pair in enumerate(merges)}

    def plain(word):
        symbols = [*word[:-1], word[-1] + "$"]
        while True:
            pairs = [(ranks[p], i) for i, p in enumerate(zip(symbols[:-1], symbols[1:], strict=True)) if p in ranks]
            if not pairs:
                return [vocabulary_[s] for s in symbols]
            _, i = min(pairs)
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]

    for word in words:
        data = np.frombuffer(word.encode(), np.uint8)
        symbols = own.symbols(data, np.array([len(data) - 1]))
        bounds = np.r_[0, np.flatnonzero(own.certain(data)) + 1, len(data)]
        ids, counts = own.merge_all(symbols, bounds)
        assert ids.tolist() == plain(word)
        assert counts.sum() == len(ids)
        assert own.merged_by_heap(symbols.tolist()) == plain(word)
        assert "d" not in word or len(bounds) > 2 or word == "d"


def test_long_runs_do_not_take_quadratic_time():
    own, _, _ = small_merges()
    data = np.frombuffer(b"a" * 200_000, np.uint8)
    ids, _ = own.merge_all(own.symbols(data, np.array([len(data) - 1])), np.array([0, len(data)]))
    assert len(ids) == 50_000 + 2


@pytest.mark.parametrize(
    ("name", "change", "message"),
    [
        ("model", {"dropout": 0.1}, "plain BPE"),
        ("model", {"ignore_merges": True}, "plain BPE"),
        ("decoder", {"type": "ByteLevel", "add_prefix_space": True, "trim_offsets": True, "use_regex": True}, "decoder"),
        ("pre_tokenizer", {"type": "ByteLevel", "add_prefix_space": True, "trim_offsets": True, "use_regex": True}, "what is before"),
        ("pre_tokenizer", {"type": "Whitespace"}, "byte-level"),
    ],
)
def test_other_kinds_of_files_are_refused(tmp_path, name, change, message):
    with open(WORDS, encoding="utf-8") as file:
        made = json.load(file)
    made[name] = made[name] | change if name == "model" else change
    path = tmp_path / "other.json"
    path.write_text(json.dumps(made))
    with pytest.raises(ValueError, match=message):
        forced.ForcedEncoder(str(path))


def test_texts_with_white_space_of_their_own_go_alone():
    own, _ = forced.encoder(WORDS)
    texts = ["a　b", "　", "c", "d e"]
    ids, first = own.encode(pa.array([" ".join(texts)]))
    assert ids.tolist() == Tokenizer.from_file(WORDS).encode(" ".join(texts), add_special_tokens=False).ids
    assert first.tolist() == [0, len(ids)]


# Very long texts ---------------------------------------------------------------------------


def test_long_texts_are_looked_up_in_stretches(monkeypatch):
    monkeypatch.setattr(segments, "LOOKUP_BYTES", 64)
    texts = [t for t in edge_texts() if t is not None] + odd_texts()[:40] + ["y" * 500 + " z"]
    library = Tokenizer.from_file(WORDS)
    wanted = [library.encode(t, add_special_tokens=False).ids for t in texts]
    pieces_path = vocabulary("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=pieces_path)

    def lists(found):
        ids, first = found
        return [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:], strict=True)]

    assert lists(forced.ForcedEncoder(WORDS).encode(pa.array(texts))) == wanted
    assert lists(records.WordEncoder(WORDS).encode(pa.array(texts))) == wanted
    pieces._models.clear()
    assert lists(pieces.encode_texts(pieces_path, pa.array(texts))) == model.encode(texts)


def test_long_texts_have_the_same_fingerprint(monkeypatch):
    texts = [prose(k, 40 + 30 * k) for k in range(6)] + ["", "ab", "x" * 400]
    wanted = [fingerprints.fingerprint(t) for t in texts]
    whole = [fingerprints._Text(k, t) for k, t in enumerate(texts)]
    edited = [a.edited_by(b) for a, b in zip(whole[1:], whole, strict=False)]
    monkeypatch.setattr(fingerprints, "STRETCH", 100)
    assert [fingerprints.fingerprint(t) for t in texts] == wanted
    cut = [fingerprints._Text(k, t) for k, t in enumerate(texts)]
    assert [a.edited_by(b) for a, b in zip(cut[1:], cut, strict=False)] == edited


def test_prefix_hashes_across_blocks():
    codes = np.random.default_rng(1).integers(0, 0x110000, 150_000).astype(np.uint32)
    prefix = fingerprints.PrefixHash(codes)
    for start, end in ((0, 5), (65_530, 65_545), (70_000, 140_000), (131_071, 131_073)):
        wanted = 0
        for base, prime in zip(fingerprints.BASES, fingerprints.PRIMES, strict=True):
            value = sum((int(c) + 1) * pow(base, k, prime) for k, c in enumerate(codes[start:end].tolist())) % prime
            wanted = wanted << 31 | value
        assert prefix.span(start, end) == wanted
    windows = prefix.windows(6)
    assert windows[65_533] == prefix.span(65_533, 65_539)
    assert (prefix.windows(6, 65_000, 2000) == windows[65_000:67_000]).all()


def test_byte_hashes_across_blocks():
    data = np.random.default_rng(2).integers(0, 256, 200_000).astype(np.uint8)
    data[140_000:140_100] = data[65_500:65_600]
    sums = words.rolling(data)
    starts = np.array([65_500, 140_000, 0, 131_000])
    hashes = words.span_hashes(sums, starts, starts + 100)
    alone = [words.span_hashes(words.rolling(data[s : s + 100]), np.array([0]), np.array([100]))[0] for s in starts]
    assert hashes.tolist() == alone and hashes[0] == hashes[1] != hashes[2]
