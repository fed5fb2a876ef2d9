from __future__ import annotations

import hashlib
import itertools
import json
import zlib

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from keelstone.llm import pieces, records, sharding
from keelstone.llm.catalog import vocabulary
from tests.llm.data import documents, edge_texts, no_documents

MODEL, WORDS = vocabulary("piece_bpe_32k.model"), vocabulary("word_bpe_49k.json")
ODD = [
    "▁", "  two  spaces ", " ", "a▁b ▁▁ c", "<s> </s> <0x41> <unk>", "\x00\x01", "ABC İİ ΟΔΟΣ. it's we'll",
    "<|endoftext|> x <|ENDOFTEXT|>", "é Å.   x y", "a" * 500, "\U0001f600" * 40, "1234567890,;:!?'s",
]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_pieces_equal_the_library(spark, library):
    texts = edge_texts() + ODD
    rows = sorted(pieces.encode_pieces(documents(spark, texts), MODEL).collect(), key=lambda r: r.doc_id)
    digests = sorted(pieces.piece_digests(documents(spark, texts), MODEL).collect(), key=lambda r: r.doc_id)
    for text, row, digest in zip(texts, rows, digests, strict=True):
        ids = library.encode(text or "")
        decoded = library.decode(ids) if ids else ""
        assert (row.text, row.ids, row.decoded) == (text, ids, decoded)
        assert digest.n_tokens == len(ids)
        assert digest.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert digest.decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()
    assert pieces.piece_digests(no_documents(spark), MODEL).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=30), max_size=6))
def test_piece_ids_of_any_text(library, texts):
    ids, at = pieces.encode_texts(MODEL, pa.array(texts, pa.string()))
    assert [ids[a:b].tolist() for a, b in itertools.pairwise(at)] == [library.encode(t) for t in texts]


def test_both_agendas_agree():
    agenda = pieces.Agenda(MODEL)
    for word in (" internationalisation", " " + "ab" * 40, " the"):
        symbols = agenda.symbol_of[[ord(c) for c in word.replace(" ", pieces.MARK)]]
        many, counts = agenda.merge_many(symbols.copy(), np.array([len(symbols)]))
        assert many.tolist() == agenda.merge_one(symbols.tolist())
        assert counts.tolist() == [len(many)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=30), max_size=6))
def test_word_ids_of_any_text(texts):
    coder, plain = records.encoder(WORDS), Tokenizer.from_file(WORDS)
    ids, at = coder.encode(pa.array(texts, pa.string()))
    assert [ids[a:b].tolist() for a, b in itertools.pairwise(at)] == [plain.encode(t, add_special_tokens=False).ids for t in texts]


def test_records_equal_the_library(spark, tmp_path):
    plain, texts = Tokenizer.from_file(WORDS), edge_texts() + ODD
    wanted = [plain.encode(t or "", add_special_tokens=False).ids + [1] for t in texts]
    manifest = records.write_records(documents(spark, texts), str(tmp_path / "out"), WORDS, shards=4)
    rows = sorted(records.read_records(manifest).collect(), key=lambda r: (r.shard, r.record))
    assert [r.doc_id for r in rows] == list(range(len(texts)))
    assert [r.ids for r in rows] == wanted
    shuffled = records.read_records(manifest, seed=3).collect()
    assert sorted((r.doc_id, tuple(r.ids)) for r in shuffled) == sorted((r.doc_id, tuple(r.ids)) for r in rows)
    start = 0
    for row, ids in zip(sorted(records.record_digests(manifest).collect(), key=lambda r: r.doc_id), wanted, strict=True):
        assert (row.start, row.n_tokens, row.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_records_of_repeated_missing_and_no_rows(spark, tmp_path):
    twice = documents(spark, ["b", "a"], repeat=True).selectExpr("nullif(doc_id, 0) AS doc_id", "text")
    rows = records.read_records(records.write_records(twice, str(tmp_path / "a"), WORDS, shards=3))
    assert sorted((r.doc_id is not None, r.doc_id or 0) for r in rows.collect()) == [(False, 0)] + [(True, 1)] * 3
    nothing = records.write_records(no_documents(spark), str(tmp_path / "b"), WORDS, shards=2)
    assert records.record_digests(nothing).count() == 0


def test_damaged_records_fail(spark, tmp_path):
    manifest = records.write_records(documents(spark, ["some text"]), str(tmp_path / "out"), WORDS, shards=1)
    path = tmp_path / "out" / "part-000000.rec"
    data = bytearray(path.read_bytes())
    data[-6] ^= 1
    path.write_bytes(data)
    with pytest.raises(Exception, match="damaged record"):
        records.read_records(manifest).collect()


def test_shards(spark):
    texts = edge_texts()
    rows = sorted(sharding.shard_by_bytes(documents(spark, texts, repeat=True), 4).collect(), key=lambda r: (r.shard, r.slot))
    assert [r.doc_id for r in rows] == sorted([*range(len(texts)), 1, len(texts) - 1])
    sizes = [len((texts[r.doc_id] or "").encode()) + 1 for r in rows]
    assert [r["size"] for r in rows] == sizes
    assert [r.text_crc32 for r in rows] == [zlib.crc32((texts[r.doc_id] or "").encode()) for r in rows]
    target, at = sum(sizes) / 4, 0
    slots = dict.fromkeys(range(4), 0)
    for row, size in zip(rows, sizes, strict=True):
        assert row.shard == min(3, int((at + size / 2) / target))
        assert (row.law, row.slot, row.grown_shard) == ("bytes", slots[row.shard], None)
        slots[row.shard] += 1
        at += size
    assert sharding.shard_by_bytes(no_documents(spark)).count() == 0


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_other_tokenizer_files_encode_whole_texts(spark, tmp_path, name):
    path = vocabulary(name)
    texts = [*edge_texts(), "It's  A\ttest. <|endoftext|> x", "Mixed CASE, and\n\nlines"]
    library = Tokenizer.from_file(path)
    manifest = records.write_records(documents(spark, texts), str(tmp_path / "r"), path, end_id=None, shards=3)
    found = {r.doc_id: r.ids for r in records.read_records(manifest).collect()}
    assert found == {i: library.encode(t or "", add_special_tokens=False).ids for i, t in enumerate(texts)}
    assert records.WordEncoder(path).by_words == (name == "word_bpe_49k.json")


@pytest.mark.parametrize(
    ("part", "value"),
    [
        ("normalizer", {"type": "NFC"}),
        ("normalizer", None),
        ("pre_tokenizer", {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}),
        ("pre_tokenizer", {"type": "Whitespace"}),
        ("truncation", {"direction": "Right", "max_length": 3, "strategy": "LongestFirst", "stride": 0}),
    ],
)
def test_changed_tokenizer_files_encode_as_the_library(tmp_path, part, value):
    with open(WORDS, encoding="utf-8") as file:
        changed = json.load(file)
    changed[part] = value
    path = tmp_path / "changed.json"
    path.write_text(json.dumps(changed))
    texts = ["It's  A test, of UPPER words", "naïve Œuvre  two", ""]
    library = Tokenizer.from_file(str(path))
    library.no_truncation()
    ids, first = records.WordEncoder(str(path)).encode(pa.array(texts))
    for k, text in enumerate(texts):
        assert ids[first[k] : first[k + 1]].tolist() == library.encode(text, add_special_tokens=False).ids


def test_models_that_normalise_are_refused(monkeypatch):
    class Changing:
        def __init__(self, real):
            self.real = real

        def __getattr__(self, name):
            return getattr(self.real, name)

        def normalize(self, text):
            return self.real.normalize(text).lower()

    import sentencepiece

    real = sentencepiece.SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model"))
    monkeypatch.setattr(sentencepiece, "SentencePieceProcessor", lambda model_file: Changing(real))
    with pytest.raises(ValueError, match="changes texts"):
        pieces.Agenda("any")
