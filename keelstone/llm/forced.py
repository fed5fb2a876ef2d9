"""Byte-pair encoding with certain cuts: byte pairs that no vocabulary token holds.

A token that spans two neighbouring bytes holds that pair. Where no token of the vocabulary
does, no merge can ever cross, whatever is around: the text is cut there, the fragments are
encoded independently, and their ids are concatenated. Cuts make fragments short and alike:
each distinct one of a step is merged once, all of them side by side.

Texts are normalised and split into words as the tokenizer's own file says; neither step
looks across white space, so each distinct word between white space is taken once. Merging
is done here.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from keelstone.llm.batches import byte_view, keyed, ragged, slices, texts_of
from keelstone.llm.segments import LOOKUP_BYTES, SegmentTable, per_text

#: From so many symbols on, a fragment is merged on its own, from a heap.
HEAP_SYMBOLS = 48
#: Fragments that are merged side by side, and words that are normalised in one call.
ROWS = 8192
WORDS = 2048
#: Rank of what is no rule.
NO_RULE = np.iinfo(np.int32).max


def byte_letters() -> list[str]:
    """The letter that stands for every byte in the vocabulary.

    Printable Latin-1 bytes stand for themselves, the others for the letters from 256 on.
    """
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    letters = {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(other)}
    return [letters[b] for b in range(256)]


class Merges:
    """A BPE vocabulary over byte letters, its merges, and its certain cuts."""

    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]], word_end: str = "") -> None:
        letters = byte_letters()
        byte_of = {c: b for b, c in enumerate(letters)}
        self.word_end = word_end
        self.inner = np.array([vocabulary[c] for c in letters], np.int64)
        self.final = np.array([vocabulary[c + word_end] for c in letters], np.int64)
        self.size = max(vocabulary.values()) + 1
        #: Rank of a pair of ids and the id they become; the same as sorted arrays.
        self.rules: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (a, b) in enumerate(merges):
            # Of a pair that is listed twice the later rank holds.
            self.rules[vocabulary[a], vocabulary[b]] = (rank, vocabulary[a + b])
        keys = np.array([a * self.size + b for a, b in self.rules], np.int64)
        order = np.argsort(keys)
        found = np.array(list(self.rules.values()), np.int64).reshape(-1, 2)[order]
        #: One more rule, larger than any pair, stands for no rule.
        self.keys = np.r_[keys[order], np.iinfo(np.int64).max]
        self.ranks, self.results = (np.r_[found[:, k], NO_RULE].astype(np.int32) for k in (0, 1))
        #: Whether a token holds a pair of bytes, at 256 times the first plus the second.
        self.inside = np.zeros(1 << 16, bool)
        for token in vocabulary:
            body = token.removesuffix(word_end) if word_end else token
            known = [byte_of.get(c) for c in body]
            for a, b in itertools.pairwise(known):
                if a is not None and b is not None:
                    self.inside[a << 8 | b] = True

    def certain(self, data: np.ndarray) -> np.ndarray:
        """For each byte but the first, whether a cut before it is certain."""
        return ~self.inside[data[:-1].astype(np.uint16) << 8 | data[1:]]

    def symbols(self, data: np.ndarray, final: np.ndarray) -> np.ndarray:
        """Ids of single bytes; ``final`` are the places of those that end a word."""
        ids = self.inner[data]
        ids[final] = self.final[data[final]]
        return ids

    def merge_all(self, ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of fragments after all merges, flat, and how many each has.

        ``first`` are the ``n + 1`` offsets of the fragments. Fragments of like lengths are
        merged side by side, the longest ones on their own.
        """
        sizes = np.diff(first)
        counts = np.zeros(len(sizes), np.int64)
        out = np.empty(len(ids), np.int64)
        order = np.argsort(sizes, kind="stable")
        short = order[: np.searchsorted(sizes[order], HEAP_SYMBOLS)]
        for at in range(0, len(short), ROWS):
            rows = short[at : at + ROWS]
            width = int(sizes[rows[-1]])
            table = np.full((len(rows), width), -1, np.int64)
            held = np.arange(width) < sizes[rows][:, None]
            table[held] = ids[ragged(first[rows], sizes[rows])]
            table = self._side_by_side(table)
            counts[rows] = (table >= 0).sum(axis=1)
            out[ragged(first[rows], counts[rows])] = table[table >= 0]
        for row in order[len(short) :].tolist():
            found = self.merged_by_heap(ids[first[row] : first[row + 1]].tolist())
            counts[row] = len(found)
            out[first[row] : first[row] + len(found)] = found
        return out[ragged(first[:-1], counts)], counts

    def _rules(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Numbers of the rules of pairs; the last one is none. A symbol below zero is none."""
        keys = np.where((left >= 0) & (right >= 0), left * self.size + right, -1)
        at = np.searchsorted(self.keys, keys)
        return np.where(self.keys[at] == keys, at, len(self.keys) - 1)

    def _side_by_side(self, table: np.ndarray) -> np.ndarray:
        """Rows of symbols, -1 behind their ends, after all merges.

        Each round every row takes its merge of the lowest rank, the leftmost of equal ones;
        then only the pairs on both sides of it are looked up again.
        """
        width = table.shape[1]
        if width < 2:
            return table
        rules = self._rules(table[:, :-1], table[:, 1:])
        active = np.arange(len(table))
        places = np.arange(width)
        while len(active):
            own, held = table[active], rules[active]
            at = self.ranks[held].argmin(axis=1)
            row = np.arange(len(active))
            rule = held[row, at]
            go = self.ranks[rule] != NO_RULE
            active, own, held, at, rule = active[go], own[go], held[go], at[go], rule[go]
            if not len(active):
                break
            row = np.arange(len(active))
            own[row, at] = self.results[rule]
            later = np.minimum(places + (places > at[:, None]), width - 1)
            own = np.take_along_axis(own, later, axis=1)
            own[:, -1] = -1
            # The pair that has gone is at ``at``; those behind it move up.
            later = np.minimum(places[:-1] + (places[:-1] >= at[:, None]), width - 2)
            held = np.take_along_axis(held, later, axis=1)
            held[:, -1] = len(self.keys) - 1
            for side in (at - 1, at):
                has = np.flatnonzero((side >= 0) & (side < width - 1))
                held[has, side[has]] = self._rules(own[has, side[has]], own[has, side[has] + 1])
            table[active], rules[active] = own, held
        return table

    def merged_by_heap(self, ids: list[int]) -> list[int]:
        """The same for long runs: candidates wait in a heap, symbols are linked."""
        rules = self.rules
        n = len(ids)
        ids, after, before = list(ids), list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []

        def offer(i: int) -> None:
            if i >= 0 and after[i] < n:
                pair = (ids[i], ids[after[i]])
                rule = rules.get(pair)
                if rule is not None:
                    heapq.heappush(heap, (rule[0], i, pair, rule[1]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, pair, new = heapq.heappop(heap)
            j = after[i] if ids[i] >= 0 else n
            # Symbols that were merged meanwhile have no such pair any more.
            if j >= n or (ids[i], ids[j]) != pair:
                continue
            ids[i], ids[j] = new, -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            offer(before[i])
            offer(i)
        return [x for x in ids if x >= 0]


class ForcedEncoder:
    """A tokenizer file of the byte-level BPE kind, encoded by fragments.

    The file's normaliser and pre-tokenizer are applied as they are, without knowledge of
    what they do, to text between white space. A file with dropout, unknown or fused tokens,
    prefixes, or letters other than bytes is refused, as its merges would be other ones; so
    is a normaliser or pre-tokenizer that looks at the start of a text.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            self.file = json.load(file)
        self.library = Tokenizer.from_file(path)
        self._check()
        model = self.file["model"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.merges = Merges(model["vocab"], merges, model.get("end_of_word_suffix") or "")
        self.special = {t["content"]: t["id"] for t in self.file["added_tokens"]}
        self.names = {i: t for t, i in (model["vocab"] | self.special).items()}
        self.bytes_of = {ord(c): b for b, c in enumerate(byte_letters())}
        self.table = SegmentTable(self._encode)

    def _check(self) -> None:
        model = self.file["model"]
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges") if model.get(k)]
        if model["type"] != "BPE" or odd:
            raise ValueError(f"not a plain BPE vocabulary: {odd or model['type']}")
        if self.file["decoder"] is not None:
            raise ValueError("ids are decoded by joining tokens; the file names a decoder")
        steps = _steps(self.file["normalizer"], "normalizers") + _steps(self.file["pre_tokenizer"], "pretokenizers")
        kinds = [s["type"] for s in steps]
        if set(kinds) - {"NFC", "NFD", "NFKC", "NFKD", "Lowercase", "Replace", "Split", "ByteLevel"} or kinds[-1:] != ["ByteLevel"]:
            raise ValueError(f"not a byte-level tokenizer: {kinds}")
        if any(s.get("add_prefix_space") or s.get("use_regex") for s in steps):
            raise ValueError("a tokenizer that looks at what is before a word")
        white = [s for s in steps if s["type"] == "Split" and s["behavior"] == "Removed" and s.get("invert")]
        if not white or self._pieces(["a \t\n b"])[0] != ["a", "b"]:
            raise ValueError("white space is part of tokens")
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in self.file["added_tokens"]):
            raise ValueError("added tokens that depend on what is around them")

    def _pieces(self, texts: list[str]) -> tuple[list[str], list[int]]:
        """Words of texts without white space, in byte letters, and the number of their text.

        Many texts go through the library at once, a space between them; a text that turns
        out to hold white space of its own goes alone.
        """
        normalise = self.library.normalizer.normalize_str if self.library.normalizer else str
        split = self.library.pre_tokenizer.pre_tokenize_str
        joined = " ".join(texts)
        # Python's white space holds all that a tokenizer may take for it.
        if len(joined.split()) == len(texts):
            plain = normalise(joined)
            codes = np.frombuffer(plain.encode("utf-32-le"), np.uint32)
            spaces = np.flatnonzero(codes == 32)
            if len(spaces) == len(texts) - 1:
                found = split(plain)
                starts = np.fromiter((span[0] for _, span in found), np.int64, len(found))
                return [p for p, _ in found], np.searchsorted(spaces, starts).tolist()
        pieces, owners = [], []
        for k, text in enumerate(texts):
            own = [p for p, _ in split(normalise(text))]
            pieces += own
            owners += [k] * len(own)
        return pieces, owners

    def _plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of texts without white space and added tokens, and how many each has."""
        pieces: list[str] = []
        owners: list[int] = []
        # Plain letters apart, as the others may hold white space beyond ASCII.
        simple = np.array([t.isascii() and t.isprintable() for t in texts], bool)
        for kind in (np.flatnonzero(simple).tolist(), np.flatnonzero(~simple).tolist()):
            for at in range(0, len(kind), WORDS):
                own = kind[at : at + WORDS]
                words, of = self._pieces([texts[k] for k in own])
                pieces += words
                owners += [own[k] for k in of]
        counts = np.zeros(len(texts), np.int64)
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        if not sizes.sum():
            return np.zeros(0, np.int64), counts
        data = np.frombuffer("".join(pieces).translate(self.bytes_of).encode("latin-1"), np.uint8)
        ends = np.cumsum(sizes)
        bound = np.zeros(len(data) + 1, bool)
        bound[0] = True
        bound[1:-1] = self.merges.certain(data)
        bound[ends] = True
        bounds = np.flatnonzero(bound)
        symbols = self.merges.symbols(data, ends[sizes > 0] - 1)
        # Equal fragments have equal symbols, the end of a word included.
        symbols = symbols.astype("<i4")
        coded = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(),
            len(bounds) - 1,
            [None, pa.py_buffer(np.ascontiguousarray(bounds * 4, np.int64)), pa.py_buffer(symbols)],
        ).dictionary_encode()
        flat, first = byte_view(coded.dictionary.cast(pa.large_binary()))
        ids, size = self.merges.merge_all(np.frombuffer(flat.tobytes(), "<i4").astype(np.int64), first // 4)
        kind = coded.indices.to_numpy(zero_copy_only=False)
        start, many = (np.cumsum(size) - size)[kind], size[kind]
        owner = np.array(owners, np.int64)[np.searchsorted(ends, bounds[:-1], "right")]
        # Pieces of plain and other texts took turns: back into the order of the texts.
        order = np.argsort(owner, kind="stable")
        np.add.at(counts, owner, many)
        return ids[ragged(start[order], many[order])], counts

    def _ids(self, text: str) -> list[int]:
        """Ids of text without white space; added tokens are taken out first, the earliest first."""
        out: list[int] = []
        while text:
            found = [(text.find(t), -len(t), t) for t in self.special if t in text]
            if not found:
                return out + self._plain([text])[0].tolist()
            at, _, token = min(found)
            out += self._plain([text[:at]])[0].tolist() if at else []
            out.append(self.special[token])
            text = text[at + len(token) :]
        return out

    def _encode(self, segments: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
        texts = segments.to_pylist()
        marked = np.zeros(len(texts), bool)
        for token in self.special:
            marked |= pc.match_substring(segments, token).to_numpy(zero_copy_only=False)
        odd = np.flatnonzero(marked)
        flat, counts = self._plain([t for t, m in zip(texts, marked.tolist(), strict=True) if not m])
        if not len(odd):
            return flat.astype(np.uint32), counts
        lists = [self._ids(texts[k]) for k in odd.tolist()]
        all_counts = np.zeros(len(texts), np.int64)
        all_counts[~marked] = counts
        all_counts[odd] = [len(x) for x in lists]
        first = np.cumsum(all_counts) - all_counts
        out = np.empty(int(all_counts.sum()), np.uint32)
        out[ragged(first[~marked], counts)] = flat
        for k, own in zip(odd.tolist(), lists, strict=True):
            out[first[k] : first[k] + len(own)] = own
        return out, all_counts

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of whole texts and their ``n + 1`` offsets; a null or empty text has none."""
        data, ends = byte_view(texts_of(texts))
        solid = (data != 32) & ((data < 9) | (data > 13))
        start = solid.copy()
        start[1:] &= ~solid[:-1]
        inner = ends[(ends > 0) & (ends < len(data))]
        start[inner] = solid[inner]
        starts = np.flatnonzero(start)
        moved = np.zeros(len(data) + 1, np.int32 if len(data) < 1 << 31 else np.int64)
        np.cumsum(solid, out=moved[1:])
        packed = data[solid]
        ids, counts = self.table.ids(packed, np.r_[moved[starts], len(packed)])
        return ids, per_text(counts, np.searchsorted(starts, ends))

    def decoder(self) -> tuple[np.ndarray, np.ndarray]:
        """UTF-8 bytes of all tokens, each with a space behind it, and their offsets by id."""
        names = [self.names.get(i, "") + " " for i in range(max(self.names, default=-1) + 1)]
        coded = [n.encode() for n in names]
        first = np.r_[0, np.cumsum([len(c) for c in coded], dtype=np.int64)]
        return np.frombuffer(b"".join(coded), np.uint8), first


def _steps(step: dict | None, inner: str) -> list[dict]:
    if step is None:
        return []
    return step[inner] if step["type"] == "Sequence" else [step]


_encoders: dict[str, tuple[ForcedEncoder, tuple[np.ndarray, np.ndarray]]] = {}


def encoder(path: str) -> tuple[ForcedEncoder, tuple[np.ndarray, np.ndarray]]:
    """The encoder of this worker and its decoding table, read once."""
    if path not in _encoders:
        made = ForcedEncoder(path)
        _encoders[path] = made, made.decoder()
    return _encoders[path]


def decoded(table: tuple[np.ndarray, np.ndarray], ids: np.ndarray) -> bytes:
    """UTF-8 of the tokens of ids, joined by spaces, as a file without a decoder has it."""
    data, first = table
    ids = ids.astype(np.int64)
    return data[ragged(first[ids], first[ids + 1] - first[ids])][:-1].tobytes()


ENCODED = "doc_id long, text string, ids array<int>, decoded string"


def encode_words(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """``doc_id, text, ids, decoded``: ids of the whole text and what they decode to.

    A null text counts as empty: no ids, decoded ''. Repeated rows stay, a null id too; an
    empty table gives no rows; extra columns are ignored. A very long text is encoded whole,
    in a step of its own. ``tokenizer_path`` is read on every executor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, table = encoder(tokenizer_path)
        for batch in slices(batches, limit=LOOKUP_BYTES):
            ids, at = coder.encode(batch.column("text"))
            texts = [decoded(table, ids[a:b]).decode() for a, b in itertools.pairwise(at.tolist())]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("text"),
                    pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.astype(np.int32))),
                    pa.array(texts, pa.string()),
                ],
                names=["doc_id", "text", "ids", "decoded"],
            )

    return keyed(docs, "doc_id", "text").mapInArrow(run, ENCODED)


DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def word_digests(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Number of ids, and digests of the ids and of the decoded text, per document.

    The same encoding as ``encode_words``, without carrying the ids out of the task. Ids are
    digested as little-endian unsigned 32-bit integers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, table = encoder(tokenizer_path)
        for batch in slices(batches, limit=LOOKUP_BYTES):
            ids, at = coder.encode(batch.column("text"))
            ids = ids.astype("<u4")
            spans = list(itertools.pairwise(at.tolist()))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(np.diff(at)),
                    pa.array([hashlib.sha256(ids[a:b].tobytes()).hexdigest() for a, b in spans], pa.string()),
                    pa.array([hashlib.sha256(decoded(table, ids[a:b])).hexdigest() for a, b in spans], pa.string()),
                ],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return keyed(docs, "doc_id", "text").mapInArrow(run, DIGESTS)
