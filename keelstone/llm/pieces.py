"""SentencePiece encoding of merge-type vocabularies by a score-ordered agenda.

The agenda holds the adjacent symbol pairs whose joined text is a piece; the pair with the
highest score, the leftmost among equals, is merged and its new neighbours enter the
agenda. Symbols that end up outside the vocabulary become byte pieces.

No piece has the space mark after another character, so no merge crosses the start of a
run of spaces and texts split there. ``Agenda.encode`` runs the agenda of all distinct
segments of a slice side by side, one merge of each at a time; segments over
``LONG_SYMBOLS`` run theirs on a heap, which stays ``n log n``. Every result is compared
with the library's before it is used.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from keelstone.llm.batches import byte_view, keyed, ragged, slices, texts_of
from keelstone.llm.segments import LOOKUP_BYTES, SegmentTable, per_text

MARK = "▁"
#: What other normalisations would change: composed and wide letters, capitals, white space.
_PROBE = "  A  e\u0301 \u00e9 \ufb01 \uff21 \u2460\t b\n\u3000c  "
LONG_SYMBOLS = 96
_NEVER = np.iinfo(np.int64).max
_CODES = 0x110000


class Agenda:
    """A merge-type model with identity normalisation, a dummy prefix and byte fallback."""

    def __init__(self, model_path: str) -> None:
        import sentencepiece

        self.library = library = sentencepiece.SentencePieceProcessor(model_file=model_path)
        self.size = library.get_piece_size()
        if library.normalize(_PROBE) != (MARK + _PROBE).replace(" ", MARK):
            raise ValueError("a model that changes texts, or their white space, before it splits them")
        pieces = {}
        self.bytes = np.zeros(256, np.int64)
        for i in range(self.size):
            if library.is_byte(i):
                self.bytes[int(library.id_to_piece(i)[1:-1], 16)] = i
            elif not (library.is_control(i) or library.is_unknown(i) or library.is_unused(i)):
                pieces[library.id_to_piece(i)] = i
        if any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError("a piece has a space mark inside: texts cannot be split at spaces")
        # Symbols: piece ids, then single characters that only occur inside pieces, then others.
        self.singles = singles = sorted({c for p in pieces for c in p} - pieces.keys())
        symbols = pieces | {c: self.size + k for k, c in enumerate(singles)}
        self.other = self.size + len(singles)
        self.width = self.other + _CODES
        self.symbol_of = np.arange(_CODES, dtype=np.int64) + self.other
        for text, symbol in symbols.items():
            if len(text) == 1:
                self.symbol_of[ord(text)] = symbol
        scores = np.array([library.get_score(i) for i in range(self.size)])
        ranks = np.unique(-scores, return_inverse=True)[1].reshape(-1)
        pairs = {
            symbols[p[:k]] * self.width + symbols[p[k:]]: i
            for p, i in pieces.items()
            for k in range(1, len(p))
            if p[:k] in symbols and p[k:] in symbols
        }
        self.keys = np.array(sorted(pairs), np.int64)
        self.joined = np.array([pairs[k] for k in self.keys.tolist()], np.int64)
        self.ranks = ranks[self.joined].astype(np.int64)
        self.table = {k: (int(r), int(j)) for k, r, j in zip(self.keys.tolist(), self.ranks, self.joined, strict=True)}

    def _pair(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (or never) and joined symbol of pairs."""
        wanted = left * self.width + right
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        found = self.keys[at] == wanted
        return np.where(found, self.ranks[at], _NEVER), self.joined[at]

    def merge_one(self, symbols: list[int]) -> list[int]:
        """The agenda of one segment on a heap."""
        symbols = list(symbols)
        n = len(symbols)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        agenda: list[tuple[int, int, int, int]] = []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j >= 0 and (found := self.table.get(symbols[i] * self.width + symbols[j])):
                heapq.heappush(agenda, (found[0], i, symbols[i], symbols[j]))

        for i in range(n - 1):
            offer(i, i + 1)
        while agenda:
            _, i, left, right = heapq.heappop(agenda)
            j = after[i] if symbols[i] == left else -1
            if j < 0 or symbols[j] != right:
                continue  # one of the two has been merged since
            symbols[i] = self.table[left * self.width + right][1]
            symbols[j] = -1
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
            offer(before[i], i)
            offer(i, after[i])
        return [s for s in symbols if s >= 0]

    def merge_many(self, symbols: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The agendas of many segments side by side: symbols left, and how many of each."""
        done_symbols, done_owner = [], []
        owner = np.repeat(np.arange(len(counts)), counts)
        ranks, joined = self._ranked(symbols, owner)
        while len(symbols):
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            sizes = np.diff(np.r_[starts, len(symbols)])
            best = np.minimum.reduceat(ranks, starts)
            going = best != _NEVER
            if not going.all():
                ended = ~np.repeat(going, sizes)
                done_symbols.append(symbols[ended])
                done_owner.append(owner[ended])
                stay = ~ended
                symbols, owner, ranks, joined = symbols[stay], owner[stay], ranks[stay], joined[stay]
                best, sizes = best[going], sizes[going]
                if not len(symbols):
                    break
                starts = np.cumsum(sizes) - sizes
            at = np.flatnonzero(ranks == np.repeat(best, sizes))
            group = np.searchsorted(starts, at, "right") - 1
            at = at[np.r_[True, group[1:] != group[:-1]]]  # the leftmost of each segment
            symbols[at] = joined[at]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            symbols, owner, ranks, joined = symbols[keep], owner[keep], ranks[keep], joined[keep]
            at = at - np.arange(len(at))
            for place in (at, at[at > 0] - 1):
                follow = np.minimum(place + 1, len(symbols) - 1)
                rank, join = self._pair(symbols[place], symbols[follow])
                same = (owner[follow] == owner[place]) & (follow > place)
                ranks[place] = np.where(same, rank, _NEVER)
                joined[place] = join
        symbols = np.concatenate(done_symbols) if done_symbols else symbols
        owner = np.concatenate(done_owner) if done_owner else owner
        order = np.argsort(owner, kind="stable")
        return symbols[order], np.bincount(owner, minlength=len(counts))

    def _ranked(self, symbols: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ranks = np.full(len(symbols), _NEVER)
        joined = np.zeros(len(symbols), np.int64)
        if len(symbols) > 1:
            rank, joined[:-1] = self._pair(symbols[:-1], symbols[1:])
            ranks[:-1] = np.where(owner[1:] == owner[:-1], rank, _NEVER)
        return ranks, joined

    def encode(self, segments: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of segments, each starting with the space that the dummy prefix stands for."""
        counts = pc.utf8_length(segments).to_numpy(zero_copy_only=False).astype(np.int64)
        data, _ = byte_view(segments)
        codes = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32).copy()
        codes[codes == 32] = ord(MARK)
        symbols = self.symbol_of[codes]
        starts = np.cumsum(counts) - counts
        long = counts > LONG_SYMBOLS
        short = np.where(long, 0, counts)
        merged, left = self.merge_many(symbols[ragged(starts, short)], short)
        if long.any():
            parts = {
                int(i): np.array(self.merge_one(symbols[starts[i] : starts[i] + counts[i]].tolist()))
                for i in np.flatnonzero(long)
            }
            ends = np.cumsum(left)
            chunks, at = [], 0
            for i, part in parts.items():
                chunks += [merged[at : ends[i]], part]
                at, left[i] = ends[i], len(part)
            merged = np.concatenate([*chunks, merged[at:]])
        ids, counts = self._ids(merged, left)
        self._check(segments, ids, counts)
        return ids, counts

    def _ids(self, symbols: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids; a character outside the vocabulary becomes its bytes."""
        outside = symbols >= self.size
        if not outside.any():
            return symbols.astype(np.uint32), counts
        sizes = np.ones(len(symbols), np.int64)
        expanded = {}
        for s in np.unique(symbols[outside]).tolist():
            char = chr(s - self.other) if s >= self.other else self.singles[s - self.size]
            expanded[s] = self.bytes[list(char.encode())]
        for place in np.flatnonzero(outside).tolist():
            sizes[place] = len(expanded[int(symbols[place])])
        starts = np.cumsum(sizes) - sizes
        flat = np.repeat(symbols, sizes)
        for place in np.flatnonzero(outside).tolist():
            flat[starts[place] : starts[place] + sizes[place]] = expanded[int(symbols[place])]
        sums = np.r_[0, np.cumsum(sizes)]
        ends = np.cumsum(counts)
        return flat.astype(np.uint32), sums[ends] - sums[ends - counts]

    def _check(self, segments: pa.LargeStringArray, ids: np.ndarray, counts: np.ndarray) -> None:
        texts = [t[1:] for t in segments.to_pylist()]
        # A lone space is the dummy prefix itself; the library adds none to an empty text.
        wanted = self.library.encode(texts, num_threads=1) if texts else []
        sizes = np.fromiter(map(len, wanted), np.int64, len(wanted))
        flat = np.fromiter(itertools.chain.from_iterable(wanted), np.int64, int(sizes.sum()))
        real = np.fromiter((bool(t) for t in texts), bool, len(texts))
        ours = ids[np.repeat(real, counts)]
        if not (np.array_equal(counts[real], sizes[real]) and np.array_equal(ours, flat)):
            raise ValueError("the agenda and the sentencepiece library disagree")


_models: dict[str, tuple[Agenda, SegmentTable]] = {}


def model(path: str) -> tuple[Agenda, SegmentTable]:
    """The model of this worker, read once."""
    if path not in _models:
        agenda = Agenda(path)
        _models[path] = agenda, SegmentTable(agenda.encode)
    return _models[path]


def encode_texts(path: str, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids of whole texts, flat, and their ``n + 1`` offsets; a null or empty text has none."""
    _, table = model(path)
    texts = texts_of(texts)
    if pc.any(pc.match_substring(texts, MARK)).as_py():
        texts = pc.replace_substring(texts, MARK, " ")
    data, ends = byte_view(texts)
    filled = np.diff(ends) > 0
    data = np.insert(data, ends[:-1][filled], 32)
    ends = ends + np.r_[0, np.cumsum(filled)]
    start = data == 32
    start[1:] &= data[:-1] != 32
    start[ends[:-1][filled]] = True
    bounds = np.flatnonzero(start)
    ids, counts = table.ids(data, np.r_[bounds, len(data)])
    return ids, per_text(counts, np.searchsorted(bounds, ends))


ENCODED = "doc_id long, text string, ids array<int>, decoded string"


def encode_pieces(docs: DataFrame, model_path: str) -> DataFrame:
    """``doc_id, text, ids, decoded``: ids of the whole text and what they decode to.

    A null text counts as empty: no ids, decoded ''. Repeated rows stay, and rows without an
    id; an empty table gives no rows; extra columns are ignored. Of pairs with equal scores
    the leftmost is merged. ``model_path`` is read on every executor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=LOOKUP_BYTES):
            ids, at = encode_texts(model_path, batch.column("text"))
            library = model(model_path)[0].library
            lists = [ids[a:b].tolist() for a, b in itertools.pairwise(at.tolist())]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("text"),
                    pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.astype(np.int32))),
                    pa.array([library.decode(x) if x else "" for x in lists], pa.string()),
                ],
                names=["doc_id", "text", "ids", "decoded"],
            )

    return keyed(docs, "doc_id", "text").mapInArrow(run, ENCODED)


DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def piece_digests(docs: DataFrame, model_path: str) -> DataFrame:
    """Number of ids, and digests of the ids and of the decoded text, per document.

    The same encoding as ``encode_pieces``, without carrying the ids out of the task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        agenda, _ = model(model_path)
        names = [str(i) for i in range(agenda.size)]
        for batch in slices(batches, limit=LOOKUP_BYTES):
            ids, at = encode_texts(model_path, batch.column("text"))
            coded, decoded = [], []
            for a, b in itertools.pairwise(at.tolist()):
                own = ids[a:b].tolist()
                coded.append(hashlib.sha256(",".join([names[i] for i in own]).encode()).hexdigest())
                text = agenda.library.decode(own) if own else ""
                decoded.append(hashlib.sha256(text.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.diff(at)), pa.array(coded), pa.array(decoded)],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return keyed(docs, "doc_id", "text").mapInArrow(run, DIGESTS)
