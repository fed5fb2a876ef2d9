"""Fill-in-the-middle forms of texts, their cuts found in a wavelet matrix of byte classes.

Every byte has a class: a line end, other white space, the end of a sentence, a byte inside
a character, or none of these. A wavelet matrix keeps the classes as one bit vector a level,
each with running counts, and answers how many bytes of a class lie before any place (its
rank). Rank queries combine: those of the classes that end a unit count the units before a
place, the one of inner bytes turns bytes into characters. The place of a unit's end is
found by bisection on that count, for all cuts of a slice at once.

A text of ``n`` units is cut where a digest of its id says. Prefix, middle and suffix are
written in the order of one of two forms, or the text stays plain.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from keelstone.llm.batches import byte_view, keyed, slices, texts_of

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
MARKS = (PREFIX, SUFFIX, MIDDLE)

OTHER, LINE_END, WHITE, SENTENCE_END, INNER = range(5)
#: Bits of a class.
LEVELS = 3
#: Classes that end a unit; what is left after the last of them is a unit as well.
UNITS = {"line": (LINE_END,), "sentence": (LINE_END, SENTENCE_END), "word": (LINE_END, WHITE)}


def byte_classes() -> np.ndarray:
    """Class of every byte of UTF-8."""
    out = np.full(256, OTHER, np.uint8)
    out[[9, 11, 12, 13, 32]] = WHITE
    out[10] = LINE_END
    out[list(b".!?")] = SENTENCE_END
    out[128:192] = INNER
    return out


class Bits:
    """A bit vector with the number of ones before any place."""

    def __init__(self, bits: np.ndarray) -> None:
        self.length = len(bits)
        packed = np.packbits(np.r_[bits, np.zeros(64, bool)], bitorder="little")
        self.words = np.frombuffer(packed[: len(packed) // 8 * 8].tobytes(), "<u8")
        self.before = np.zeros(len(self.words) + 1, np.int64)
        np.cumsum(np.bitwise_count(self.words), out=self.before[1:])

    def rank(self, place: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        word, bit = place >> 6, (place & 63).astype(np.uint64)
        low = self.words[word] & ((np.uint64(1) << bit) - np.uint64(1))
        return self.before[word] + np.bitwise_count(low)


class WaveletMatrix:
    """Ranks of small numbers in a sequence.

    Each level holds one bit of every number, the highest first; below it, those with a zero
    stand before those with a one, both in their order.
    """

    def __init__(self, values: np.ndarray, levels: int = LEVELS) -> None:
        self.length = len(values)
        self.levels: list[tuple[Bits, int]] = []
        for level in reversed(range(levels)):
            one = (values >> level & 1).astype(bool)
            self.levels.append((Bits(one), int(len(one) - one.sum())))
            values = np.concatenate([values[~one], values[one]])

    def rank(self, value: int, place: np.ndarray) -> np.ndarray:
        """How many of the numbers before each place equal ``value``."""
        low, high = np.zeros_like(place), place
        for depth, (bits, zeros) in enumerate(self.levels):
            before_low, before_high = bits.rank(low), bits.rank(high)
            if value >> (len(self.levels) - 1 - depth) & 1:
                low, high = zeros + before_low, zeros + before_high
            else:
                low, high = low - before_low, high - before_high
        return high - low


@dataclass(frozen=True)
class Cuts:
    """Per text: its units, and the places in bytes and characters where its middle begins and ends."""

    units: np.ndarray
    first: np.ndarray
    second: np.ndarray
    prefix_chars: np.ndarray
    middle_chars: np.ndarray


class Units:
    """Units and characters of the texts of a slice."""

    def __init__(self, data: np.ndarray, ends: np.ndarray, unit: str) -> None:
        self.matrix = WaveletMatrix(byte_classes()[data])
        self.ending = UNITS[unit]
        self.starts, self.stops = ends[:-1], ends[1:]
        self.before = self.closed(self.starts)
        full = self.closed(self.stops) - self.before
        filled = np.flatnonzero(self.stops > self.starts)
        open_end = np.zeros(len(full), bool)
        at = self.stops[filled]
        open_end[filled] = self.closed(at) == self.closed(at - 1)
        self.count = full + open_end

    def closed(self, place: np.ndarray) -> np.ndarray:
        """Units that end before each place, from the ranks of all classes that end one."""
        total = np.zeros(len(place), np.int64)
        for kind in self.ending:
            total += self.matrix.rank(kind, place)
        return total

    def characters(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Characters between places: bytes that are not inside one."""
        return high - low - (self.matrix.rank(INNER, high) - self.matrix.rank(INNER, low))

    def end_of(self, number: np.ndarray) -> np.ndarray:
        """Where the first ``number`` units of every text end, by bisection on the count.

        The first place with that many ends before it; where the last unit has no end of its
        own, and all units are asked for, that is the end of the text.
        """
        low, high = self.starts.copy(), self.stops.copy()
        while True:
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                return low
            middle = (low[open_] + high[open_]) >> 1
            enough = self.closed(middle) - self.before[open_] >= number[open_]
            high[open_[enough]] = middle[enough]
            low[open_[~enough]] = middle[~enough] + 1

    def cut(self, draws: np.ndarray) -> Cuts:
        """Cuts after as many units as the first two draws of every text say, modulo units + 1."""
        asked = draws[:, :2] % (self.count + 1)[:, None]
        first, second = self.end_of(asked.min(axis=1)), self.end_of(asked.max(axis=1))
        return Cuts(self.count, first, second, self.characters(self.starts, first), self.characters(first, second))


@dataclass(frozen=True)
class Rule:
    """How texts are turned.

    seed       begins what is digested for a text's draws
    unit       what a text is cut between: lines, sentences or words
    percent    of the texts are turned, the others stay plain
    spm        percent of the turned ones have their suffix first
    """

    seed: str = "7"
    unit: str = "line"
    percent: int = 100
    spm: int = 50


def draws(ids: list[int | None], seed: str) -> np.ndarray:
    """Four numbers of 32 bits for every id; a null id counts as an empty text."""
    digests = (hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).digest()[:16] for i in ids)
    return np.frombuffer(b"".join(digests), ">u4").reshape(-1, 4).astype(np.int64)


def turned(text: bytes, first: int, second: int, form: str) -> bytes:
    """A text in its form, the middle being its bytes from ``first`` to ``second``."""
    if form == "plain":
        return text
    prefix, middle, suffix = text[:first], text[first:second], text[second:]
    if form == "psm":
        return b"".join((PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle))
    return b"".join((SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle))


def restored(output: bytes, form: str) -> bytes:
    """The text that an output was made of; it holds no marks of its own unless it is plain."""
    if form == "plain":
        return output
    opening, between = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    if not output.startswith(opening):
        raise ValueError("not an output of this form")
    one, _, rest = output[len(opening) :].partition(between)
    two, mark, middle = rest.partition(MIDDLE)
    if not mark:
        raise ValueError("not an output of this form")
    prefix, suffix = (one, two) if form == "psm" else (two, one)
    return prefix + middle + suffix


def form_of(text: bytes, draw: np.ndarray, rule: Rule) -> str:
    """Plain where the text is empty, holds a mark, or its draw says so."""
    if not text or any(m in text for m in MARKS) or draw[2] % 100 >= rule.percent:
        return "plain"
    return "spm" if draw[3] % 100 < rule.spm else "psm"


def _turned(batches: Iterator[pa.RecordBatch], rule: Rule) -> Iterator[tuple[pa.RecordBatch, Cuts, list[tuple[str, bytes]]]]:
    for batch in slices(batches):
        data, ends = byte_view(texts_of(batch.column("text")))
        drawn = draws(batch.column("doc_id").to_pylist(), rule.seed)
        cuts = Units(data, ends, rule.unit).cut(drawn)
        rows = []
        for k, (low, high) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)):
            text = data[low:high].tobytes()
            form = form_of(text, drawn[k], rule)
            rows.append((form, turned(text, int(cuts.first[k]) - low, int(cuts.second[k]) - low, form)))
        yield batch, cuts, rows


def _shared(batch: pa.RecordBatch, cuts: Cuts, forms: list[str]) -> list[pa.Array]:
    plain = np.array([f == "plain" for f in forms], bool)
    return [
        batch.column("doc_id"),
        pa.array(cuts.units.astype(np.int64)),
        pa.array(forms, pa.string()),
        pa.array(cuts.prefix_chars.astype(np.int64), mask=plain),
        pa.array(cuts.middle_chars.astype(np.int64), mask=plain),
    ]


_COMMON = ["doc_id", "n", "form", "prefix_chars", "middle_chars"]
OUTPUTS = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def fill_in_middle(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output`` of every row from its whole text.

    ``n`` counts the units. A null or empty text has none and is plain, as is one that holds
    a mark. A null id draws as an empty one would. Rows that repeat an id are cut by the same
    draws, each in its own text; an empty table gives no rows; extra columns are ignored. A
    very long text makes a step of its own, with about twenty bytes for each of its bytes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, cuts, rows in _turned(batches, rule):
            outputs = pa.array([o.decode() for _, o in rows], pa.string())
            yield pa.RecordBatch.from_arrays([*_shared(batch, cuts, [f for f, _ in rows]), outputs], names=[*_COMMON, "output"])

    return keyed(docs, "doc_id", "text").mapInArrow(run, OUTPUTS)


DIGESTS = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string"


def middle_digests(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """The same as ``fill_in_middle`` with digests of the output and of the text rebuilt from it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, cuts, rows in _turned(batches, rule):
            made = [hashlib.sha256(o).hexdigest() for _, o in rows]
            back = [hashlib.sha256(restored(o, f)).hexdigest() for f, o in rows]
            yield pa.RecordBatch.from_arrays(
                [*_shared(batch, cuts, [f for f, _ in rows]), pa.array(made, pa.string()), pa.array(back, pa.string())],
                names=[*_COMMON, "output_sha256", "restored_sha256"],
            )

    return keyed(docs, "doc_id", "text").mapInArrow(run, DIGESTS)


#: The same rows in DuckDB.
ORACLE = r"""
WITH texts AS (
    SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || CAST(doc_id AS VARCHAR)) AS digest FROM documents
), lined AS (
    SELECT doc_id, text, regexp_extract_all(text, '[^\n]*\n|[^\n]+') AS units,
           CAST('0x' || digest[1:8] AS BIGINT) AS h1, CAST('0x' || digest[9:16] AS BIGINT) AS h2,
           CAST('0x' || digest[17:24] AS BIGINT) AS h3, CAST('0x' || digest[25:32] AS BIGINT) AS h4
    FROM texts
), asked AS (
    SELECT *, CAST(len(units) AS BIGINT) AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS a,
           greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS b,
           CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100
                THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
    FROM lined
), parts AS (
    SELECT doc_id, text, n, form, array_to_string(units[1:a], '') AS p, array_to_string(units[a + 1:b], '') AS m,
           array_to_string(units[b + 1:], '') AS s
    FROM asked
)
SELECT doc_id, n, form,
       CASE WHEN form <> 'plain' THEN CAST(length(coalesce(p, '')) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(coalesce(m, '')) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text
                   WHEN 'psm' THEN '<P>' || coalesce(p, '') || '<S>' || coalesce(s, '') || '<M>' || coalesce(m, '')
                   ELSE '<S>' || coalesce(s, '') || '<P>' || coalesce(p, '') || '<M>' || coalesce(m, '') END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM parts"""
