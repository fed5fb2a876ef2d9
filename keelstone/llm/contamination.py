"""Benchmark items inside documents, with edits, by the pigeonhole principle.

An item of ``m`` characters may differ by ``k`` edits (insertions, deletions,
replacements). Cut into ``k + 1`` pieces, one piece at least is untouched by any ``k``
edits, so exact piece hits find every place to look at. Each place is verified with Myers'
bit-parallel edit distance, the item as one long bit vector against the text around it.

An item too short for an edit counts where it stands as words of its own.

Both sides are compared in lower case with every run of white space as one space.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelstone.llm.batches import keyed, slices

#: Edits allowed per character of an item. A piece has about one over it characters.
EDIT_RATE = 0.05
#: Item text that one pass over the documents looks for; more items mean more passes.
BLOCK_BYTES = 2 << 20


def normal(text: str | None) -> str:
    """Lower case, single spaces; null is empty."""
    return " ".join((text or "").lower().split())


def budget(length: int, rate: float = EDIT_RATE) -> int:
    """Edits an item of a length may have."""
    return int(length * rate)


def stands_alone(text: str, start: int, end: int) -> bool:
    """Whether a stretch neither begins nor ends inside a word."""
    return not (
        (start > 0 and text[start].isalnum() and text[start - 1].isalnum())
        or (end < len(text) and text[end - 1].isalnum() and text[end].isalnum())
    )


def pieces(item: str, rate: float = EDIT_RATE) -> list[tuple[int, str]]:
    """``budget + 1`` pieces of near equal length, with their places in the item."""
    count = budget(len(item), rate) + 1
    cuts = [len(item) * i // count for i in range(count + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def best_match(pattern: str, text: str) -> tuple[int, int]:
    """Least edit distance of the pattern to any substring of a text, and its first end."""
    m = len(pattern)
    where: dict[str, int] = {}
    for i, c in enumerate(pattern):
        where[c] = where.get(c, 0) | 1 << i
    mask, high = (1 << m) - 1, 1 << (m - 1)
    plus, minus, distance = mask, 0, m
    best, end = m, 0
    for j, c in enumerate(text, 1):
        equal = where.get(c, 0)
        vertical = equal | minus
        diagonal = (((equal & plus) + plus) ^ plus) | equal
        up = minus | ~(diagonal | plus) & mask
        down = plus & diagonal
        if up & high:
            distance += 1
        elif down & high:
            distance -= 1
        up = up << 1 & mask
        down = down << 1 & mask
        plus = down | ~(vertical | up) & mask
        minus = up & vertical
        if distance < best:
            best, end = distance, j
    return best, end


@dataclass(frozen=True)
class Hit:
    """An item in a text: its closest place, the edits there, and how many places match."""

    item: int
    start: int
    end: int
    distance: int
    places: int


class Matcher:
    """The pieces of a block of items in one automaton.

    All items are sought the same way; one whose budget is nothing is its only piece. Of
    such an item, which stands inside other words by chance, places count that begin and
    end with a word. Items without text match nothing.
    """

    def __init__(self, items: list[tuple[int, str]], rate: float = EDIT_RATE) -> None:
        self.rate = rate
        self.items = [(i, t) for i, t in ((i, normal(t)) for i, t in items) if t]
        owners: dict[str, list[tuple[int, int]]] = {}
        for number, (_, text) in enumerate(self.items):
            for place, piece in pieces(text, rate):
                owners.setdefault(piece, []).append((number, place))
        self.automaton = ahocorasick.Automaton() if owners else None
        if self.automaton is not None:
            for piece, places in owners.items():
                self.automaton.add_word(piece, (len(piece), places))
            self.automaton.make_automaton()

    def find(self, raw: str | None) -> list[Hit]:
        """The items of a whole text; places are those of its normal form."""
        text = normal(raw)
        found: list[Hit] = []
        if self.automaton is None or not text:
            return found
        starts: dict[int, set[int]] = {}
        for end, (length, places) in self.automaton.iter(text):
            for number, place in places:
                starts.setdefault(number, set()).add(end + 1 - length - place)
        for number, candidates in starts.items():
            item, pattern = self.items[number]
            allowed = budget(len(pattern), self.rate)
            if not allowed:
                places = [a for a in sorted(candidates) if stands_alone(text, a, a + len(pattern))]
                if places:
                    found.append(Hit(item, places[0], places[0] + len(pattern), 0, len(places)))
                continue
            matches: list[tuple[int, int, int]] = []
            # Starts within the budget of each other share one look at the text.
            group: list[int] = []
            for start in [*sorted(candidates), None]:
                if group and (start is None or start - group[-1] > allowed):
                    low = max(0, group[0] - allowed)
                    window = text[low : group[-1] + len(pattern) + allowed]
                    distance, end = best_match(pattern, window)
                    if distance <= allowed:
                        _, back = best_match(pattern[::-1], window[:end][::-1])
                        matches.append((distance, low + end - back, low + end))
                    group = []
                if start is not None:
                    group.append(start)
            if matches:
                distance, start, end = min(matches)
                found.append(Hit(item, start, end, distance, len({m[2] for m in matches})))
        return sorted(found, key=lambda h: (h.item, h.start))


HITS = "doc_id long, item_id long, start int, end int, distance int, places int"


def _found(docs: DataFrame, items: list[tuple[int, str]], rate: float) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(shared.value, rate)
        for batch in slices(batches):
            rows = [
                (doc_id, h.item, h.start, h.end, h.distance, h.places)
                for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True)
                for h in matcher.find(text)
            ]
            kinds = [pa.int64(), pa.int64(), *[pa.int32()] * 4]
            columns = list(zip(*rows, strict=True)) if rows else [[] for _ in kinds]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                names=["doc_id", "item_id", "start", "end", "distance", "places"],
            )

    return docs.mapInArrow(run, HITS)


def _blocks(items: DataFrame, block_bytes: int) -> Iterator[list[tuple[int, str]]]:
    """The items with text, in blocks of bounded size; the driver holds one at a time.

    The blocks that were sent stay on disk until the tasks that need them have read them.
    """
    asked = keyed(items, "item_id", "text").filter(F.length(F.trim("text")) > 0)
    total = asked.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first().n
    count = -(-total // block_bytes)
    for block in range(count):
        own = asked.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == block)
        yield [(r.item_id, r.text) for r in own.orderBy("item_id").collect()]


def find_items(
    docs: DataFrame, items: DataFrame, block_bytes: int = BLOCK_BYTES, rate: float = EDIT_RATE
) -> DataFrame:
    """A row for every document and benchmark item in it: the closest place and its edits.

    The items are the query set. They are taken in blocks of at most about ``block_bytes``
    of text, sent to the executors one after the other; every block looks at all documents.
    An item of ``m`` characters may have ``int(m * rate)`` edits; without any it has to stand
    as words of its own.

    Null, empty and very long texts, repeated rows and equal items are all defined: no text
    matches nothing, each row and each item is answered for itself. Of places with as few
    edits the first one counts. Empty tables give no rows; extra columns are ignored.
    """
    plain = keyed(docs, "doc_id", "text")
    found = [_found(plain, block, rate) for block in _blocks(items, block_bytes)]
    return reduce(DataFrame.unionByName, found) if found else docs.sparkSession.createDataFrame([], HITS)


def without_items(
    docs: DataFrame, items: DataFrame, block_bytes: int = BLOCK_BYTES, rate: float = EDIT_RATE
) -> DataFrame:
    """The rows that hold no benchmark item, all columns kept; judged where they are.

    Rows with a null or empty text stay, as do repeated ones, each judged for itself; what
    counts as holding an item is what ``find_items`` finds.
    """
    for block in _blocks(items, block_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(shared.value, rate)
            for batch in slices(batches):
                clean = [not matcher.find(t) for t in batch.column("text").to_pylist()]
                yield batch.filter(pa.array(clean, pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
