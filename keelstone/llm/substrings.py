"""Exact removal of repeated substrings: bytes in a 100-byte string that also starts earlier go.

Anchors find what to compare. Of the hashes of all ``GRAM``-byte strings in a window of
``LENGTH`` bytes the smallest is an anchor; equal windows have the same anchors at the same
places, so a window can only be repeated where one of its anchors is.

An anchor's snippet is the stretch that all windows around it cover. Of equal snippets, all
but the first go whole; equal means that two 64-bit hashes agree, the anchor's and their
own. Snippets that share an anchor and differ are compared through their suffix order: the
previous and next smaller position of a suffix in that order are the earlier places with
the longest match, its longest previous factor. Where it reaches ``LENGTH``, the window
repeats an earlier one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelstone.llm.batches import SLICE_BYTES, byte_view, keyed, parallelism, ragged, scratch_table, slices, texts_of
from keelstone.llm.words import mixed, rolling, span_hashes
from keelstone.session import cut_lineage

LENGTH = 100
GRAM = 32
#: Bytes before an anchor, or after its end, that a window around it may cover.
REACH = LENGTH - GRAM
#: Snippets of one anchor that are one task's; more are compared in parts of this size.
GROUP_SNIPPETS = 8192
#: Snippets a task remembers, each in the slot of its hash, to tell later copies of them.
REMEMBERED = 1 << 16
#: Snippet bytes whose suffixes are ordered at once.
BLOCK_BYTES = 1 << 19
_NULL_ID = (1 << 63) - 1


# Suffix orders -----------------------------------------------------------------------------


def _classes(keys: np.ndarray) -> np.ndarray:
    """Rank of every key among the distinct ones."""
    return np.unique(keys, return_inverse=True)[1].astype(np.int64).reshape(-1)


def _shifted(classes: np.ndarray, by: int) -> np.ndarray:
    """Class of the suffix ``by`` later; 0 beyond the end, others from 1."""
    out = np.zeros(len(classes), np.int64)
    if by < len(classes):
        out[: len(classes) - by] = classes[by:] + 1
    return out


def smaller_before(values: np.ndarray) -> np.ndarray:
    """Nearest place before each with a strictly smaller value, -1 if none.

    Where the value just before is not smaller, by halving over the least values of stretches.
    """
    at = np.arange(-1, len(values) - 1)
    wrong = np.flatnonzero((at >= 0) & (values[np.maximum(at, 0)] >= values))
    least = [values]  # least[k][i]: of the 2**k values from i on
    while len(wrong) and 2 << (len(least) - 1) <= len(values):
        half = 1 << (len(least) - 1)
        least.append(np.minimum(least[-1][:-half], least[-1][half:]))
    # All values of end .. wrong - 1 are at least as large.
    end, own = wrong.copy(), values[wrong]
    for k in range(len(least) - 1, -1, -1):
        size = 1 << k
        end -= size * ((end >= size) & (least[k][np.maximum(end - size, 0)] >= own))
    at[wrong] = end - 1
    return at


def neighbours(classes: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every suffix the suffixes with the previous and next smaller position in suffix order.

    ``order`` says which suffix starts earlier; -1 where there is none.
    """
    ranked = np.lexsort((order, classes))
    values = order[ranked]
    before = smaller_before(values)
    after = len(values) - 1 - smaller_before(values[::-1])[::-1]
    out = np.full((2, len(values)), -1)
    has = before >= 0
    out[0, ranked[has]] = ranked[before[has]]
    has = after < len(values)
    out[1, ranked[has]] = ranked[after[has]]
    return out[0], out[1]


def longest_previous_factors(data: np.ndarray) -> np.ndarray:
    """For every position the length of its longest match that starts earlier (overlaps count)."""
    n = len(data)
    levels, have = [data.astype(np.int64)], 1
    while have < n and len(np.unique(levels[-1])) < n:
        later = _shifted(levels[-1], have)
        levels.append(_classes(levels[-1] * (later.max(initial=0) + 1) + later))
        have *= 2
    best = np.zeros(n, np.int64)
    for near in neighbours(levels[-1], np.arange(n)):
        i, j = np.flatnonzero(near >= 0), near[near >= 0]
        length = np.zeros(len(i), np.int64)
        for k in range(len(levels) - 1, -1, -1):
            size = 1 << k
            a, b = i + length, j + length
            fits = (a + size <= n) & (b + size <= n)
            same = fits & (levels[k][np.minimum(a, n - 1)] == levels[k][np.minimum(b, n - 1)])
            length += np.where(same, size, 0)
        best[i] = np.maximum(best[i], length)
    return best


def repeated_windows(data: np.ndarray, starts: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Which windows of ``LENGTH`` bytes also start earlier.

    ``starts`` are the windows' places in ``data``, ``order`` their places in the corpus:
    windows of one place have equal values, an earlier one a smaller value. A window whose
    hash occurs once has no previous factor of its length. The others are ranked as suffixes,
    one of each hash by its bytes; a window has a previous factor of its length if one of its
    neighbours, the previous or next smaller position in suffix order, has its rank.
    """
    found = np.zeros(len(starts), bool)
    hashes = span_hashes(rolling(data), starts, starts + LENGTH)
    _, example, group, size = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
    asked = np.flatnonzero(size[group] > 1)
    if not len(asked):
        return found
    windows = np.lib.stride_tricks.sliding_window_view(data, LENGTH)
    kinds, of = np.unique(group[asked], return_inverse=True)
    examples = np.ascontiguousarray(windows[starts[example[kinds]]])
    for at in range(0, len(asked), 1 << 16):
        if (windows[starts[asked[at : at + (1 << 16)]]] != examples[of[at : at + (1 << 16)]]).any():
            raise ValueError("two windows share a hash")
    rank = np.empty(len(kinds), np.int64)
    rank[np.argsort(examples.view(f"S{LENGTH}").reshape(-1))] = np.arange(len(kinds))
    classes = rank[of]
    for near in neighbours(classes, order[asked]):
        has = np.flatnonzero(near >= 0)
        found[asked[has[classes[has] == classes[near[has]]]]] = True
    return found


# Anchors -----------------------------------------------------------------------------------


def _running(values: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` over every run of ``width`` values, by doubling."""
    have = 1
    while have * 2 <= width:
        values, have = pick(values[:-have], values[have:]), have * 2
    rest = width - have
    return pick(values[:-rest], values[rest:]) if rest else values


def anchors(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, place in the row and hash of every anchor, and byte prefix sums.

    ``data`` holds the bytes of all rows, ``ends`` their ``n + 1`` offsets. Windows across
    two rows may add anchors; they take none away.
    """
    sums = rolling(data)
    none = np.zeros(0, np.int64)
    if len(data) < LENGTH:
        return none, none, np.zeros(0, np.uint64), sums
    at = np.arange(len(data) - GRAM + 1)
    hashes = span_hashes(sums, at, at + GRAM)
    short = (hashes >> np.uint64(32)).astype(np.uint32)
    width = REACH + 1
    least = _running(short, width, np.minimum)
    most = np.full(len(short) + width - 1, 0, np.uint32)
    most[width - 1 : width - 1 + len(least)] = least
    # A gram is chosen if it is the least of any window that holds it.
    chosen = np.flatnonzero(_running(most, width, np.maximum) == short)
    row = np.searchsorted(ends, chosen, "right") - 1
    fits = (chosen + GRAM <= ends[row + 1]) & (ends[row + 1] - ends[row] >= LENGTH)
    chosen, row = chosen[fits], row[fits]
    return row, chosen - ends[row], hashes[chosen], sums


#: Columns of places: the anchor's hash, its snippet's, and where it is.
Places = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def _snippets(data: np.ndarray, ends: np.ndarray, ids: np.ndarray) -> Places:
    """Anchors with a hash of their snippets; ends cut off by the text are part of it."""
    row, place, hashes, sums = anchors(data, ends)
    at = ends[row] + place
    low, high = np.maximum(at - REACH, ends[row]), np.minimum(at + LENGTH, ends[row + 1])
    shape = (at - low).astype(np.uint64) * np.uint64(LENGTH + 1) + (high - at).astype(np.uint64)
    return hashes, mixed(span_hashes(sums, low, high) + mixed(shape + np.uint64(1))), ids[row], place


def _places_of(data: np.ndarray, ends: np.ndarray, ids: np.ndarray, step: int = SLICE_BYTES) -> Iterator[Places]:
    """Places of some texts; a text far longer than ``step`` goes by in stretches.

    A stretch sees what every window and snippet around its own bytes covers, so it finds
    the anchors, and their snippets, that the whole text has.
    """
    if len(ids) > 1 or len(data) <= 2 * step:
        yield _snippets(data, ends, ids)
        return
    margin = 2 * LENGTH
    for low in range(0, len(data), step):
        first, last = max(0, low - margin), min(len(data), low + step + margin)
        hashes, snippet, doc_id, place = _snippets(data[first:last], np.array([0, last - first]), ids)
        own = (place + first >= low) & (place + first < low + step)
        yield hashes[own], snippet[own], doc_id[own], place[own] + first


class _Seen:
    """The first places of the snippets a task came across, as far as there are slots for them."""

    def __init__(self) -> None:
        self.anchor = np.zeros(REMEMBERED, np.uint64)
        self.snippet = np.zeros(REMEMBERED, np.uint64)
        self.doc_id = np.zeros(REMEMBERED, np.int64)
        self.place = np.full(REMEMBERED, -1, np.int64)

    def copies(self, anchor: np.ndarray, snippet: np.ndarray, doc_id: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Which places have an equal snippet at an earlier one seen so far; none does so wrongly."""
        slot = (mixed(anchor ^ snippet) % np.uint64(REMEMBERED)).astype(np.int64)
        known = (self.place[slot] >= 0) & (self.anchor[slot] == anchor) & (self.snippet[slot] == snippet)
        after = (self.doc_id[slot] < doc_id) | ((self.doc_id[slot] == doc_id) & (self.place[slot] < place))
        out = known & after
        new = np.flatnonzero(~out)
        _, one = np.unique(slot[new], return_index=True)
        new, at = new[one], slot[new[one]]
        self.anchor[at], self.snippet[at], self.doc_id[at], self.place[at] = (c[new] for c in (anchor, snippet, doc_id, place))
        return out


PLACES = "anchor long, snippet long, doc_id long, place int"


def _place_batch(columns: Places) -> pa.RecordBatch:
    anchor, snippet, doc_id, place = columns
    return pa.RecordBatch.from_arrays(
        [
            pa.array(anchor.view(np.int64)),
            pa.array(snippet.view(np.int64)),
            pa.array(doc_id),
            pa.array(place.astype(np.int32)),
        ],
        names=["anchor", "snippet", "doc_id", "place"],
    )


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Places of a task's anchors.

    A place whose snippet the task has seen at an earlier one is a copy for sure. It does not
    have to meet the others: its anchor is its own place's hash, and its place below zero. So
    what is everywhere comes to its anchor's task about once for every task of this stage.
    """
    seen = _Seen()
    for batch in slices(batches):
        data, ends = byte_view(texts_of(batch.column("text")))
        ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
        for columns in _places_of(data, ends, ids):
            order = np.lexsort((columns[3], columns[2], columns[1], columns[0]))
            anchor, snippet, doc_id, place = (c[order] for c in columns)
            first = np.ones(len(anchor), bool)
            first[1:] = (anchor[1:] != anchor[:-1]) | (snippet[1:] != snippet[:-1])
            # A row that repeats a place is no second place.
            again = np.zeros(len(anchor), bool)
            again[1:] = ~first[1:] & (doc_id[1:] == doc_id[:-1]) & (place[1:] == place[:-1])
            copy = ~first
            lead = np.flatnonzero(first)
            copy[lead] = seen.copies(anchor[lead], snippet[lead], doc_id[lead], place[lead])
            own = mixed(mixed(doc_id.view(np.uint64)) + place.astype(np.uint64))
            anchor = np.where(copy, own, anchor)
            place = np.where(copy, -1 - place, place)
            yield _place_batch(tuple(c[~again] for c in (anchor, snippet, doc_id, place)))


#: What a place of a repeated anchor is: a copy of an earlier snippet, or the first of
#: several different snippets.
COPY, DIFFERENT = 0, 1
MATCHES = "kind int, anchor long, doc_id long, place int"


def _match_batch(kind: int, anchor: np.ndarray, doc_id: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(anchor), kind, np.int32)), pa.array(anchor), pa.array(doc_id), pa.array(place)],
        names=["kind", "anchor", "doc_id", "place"],
    )


def _matches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What the places are, as they come by in the order of anchor, snippet, id and place.

    Only the last place and the last first of a snippet wait for the next batch, however
    many places an anchor has.
    """
    names = ("anchor", "snippet", "doc_id", "place")
    last: list[np.ndarray] | None = None  # the last place, one row
    waiting: list[np.ndarray] | None = None  # the last first of a snippet, one row
    several = False  # whether an earlier snippet has its anchor
    for batch in batches:
        columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in names]
        sure = columns[3] < 0
        if sure.any():
            anchor, _, doc_id, place = (c[sure] for c in columns)
            yield _match_batch(COPY, anchor, doc_id, -1 - place)
            columns = [c[~sure] for c in columns]
        if not len(columns[0]):
            continue
        joined = columns if last is None else [np.concatenate(c) for c in zip(last, columns, strict=True)]
        anchor, snippet, doc_id, place = joined
        first = np.ones(len(anchor), bool)
        first[1:] = (anchor[1:] != anchor[:-1]) | (snippet[1:] != snippet[:-1])
        copy = ~first
        copy[1:] &= (doc_id[1:] != doc_id[:-1]) | (place[1:] != place[:-1])
        if last is not None:
            first[0] = False
            copy[0] = False
        last = [c[-1:] for c in joined]
        yield _match_batch(COPY, anchor[copy], doc_id[copy], place[copy])
        firsts = [c[first] for c in (anchor, doc_id, place)]
        if waiting is not None:
            firsts = [np.concatenate(c) for c in zip(waiting, firsts, strict=True)]
        if not len(firsts[0]):
            continue
        same = firsts[0][1:] == firsts[0][:-1]
        shared = np.r_[several, same] | np.r_[same, False]
        yield _match_batch(DIFFERENT, *(c[:-1][shared[:-1]] for c in firsts))
        several = bool(shared[-1])
        waiting = [c[-1:] for c in firsts]
    if waiting is not None and several:
        yield _match_batch(DIFFERENT, *waiting)


PACKED = "doc_id long, packed binary"


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts on their way through a shuffle: a third smaller than the shuffle's own packing."""
    work = zstandard.ZstdCompressor(level=1)
    for batch in slices(batches):
        packed = [work.compress(t.encode()) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(packed, pa.binary())], names=["doc_id", "packed"])


def _unpacked(batches: Iterator[pa.RecordBatch], *lists: str) -> Iterator[tuple]:
    """The id, the bytes of the text and the numbers of further list columns of every row."""
    work = zstandard.ZstdDecompressor()
    for batch in slices(batches, "packed"):
        ids, packed = (batch.column(c).to_pylist() for c in ("doc_id", "packed"))
        more = [batch.column(c) for c in lists]
        for k, doc_id in enumerate(ids):
            own = [_numbers(c[k]) for c in more]
            yield doc_id, work.decompress(packed[k]) if packed[k] else b"", *own


def _numbers(item: pa.ListScalar) -> np.ndarray:
    return item.values.to_numpy(zero_copy_only=False) if item.is_valid else np.zeros(0, np.int64)


CONTENT = "anchor long, doc_id long, place int, low int, content binary"


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of snippets at given places, with the anchors they were asked for."""
    for doc_id, data, anchor, place in _unpacked(batches, "anchors", "places"):
        for at in range(0, len(place), 4096):
            spots = place[at : at + 4096]
            low = np.maximum(spots - REACH, 0)
            content = [data[a : b + LENGTH] for a, b in zip(low.tolist(), spots.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(anchor[at : at + 4096]),
                    pa.array(np.full(len(spots), doc_id, np.int64)),
                    pa.array(spots),
                    pa.array(low.astype(np.int32)),
                    pa.array(content, pa.binary()),
                ],
                names=["anchor", "doc_id", "place", "low", "content"],
            )


# Comparison --------------------------------------------------------------------------------

SPANS = "doc_id long, low int, high int"
WINDOWS = "anchor long, window long, doc_id long, place int"


class _Block:
    """Snippets of whole groups (or of one part of a large group) and their windows."""

    def __init__(self, rows: list[tuple]) -> None:
        self.anchor, ids, _, low, contents = (list(c) for c in zip(*rows, strict=True))
        self.data = np.frombuffer(b"".join(contents), np.uint8)
        size = np.fromiter(map(len, contents), np.int64, len(contents))
        first = np.cumsum(size) - size
        count = np.maximum(size - LENGTH + 1, 0)
        self.row = np.repeat(np.arange(len(size)), count)
        self.starts = ragged(first, count)
        self.doc_id = np.array(ids, np.int64)[self.row]
        self.place = np.array(low, np.int64)[self.row] + self.starts - first[self.row]
        pairs = np.lexsort((self.place, self.doc_id))
        fresh = np.r_[True, (np.diff(self.doc_id[pairs]) != 0) | (np.diff(self.place[pairs]) != 0)]
        self.order = np.empty(len(pairs), np.int32)
        self.order[pairs] = np.cumsum(fresh[: len(pairs)])
        self.repeated = repeated_windows(self.data, self.starts, self.order) if len(pairs) else np.zeros(0, bool)

    def spans(self) -> pa.RecordBatch:
        """Runs of repeated windows."""
        at = np.flatnonzero(self.repeated)
        fresh = np.ones(len(at), bool)
        fresh[1:] = (np.diff(at) != 1) | (np.diff(self.row[at]) != 0)
        first, last = at[fresh], at[np.r_[fresh[1:], np.ones(min(1, len(at)), bool)]]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(self.doc_id[first]),
                pa.array(self.place[first].astype(np.int32)),
                pa.array((self.place[last] + LENGTH).astype(np.int32)),
            ],
            names=["doc_id", "low", "high"],
        )

    def windows(self) -> pa.RecordBatch:
        """Hashes of the windows that no earlier one of this block equals."""
        at = np.flatnonzero(~self.repeated)
        sums = rolling(self.data)
        hashes = span_hashes(sums, self.starts[at], self.starts[at] + LENGTH)
        anchor = np.array(self.anchor, np.int64)[self.row[at]]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(anchor),
                pa.array(hashes.view(np.int64)),
                pa.array(self.doc_id[at]),
                pa.array(self.place[at].astype(np.int32)),
            ],
            names=["anchor", "window", "doc_id", "place"],
        )


def _blocks(batches: Iterator[pa.RecordBatch], key: tuple[str, ...]) -> Iterator[_Block]:
    """Blocks of whole groups, up to about ``BLOCK_BYTES`` each; one group may exceed it."""
    names = ("anchor", "doc_id", "place", "low", "content")
    rows = (
        (tuple(r[: len(key)]), r[len(key) :])
        for batch in batches
        for r in zip(*(batch.column(c).to_pylist() for c in (*key, *names)), strict=True)
    )
    waiting: list[tuple] = []
    held = 0
    for _, run in groupby(rows, key=lambda r: r[0]):
        group = [r[1] for r in run]
        waiting += group
        held += sum(len(r[4]) for r in group)
        if held > BLOCK_BYTES:
            yield _Block(waiting)
            waiting, held = [], 0
    if waiting:
        yield _Block(waiting)


def _spans_in_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in _blocks(batches, ("anchor",)):
        yield block.spans()


def _spans_in_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in _blocks(batches, ("anchor", "part")):
        yield block.spans()


def _windows_in_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in _blocks(batches, ("anchor", "part")):
        yield block.windows()


def _differing(content: DataFrame, sizes: DataFrame, tasks: int) -> DataFrame:
    """Repeated windows among snippets that share an anchor.

    Anchors with many snippets are cut into parts. A part finds its own repeats; the windows
    it found no earlier match for meet by hash, where only the earliest stays.
    """
    small = content.join(sizes.filter(F.col("n") <= GROUP_SNIPPETS).select("anchor"), "anchor")
    dealt = small.repartition(tasks, "anchor").sortWithinPartitions("anchor", "doc_id", "place")
    out = dealt.mapInArrow(_spans_in_groups, SPANS)
    large = sizes.filter(F.col("n") > GROUP_SNIPPETS)
    if not large.limit(1).count():
        return out
    parts = F.ceil(F.col("n") * 2 / GROUP_SNIPPETS).cast("int")
    parted = content.join(large, "anchor").withColumn("part", F.pmod(F.xxhash64("doc_id", "place"), parts)).drop("n")
    parted = parted.repartition(tasks, "anchor", "part").sortWithinPartitions("anchor", "part", "doc_id", "place")
    windows = parted.mapInArrow(_windows_in_parts, WINDOWS)
    firsts = windows.groupBy("anchor", "window").agg(F.min(F.struct("doc_id", "place")).alias("first"), F.count("*").alias("n"))
    firsts = firsts.filter("n > 1").select("anchor", "window", "first")
    later = windows.join(firsts, ["anchor", "window"]).filter(F.struct("doc_id", "place") != F.col("first"))
    spans = later.select("doc_id", F.col("place").alias("low"), (F.col("place") + LENGTH).alias("high"))
    return out.unionByName(parted.mapInArrow(_spans_in_parts, SPANS)).unionByName(spans.distinct())


# The operator ------------------------------------------------------------------------------

RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts without the bytes of their spans."""
    out: list[tuple] = []
    held = 0
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]

    def rows() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names
        )

    for doc_id, text, lows, highs in _unpacked(batches, "lows", "highs"):
        data = np.frombuffer(text, np.uint8)
        change = np.zeros(len(data) + 1, np.int64)
        np.add.at(change, lows.astype(np.int64), 1)
        np.add.at(change, np.minimum(highs.astype(np.int64), len(data)), -1)
        gone = np.cumsum(change[:-1]) > 0
        runs = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        kept = data[~gone].tobytes()
        out.append((doc_id, len(data), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest(), kept))
        held += len(kept)
        if held > 1 << 20:
            yield rows()
            out, held = [], 0
    if out:
        yield rows()


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept`` of every row.

    Every byte of a text's UTF-8 that lies in a ``LENGTH``-byte string which also starts
    earlier (in a smaller id, or before in the same text; overlaps count) is removed;
    strings are judged on the input. ``kept`` holds the remaining bytes, which may cut
    characters; ``n_spans`` counts maximal removed runs.

    A null text is empty; texts under ``LENGTH`` bytes lose nothing. An id names one text:
    rows that repeat an id are the same text and get the same result, a null id counts as
    the largest. An empty table gives no rows; extra columns are ignored.

    Places are shuffled once and go by in order, none being held; sure copies stay away from
    their anchor's task. Texts are shuffled twice, packed: for the snippets to compare, and
    for the result. A text far longer than a slice is anchored in stretches.
    """
    tasks = parallelism(docs.sparkSession)
    plain = keyed(docs, "doc_id", "text").select(
        F.coalesce("doc_id", F.lit(_NULL_ID)).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")
    )
    places = plain.mapInArrow(_places, PLACES)
    ordered = places.repartition(tasks, "anchor").sortWithinPartitions("anchor", "snippet", "doc_id", "place")
    matches = scratch_table(ordered.mapInArrow(_matches, MATCHES), "matches")
    copies = matches.filter(F.col("kind") == COPY).select("doc_id", "place")
    different = matches.filter(F.col("kind") == DIFFERENT).select("anchor", "doc_id", "place")
    sizes = cut_lineage(different.groupBy("anchor").agg(F.count("*").alias("n")))
    asked = different.groupBy("doc_id").agg(F.collect_list(F.struct("anchor", "place")).alias("asked"))
    asked = asked.select("doc_id", F.col("asked.anchor").alias("anchors"), F.col("asked.place").alias("places"))
    packed = plain.mapInArrow(_pack, PACKED)
    content = packed.join(asked, "doc_id").mapInArrow(_contents, CONTENT)
    found = scratch_table(_differing(content, sizes, tasks), "spans")
    spans = found.unionByName(
        copies.select(
            "doc_id",
            F.greatest(F.col("place") - REACH, F.lit(0)).alias("low"),
            (F.col("place") + LENGTH).alias("high"),
        )
    )
    gathered = spans.groupBy("doc_id").agg(F.collect_list("low").alias("lows"), F.collect_list("high").alias("highs"))
    result = packed.join(gathered, "doc_id", "left").mapInArrow(_cut, RESULT)
    return result.withColumn("doc_id", F.nullif(F.col("doc_id"), F.lit(_NULL_ID)))
