"""Fingerprints from modular prefix polynomial hashes.

``PrefixHash`` keeps, modulo two primes, the prefix sums of ``code * base**position``. The
hash of any span is a difference of two of them, brought to position 0: spans compare in
constant time and the longest common extension of two positions is found by binary search.

A fingerprint is the text's length, the hash of the whole text, and for each of ``WIDTHS``
the smallest ``SAMPLES`` hashes of its windows of so many code points (all spans of one
prefix array). Two fingerprints estimate the Dice coefficient of two window sets, which is
near the share of unchanged text; equal texts have equal fingerprints and likeness 1. The
sets compared are those of the widest windows that the shorter text is ``WINDOWS_LONG``
times as long as, so that an edit of a short text does not touch all of its windows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelstone.llm.batches import keyed, parallelism, texts_of
from keelstone.llm.words import mixed

PRIMES = (2147483647, 2147483629)
BASES = (1000003, 999979)
#: Widths of the windows, and how many of them the shorter text must be long for a width;
#: the narrowest is for any length.
WIDTHS = (24, 6, 2)
WINDOWS_LONG = 4
SAMPLES = 64

#: Places whose powers are tabled; those of later places are a block's times one within it.
_BLOCK = 1 << 16
#: Windows of a text that are hashed at once; a longer text goes by in stretches.
STRETCH = 1 << 20


def _table(base: int, prime: int) -> np.ndarray:
    """``base ** 0 .. base ** (_BLOCK - 1)`` modulo the prime."""
    table = np.ones(1, np.uint64)
    while len(table) < _BLOCK:
        table = np.concatenate([table, table * np.uint64(pow(base, len(table), prime)) % np.uint64(prime)])
    return table


_INVERSES = tuple(pow(base, -1, prime) for base, prime in zip(BASES, PRIMES, strict=True))
_tables = {(base, prime): _table(base, prime) for k, prime in enumerate(PRIMES) for base in (BASES[k], _INVERSES[k])}


def _powers(base: int, prime: int, first: int, count: int) -> np.ndarray:
    """``base ** first .. base ** (first + count - 1)`` modulo the prime."""
    table = _tables[base, prime]
    if first + count <= _BLOCK:
        return table[first : first + count]
    out = np.empty(count, np.uint64)
    at = first
    while at < first + count:
        block, inside = divmod(at, _BLOCK)
        size = min(_BLOCK - inside, first + count - at)
        part = table[inside : inside + size] * np.uint64(pow(base, block * _BLOCK, prime))
        out[at - first : at - first + size] = _modulo(part, np.uint64(prime))
        at += size
    return out


def _modulo(values: np.ndarray, prime: np.uint64) -> np.ndarray:
    """Remainders; numpy divides by one number faster than it takes remainders."""
    return values - values // prime * prime


class PrefixHash:
    """Prefix arrays of a sequence of codes; spans are half-open."""

    def __init__(self, codes: np.ndarray) -> None:
        self.length = len(codes)
        self.sums = []
        for base, prime in zip(BASES, PRIMES, strict=True):
            p = np.uint64(prime)
            sums = np.zeros(len(codes) + 1, np.uint64)
            for at in range(0, len(codes), _BLOCK):
                part = codes[at : at + _BLOCK].astype(np.uint64) + np.uint64(1)
                terms = _modulo(part * _powers(base, prime, at, len(part)), p)
                terms[0] += sums[at]
                sums[at + 1 : at + 1 + len(part)] = _modulo(np.cumsum(terms), p)
            self.sums.append(sums)

    def span(self, start: int, end: int) -> int:
        """62-bit hash of one span."""
        out = 0
        for sums, inverse, prime in zip(self.sums, _INVERSES, PRIMES, strict=True):
            back = int(_powers(inverse, prime, start, 1)[0])
            out = out << 31 | (int(sums[end]) - int(sums[start])) * back % prime
        return out

    def windows(self, width: int, first: int = 0, most: int | None = None) -> np.ndarray:
        """Hashes of all spans of ``width`` codes, from the one at ``first`` on, or of so many."""
        count = max(0, self.length - width + 1 - first)
        count = count if most is None else min(count, most)
        out = np.zeros(count, np.uint64)
        for sums, inverse, prime in zip(self.sums, _INVERSES, PRIMES, strict=True):
            p = np.uint64(prime)
            back = _powers(inverse, prime, first, count)
            low, high = sums[first : first + count], sums[first + width : first + width + count]
            out = (out << np.uint64(31)) | _modulo((high + p - low) * back, p)
        return out

    def common(self, start: int, other: PrefixHash, there: int) -> int:
        """Longest common extension of two positions, by binary search on span equality."""
        low, high = 0, min(self.length - start, other.length - there)
        while low < high:
            middle = (low + high + 1) // 2
            if self.span(start, start + middle) == other.span(there, there + middle):
                low = middle
            else:
                high = middle - 1
        return low


def codes_of(text: str) -> np.ndarray:
    """Code points."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def smallest(values: np.ndarray, count: int = SAMPLES) -> np.ndarray:
    """The ``count`` smallest distinct values, ascending."""
    if len(values) > 8 * count:
        # Mixed values spread evenly, so about this many lie below the bound.
        few = np.unique(values[values < np.uint64((1 << 64) // len(values) * 4 * count)])
        if len(few) >= count:
            return few[:count]
    return np.unique(values)[:count]


def windows_of(prefix: PrefixHash, width: int, first: int = 0) -> np.ndarray:
    """Mixed hashes of the windows; a text shorter than a window is one window."""
    if 0 < prefix.length < width:
        return mixed(np.array([prefix.span(0, prefix.length)], np.uint64))
    return mixed(prefix.windows(width, first))


def sample(prefix: PrefixHash, width: int) -> np.ndarray:
    """The smallest hashes of the windows, a stretch of them at a time."""
    if prefix.length <= STRETCH:
        return smallest(windows_of(prefix, width))
    best = np.zeros(0, np.uint64)
    for at in range(0, prefix.length - width + 1, STRETCH):
        best = np.unique(np.concatenate([best, smallest(mixed(prefix.windows(width, at, STRETCH)))]))[:SAMPLES]
    return best


def render(length: int, whole: int, samples: list[np.ndarray]) -> str:
    """Length, whole hash and the samples of all widths as text."""
    return ":".join([f"{length}", f"{whole:016x}", *(".".join([f"{v:016x}" for v in s.tolist()]) for s in samples)])


def parse(fingerprint: str) -> tuple[int, str, list[np.ndarray]]:
    """Length, whole hash and the samples of all widths."""
    length, whole, *samples = fingerprint.split(":")
    return int(length), whole, [np.array([int(v, 16) for v in s.split(".") if v], np.uint64) for s in samples]


def likeness(a: str, b: str) -> float:
    """0 to 1: estimated Dice coefficient of the window sets; 1 for equal fingerprints."""
    if a == b:
        return 1.0
    (n, _, x), (m, _, y) = parse(a), parse(b)
    return _near(n, x, m, y)


def _near(n: int, a: list[np.ndarray], m: int, b: list[np.ndarray]) -> float:
    """Likeness of the samples of two texts by the widest windows that suit the shorter one."""
    fits = (k for k, width in enumerate(WIDTHS) if min(n, m) >= WINDOWS_LONG * width)
    k = next(fits, len(WIDTHS) - 1)
    return _dice(a[k], b[k])


def _dice(a: np.ndarray, b: np.ndarray) -> float:
    both = np.union1d(a, b)[:SAMPLES]
    if not len(a) or not len(b):
        return 0.0
    shared = len(np.intersect1d(np.intersect1d(a, b), both))
    jaccard = shared / len(both)
    return 2 * jaccard / (1 + jaccard)


def fingerprint(text: str | None) -> str:
    """Fingerprint of a text; null is empty."""
    prefix = PrefixHash(codes_of(text or ""))
    samples = [sample(prefix, width) for width in WIDTHS]
    return render(prefix.length, prefix.span(0, prefix.length), samples)


class _Text:
    """A document on its way through a range."""

    def __init__(self, doc_id, text: str) -> None:
        self.doc_id, self.codes = doc_id, codes_of(text)
        self.prefix = PrefixHash(self.codes)
        # Kept for the edited text; a very long text is hashed again instead.
        self.windows = [windows_of(self.prefix, width) for width in WIDTHS] if len(self.codes) <= STRETCH else []
        self.samples = [smallest(w) for w in self.windows] or [sample(self.prefix, width) for width in WIDTHS]
        self.print = render(self.prefix.length, self.prefix.span(0, self.prefix.length), self.samples)

    def edited_by(self, following: _Text) -> tuple:
        """The row of this document; windows before the edit are not hashed again."""
        n = len(self.codes)
        cut = n - n // 3
        edited = np.concatenate([self.codes[:cut], following.codes[: n // 3]])
        whole = PrefixHash(edited)
        samples = [] if self.windows else [sample(whole, width) for width in WIDTHS]
        for width, windows in zip(WIDTHS, self.windows, strict=False):
            kept = max(0, cut - width + 1)
            samples.append(smallest(np.concatenate([windows[:kept], windows_of(whole, width, kept)])))
        edited_print = render(len(edited), whole.span(0, len(edited)), samples)
        text = edited.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")
        return (
            self.doc_id,
            n,
            hashlib.sha256(text).hexdigest(),
            self.print,
            edited_print,
            1.0 if edited_print == self.print else _near(n, self.samples, len(edited), samples),
            1.0 if following.print == self.print else _near(n, self.samples, len(following.codes), following.samples),
            self.prefix.common(0, whole, 0),
        )


RESULT = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
    "edited_fingerprint string, near_edited double, near_next double, common_prefix long"
)


def _rows_with_next(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of whole ranges in order; a range's last row is only the next one of the row before."""
    schema = pa.schema(
        [("doc_id", pa.int64()), ("n_chars", pa.int64())]
        + [(n, pa.string()) for n in ("edited_sha256", "fingerprint", "edited_fingerprint")]
        + [("near_edited", pa.float64()), ("near_next", pa.float64()), ("common_prefix", pa.int64())]
    )
    waiting, place = None, None
    for batch in batches:
        out = []
        texts = texts_of(batch.column("text"))
        for i, (bucket, extra, doc_id) in enumerate(
            zip(*(batch.column(c).to_pylist() for c in ("_range", "_extra", "doc_id")), strict=True)
        ):
            if extra and (waiting is None or place != bucket):
                continue  # further copies of the row that closed the range
            if place != bucket:
                waiting = None
            current = _Text(doc_id, texts[i].as_py())
            if waiting is not None:
                out.append(waiting.edited_by(current))
            waiting, place = (None if extra else current), bucket
            if len(out) >= 1024:
                yield pa.RecordBatch.from_pydict(_columns(out, schema), schema)
                out = []
        if out:
            yield pa.RecordBatch.from_pydict(_columns(out, schema), schema)


def _columns(rows: list[tuple], schema: pa.Schema) -> dict:
    return dict(zip(schema.names, map(list, zip(*rows, strict=True)), strict=True))


def _heads(plain: DataFrame, ranges: int) -> np.ndarray:
    """The highest key of every range, ascending: one for each shuffle partition at most.

    Keys alone are range-partitioned, so what comes here depends on the cluster, not on the
    number of documents.
    """
    key = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63))).alias("_key")
    ranged = plain.select(key).repartitionByRange(ranges, "_key")
    found = ranged.groupBy(F.spark_partition_id().alias("_p")).agg(F.max("_key").alias("head")).toArrow()
    return np.sort(found.column("head").to_numpy())


def fingerprint_edits(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """Per document: fingerprints of its text and of its edited text, and their likenesses.

    The edited text has its last ``floor(n / 3)`` code points replaced by the first as many
    (or all) of the next document in descending ``doc_id``; the last one's next is the
    first. ``common_prefix`` is the longest common extension of both texts from 0.

    Null and empty texts have length 0 and an empty sample; null keys come last, repeated
    keys stand in the order of their texts; a single row is its own next; an empty table
    gives no rows. Extra columns are ignored.

    Keys are cut into ranges, as many as the session has shuffle partitions, whose borders
    are keys themselves, so each range needs one more row, the head of the range after it.
    A range streams through its task. Texts are shuffled once.
    """
    spark = docs.sparkSession
    plain = keyed(docs, "doc_id", "text")
    # heads[k] is the highest key of range k; the ranges descend.
    heads = _heads(plain, ranges or parallelism(spark))[::-1].copy()
    if not len(heads):
        return spark.createDataFrame([], RESULT)
    last = len(heads) - 1

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ascending = heads[::-1]
        for batch in batches:
            ids = batch.column("doc_id").fill_null(-(1 << 63)).to_numpy(zero_copy_only=False)
            own = last - np.searchsorted(ascending, ids, "left")
            rows = np.flatnonzero(heads[own] == ids)
            before = np.where(own[rows] == 0, last, own[rows] - 1)
            at = np.concatenate([np.arange(len(ids)), rows])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([own, before]).astype(np.int32)),
                    pa.array(np.arange(len(at)) >= len(ids)),
                    batch.column("doc_id").take(pa.array(at)),
                    batch.column("text").take(pa.array(at)),
                ],
                names=["_range", "_extra", "doc_id", "text"],
            )

    dealt = plain.mapInArrow(deal, "_range int, _extra boolean, doc_id long, text string")
    order = ["_range", "_extra", F.col("doc_id").desc_nulls_last(), "text"]
    ranged = dealt.repartitionById(len(heads), F.col("_range")).sortWithinPartitions(*order)
    return ranged.mapInArrow(_rows_with_next, RESULT)
