"""Near-duplicate classes: banded MinHash, odd sketches, full shingle sets.

A document's MinHash samples are cut into bands; documents that agree in a whole band share
a bucket. The samples are also folded into an odd sketch, a bitmap in which sample ``i`` with
value ``v`` flips the bit ``h(i, v)``: samples that two documents share cancel out in the XOR
of their sketches, so its population count tells how many differ, and with that the
similarity, most precisely where it is high.

Within a bucket, sketches decide which documents may be similar; these form coarse classes.
Within a coarse class the full shingle sets decide, by counting along posting lists. Both
steps return links that connect what is similar and never all pairs, and both cut groups
that are too large for a task (see ``components.group_links``). Documents with equal sets
are one document from the start.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelstone.llm.batches import keyed, ragged, scratch_table, slices
from keelstone.llm.components import components, group_links
from keelstone.llm.words import mixed, shingle_sets
from keelstone.session import cut_lineage

WIDTH = 5
#: Link: ``100 * intersection >= PERCENT * union``.
PERCENT = 75
#: At similarity 0.75 a pair shares no bucket with probability (1 - 0.75**4)**40 = 3e-7.
BANDS, ROWS = 40, 4
SKETCH_BITS = 512
#: Sketches that say less than this cannot be similar: at 0.75 samples and sketch together
#: have a standard deviation of 0.044, so the bound is 5.6 of them away.
SKETCH_LEAST = 0.5
#: Bounds of a task: rows of a bucket, shingles of a coarse class.
BUCKET_ROWS = 4096
CLASS_SHINGLES = 2_000_000
_BLOCK = 32_768

_random = np.random.default_rng(20140402)
_FACTORS = _random.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = _random.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def samples(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """MinHash samples of the sets ``hashes[first[i]:first[i + 1]]``; empty sets get the largest value."""
    count = len(first) - 1
    out = np.full((len(_FACTORS), count), np.iinfo(np.uint32).max, np.uint32)
    at = 0
    while at < count:
        to = min(max(int(np.searchsorted(first, first[at] + _BLOCK, "right")) - 1, at + 1), count)
        own = hashes[first[at] : first[to]]
        filled = at + np.flatnonzero(np.diff(first[at : to + 1]))
        if len(own):
            starts = first[filled] - first[at]
            work = np.empty_like(own)
            for k in range(len(_FACTORS)):
                np.multiply(own, _FACTORS[k], out=work)
                work += _SHIFTS[k]
                out[k, filled] = np.minimum.reduceat(work, starts) >> np.uint64(32)
        at = to
    return out.T


def band_keys(values: np.ndarray) -> np.ndarray:
    """A 64-bit key of every band, different for different bands."""
    parts = values.reshape(len(values), BANDS, ROWS).astype(np.uint64)
    keys = np.arange(1, BANDS + 1, dtype=np.uint64)[None, :].repeat(len(values), 0)
    for k in range(ROWS):
        keys = mixed(keys * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, k])
    return keys


def odd_sketches(values: np.ndarray, bits: int = SKETCH_BITS) -> np.ndarray:
    """Parity bitmaps of samples, a row of ``bits / 8`` bytes each."""
    place = np.arange(values.shape[1], dtype=np.uint64) << np.uint64(32)
    flips = (mixed(place[None, :] + values.astype(np.uint64)) % np.uint64(bits)).astype(np.int64)
    flips += np.arange(len(values))[:, None] * bits
    odd = np.bincount(flips.ravel(), minlength=len(values) * bits) & 1
    return np.packbits(odd.reshape(-1, bits).astype(np.uint8), axis=1)


def estimate(differing: np.ndarray, bits: int = SKETCH_BITS, count: int = BANDS * ROWS) -> np.ndarray:
    """Similarity from the population count of the XOR of two sketches."""
    share = np.minimum(2 * np.asarray(differing, float) / bits, 1 - 1e-9)
    return 1 + bits / (4 * count) * np.log1p(-share)


def _most_differing() -> int:
    counts = np.arange(SKETCH_BITS + 1)
    return int(counts[estimate(counts) >= SKETCH_LEAST].max())


def sketch_index(sketches: list[bytes]) -> Callable[[int], np.ndarray]:
    """Rows whose sketches may belong to similar sets."""
    table = np.frombuffer(b"".join(sketches), np.uint64).reshape(len(sketches), -1)
    most = _most_differing()
    return lambda q: np.flatnonzero(np.bitwise_count(table ^ table[q]).sum(1, dtype=np.int64) <= most)


def set_index(texts: list[str], percent: int = PERCENT) -> Callable[[int], np.ndarray]:
    """Rows whose full shingle sets are similar, by counting along posting lists."""
    hashes, first = shingle_sets(pa.array(texts, pa.large_string()), WIDTH)
    sizes = np.diff(first)
    _, code = np.unique(hashes, return_inverse=True)
    owner = np.repeat(np.arange(len(sizes)), sizes)[np.argsort(code, kind="stable")]
    begin = np.r_[0, np.cumsum(np.bincount(code))] if len(code) else np.zeros(1, np.int64)

    def similar(q: int) -> np.ndarray:
        own = code[first[q] : first[q + 1]]
        common = np.bincount(owner[ragged(begin[own], begin[own + 1] - begin[own])], minlength=len(sizes))
        return np.flatnonzero((100 * common >= percent * (sizes[q] + sizes - common)) & (common > 0))

    return similar


SIGNED = "doc_id long, n_shingles long, digest binary, bands array<long>, sketch binary"


def signed(docs: DataFrame) -> DataFrame:
    """Set size, set digest, band keys and odd sketch of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            hashes, first = shingle_sets(batch.column("text"), WIDTH)
            values = samples(hashes, first)
            keys = band_keys(values).view(np.int64)
            data, cut = hashes.tobytes(), (8 * first).tolist()
            digests = [hashlib.blake2b(data[a:b], digest_size=16).digest() for a, b in zip(cut[:-1], cut[1:], strict=True)]
            offsets = pa.array(np.arange(0, keys.size + 1, BANDS, dtype=np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(np.diff(first).astype(np.int64)),
                    pa.array(digests, pa.binary()),
                    pa.ListArray.from_arrays(offsets, pa.array(keys.ravel())),
                    pa.array([s.tobytes() for s in odd_sketches(values)], pa.binary()),
                ],
                names=["doc_id", "n_shingles", "digest", "bands", "sketch"],
            )

    return keyed(docs, "doc_id", "text").mapInArrow(run, SIGNED)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row.

    Words are lower-cased in A-Z; a text with fewer than five words is one shingle. Texts
    without words (null ones too) are linked with nothing. ``component_id`` is the smallest
    id reachable over links, the row's own included; ``kept`` marks the row that bears it.
    An id names one text: repeated rows get the same class; rows that repeat an id with
    another text get the class of their own text, and both classes are one where that id is
    the smallest of both. A null id is linked with nothing, has no component and is kept. An
    empty table gives no rows; extra columns are ignored.
    """
    signs = scratch_table(signed(docs), "signs")
    linkable = signs.filter("doc_id IS NOT NULL AND n_shingles > 0")
    # One document of each set: copies need no sketch and no comparison.
    firsts = linkable.groupBy("digest").agg(F.min("doc_id").alias("first"))
    one = linkable.select("doc_id", "digest", "n_shingles", "bands", "sketch").join(
        firsts.select(F.col("first").alias("doc_id"), "digest"), ["doc_id", "digest"]
    )
    one = one.dropDuplicates(["digest"])
    keys = one.select("doc_id", F.explode("bands").alias("group"))
    shared = keys.groupBy("group").agg(F.count("*").alias("n")).filter("n > 1").select("group")
    members = cut_lineage(keys.join(shared, "group"))
    sketched = members.join(one.select("doc_id", "sketch"), "doc_id").select(
        "group", F.col("doc_id").alias("id"), "sketch", F.lit(1).alias("weight")
    )
    coarse = cut_lineage(components(group_links(sketched, "sketch", "weight", BUCKET_ROWS, sketch_index)))
    # Full sets of the documents that may have a link, computed from their texts.
    candidates = coarse.join(one.select(F.col("doc_id").alias("id"), "n_shingles"), "id")
    texts = keyed(docs, "doc_id", "text").withColumnRenamed("doc_id", "id")
    compared = candidates.join(texts, "id").select(
        F.col("component").alias("group"), "id", "text", F.col("n_shingles").alias("weight")
    )
    links = group_links(compared, "text", "weight", CLASS_SHINGLES, set_index)
    found = components(links).withColumnRenamed("component", "linked")
    per_set = firsts.join(found, F.col("first") == F.col("id"), "left").select(
        "digest", F.coalesce("linked", "first").alias("component")
    )
    joined = signs.select("doc_id", "n_shingles", "digest").join(per_set, "digest", "left")
    component = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("component")).otherwise(F.col("doc_id"))
    return joined.select(
        "doc_id",
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"),
    )


def without_near_duplicates(docs: DataFrame) -> DataFrame:
    """One document of each near-duplicate class, the one with the smallest id, all columns kept.

    Of rows that repeat an id one stays; rows without an id all stay.
    """
    kept = near_duplicates(docs).filter("kept AND doc_id IS NOT NULL").select("doc_id").distinct()
    named = docs.filter(F.col("doc_id").isNotNull()).join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return named.unionByName(docs.filter(F.col("doc_id").isNull())).select(*docs.columns)
