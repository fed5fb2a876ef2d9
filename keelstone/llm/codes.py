"""Codes for vectors: every part of a vector becomes the number of its codebook's nearest entry.

Components are whole numbers, ``floor(scale * x)``, so that sums and distances are exact
whatever the order they are taken in. A codebook starts as that part of the vectors with the
smallest ids and moves in rounds: parts are assigned, entries become their parts' means.

The nearest entry is found by equal-average search. By Cauchy's inequality the squared
distance of two vectors of ``d`` components is at least the squared difference of their
component sums over ``d``. Entries are sorted by their sums; from the place of a part's own
sum the search goes outward, the closer sum first, and ends when the squared gap over ``d``
exceeds the best distance so far: strictly, as an entry at that very distance may still have
a lower number.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelstone.llm.batches import keyed, scratch_table
from keelstone.operators.joins import fits_broadcast

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
#: Vector components that one step of numpy work takes at once.
STEP = 1 << 20
#: Components below this, in parts of up to so many, keep all that is compared within 64 bits.
SMALL = 1 << 20
SMALL_WIDTH = 1 << 8
#: Components beyond this would not keep distances within 38 digits.
LARGEST = 1 << 56
LONGEST = (1 << 63) - 1


@dataclass(frozen=True)
class Codebooks:
    """Entries by part, entry and position, as whole numbers."""

    entries: np.ndarray

    def digest(self) -> str:
        """SHA-256 of all components as decimals, joined by commas."""
        return hashlib.sha256(",".join(map(str, self.entries.reshape(-1).tolist())).encode()).hexdigest()


def exact(values: np.ndarray) -> np.ndarray:
    """64-bit numbers where nothing that is compared can exceed them, else Python's own."""
    small = values.shape[-1] <= SMALL_WIDTH and not (np.abs(values) >= SMALL).any()
    return values.astype(np.int64) if small else values.astype(object)


def whole_numbers(vectors: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """``floor(scale * x)`` of finite components."""
    scaled = np.floor(vectors.astype(np.float64) * scale)
    if np.abs(scaled).max(initial=0) >= LARGEST:
        raise ValueError("a vector component beyond 56 bits")
    return scaled.astype(np.int64)


def nearest(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest entry of each part and its squared distance; ties to the lower number."""
    width = entries.shape[1]
    kind = np.result_type(parts, entries)
    parts, entries = parts.astype(kind), entries.astype(kind)
    sums = entries.sum(axis=1) if width else np.zeros(len(entries), kind)
    order = np.argsort(sums, kind="stable")
    ranked, own = sums[order], parts.sum(axis=1) if width else np.zeros(len(parts), kind)
    up = np.searchsorted(ranked, own)
    down = up - 1
    best = np.full(len(parts), -1, np.int64)
    distance = np.zeros(len(parts), kind)
    open_ = np.arange(len(parts))
    while len(open_):
        has_down, has_up = down[open_] >= 0, up[open_] < len(order)
        gap_down = own[open_] - ranked[np.maximum(down[open_], 0)]
        gap_up = ranked[np.minimum(up[open_], len(order) - 1)] - own[open_]
        take_up = has_up & (~has_down | (gap_up < gap_down))
        gap = np.where(take_up, gap_up, gap_down)
        # Every entry left has a gap at least as wide.
        go = (has_down | has_up) & ((best[open_] < 0) | (gap * gap <= distance[open_] * max(width, 1)))
        open_, take_up = open_[go], take_up[go]
        if not len(open_):
            break
        at = np.where(take_up, up[open_], down[open_])
        up[open_[take_up]] += 1
        down[open_[~take_up]] -= 1
        entry = order[at]
        found = ((parts[open_] - entries[entry]) ** 2).sum(axis=1) if width else np.zeros(len(open_), kind)
        known = best[open_] >= 0
        better = ~known | (found < distance[open_]) | ((found == distance[open_]) & (entry < best[open_]))
        best[open_[better]], distance[open_[better]] = entry[better], found[better]
    return best, distance


def _usable(vectors: pa.Array) -> np.ndarray:
    """Rows with a vector whose components are all there and finite."""
    usable = pc.is_valid(vectors).to_numpy(zero_copy_only=False).copy()
    flat = vectors.flatten()
    bad = ~pc.fill_null(pc.is_finite(flat), False).to_numpy(zero_copy_only=False)
    owner = pc.list_parent_indices(vectors).to_numpy(zero_copy_only=False)
    usable[owner[bad]] = False
    return usable


def _steps(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Rows with a usable vector of ``dim`` components, and these as whole numbers."""
    for batch in batches:
        vectors = batch.column("embedding")
        if pa.types.is_fixed_size_list(vectors.type):
            vectors = vectors.cast(pa.list_(vectors.type.value_type))
        fits = _usable(vectors) & (pc.fill_null(pc.list_value_length(vectors), -1).to_numpy(zero_copy_only=False) == dim)
        kept = batch.filter(pa.array(fits))
        vectors = vectors.filter(pa.array(fits))
        rows = max(1, STEP // max(dim, 1))
        for at in range(0, len(kept), rows):
            part = vectors.slice(at, rows)
            flat = part.flatten().to_numpy(zero_copy_only=False).reshape(len(part), dim)
            yield kept.slice(at, rows), whole_numbers(flat)


def _parts(whole: np.ndarray, books: Codebooks) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For every part its number, the rows' parts and the entries, in numbers that hold distances."""
    count, _, width = books.entries.shape
    for p in range(count):
        part, entries = exact(whole[:, p * width : (p + 1) * width]), exact(books.entries[p])
        if part.dtype != entries.dtype:
            part, entries = part.astype(object), entries.astype(object)
        yield p, part, entries


SUMS = "part int, entry int, place int, total decimal(38,0), n long"


def _moved(rows: DataFrame, books: Codebooks) -> Codebooks:
    """Entries replaced by the floors of their parts' means; unused ones stay.

    A task sums up its own parts, so one row for each component and task is shuffled, and
    one for each component of the codebooks comes to the driver.
    """
    shared = rows.sparkSession.sparkContext.broadcast(books)
    dim = books.entries.shape[0] * books.entries.shape[2]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        parts, size, width = own.entries.shape
        total, count = np.zeros((parts, size, width), object), np.zeros((parts, size), np.int64)
        for _, whole in _steps(batches, dim):
            for p, part, entries in _parts(whole, own):
                best, _ = nearest(part, entries)
                count[p] += np.bincount(best, minlength=size)
                step = np.zeros((size, width), part.dtype)
                np.add.at(step, best, part)
                total[p] += step.astype(object)
        part, entry = np.nonzero(count)
        at = [np.repeat(x, width) for x in (part, entry)] + [np.tile(np.arange(width), len(part))]
        yield pa.RecordBatch.from_arrays(
            [
                *(pa.array(x.astype(np.int32)) for x in at),
                pa.array([str(x) for x in total[part, entry].reshape(-1).tolist()], pa.string()).cast(pa.decimal128(38, 0)),
                pa.array(np.repeat(count[part, entry], width)),
            ],
            names=["part", "entry", "place", "total", "n"],
        )

    found = rows.mapInArrow(sums, SUMS).groupBy("part", "entry", "place")
    entries = books.entries.astype(object).copy()
    for r in found.agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect():
        entries[r.part, r.entry, r.place] = int(r.total) // r.n
    return Codebooks(exact(entries))


def fit(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks | None:
    """Codebooks after some rounds over all rows; None where no vector is usable.

    They start as the parts of the ``entries`` smallest ids, so there are fewer entries where
    there are fewer usable rows. A null id counts as the largest; rows that share an id are
    taken in the order of their vectors. The vector of the smallest id says how many
    components there are; the number of parts must divide it. Vectors of other lengths have
    no part in the codebooks.
    """
    rows = keyed(vectors, "vec_id", "embedding")
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    kept = rows.filter(F.col("embedding").isNotNull() & finite).orderBy(F.col("vec_id").asc_nulls_last(), "embedding")
    first = kept.limit(entries).collect()
    if not first:
        return None
    dim = len(first[0].embedding)
    if dim % parts:
        raise ValueError(f"{dim} components do not make {parts} equal parts")
    if any(len(r.embedding) != dim for r in first):
        first = kept.filter(F.size("embedding") == dim).limit(entries).collect()
    held = np.array([r.embedding for r in first], np.float64).reshape(-1, dim)
    whole_start = whole_numbers(held).reshape(len(held), parts, dim // parts)
    books = Codebooks(exact(np.ascontiguousarray(whole_start.swapaxes(0, 1))))
    for _ in range(rounds):
        books = _moved(rows, books)
    return books


def encode(vectors: DataFrame, books: Codebooks) -> DataFrame:
    """``vec_id, label, code, error`` of every usable vector of the codebooks' length.

    ``code`` has two hex digits a part; ``error`` is the squared distance of the vector to
    its code, exact up to 38 digits.
    """
    shared = vectors.sparkSession.sparkContext.broadcast(books)
    parts, _, width = books.entries.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch, whole in _steps(batches, parts * width):
            code = np.zeros((len(whole), parts), np.uint8)
            error = np.zeros(len(whole), object)
            for p, part, entries in _parts(whole, own):
                code[:, p], distance = nearest(part, entries)
                error += distance.astype(object)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id"),
                    batch.column("label"),
                    pa.array([row.tobytes().hex() for row in code], pa.string()),
                    pa.array([str(x) for x in error.tolist()], pa.string()).cast(pa.decimal128(38, 0)),
                ],
                names=["vec_id", "label", "code", "error"],
            )

    rows = keyed(vectors, "vec_id", "label", "embedding")
    label = rows.schema["label"].dataType.simpleString()
    return rows.mapInArrow(run, f"vec_id long, label {label}, code string, error decimal(38,0)")


def _long(value: F.Column) -> F.Column:
    return F.when(F.abs(value) <= F.lit(LONGEST), value).cast("long")


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256`` of every usable vector.

    Rows are left out where the vector is null, or a component is null or not finite, or its
    length is not that of the smallest id's vector. ``label_error`` sums up the errors of
    equal labels, null ones together. An error that is more than a long holds is null.
    Repeated rows stay and count each; an empty table, or one without a usable vector, gives
    no rows; extra columns are ignored.

    Errors by label are summed before they are shuffled. They are joined by broadcast if
    their measured size allows it, else by a shuffle, where adaptive execution splits a hot
    label.
    """
    books = fit(vectors, parts, entries, rounds)
    if books is None:
        empty = "vec_id long, code string, error long, label_error long, codebooks_sha256 string"
        return vectors.sparkSession.createDataFrame([], empty)
    coded = scratch_table(encode(vectors, books), "codes")
    sums = coded.groupBy("label").agg(F.try_sum("error").alias("_sum"))
    sums = scratch_table(sums.withColumnRenamed("label", "_label"), "label-errors")
    side = F.broadcast(sums) if fits_broadcast(sums) else sums
    joined = coded.join(side, F.col("label").eqNullSafe(F.col("_label")))
    return joined.select(
        "vec_id",
        "code",
        _long(F.col("error")).alias("error"),
        _long(F.col("_sum")).alias("label_error"),
        F.lit(books.digest()).alias("codebooks_sha256"),
    )


def _oracle_near(books: str, name: str) -> str:
    """The nearest entry of every part, in DuckDB."""
    return f"""{name} AS MATERIALIZED (
    SELECT vec_id, part, arg_min(entry, d * 64 + entry) AS entry, min(d) AS d FROM (
        SELECT p.vec_id, p.part, b.entry, sum((p.v - b.v) * (p.v - b.v)) AS d
        FROM numbers p JOIN {books} b ON p.part = b.part AND p.place = b.place
        GROUP BY p.vec_id, p.part, b.entry) GROUP BY vec_id, part
)"""


def _oracle_moved(books: str, near: str, name: str) -> str:
    """Entries moved to the floors of their parts' means."""
    return f"""{name} AS MATERIALIZED (
    SELECT b.part, b.entry, b.place, coalesce(m.v, b.v) AS v FROM {books} b LEFT JOIN (
        SELECT part, entry, place, s // n - (CASE WHEN s % n < 0 THEN 1 ELSE 0 END) AS v FROM (
            SELECT n.part, n.entry, p.place, CAST(sum(p.v) AS HUGEINT) AS s, count(*) AS n
            FROM {near} n JOIN numbers p ON p.vec_id = n.vec_id AND p.part = n.part
            GROUP BY n.part, n.entry, p.place)) m
    ON m.part = b.part AND m.entry = b.entry AND m.place = b.place
)"""


#: The same rows in DuckDB, for ids that are there and differ.
ORACLE = f"""
WITH kept AS MATERIALIZED (
    SELECT vec_id, label, embedding FROM embeddings WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), numbers AS MATERIALIZED (
    SELECT vec_id, CAST((i - 1) // (len(embedding) // 16) AS INTEGER) AS part,
           CAST((i - 1) % (len(embedding) // 16) AS INTEGER) AS place,
           CAST(floor(256 * CAST(embedding[i] AS DOUBLE)) AS HUGEINT) AS v
    FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM kept)
), b0 AS MATERIALIZED (
    SELECT n.part, s.entry, n.place, n.v FROM numbers n JOIN (
        SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept ORDER BY vec_id LIMIT 64) s
    ON s.vec_id = n.vec_id
), {_oracle_near("b0", "n0")}, {_oracle_moved("b0", "n0", "b1")},
{_oracle_near("b1", "n1")}, {_oracle_moved("b1", "n1", "b2")}, {_oracle_near("b2", "n2")},
coded AS (
    SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error
    FROM n2 GROUP BY vec_id
), digest AS (
    SELECT sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY part, entry, place)) AS codebooks_sha256 FROM b2
)
SELECT c.vec_id, c.code, c.error, CAST(sum(c.error) OVER (PARTITION BY k.label) AS BIGINT) AS label_error, d.codebooks_sha256
FROM coded c JOIN kept k ON k.vec_id = c.vec_id CROSS JOIN digest d"""
