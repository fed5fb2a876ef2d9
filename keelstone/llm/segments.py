"""Ids of whole texts from the ids of their distinct segments.

A segment is a stretch of text that a tokenizer encodes independently of its neighbours.
Natural text repeats its segments, so each distinct one of a slice is encoded once, and the
first ``limit`` of a worker are kept for later slices: some 30 MB, whatever the texts are.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from keelstone.llm.batches import ragged, tidy

#: Flat ids of several segments, and how many each has.
Encoded = tuple[np.ndarray, np.ndarray]


#: Text bytes whose segments are looked up together: a look-up costs a pass over the table.
LOOKUP_BYTES = 3 << 20


class SegmentTable:
    """Memory is bounded by ``limit`` segments, each of at most ``longest`` bytes."""

    def __init__(
        self, encode: Callable[[pa.LargeStringArray], Encoded], limit: int = 1_000_000, longest: int = 64
    ) -> None:
        self.encode, self.limit, self.longest = encode, limit, longest
        self.known = pa.array([], pa.large_string())
        self.flat, self.counts = np.zeros(0, np.uint32), np.zeros(0, np.int32)

    def ids(self, data: np.ndarray, bounds: np.ndarray) -> Encoded:
        """Ids of the segments between consecutive ``bounds`` of UTF-8 ``data``.

        A very long text is looked up in stretches of whole segments.
        """
        if len(bounds) < 2:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        if bounds[-1] - bounds[0] > 2 * LOOKUP_BYTES:
            cuts = np.unique(np.searchsorted(bounds, np.arange(bounds[0], bounds[-1], LOOKUP_BYTES), "right") - 1)
            cuts = np.r_[cuts, len(bounds) - 1]
            if len(cuts) > 2:
                parts = []
                for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                    low, high = int(bounds[a]), int(bounds[b])
                    parts.append(self.ids(data[low:high], bounds[a : b + 1] - low))
                    tidy()
                flat, counts = zip(*parts, strict=True)
                return np.concatenate(flat), np.concatenate(counts)
        segments = pa.LargeStringArray.from_buffers(
            len(bounds) - 1,
            pa.py_buffer(np.ascontiguousarray(bounds, np.int64)),
            pa.py_buffer(np.ascontiguousarray(data)),
        )
        coded = segments.dictionary_encode()
        distinct = coded.dictionary
        hit = pc.index_in(distinct, value_set=self.known).fill_null(-1).to_numpy(zero_copy_only=False)
        missing = np.flatnonzero(hit < 0)
        fresh = distinct.take(pa.array(missing))
        new_flat, new_counts = self.encode(fresh)
        flat = np.concatenate([self.flat, new_flat])
        all_counts = np.concatenate([self.counts, new_counts.astype(np.int32)])
        all_starts = np.cumsum(all_counts, dtype=np.int64) - all_counts
        place = hit.astype(np.int64)
        place[missing] = len(self.counts) + np.arange(len(missing))
        self._keep(fresh, new_flat, new_counts)
        used = place[coded.indices.to_numpy(zero_copy_only=False)]
        counts = all_counts[used]
        return flat[ragged(all_starts[used], counts)], counts.astype(np.int64)

    def _keep(self, fresh: pa.LargeStringArray, flat: np.ndarray, counts: np.ndarray) -> None:
        room = self.limit - len(self.known)
        if room <= 0 or not len(fresh):
            return
        short = np.flatnonzero(pc.binary_length(fresh).to_numpy(zero_copy_only=False) <= self.longest)
        short = short[:room]
        starts = np.cumsum(counts) - counts
        self.flat = np.concatenate([self.flat, flat[ragged(starts[short], counts[short])]])
        self.counts = np.concatenate([self.counts, counts[short].astype(np.int32)])
        self.known = pa.concat_arrays([self.known, fresh.take(pa.array(short))])


def per_text(counts: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Offsets of every text's ids, from its segments' counts and its first segments."""
    sums = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts, out=sums[1:])
    return sums[first]
