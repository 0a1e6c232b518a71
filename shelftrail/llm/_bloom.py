"""A Bloom filter of bounded size, built by Spark in segments and probed in numpy.

Hashes fall into segments by their top bits; a segment's bits are set in one task, a batch at a time, so building needs
memory for the segments of one partition only. The whole filter never exceeds `max_bits`, which is what makes it safe to
broadcast; more hashes than it was sized for raise its false positives, which callers settle exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..shipping import map_arrow

SEGMENT_BITS = 1 << 16
PROBES = 4
BITS_PER_HASH = 16
#: 64 MiB.
MAX_BITS = 1 << 29


def segments_for(hashes: int, max_bits: int = MAX_BITS) -> int:
    wanted = max(1, -(-hashes * BITS_PER_HASH // SEGMENT_BITS))
    return min(1 << (wanted - 1).bit_length(), max(1, max_bits // SEGMENT_BITS))


def _places(h: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Segment of each hash (from its top bits) and its `PROBES` bits inside it."""
    u = h.view(np.uint64) if h.dtype == np.int64 else h.astype(np.uint64)
    segment = ((u >> np.uint64(40)) % np.uint64(segments)).astype(np.int64)
    mixed = (u ^ (u >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    shifts = np.arange(PROBES, dtype=np.uint64) * np.uint64(16)
    return segment, ((mixed[:, None] >> shifts) % np.uint64(SEGMENT_BITS)).astype(np.int64)


def _hits(plane: np.ndarray, rows: np.ndarray, bits: np.ndarray) -> np.ndarray:
    return ((plane[rows[:, None], bits >> 3] >> (bits & 7).astype(np.uint8)) & 1).all(axis=1)


def _set(plane: np.ndarray, rows: np.ndarray, bits: np.ndarray) -> None:
    at = (np.repeat(rows, PROBES), (bits >> 3).ravel())
    np.bitwise_or.at(plane, at, np.left_shift(np.uint8(1), (bits & 7).astype(np.uint8)).ravel())


def contains(plane: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes may be in the filter."""
    return _hits(plane, *_places(hashes, len(plane)))


def build(hashes: DataFrame, segments: int, repeated: bool = False) -> np.ndarray:
    """The filter of column `h`, as (segments, SEGMENT_BITS / 8) bytes; if `repeated`, only of hashes seen before.

    The latter keeps two planes: every hash goes into the first, and what the first already had into the second.
    """

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:  # a hash that is frequent here leaves this task once a batch
            h, n = np.unique(b.column(0).to_numpy(zero_copy_only=False), return_counts=True)
            if len(h):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(_places(h, segments)[0].astype(np.int32)), pa.array(h), pa.array(n > 1)], names=["segment", "h", "again"]
                )

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place: dict[int, int] = {}
        first = second = np.zeros((0, SEGMENT_BITS // 8), np.uint8)
        for b in batches:
            seg, all_h = b.column(0).to_numpy(), b.column(1).to_numpy()
            new = [s for s in np.unique(seg).tolist() if s not in place]
            place.update(zip(new, range(len(place), len(place) + len(new)), strict=True))
            if new:
                more = np.zeros((len(new), SEGMENT_BITS // 8), np.uint8)
                first, second = np.vstack([first, more]), np.vstack([second, more])
            h, at, n = np.unique(all_h, return_index=True, return_counts=True)
            again = np.zeros(len(h), bool)
            np.logical_or.at(again, np.searchsorted(h, all_h), b.column(2).to_numpy(zero_copy_only=False))
            rows = np.array([place[s] for s in seg[at].tolist()], dtype=np.int64)
            bits = _places(h, segments)[1]
            if repeated:
                seen = again | (n > 1) | _hits(first, rows, bits)
                _set(second, rows[seen], bits[seen])
            _set(first, rows, bits)
        out = second if repeated else first
        full = [s for s, i in place.items() if out[i].any()]
        if full:
            yield pa.RecordBatch.from_arrays(
                [pa.array(full, pa.int32()), pa.array([out[place[s]].tobytes() for s in full], pa.binary())], names=["segment", "plane"]
            )

    spread = map_arrow(hashes.select("h"), combine, "segment int, h long, again boolean").repartition("segment")
    plane = np.zeros((segments, SEGMENT_BITS // 8), np.uint8)
    for row in map_arrow(spread, fill, "segment int, plane binary").toLocalIterator():  # each segment once: at most max_bits in all
        plane[row.segment] |= np.frombuffer(row.plane, np.uint8)
    return plane
