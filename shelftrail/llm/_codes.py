"""One-bit codes of randomly rotated vectors, and inner products estimated from them by counting bits.

A vector's code is the signs of its rotated entries, packed into 64-bit words; as a unit vector it is sign / sqrt(d). Beside
the code stand the vector's length and its alignment, the inner product of the code with the rotated unit vector. A query
is rotated too and rounded to `BITS` bits an entry, cut into bit planes: its inner product with a code is a sum of popcounts.
What rounding costs is bounded by the sum of the rounding errors over sqrt(d).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BITS = 6
SEED = 20_240_521
#: Room for rounding in floating point, of the product of two lengths.
SLACK = 1e-9


def rotation(d: int, seed: int = SEED) -> np.ndarray:
    """A random orthogonal matrix, the same for the same dimension and seed."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def _pack(bits: np.ndarray) -> np.ndarray:
    """Bits (n, d) as (n, words) 64-bit words."""
    packed = np.packbits(bits, axis=-1)
    room = -packed.shape[-1] % 8
    packed = np.concatenate([packed, np.zeros((*packed.shape[:-1], room), np.uint8)], axis=-1)
    return np.ascontiguousarray(packed).view(np.uint64)


def encode(vectors: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes (n, words), lengths and alignments of the rows of `vectors`. A zero row has length 0 and alignment 1."""
    turned = vectors @ turn.T
    length = np.sqrt(np.einsum("ij,ij->i", vectors, vectors))
    with np.errstate(invalid="ignore", divide="ignore"):
        align = np.abs(turned).sum(axis=1) / (np.sqrt(vectors.shape[1]) * length)
    return _pack(turned > 0), length, np.where(length > 0, np.minimum(align, 1.0), 1.0)


@dataclass(frozen=True)
class Queries:
    """Rotated queries, rounded and cut into bit planes."""

    planes: np.ndarray  # (queries, BITS, words)
    low: np.ndarray
    step: np.ndarray
    total: np.ndarray  # of the rounded entries
    error: np.ndarray  # bound on what rounding changes of an inner product with a code
    length: np.ndarray
    d: int

    def __getitem__(self, part) -> Queries:
        return Queries(self.planes[part], self.low[part], self.step[part], self.total[part], self.error[part], self.length[part], self.d)


def queries(vectors: np.ndarray, turn: np.ndarray) -> Queries:
    d = vectors.shape[1]
    turned = vectors @ turn.T
    low = turned.min(axis=1, initial=np.inf) if len(turned) else np.zeros(0)
    step = (turned.max(axis=1, initial=-np.inf) - low) / (2**BITS - 1) if len(turned) else np.zeros(0)
    safe = np.where(step > 0, step, 1.0)
    level = np.clip(np.rint((turned - low[:, None]) / safe[:, None]), 0, 2**BITS - 1).astype(np.uint8)
    rounded = low[:, None] + step[:, None] * level
    planes = _pack((level[:, None, :] >> np.arange(BITS, dtype=np.uint8)[None, :, None]) & 1)
    error = np.abs(turned - rounded).sum(axis=1) / np.sqrt(d)
    return Queries(planes, low, step, rounded.sum(axis=1), error, np.sqrt(np.einsum("ij,ij->i", vectors, vectors)), d)


def dots(codes: np.ndarray, q: Queries) -> np.ndarray:
    """(queries, codes): inner products of the rounded queries with the codes as unit vectors."""
    ones = np.bitwise_count(codes).sum(axis=1, dtype=np.int32)
    weighted = np.zeros((len(q.low), len(codes)), np.int32)
    for bit in range(BITS):
        for word in range(codes.shape[1]):
            weighted += np.left_shift(np.bitwise_count(q.planes[:, bit, word, None] & codes[None, :, word]).astype(np.int32), bit)
    inside = q.step[:, None] * weighted + q.low[:, None] * ones
    return (2 * inside - q.total[:, None]) / np.sqrt(q.d)
