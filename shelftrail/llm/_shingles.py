"""Word and shingle hashes of many texts at once, in numpy.

Words are maximal runs of bytes outside ASCII white space, A-Z lower-cased. A word hashes to the sum over its bytes of
a random 64-bit value of the byte times an odd power of its place, mixed; a shingle to the mixed sum of its words' hashes
times an odd power of their place. All sums wrap at 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_rng = np.random.default_rng(20240601)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_PLACE = np.uint64(0xD6E8FEB86659FD93)
#: Texts are hashed together up to this many bytes; a longer one alone.
CHUNK_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    return np.multiply.accumulate(np.full(max(n, 1), base, np.uint64))


def _word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts in order, and the number of words before each text and after the last."""
    raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    inside = np.ones(256, bool)
    inside[[9, 10, 11, 12, 13, 32]] = False
    word = inside[raw]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], word]).view(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    bounds = np.searchsorted(starts, np.cumsum([0] + [len(t) + 1 for t in texts]))
    if not len(starts):
        return np.zeros(0, np.uint64), bounds
    lengths = ends - starts
    first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    place = np.arange(lengths.sum()) - np.repeat(first, lengths)
    values = _BYTE[raw[word]] * _powers(_STEP, int(lengths.max()))[place]
    return mix(np.add.reduceat(values, first)), bounds


def _shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    if not len(words):
        return words
    n = min(k, len(words))  # a shorter text is one shingle of all its words
    powers = _powers(_PLACE, n)
    total = np.zeros(len(words) - n + 1, np.uint64)
    for j in range(n):
        total += words[j : len(words) - n + 1 + j] * powers[j]
    return mix(total + np.uint64(n))


def _chunks(texts: list[str | bytes | None]) -> Iterator[list[bytes]]:
    """Up to `CHUNK_BYTES` of UTF-8 at a time: bytes as they are, strings with A-Z lower-cased, null as empty."""
    part, size = [], 0
    for t in texts:
        raw = t if isinstance(t, bytes) else (t or "").encode("utf-8").lower()
        if part and size + len(raw) > CHUNK_BYTES:
            yield part
            part, size = [], 0
        part.append(raw)
        size += len(raw)
    if part:
        yield part


def shingle_sequences(texts: list[str | bytes | None], k: int) -> Iterator[np.ndarray]:
    """For each text the hashes of its k-word shingles in order, repeats included."""
    for part in _chunks(texts):
        words, bounds = _word_hashes(part)
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            yield _shingle_hashes(words[a:b], k)


def shingle_sets(texts: list[str | bytes | None], k: int) -> Iterator[np.ndarray]:
    """For each text its distinct shingle hashes, sorted."""
    return map(np.unique, shingle_sequences(texts, k))
