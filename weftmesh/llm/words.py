"""Word and shingle hashes of whole texts, vectorised over Arrow batches.

A word is a maximal run of characters other than space and \\t to \\r.  Texts of
a batch are handled in pieces of a few MB of whole documents, so memory follows
the longest document, not the batch.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64
#: Bytes of text handled at once; a longer document is a piece of its own.
PIECE = (1 << 20) - 1024

# Arrow's own pools and the C library keep what is freed; workers share an executor's memory with others.
pa.set_memory_pool(pa.system_memory_pool())
try:
    _TRIM = ctypes.CDLL(None).malloc_trim
except (OSError, AttributeError):  # not every C library has it

    def _TRIM(_: int) -> int:
        return 0


_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, a bijection of 64-bit values."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_BYTES = mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))
_LOWER = _BYTES.copy()
_LOWER[65:91] = _BYTES[97:123]
#: Odd multipliers, one for each place in a gram.
PLACES = mix(np.arange(1000, 1512, dtype=U)) | U(1)


class _Powers:
    """Powers of the base and of its inverse, grown as longer pieces come."""

    up = np.ones(1, U)
    down = np.ones(1, U)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = 1 << max(10, int(n - 1).bit_length())
            cls.up = np.cumprod(np.concatenate([[U(1)], np.full(size - 1, _BASE, U)]))
            cls.down = np.cumprod(np.concatenate([[U(1)], np.full(size - 1, _BASE_INVERSE, U)]))
        return cls.up, cls.down


@dataclass
class Piece:
    """Words of the documents first..first + n_docs - 1 of a batch.

    Words of the k-th document are at[k]:at[k + 1], its bytes
    bytes_at[k]:bytes_at[k + 1]; word w is data[start[w]:end[w]].
    """

    first: int
    data: np.ndarray
    bytes_at: np.ndarray
    at: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hashes: np.ndarray

    @property
    def n_docs(self) -> int:
        return len(self.at) - 1


def _words(first: int, data: np.ndarray, offsets: np.ndarray, lower: bool) -> Piece:
    solid = ~_SPACE[data]
    before, after = np.empty_like(solid), np.empty_like(solid)
    before[1:], after[:-1] = solid[:-1], solid[1:]
    full = offsets[1:] > offsets[:-1]
    before[offsets[:-1][full]] = False
    after[offsets[1:][full] - 1] = False
    start, end = np.flatnonzero(solid & ~before), np.flatnonzero(solid & ~after) + 1
    up, down = _Powers.upto(len(data) + 1)
    sums = np.zeros(len(data) + 1, U)
    terms = (_LOWER if lower else _BYTES)[data]
    terms *= up[: len(data)]
    np.cumsum(terms, out=sums[1:])
    hashes = mix((sums[end] - sums[start]) * down[start] + (end - start).astype(U))
    return Piece(first, data, offsets, np.searchsorted(start, offsets), start, end, hashes)


def pieces(texts: pa.Array | pa.ChunkedArray, lower: bool) -> Iterator[Piece]:
    """Pieces of whole documents; a null text has no words. lower: hash A-Z as a-z."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks() if texts.num_chunks != 1 else texts.chunk(0)
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    k = 0
    while k < len(texts):
        to = max(k + 1, int(np.searchsorted(offsets, offsets[k] + PIECE, "right")) - 1)
        to = min(to, len(texts))
        part = data[offsets[k] : offsets[to]]
        yield _words(k, part, offsets[k : to + 1] - offsets[k], lower)
        k = to
    _TRIM(0)


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each place on; the last n - 1 places are left out."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, U)
    total = hashes[:m] * PLACES[0]
    for k in range(1, n):
        total += hashes[k : k + m] * PLACES[k]
    return mix(total)


def short_gram(hashes: np.ndarray) -> np.uint64:
    """Hash of a whole sequence that is shorter than a shingle."""
    total = np.array([(0x5851F42D4C957F2D * (len(hashes) + 1)) % (1 << 64)], U)
    return mix(total + (hashes * PLACES[: len(hashes)]).sum(dtype=U))[0]


def rolling(hashes: np.ndarray, n: int) -> np.ndarray:
    """As :func:`grams` for long windows: a polynomial over word hashes by prefix sums."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, U)
    up, down = _Powers.upto(len(hashes) + 1)
    sums = np.zeros(len(hashes) + 1, U)
    np.cumsum(hashes * up[: len(hashes)], out=sums[1:])
    return mix((sums[n:] - sums[:m]) * down[:m])


def shingle_sets(piece: Piece, n: int = 5) -> Iterator[np.ndarray]:
    """Per document the sorted distinct hashes of its n-word shingles.

    Fewer words make one shingle of the whole sequence, no words an empty set.
    """
    every = grams(piece.hashes, n)
    for k in range(piece.n_docs):
        a, b = piece.at[k], piece.at[k + 1]
        if b - a >= n:
            yield np.unique(every[a : b - n + 1])
        elif b > a:
            yield np.array([short_gram(piece.hashes[a:b])], U)
        else:
            yield np.zeros(0, U)


def unused(names: list[str], *stems: str) -> tuple[str, ...]:
    """Column names from the stems that clash with none of ``names`` (which Spark compares without case)."""
    taken = {n.lower() for n in names}
    out = []
    for stem in stems:
        while stem.lower() in taken:
            stem += "_"
        out.append(stem)
    return tuple(out)
