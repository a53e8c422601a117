"""Benchmark decontamination: SimHash of item-sized windows, Hamming blocks, exact verification.

The benchmark is a query set: its items are read in blocks of bounded size and
each block is matched against all documents, with no shuffle of documents.

For an item of L words, every window of L words that holds one of its five-word
shingles gets a 64-bit SimHash of its shingles (each counted as often as it
occurs).  A window without any such shingle has similarity 0.  Fingerprints are
cut into four blocks of 16 bits: two within RADIUS bits differ in at most
RADIUS // 4 bits of some block, so tables of all block values near an item's
yield every item within the radius.  Candidates are verified by weighted
Jaccard similarity (sum of least over sum of greatest shingle counts).

Edge cases: null and empty texts and items match nothing; items under five
words are one shingle and match equal sequences only; a document shorter than
an item is one window; repeated rows are each reported, with null doc_id too;
empty tables give an empty result; of extra columns, :func:`clean` keeps all.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .words import PLACES, U, Piece, grams, mix, pieces, short_gram

SHINGLE, SIMILARITY = 5, 0.8
#: Bits in which fingerprints of similar windows may differ: at similarity 0.8 about 10 of 64 do, with a deviation of 3.
RADIUS = 18
BLOCKS, BLOCK_BITS = 4, 16
#: Items and bytes of text in a block of the benchmark.
BLOCK_ITEMS, BLOCK_BYTES = 1000, 8 << 20
FILTER_BITS = 22


def simhash(counts: np.ndarray) -> np.ndarray:
    """Sums of +1 and -1 by bit, shape (n, 64) -> n fingerprints."""
    return np.packbits(counts > 0, axis=1, bitorder="little").view("<u8").ravel().astype(U)


def _signs(shingles: np.ndarray) -> np.ndarray:
    bits = np.unpackbits(shingles.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits.astype(np.int16) * 2 - 1


class Index:
    """Shingles, fingerprints and block tables of a block of items."""

    def __init__(self, ids: list, texts: list):
        self.ids, self.length, self.shingles = [], [], []
        for piece in pieces(pa.array(texts, pa.string()), True):
            for k in range(piece.n_docs):
                hashes = piece.hashes[piece.at[k] : piece.at[k + 1]]
                if len(hashes):
                    self.ids.append(ids[piece.first + k])
                    self.length.append(len(hashes))
                    self.shingles.append(grams(hashes, SHINGLE) if len(hashes) >= SHINGLE else np.array([short_gram(hashes)], U))
        self.lengths = np.array(self.length, np.int64)
        long = self.lengths >= SHINGLE
        self.short = sorted(set(self.lengths[~long].tolist()))
        owner = np.concatenate([np.full(len(s), k) for k, s in enumerate(self.shingles)]) if self.ids else np.zeros(0, np.int64)
        flat = np.concatenate(self.shingles) if self.ids else np.zeros(0, U)
        order = np.argsort(flat, kind="stable")
        self.flat, self.owner = flat[order], owner[order]
        self.filter = np.zeros(1 << FILTER_BITS, bool)
        self.filter[(self.flat >> U(64 - FILTER_BITS)).astype(np.int64)] = True
        self.counted = [np.unique(s, return_counts=True) for s in self.shingles]
        self.prints = np.concatenate([simhash(_signs(s).sum(axis=0, dtype=np.int64)[None]) for s in self.shingles]) if self.ids else np.zeros(0, U)
        near = [sum(1 << b for b in c) for r in range(RADIUS // BLOCKS + 1) for c in itertools.combinations(range(BLOCK_BITS), r)]
        near = np.array(near, np.int64)
        self.tables = []
        for b in range(BLOCKS):
            values = self._block(self.prints, b)[:, None] ^ near[None, :]
            order = np.argsort(values.ravel(), kind="stable")
            items = np.repeat(np.arange(len(self.ids)), len(near))[order].astype(np.int32)
            starts = np.searchsorted(values.ravel()[order], np.arange((1 << BLOCK_BITS) + 1))
            self.tables.append((starts, items))

    @staticmethod
    def _block(prints: np.ndarray, b: int) -> np.ndarray:
        return ((prints >> U(b * BLOCK_BITS)) & U((1 << BLOCK_BITS) - 1)).astype(np.int64)

    def near(self, prints: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, item, distance) of all items of that length within RADIUS of the fingerprints."""
        found = []
        for b, (starts, items) in enumerate(self.tables):
            value = self._block(prints, b)
            n = starts[value + 1] - starts[value]
            window = np.repeat(np.arange(len(prints)), n)
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts[value], n)
            item = items[at].astype(np.int64)
            fit = self.lengths[item] == length
            found.append(window[fit] * len(self.ids) + item[fit])
        pairs = np.unique(np.concatenate(found))
        window, item = pairs // len(self.ids), pairs % len(self.ids)
        distance = np.bitwise_count(prints[window] ^ self.prints[item]).astype(np.int64)
        close = distance <= RADIUS
        return window[close], item[close], distance[close]

    def similarity(self, shingles: np.ndarray, item: int) -> float:
        values, counts = np.unique(shingles, return_counts=True)
        known, expected = self.counted[item]
        at = np.minimum(np.searchsorted(values, known), len(values) - 1)
        both = np.where(values[at] == known, np.minimum(counts[at], expected), 0).sum()
        return float(both / (len(shingles) + expected.sum() - both))

    def matches(self, piece: Piece) -> Iterator[tuple[int, int, int, int, float, int]]:
        """(document, item, start, words, similarity, distance) of the best window of each document and item."""
        best: dict[tuple[int, int], tuple] = {}
        every, n_words = grams(piece.hashes, SHINGLE), np.diff(piece.at)
        if not self.ids or not len(piece.hashes):
            return
        doc_of = np.repeat(np.arange(piece.n_docs), n_words)
        hits = np.flatnonzero(self.filter[(every >> U(64 - FILTER_BITS)).astype(np.int64)])
        hits = hits[doc_of[hits] == doc_of[hits + SHINGLE - 1]] if len(hits) else hits
        lo, hi = np.searchsorted(self.flat, every[hits], "left"), np.searchsorted(self.flat, every[hits], "right")
        n = hi - lo
        if n.any():  # the filter also lets some other shingles through
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
            place, length = np.repeat(hits, n), self.lengths[self.owner[at]]
            asked = np.unique(np.stack([doc_of[place], length, place]), axis=1)
            cuts = np.flatnonzero(np.concatenate([[True], (np.diff(asked[0]) != 0) | (np.diff(asked[1]) != 0), [True]]))
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                self._document(piece, every, int(asked[0, a]), int(asked[1, a]), asked[2, a:b], best)
        for length in self.short:
            m = len(piece.hashes) - length + 1
            if m <= 0:
                continue
            total = np.full(m, (0x5851F42D4C957F2D * (length + 1)) % (1 << 64), U)
            for k in range(length):
                total += piece.hashes[k : k + m] * PLACES[k]
            values = mix(total)
            lo, hi = np.searchsorted(self.flat, values, "left"), np.searchsorted(self.flat, values, "right")
            for p in np.flatnonzero((hi > lo) & (doc_of[:m] == doc_of[length - 1 : length - 1 + m])):
                for item in self.owner[lo[p] : hi[p]]:
                    if self.lengths[item] == length:
                        best.setdefault((int(doc_of[p]), int(item)), (1.0, 0, int(p - piece.at[doc_of[p]]), length))
        for (doc, item), (similarity, distance, start, words) in sorted(best.items()):
            yield doc, item, start, words, similarity, -distance

    def _document(self, piece: Piece, every: np.ndarray, doc: int, length: int, places: np.ndarray, best: dict) -> None:
        """Windows of ``length`` words of one document that hold a shingle at ``places``."""
        first, words = int(piece.at[doc]), int(piece.at[doc + 1] - piece.at[doc])
        size = min(length, words)
        n = size - SHINGLE + 1
        last = first + words - size
        steps = np.zeros(words + 2, np.int64)
        np.add.at(steps, np.clip(places - n + 1, first, last) - first, 1)
        np.add.at(steps, np.clip(places, first, last) - first + 1, -1)
        starts = np.flatnonzero(np.cumsum(steps) > 0) + first
        for a in range(0, len(starts), 4096):
            some = starts[a : a + 4096]
            lo, hi = int(some[0]), int(some[-1]) + n
            sums = np.zeros((hi - lo + 1, 64), np.int32)
            np.cumsum(_signs(every[lo:hi]), axis=0, out=sums[1:])
            prints = simhash(sums[some - lo + n] - sums[some - lo])
            for window, item, distance in zip(*self.near(prints, length), strict=True):
                start = int(some[window])
                similarity = self.similarity(every[start : start + n], int(item))
                if similarity >= SIMILARITY - 1e-12:
                    found, key = (similarity, -int(distance), start - first, size), (doc, int(item))
                    old = best.get(key)
                    if old is None or (found[0], -found[2]) > (old[0], -old[2]):
                        best[key] = found


#: The last block that this worker has indexed, and its index.
_BUILT: list = []


def _index(shared) -> Index:
    if not _BUILT or _BUILT[0] is not shared.value:
        _BUILT[:] = [shared.value, Index(*shared.value)]
    return _BUILT[1]


def blocks(items: DataFrame) -> Iterator[tuple[list, list]]:
    """The query set in blocks whose items and bytes are bounded (a longer item stands alone at worst)."""
    items = items.select("item_id", "text").where("text is not null")
    count, size = items.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).head()
    n = max(1, -(-count // BLOCK_ITEMS), -(-size // BLOCK_BYTES))
    for k in range(n):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).orderBy("item_id", "text").toArrow()
        if rows.num_rows:
            yield rows.column("item_id").to_pylist(), rows.column("text").to_pylist()


def _find(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _index(shared)
        for batch in batches:
            ids = batch.column("doc_id")
            rows: list[tuple] = []
            for piece in pieces(batch.column("text"), True):
                for doc, item, start, words, similarity, distance in index.matches(piece):
                    rows.append((ids[piece.first + doc].as_py(), index.ids[item], start, words, similarity, distance))
            if rows:
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "item_id", "start", "n_words", "similarity", "distance"])

    return run


def find_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """One row per document and item that it holds: where, how similar, and the fingerprints' distance."""
    spark, out = docs.sparkSession, None
    fields = "doc_id bigint, item_id bigint, start bigint, n_words bigint, similarity double, distance bigint"
    for block in blocks(items):
        shared = spark.sparkContext.broadcast(block)
        found = docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(_find(shared), fields)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], fields)


def _drop(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _index(shared)
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            for piece in pieces(batch.column("text"), True):
                for doc, *_ in index.matches(piece):
                    keep[piece.first + doc] = False
            yield batch.filter(pa.array(keep))

    return run


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents that hold no item, all columns kept."""
    for block in blocks(items):
        docs = docs.mapInArrow(_drop(docs.sparkSession.sparkContext.broadcast(block)), docs.schema)
    return docs


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaks of the whole ``benchmark`` in the whole ``documents`` table."""
    return find_leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
