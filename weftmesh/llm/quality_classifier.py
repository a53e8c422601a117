"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics are computed from whole texts.  Trees are complete binary trees of a
fixed depth, stored as flat arrays (feature, threshold, leaf value), and all
documents of a batch walk a tree at once: ``node = 2 node + 1 + (x > threshold)``.

The model is fitted on the driver from at most SAMPLE_ROWS labelled documents
(those least by a hash of the id); statistics and scores cover every document.

Edge cases: null and empty texts have all-zero statistics and get a score;
repeated rows get equal scores; a label that is null, or differs between rows of
one doc_id (the lower one counts), is handled before fitting; with no labels, or
of one class only, every score is that share (0.5 without labels); an empty
table gives an empty result; labels, lang, source and doc_id are never inputs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.storage import extended
from .words import Piece, grams, pieces

#: The most labelled documents that a model is fitted on.
SAMPLE_ROWS = 20_000
THRESHOLD = 0.7
TREES, DEPTH, RATE, BINS = 60, 4, 0.15, 48
MIN_LEAF, RIDGE = 4.0, 1.0

STATISTICS = [
    "log_words", "mean_word", "sd_word", "longest_word", "upper", "digits", "symbols", "bars", "exclamations", "stops", "commas",
    "other_marks", "non_ascii", "spaces", "distinct_words", "top_word", "same_as_next", "distinct_grams", "repeat_reach",
    "log_lines", "words_a_line", "dup_lines", "short_lines", "control",
]

_CLASSES = {
    "upper": range(65, 91),
    "lower": range(97, 123),
    "digits": range(48, 58),
    "symbols": b"#*$%&<>",
    "bars": b"|",
    "exclamations": b"!",
    "stops": b".",
    "commas": b",",
    "other_marks": b"\"'()+-/:;=?@[\\]^_`{}~",
    "non_ascii": range(128, 256),
    "spaces": b" \t\n\x0b\x0c\r",
    "control": [*range(0, 9), *range(14, 32), 127],
}


def statistics(piece: Piece) -> np.ndarray:
    """(documents, statistics) of one piece."""
    n = piece.n_docs
    out = np.zeros((n, len(STATISTICS)), np.float64)
    if not n:
        return out
    put = {name: k for k, name in enumerate(STATISTICS)}
    words = np.diff(piece.at)
    doc_of = np.repeat(np.arange(n), np.diff(piece.bytes_at))
    table = np.bincount(doc_of * 256 + piece.data, minlength=n * 256).reshape(n, 256)
    size = np.maximum(table.sum(axis=1), 1)
    for name, members in _CLASSES.items():
        if name in put:
            out[:, put[name]] = table[:, list(members)].sum(axis=1) / size
    # Latin letters with marks: capitals are C3 80 to C3 9E.
    marked = np.flatnonzero(piece.data[:-1] == 0xC3)
    capital = marked[(piece.data[marked + 1] >= 0x80) & (piece.data[marked + 1] <= 0x9E)]
    letters = table[:, 65:91].sum(axis=1) + table[:, 97:123].sum(axis=1) + np.bincount(doc_of[marked], minlength=n)
    out[:, put["upper"]] = (table[:, 65:91].sum(axis=1) + np.bincount(doc_of[capital], minlength=n)) / np.maximum(letters, 1)
    length = (piece.end - piece.start).astype(np.float64)
    some = np.maximum(words, 1)
    total = np.concatenate([[0], np.cumsum(length)])
    square = np.concatenate([[0], np.cumsum(length**2)])
    mean = (total[piece.at[1:]] - total[piece.at[:-1]]) / some
    out[:, put["log_words"]] = np.log1p(words)
    out[:, put["mean_word"]] = mean
    out[:, put["sd_word"]] = np.sqrt(np.maximum((square[piece.at[1:]] - square[piece.at[:-1]]) / some - mean**2, 0))
    every = grams(piece.hashes, 5)
    for k in range(n):
        a, b = piece.at[k], piece.at[k + 1]
        if a == b:
            continue
        hashes = piece.hashes[a:b]
        _, counts = np.unique(hashes, return_counts=True)
        out[k, put["longest_word"]] = length[a:b].max()
        out[k, put["distinct_words"]] = len(counts) / (b - a)
        out[k, put["top_word"]] = counts.max() / (b - a)
        out[k, put["same_as_next"]] = (hashes[1:] == hashes[:-1]).mean() if b - a > 1 else 0
        if b - a >= 5:
            own = np.unique(every[a : b - 4], return_counts=True)[1]
            out[k, put["distinct_grams"]] = len(own) / (b - a - 4)
            out[k, put["repeat_reach"]] = own[own > 1].sum() / (b - a - 4)
        else:
            out[k, put["distinct_grams"]] = 1
        lines = [x for x in piece.data[piece.bytes_at[k] : piece.bytes_at[k + 1]].tobytes().split(b"\n") if x.strip()]
        out[k, put["log_lines"]] = np.log1p(len(lines))
        out[k, put["words_a_line"]] = np.log1p((b - a) / max(1, len(lines)))
        out[k, put["dup_lines"]] = 1 - len(set(lines)) / max(1, len(lines))
        out[k, put["short_lines"]] = sum(len(x) < 30 for x in lines) / max(1, len(lines))
    return out


@dataclass
class Forest:
    """base score, and arrays (trees, inner nodes) and (trees, leaves)."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.base)
        rows = np.arange(len(x))
        inner = self.feature.shape[1] if self.feature.ndim == 2 else 0
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            z += leaf[node - inner]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES) -> Forest:
    """Boost logistic loss; every split is the best over all features' histograms."""
    inner, leaves = (1 << DEPTH) - 1, 1 << DEPTH
    share = float(y.mean()) if len(y) else 0.5
    base = float(np.log(max(share, 1e-6) / max(1 - share, 1e-6)))
    if not len(y) or share in (0.0, 1.0):
        return Forest(0.0 if not len(y) else base, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)))
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], axis=1)  # bin <= k means x <= edge k
    m, z = x.shape[1], np.full(len(y), base)
    flat = binned + np.arange(m) * BINS
    forest = Forest(base, np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, leaves)))
    for t in range(trees):
        p = 1 / (1 + np.exp(-z))
        g, h = y - p, np.maximum(p * (1 - p), 1e-6)
        node = np.zeros(len(y), np.int64)
        for level in range(DEPTH):
            first, width = (1 << level) - 1, 1 << level
            key = ((node - first)[:, None] * (m * BINS) + flat).ravel()
            shape = (width, m, BINS)
            hist = [np.bincount(key, np.repeat(v, m), width * m * BINS).reshape(shape).cumsum(axis=2) for v in (g, h)]
            gl, hl = hist[0][:, :, :-1], hist[1][:, :, :-1]
            gt, ht = hist[0][:, :, -1:], hist[1][:, :, -1:]
            gain = gl**2 / (hl + RIDGE) + (gt - gl) ** 2 / (ht - hl + RIDGE) - gt**2 / (ht + RIDGE)
            gain[(hl < MIN_LEAF / 4) | (ht - hl < MIN_LEAF / 4)] = -1
            best = gain.reshape(width, -1).argmax(axis=1)
            f, cut = best // (BINS - 1), best % (BINS - 1)
            good = gain.reshape(width, -1)[np.arange(width), best] > 1e-3
            limit = np.array([edges[a][min(c, len(edges[a]) - 1)] if ok and c < len(edges[a]) else np.inf for a, c, ok in zip(f, cut, good, strict=True)])
            forest.feature[t, first : first + width], forest.threshold[t, first : first + width] = f, limit
            own = node - first
            node = 2 * node + 1 + (x[np.arange(len(y)), f[own]] > limit[own])
        sums = [np.bincount(node - inner, v, leaves) for v in (g, h)]
        forest.leaf[t] = RATE * sums[0] / (sums[1] + RIDGE)
        z += forest.leaf[t][node - inner]
    return forest


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in pieces(batch.column("text"), False):
            found = statistics(piece)
            lists = pa.FixedSizeListArray.from_arrays(pa.array(found.ravel()), found.shape[1]).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column("label").slice(piece.first, piece.n_docs), lists], ["label", "x"])


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str, allowed, rows: int) -> DataFrame:
    """(doc_id, label, text) of at most ``rows`` labelled documents, those with the least hash of the id; of rows of one id the least text."""
    usable = labels.where(F.col(column).isin(0, 1) & F.col("doc_id").isNotNull() & allowed).groupBy("doc_id").agg(F.min(column).alias("label"))
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return found.groupBy("doc_id").agg(F.min("label").cast("int").alias("label"), F.min("text").alias("text"))


def train(docs: DataFrame, labels: DataFrame, allowed, column: str = "quality", rows: int = SAMPLE_ROWS) -> Forest:
    sample = labelled_sample(docs, labels, column, allowed, rows).select("label", "text")
    table = sample.mapInArrow(_rows, "label int, x array<double>").toArrow()
    if not table.num_rows:
        return fit(np.zeros((0, len(STATISTICS))), np.zeros(0))
    x = table.column("x").combine_chunks().flatten().to_numpy().reshape(-1, len(STATISTICS))
    y = table.column("label").to_numpy().astype(np.float64)
    order = np.lexsort((*x.T[::-1], y))  # the same model however rows arrive
    return fit(x[order], y[order])


def _scores(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [shared.value.score(statistics(piece)) for piece in pieces(batch.column("text"), False)]
            column = pa.array(np.concatenate(scores) if scores else np.zeros(0), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, column], [*batch.schema.names, "score"])

    return run


def score(docs: DataFrame, forest: Forest) -> DataFrame:
    """Adds score to all columns of ``docs`` (a column of that name is replaced)."""
    docs = docs.drop("score")
    shared = docs.sparkSession.sparkContext.broadcast(forest)
    return docs.mapInArrow(_scores(shared), extended(docs.schema, "score double"))


def held_out() -> F.Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's rows over the whole ``documents`` table."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    forest = train(docs, labels, ~held_out())
    scored = score(docs.select("doc_id", "text"), forest)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
