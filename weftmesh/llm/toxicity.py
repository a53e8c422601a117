"""Toxicity: a bidirectional gated recurrent network with attention pooling, in numpy.

A word's input joins a learned vector of the word (if it is known) and the mean
of learned vectors of all its 4-byte character grams.  Two GRUs read a window of 32
words in both directions, attention pools their states, and a logistic unit
scores the window.  Every text is covered by windows that overlap by half; its
score is the calibrated greatest window score.

The network is fitted on the driver from at most SAMPLE_DOCS labelled documents
(half of them toxic if there are so many); scoring covers every window of every
document, in memory bounded by a piece of text.

Edge cases: null and empty texts have no window and get the least score;
repeated rows get equal scores; null labels are left out and of several labels
of one doc_id the lower counts; without labels of both classes every score is
the toxic share of the labels (0 without labels); an empty table gives an empty
result; labels, lang, source and doc_id are never inputs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.storage import extended
from .words import _LOWER, PLACES, U, Piece, mix, pieces

#: The most labelled documents, of each class, that the network is fitted on; the most words it knows.
SAMPLE_DOCS, KNOWN_WORDS = 700, 8192
THRESHOLD = 0.5
WINDOW, STRIDE = 32, 16
WORD_DIM, CHAR_DIM, HIDDEN, ATTENTION = 8, 8, 8, 8
CHAR_GRAM, CHAR_BUCKETS = 4, 4096
EPOCHS, BATCH, RATE, LEAST_STEPS = 5, 256, 8e-3, 250
#: Share of a toxic document's windows that count as toxic while fitting.
TOXIC_SHARE = 0.3
#: Chance that a known word is read by its characters only while fitting.
HIDE_WORD = 0.4
#: Windows scored at once; character grams whose vectors are gathered at once.
LOT, GRAM_LOT = 4096, 1 << 16
EMPTY = -12.0


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Vocabulary:
    """Distinct words of a piece: hash, known-word number (0 unknown) and character grams.

    Grams of word w are grams[gram_at[w]:gram_at[w + 1]].
    """

    hashes: np.ndarray
    known: np.ndarray
    grams: np.ndarray
    gram_at: np.ndarray

    @property
    def n_grams(self) -> np.ndarray:
        return np.diff(self.gram_at)

    def take(self, some: np.ndarray) -> Vocabulary:
        n = self.n_grams[some]
        at = np.concatenate([[0], np.cumsum(n)])
        grams = self.grams[np.repeat(self.gram_at[some] - at[:-1], n) + np.arange(at[-1])]
        return Vocabulary(self.hashes[some], self.known[some], grams, at)

    def gram_lots(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(words, starts) of runs of at most about 2 * GRAM_LOT grams; starts has one place more, for the end.

        A word of more than GRAM_LOT grams comes in parts, cut at the same places in any company.
        """
        parts = -(-self.n_grams // GRAM_LOT)
        word = np.repeat(np.arange(len(parts)), parts)
        nth = np.arange(len(word)) - np.repeat(np.cumsum(parts) - parts, parts)
        start = np.append(self.gram_at[word] + nth * GRAM_LOT, self.gram_at[-1])
        cuts = np.flatnonzero(np.diff(start[:-1] // GRAM_LOT, prepend=-1))
        for a, b in zip(cuts, np.append(cuts, len(word))[1:], strict=True):
            yield word[a:b], start[a : b + 1]


def vocabulary(piece: Piece, known: np.ndarray) -> tuple[Vocabulary, np.ndarray]:
    """The piece's distinct words, and for each word its place among them."""
    hashes, first, inverse = np.unique(piece.hashes, return_index=True, return_inverse=True)
    start, length = piece.start[first], (piece.end - piece.start)[first]
    # The word with a mark before it: grams at places -1 .. length - CHAR_GRAM, one at least.
    n = np.maximum(length - CHAR_GRAM + 2, 1)
    gram_at = np.concatenate([[0], np.cumsum(n)])
    grams = np.empty(gram_at[-1], np.int32)
    for a in range(0, len(grams), 1 << 20):
        place = np.arange(a, min(a + (1 << 20), len(grams)))
        word = np.searchsorted(gram_at, place, "right") - 1
        at, begin, end = place - gram_at[word] - 1, start[word], length[word]
        codes = np.zeros(len(at), U)
        for k in range(CHAR_GRAM):
            spot = at + k
            byte = piece.data[begin + np.clip(spot, 0, end - 1)]
            codes += np.where(spot < 0, U(7), np.where(spot < end, _LOWER[byte], U(9))) * PLACES[k]
        grams[a : a + len(at)] = mix(codes) % U(CHAR_BUCKETS)
    if len(known):
        spot = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
        number = np.where(known[spot] == hashes, spot + 1, 0)
    else:
        number = np.zeros(len(hashes), np.int64)
    return Vocabulary(hashes, number, grams, gram_at), inverse


def windows(piece: Piece, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, first word, words) of windows that cover every word of the piece."""
    n = np.diff(piece.at)
    count = np.where(n > 0, np.maximum(1, -(-(n - (WINDOW - stride)) // stride)), 0)
    doc = np.repeat(np.arange(piece.n_docs), count)
    nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    start = piece.at[:-1][doc] + nth * stride
    return doc, start, np.minimum(WINDOW, piece.at[1:][doc] - start)


@dataclass
class Network:
    known: np.ndarray
    weights: dict[str, np.ndarray] = field(default_factory=dict)
    slope: float = 1.0
    offset: float = 0.0
    constant: float | None = None

    @classmethod
    def fresh(cls, known: np.ndarray, rng: np.random.Generator) -> Network:
        size, f = WORD_DIM + CHAR_DIM, np.float32
        draw = lambda *shape, s: (rng.standard_normal(shape) * s).astype(f)
        w = {"word": draw(len(known) + 1, WORD_DIM, s=0.1), "char": draw(CHAR_BUCKETS, CHAR_DIM, s=0.1)}
        for d in ("f", "b"):
            w |= {f"x{d}": draw(size, 3 * HIDDEN, s=0.4), f"h{d}": draw(HIDDEN, 3 * HIDDEN, s=0.3), f"c{d}": np.zeros(3 * HIDDEN, f)}
        w |= {"a": draw(2 * HIDDEN, ATTENTION, s=0.4), "ac": np.zeros(ATTENTION, f), "v": draw(ATTENTION, s=0.4), "o": draw(2 * HIDDEN, s=0.4), "oc": np.zeros(1, f)}
        return cls(known, w)

    def inputs(self, words: Vocabulary, known: np.ndarray | None = None) -> np.ndarray:
        """A row for each distinct word."""
        w = self.weights
        out = np.empty((len(words.hashes), WORD_DIM + CHAR_DIM), np.float32)
        out[:, :WORD_DIM] = w["word"][words.known if known is None else known]
        total = np.zeros((len(out), CHAR_DIM))
        for word, start in words.gram_lots():
            np.add.at(total, word, np.add.reduceat(w["char"][words.grams[start[0] : start[-1]]], start[:-1] - start[0], axis=0, dtype=np.float64))
        out[:, WORD_DIM:] = total / words.n_grams[:, None]
        return out

    def _run(self, x: np.ndarray, ids: np.ndarray, mask: np.ndarray, d: str, keep: list | None) -> np.ndarray:
        """States (time, window, hidden); x: projected inputs by word, ids: (window, time)."""
        w, n, steps = self.weights[f"h{d}"], *ids.shape
        h, out = np.zeros((n, HIDDEN), np.float32), np.empty((steps, n, HIDDEN), np.float32)
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            a, u, m = x[ids[:, t]], h @ w, mask[:, t, None]
            gates = 1 / (1 + np.exp(-(a[:, : 2 * HIDDEN] + u[:, : 2 * HIDDEN])))
            z, r = gates[:, :HIDDEN], gates[:, HIDDEN:]
            c = np.tanh(a[:, 2 * HIDDEN :] + r * u[:, 2 * HIDDEN :])
            new = c + z * (h - c)
            new = np.where(m, new, h)
            if keep is not None:
                keep.append((t, h, z, r, c, u[:, 2 * HIDDEN :]))
            out[t] = h = new
        return out

    def logits(self, x: np.ndarray, ids: np.ndarray, mask: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Window scores; x: word inputs."""
        w = self.weights
        runs = {d: [] if keep is not None else None for d in "fb"}
        states = np.concatenate([self._run(x @ w[f"x{d}"] + w[f"c{d}"], ids, mask, d, runs[d]) for d in "fb"], axis=2)
        u = np.tanh(states @ w["a"] + w["ac"])
        s = np.where(mask.T, u @ w["v"], -1e9)
        e = np.exp(s - s.max(axis=0))
        alpha = e / e.sum(axis=0)
        pooled = (alpha[:, :, None] * states).sum(axis=0)
        if keep is not None:
            keep |= {"runs": runs, "states": states, "u": u, "alpha": alpha, "pooled": pooled}
        return pooled @ w["o"] + w["oc"][0]

    def gradients(self, x: np.ndarray, ids: np.ndarray, mask: np.ndarray, k: dict, dz: np.ndarray) -> tuple[dict, np.ndarray]:
        """Of all weights but the embeddings, and of the word inputs."""
        w, g = self.weights, {}
        g["o"], g["oc"] = k["pooled"].T @ dz, dz.sum(keepdims=True)
        dpooled = dz[:, None] * w["o"]
        dstates = k["alpha"][:, :, None] * dpooled[None]
        dalpha = (k["states"] * dpooled[None]).sum(axis=2)
        ds = k["alpha"] * (dalpha - (k["alpha"] * dalpha).sum(axis=0))
        g["v"] = np.einsum("tn,tna->a", ds, k["u"])
        du = ds[:, :, None] * w["v"] * (1 - k["u"] ** 2)
        g["a"], g["ac"] = np.einsum("tnh,tna->ha", k["states"], du), du.sum(axis=(0, 1))
        dstates += du @ w["a"].T
        dx = np.zeros_like(x)
        # Every word of x occurs, so sums by word run over the sorted occurrences.
        order = np.argsort(ids.T.ravel(), kind="stable")
        cuts = np.searchsorted(ids.T.ravel()[order], np.arange(len(x)))
        for d, part in (("f", slice(0, HIDDEN)), ("b", slice(HIDDEN, 2 * HIDDEN))):
            hw, dh = w[f"h{d}"], np.zeros((len(ids), HIDDEN), np.float32)
            dw, dgates = np.zeros_like(hw), np.empty((ids.shape[1], len(ids), 3 * HIDDEN), np.float32)
            for t, before, z, r, c, uc in reversed(k["runs"][d]):
                dh = dh + dstates[t][:, part]
                m = mask[:, t, None].astype(np.float32)
                dn, rest = dh * m, dh * (1 - m)
                da_c = dn * (1 - z) * (1 - c**2)
                da_z = dn * (before - c) * z * (1 - z)
                da_r = da_c * uc * r * (1 - r)
                du = np.concatenate([da_z, da_r, da_c * r], axis=1)
                dw += before.T @ du
                dgates[t] = np.concatenate([da_z, da_r, da_c], axis=1)
                dh = rest + dn * z + du @ hw.T
            dproj = np.add.reduceat(dgates.reshape(-1, 3 * HIDDEN)[order], cuts, axis=0)
            g[f"h{d}"], g[f"x{d}"], g[f"c{d}"] = dw, x.T @ dproj, dproj.sum(axis=0)
            dx += dproj @ w[f"x{d}"].T
        return g, dx

    def window_scores(self, piece: Piece) -> tuple[np.ndarray, np.ndarray]:
        """(document, logit) of every window of a piece."""
        doc, start, length = windows(piece)
        if not len(doc):
            return doc, np.zeros(0, np.float32)
        words, inverse = vocabulary(piece, self.known)
        x, out = self.inputs(words), np.empty(len(doc), np.float32)
        for a in range(0, len(doc), LOT):
            mask = np.arange(WINDOW)[None, :] < length[a : a + LOT, None]
            at = np.minimum(start[a : a + LOT, None] + np.arange(WINDOW), len(inverse) - 1)
            out[a : a + LOT] = self.logits(x, inverse[at], mask)
        return doc, out

    def greatest(self, piece: Piece) -> np.ndarray:
        """The greatest window logit of each document; EMPTY without words."""
        doc, z = self.window_scores(piece)
        out = np.full(piece.n_docs, EMPTY)
        np.maximum.at(out, doc, z)
        return out

    def score(self, piece: Piece) -> np.ndarray:
        if self.constant is not None:
            return np.full(piece.n_docs, self.constant)
        top = self.greatest(piece)
        return np.where(np.diff(piece.at) > 0, _sigmoid(self.slope * top + self.offset), _sigmoid(np.array(EMPTY)))


def _calibrate(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic fit, by Newton steps that are halved until the loss falls."""
    middle, spread = float(z.mean()), float(z.std()) + 1e-6
    x = np.stack([(z - middle) / spread, np.ones_like(z)], axis=1)
    ridge = np.array([0.02, 0.0])
    loss = lambda w: float(np.logaddexp(0, np.where(y > 0, -1, 1) * (x @ w)).sum() + (ridge * w * w).sum() / 2)
    w = np.zeros(2)
    for _ in range(100):
        p = _sigmoid(x @ w)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge + 1e-9), x.T @ (y - p) - ridge * w)
        size = 1.0
        while size > 1e-4 and loss(w + size * step) > loss(w):
            size /= 2
        w = w + size * step
        if np.abs(size * step).max() < 1e-6 or size <= 1e-4:
            break
    slope = max(float(w[0]) / spread, 0.05)
    return slope, float(w[1]) - slope * middle


def _unevenness(counts: np.ndarray, documents: np.ndarray) -> np.ndarray:
    """Shrunken log odds of (clean, toxic) document counts."""
    share = (counts + 0.5) / (documents + 1)
    n = counts.sum(axis=1)
    return np.log(share[:, 1] / share[:, 0]) * n / (n + 5) / 2


def _chosen(net: Network, lot: tuple) -> np.ndarray:
    """All windows of clean documents, and of each toxic one the likeliest TOXIC_SHARE."""
    words, inverse, doc, start, length, y = lot
    toxic = np.flatnonzero(y > 0)
    if not len(toxic):
        return np.arange(len(y))
    x = net.inputs(words)
    mask = np.arange(WINDOW)[None, :] < length[toxic, None]
    z = net.logits(x, inverse[np.minimum(start[toxic, None] + np.arange(WINDOW), len(inverse) - 1)], mask)
    order = np.lexsort((-z, doc[toxic]))
    docs, first, n = np.unique(doc[toxic][order], return_index=True, return_counts=True)
    rank = np.arange(len(toxic)) - np.repeat(first, n)
    keep = rank < np.repeat(np.maximum(1, np.ceil(TOXIC_SHARE * n)), n)
    return np.sort(np.concatenate([np.flatnonzero(y <= 0), toxic[order][keep]]))


def fit(texts: list[str], labels: np.ndarray, seed: int = 5) -> Network:
    """Fit on four fifths of the documents; calibrate document scores on the rest."""
    labels = np.asarray(labels, np.float64)
    if not len(labels) or labels.min() == labels.max():
        return Network(np.zeros(0, U), constant=float(labels.mean()) if len(labels) else 0.0)
    rng = np.random.default_rng(seed)
    held = np.arange(len(texts)) % 5 == 4
    if len(set(labels[held])) < 2 or len(set(labels[~held])) < 2:
        held[:] = False
    parts = list(pieces(pa.array(texts, pa.string()), True))
    # Known words: those of at least three documents, the most frequent first.
    seen: dict[int, np.ndarray] = {}
    grams, of_class = np.zeros((CHAR_BUCKETS, 2)), np.zeros(2)
    for p in parts:
        words, inverse = vocabulary(p, np.zeros(0, U))
        for k in range(p.n_docs):
            if not held[p.first + k]:
                own, y = np.unique(inverse[p.at[k] : p.at[k + 1]]), int(labels[p.first + k])
                of_class[y] += 1
                grams[np.unique(words.take(own).grams), y] += 1
                for h in words.hashes[own].tolist():
                    seen.setdefault(h, np.zeros(2))[y] += 1
    often = sorted((h for h, n in seen.items() if n.sum() >= 3), key=lambda h: (-seen[h].sum(), h))[:KNOWN_WORDS]
    net = Network.fresh(np.array(sorted(often), U), rng)
    # One place of each vector starts from how unevenly the classes' documents hold the word or gram.
    net.weights["word"][1:, 0] = _unevenness(np.array([seen[h] for h in sorted(often)]).reshape(-1, 2), of_class)
    net.weights["char"][:, 0] = _unevenness(grams, of_class)
    lots = []
    for p in parts:
        words, inverse = vocabulary(p, net.known)
        doc, start, length = windows(p, WINDOW)
        use = ~held[p.first + doc]
        lots.append((words, inverse, doc[use], start[use], length[use], labels[p.first + doc[use]]))
    moments = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in net.weights.items()}
    steps = 0
    total = sum(-(-len(lot[2]) // BATCH) for lot in lots) * EPOCHS
    rounds = EPOCHS * max(1, -(-LEAST_STEPS // max(1, total)))  # few documents: more passes
    for epoch in range(rounds):
        # A toxic document need not be toxic throughout: after the first pass only its likeliest windows count as toxic, the others not at all.
        chosen = [_chosen(net, lot) if epoch else np.arange(len(lot[2])) for lot in lots]
        share = float(np.concatenate([lot[5][c] for lot, c in zip(lots, chosen, strict=True)]).mean())
        weight = {1.0: 0.5 / max(share, 1e-3), 0.0: 0.5 / max(1 - share, 1e-3)}
        for (words, inverse, _, start, length, y), some_windows in zip(lots, chosen, strict=True):
            order = rng.permutation(some_windows)
            for a in range(0, len(order), BATCH):
                pick = order[a : a + BATCH]
                mask = np.arange(WINDOW)[None, :] < length[pick, None]
                at = inverse[np.minimum(start[pick, None] + np.arange(WINDOW), len(inverse) - 1)]
                distinct, ids = np.unique(at, return_inverse=True)
                ids = ids.reshape(at.shape)
                some = words.take(distinct)
                known = np.where(rng.random(len(distinct)) < HIDE_WORD, 0, some.known)
                x, kept = net.inputs(some, known), {}
                z = net.logits(x, ids, mask, kept)
                dz = ((_sigmoid(z) - y[pick]) * np.where(y[pick] > 0, weight[1.0], weight[0.0]) / len(pick)).astype(np.float32)
                g, dx = net.gradients(x, ids, mask, kept, dz)
                g["word"], g["char"] = np.zeros_like(net.weights["word"]), np.zeros_like(net.weights["char"])
                np.add.at(g["word"], known, dx[:, :WORD_DIM])
                each = (dx[:, WORD_DIM:] / some.n_grams[:, None]).astype(np.float32)
                for word, cuts in some.gram_lots():
                    np.add.at(g["char"], some.grams[cuts[0] : cuts[-1]], np.repeat(each[word], np.diff(cuts), axis=0))
                steps += 1
                rate = RATE * np.sqrt(1 - 0.999**steps) / (1 - 0.9**steps) * (1 - 0.8 * epoch / rounds)
                for name, value in net.weights.items():
                    m, v = moments[name]
                    m *= 0.9
                    m += 0.1 * g[name]
                    v *= 0.999
                    v += 0.001 * g[name] ** 2
                    value -= (rate * m / (np.sqrt(v) + 1e-8) + 1e-4 * rate * value).astype(np.float32)
    top = np.concatenate([net.greatest(p) for p in parts])
    judge = held if held.any() else np.ones(len(texts), bool)
    net.slope, net.offset = _calibrate(top[judge], labels[judge])
    return net


def train(docs: DataFrame, labels: DataFrame, allowed, column: str = "toxic", rows: int = SAMPLE_DOCS) -> Network:
    """Fit on at most ``rows`` documents of each class, those with the least hash of the id."""
    usable = labels.where(F.col(column).isin(0, 1) & F.col("doc_id").isNotNull() & allowed).groupBy("doc_id").agg(F.min(column).alias("label"))
    least = lambda v: usable.where(F.col("label") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    found = docs.select("doc_id", "text").join(F.broadcast(least(0).union(least(1))), "doc_id")
    sample = found.groupBy("doc_id").agg(F.min("label").alias("label"), F.coalesce(F.min("text"), F.lit("")).alias("text"))  # of rows of one id the least text
    rows_ = sample.orderBy(F.xxhash64("doc_id"), "doc_id", "text").toArrow()
    return fit(rows_.column("text").to_pylist(), rows_.column("label").to_numpy().astype(np.float64))


def _scores(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [shared.value.score(piece) for piece in pieces(batch.column("text"), True)]
            others = [c for n, c in zip(batch.schema.names, batch.columns, strict=True) if n != "text"]
            names = [n for n in batch.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays([*others, pa.array(np.concatenate(scores) if scores else np.zeros(0), pa.float64())], [*names, "score"])

    return run


def score(docs: DataFrame, net: Network) -> DataFrame:
    """All columns of ``docs`` but text, and score (a column of that name is replaced)."""
    docs = docs.drop("score")
    shared = docs.sparkSession.sparkContext.broadcast(net)
    return docs.mapInArrow(_scores(shared), extended(docs.drop("text").schema, "score double"))


def held_out() -> F.Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's rows over the whole ``documents`` table."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    scored = score(docs.select("doc_id", "text"), train(docs, labels, ~held_out()))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
