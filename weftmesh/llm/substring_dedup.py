"""Substring dedup by seed and extend: repeats of 50 words or more go, their first copy stays.

Seeds.  Every window of 50 words has an anchor: the least hash among its 10-word
grams (winnowing).  Two documents that hold one window hold its anchor, so
documents are joined on anchors; an anchor of one document only is no seed.

Extension.  Each seed is extended both ways, word by word, against the words
around the anchor in its first holder (the document with the least id), as far
as windows with that anchor reach there.  A match of 50 words or more is a
repeat, kept as an interval; overlapping intervals make maximal repeats.

An anchor of two documents is settled by that.  Of an anchor of more, windows
that the first holder hasn't may still be shared by others: only those windows
get a fingerprint of their words, and the least document id that holds one is
found by an aggregation, not by pairs of documents.  A passage held by a third
of all documents so costs each of them an extension, not a row a window.

Copies of a whole text are found first, by a hash of the sequence; only the copy
with the least id goes on.

Edge cases: null text has no words; texts under 50 words are kept; a null doc_id
counts as larger than any other; rows of one doc_id never remove each other's
words; equal rows lose equal words; very long texts are handled whole, one at a
time; an empty table gives an empty result; extra columns, of any name, are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.storage import discard, materialize, sized_join, small_enough
from .words import U, Piece, grams, mix, pieces, rolling

WINDOW, GRAM = 50, 10
#: Bytes of a word's hash that matches are extended by.
WORD_BYTES = 6
#: Rows of one fingerprint that may meet in one task; fingerprints of more are joined by themselves.
HEAVY = 1_000


def _anchors(hashes: np.ndarray, window: int, gram: int) -> np.ndarray:
    """The least gram hash of each window, by doubling."""
    least, width = grams(hashes, gram), 1
    span = window - gram + 1
    while 2 * width <= span:
        least = np.minimum(least[:-width], least[width:]) if len(least) > width else least[:0]
        width *= 2
    rest = span - width
    if rest:
        least = np.minimum(least[:-rest], least[rest:]) if len(least) > rest else least[:0]
    return least


def _sequence_hashes(piece: Piece) -> tuple[np.ndarray, np.ndarray]:
    n = np.diff(piece.at)
    place = np.arange(len(piece.hashes), dtype=U) - np.repeat(piece.at[:-1], n).astype(U)
    out = []
    for salt in (U(11), U(12)):
        sums = np.zeros(len(piece.hashes) + 1, U)
        np.cumsum(mix(piece.hashes + mix(place + salt)), out=sums[1:])
        out.append((sums[piece.at[1:]] - sums[piece.at[:-1]]).view(np.int64))
    return out[0], out[1]


def _lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(parts) if parts else [], kind))


def _sketches(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id")
            for piece in pieces(batch.column("text"), False):
                h1, h2 = _sequence_hashes(piece)
                least = _anchors(piece.hashes, window, gram).view(np.int64)
                seeds = [np.unique(least[a : max(a, b - window + 1)]) for a, b in zip(piece.at[:-1], piece.at[1:], strict=True)]
                cols = [ids.slice(piece.first, piece.n_docs), pa.array(np.diff(piece.at), pa.int64()), pa.array(h1), pa.array(h2), _lists(seeds, pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, ["id", "n", "h1", "h2", "anchors"])

    return run


def _packed(words: list[np.ndarray]) -> pa.BinaryArray:
    """Word hashes cut to WORD_BYTES bytes each, a row for each array."""
    flat = np.concatenate(words) if words else np.zeros(0, U)
    data = np.ascontiguousarray(flat.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :WORD_BYTES])
    offsets = np.concatenate([[0], np.cumsum([WORD_BYTES * len(w) for w in words])]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(words), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def _unpacked(data: np.ndarray) -> np.ndarray:
    wide = np.zeros((len(data) // WORD_BYTES, 8), np.uint8)
    wide[:, :WORD_BYTES] = data.reshape(-1, WORD_BYTES)
    return wide.view("<u8").ravel()


def _contexts(window: int, gram: int):
    """(node, h1, anchors, text) of first holders -> (anchor, words, center, once): the words of all windows with that anchor at its first place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted, held = batch.column("h1").to_numpy(), batch.column("anchors")
            offsets, values = held.offsets.to_numpy(), held.values.to_numpy()
            for piece in pieces(batch.column("text"), False):
                h1, _ = _sequence_hashes(piece)
                every, least = grams(piece.hashes, gram).view(np.int64), _anchors(piece.hashes, window, gram).view(np.int64)
                out: list[list] = [[], [], [], []]
                for k in range(piece.n_docs):
                    row, a, b = piece.first + k, piece.at[k], piece.at[k + 1]
                    if h1[k] != wanted[row] or b - a < window:
                        continue
                    mine = least[a : b - window + 1]
                    places, begin = np.unique(_first_places(every[a : b - gram + 1], mine), return_index=True)
                    end = np.append(begin[1:], len(mine)) + window - 1
                    anchor = mine[begin]
                    known = np.isin(anchor, values[offsets[row] : offsets[row + 1]])
                    _, first, back, n = np.unique(anchor, return_index=True, return_inverse=True, return_counts=True)
                    for j in np.flatnonzero(known & (first[back] == np.arange(len(anchor)))):
                        for c, v in zip(out, (anchor[j], piece.hashes[a + begin[j] : a + end[j]], places[j] - begin[j], n[back[j]] == 1), strict=True):
                            c.append(v)
                if out[0]:
                    cols = [pa.array(out[0], pa.int64()), _packed(out[1]), pa.array(out[2], pa.int32()), pa.array(out[3], pa.bool_())]
                    yield pa.RecordBatch.from_arrays(cols, ["anchor", "words", "center", "once"])

    return run


def extended(own: np.ndarray, at: int, words: np.ndarray, center: int) -> tuple[int, int]:
    """The match of ``own`` with ``words`` around own[at] and words[center]: its start and end in ``own``."""
    back = min(at, center)
    same = own[at - back : at] == words[center - back : center]
    left = back if same.all() else int(np.argmin(same[::-1]))
    ahead = min(len(own) - at, len(words) - center)
    same = own[at : at + ahead] == words[center : center + ahead]
    right = ahead if same.all() else int(np.argmin(same))
    return at - left, at + right


def _extend(window: int, gram: int):
    """Seeds of documents -> (node, from, to) repeats by the first holder, and (node, print, from) windows that it leaves open."""

    def document(own: np.ndarray, least: np.ndarray, places: np.ndarray, seeds: _Seeds, order: np.ndarray, own_id: int | None) -> tuple[list, np.ndarray]:
        """own: word hashes; least: anchor by window; places: place of the anchor of each window; order: the document's seeds by anchor."""
        spans: list[tuple[int, int]] = []
        open_ = np.zeros(len(least), bool)
        at, first = np.unique(places, return_index=True)
        spot = np.minimum(np.searchsorted(seeds.anchor[order], least[first]), len(order) - 1)
        known = seeds.anchor[order[spot]] == least[first]
        for p, start, stop, seed, good in zip(at.tolist(), first.tolist(), [*first[1:].tolist(), len(least)], order[spot].tolist(), known.tolist(), strict=True):
            if not good:
                continue
            a, b = extended(own, p, seeds.words(seed), seeds.center[seed])
            if b - a >= window and not seeds.no_first[seed] and (own_id is None or own_id > seeds.first_id[seed]):
                if spans and a <= spans[-1][1]:
                    spans[-1] = (min(a, spans[-1][0]), max(b, spans[-1][1]))
                else:
                    spans.append((a, b))
            if not seeds.settled[seed]:
                starts = np.arange(start, stop)
                open_[start:stop] = (starts < a) | (starts + window > b)
        return spans, np.flatnonzero(open_)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, seeds = batch.column("id").to_pylist(), _Seeds(batch.column("seeds"))
            for piece in pieces(batch.column("text"), False):
                h1, _ = _sequence_hashes(piece)
                every = grams(piece.hashes, gram).view(np.int64)
                least, prints = _anchors(piece.hashes, window, gram).view(np.int64), rolling(piece.hashes, window).view(np.int64)
                hashes = piece.hashes & U((1 << 8 * WORD_BYTES) - 1)
                owner, out = [], [[], [], [], [], []]
                for k in range(piece.n_docs):
                    row, a, b = piece.first + k, piece.at[k], piece.at[k + 1]
                    own = seeds.of(row, h1[k], ids[row])
                    if not len(own) or b - a < window:
                        continue
                    mine = least[a : b - window + 1]
                    places = _first_places(every[a : b - gram + 1], mine)
                    spans, rest = document(hashes[a:b], mine, places, seeds, own, ids[row])
                    starts = np.array([s for s, _ in spans] + rest.tolist(), np.int64)
                    ends = np.array([e for _, e in spans] + (rest + window).tolist(), np.int64)
                    fresh = np.concatenate([np.zeros(len(spans), np.int64), prints[a : b - window + 1][rest]])
                    is_open = np.arange(len(starts)) >= len(spans)
                    owner += [ids[row]] * len(starts)
                    for c, v in zip(out, (np.full(len(starts), seeds.node[own[0]], np.int64), starts, ends, is_open, fresh), strict=True):
                        c.append(v)
                if owner:
                    yield pa.RecordBatch.from_arrays([pa.array(owner, pa.int64()), *[pa.array(np.concatenate(c)) for c in out]], ["id", "node", "from", "to", "open", "print"])

    return run


class _Seeds:
    """The seeds of a batch's documents as flat arrays; those of row k are at[k]:at[k + 1]."""

    def __init__(self, column: pa.ListArray):
        seeds = column.values
        self.at = column.offsets.to_numpy()
        plain = lambda name: seeds.field(name).to_numpy(zero_copy_only=False)
        self.anchor, self.node, self.h1, self.settled = (plain(name) for name in ("anchor", "node", "h1", "settled"))
        self.id, self.no_id = seeds.field("id").fill_null(0).to_numpy(zero_copy_only=False), seeds.field("id").is_null().to_numpy(zero_copy_only=False)
        self.first_id, self.no_first = seeds.field("first_id").fill_null(0).to_numpy(zero_copy_only=False), seeds.field("first_id").is_null().to_numpy(zero_copy_only=False)
        self.center = seeds.field("center").fill_null(0).to_numpy(zero_copy_only=False)
        words = seeds.field("words").fill_null(b"")
        self._at = np.frombuffer(words.buffers()[1], np.int32)[words.offset :]
        self._words = np.frombuffer(words.buffers()[2], np.uint8) if words.buffers()[2] else np.zeros(0, np.uint8)

    def of(self, row: int, h1: int, own_id: int | None) -> np.ndarray:
        """The seeds of a row's text, in the order of their anchors."""
        some = np.arange(self.at[row], self.at[row + 1])
        some = some[(self.h1[some] == h1) & (self.no_id[some] if own_id is None else ~self.no_id[some] & (self.id[some] == own_id))]
        return some[np.argsort(self.anchor[some], kind="stable")]

    def words(self, k: int) -> np.ndarray:
        return _unpacked(self._words[self._at[k] : self._at[k + 1]])


def _first_places(own: np.ndarray, least: np.ndarray) -> np.ndarray:
    """For each window the first place from its start on whose gram is the window's least one; these rise with the windows."""
    values, code = np.unique(own, return_inverse=True)
    order = np.argsort(code, kind="stable")
    size = len(own) + 1
    key = code[order] * size + order
    return order[np.searchsorted(key, np.searchsorted(values, least) * size + np.arange(len(least)))]


def _kept(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = batch.column("marks")
            for piece in pieces(batch.column("text"), False):
                h1, h2 = _sequence_hashes(piece)
                n, removed, texts = np.diff(piece.at), np.zeros(piece.n_docs, np.int64), []
                for k in range(piece.n_docs):
                    a, b = piece.at[k], piece.at[k + 1]
                    words = piece.data[piece.start[a] : piece.end[b - 1]].tobytes().split() if b > a else []
                    mark = marks[piece.first + k]
                    if mark.is_valid:
                        mine = next((m for m in mark.as_py() if m["h1"] == h1[k] and m["h2"] == h2[k]), None)
                        if mine is not None:
                            keep = np.full(len(words), not mine["whole"])
                            for span in mine["spans"]:
                                keep[span["from"] : span["to"]] = False
                            removed[k] = len(words) - int(keep.sum())
                            words = [w for w, good in zip(words, keep, strict=True) if good]
                    texts.append(b" ".join(words).decode("utf-8"))
                others = [c.slice(piece.first, piece.n_docs) for c in batch.columns[:-2]]
                yield pa.RecordBatch.from_arrays([*others, pa.array(n, pa.int64()), pa.array(removed), pa.array(texts, pa.string())], [*batch.schema.names[:-2], "n_words", "n_removed", "kept_text"])

    return run


def _by_key(rows: DataFrame, table: DataFrame, key: str, width: int) -> DataFrame:
    """Inner join with (key, k, ...), k the number of rows of a key.

    Keys that many rows hold are few (one in HEAVY rows at most), so their rows are joined by themselves and,
    while the keys' counted size allows it, without a shuffle.
    """
    heavy = table.where(f"k > {HEAVY}")
    if heavy.isEmpty():
        return sized_join(rows, table.drop("k"), key, "inner", width)
    rest = sized_join(rows, heavy.select(key), key, "left_anti", 16)
    light = sized_join(rest, table.where(f"k <= {HEAVY}").drop("k"), key, "inner", width)
    return light.unionByName(sized_join(rows, heavy.drop("k"), key, "inner", width))


def _shared_windows(windows: DataFrame, window: int) -> DataFrame:
    """(id, node, from, print) -> (id, node, from, to): runs of windows that a document with a smaller id holds."""
    least = windows.groupBy("print").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.max(F.col("id").isNull()).alias("none"), F.count("*").alias("k"))
    least = materialize(least.where("lo < hi or (lo is not null and none)").select("print", "lo", "k"), "repeats-prints")
    later = _by_key(windows, least, "print", 24).where("id is null or id > lo").select("id", "node", "from")
    # Windows that follow each other by less than a window make one run: a row that ends where the next gap begins.
    by_place = Window.partitionBy("node", "id").orderBy("from")
    new = F.coalesce(F.col("from") - F.lag("from").over(by_place) > window, F.lit(True)).cast("int")
    runs = later.withColumn("new", new).withColumn("nth", F.sum("new").over(by_place))
    return runs.groupBy("id", "node", "nth").agg(F.min("from").alias("from"), (F.max("from") + window).alias("to")).drop("nth")


def dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(doc_id, text) -> one row per row: doc_id, n_words, n_removed, kept_text (kept words, one space apart)."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    with_id = docs.withColumnRenamed("doc_id", "id")
    sketches = with_id.mapInArrow(_sketches(window, gram), "id bigint, n bigint, h1 bigint, h2 bigint, anchors array<bigint>")
    sketches = materialize(sketches.where(f"n >= {window}").withColumn("node", F.monotonically_increasing_id()), "repeats-sketches")

    # Whole copies: only the first goes on, the others are removed as a whole.
    sequence = ["h1", "h2", "n"]
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "node")).alias("first")
    firsts = sketches.groupBy(*sequence).agg(first, F.count("*").alias("k"))
    firsts = materialize(firsts.select(*sequence, F.col("first.id").alias("first_id"), F.col("first.node").alias("node"), "k"), "repeats-firsts")
    copies = sketches.select("id", *sequence).join(firsts.where("k > 1").select(*sequence, "first_id"), sequence).where("first_id is not null and (id is null or id > first_id)")
    spans = "array<struct<from:bigint,to:bigint>>"
    whole = copies.select("id", "h1", "h2").distinct().select("id", F.struct("h1", "h2", F.lit(True).alias("whole"), F.array().cast(spans).alias("spans")).alias("mark"))

    # Seeds: anchors of more than one document, each with its first holder.
    held = sized_join(sketches, firsts.select("node"), "node", "left_semi", 16)
    anchors = materialize(held.select("node", "id", "h1", F.explode("anchors").alias("anchor")), "repeats-anchors")
    shared = anchors.groupBy("anchor").agg(first, F.min("id").alias("lo"), F.max("id").alias("hi"), F.max(F.col("id").isNull()).alias("none"), F.count("*").alias("k"))
    shared = shared.where("lo < hi or (lo is not null and none)").select("anchor", F.col("first.id").alias("first_id"), F.col("first.node").alias("first_node"), "k")
    shared = materialize(shared, "repeats-shared")

    # The words around each anchor in its first holder.
    names = firsts.select("node", F.col("first_id").alias("_id"), "h1", "h2")
    holders = shared.groupBy(F.col("first_node").alias("node")).agg(F.collect_list("anchor").alias("anchors"))
    holders = materialize(holders.join(names, "node"), "repeats-holders")
    contexts = sized_join(with_id, holders, F.col("id").eqNullSafe(F.col("_id")), "inner", _measured(holders, F.size("anchors") * 8 + 40)).select("node", "h1", "anchors", "text")
    contexts = contexts.mapInArrow(_contexts(window, gram), "anchor bigint, words binary, center int, once boolean")
    contexts = materialize(contexts, "repeats-contexts")
    around = contexts.groupBy("anchor").agg(F.first(F.struct("words", "center", "once")).alias("c"))  # rows of one id may repeat
    settled = F.coalesce("c.once", F.lit(False)) & (F.col("k") == 2)
    around = shared.join(around, "anchor", "left").select("anchor", "k", "first_id", "c.words", "c.center", settled.alias("settled"))

    # Extension of every seed against its first holder: seeds meet their documents' texts by a hash of the id.
    heavy = shared.where(f"k > {HEAVY}").select("anchor")
    if heavy.isEmpty():
        seeds = anchors.join(around.drop("k"), "anchor")
    else:  # anchors that many documents hold are few: their rows are joined by themselves
        seeds = sized_join(anchors, heavy, "anchor", "left_anti", 16).join(around.where(f"k <= {HEAVY}").drop("k"), "anchor")
        seeds = seeds.unionByName(sized_join(anchors, materialize(around.where(f"k > {HEAVY}").drop("k"), "repeats-heavy"), "anchor", "inner", 600))
    seeds = seeds.groupBy(F.xxhash64("id").alias("key")).agg(F.collect_list(F.struct("id", "node", "h1", "anchor", "first_id", "words", "center", "settled")).alias("seeds"))
    seeded = materialize(sized_join(anchors, shared.select("anchor"), "anchor", "left_semi", 16).select(F.xxhash64("id").alias("key")).distinct(), "repeats-seeded")
    keyed = with_id.withColumn("key", F.xxhash64("id"))
    if small_enough(seeded, 16):  # then only texts with seeds are moved
        keyed = keyed.join(F.broadcast(seeded), "key", "left_semi")
    texts = keyed.join(seeds, "key").select("id", "seeds", "text")
    found = texts.mapInArrow(_extend(window, gram), "id bigint, node bigint, `from` bigint, `to` bigint, `open` boolean, print bigint")
    found = materialize(found, "repeats-found")
    discard(contexts, anchors)

    parts = found.where("not open").select("id", "node", "from", "to").unionByName(_shared_windows(found.where("open").select("id", "node", "from", "print"), window))
    parts = parts.groupBy("id", "node").agg(F.array_sort(F.collect_set(F.struct("from", "to"))).alias("spans"))
    parts = parts.join(names.select("node", "h1", "h2"), "node").select("id", F.struct("h1", "h2", F.lit(False).alias("whole"), "spans").alias("mark"))

    marks = whole.unionByName(parts).groupBy(F.col("id").alias("_id")).agg(F.collect_list("mark").alias("marks"))
    marks = materialize(marks, "repeats-marks")
    width = _measured(marks, F.aggregate("marks", F.lit(24), lambda n, m: n + 32 + 16 * F.size(m["spans"])))
    joined = sized_join(docs, marks, F.col("doc_id").eqNullSafe(F.col("_id")), "left", width)
    return joined.select("doc_id", "text", "marks").mapInArrow(_kept(window), "doc_id bigint, n_words bigint, n_removed bigint, kept_text string")


def _measured(table: DataFrame, width) -> int:
    """The mean bytes of a row, counted over the whole table."""
    return int(table.agg(F.avg(width)).head()[0] or 1) + 1


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's digest over the whole ``documents`` table."""
    kept = dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


#: DuckDB: every window as a string of its words.
OP10_SQL = r"""
with tokenised as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
windows as (
  select doc_id, p, md5(array_to_string(w[p:p + 49], ' ')) as s
  from (select doc_id, w, unnest(range(1, len(w) - 48)) as p from tokenised where len(w) >= 50)),
firsts as (select s, min(doc_id) as lo from windows group by s),
gone as (
  select distinct doc_id, unnest(range(p, p + 50)) as i
  from windows join firsts using (s) where doc_id > lo),
removed as (select doc_id, list(i) as gone from gone group by doc_id),
kept as (
  select doc_id, len(w) as n, case when gone is null then w else list_filter(list_zip(w, range(1, len(w) + 1)), lambda x: not list_contains(gone, x[2])).list_transform(lambda x: x[1]) end as k
  from tokenised left join removed using (doc_id))
select doc_id, n::bigint as n_words, (n - len(k))::bigint as n_removed, sha256(array_to_string(k, ' ')) as kept_sha256 from kept
"""
