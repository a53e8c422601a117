"""N-gram Jaccard join by a token-group matrix.

Documents are sets of hashed word shingles.  Two sets link when their Jaccard
similarity is at least 0.8; components of links are the result, so copies and
near copies never have to be listed as pairs.

1. Documents with equal sets form one class (an aggregation by set hash).
2. Similar classes are partitioned into clusters.  Classes that share a pair of
   minimum hashes lie in one bucket; a bucket is cut into lots of about LOT
   classes, the links within a lot are closed, and the class with the most links
   of each closed part goes on to the bucket's next, smaller set of lots, until
   one lot is left.  A bucket of n classes costs n * LOT comparisons.
3. The token-group matrix tells for each token how many clusters hold it.  A
   first matrix has the tokens below a fixed share RANGE of the hash space; a
   class that already there has more tokens of its own cluster than it may miss
   can't link to any other cluster.  The second has all tokens of the classes
   that are left; clusters that share a token which a linking pair must share
   (tokens ordered by the number of clusters that hold them) are asked.
4. A cluster is stored as groups of about GROUP classes.  Where a class asks a
   group, its overlap with the union of the group's tokens is counted: a link of
   sizes a and b shares ``(4a + 4b) / 9`` tokens.  Groups whose union overlaps
   less stay closed.
5. Qualifying groups are opened, and one link to a group is enough.  Every class
   first asks one group of a cluster; links found so far are closed, and the
   other groups are asked only by classes that are not of that cluster by then.
   The result is exact for any partition into clusters and groups.

Edge cases: a text without words has an empty set and stays alone; with fewer
than five words the whole sequence is one shingle; repeated rows, also of one
doc_id, are members of one class or of their own classes by text; a null doc_id
is never a component's id unless all its ids are null; an empty table gives an
empty result; very long texts are handled whole, a set at a time; extra columns,
of any name, are ignored by :func:`join_components` and kept by
:func:`representatives`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.components import connected_components
from ..plans.storage import discard, materialize, sized_join
from .words import U, mix, pieces, shingle_sets

#: Share of the hash space whose tokens the first matrix has.
RANGE = 0.27
#: Pairs of minimum hashes by which similar documents are grouped.
GROUP_KEYS = 3
#: Classes of a bucket that are compared at once, and classes of a stored group.
LOT, GROUP = 128, 128
#: Classes that ask one copy of a group; a group that more ask is read by several tasks.
ASKED = 2_000
#: Clusters of a token whose rows meet in one task; a token of more is dealt in squares.
TOKEN_CLUSTERS = 2_000
#: Elements of a token's pairings held at once.
EXPAND = 250_000
#: Columns of a lot's membership matrix multiplied at once.
COLUMNS = 8192

_LIMIT = int(RANGE * (1 << 63))
_SEEDS = mix(np.arange(77, 77 + 2 * GROUP_KEYS, dtype=U)) | U(1)


def _tokens(shingles: np.ndarray) -> np.ndarray:
    """Shingle hashes as ascending int64 of 63 bits."""
    return np.unique(shingles >> U(1)).view(np.int64)


def _keys(tokens: np.ndarray) -> np.ndarray:
    least = [int((mix(tokens.view(U) * s)).min()) for s in _SEEDS]
    return np.array([mix(np.array([least[2 * k] ^ (least[2 * k + 1] >> 1) ^ k], U))[0] for k in range(GROUP_KEYS)], U).view(np.int64)


def _set_hash(tokens: np.ndarray) -> tuple[int, int]:
    x = mix(tokens.view(U))
    return int(x.sum(dtype=U).view(np.int64)), int(mix(x + U(1)).sum(dtype=U).view(np.int64))


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(parts) if parts else [], pa.int64()))


_NONE = np.zeros(0, np.int64)


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts = batch.column("doc_id"), batch.column("text_hash")
        for piece in pieces(batch.column("text"), True):
            n, low, h1, h2, keys = [], [], [], [], []
            for shingles in shingle_sets(piece):
                tokens = _tokens(shingles)
                a, b = _set_hash(tokens) if len(tokens) else (0, 0)
                n.append(len(tokens))
                low.append(tokens[: np.searchsorted(tokens, _LIMIT)])
                h1.append(a)
                h2.append(b)
                keys.append(_keys(tokens) if len(tokens) else _NONE)
            columns = [*[c.slice(piece.first, piece.n_docs) for c in (ids, texts)], *[pa.array(c, pa.int64()) for c in (n, h1, h2)], _lists(keys), _lists(low)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_hash", "n", "h1", "h2", "keys", "low"])


def linked(both, a, b):
    """Whether sets of sizes a and b with so many common tokens are similar enough."""
    return 100 * both >= 80 * (a + b - both)


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Numbers of common tokens of all pairs of a lot's sets."""
    n = len(sets)
    row = np.repeat(np.arange(n), [len(s) for s in sets])
    token = np.concatenate(sets)
    order = np.argsort(token, kind="stable")
    token, row = token[order], row[order]
    new = np.concatenate([[True], token[1:] != token[:-1]])
    column = np.cumsum(new) - 1
    several = np.bincount(column)[column] > 1
    row, column = row[several], np.cumsum(new & several)[several] - 1
    total = np.zeros((n, n), np.float64)
    for a in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        lo, hi = np.searchsorted(column, [a, a + COLUMNS])
        held = np.zeros((n, int(column[hi - 1]) - a + 1), np.float32)
        held[row[lo:hi], column[lo:hi] - a] = 1
        total += held @ held.T
    return total.astype(np.int64)


def closed(sets: list[np.ndarray]) -> tuple[list[tuple[int, int]], list[int]]:
    """A lot's links, as few as join its parts, and of each part of several sets the one with the most links."""
    size = np.array([len(s) for s in sets])
    link = linked(overlaps(sets), size[:, None], size[None, :])
    np.fill_diagonal(link, False)
    degree = link.sum(axis=1)
    seen, tree, hubs = np.zeros(len(sets), bool), [], []
    for first in np.argsort(-degree, kind="stable"):
        if seen[first] or not degree[first]:
            continue
        hubs.append(int(first))
        seen[first], front = True, [int(first)]
        while front:
            a = front.pop()
            new = np.flatnonzero(link[a] & ~seen)
            seen[new] = True
            tree += [(a, int(b)) for b in new]
            front += new.tolist()
    return tree, hubs


def _runs(batches: Iterator[pa.RecordBatch], by: list[str], lists: str) -> Iterator[tuple[bool, tuple, dict[str, np.ndarray], list[np.ndarray]]]:
    """Runs of equal ``by`` within each batch of sorted rows: (goes on from the batch before, key, columns, lists)."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = {name: batch.column(name).to_numpy(zero_copy_only=False) for name in batch.schema.names if name != lists}
        held = batch.column(lists)
        offsets, values = held.offsets.to_numpy(), held.values.to_numpy(zero_copy_only=False)
        change = np.zeros(batch.num_rows, bool)
        for name in by:
            change[1:] |= columns[name][1:] != columns[name][:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            key = tuple(columns[name][a].item() for name in by)
            yield key == last, key, {name: c[a:b] for name, c in columns.items()}, [values[offsets[k] : offsets[k + 1]] for k in range(a, b)]
            last = key


def _close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, lot, node, tokens), sorted by key and lot -> (key, a, b) for links and (key, a, null) for classes that go on."""
    out: list[tuple] = []
    key, nodes, sets = None, [], []

    def settle() -> None:
        tree, hubs = closed(sets) if len(sets) > 1 else ([], [])
        out.extend((key[0], nodes[a], nodes[b]) for a, b in tree)
        out.extend((key[0], nodes[a], None) for a in hubs)

    def batch() -> pa.RecordBatch:
        rows = list(zip(*out, strict=True)) if out else [(), (), ()]
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in rows], ["key", "a", "b"])

    for more, this, columns, own in _runs(batches, ["key", "lot"], "tokens"):
        if not more:
            settle()
            if len(out) > 10_000:
                yield batch()
            key, nodes, sets = this, [], []
        nodes += columns["node"].tolist()
        sets += [np.array(s) for s in own]
    settle()
    yield batch()


class _Group:
    """A stored group: the union of its classes' tokens, and which class holds which."""

    def __init__(self) -> None:
        self.nodes: list[int] = []
        self.sets: list[np.ndarray] = []
        self.flat: np.ndarray | None = None

    def add(self, nodes: np.ndarray, sets: list[np.ndarray]) -> None:
        self.nodes += nodes.tolist()
        self.sets += [np.array(s) for s in sets]

    def store(self) -> None:
        self.size = np.array([len(s) for s in self.sets])
        flat = np.concatenate(self.sets)
        order = np.argsort(flat, kind="stable")
        self.flat, self.owner = flat[order], np.repeat(np.arange(len(self.sets)), self.size)[order]
        new = np.concatenate([[True], self.flat[1:] != self.flat[:-1]])
        self.union, self.start = self.flat[new], np.append(np.flatnonzero(new), len(flat))

    def ask(self, tokens: np.ndarray) -> int | None:
        """A class of the group that links with these tokens."""
        n = len(tokens)
        fits = (5 * self.size >= 4 * n) & (5 * n >= 4 * self.size)
        if not fits.any():
            return None
        at = np.searchsorted(self.union, tokens)
        at = at[at < len(self.union)]
        at = at[self.union[at] == tokens[: len(at)]]
        if 9 * len(at) < 4 * (n + self.size[fits].min()):
            return None  # the union overlaps less than any link: the group stays closed
        width = self.start[at + 1] - self.start[at]
        spots = np.repeat(self.start[at] - np.cumsum(width) + width, width) + np.arange(width.sum())
        both = np.bincount(self.owner[spots], minlength=len(self.sets))
        hit = np.flatnonzero(fits & linked(both, n, self.size))
        return self.nodes[hit[np.argmax(both[hit])]] if len(hit) else None


def _open(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(cluster, part, copy, asks, node, tokens), sorted so that a group's classes come before those that ask it -> (a, b): links."""
    group, out = _Group(), []
    at = None
    for _, key, columns, sets in _runs(batches, ["cluster", "part", "copy", "asks"], "tokens"):
        if key[:3] != at:
            group, at = _Group(), key[:3]
        if not key[3]:
            group.add(columns["node"], sets)
            continue
        if not group.sets:
            continue
        if group.flat is None:
            group.store()
        for node, tokens in zip(columns["node"].tolist(), sets, strict=True):
            hit = group.ask(tokens)
            if hit is not None:
                out.append((node, hit))
        if len(out) > 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["a", "b"])
            out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["a", "b"])

def _fits(n: np.ndarray, at: np.ndarray, m: np.ndarray, bt: np.ndarray) -> np.ndarray:
    """Sizes fit, and each side's tokens before the shared one are no more than it may miss."""
    share = (4 * (n + m) + 8) // 9
    return (5 * n >= 4 * m) & (5 * m >= 4 * n) & (at <= n - share) & (bt <= m - share)


def _pairings(run: np.ndarray, asks: np.ndarray, cluster: np.ndarray, size: np.ndarray, node: np.ndarray, n: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """(class, own cluster, asked cluster) of rows of one run whose bound holds; of two clusters the smaller one's classes ask.

    Rows are sorted by run; rows that don't ask are the clusters' entries.
    """
    entry, query = np.flatnonzero(~asks), np.flatnonzero(asks)
    begin, end = np.searchsorted(run[entry], run[query], "left"), np.searchsorted(run[entry], run[query], "right")
    total = np.cumsum(end - begin)
    cut = 0
    while cut < len(query):
        base = total[cut - 1] if cut else 0
        to = max(cut + 1, int(np.searchsorted(total, base + EXPAND, "right")))
        width = (end - begin)[cut:to]
        i = np.repeat(query[cut:to], width)
        j = entry[np.repeat(begin[cut:to] - np.cumsum(width) + width, width) + np.arange(width.sum())]
        smaller = (size[i] < size[j]) | ((size[i] == size[j]) & (cluster[i] < cluster[j]))
        good = smaller & _fits(n[i], at[i], n[j], at[j])
        if good.any():
            found = np.unique(np.stack([node[i[good]], cluster[i[good]], cluster[j[good]]]), axis=1)
            yield found[0], found[1], found[2]
        cut = to


def _whole_runs(batches: Iterator[pa.RecordBatch], by: list[str], least: int = 200_000) -> Iterator[pa.Table]:
    """Sorted rows as tables of whole runs of equal ``by``, of about ``least`` rows."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows < least:
            continue
        table = pa.Table.from_batches(held)
        keys = [table.column(name).to_numpy() for name in by]
        last = np.logical_and.reduce([k == k[-1] for k in keys])
        cut = int(np.argmax(last))
        if cut:
            yield table.slice(0, cut)
        rest = table.slice(cut)
        held, rows = rest.to_batches(), rest.num_rows
    if rows:
        yield pa.Table.from_batches(held)


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    by = ["token", "down", "across"]
    for table in _whole_runs(batches, by):
        keys = [table.column(name).to_numpy() for name in by]
        run = np.cumsum(np.concatenate([[True], np.logical_or.reduce([k[1:] != k[:-1] for k in keys])]))
        columns = [table.column(k).to_numpy() for k in ("asks", "cluster", "size", "node", "n", "at")]
        for found in _pairings(run, columns[0] > 0, *columns[1:]):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in found], ["node", "own", "cluster"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, h1, text) -> (node, tokens); rows of other sets than the class's go."""
    for batch in batches:
        nodes, wanted = batch.column("node"), batch.column("h1").to_numpy()
        for piece in pieces(batch.column("text"), True):
            keep, sets = [], []
            for k, shingles in enumerate(shingle_sets(piece)):
                tokens = _tokens(shingles)
                if len(tokens) and _set_hash(tokens)[0] == wanted[piece.first + k]:
                    keep.append(piece.first + k)
                    sets.append(tokens)
            if keep:
                yield pa.RecordBatch.from_arrays([nodes.take(pa.array(keep)), _lists(sets)], ["node", "tokens"])


def _tokens_of(docs: DataFrame, classes: DataFrame, name: str) -> DataFrame:
    """(node, tokens) of the classes (node, doc_id, h1), read from their documents' texts."""
    wanted = materialize(classes.select(F.col("doc_id").alias("_id"), "node", "h1"), f"{name}-wanted")
    texts = sized_join(docs, wanted, F.col("doc_id").eqNullSafe(F.col("_id")), "inner", 40).select("node", "h1", "text")
    sets = materialize(texts.mapInArrow(_sets, "node bigint, tokens array<bigint>"), f"{name}-sets")
    # Rows of one doc_id may be of one class.
    if sets.groupBy("node").agg(F.count("*").alias("k")).where("k > 1").isEmpty():
        return sets
    return materialize(sets.dropDuplicates(["node"]), f"{name}-once")


def _share(n: str, of: int) -> Column:
    """The number of parts of about ``of`` rows."""
    return F.greatest(F.lit(1), F.ceil(F.col(n) / of))


def _clusters(docs: DataFrame, sketches: DataFrame, members: DataFrame) -> DataFrame:
    """(node, cluster, size) of classes that are linked with another one of their buckets."""
    keys = sketches.select(F.col("row").alias("node"), F.explode("keys").alias("key"))
    keyed = materialize(sized_join(keys, members.select("node"), "node", "left_semi", 16), "ngram-keys")
    buckets = keyed.groupBy("key").agg(F.count("*").alias("k"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("held")).where("k > 1")
    buckets = materialize(buckets.groupBy("k", "held").agg(F.min("key").alias("key")), "ngram-buckets")  # equal buckets are compared once
    rows = materialize(keyed.join(buckets.select("key", "k"), "key"), "ngram-lots")
    sets = _tokens_of(docs, members.join(rows.select("node").distinct(), "node", "left_semi"), "ngram-similar")
    links, level = None, 0
    while not rows.isEmpty():
        lots = rows.withColumn("lot", F.pmod(F.xxhash64("node", F.lit(level)), _share("k", LOT)))
        work = lots.join(sets, "node").select("key", "lot", "node", "tokens").repartition("key", "lot").sortWithinPartitions("key", "lot")
        found = materialize(work.mapInArrow(_close, "key bigint, a bigint, b bigint"), "ngram-closed")
        own = found.where("b is not null").select("a", "b")
        links = own if links is None else links.union(own)
        # Of buckets with several lots, the best linked class of each closed part goes on.
        on = found.where("b is null").join(rows.where(f"k > {LOT}").select("key").distinct(), "key", "left_semi").select("key", F.col("a").alias("node")).distinct()
        k = on.groupBy("key").agg(F.count("*").alias("k")).where("k > 1")
        rows, level = materialize(on.join(k, "key"), "ngram-lots"), level + 1
    components = materialize(connected_components(links if links is not None else members.selectExpr("node as a", "node as b").limit(0)), "ngram-clusters")
    sizes = materialize(components.groupBy(F.col("component").alias("cluster")).agg(F.count("*").alias("size")), "ngram-sizes")
    discard(sets)
    named = sized_join(components.withColumnRenamed("component", "cluster"), sizes, "cluster", "inner", 24)
    return materialize(named.select("node", "cluster", "size"), "ngram-sized")


def _held_elsewhere(low: DataFrame, grouped: DataFrame) -> DataFrame:
    """The classes that may link to another cluster by the first matrix; low (node, low): tokens below _LIMIT."""
    low = sized_join(low, grouped.select("node", "cluster"), "node", "inner", 32)
    rows = low.select("node", "cluster", F.explode("low").alias("token"))
    several = rows.groupBy("token").agg(F.min("cluster").alias("lo"), F.max("cluster").alias("hi")).where("lo < hi").select("token")
    counted = rows.join(several, "token").groupBy("node").agg(F.count("*").alias("held"))
    may_miss = F.floor(F.col("n") / 5)  # in the smallest set that it can link to
    return grouped.join(counted, "node", "left").where(F.col("n_low") - F.coalesce("held", F.lit(0)) <= may_miss).drop("held")


def _asking(left: DataFrame, sets: DataFrame) -> DataFrame:
    """(node, own, cluster): clusters whose groups may overlap a class of another cluster enough, by the second matrix."""
    own = sized_join(sets, left.select("node", "cluster"), "node", "inner", 32)
    rows = own.select("node", "cluster", F.explode("tokens").alias("token"))
    clusters = rows.groupBy("token", "cluster").agg(F.count("*").alias("k")).groupBy("token").agg(F.count("*").alias("clusters")).where("clusters > 1")
    held = rows.join(clusters, "token").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("clusters", "token"))).alias("held"))  # a class's own tokens
    alone = F.col("n") - F.size("held")
    first = F.slice("held", F.lit(1), F.greatest(F.lit(0), F.floor(F.col("n") / 5) + 1 - alone).cast("int"))
    matrix = left.join(held, "node").select("node", "cluster", "size", "n", alone.cast("bigint").alias("alone"), F.posexplode(first).alias("k", "h"))
    matrix = materialize(matrix.select(F.col("h.token").alias("token"), "cluster", "size", "node", "n", (F.col("alone") + F.col("k")).alias("at")), "ngram-matrix")

    # A token's largest cluster never asks; rows of tokens that many hold are dealt over several tasks.
    by_cluster = matrix.groupBy("token", "cluster", "size").agg(F.count("*").alias("k"))
    tokens = by_cluster.groupBy("token").agg(F.count("*").alias("clusters"), F.sum("k").alias("rows"), F.max(F.struct("size", "cluster")).alias("top")).where("clusters > 1")
    tokens = materialize(tokens.select("token", "top", _share("clusters", TOKEN_CLUSTERS).alias("width"), _share("rows", 10 * TOKEN_CLUSTERS).alias("height")), "ngram-tokens")
    dealt = sized_join(matrix, tokens, "token", "inner", 48)
    nth = lambda key, n: F.pmod(F.xxhash64(key), F.col(n))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
    asks = dealt.where(F.struct("size", "cluster") < F.col("top")).select("token", nth("node", "height").alias("down"), each("width").alias("across"), F.lit(1).alias("asks"), "cluster", "size", "node", "n", "at")
    entries = dealt.groupBy("token", "cluster", "size", "n", "width", "height").agg(F.min("at").alias("at"))
    entries = entries.select("token", each("height").alias("down"), nth("cluster", "width").alias("across"), F.lit(0).alias("asks"), "cluster", "size", F.lit(0).cast("bigint").alias("node"), "n", "at")
    both = asks.unionByName(entries).repartition("token", "down", "across").sortWithinPartitions("token", "down", "across")
    return both.mapInArrow(_candidates, "node bigint, own bigint, cluster bigint").distinct()


def _opened(asks: DataFrame, stored: DataFrame, sets: DataFrame, name: str) -> DataFrame:
    """asks (node, cluster, part) of groups stored (node, cluster, part) -> one link (a, b) for each class and group that link."""
    load = asks.groupBy("cluster", "part").agg(F.count("*").alias("k")).select("cluster", "part", _share("k", ASKED).alias("copies"))
    load = materialize(load, f"{name}-load")
    queries = sized_join(asks, load, ["cluster", "part"], "inner", 40).select("cluster", "part", F.pmod(F.xxhash64("node"), F.col("copies")).alias("copy"), F.lit(1).alias("asks"), "node")
    classes = sized_join(stored, load, ["cluster", "part"], "inner", 40).select("cluster", "part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("copies") - 1)).alias("copy"), F.lit(0).alias("asks"), "node")
    rows = queries.unionByName(classes).join(sets, "node").select("cluster", "part", "copy", "asks", "node", "tokens")
    rows = rows.repartition("cluster", "part", "copy").sortWithinPartitions("cluster", "part", "copy", "asks", "node")
    return materialize(rows.mapInArrow(_open, "a bigint, b bigint"), f"{name}-links")


def _joined_clusters(docs: DataFrame, left: DataFrame) -> DataFrame:
    """(cluster, component): clusters of the classes in ``left`` that are linked with others, by opened groups."""
    sets = _tokens_of(docs, left, "ngram-left")
    asking = materialize(_asking(left, sets), "ngram-asking")
    large = left.groupBy("cluster").agg(F.count("*").alias("here")).where(f"here > {GROUP}")
    large = materialize(large.select("cluster", _share("here", GROUP).alias("parts")), "ngram-large")
    stored = sized_join(left, large, "cluster", "left", 24).withColumn("parts", F.coalesce("parts", F.lit(1).cast("bigint")))
    stored = materialize(stored.select("node", "cluster", "parts", F.pmod(F.xxhash64("node", F.lit(1)), F.col("parts")).alias("part")), "ngram-stored")
    asked = asking.join(stored.select("cluster", "parts").distinct(), "cluster").withColumn("first", F.pmod(F.xxhash64("node", F.lit(2)), F.col("parts")))
    asked = materialize(asked, "ngram-asked")
    places = stored.select("node", "cluster", "part")
    by_node = stored.select("node", "cluster")

    def between(links: DataFrame) -> DataFrame:
        ends = links.join(by_node.select(F.col("node").alias("a"), F.col("cluster").alias("ca")), "a").join(by_node.select(F.col("node").alias("b"), F.col("cluster").alias("cb")), "b")
        return ends.select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct()

    links = between(_opened(asked.select("node", "cluster", F.col("first").alias("part")), places, sets, "ngram-first"))
    links = materialize(links, "ngram-first-clusters")
    rest = asked.where("parts > 1")
    if not rest.isEmpty():
        known = materialize(connected_components(links), "ngram-known")
        for side in ("own", "cluster"):
            rest = sized_join(rest, known.select(F.col("node").alias(side), F.col("component").alias(f"{side}_of")), side, "left", 24).withColumn(f"{side}_of", F.coalesce(f"{side}_of", side))
        rest = rest.where("own_of <> cluster_of").select("node", "cluster", "first", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("part")).where("part <> first")
        rest = materialize(rest.select("node", "cluster", "part"), "ngram-rest")
        if not rest.isEmpty():
            links = materialize(links.union(between(_opened(rest, places, sets, "ngram-second"))), "ngram-cluster-links")
    out = materialize(connected_components(links).select(F.col("node").alias("cluster"), "component"), "ngram-components")
    discard(sets)
    return out


def _components(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> one row per row: doc_id, text_hash, n, component (null without words) and component_id."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    fields = "doc_id bigint, text_hash bigint, n bigint, h1 bigint, h2 bigint, keys array<bigint>, low array<bigint>"
    sketches = docs.withColumn("text_hash", F.xxhash64("text")).mapInArrow(_sketches, fields)
    whole = materialize(sketches.withColumn("row", F.monotonically_increasing_id()), "ngram-sketches")
    sketches = materialize(whole.select("doc_id", "text_hash", "row", "n", "h1", "h2", "keys", F.size("low").cast("bigint").alias("n_low")), "ngram-rows")

    # 1. classes of equal sets; the class's node is the row of its least doc_id
    by_set = ["h1", "h2", "n"]
    least = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row", "n_low")).alias("m")
    members = sketches.where("n > 0").groupBy(*by_set).agg(least)
    members = members.select(*by_set, F.col("m.doc_id").alias("doc_id"), F.col("m.row").alias("node"), F.col("m.n_low").alias("n_low"))
    members = materialize(members, "ngram-members")

    # 2. clusters of similar classes
    clusters = _clusters(docs, sketches, members)
    grouped = sized_join(members, clusters, "node", "left", 40).withColumn("cluster", F.coalesce("cluster", "node")).withColumn("size", F.coalesce("size", F.lit(1)))
    grouped = materialize(grouped, "ngram-grouped")

    # 3. to 5. qualifying groups are opened
    left = materialize(_held_elsewhere(whole.select(F.col("row").alias("node"), "low"), grouped), "ngram-left")
    discard(whole)
    components = _joined_clusters(docs, left)
    named = sized_join(grouped, components, "cluster", "left", 32).withColumn("component", F.coalesce("component", "cluster"))
    named = materialize(named.select(*by_set, "doc_id", "component"), "ngram-named")
    ids = named.groupBy("component").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("k")).where("k > 1")
    ids = materialize(ids.select("component", "component_id"), "ngram-least")
    named = sized_join(named, ids, "component", "left", 24).withColumn("component_id", F.coalesce("component_id", "doc_id"))
    ids = materialize(named.select(*by_set, "component", "component_id"), "ngram-ids")
    some = sketches.where("n > 0").select("doc_id", "text_hash", *by_set).join(ids, by_set).select("doc_id", "text_hash", "n", "component", "component_id")
    none = sketches.where("n = 0").select("doc_id", "text_hash", "n", F.lit(None).cast("bigint").alias("component"), F.col("doc_id").alias("component_id"))
    return some.unionByName(none)


def join_components(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> one row per row of docs: doc_id, n_shingles, component_id."""
    return _components(docs).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def representatives(docs: DataFrame) -> DataFrame:
    """One row of ``docs``, all columns, of each component: that of the least doc_id (nulls last), of such rows that of the least text hash.

    Of rows with that id and text any one stays.  Rows without words all stay.
    """
    rows = materialize(_components(docs).where("n > 0").groupBy("component", "doc_id", "text_hash").agg(F.count("*").alias("k")), "ngram-rows")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")).alias("m")
    several = rows.groupBy("component").agg(first, F.count("*").alias("n")).where("n > 1")
    several = materialize(several.select("component", F.col("m.doc_id").alias("first_id"), F.col("m.text_hash").alias("first_hash")), "ngram-firsts")
    rows = sized_join(rows, several, "component", "left", 32)
    first = F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("text_hash") == F.col("first_hash"))
    rows = rows.withColumn("stays", F.col("first_hash").isNull() | first)
    out = materialize(rows.where("not stays or k > 1").select("doc_id", "text_hash", "stays"), "ngram-gone")
    same = F.col("_docs_.doc_id").cast("bigint").eqNullSafe(F.col("_gone_.doc_id")) & (F.xxhash64("_docs_.text") == F.col("_gone_.text_hash"))
    kept = sized_join(docs.alias("_docs_"), out.alias("_gone_"), same, "left_anti", 32)
    again = out.where("stays")
    if again.isEmpty():
        return kept
    return kept.unionByName(sized_join(docs.alias("_docs_"), again.alias("_gone_"), same, "left_semi", 32).dropDuplicates(["doc_id", "text"]))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's rows over the whole ``documents`` table."""
    return join_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: DuckDB: shingles as strings, candidates by a shared shingle, closure by recursion.
OP4_SQL = r"""
with recursive tokenised as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
shingles as (
  select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
    else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end) as s from tokenised),
sets as (select doc_id, count(*) as n, bit_xor(hash(s)) as h1, sum(hash(s)::hugeint) as h2 from shingles group by doc_id),
classes as (select doc_id, n, min(doc_id) over (partition by h1, h2, n) as rep from sets),
reps as (select doc_id, n from classes where rep = doc_id),
held as (select s.doc_id, s.s, r.n from shingles s join reps r using (doc_id)),
shared as (
  select a.doc_id as a, b.doc_id as b, a.n as na, b.n as nb, count(*) as c
  from held a join held b on a.s = b.s and a.doc_id < b.doc_id and 5 * a.n >= 4 * b.n and 5 * b.n >= 4 * a.n
  group by all),
links as (select a, b from shared where 100 * c >= 80 * (na + nb - c)),
edges as (select a, b from links union all select b, a from links),
reach(node, root) as (
  select doc_id, doc_id from reps
  union
  select e.b, r.root from reach r join edges e on e.a = r.node where r.root < e.b),
roots as (select node, min(root) as component from reach group by node)
select t.doc_id, coalesce(c.n, 0)::bigint as n_shingles, coalesce(r.component, t.doc_id) as component_id
from tokenised t left join classes c using (doc_id) left join roots r on r.node = c.rep
"""
