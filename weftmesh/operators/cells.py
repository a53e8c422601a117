"""Cell ids, ordered orbits, and what is counted over them.

A cell's id is the least dart of its orbit.  Where a generator and its inverse are
both known functions, ids come by pointer doubling (the reach doubles each
round); vertices and volumes of three dimensions have more generators: parts of
their orbits come by doubling, and connected components join the parts.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..mesh import Mesh, MeshError
from ..plans.components import connected_components
from ..plans.storage import discard, materialize

#: Darts of which a task walks the faces at once.
LOT_ROWS = 200_000

# Generators by policy and dimension, in visiting order; (1, 2) is b1 after b2.
GENERATORS = {
    2: {"vertex": [(1, 2), (2, 0)], "vertex_linear": [(1, 2)], "edge": [(2,)], "face": [(1,), (0,)], "face_linear": [(1,)]},
    3: {
        "vertex": [(1, 2), (2, 0), (1, 3), (3, 0), (2, 3), (3, 2)],
        "vertex_linear": [(1, 2), (1, 3), (2, 3)],
        "edge": [(2,), (3,)],
        "face": [(1,), (0,), (3,)],
        "face_linear": [(1,), (3,)],
        "volume": [(1,), (0,), (2,)],
        "volume_linear": [(1,), (2,)],
    },
}


def generators(dim: int, policy: str | list[int]) -> list[tuple[int, ...]]:
    """The generators of a named policy, or of a custom list of image numbers."""
    if isinstance(policy, str):
        if policy not in GENERATORS[dim]:
            raise MeshError(f"no {policy} orbit in {dim} dimensions")
        return GENERATORS[dim][policy]
    if any(i < 0 or i > dim for i in policy):
        raise MeshError("no such image")
    return [(i,) for i in policy]


def compose(darts: DataFrame, images: tuple[int, ...], name: str = "to") -> DataFrame:
    """(d, name): images applied from the last to the first, without null results."""
    last = darts.select("d", F.col(f"b{images[-1]}").alias(name)).where(f"{name} <> 0")
    for i in reversed(images[:-1]):
        step = darts.select(F.col("d").alias(name), F.col(f"b{i}").alias("_next"))
        last = last.join(step, name).where("_next <> 0").select("d", F.col("_next").alias(name))
    return last


def _stepped(darts: DataFrame, images: tuple[int, ...], name: str) -> DataFrame:
    """(d, name) of every dart: images applied from the last to the first, 0 where there is none."""
    out = darts.select("d", F.col(f"b{images[-1]}").alias(name))
    for i in reversed(images[:-1]):
        step = darts.select(F.col("d").alias(name), F.col(f"b{i}").alias("_next"))
        out = out.join(step, name, "left").select("d", F.coalesce("_next", F.lit(0)).cast("bigint").alias(name))
    return out


def _doubled(darts: DataFrame, forward: tuple[int, ...], backward: tuple[int, ...], name: str) -> DataFrame:
    """(d, name): least dart reached by walking either way, in rounds of doubling reach."""
    written = state = materialize(_stepped(darts, forward, "f").withColumn("least", F.col("d")), f"{name}-state")
    # Where all orbits are closed, walking ahead meets all of them.
    closed = state.where("f = 0").isEmpty()
    if not closed:
        state = state.join(_stepped(darts, backward, "g"), "d")
        last, state = written, materialize(state, f"{name}-state")
        written = state
        discard(last)
    before = None
    while True:
        total = state.agg(F.sum(F.col("least").cast("decimal(38,0)"))).head()[0]
        if total == before:
            return state.select("d", F.col("least").alias(name))
        before = total
        ahead = state.select(F.col("d").alias("f"), F.col("f").alias("f2"), F.col("least").alias("fl"))
        if closed:
            state = state.join(ahead, "f").select("d", F.col("f2").alias("f"), F.least("least", "fl").alias("least"))
            last, state = written, materialize(state, f"{name}-state")
            written = state
            discard(last)
            continue
        behind = state.select(F.col("d").alias("g"), F.col("g").alias("g2"), F.col("least").alias("gl"))
        state = state.join(ahead, "f", "left").join(behind, "g", "left")
        state = state.select("d", F.coalesce("f2", F.lit(0)).alias("f"), F.coalesce("g2", F.lit(0)).alias("g"), F.least("least", F.coalesce("fl", "least"), F.coalesce("gl", "least")).alias("least"))
        last, state = written, materialize(state, f"{name}-state")
        written = state
        discard(last)


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (d, b1) -> (d, head, least, to), lot by lot: the chain that a dart is in within its lot, its least dart and where it goes on (null: nowhere, it is closed)."""

    def lot(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        d, b1 = (np.concatenate([p.column(c).to_numpy(zero_copy_only=False) for p in parts]) for c in ("d", "b1"))
        order = np.argsort(d)
        d, b1, n = d[order], b1[order], len(d)
        at = np.minimum(np.searchsorted(d, b1), n - 1)
        known = d[at] == b1
        back = np.arange(n)
        back[at[known]] = np.flatnonzero(known)
        # A head is its own last; on closed chains the walk back never ends, but has met all of them.
        head, least = back.copy(), np.minimum(d, d[back])
        for _ in range(n.bit_length()):
            least = np.minimum(least, least[head])
            head = head[head]
        tail = np.flatnonzero(~known)
        closed = (back[head] != head) | (d[head] == b1[head])
        low, to = np.zeros(n, np.int64), np.zeros(n, np.int64)
        low[head[tail]], to[head[tail]] = least[tail], b1[tail]
        columns = [d, np.where(closed, least, d[head]), np.where(closed, least, low[head])]
        return pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(to[head], mask=closed)], ["d", "head", "least", "to"])

    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= LOT_ROWS:
            yield lot(held)
            held, rows = [], 0
    if rows:
        yield lot(held)


def closed_faces(darts: DataFrame, near: str) -> DataFrame:
    """(d, fid) of darts (d, b1, near) whose faces are all closed.

    Darts that are near each other meet in a task, which walks what it has of a
    face in lots of bounded rows; only pieces of faces that a lot cuts are joined
    by doubling.  ``near`` is but a hint: any value gives the same ids.
    """
    lots = darts.select("d", "b1", near).repartition(near).sortWithinPartitions(near).select("d", "b1")
    pieces = materialize(lots.mapInArrow(_chained, "d bigint, head bigint, least bigint, to bigint"), "face-pieces")
    state = materialize(pieces.where("to is not null and d = head").select("d", F.col("to").alias("f"), "least"), "fid-state")
    if state.isEmpty():
        return pieces.select("d", F.col("least").alias("fid"))
    found = _settled(state, "fid").select(F.col("d").alias("head"), F.col("least").alias("fid"))
    return pieces.join(found, "head", "left").select("d", F.coalesce("fid", "least").alias("fid"))


def _settled(state: DataFrame, name: str) -> DataFrame:
    """(d, f, least) written, with all walks along f closed -> the same with the least of each walk."""
    before = None
    while True:
        total = state.agg(F.sum(F.col("least").cast("decimal(38,0)"))).head()[0]
        if total == before:
            return state
        before = total
        ahead = state.select(F.col("d").alias("f"), F.col("f").alias("f2"), F.col("least").alias("fl"))
        last, state = state, materialize(state.join(ahead, "f").select("d", F.col("f2").alias("f"), F.least("least", "fl").alias("least")), f"{name}-state")
        discard(last)


def _linked(parts: DataFrame, steps: list[DataFrame], name: str) -> DataFrame:
    """(d, name): parts (d, part) joined by steps (d, to) between darts; only the parts, not the darts, take part in the components' rounds."""
    parts = parts if hasattr(parts, "written_to") else materialize(parts, f"{name}-parts")
    far = parts.select(F.col("d").alias("to"), F.col("part").alias("b"))
    edges = reduce(DataFrame.union, [s.join(parts, "d").join(far, "to").select(F.col("part").alias("a"), "b") for s in steps]).distinct()
    found = connected_components(edges).select(F.col("node").alias("part"), F.col("component").alias(name))
    return parts.join(found, "part", "left").select("d", F.coalesce(name, "part").alias(name))


def _least_across(parts: DataFrame, darts: DataFrame, images: list[str], name: str) -> DataFrame:
    """(d, name): the least part of a dart and of its images."""
    parts = materialize(parts, f"{name}-parts")
    state = darts.select("d", *images).join(parts, "d")
    for b in images:
        state = state.join(parts.select(F.col("d").alias(b), F.col("part").alias(f"part_{b}")), b, "left")
    return state.select("d", F.least("part", *[F.coalesce(f"part_{b}", "part") for b in images]).alias(name))


def corner_parts(darts: DataFrame) -> DataFrame:
    """(d, part): the part of a vertex within one volume of a 3-mesh; b3 plays no part in it."""
    return materialize(_doubled(darts, (1, 2), (2, 0), "part"), "vid-parts")


def _ids_3d(mesh: Mesh, kind: str, name: str) -> DataFrame:
    """Parts of orbits that are one cycle come by doubling; what is left to join are few parts of a cell."""
    darts = mesh.darts
    if kind == "edge":  # b2 and b3 in turn: two cycles, told apart by the first step
        return _least_across(_doubled(darts, (3, 2), (2, 3), "part"), darts, ["b2", "b3"], name)
    if kind == "vertex":  # around the corner of one volume, then across volumes
        parts = mesh.ids["corner"] if "corner" in mesh.ids else corner_parts(darts)
        # b1 and b2 of one dart are in one part, so b2 is only needed where a face ends.
        ends = darts.where("b1 = 0 and b2 <> 0").select(F.col("d").alias("b3"), F.col("b2").alias("to"))
        return _linked(parts, [compose(darts, (1, 3)), darts.select("d", "b3").join(ends, "b3").select("d", "to")], name)
    side = _doubled(darts, (1,), (0,), "part")
    return _least_across(side, darts, ["b3"], name) if kind == "face" else _linked(side, [compose(darts, (2,))], name)


def cell_ids(mesh: Mesh, kind: str) -> DataFrame:
    """(d, id) of every dart; kind: vertex, edge, face or volume."""
    name = {"vertex": "vid", "edge": "eid", "face": "fid", "volume": "volid"}[kind]
    if kind in mesh.ids:
        return mesh.ids[kind]
    darts = mesh.darts
    if mesh.dim == 3:
        return _ids_3d(mesh, kind, name)
    if kind == "edge":
        return darts.select("d", F.when(F.col("b2") == 0, F.col("d")).otherwise(F.least("d", "b2")).alias(name))
    if kind == "volume":
        raise MeshError("no volume orbit in 2 dimensions")
    return _doubled(darts, (1, 2), (2, 0), name) if kind == "vertex" else _doubled(darts, (1,), (0,), name)


def cells(mesh: Mesh) -> DataFrame:
    """(d, vid, eid, fid[, volid]) of every dart, written once."""
    kinds = ["vertex", "edge", "face"] + (["volume"] if mesh.dim == 3 else [])
    out = reduce(lambda a, b: a.join(b, "d"), [cell_ids(mesh, k) for k in kinds])
    return materialize(out, "cells")


def cell_counts(mesh: Mesh, table: DataFrame | None = None) -> DataFrame:
    """(kind, n): cells of used darts of each kind."""
    label = {"vid": "vertex", "eid": "edge", "fid": "face", "volid": "volume"}
    if table is None:
        # Each kind is counted by itself, so no dart is brought together with all its cells.
        names = [c for c in label if mesh.dim == 3 or c != "volid"]
        counts = [iter_cells(mesh, label[c]).agg(F.count("*").alias("n")).select(F.lit(label[c]).alias("kind"), "n") for c in names]
        return reduce(DataFrame.unionByName, counts)
    used = table.join(mesh.darts.where("not unused").select("d"), "d", "left_semi")
    names = [c for c in table.columns if c != "d"]
    row = used.agg(*[F.count(F.when(F.col(c) == F.col("d"), 1)).alias(c) for c in names])
    return row.select(F.inline(F.array(*[F.struct(F.lit(label[c]).alias("kind"), F.col(c).alias("n")) for c in names])))


def iter_cells(mesh: Mesh, kind: str) -> DataFrame:
    """(id): the cells of one kind that used darts have."""
    name = {"vertex": "vid", "edge": "eid", "face": "fid", "volume": "volid"}[kind]
    used = mesh.darts.where("not unused").select("d")
    return cell_ids(mesh, kind).where(f"d = {name}").join(used, "d", "left_semi").select(name)


def i_cell(mesh: Mesh, kind: str, starts: DataFrame) -> DataFrame:
    """(start, d): all darts of the cell of each start (column d of ``starts``)."""
    ids = cell_ids(mesh, kind)
    name = ids.columns[1]
    return starts.select(F.col("d").alias("start")).join(ids.withColumnRenamed("d", "start"), "start").join(ids, name).select("start", "d")


def orbit(mesh: Mesh, policy: str | list[int], starts: DataFrame) -> DataFrame:
    """(start, pos, d): darts in the order of a breadth-first walk from each start.

    Each round visits the frontier's images by generator order; a dart met twice
    keeps its first place.  Rounds follow the depth of the deepest orbit.
    """
    gens = generators(mesh.dim, policy)
    steps = [compose(mesh.darts, g).withColumn("gen", F.lit(k)) for k, g in enumerate(gens)]
    begin = starts.where("d <> 0").select(F.col("d").alias("start"), F.col("d"), F.lit(0).cast("bigint").alias("pos")).distinct()
    seen = frontier = materialize(begin, "orbit")
    if not steps:
        return seen.select("start", "pos", "d")
    step = materialize(reduce(DataFrame.union, steps), "orbit-steps")
    while True:
        found = frontier.join(step, "d").select("start", F.col("to").alias("d"), F.struct("pos", "gen").alias("by"))
        found = found.groupBy("start", "d").agg(F.min("by").alias("by")).join(seen.select("start", "d"), ["start", "d"], "left_anti")
        last = seen.groupBy("start").agg(F.max("pos").alias("last"))
        ranked = found.join(last, "start").select("start", "d", "by", "last")
        order = F.row_number().over(_by_start())
        frontier = materialize(ranked.select("start", "d", (F.col("last") + order).cast("bigint").alias("pos")), "orbit")
        if frontier.isEmpty():
            return seen.select("start", "pos", "d")
        seen = materialize(seen.unionByName(frontier), "orbit")


def orbit_errors(mesh: Mesh, policy: str | list[int], starts: DataFrame) -> DataFrame:
    """(start, err): starts whose walk can't begin: the null dart, unknown and unused ones."""
    generators(mesh.dim, policy)
    known = starts.select(F.col("d").alias("start")).distinct().join(mesh.darts.select(F.col("d").alias("start"), "unused"), "start", "left")
    err = F.when(F.col("start") == 0, "NullDart").when(F.col("unused").isNull(), "UnknownDart").when(F.col("unused"), "UnusedDart")
    return known.select("start", err.alias("err")).where("err is not null")


def _by_start():
    return Window.partitionBy("start").orderBy("by")


def face_corners(mesh: Mesh, table: DataFrame) -> DataFrame:
    """(fid, pos, d, vid): corners of each face from its id dart along b1, by pointer doubling.

    The face's open end, if any, comes last.  In three dimensions only the side
    of the id dart is walked.
    """
    here = table.select("d", "fid", "vid")
    if mesh.dim == 3:
        # Darts of the other side go round without ever meeting the id dart.
        side = table.where("d = fid").select("fid", "volid")
        here = table.join(side, ["fid", "volid"]).select("d", "fid", "vid")
    # Distance to the face's first dart, walking b1 backwards and stopping there.
    state = mesh.darts.join(here, "d").select("d", "fid", F.when(F.col("d") == F.col("fid"), F.col("d")).otherwise(F.col("b0")).alias("back"), F.when(F.col("d") == F.col("fid"), F.lit(0)).otherwise(F.lit(1)).cast("bigint").alias("steps"))
    state = materialize(state, "corners")
    while not state.where("back <> fid and back <> 0").isEmpty():
        far = state.select(F.col("d").alias("back"), F.col("back").alias("back2"), F.col("steps").alias("steps2"))
        state = state.join(far, "back", "left").select("d", "fid", F.coalesce("back2", F.lit(0)).alias("back"), (F.col("steps") + F.coalesce("steps2", F.lit(0))).alias("steps"))
        state = materialize(state, "corners")
    return state.where("back = fid").join(here.select("d", "vid"), "d").select("fid", F.col("steps").alias("pos"), "d", "vid")


def boundary_darts(mesh: Mesh) -> DataFrame:
    """Used darts without an opposite one."""
    return mesh.darts.where(f"not unused and b{mesh.dim} = 0").select("d")


def vertex_graph(mesh: Mesh, table: DataFrame) -> DataFrame:
    """(vid, neighbour) of interior vertices of a 2-mesh: those none of whose darts lacks an opposite."""
    ends = table.select(F.col("d").alias("b2"), F.col("vid").alias("neighbour"))
    around = mesh.darts.where("not unused").join(table.select("d", "vid"), "d")
    border = around.groupBy("vid").agg(F.max((F.col("b2") == 0).cast("int")).alias("border")).where("border = 0").select("vid")
    return around.join(border, "vid").join(ends, "b2").select("vid", "neighbour")
