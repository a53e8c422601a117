"""Vertex insertion on edges, triangulation of faces, and edge cuts, swaps and collapses of triangle meshes."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..mesh import Mesh, MeshError
from ..plans.numbering import numbered, running_sum
from ..plans.storage import materialize
from .cells import cells, face_corners
from .edits import ready, set_images
from .measure import edge_lengths, shift
from .planar import mesh_of_loops

#: Corners of a face up to which points within an ear are looked for one by one, and by arrays beyond.
MANY_CORNERS = 32


def insert_vertices(mesh: Mesh, table: DataFrame, at: DataFrame) -> tuple[Mesh, DataFrame]:
    """Split edges at shares: at (eid, t) with 0 < t < 1 along the edge's id dart.

    Returns the mesh and (eid, err) of edges that can't be split (VertexBound,
    UndefinedEdge).  New darts follow the mesh's last: for each edge the n of its
    own side in walking order, then (if it has one) the n of the opposite side.
    """
    first = mesh.n_darts()
    ends = table.select("d", "vid").join(mesh.darts, "d").select("d", "b1", "b2", "vid")
    far = table.select(F.col("d").alias("b1"), F.col("vid").alias("vid2"))
    edges = ends.join(far, "b1", "left").select(F.col("d").alias("eid"), "b1", "b2", "vid", "vid2")
    points = mesh.vertices
    one = points.select("vid", *[F.col(a).alias(f"p{a}") for a in mesh.axes])
    two = points.select(F.col("vid").alias("vid2"), *[F.col(a).alias(f"q{a}") for a in mesh.axes])
    known = edges.join(one, "vid", "left").join(two, "vid2", "left")
    asked = materialize(at.select("eid", "t").join(known, "eid", "left"), "insert-asked")
    err = F.when(F.min("t").isNull() | (F.min("t") <= 0) | (F.max("t") >= 1), "VertexBound").when(F.max("px").isNull() | F.max("qx").isNull(), "UndefinedEdge")
    errors = materialize(asked.groupBy("eid").agg(err.alias("err")).where("err is not null"), "insert-errors")
    good = asked.join(errors.select("eid"), "eid", "left_anti")
    rank = Window.partitionBy("eid").orderBy("t")
    good = good.withColumn("k", F.row_number().over(rank)).withColumn("m", F.count("*").over(Window.partitionBy("eid")))
    needs = running_sum(good.groupBy("eid").agg((F.count("*") * F.when(F.max("b2") > 0, 2).otherwise(1)).alias("n")), ["eid"], "n", "first_dart", first)
    good = materialize(good.join(needs.select("eid", "first_dart"), "eid"), "insert-good")
    own = F.col("first_dart") + F.col("k") - 1
    # On the other side the k-th point is the (m + 1 - k)-th met.
    other = F.col("first_dart") + F.col("m") + F.col("m") - F.col("k")
    last, zero = F.col("k") == F.col("m"), F.lit(0).cast("bigint")
    has_b2 = F.col("b2") > 0
    before = F.when(F.col("k") == 1, F.col("eid")).otherwise(own - 1)
    new_own = good.select(own.alias("d"), before.alias("b0"), F.when(last, F.col("b1")).otherwise(own + 1).alias("b1"), F.when(has_b2, F.when(F.col("k") == 1, F.col("b2")).otherwise(other + 1)).otherwise(zero).alias("b2"))
    opposite = mesh.darts.select(F.col("d").alias("b2"), F.col("b1").alias("o1"))
    others = good.where(has_b2).join(opposite, "b2")
    new_other = others.select(other.alias("d"), F.when(last, F.col("b2")).otherwise(other - 1).alias("b0"), F.when(F.col("k") == 1, F.col("o1")).otherwise(other + 1).alias("b1"), F.when(last, F.col("eid")).otherwise(own + 1).alias("b2"))
    # The opposite dart of the segment after the k-th point ends at it: walked backwards they are shifted by one.
    fixed_other = new_other
    writes = good.where("k = 1").select(F.inline(F.array(
        F.struct(F.col("eid").alias("d"), F.lit(1).alias("i"), F.col("first_dart").alias("value")),
        F.struct(F.col("eid").alias("d"), F.lit(2).alias("i"), F.when(has_b2, F.col("first_dart") + 2 * F.col("m") - 1).otherwise(zero).alias("value")),
        F.struct(F.col("b1").alias("d"), F.lit(0).alias("i"), (F.col("first_dart") + F.col("m") - 1).alias("value")),
    )))
    back = others.where("k = 1").select(F.inline(F.array(
        F.struct(F.col("b2").alias("d"), F.lit(1).alias("i"), (F.col("first_dart") + F.col("m")).alias("value")),
        F.struct(F.col("b2").alias("d"), F.lit(2).alias("i"), (F.col("first_dart") + F.col("m") - 1).alias("value")),
        F.struct(F.col("o1").alias("d"), F.lit(0).alias("i"), (F.col("first_dart") + 2 * F.col("m") - 1).alias("value")),
    )))
    # Opposites: segment k (after point k) faces the other side's dart m - k (before its point).
    seg_b2 = F.when(has_b2, F.when(last, F.col("b2")).otherwise(F.col("first_dart") + 2 * F.col("m") - 1 - F.col("k"))).otherwise(zero)
    new_own = good.select(own.alias("d"), before.alias("b0"), F.when(last, F.col("b1")).otherwise(own + 1).alias("b1"), seg_b2.alias("b2"))
    # The other side's j-th new dart (j = m + 1 - k from its start) faces the segment before point k.
    fixed_other = others.select(other.alias("d"), F.when(last, F.col("b2")).otherwise(other - 1).alias("b0"), F.when(F.col("k") == 1, F.col("o1")).otherwise(other + 1).alias("b1"), F.when(F.col("k") == 1, F.col("eid")).otherwise(own - 1).alias("b2"))
    changed = set_images(mesh, writes.unionByName(back))
    fresh = new_own.unionByName(fixed_other).select("d", *[F.col(b).cast("bigint").alias(b) for b in ("b0", "b1", "b2")], F.lit(False).alias("unused"))
    share = lambda a: F.col(f"p{a}") + F.col("t") * (F.col(f"q{a}") - F.col(f"p{a}"))
    # The vertex of point k is held by its own dart and, on the other side, by the dart that starts there.
    vertices = points.unionByName(good.select(own.alias("vid"), *[share(a).alias(a) for a in mesh.axes]))
    return mesh.with_(darts=materialize(changed.darts.unionByName(fresh), "inserted"), vertices=materialize(vertices, "inserted-vertices")), errors


def fan_convex(mesh: Mesh, table: DataFrame) -> DataFrame:
    """(fid, tri, v0, v1, v2): every face as a fan around its id dart's vertex, without checks."""
    corner = face_corners(mesh, table)
    first = corner.where("pos = 0").select("fid", F.col("vid").alias("v0"))
    follow = Window.partitionBy("fid").orderBy("pos")
    pairs = corner.withColumn("v2", F.lead("vid").over(follow)).where("pos >= 1 and v2 is not null")
    return pairs.join(first, "fid").select("fid", F.col("pos").alias("tri"), "v0", F.col("vid").alias("v1"), "v2")


def _turn(a, b, c) -> float:
    return (b[0] - a[0]) * (c[1] - b[1]) - (b[1] - a[1]) * (c[0] - b[0])


def _fan(points: list[tuple[float, float]]) -> tuple[str | None, list[tuple[int, int, int]]]:
    n = len(points)
    for s in range(n):
        order = [(s + k) % n for k in range(n)]
        turns = [_turn(points[order[0]], points[order[k]], points[order[k + 1]]) for k in range(1, n - 1)]
        if all(t > 0 for t in turns) or all(t < 0 for t in turns):
            return None, [(order[0], order[k], order[k + 1]) for k in range(1, n - 1)]
    return "NonFannable", []


def _ears(points: list[tuple[float, float]], left: bool) -> tuple[str | None, list[tuple[int, int, int]]]:
    """Clip the first ear of what is left until three corners are.

    A corner that is no ear is judged again only when a neighbour of it or the
    point that was found within it is gone, so many corners don't cost their cube.
    """
    n, out = len(points), []
    sign = 1 if left else -1
    before, after, alive, queued = [n - 1, *range(n - 1)], [*range(1, n), 0], [True] * n, [True] * n
    todo, waits, m = list(range(n)), {}, n
    live, at = None, None

    def within(a: int, b: int, c: int) -> int | None:
        """A point that is left within the triangle or on its sides."""
        nonlocal live, at
        p, q, r = points[a], points[b], points[c]
        if m <= MANY_CORNERS:
            k = after[c]
            while k != a:
                s = points[k]
                if sign * _turn(p, q, s) >= 0 and sign * _turn(q, r, s) >= 0 and sign * _turn(r, p, s) >= 0:
                    return k
                k = after[k]
            return None
        if live is None or 2 * m < len(live):
            live = np.flatnonzero(alive)
            at = np.array(points)[live].T.copy()
        found = live[(sign * _turn(p, q, at) >= 0) & (sign * _turn(q, r, at) >= 0) & (sign * _turn(r, p, at) >= 0)].tolist()
        return next((k for k in found if alive[k] and k not in (a, b, c)), None)

    while m > 3:
        if not todo:
            return "NoEar", []
        b = heapq.heappop(todo)
        queued[b] = False
        a, c = before[b], after[b]
        if not alive[b] or sign * _turn(points[a], points[b], points[c]) <= 0:
            continue
        hit = within(a, b, c)
        if hit is not None:
            waits.setdefault(hit, []).append(b)
            continue
        out.append((a, b, c))
        alive[b], after[a], before[c], m = False, c, a, m - 1
        for k in (a, c, *waits.pop(b, ())):
            if alive[k] and not queued[k]:
                queued[k] = True
                heapq.heappush(todo, k)
    return None, [*out, tuple(k for k in range(n) if alive[k])]


def triangulate(mesh: Mesh, table: DataFrame, method: str = "fan", left: bool = True) -> DataFrame:
    """(fid, tri, v0, v1, v2, err): faces by a checked fan or by ear clipping.

    Faces of three corners come back as they are with AlreadyTriangulated, smaller
    ones with UndefinedFace.  A face's corners are few and meet in one row; faces
    are spread over all tasks.
    """
    if method not in ("fan", "earclip"):
        raise MeshError("method must be fan or earclip")
    corner = mesh.darts.select("d", "b1").join(table.select("d", "fid", "vid"), "d").join(mesh.vertices, "vid", "left")
    faces = corner.groupBy("fid").agg(F.collect_list(F.struct("d", "b1", "vid", "x", "y")).alias("corners"), F.count("x").alias("known")).where("known > 0").drop("known")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, rows = batch.column("corners"), []
            at, flat = lists.offsets.to_pylist(), lists.values
            darts, images, all_vids = (flat.field(c).to_pylist() for c in ("d", "b1", "vid"))
            places = list(zip(flat.field("x").to_pylist(), flat.field("y").to_pylist(), strict=True))
            for fid, a, b in zip(batch.column("fid").to_pylist(), at[:-1], at[1:], strict=True):
                # Around the face from its id dart; corners without a place are passed over.
                nth, order, d = {darts[k]: k for k in range(a, b)}, [], fid
                while d in nth:
                    order.append(nth.pop(d))
                    d = images[order[-1]]
                order = [k for k in order if places[k][0] is not None]
                vids, points = [all_vids[k] for k in order], [places[k] for k in order]
                if len(order) < 3:
                    err, found = "UndefinedFace", []
                elif len(order) == 3:
                    err, found = "AlreadyTriangulated", [(0, 1, 2)]
                else:
                    err, found = _fan(points) if method == "fan" else _ears(points, left)
                rows += [(fid, k + 1, *(vids[i] for i in t), err) for k, t in enumerate(found)] or [(fid, 0, None, None, None, err)]
            columns = zip(*rows, strict=True) if rows else [[]] * 6
            kinds = [pa.int64()] * 5 + [pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["fid", "tri", "v0", "v1", "v2", "err"])

    return faces.mapInArrow(run, "fid bigint, tri bigint, v0 bigint, v1 bigint, v2 bigint, err string")


def mesh_of_triangles(triangles: DataFrame, points: DataFrame, corners: int = 3) -> Mesh:
    """A 2-mesh from (v0, v1, v2): darts numbered by triangle, opposite sides sewn by an equality join on their ends."""
    names = [f"v{k}" for k in range(corners)]
    return mesh_of_loops(triangles.select(F.struct(*names).alias("f"), F.posexplode(F.array(*names)).alias("k", "u")), points, "triangles")[0]


def corners_of(mesh: Mesh, table: DataFrame) -> DataFrame:
    """(fid, v0, v1, v2) of a triangle mesh by vertex id."""
    corner = face_corners(mesh, table)
    return corner.groupBy("fid").agg(*[F.max(F.when(F.col("pos") == k, F.col("vid"))).alias(f"v{k}") for k in range(3)])


def cut_long_edges(mesh: Mesh, longest: float, max_rounds: int = 40) -> Mesh:
    """Halve every edge of a triangle mesh that is longer than ``longest``, with its triangles, until none is left.

    A round cuts edges that share no triangle, the longest first in each
    triangle; each cut triangle becomes two.
    """
    for _ in range(max_rounds):
        table = cells(mesh)
        lengths = materialize(edge_lengths(mesh, table).where(F.col("length") > longest), "long-edges")
        if lengths.isEmpty():
            return mesh
        at = table.join(lengths, "eid").select("eid", "fid", "length")
        best = at.groupBy("fid").agg(F.max(F.struct("length", (-F.col("eid")).alias("e"))).alias("m")).select("fid", (-F.col("m.e")).alias("best"))
        chosen = at.join(best, "fid").groupBy("eid").agg(F.min((F.col("best") == F.col("eid")).cast("int")).alias("ok")).where("ok = 1").select("eid")
        chosen = materialize(chosen, "cut-edges")
        ends = mesh.darts.join(table.select("d", "eid", "fid", "vid"), "d").join(table.select(F.col("d").alias("b1"), F.col("vid").alias("w")), "b1").select("d", "eid", "fid", "vid", "w")
        cut = materialize(ends.join(chosen, "eid"), "cut-ends")
        top = mesh.vertices.agg(F.max("vid")).head()[0]
        a, b = mesh.vertices.select("vid", F.col("x").alias("ax"), F.col("y").alias("ay")), mesh.vertices.select(F.col("vid").alias("w"), F.col("x").alias("bx"), F.col("y").alias("by"))
        middle = cut.where("d = eid").join(a, "vid").join(b, "w").select("eid", ((F.col("ax") + F.col("bx")) / 2).alias("x"), ((F.col("ay") + F.col("by")) / 2).alias("y"))
        middle = materialize(numbered(middle, ["eid"], "id", top + 1), "middles")
        tri = corners_of(mesh, table)
        split = tri.join(cut.select("fid", "eid", F.col("vid").alias("u"), F.col("w")), "fid").join(middle.select("eid", F.col("id").alias("m")), "eid")
        apex = F.col("v0") + F.col("v1") + F.col("v2") - F.col("u") - F.col("w")
        halves = split.select(F.inline(F.array(F.struct(F.col("u").alias("v0"), F.col("m").alias("v1"), apex.alias("v2")), F.struct(F.col("m").alias("v0"), F.col("w").alias("v1"), apex.alias("v2")))))
        whole = tri.join(cut.select("fid"), "fid", "left_anti").select("v0", "v1", "v2")
        points = mesh.vertices.select(F.col("vid").alias("id"), "x", "y").unionByName(middle.select("id", "x", "y"))
        mesh = mesh_of_triangles(materialize(whole.unionByName(halves), "cut-triangles"), materialize(points, "cut-points"))
    raise MeshError("edges are still too long")


def swappable(mesh: Mesh, table: DataFrame) -> DataFrame:
    """(eid, a, b, l, r): interior edges a-b of two triangles with apexes l and r."""
    corner = mesh.darts.join(table.select("d", "eid", "vid", "fid"), "d")
    nxt = corner.select(F.col("d").alias("b1"), F.col("b1").alias("bb"), F.col("vid").alias("w"))
    far = corner.select(F.col("d").alias("bb"), F.col("vid").alias("apex"))
    side = corner.join(nxt, "b1").join(far, "bb").select("d", "b2", "eid", "vid", "w", "apex")
    other = side.select(F.col("d").alias("b2"), F.col("apex").alias("r"))
    return side.where("d = eid and b2 <> 0").join(other, "b2").select("eid", F.col("vid").alias("a"), F.col("w").alias("b"), F.col("apex").alias("l"), "r")


def _pairs(mesh: Mesh, table: DataFrame, wanted: DataFrame) -> DataFrame:
    """(eid, a, b): wanted edges by their ends, the smaller first; edges keep their name while darts are renumbered."""
    ends = mesh.darts.join(table.select("d", "eid", "vid"), "d").join(table.select(F.col("d").alias("b1"), F.col("vid").alias("w")), "b1").where("d = eid")
    return ends.join(wanted.select("eid").distinct(), "eid").select("eid", F.least("vid", "w").alias("a"), F.greatest("vid", "w").alias("b"))


def _rebuilt(triangles: DataFrame, points: DataFrame, name: str) -> tuple[Mesh, DataFrame]:
    """The mesh of (v0, v1, v2) over points (id, x, y), and (old, vid): each point's vertex in it."""
    loops = materialize(triangles, f"{name}-triangles").select(F.struct("v0", "v1", "v2").alias("f"), F.posexplode(F.array("v0", "v1", "v2")).alias("k", "u"))
    mesh, sides = mesh_of_loops(loops, materialize(points, f"{name}-points"), name)
    return mesh, materialize(sides.groupBy(F.col("u").alias("old")).agg(F.min("d").alias("vid")), f"{name}-names")


def _renamed(rows: DataFrame, names: DataFrame, column: str) -> DataFrame:
    """The rows with a vertex column in the new mesh's names; rows of vertices that are gone go."""
    return rows.join(names.select(F.col("old").alias(column), F.col("vid").alias("_now")), column).withColumn(column, F.col("_now")).drop("_now")


def _sides_of(mesh: Mesh, table: DataFrame, left: DataFrame) -> DataFrame:
    """(id, eid, a, b, l, r): edges still wanted (id, a, b) as sides of two triangles, as the mesh is now."""
    quads = swappable(mesh, table).withColumn("p", F.least("a", "b")).withColumn("q", F.greatest("a", "b"))
    return quads.join(left.select("id", F.col("a").alias("p"), F.col("b").alias("q")), ["p", "q"]).drop("p", "q")


def _at(mesh: Mesh, v: str, k: str) -> DataFrame:
    return mesh.vertices.select(F.col("vid").alias(v), F.col("x").alias(f"{k}x"), F.col("y").alias(f"{k}y"))


def swap_edges(mesh: Mesh, wanted: DataFrame) -> tuple[Mesh, DataFrame]:
    """Flip edges (eid) between two triangles where the result stays oriented: (mesh, flipped eids).

    Edges that share a triangle take turns: a round flips those that come first at
    both their triangles, the others are judged again on the changed mesh, until no
    wanted edge can be flipped.  Every edge is flipped once at most.
    """
    left = materialize(_pairs(mesh, cells(mesh), wanted).withColumnRenamed("eid", "id"), "swaps-wanted")
    flipped = left.select(F.col("id").alias("eid")).limit(0)
    while True:
        table = cells(mesh)
        quads = _sides_of(mesh, table, left)
        placed = quads.join(_at(mesh, "a", "a"), "a").join(_at(mesh, "b", "b"), "b").join(_at(mesh, "l", "l"), "l").join(_at(mesh, "r", "r"), "r")
        turn = lambda p, q, s: (F.col(f"{q}x") - F.col(f"{p}x")) * (F.col(f"{s}y") - F.col(f"{q}y")) - (F.col(f"{q}y") - F.col(f"{p}y")) * (F.col(f"{s}x") - F.col(f"{q}x"))
        fine = materialize(placed.where((turn("l", "a", "r") > 0) & (turn("r", "b", "l") > 0)).select("id", "eid", "a", "b", "l", "r"), "swaps")
        if fine.isEmpty():
            return mesh, flipped
        # Two edges between the same apexes may not both be flipped: the new edge is a key of its own.
        touched = fine.join(table.select("eid", "fid"), "eid").select(F.col("id").alias("op_id"), F.col("fid").cast("string").alias("key"))
        touched = touched.union(fine.select(F.col("id").alias("op_id"), F.concat_ws(":", F.least("l", "r"), F.greatest("l", "r")).alias("key")))
        done = materialize(fine.join(ready(touched).withColumnRenamed("op_id", "id"), "id"), "swapped")
        gone = table.join(done.select("eid"), "eid", "left_semi").select("fid").distinct()
        kept = corners_of(mesh, table).join(gone, "fid", "left_anti").select("v0", "v1", "v2")
        new = done.select(F.inline(F.array(F.struct(F.col("l").alias("v0"), F.col("a").alias("v1"), F.col("r").alias("v2")), F.struct(F.col("r").alias("v0"), F.col("b").alias("v1"), F.col("l").alias("v2")))))
        mesh, names = _rebuilt(kept.unionByName(new), mesh.vertices.withColumnRenamed("vid", "id"), "swap")
        flipped = materialize(flipped.union(done.select("id")), "swaps-done")
        left = left.join(done.select("id"), "id", "left_anti")
        left = _renamed(_renamed(left, names, "a"), names, "b")
        left = materialize(left.select("id", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), "swaps-wanted")


def collapse_edges(mesh: Mesh, wanted: DataFrame) -> tuple[Mesh, DataFrame]:
    """Collapse interior edges (eid) of a triangle mesh to their middle: (mesh, collapsed eids); see :func:`collapse_anchored`."""
    mesh, done, _ = collapse_anchored(mesh, wanted)
    return mesh, done


def collapse_anchored(mesh: Mesh, wanted: DataFrame, vertex_anchors: DataFrame | None = None, edge_anchors: DataFrame | None = None) -> tuple[Mesh, DataFrame, DataFrame | None]:
    """Collapse edges (eid) of a triangle mesh: (mesh, collapsed eids, vertex anchors in the new mesh).

    Without anchors an edge collapses to its middle.  With anchors (vid, dim, id)
    and (eid, dim, id) the end of lower dimension stays where it is (equal anchors:
    the middle), ends of one dimension with other ids don't collapse, and the edge
    must have the dimension of one end.  Refused too where an end lies on the
    boundary, where the ends have other than two common neighbours, or where a
    triangle would turn over.  Edges whose surroundings meet take turns until no
    wanted edge can collapse; a refused edge holds nobody up.
    """
    table = cells(mesh)
    left = _pairs(mesh, table, wanted).withColumnRenamed("eid", "id")
    if edge_anchors is not None:
        left = left.join(edge_anchors.select(F.col("eid").alias("id"), F.col("dim").alias("edge_dim")), "id", "left")
    left = materialize(left, "collapse-wanted")
    collapsed = left.select(F.col("id").alias("eid")).limit(0)
    while True:
        quads = _sides_of(mesh, table, left).withColumn("share", F.lit(0.5))
        if vertex_anchors is not None and edge_anchors is not None:
            anchor = lambda v: vertex_anchors.select(F.col("vid").alias(v), F.struct("dim", "id").alias(f"{v}_anchor"))  # noqa: B023, E731
            quads = quads.join(anchor("a"), "a", "left").join(anchor("b"), "b", "left").join(left.select("id", "edge_dim"), "id")
            ad, bd, ai, bi = F.col("a_anchor.dim"), F.col("b_anchor.dim"), F.col("a_anchor.id"), F.col("b_anchor.id")
            quads = quads.where(((ad != bd) | (ai == bi)) & ((F.col("edge_dim") == ad) | (F.col("edge_dim") == bd)))
            quads = quads.withColumn("share", F.when(ad == bd, 0.5).when(ad < bd, 0.0).otherwise(1.0))
        ends = mesh.darts.join(table.select("d", "vid"), "d").join(table.select(F.col("d").alias("b1"), F.col("vid").alias("w")), "b1")
        border = ends.where("not unused and b2 = 0")
        border = materialize(border.select("vid").union(border.select("w")).distinct(), "border")
        inner = quads.join(border.select(F.col("vid").alias("a")), "a", "left_anti").join(border.select(F.col("vid").alias("b")), "b", "left_anti")
        near = materialize(ends.select("vid", "w").union(ends.select("w", "vid")).distinct(), "near")
        common = inner.join(near.select(F.col("vid").alias("a"), F.col("w").alias("c")), "a").join(near.select(F.col("vid").alias("b"), F.col("w").alias("c")), ["b", "c"]).groupBy("id").agg(F.count("*").alias("n")).where("n = 2").select("id")
        inner = materialize(inner.join(common, "id"), "collapsible")
        tri = materialize(corners_of(mesh, table), "collapse-corners")
        corner = tri.select("fid", F.explode(F.array("v0", "v1", "v2")).alias("v"))
        around = inner.select("id", F.explode(F.array("a", "b")).alias("v")).join(corner, "v").select("id", "fid").distinct()
        part = lambda k: F.col(f"a{k}") + F.col("share") * (F.col(f"b{k}") - F.col(f"a{k}"))
        middle = inner.join(_at(mesh, "a", "a"), "a").join(_at(mesh, "b", "b"), "b").select("id", "a", "b", "share", part("x").alias("mx"), part("y").alias("my"))
        middle = materialize(middle, "collapse-middles")
        # Triangles around either end, with the ends at their new place; those of the edge itself vanish.
        keep = around.join(middle, "id").join(tri, "fid")
        has = lambda v: (F.col("v0") == F.col(v)) | (F.col("v1") == F.col(v)) | (F.col("v2") == F.col(v))
        keep = keep.where(~(has("a") & has("b")))
        for k in range(3):
            keep = keep.join(_at(mesh, f"v{k}", f"p{k}"), f"v{k}")
            moved = (F.col(f"v{k}") == F.col("a")) | (F.col(f"v{k}") == F.col("b"))
            keep = keep.withColumn(f"p{k}x", F.when(moved, F.col("mx")).otherwise(F.col(f"p{k}x"))).withColumn(f"p{k}y", F.when(moved, F.col("my")).otherwise(F.col(f"p{k}y")))
        area = (F.col("p1x") - F.col("p0x")) * (F.col("p2y") - F.col("p1y")) - (F.col("p1y") - F.col("p0y")) * (F.col("p2x") - F.col("p1x"))
        fine = materialize(middle.join(keep.where(area <= 0).select("id").distinct(), "id", "left_anti"), "collapse-fine")
        if fine.isEmpty():
            return mesh, collapsed, vertex_anchors
        touched = around.join(fine.select("id"), "id").join(tri, "fid").select(F.col("id").alias("op_id"), F.explode(F.array("v0", "v1", "v2")).alias("key"))
        done = materialize(fine.join(ready(touched.distinct()).withColumnRenamed("op_id", "id"), "id"), "collapsed")
        renamed = done.select(F.col("b").alias("v"), F.col("a").alias("to"))
        out = tri.select("v0", "v1", "v2")
        for k in range(3):
            out = out.join(renamed.select(F.col("v").alias(f"v{k}"), F.col("to").alias(f"t{k}")), f"v{k}", "left").withColumn(f"v{k}", F.coalesce(f"t{k}", f"v{k}")).drop(f"t{k}")
        out = out.where("v0 <> v1 and v1 <> v2 and v2 <> v0").select("v0", "v1", "v2")
        points = mesh.vertices.join(done.select(F.col("b").alias("vid")), "vid", "left_anti").join(done.select(F.col("a").alias("vid"), "mx", "my"), "vid", "left")
        points = points.select(F.col("vid").alias("id"), F.coalesce("mx", "x").alias("x"), F.coalesce("my", "y").alias("y"))
        mesh, names = _rebuilt(out, points, "collapse")
        collapsed = materialize(collapsed.union(done.select("id")), "collapse-done")
        merged = lambda rows, c: rows.join(renamed.select(F.col("v").alias(c), "to"), c, "left").withColumn(c, F.coalesce("to", c)).drop("to")  # noqa: B023, E731
        left = merged(merged(left.join(done.select("id"), "id", "left_anti"), "a"), "b").where("a <> b")
        left = _renamed(_renamed(left, names, "a"), names, "b")
        left = materialize(left.withColumn("p", F.least("a", "b")).withColumn("b", F.greatest("a", "b")).withColumn("a", F.col("p")).drop("p"), "collapse-wanted")
        if vertex_anchors is not None:
            # The lower dimension of the two ends is the new vertex's.
            both = _renamed(merged(vertex_anchors.select("vid", "dim", "id"), "vid"), names, "vid")
            vertex_anchors = materialize(both.groupBy("vid").agg(F.min(F.struct("dim", "id")).alias("m")).select("vid", "m.dim", "m.id"), "collapse-anchors")
        table = cells(mesh)


def remesh(mesh: Mesh, target: float, tolerance: float = 0.25, n_rounds: int = 3, n_relax: int = 1, early: bool = False) -> Iterator[Mesh]:
    """Rounds of relaxing inner vertices, cutting long edges, collapsing short ones, and swapping edges whose swap nears the target length.

    ``early`` ends the rounds when all edges are within the tolerance.
    """
    for _ in range(n_rounds):
        table = cells(mesh)
        if n_relax:
            mesh = shift(mesh, table, n_relax)
        lengths = edge_lengths(mesh, table)
        if early and lengths.where(F.abs(F.col("length") - target) > target * tolerance).isEmpty():
            return
        mesh = cut_long_edges(mesh, target * (1 + tolerance))
        table = cells(mesh)
        short = edge_lengths(mesh, table).where(F.col("length") < target * (1 - tolerance)).select("eid")
        mesh, _ = collapse_edges(mesh, materialize(short, "short-edges"))
        table = cells(mesh)
        quads = swappable(mesh, table)
        placed = quads.join(_at(mesh, "a", "a"), "a").join(_at(mesh, "b", "b"), "b").join(_at(mesh, "l", "l"), "l").join(_at(mesh, "r", "r"), "r")
        error = lambda p, q: F.abs(F.hypot(F.col(f"{p}x") - F.col(f"{q}x"), F.col(f"{p}y") - F.col(f"{q}y")) - target)
        mesh, _ = swap_edges(mesh, materialize(placed.where(error("l", "r") < error("a", "b")).select("eid"), "better-edges"))
        yield mesh


def ideal_angle(n: int) -> float:
    return (n - 2) * math.pi / n
