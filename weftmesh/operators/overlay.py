"""Overlay grids: quadtree refinement around points, 2:1 balance, regularisation, and the dual mesh.

A quad of depth L is the key (level, ix, iy), so children, parents, siblings and
neighbours are arithmetic on keys.  Siblings are refined together (pairing).

The mesh of the leaves is drawn in whole numbers: corners are places on the grid
of half the deepest quads, so a hanging vertex is found by equality.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..mesh import Mesh
from ..plans.storage import materialize
from .cells import cells, compose
from .planar import mesh_of_edges, outside_of_box

KEY = ["level", "ix", "iy"]


def locate(points: DataFrame, box: dict[str, float], level: int) -> DataFrame:
    """points (x, y) -> adds ix, iy of their quad at a level of the tree over a box."""
    side = float(2**level)
    at = lambda a: F.least(F.lit(2**level - 1), F.greatest(F.lit(0), F.floor((F.col(a) - box[f"min_{a}"]) / (box[f"max_{a}"] - box[f"min_{a}"]) * side))).cast("bigint")
    return points.withColumn("level", F.lit(level)).withColumn("ix", at("x")).withColumn("iy", at("y"))


def occupied(points: DataFrame, box: dict[str, float], max_depth: int) -> DataFrame:
    """(level, ix, iy, n): quads of each level from 0 to max_depth that hold points, and how many.

    Points are counted once, at the deepest level; the levels above are sums of
    the level below.
    """
    deepest = locate(points, box, max_depth).groupBy(*KEY).agg(F.count("*").alias("n"))
    deepest = materialize(deepest, "quads")
    up = lambda k: F.floor(F.col(k) / 2).cast("bigint")
    levels, current = [deepest], deepest
    for level in range(max_depth - 1, -1, -1):
        current = current.groupBy(F.lit(level).alias("level"), up("ix").alias("ix"), up("iy").alias("iy")).agg(F.sum("n").alias("n"))
        levels.append(current)
    out = levels[0]
    for table in levels[1:]:
        out = out.unionByName(table)
    return out


def _children(parents: DataFrame) -> DataFrame:
    """The four children of each quad."""
    offsets = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1)])
    four = parents.select("level", "ix", "iy", F.explode(offsets).alias("o"))
    return four.select((F.col("level") + 1).alias("level"), (2 * F.col("ix") + F.col("o.a")).alias("ix"), (2 * F.col("iy") + F.col("o.b")).alias("iy"))


def refine(points: DataFrame, box: dict[str, float], max_depth: int, most: int = 1) -> DataFrame:
    """Split quads (level, ix, iy): those that hold more than ``most`` points, and their siblings, above max_depth."""
    full = materialize(occupied(points, box, max_depth).where(f"n > {most} and level < {max_depth}").select(*KEY), "refine")
    root = full.where("level = 0")
    parents = full.where("level > 0").select((F.col("level") - 1).alias("level"), F.floor(F.col("ix") / 2).cast("bigint").alias("ix"), F.floor(F.col("iy") / 2).cast("bigint").alias("iy")).distinct()
    return materialize(root.unionByName(_children(parents)).distinct(), "split")


def balance(split: DataFrame, max_rounds: int = 64) -> DataFrame:
    """The split quads with those added that keep neighbours of leaves within one level.

    A split quad of level L needs every edge neighbour of its level to exist, so
    the neighbours' parents must be split, with their siblings; rounds go on until
    nothing is added.
    """
    split = materialize(split.select(*KEY).distinct(), "balance")
    moves = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ((1, 0), (-1, 0), (0, 1), (0, -1))])
    for _ in range(max_rounds):
        size = F.pow(F.lit(2), F.col("level")).cast("bigint")
        near = split.where("level > 0").select("level", "ix", "iy", F.explode(moves).alias("m")).select("level", (F.col("ix") + F.col("m.a")).alias("ix"), (F.col("iy") + F.col("m.b")).alias("iy"))
        near = near.where((F.col("ix") >= 0) & (F.col("iy") >= 0) & (F.col("ix") < size) & (F.col("iy") < size))
        needed = near.select((F.col("level") - 1).alias("level"), F.floor(F.col("ix") / 2).cast("bigint").alias("ix"), F.floor(F.col("iy") / 2).cast("bigint").alias("iy")).distinct()
        above = needed.where("level > 0").select((F.col("level") - 1).alias("level"), F.floor(F.col("ix") / 2).cast("bigint").alias("ix"), F.floor(F.col("iy") / 2).cast("bigint").alias("iy")).distinct()
        grouped = needed.where("level = 0").unionByName(_children(above)).distinct()
        new = materialize(grouped.join(split, KEY, "left_anti"), "balance-new")
        if new.isEmpty():
            return split
        split = materialize(split.unionByName(new), "balance")
    raise RuntimeError("the tree did not balance")


def leaves(split: DataFrame) -> DataFrame:
    """Quads that exist (the root, and children of split quads) and are not split."""
    root = split.sparkSession.range(1).select(F.lit(0).alias("level"), F.lit(0).cast("bigint").alias("ix"), F.lit(0).cast("bigint").alias("iy"))
    return root.unionByName(_children(split)).join(split, KEY, "left_anti")


def leaf_of(points: DataFrame, leaf: DataFrame, box: dict[str, float], max_depth: int) -> DataFrame:
    """points -> adds the key of the leaf that holds them: one equality join over the levels a point passes."""
    deep = locate(points, box, max_depth).withColumnRenamed("ix", "dx").withColumnRenamed("iy", "dy").drop("level")
    path = deep.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(max_depth))))
    cut = F.pow(F.lit(2), max_depth - F.col("level"))
    keyed = path.withColumn("ix", F.floor(F.col("dx") / cut).cast("bigint")).withColumn("iy", F.floor(F.col("dy") / cut).cast("bigint")).drop("dx", "dy")
    return keyed.join(leaf, KEY)


def dual_edges(leaf: DataFrame) -> DataFrame:
    """(level, ix, iy, level2, ix2, iy2): neighbouring leaves of a balanced tree, each pair once, finer side first."""
    moves = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ((1, 0), (-1, 0), (0, 1), (0, -1))])
    near = leaf.select("level", "ix", "iy", F.explode(moves).alias("m")).select("level", "ix", "iy", (F.col("ix") + F.col("m.a")).alias("jx"), (F.col("iy") + F.col("m.b")).alias("jy"))
    same = near.join(leaf.select("level", F.col("ix").alias("jx"), F.col("iy").alias("jy")), ["level", "jx", "jy"]).where("ix < jx or (ix = jx and iy < jy)")
    same = same.select("level", "ix", "iy", F.col("level").alias("level2"), F.col("jx").alias("ix2"), F.col("jy").alias("iy2"))
    coarse = near.where("jx >= 0 and jy >= 0").select("level", "ix", "iy", (F.col("level") - 1).alias("level2"), F.floor(F.col("jx") / 2).cast("bigint").alias("ix2"), F.floor(F.col("jy") / 2).cast("bigint").alias("iy2"))
    coarse = coarse.where((F.col("ix2") != F.floor(F.col("ix") / 2)) | (F.col("iy2") != F.floor(F.col("iy") / 2)))
    coarse = coarse.join(leaf.select(F.col("level").alias("level2"), F.col("ix").alias("ix2"), F.col("iy").alias("iy2")), ["level2", "ix2", "iy2"])
    return same.unionByName(coarse.select(*same.columns))


def regular(leaf: DataFrame) -> DataFrame:
    """Leaves with a flag: irregular ones touch a finer leaf along an edge."""
    finer = dual_edges(leaf).where("level <> level2").select(F.col("level2").alias("level"), F.col("ix2").alias("ix"), F.col("iy2").alias("iy")).distinct().withColumn("_hit", F.lit(True))
    return leaf.join(finer, KEY, "left").select(*KEY, F.col("_hit").isNull().alias("regular"))


def center(box: dict[str, float]) -> tuple[Column, Column]:
    """Coordinates of a quad's middle, the place of its dual vertex."""
    side = F.pow(F.lit(2.0), F.col("level"))
    at = lambda a, k: F.lit(box[f"min_{a}"]) + (F.col(k) + 0.5) / side * (box[f"max_{a}"] - box[f"min_{a}"])
    return at("x", "ix"), at("y", "iy")


# the leaves as a mesh

#: Sides of a quad: bottom, right, top, left, as steps to the neighbour.
_SIDES = ((0, -1), (1, 0), (0, 1), (-1, 0))


def irregular_sides(leaf: DataFrame) -> DataFrame:
    """(level, ix, iy, side): leaf sides with a hanging vertex: the neighbour there is split.  side: 0 bottom, 1 right, 2 top, 3 left."""
    near = leaf.select(*KEY, F.inline(F.array(*[F.struct(F.lit(k).alias("side"), F.lit(a).alias("a"), F.lit(b).alias("b")) for k, (a, b) in enumerate(_SIDES)])))
    # Of a split neighbour, the child that touches the side's first half is a leaf.
    child_x = 2 * (F.col("ix") + F.col("a")) + (F.col("a") < 0).cast("int")
    child_y = 2 * (F.col("iy") + F.col("b")) + (F.col("b") < 0).cast("int")
    child = near.select(*KEY, "side", (F.col("level") + 1).alias("l2"), child_x.alias("x2"), child_y.alias("y2"))
    return child.join(leaf.select(F.col("level").alias("l2"), F.col("ix").alias("x2"), F.col("iy").alias("y2")), ["l2", "x2", "y2"], "left_semi").select(*KEY, "side")


@dataclass(frozen=True)
class Drawing:
    """points (id, px, py) in whole numbers of 1 / scale of the root's side, and edges (u, v)."""

    points: DataFrame
    edges: DataFrame
    scale: int


def _id(x: Column, y: Column, scale: int) -> Column:
    return x + y * (scale + 1)


def leaf_drawing(leaf: DataFrame, max_depth: int, regularized: bool = False) -> Drawing:
    """Sides of all leaves, cut at hanging vertices.

    ``regularized`` adds, for each pair of sibling leaves beside the same finer
    neighbour, the middle of the side they share and its edges to their hanging
    vertices, so that every inner vertex has four edges.  Siblings are refined
    together, so both of such a pair are leaves of one level.
    """
    scale = 1 << (max_depth + 1)
    leaf = materialize(leaf.select(*KEY), "drawn-leaves")
    hanging = materialize(irregular_sides(leaf), "hanging")
    size = F.pow(F.lit(2), max_depth + 1 - F.col("level")).cast("bigint")
    x, y = F.col("ix") * size, F.col("iy") * size
    corner = [(x, y), (x + size, y), (x + size, y + size), (x, y + size)]
    sides = leaf.select(*KEY, F.inline(F.array(*[F.struct(F.lit(k).alias("side"), *[c.alias(n) for n, c in zip(("ux", "uy", "vx", "vy"), (*corner[k], *corner[(k + 1) % 4]), strict=True)]) for k in range(4)])))
    cut = hanging.withColumn("cut", F.lit(True))
    extra = None
    if regularized:
        # The sibling along a bottom or top side lies across ix, else across iy; the side they share is this leaf's right or left, top or bottom one.
        flat = F.col("side").isin(0, 2)
        odd = F.when(flat, F.col("ix") % 2).otherwise(F.col("iy") % 2) == 1
        shared = F.when(flat, F.when(odd, 3).otherwise(1)).otherwise(F.when(odd, 0).otherwise(2))
        middle = hanging.select(*KEY, shared.alias("side"), F.col("side").alias("by"))
        cut = materialize(cut.unionByName(middle.select(*KEY, "side", F.lit(True).alias("cut"))).distinct(), "drawn-cuts")
        at = lambda k: [(corner[k][j] + corner[(k + 1) % 4][j]) / 2 for j in (0, 1)]
        place = lambda name, j: F.element_at(F.array(*[at(k)[j].cast("bigint") for k in range(4)]), F.col(name) + 1)
        extra = middle.where("level > 0").select(_id(place("by", 0), place("by", 1), scale).alias("u"), _id(place("side", 0), place("side", 1), scale).alias("v"))
        # The neighbour across the shared side is cut at the same place: it is the sibling, which has a row of its own.
    sides = sides.join(cut, [*KEY, "side"], "left")
    mx, my = ((F.col("ux") + F.col("vx")) / 2).cast("bigint"), ((F.col("uy") + F.col("vy")) / 2).cast("bigint")
    u, v, m = _id(F.col("ux"), F.col("uy"), scale), _id(F.col("vx"), F.col("vy"), scale), _id(mx, my, scale)
    one = F.array(F.struct(u.alias("u"), v.alias("v")))
    two = F.array(F.struct(u.alias("u"), m.alias("v")), F.struct(m.alias("u"), v.alias("v")))
    pieces = sides.select(F.inline(F.when(F.col("cut"), two).otherwise(one)))
    pieces = pieces if extra is None else pieces.union(extra)
    edges = materialize(pieces.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "drawn-edges")
    points = edges.select(F.explode(F.array("u", "v")).alias("id")).distinct().select("id", (F.col("id") % (scale + 1)).alias("px"), F.floor(F.col("id") / (scale + 1)).alias("py"))
    return Drawing(points, edges, scale)


def mesh_of_drawing(drawing: Drawing, box: dict[str, float]) -> tuple[Mesh, DataFrame]:
    """The drawing's faces as a mesh over the root's box, and its sides (d, u, v)."""
    plain = materialize(drawing.points.select("id", F.col("px").cast("double").alias("x"), F.col("py").cast("double").alias("y")), "drawn-points")
    mesh, sides = mesh_of_edges(plain, drawing.edges, outside_of_box(0.0, 0.0, float(drawing.scale), float(drawing.scale)), "overlay")
    at = lambda a: F.lit(box[f"min_{a}"]) + F.col(a) / drawing.scale * (box[f"max_{a}"] - box[f"min_{a}"])
    return mesh.with_(vertices=mesh.vertices.select("vid", at("x").alias("x"), at("y").alias("y"))), sides


def refined_mesh(leaf: DataFrame, box: dict[str, float], max_depth: int) -> Mesh:
    """The leaves of a balanced tree as faces; hanging vertices are corners of the coarser leaf."""
    return mesh_of_drawing(leaf_drawing(leaf, max_depth), box)[0]


def regularize(leaf: DataFrame, box: dict[str, float], max_depth: int) -> Mesh:
    """:func:`refined_mesh` with transition faces: every inner vertex has four edges."""
    return mesh_of_drawing(leaf_drawing(leaf, max_depth, regularized=True), box)[0]


def face_centers(mesh: Mesh, table: DataFrame) -> DataFrame:
    """(fid, x, y): the mean of each face's corners."""
    return table.join(mesh.vertices, "vid").groupBy("fid").agg(F.avg("x").alias("x"), F.avg("y").alias("y"))


def dualize(mesh: Mesh) -> Mesh:
    """The dual mesh: a face around each inner vertex, with the centres of the faces there as corners.

    Every dart at an inner vertex is a dart of the dual: it runs from its face's
    centre to that of the next face counter-clockwise, so the dual's images are
    compositions of the mesh's: next is b2 after b0, opposite is b1 after b2
    after b0.  Dual faces keep the orientation of the mesh.
    """
    table = cells(mesh)
    used = mesh.darts.where("not unused")
    border = used.where("b2 = 0").join(table.select("d", "vid"), "d").select("vid")
    ends = used.where("b2 = 0").select(F.col("b1").alias("d")).join(table.select("d", "vid"), "d").select("vid")
    inner = table.join(border.union(ends).distinct(), "vid", "left_anti").join(used.select("d"), "d", "left_semi")
    inner = materialize(inner.select("d", "vid", "fid"), "dual-darts")
    kept = inner.select("d")
    nxt = compose(mesh.darts, (2, 0), "b1").join(kept, "d")
    opposite = compose(mesh.darts, (1, 2, 0), "b2").join(kept, "d").join(kept.select(F.col("d").alias("b2")), "b2")
    darts = kept.join(nxt, "d").join(nxt.select(F.col("b1").alias("d"), F.col("d").alias("b0")), "d").join(opposite, "d", "left")
    darts = materialize(darts.select("d", "b0", "b1", F.coalesce("b2", F.lit(0)).cast("bigint").alias("b2"), F.lit(False).alias("unused")), "dual")
    out = Mesh(2, darts, mesh.vertices.limit(0))
    # A dual vertex is a face of the mesh; where the dual's border pinches it, each orbit is a vertex at the same place.
    corner = cells(out).select("d", "vid").join(inner.select("d", "fid"), "d").groupBy("vid").agg(F.min("fid").alias("fid"))
    vertices = corner.join(face_centers(mesh, table), "fid").select("vid", "x", "y")
    return out.with_(vertices=materialize(vertices, "dual-vertices"))


def overlay_grid(points: DataFrame, box: dict[str, float], max_depth: int, most: int = 1) -> Mesh:
    """Refine around points, balance, regularise and dualise."""
    leaf = leaves(balance(refine(points, box, max_depth, most)))
    return dualize(regularize(leaf, box, max_depth))


def remove_dangling_darts(mesh: Mesh) -> Mesh:
    """Vertices stored under another dart of their orbit move to the orbit's id; those of unused darts go.

    Of several values of one orbit that under its id counts, then that of the least dart.
    """
    vid = cells(mesh).select("d", "vid").join(mesh.darts.where("not unused").select("d"), "d", "left_semi")
    at = mesh.vertices.withColumnRenamed("vid", "d").join(vid, "d")
    pick = F.min(F.struct((F.col("d") != F.col("vid")).alias("other"), "d", *mesh.axes)).alias("m")
    return mesh.with_(vertices=at.groupBy("vid").agg(pick).select("vid", *[F.col(f"m.{a}").alias(a) for a in mesh.axes]))


def dart_origins(mesh: Mesh, table: DataFrame) -> DataFrame:
    """(d, x, y): where each dart starts; null where its vertex has no place."""
    return table.select("d", "vid").join(mesh.vertices, "vid", "left").select("d", *mesh.axes)
