"""Measures over cells: edge lengths, areas, orientation, skewness; and smoothing rounds."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..mesh import Mesh
from ..plans.storage import materialize
from .cells import vertex_graph


def dart_points(mesh: Mesh, table: DataFrame) -> DataFrame:
    """darts with the cell ids and the coordinates of their own vertex (px, py[, pz])."""
    points = mesh.vertices.select("vid", *[F.col(a).alias(f"p{a}") for a in mesh.axes])
    return mesh.darts.join(table, "d").join(points, "vid", "left")


def edge_lengths(mesh: Mesh, table: DataFrame) -> DataFrame:
    """(eid, length) of edges whose two ends are known."""
    at = dart_points(mesh, table)
    ends = at.select(F.col("d").alias("b1"), *[F.col(f"p{a}").alias(f"q{a}") for a in mesh.axes])
    long = g.norm(g.sub(g.vec("q", mesh.dim), g.vec("p", mesh.dim)))
    return at.where("d = eid").join(ends, "b1").select("eid", long.alias("length")).where("length is not null")


def length_errors(mesh: Mesh, table: DataFrame, target: float) -> DataFrame:
    return edge_lengths(mesh, table).select("eid", ((F.col("length") - target) / target).alias("error"))


def face_areas(mesh: Mesh, table: DataFrame) -> DataFrame:
    """(fid, area, n): signed shoelace area of 2D faces and their darts.

    Places are taken from each face's own corner of its box: from far off, the
    rounding of the products would turn small faces over.
    """
    at = dart_points(mesh, table)
    ends = at.select(F.col("d").alias("b1"), F.col("px").alias("qx"), F.col("py").alias("qy"))
    face = Window.partitionBy("fid")
    near = at.join(ends, "b1").withColumn("ox", F.min("px").over(face)).withColumn("oy", F.min("py").over(face))
    px, py, qx, qy = [F.col(c) - F.col(f"o{c[1]}") for c in ("px", "py", "qx", "qy")]
    return near.groupBy("fid").agg((F.sum(px * qy - qx * py) / 2).alias("area"), F.count("*").alias("n"))


def _corners(mesh: Mesh, table: DataFrame, side: bool) -> DataFrame:
    """Each dart with its own point p, the next q and the one after r; side: of a 3D face only one side's darts."""
    at = dart_points(mesh, table)
    if side:
        # Darts of the id dart's side: the walk along b1 only, told by the volume of the id dart.
        first = at.where("d = fid").select(F.col("fid").alias("_f"), F.col("volid").alias("_v"))
        at = at.join(first, (F.col("fid") == F.col("_f")) & (F.col("volid") == F.col("_v"))).drop("_f", "_v")
    nxt = at.select(F.col("d").alias("b1"), F.col("b1").alias("bb"), *[F.col(f"p{a}").alias(f"q{a}") for a in mesh.axes])
    far = at.select(F.col("d").alias("bb"), *[F.col(f"p{a}").alias(f"r{a}") for a in mesh.axes])
    return at.join(nxt, "b1").join(far, "bb")


def orientation(mesh: Mesh, table: DataFrame) -> DataFrame:
    """(vid, consistent): all turns at a vertex's darts have one sign, and none is 0."""
    p, q, r = (g.vec(k) for k in "pqr")
    signs = _corners(mesh, table, False).select("vid", F.signum(g.turn(p, q, r)).alias("s"))
    return signs.groupBy("vid").agg(((F.min("s") == F.max("s")) & (F.min("s") != 0)).alias("consistent"))


def skewness(mesh: Mesh, table: DataFrame) -> DataFrame:
    """(fid, skewness): equiangular skewness, 0 for a regular face."""
    p, q, r = (g.vec(k, mesh.dim) for k in "pqr")
    angles = _corners(mesh, table, mesh.dim == 3).select("fid", g.angle(g.sub(p, q), g.sub(r, q)).alias("a"))
    stats = angles.groupBy("fid").agg(F.min("a").alias("lo"), F.max("a").alias("hi"), F.count("*").alias("n"))
    ideal = (F.col("n") - 2) * math.pi / F.col("n")
    return stats.select("fid", F.greatest((F.col("hi") - ideal) / (math.pi - ideal), (ideal - F.col("lo")) / ideal).alias("skewness"))


def smooth(mesh: Mesh, table: DataFrame, factors: list[float]) -> Mesh:
    """One Jacobi round for each factor: interior vertices move by it towards their neighbours' mean.

    Every round is one join and one aggregation keyed by vertex; the positions
    are written between rounds.
    """
    graph = materialize(vertex_graph(mesh, table), "vertex-graph")
    points = mesh.vertices
    for factor in factors:
        around = graph.join(points.withColumnRenamed("vid", "neighbour"), "neighbour").groupBy("vid").agg(*[F.avg(a).alias(f"m{a}") for a in mesh.axes])
        moved = points.join(around, "vid", "left")
        step = lambda a: F.col(a) + F.coalesce(factor * (F.col(f"m{a}") - F.col(a)), F.lit(0.0))  # noqa: B023, E731
        points = materialize(moved.select("vid", *[step(a).alias(a) for a in mesh.axes]), "smoothed")
    return mesh.with_(vertices=points)


def shift(mesh: Mesh, table: DataFrame, n_rounds: int) -> Mesh:
    """Vertices move to their neighbours' mean."""
    return smooth(mesh, table, [1.0] * n_rounds)


def laplace(mesh: Mesh, table: DataFrame, n_rounds: int, factor: float) -> Mesh:
    if not 0 < factor < 1:
        raise ValueError("the factor must lie between 0 and 1")
    return smooth(mesh, table, [factor] * n_rounds)


def taubin(mesh: Mesh, table: DataFrame, n_rounds: int, factor: float, pass_band: float) -> Mesh:
    """Shrinking and growing rounds in turn."""
    back = 1 / (pass_band - 1 / factor)
    return smooth(mesh, table, [factor if k % 2 == 0 else back for k in range(n_rounds)])


def total(values: DataFrame, column: str) -> Column:
    return F.sum(column)
