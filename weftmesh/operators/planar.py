"""2-meshes from plain geometry: faces given by their corners, or a plane drawing given by its edges.

Both are joins and windows by face or by vertex, so no face or dart is built one
after the other, and both return which points each dart runs between.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..mesh import Mesh
from ..plans.numbering import numbered
from ..plans.storage import materialize
from .cells import closed_faces


def _assembled(sides: DataFrame, points: DataFrame, name: str) -> tuple[Mesh, DataFrame]:
    """sides (d, b0, b1, b2, u, v, ...) and points (id, x, y[, z]) -> the mesh, and sides written; darts that start at one point form one vertex."""
    sides = materialize(sides, name)
    darts = sides.select("d", "b0", "b1", "b2", F.lit(False).alias("unused"))
    axes = [a for a in "xyz" if a in points.columns][:2]
    vertices = sides.groupBy(F.col("u").alias("id")).agg(F.min("d").alias("vid")).join(points, "id").select("vid", *axes)
    return Mesh(2, darts, materialize(vertices, f"{name}-vertices")), sides


def mesh_of_loops(loops: DataFrame, points: DataFrame, name: str = "loops") -> tuple[Mesh, DataFrame]:
    """loops (f, k, u): corners of faces in order -> the mesh and its sides (d, f, k, u, v, ...).

    Darts are numbered by face and corner.  Sides that run between the same points
    in opposite ways are sewn; a point stands for one vertex, so faces that touch
    in a corner only must not share its point.
    """
    placed = numbered(loops.select("f", "k", "u"), ["f", "k"], "d", 1)
    around = Window.partitionBy("f").orderBy("k")
    whole = around.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sides = placed.select(
        "d", "f", "k", "u",
        F.coalesce(F.lead("u").over(around), F.first("u").over(whole)).alias("v"),
        F.coalesce(F.lag("d").over(around), F.last("d").over(whole)).alias("b0"),
        F.coalesce(F.lead("d").over(around), F.first("d").over(whole)).alias("b1"),
    )
    sides = materialize(sides, f"{name}-sides")
    twin = sides.groupBy(F.col("u").alias("v"), F.col("v").alias("u")).agg(F.min("d").alias("b2"))
    return _assembled(sides.join(twin, ["u", "v"], "left").withColumn("b2", F.coalesce("b2", F.lit(0)).cast("bigint")), points, name)


def mesh_of_edges(points: DataFrame, edges: DataFrame, outside: Column, name: str = "drawing", near: Column | None = None) -> tuple[Mesh, DataFrame]:
    """points (id, x, y) and edges (u, v) of a connected plane drawing -> the mesh of its faces and its sides (d, u, v, ...).

    Every edge is two darts.  The next dart of a face turns clockwise from the
    opposite one about its end, so faces lie to the left; edges are sorted by
    angle about each point.  ``outside`` tells, by (ux, uy, vx, vy), darts that
    have the outer face to their left; they are left out.  With ``near``, a value
    by the same columns that most darts of a face share, the mesh knows its faces
    and vertices; its outer face must then meet no point twice.
    """
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()
    at = lambda k: points.select(F.col("id").alias(k), F.col("x").alias(f"{k}x"), F.col("y").alias(f"{k}y"))
    half = both.join(at("u"), "u").join(at("v"), "v").withColumn("angle", F.atan2(F.col("vy") - F.col("uy"), F.col("vx") - F.col("ux")))
    turn = Window.partitionBy("u").orderBy("angle")
    whole = turn.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    half = half.withColumn("w", F.coalesce(F.lag("v").over(turn), F.last("v").over(whole))).withColumn("out", outside).withColumn("near", F.lit(0) if near is None else near)
    half = materialize(half.select("u", "v", "w", "out", "near"), f"{name}-half")
    inside = materialize(numbered(half.where("not out").select("u", "v", "near"), ["u", "v"], "d", 1), f"{name}-numbers")
    # At the end of the dart v -> u, the next one of its face is u -> w.
    ahead = half.select(F.col("v").alias("u"), F.col("u").alias("v"), F.col("u").alias("s"), F.col("w").alias("t"))
    ahead = inside.join(ahead, ["u", "v"]).join(inside.select(F.col("u").alias("s"), F.col("v").alias("t"), F.col("d").alias("b1")), ["s", "t"]).select("d", "b1")
    twin = inside.select(F.col("v").alias("u"), F.col("u").alias("v"), F.col("d").alias("b2"))
    sides = inside.join(twin, ["u", "v"], "left").join(ahead, "d").join(ahead.select(F.col("b1").alias("d"), F.col("d").alias("b0")), "d")
    mesh, sides = _assembled(sides.select("d", "b0", "b1", F.coalesce("b2", F.lit(0)).cast("bigint").alias("b2"), "u", "v", "near"), points, name)
    if near is not None:
        mesh = mesh.with_(ids={"face": closed_faces(sides, "near"), "vertex": least_at(sides, "u", "vid")})
    return mesh, sides.drop("near")


def least_at(sides: DataFrame, by: str, name: str) -> DataFrame:
    """(d, name): the least of the darts that share the value ``by``."""
    return sides.select("d", F.min("d").over(Window.partitionBy(by)).alias(name))


def outside_of_box(x0: float, y0: float, x1: float, y1: float) -> Column:
    """Darts on the sides of a box that run clockwise around it."""
    on = lambda a, value: (F.col(f"u{a}") == value) & (F.col(f"v{a}") == value)
    return (on("x", x0) & (F.col("vy") > F.col("uy"))) | (on("x", x1) & (F.col("vy") < F.col("uy"))) | (on("y", y0) & (F.col("vx") < F.col("ux"))) | (on("y", y1) & (F.col("vx") > F.col("ux")))
