"""Structured grids: quads, split quads, hexahedra, tetrahedra.

A grid is a projection of ``spark.range(cells)``: a small template gives each
dart of a cell its origin corner, and all images follow by rule (the same edge
walked backwards in the same cell, or across the common face).  No join, no
shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..mesh import Mesh, MeshError

# Origin corners of a cell's darts, face by face, each face in walking order.
QUAD = [[(0, 0), (1, 0), (1, 1), (0, 1)]]
TRIANGLES = [[(0, 0), (1, 0), (0, 1)], [(0, 1), (1, 0), (1, 1)]]
HEXAHEDRON = [
    [(0, 0, 0), (1, 0, 0), (1, 0, 1), (0, 0, 1)],
    [(1, 0, 0), (0, 0, 0), (0, 1, 0), (1, 1, 0)],
    [(1, 0, 1), (1, 0, 0), (1, 1, 0), (1, 1, 1)],
    [(0, 0, 1), (1, 0, 1), (1, 1, 1), (0, 1, 1)],
    [(0, 0, 0), (0, 0, 1), (0, 1, 1), (0, 1, 0)],
    [(1, 1, 0), (0, 1, 0), (0, 1, 1), (1, 1, 1)],
]


def _tetrahedra(mirrored: bool) -> list[list[tuple]]:
    """Faces of the five tetrahedra of a cube: one in the middle, one at each other corner."""
    flip = lambda c: (1 - c[0], c[1], c[2]) if mirrored else c
    middle = [(0, 0, 0), (1, 1, 0), (1, 0, 1), (0, 1, 1)]
    near = lambda c: [m for m in middle if sum(abs(a - b) for a, b in zip(c, m, strict=True)) == 1]
    solids = [middle, *[[c, *near(c)] for c in product((0, 1), repeat=3) if c not in middle]]
    faces = []
    for solid in solids:
        a, b, c, d = map(flip, solid)
        u, v, w = ([q - p for p, q in zip(a, x, strict=True)] for x in (b, c, d))
        det = u[0] * (v[1] * w[2] - v[2] * w[1]) - u[1] * (v[0] * w[2] - v[2] * w[0]) + u[2] * (v[0] * w[1] - v[1] * w[0])
        if det < 0:
            b, c = c, b
        faces += [[a, c, b], [a, b, d], [b, c, d], [a, d, c]]
    return faces


def _template(kinds: list[list[list[tuple]]], solids: list[list[int]]) -> list[dict]:
    """Per kind of cell the images of each dart as (axis, step, dart): axis -1 is the cell itself, dart 0 none.

    ``solids`` names, for each kind, the solid of each face (in 2D all faces of a
    cell bound each other).  Kinds alternate from a cell to its neighbours.
    """
    out = []
    for kind, faces in enumerate(kinds):
        dim, darts, k = len(faces[0][0]), [], 0
        for f, face in enumerate(faces):
            n = len(face)
            darts += [{"face": f, "o": face[p], "e": face[(p + 1) % n], "b0": k + 1 + (p - 1) % n, "b1": k + 1 + (p + 1) % n} for p in range(n)]
            k += n
        out.append({"dim": dim, "darts": darts, "solids": solids[kind], "faces": faces})
    for kind, cell in enumerate(out):
        other = out[(kind + 1) % len(out)]
        for dart in cell["darts"]:
            inside = [(j + 1, x) for j, x in enumerate(cell["darts"]) if (x["o"], x["e"]) == (dart["e"], dart["o"])]
            same = [j for j, x in inside if cell["solids"][x["face"]] == cell["solids"][dart["face"]]]
            across = lambda d, s, c: tuple(v - (s if a == d else 0) for a, v in enumerate(c))
            found = {2: (-1, 0, same[0]) if same else None, 3: None}
            level = 2 if cell["dim"] == 2 else 3
            corners = set(cell["faces"][dart["face"]])
            if cell["dim"] == 3:
                twin = [j for j, x in inside if cell["solids"][x["face"]] != cell["solids"][dart["face"]] and set(cell["faces"][x["face"]]) == corners]
                found[3] = (-1, 0, twin[0]) if twin else None
            if found[level] is None:
                ends = {dart["o"], dart["e"]} if level == 2 else corners
                axis, step = next((a, 1 if v else -1) for a in range(cell["dim"]) for v in (0, 1) if all(c[a] == v for c in ends))
                for j, x in enumerate(other["darts"]):
                    theirs = {x["o"], x["e"]} if level == 2 else set(other["faces"][x["face"]])
                    if (x["e"], x["o"]) == (across(axis, step, dart["o"]), across(axis, step, dart["e"])) and theirs == {across(axis, step, c) for c in ends}:
                        found[level] = (axis, step, j + 1)
            dart |= {"b2": found[2], "b3": found[3]}
    return out


def _pick(kinds: list[list], kind: Column, k: Column) -> Column:
    arrays = [F.element_at(F.array(*[F.lit(v) for v in values]), k) for values in kinds]
    return arrays[0] if len(arrays) == 1 else F.when(kind == 0, arrays[0]).otherwise(arrays[1])


def _grid(spark: SparkSession, n_cells: Sequence[int], lengths: Sequence[float], origin: Sequence[float], template: list[dict]) -> Mesh:
    dim, per_cell = len(n_cells), len(template[0]["darts"])
    total = math.prod(n_cells)
    cell = F.floor((F.col("d") - 1) / per_cell).cast("bigint")
    at, rest = [], cell
    for n in n_cells[:-1]:
        at.append((rest % n).cast("bigint"))
        rest = F.floor(rest / n).cast("bigint")
    at.append(rest)
    base = spark.range(1, total * per_cell + 1).select(F.col("id").alias("d"))
    base = base.select("d", ((F.col("d") - 1) % per_cell + 1).cast("int").alias("k"), cell.alias("cell"), *[a.alias(f"i{j}") for j, a in enumerate(at)])
    parity = sum((F.col(f"i{j}") for j in range(1, dim)), F.col("i0")) % 2 if len(template) == 2 else F.lit(0)
    first = F.col("cell") * per_cell
    steps = [1, *[math.prod(n_cells[: j + 1]) for j in range(dim - 1)]]
    pick = lambda f: _pick([[f(x) for x in t["darts"]] for t in template], parity, F.col("k"))

    def image(name: str) -> Column:
        axis, step, dart = (pick(lambda x, p=p: (x[name] or (-1, 0, 0))[p]) for p in range(3))
        there, inside = F.lit(0).cast("bigint"), F.lit(True)
        for j in range(dim):
            here = F.col(f"i{j}") + step
            there = F.when(axis == j, step * steps[j]).otherwise(there)
            inside = inside & ((axis != j) | ((here >= 0) & (here < n_cells[j])))
        return F.when((dart > 0) & inside, first + there * per_cell + dart).otherwise(0).cast("bigint")

    images = [(first + pick(lambda x: x["b0"])).cast("bigint"), (first + pick(lambda x: x["b1"])).cast("bigint"), image("b2")]
    images += [image("b3")] if dim == 3 else []
    corner = [F.col(f"i{j}") + pick(lambda x, j=j: x["o"][j]) for j in range(dim)]
    full = base.select("d", *[b.cast("bigint").alias(f"b{i}") for i, b in enumerate(images)], F.lit(False).alias("unused"), *[c.cast("bigint").alias(f"c{j}") for j, c in enumerate(corner)])
    darts = full.select("d", *[f"b{i}" for i in range(dim + 1)], "unused")
    # Darts of one corner form one vertex: in a grid no two corners touch, so its id is a plain minimum.
    places = [(F.lit(float(origin[j])) + F.col(f"c{j}") * float(lengths[j])).alias("xyz"[j]) for j in range(dim)]
    vertices = full.groupBy(*[f"c{j}" for j in range(dim)]).agg(F.min("d").alias("vid")).select("vid", *places)
    return Mesh(dim, darts, vertices)


def resolve(n_cells: Sequence[int] | None, len_per_cell: Sequence[float] | None, lens: Sequence[float] | None, dim: int) -> tuple[list[int], list[float]]:
    """Cell counts and lengths from any two of the three; with all three ``lens`` is left out."""
    for given in (n_cells, len_per_cell, lens):
        if given is not None and (len(given) != dim or any(not v > 0 for v in given)):
            raise MeshError("invalid grid parameters")
    if n_cells is not None and len_per_cell is not None:
        return [int(n) for n in n_cells], [float(v) for v in len_per_cell]
    if n_cells is not None and lens is not None:
        return [int(n) for n in n_cells], [v / n for v, n in zip(lens, n_cells, strict=True)]
    if len_per_cell is not None and lens is not None:
        return [math.ceil(t / v) for t, v in zip(lens, len_per_cell, strict=True)], [float(v) for v in len_per_cell]
    raise MeshError("missing grid parameters")


def grid(spark: SparkSession, dim: int, n_cells=None, len_per_cell=None, lens=None, origin=None, split_cells: bool = False) -> Mesh:
    """A grid of quads (dim 2) or hexahedra (dim 3), or of triangles or tetrahedra with ``split_cells``."""
    cells, lengths = resolve(n_cells, len_per_cell, lens, dim)
    if dim == 2:
        kinds = [TRIANGLES if split_cells else QUAD]
        solids = [[0] * len(kinds[0])]
    else:
        kinds = [_tetrahedra(False), _tetrahedra(True)] if split_cells else [HEXAHEDRON]
        solids = [[f // 4 if split_cells else 0 for f in range(len(k))] for k in kinds]
    return _grid(spark, cells, lengths, origin or [0.0] * dim, _template(kinds, solids))


def unit_grid(spark: SparkSession, n: int) -> Mesh:
    return grid(spark, 2, [n, n], [1.0, 1.0])


def unit_triangles(spark: SparkSession, n: int) -> Mesh:
    return grid(spark, 2, [n, n], [1.0, 1.0], split_cells=True)


def hex_grid(spark: SparkSession, n: int, cell_length: float = 1.0) -> Mesh:
    return grid(spark, 3, [n] * 3, [cell_length] * 3)


def tet_grid(spark: SparkSession, n: int, cell_length: float = 1.0) -> Mesh:
    return grid(spark, 3, [n] * 3, [cell_length] * 3, split_cells=True)


def sample_points(spark: SparkSession, lens: Sequence[float], n: int, seed: int) -> DataFrame:
    """(pid, x, y[, z]): n uniform points of a box."""
    return spark.range(n).select(F.col("id").alias("pid"), *[(F.rand(seed + k) * float(v)).alias("xyz"[k]) for k, v in enumerate(lens)])


def bounding_box(points: DataFrame, axes: Sequence[str] = ("x", "y")) -> dict[str, float]:
    """Least and greatest coordinates; an empty or flat box is an error."""
    row = points.agg(*[f(a).alias(f"{n}_{a}") for a in axes for n, f in (("min", F.min), ("max", F.max))]).head().asDict()
    if any(row[f"min_{a}"] is None or not row[f"min_{a}"] < row[f"max_{a}"] for a in axes):
        raise MeshError("degenerate bounding box")
    return row


def padded_root(points: DataFrame, padding: float = 0.1) -> Mesh:
    """One quad around all points, padded by a share of width and height."""
    box = bounding_box(points)
    w, h = box["max_x"] - box["min_x"], box["max_y"] - box["min_y"]
    return grid(points.sparkSession, 2, [1, 1], [w * (1 + 2 * padding), h * (1 + 2 * padding)], origin=[box["min_x"] - w * padding, box["min_y"] - h * padding])
