"""Mesh files: the sectioned text format, legacy VTK (ASCII and binary), and Parquet.

Text formats hold one mesh in one file, so they are parsed and written as whole
files through Spark's own readers and writers (any file system they know);
Parquet is the format for meshes of any size.
"""

from __future__ import annotations

import struct

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..mesh import Attribute, Mesh, MeshError
from ..operators.cells import cells, face_corners
from ..operators.planar import mesh_of_loops
from ..plans.numbering import numbered
from ..plans.storage import materialize

# Section names of the text format, and VTK cell types.
SECTIONS = ["META", "BETAS", "UNUSED", "VERTICES"]
VTK_VERTEX, VTK_POLY_VERTEX, VTK_LINE, VTK_POLY_LINE, VTK_TRIANGLE, VTK_POLYGON, VTK_QUAD = 1, 2, 3, 4, 5, 7, 9
VERSION = "0.11.0"


def _content(spark: SparkSession, path: str) -> bytes:
    rows = spark.read.format("binaryFile").load(path).select("content").head(1)
    if not rows:
        raise MeshError(f"nothing to read at {path}")
    return bytes(rows[0][0])


# the sectioned text format


def parse_sections(text: str) -> dict[str, list[str]]:
    """Lines by section, without comments and blank lines."""
    found: dict[str, list[str]] = {}
    current = None
    for raw in text.splitlines():
        line = raw.split("#", 1)[0].strip()
        if not line:
            continue
        if line.startswith("["):
            if not line.endswith("]"):
                raise MeshError(f"unknown section {line}")
            current = line[1:-1].strip().upper()
            if current not in SECTIONS:
                raise MeshError(f"unknown section {line}")
            if current in found:
                raise MeshError(f"section {line} comes twice")
            found[current] = []
        elif current is None:
            raise MeshError("content before the first section")
        else:
            found[current].append(line)
    for name in ("META", "BETAS"):
        if name not in found:
            raise MeshError(f"section {name} is missing")
    return found


def parse_meta(line: str) -> tuple[str, int, int]:
    """(version, dimension, darts) of exactly three tokens."""
    tokens = line.split()
    if len(tokens) != 3 or not tokens[1].isdecimal() or not tokens[2].isdecimal():
        raise MeshError("the META line needs a version, a dimension and a number of darts")
    return tokens[0], int(tokens[1]), int(tokens[2])


def parse_cmap(spark: SparkSession, text: str) -> Mesh:
    """A mesh from the text format; any inconsistency is a MeshError."""
    found = parse_sections(text)
    if len(found["META"]) != 1:
        raise MeshError("META needs one line")
    _, dim, n = parse_meta(found["META"][0])
    if dim not in (2, 3):
        raise MeshError("the dimension must be 2 or 3")
    try:
        images = [[int(t) for t in line.split()] for line in found["BETAS"]]
        unused = {int(t) for line in found.get("UNUSED", []) for t in line.split()}
        vertices = [(int(t[0]), *map(float, t[1:])) for t in (line.split() for line in found.get("VERTICES", []))]
    except ValueError as error:
        raise MeshError(f"not a number: {error}") from error
    if len(images) != dim + 1 or any(len(row) != n + 1 for row in images):
        raise MeshError("the images' lines don't fit the number of darts")
    if any(v < 0 or v > n for row in images for v in row) or any(u < 1 or u > n for u in unused) or any(len(v) != dim + 1 for v in vertices):
        raise MeshError("a dart or vertex is out of range")
    rows = [(d, *(row[d] for row in images), d in unused) for d in range(1, n + 1)]
    darts = spark.createDataFrame(rows, "d bigint, " + ", ".join(f"b{i} bigint" for i in range(dim + 1)) + ", unused boolean")
    points = spark.createDataFrame(vertices, "vid bigint, " + ", ".join(f"{a} double" for a in "xyz"[:dim]))
    return Mesh(dim, darts, points)


def read_cmap(spark: SparkSession, path: str) -> Mesh:
    return parse_cmap(spark, _content(spark, path).decode("utf-8"))


def _number(v: float) -> str:
    return str(int(v)) if float(v).is_integer() and abs(v) < 1e15 else repr(float(v))


def format_cmap(mesh: Mesh) -> str:
    """The text format of a mesh: right-aligned images, the null dart included, vertices in id order."""
    rows = mesh.darts.orderBy("d").collect()
    width = len(str(len(rows)))
    lines = ["[META]", f"{VERSION} {mesh.dim} {len(rows)}", "", "[BETAS]"]
    for b in mesh.images:
        lines.append(" ".join(f"{v:>{width}}" for v in (0, *(r[b] for r in rows))))
    lines += ["", "[UNUSED]", " ".join(str(r.d) for r in rows if r.unused), "", "[VERTICES]"]
    lines += [" ".join([str(v.vid), *[_number(v[a]) for a in mesh.axes]]) for v in mesh.vertices.orderBy("vid").collect()]
    return "\n".join(lines) + "\n"


def write_cmap(mesh: Mesh, path: str) -> None:
    """One text file in the folder ``path``."""
    spark = mesh.spark
    spark.createDataFrame([(format_cmap(mesh).rstrip("\n"),)], "value string").coalesce(1).write.text(path)


# legacy VTK


def parse_vtk(content: bytes) -> tuple[list[tuple[float, float, float]], list[tuple[int, list[int]]]]:
    """(points, (type, point numbers) of cells) of an unstructured grid, ASCII or big-endian binary."""
    head, _, rest = content.partition(b"\n")
    if not head.startswith(b"# vtk DataFile"):
        raise MeshError("not a legacy VTK file")
    _, _, rest = rest.partition(b"\n")
    kind, _, rest = rest.partition(b"\n")
    binary = kind.strip().upper() == b"BINARY"
    points, lists, types, at = [], [], [], 0
    sizes = {b"float": ("f", 4), b"double": ("d", 8)}

    def line() -> bytes | None:
        nonlocal at
        while at < len(rest):
            end = rest.find(b"\n", at)
            end = len(rest) if end < 0 else end
            out, at = rest[at:end].strip(), end + 1
            if out:
                return out
        return None

    def numbers(n: int, code: str, size: int) -> list:
        nonlocal at
        if binary:
            out = list(struct.unpack_from(f">{n}{code}", rest, at))
            at += n * size
            return out
        out: list = []
        while len(out) < n:
            tokens = line()
            if tokens is None:
                raise MeshError("the VTK file ends too early")
            out += [float(t) if code in "fd" else int(t) for t in tokens.split()]
        return out

    while (words := line()) is not None:
        tokens = words.split()
        key = tokens[0].upper()
        if key == b"DATASET" and tokens[1].upper() != b"UNSTRUCTURED_GRID":
            raise MeshError("only unstructured grids are read")
        if key == b"POINTS":
            flat = numbers(3 * int(tokens[1]), *sizes[tokens[2].lower()])
            points = [tuple(flat[3 * k : 3 * k + 3]) for k in range(len(flat) // 3)]
        elif key == b"CELLS":
            flat, k = numbers(int(tokens[2]), "i", 4), 0
            while k < len(flat):
                lists.append(flat[k + 1 : k + 1 + flat[k]])
                k += 1 + flat[k]
        elif key == b"CELL_TYPES":
            types = numbers(int(tokens[1]), "i", 4)
        elif key in (b"CELL_DATA", b"POINT_DATA"):
            break
    if len(lists) != len(types):
        raise MeshError("cells and cell types differ in number")
    return points, list(zip(types, lists, strict=True))


def vtk_tables(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(id, x, y, z) and (cell, type, vids)."""
    points, found = parse_vtk(_content(spark, path))
    return spark.createDataFrame([(k, *map(float, p)) for k, p in enumerate(points)], "id bigint, x double, y double, z double"), spark.createDataFrame([(k, t, v) for k, (t, v) in enumerate(found)], "cell bigint, type int, vids array<bigint>")


def mesh_of_cells(points: DataFrame, cell_table: DataFrame) -> Mesh:
    """A 2-mesh of (cell, vids): darts by cell and place, opposite sides by an equality join on their ends."""
    faces = cell_table.where(F.size("vids") >= 3).select(F.col("cell").alias("f"), F.posexplode("vids").alias("k", "u"))
    mesh, sides = mesh_of_loops(faces, points, "file")
    # Faces of a file may touch in a corner only: each orbit is a vertex of its own.
    vertices = sides.select("d", "u").join(cells(mesh).select("d", "vid"), "d").groupBy("vid").agg(F.min("u").alias("id")).join(points, "id").select("vid", "x", "y")
    return mesh.with_(vertices=materialize(vertices, "file-vertices"))


def read_vtk(spark: SparkSession, path: str) -> Mesh:
    """Triangles, quads and polygons become faces; vertices and lines are left out; other cells are an error."""
    points, found = vtk_tables(spark, path)
    known = [VTK_VERTEX, VTK_LINE, VTK_TRIANGLE, VTK_POLYGON, VTK_QUAD]
    if not found.where(~F.col("type").isin(known)).isEmpty():
        raise MeshError("unsupported cell type")
    return mesh_of_cells(points, found.where(F.col("type").isin(VTK_TRIANGLE, VTK_POLYGON, VTK_QUAD)))


def read_geometry(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(points, segments, poi) of a boundary: lines are segments, vertices points of interest."""
    points, found = vtk_tables(spark, path)
    if not found.where(F.col("type").isin(VTK_POLY_VERTEX, VTK_POLY_LINE)).isEmpty():
        raise MeshError("poly vertices and poly lines are not supported")
    segments = found.where(F.col("type") == VTK_LINE).select(F.col("cell").alias("seg_id"), F.col("vids")[0].alias("v0"), F.col("vids")[1].alias("v1"))
    poi = found.where(F.col("type") == VTK_VERTEX).select(F.col("vids")[0].alias("id"))
    return points.select("id", "x", "y"), segments, poi


def vtk_cells(mesh: Mesh) -> tuple[DataFrame, DataFrame]:
    """(pid, x, y) and (pos, type, vids): boundary edges as lines, then faces of three corners and more."""
    table = cells(mesh)
    points = materialize(numbered(mesh.vertices, ["vid"], "pid"), "vtk-points")
    number = points.select("vid", "pid")
    ends = mesh.darts.where("not unused and b2 = 0 and b1 <> 0").join(table.select("d", "vid"), "d").join(table.select(F.col("d").alias("b1"), F.col("vid").alias("w")), "b1")
    lines = ends.join(number, "vid").join(number.select(F.col("vid").alias("w"), F.col("pid").alias("q")), "w").select(F.lit(0).alias("part"), F.col("d").alias("key"), F.lit(VTK_LINE).alias("type"), F.array(F.col("pid").cast("bigint"), F.col("q").cast("bigint")).alias("vids"))
    corner = face_corners(mesh, table).join(number, "vid")
    faces = corner.groupBy("fid").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "pid"))), lambda s: s["pid"].cast("bigint")).alias("vids"))
    kind = F.when(F.size("vids") == 3, VTK_TRIANGLE).when(F.size("vids") == 4, VTK_QUAD).otherwise(VTK_POLYGON)
    faces = faces.where(F.size("vids") >= 3).select(F.lit(1).alias("part"), F.col("fid").alias("key"), kind.alias("type"), "vids")
    both = numbered(lines.unionByName(faces), ["part", "key"], "pos")
    return points.select("pid", "x", "y"), both.select("pos", "type", "vids")


def format_vtk(mesh: Mesh, binary: bool = False) -> bytes:
    points, found = vtk_cells(mesh)
    xyz = [(p.x, p.y, 0.0) for p in points.orderBy("pid").collect()]
    rows = [(r.type, r.vids) for r in found.orderBy("pos").collect()]
    size = sum(1 + len(v) for _, v in rows)
    out = [b"# vtk DataFile Version 2.0\n", b"mesh\n", b"BINARY\n" if binary else b"ASCII\n", b"DATASET UNSTRUCTURED_GRID\n", f"POINTS {len(xyz)} double\n".encode()]
    if binary:
        out += [struct.pack(f">{3 * len(xyz)}d", *[v for p in xyz for v in p]), b"\n"]
    else:
        out += [" ".join(_number(v) for v in p).encode() + b"\n" for p in xyz]
    out.append(f"CELLS {len(rows)} {size}\n".encode())
    flat = [[len(v), *v] for _, v in rows]
    out += [struct.pack(f">{size}i", *[x for r in flat for x in r]), b"\n"] if binary else [" ".join(map(str, r)).encode() + b"\n" for r in flat]
    out.append(f"CELL_TYPES {len(rows)}\n".encode())
    out += [struct.pack(f">{len(rows)}i", *[t for t, _ in rows]), b"\n"] if binary else [f"{t}\n".encode() for t, _ in rows]
    return b"".join(out)


def write_vtk(mesh: Mesh, path: str) -> None:
    """One ASCII file in the folder ``path``."""
    text = format_vtk(mesh).decode().rstrip("\n")
    mesh.spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(path)


def hash_file(spark: SparkSession, path: str) -> int:
    return spark.read.format("binaryFile").load(path).select(F.xxhash64("content")).head()[0]


# Parquet


def write_mesh(mesh: Mesh, path: str, overwrite: bool = False) -> None:
    """Parquet tables below ``path``; with ``overwrite`` a mesh there is replaced (it must not be read by this one)."""
    mode = "overwrite" if overwrite else "error"
    mesh.darts.write.mode(mode).parquet(f"{path}/darts")
    mesh.vertices.write.mode(mode).parquet(f"{path}/vertices")
    for name, attribute in mesh.attrs.items():
        attribute.table.write.mode(mode).parquet(f"{path}/attr_{name}")


def read_mesh(spark: SparkSession, path: str, attrs: dict[str, Attribute] | None = None) -> Mesh:
    """A mesh from Parquet; attrs names its attributes with their laws, whose tables are read (a missing one is an error)."""
    darts = spark.read.parquet(f"{path}/darts")
    tables = {k: Attribute(**{**a.__dict__, "table": spark.read.parquet(f"{path}/attr_{k}")}) for k, a in (attrs or {}).items()}
    return Mesh(3 if "b3" in darts.columns else 2, darts, spark.read.parquet(f"{path}/vertices"), tables)


def load_mesh(spark: SparkSession, path: str) -> Mesh:
    """By the path's suffix: .cmap, .vtk, else Parquet."""
    return read_cmap(spark, path) if path.endswith(".cmap") else read_vtk(spark, path) if path.endswith(".vtk") else read_mesh(spark, path)
