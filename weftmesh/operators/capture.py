"""Geometry capture: boundary segments against a grid, classification, clipping.

A boundary is ``segments`` (seg_id, v0, v1) over ``points`` (id, x, y), with points
of interest ``poi`` (id).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..mesh import Mesh, MeshError
from ..plans.components import connected_components
from ..plans.numbering import numbered, running_sum
from ..plans.storage import materialize
from .cells import cells
from .planar import least_at, mesh_of_edges, mesh_of_loops, outside_of_box
from .polygons import triangulate

LEFT, RIGHT, NONE = "Left", "Right", "None"
#: Share of a cell that points keep from the grid's lines where a side is clipped: nearer ones have crossings in an order that rounding makes.
CLEARANCE = 1e-8
#: Edges (16 bytes each) whose components one task may find.
ONE_TASK_EDGES = 2_000_000


def cell_distance(a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    """Steps along the grid's axes between two cells."""
    return F.abs(a[0] - b[0]) + F.abs(a[1] - b[1])


def cell_offset(a: tuple[Column, Column], b: tuple[Column, Column]) -> tuple[Column, Column]:
    """The move over the grid from cell a to cell b."""
    return b[0] - a[0], b[1] - a[1]


def boundary_laws() -> dict:
    """Laws of the boundary side as an attribute of darts: equal sides keep, others give None; a lone value stays; it is never split."""
    return {"merge": lambda l, r: F.when(l == r, l).otherwise(F.lit(NONE)), "merge_one": lambda v: v, "merge_none": F.lit(NONE), "split": None}  # noqa: E741


def orientation_issues(segments: DataFrame) -> DataFrame:
    """(id, side, n): points that more than one segment starts (out) or ends (in) at."""
    out = segments.groupBy(F.col("v0").alias("id")).agg(F.count("*").alias("n")).where("n > 1").select("id", F.lit("out").alias("side"), "n")
    back = segments.groupBy(F.col("v1").alias("id")).agg(F.count("*").alias("n")).where("n > 1").select("id", F.lit("in").alias("side"), "n")
    return out.unionByName(back)


def overlapping_grid(points: DataFrame, cell: tuple[float, float], max_shifts: int = 16, clearance: float = 0.0) -> tuple[tuple[int, int], tuple[float, float]]:
    """((nx, ny), origin) of a grid that covers the points with a margin and has none of them on a grid line.

    With a ``clearance`` (a share of a cell) the points keep that distance from the
    lines; where no shift gives it, the shift with the largest distance is taken.
    """
    names = ["x", "y"]
    row = points.agg(*[f(a).alias(f"{n}_{a}") for a in names for n, f in (("min", F.min), ("max", F.max))]).head().asDict()
    if any(row[f"min_{a}"] is None or row[f"min_{a}"] >= row[f"max_{a}"] for a in names):
        raise MeshError("the boundary has no extent")
    origin = [row[f"min_{a}"] - 1.5 * c for a, c in zip(names, cell, strict=True)]
    origins = []
    for k in range(max_shifts):
        origins.append(origin)
        origin = [o + c / 2 ** (k + 1) for o, c in zip(origin, cell, strict=True)]
    past = lambda a, o, c: (F.col(a) - o) % c
    gaps = [F.min(F.least(*[F.least(past(a, o, c), c - past(a, o, c)) / c for a, o, c in zip(names, at, cell, strict=True)])) for at in origins]
    gaps = list(points.agg(*gaps).head())
    if not max(gaps) > 0:
        raise MeshError("points stay on grid lines after all shifts of the grid")
    best = next((k for k, gap in enumerate(gaps) if gap > 0 and gap >= clearance), gaps.index(max(gaps)))
    origin = origins[best]
    counts = [int(-(-(row[f"max_{a}"] - o) // c)) + 1 for a, o, c in zip(names, origin, cell, strict=True)]
    return (counts[0], counts[1]), (origin[0], origin[1])


def redundant_poi(points: DataFrame, poi: DataFrame, cell: tuple[float, float], origin: tuple[float, float]) -> DataFrame:
    """Points of interest without those that lie on a grid line."""
    at = poi.join(points, "id")
    return at.where(((F.col("x") - origin[0]) % cell[0] != 0) & ((F.col("y") - origin[1]) % cell[1] != 0)).select("id")


def grid_intersections(segments: DataFrame, points: DataFrame, cell: tuple[float, float], origin: tuple[float, float]) -> DataFrame:
    """(seg_id, pos, s, x, y, axis, line): where segments cross grid lines, in the order of the segment.

    Each segment names the lines between its ends' cells itself, so a crossing is
    a row of an exploded range and no segment meets a line that it can't cross.
    """
    a = points.select(F.col("id").alias("v0"), F.col("x").alias("ax"), F.col("y").alias("ay"))
    b = points.select(F.col("id").alias("v1"), F.col("x").alias("bx"), F.col("y").alias("by"))
    both = segments.join(a, "v0").join(b, "v1")
    parts = []
    for axis, (c, o) in enumerate(zip(cell, origin, strict=True)):
        p, q = (F.col("ax"), F.col("bx")) if axis == 0 else (F.col("ay"), F.col("by"))
        low, high = F.floor((F.least(p, q) - o) / c) + 1, F.ceil((F.greatest(p, q) - o) / c) - 1
        lines = both.where(low <= high).withColumn("line", F.explode(F.sequence(low, high)))
        on_line = o + F.col("line") * c
        s = (on_line - p) / (q - p)
        # The line's own coordinate is kept as it is, so crossings of one line are collinear.
        x = on_line if axis == 0 else F.col("ax") + s * (F.col("bx") - F.col("ax"))
        y = on_line if axis == 1 else F.col("ay") + s * (F.col("by") - F.col("ay"))
        parts.append(lines.select("seg_id", s.alias("s"), x.alias("x"), y.alias("y"), F.lit("xy"[axis]).alias("axis"), "line"))
    order = Window.partitionBy("seg_id").orderBy("s", "axis", "line")
    return parts[0].unionByName(parts[1]).withColumn("pos", F.row_number().over(order))


def intersections_per_edge(hits: DataFrame, n_cells: tuple[int, int], cell: tuple[float, float], origin: tuple[float, float]) -> DataFrame:
    """(eid, pos, t, seg_id, first_dart): crossings by the grid edge they lie on, with the darts they need.

    Darts are numbered by a running sum over edges: two for each crossing.
    """
    nx, ny = n_cells
    i, j = F.floor((F.col("x") - origin[0]) / cell[0]), F.floor((F.col("y") - origin[1]) / cell[1])
    # A vertical line x = line is the left side of cell (line, j), or the right side of the one before.
    column = F.when(F.col("axis") == "x", F.col("line")).otherwise(i).cast("bigint")
    row = F.when(F.col("axis") == "x", j).otherwise(F.col("line")).cast("bigint")
    dart = 4 * (column + nx * row) + F.when(F.col("axis") == "x", 4).otherwise(1)
    other = F.when(F.col("axis") == "x", F.when(F.col("line") > 0, 4 * (column - 1 + nx * row) + 2)).otherwise(F.when(F.col("line") > 0, 4 * (column + nx * (row - 1)) + 3))
    share = F.when(F.col("axis") == "x", (F.col("y") - origin[1]) / cell[1] - row).otherwise((F.col("x") - origin[0]) / cell[0] - column)
    # Left sides run downwards, bottoms to the right; right sides upwards, tops to the left.
    t_dart = F.when(F.col("axis") == "x", 1 - share).otherwise(share)
    eid = F.least(dart, F.coalesce(other, dart))
    t = F.when(eid == dart, t_dart).otherwise(1 - t_dart)
    placed = hits.select("seg_id", eid.cast("bigint").alias("eid"), t.alias("t"))
    within = Window.partitionBy("eid").orderBy("t", "seg_id")
    placed = placed.withColumn("pos", F.row_number().over(within))
    counts = placed.groupBy("eid").agg((2 * F.count("*")).alias("n"))
    first = running_sum(counts, ["eid"], "n", "first_dart", 4 * nx * ny + 1)
    return placed.join(first.drop("n"), "eid").select("eid", "pos", "t", "seg_id", "first_dart")


def flood(faces: DataFrame, borders: DataFrame, walls: DataFrame) -> DataFrame:
    """(fid, region): faces (fid) grouped across shared edges (eid, f1, f2) that are no walls (eid); region = least face."""
    open_edges = borders.join(walls, "eid", "left_anti").select(F.col("f1").alias("a"), F.col("f2").alias("b"))
    found = connected_components(open_edges, one_task_rows=ONE_TASK_EDGES).select(F.col("node").alias("fid"), F.col("component").alias("region"))
    return faces.select("fid").join(found, "fid", "left").select("fid", F.coalesce("region", "fid").alias("region"))


def shared_edges(mesh: Mesh, table: DataFrame) -> DataFrame:
    """(eid, f1, f2): the two faces at each interior edge of a 2-mesh."""
    left = table.select("d", "eid", F.col("fid").alias("f1"))
    right = table.select(F.col("d").alias("b2"), F.col("fid").alias("f2"))
    return mesh.darts.where("b2 <> 0").select("d", "b2").join(left, "d").join(right, "b2").where("d = eid").select("eid", "f1", "f2")


def classify_surfaces(mesh: Mesh, table: DataFrame, walls: DataFrame, regions: DataFrame | None = None) -> DataFrame:
    """(fid, surface): surfaces numbered from 0 in the order of their least face."""
    if regions is None:
        faces = table.select("fid").distinct()
        regions = materialize(flood(faces, shared_edges(mesh, table), walls), "regions")
    number = numbered(regions.select("region").distinct(), ["region"], "surface")
    return regions.join(number, "region").select("fid", "surface")


def boundary_curves(mesh: Mesh, table: DataFrame, nodes: DataFrame) -> DataFrame:
    """(d, curve): boundary darts grouped to curves that end at ``nodes`` (vid); a loop without nodes is a curve of its own."""
    border = mesh.darts.where("not unused and b2 = 0").select("d").join(table.select("d", "vid"), "d")
    ends = mesh.darts.select("d", "b1").join(border.select("d"), "d").join(table.select(F.col("d").alias("b1"), F.col("vid").alias("end")), "b1").select("d", "end")
    follow = ends.join(border.select(F.col("d").alias("to"), F.col("vid").alias("end")), "end").join(nodes.select(F.col("vid").alias("end")), "end", "left_anti")
    found = connected_components(follow.select(F.col("d").alias("a"), F.col("to").alias("b")), one_task_rows=ONE_TASK_EDGES).select(F.col("node").alias("d"), "component")
    named = border.select("d").join(found, "d", "left").select("d", F.coalesce("component", "d").alias("least"))
    named = materialize(named, "curves")
    number = numbered(named.select("least").distinct(), ["least"], "curve")
    return named.join(number, "least").select("d", "curve")


def clip(mesh: Mesh, table: DataFrame, marked: DataFrame, walls: DataFrame, regions: DataFrame | None = None) -> Mesh:
    """Delete the faces reached from ``marked`` (fid) without crossing ``walls`` (eid); ``regions`` are those of :func:`flood`, if they are known."""
    if regions is None:
        regions = materialize(flood(table.select("fid").distinct(), shared_edges(mesh, table), walls), "clip-regions")
    gone_regions = regions.join(marked.select("fid"), "fid", "left_semi").select("region").distinct()
    gone = materialize(table.join(regions.join(gone_regions, "region", "left_semi"), "fid").select("d"), "clip-gone")
    hit = gone.select("d", F.lit(True).alias("_gone"))
    darts = mesh.darts.join(hit, "d", "left")
    opposite = gone.select(F.col("d").alias("b2"), F.lit(True).alias("_open"))
    darts = darts.join(opposite, "b2", "left")
    zero = F.lit(0).cast("bigint")
    darts = darts.select("d", *[F.when(F.col("_gone"), zero).otherwise(F.when(F.col("_open"), zero).otherwise(F.col(b)) if b == "b2" else F.col(b)).alias(b) for b in mesh.images], (F.col("unused") | F.coalesce("_gone", F.lit(False))).alias("unused"))
    darts = materialize(darts, "clipped")
    # Vertices keep their place under the new least dart of their orbit.
    left = table.join(gone, "d", "left_anti").groupBy("vid").agg(F.min("d").alias("new"))
    vertices = mesh.vertices.join(left, "vid").select(F.col("new").alias("vid"), *mesh.axes)
    return mesh.with_(darts=darts, vertices=vertices)


# capture: the boundary becomes edges of a grid mesh


@dataclass(frozen=True)
class Captured:
    """A mesh with a captured boundary.

    ``sides`` (d, u, v) names the points that darts run between: grid corners
    first, then points of interest (``poi_base`` + 2 id) and crossings (odd
    places); ``boundary`` (d, side) marks darts along it Left and against it Right;
    ``nodes`` (vid, id) are the points of interest in the mesh; ``regions`` (fid,
    region) are what the boundary parts its faces into, known once it is clipped.
    """

    mesh: Mesh
    sides: DataFrame
    boundary: DataFrame
    nodes: DataFrame
    regions: DataFrame | None = None


def kept_points(segments: DataFrame, hits: DataFrame, poi: DataFrame) -> DataFrame:
    """(seg_id, s, key, kind): what the mesh keeps of each segment: its start if it is of interest (kind 0), and its crossings (kind 1, key = pos)."""
    starts = segments.join(poi.select(F.col("id").alias("v0")).distinct(), "v0").select("seg_id", F.lit(0.0).alias("s"), F.col("v0").alias("key"), F.lit(0).alias("kind"))
    return starts.unionByName(hits.select("seg_id", "s", F.col("pos").cast("bigint").alias("key"), F.lit(1).alias("kind")))


def edge_data(segments: DataFrame, kept: DataFrame) -> DataFrame:
    """(u, v): kept points (structs of kind, seg_id, key) that follow each other along the boundary.

    Segments that keep nothing are skipped by pointer doubling, so a run of them
    costs the logarithm of its length.  Loops without a crossing are left out: no
    grid line ties them to the mesh.
    """
    crossed = kept.where("kind = 1").select("seg_id").distinct()
    # Ends of crossed segments are one node, below all others: only runs of segments without a crossing take part in the rounds.
    linked = segments.join(crossed.withColumn("hit", F.lit(True)), "seg_id", "left").select("seg_id", "v0", "v1", F.coalesce("hit", F.lit(False)).alias("hit"))
    linked = materialize(linked, "capture-linked")
    lowest = linked.agg(F.min(F.least("v0", "v1"))).head()[0]
    hub = F.lit((lowest or 0) - 1).cast("bigint")
    ends = linked.where("hit").select(F.explode(F.array("v0", "v1")).alias("id")).distinct().withColumn("at", hub)
    runs = linked.where("not hit")
    for end in ("v0", "v1"):
        runs = runs.join(ends.select(F.col("id").alias(end), F.col("at").alias(f"{end}_at")), end, "left").withColumn(f"{end}_at", F.coalesce(f"{end}_at", end))
    runs = materialize(runs.select("seg_id", F.col("v0_at").alias("a"), F.col("v1_at").alias("b")), "capture-runs")
    loop = connected_components(runs.select("a", "b"), one_task_rows=ONE_TASK_EDGES).where(F.col("component") == hub).select(F.col("node").alias("a"))
    tied = materialize(linked.where("hit").select("seg_id").union(runs.join(loop, "a").select("seg_id")), "capture-tied")
    name = F.struct("kind", "seg_id", "key")
    kept = materialize(kept.join(tied, "seg_id").select("seg_id", "s", "kind", name.alias("p")), "capture-kept")
    along = Window.partitionBy("seg_id").orderBy("s", "kind", "p")
    inner = kept.withColumn("v", F.lead("p").over(along)).where("v is not null").select(F.col("p").alias("u"), "v")
    ends = kept.groupBy("seg_id").agg(F.min(F.struct("s", "kind", "p"))["p"].alias("first"), F.max(F.struct("s", "kind", "p"))["p"].alias("last"))
    ends = materialize(ends, "capture-ends")
    follow = segments.select("seg_id", F.col("v1").alias("v")).join(segments.select(F.col("v0").alias("v"), F.col("seg_id").alias("to")), "v").select("seg_id", "to")
    follow = follow.join(tied, "seg_id")
    state = materialize(follow.join(ends.select(F.col("seg_id").alias("to"), F.lit(True).alias("done")), "to", "left").select("seg_id", "to", F.coalesce("done", F.lit(False)).alias("done")), "capture-follow")
    while not state.where("not done").isEmpty():
        ahead = state.select(F.col("seg_id").alias("to"), F.col("to").alias("to2"), F.col("done").alias("done2"))
        state = state.join(ahead, "to", "left").select("seg_id", F.when(F.col("done"), F.col("to")).otherwise(F.col("to2")).alias("to"), (F.col("done") | F.coalesce("done2", F.lit(True))).alias("done"))
        state = materialize(state.where("to is not null"), "capture-follow")
    between = ends.select("seg_id", "last").join(state, "seg_id").join(ends.select(F.col("seg_id").alias("to"), "first"), "to").select(F.col("last").alias("u"), F.col("first").alias("v"))
    return inner.unionByName(between)


def insert_boundary(points: DataFrame, segments: DataFrame, poi: DataFrame, n_cells: tuple[int, int], cell: tuple[float, float], origin: tuple[float, float]) -> Captured:
    """The grid with the boundary's crossings as vertices and its pieces as edges.

    Between two crossings the boundary is drawn straight, by way of its points of
    interest.  A crossing of two lines at once is the grid's corner itself.
    """
    nx, ny = n_cells
    spark = points.sparkSession
    hits = materialize(grid_intersections(segments, points, cell, origin), "capture-hits")
    corners = spark.range((nx + 1) * (ny + 1)).select("id", (F.lit(origin[0]) + F.col("id") % (nx + 1) * cell[0]).alias("x"), (F.lit(origin[1]) + F.floor(F.col("id") / (nx + 1)) * cell[1]).alias("y"))
    base = (nx + 1) * (ny + 1)
    # Crossings by the grid edge they lie on; one at a corner is that corner.
    along = F.when(F.col("axis") == "x", (F.col("y") - origin[1]) / cell[1]).otherwise((F.col("x") - origin[0]) / cell[0])
    placed = hits.withColumn("along", along).withColumn("step", F.floor("along").cast("bigint"))
    twice = hits.groupBy("seg_id", "s").agg(F.countDistinct("axis").alias("axes")).where("axes = 2").select("seg_id", "s", F.lit(True).alias("twice"))
    placed = placed.join(twice, ["seg_id", "s"], "left")
    line, step = F.col("line").cast("bigint"), F.col("step")
    corner = F.when(F.col("axis") == "x", line + (nx + 1) * F.round("along").cast("bigint")).otherwise(F.round("along").cast("bigint") + (nx + 1) * line)
    at_corner = F.coalesce("twice", F.lit(False)) | (F.col("along") == F.round("along"))
    placed = numbered(materialize(placed.withColumn("corner", F.when(at_corner, corner)), "capture-placed"), ["seg_id", "pos"], "nth")
    placed = materialize(placed.withColumn("point", F.coalesce("corner", F.lit(base) + 2 * F.col("nth") + 1)), "capture-crossings")
    start = F.when(F.col("axis") == "x", line + (nx + 1) * step).otherwise(step + (nx + 1) * line)
    step_to = F.when(F.col("axis") == "x", F.lit(nx + 1)).otherwise(F.lit(1))
    on_edge = placed.where("corner is null").select(start.alias("a"), (start + step_to).alias("b"), "along", "point")
    # Grid edges in pieces between their crossings.
    i, j = F.col("id") % (nx + 1), F.floor(F.col("id") / (nx + 1))
    grid_edges = corners.where(i < nx).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).union(corners.where(j < ny).select(F.col("id").alias("a"), (F.col("id") + nx + 1).alias("b")))
    whole = grid_edges.join(on_edge.select("a", "b").distinct(), ["a", "b"], "left_anti").select(F.col("a").alias("u"), F.col("b").alias("v"))
    order = Window.partitionBy("a", "b").orderBy("along", "point")
    pieces = on_edge.select("a", "b", F.coalesce(F.lag("point").over(order), F.col("a")).alias("u"), F.col("point").alias("v"), F.lead("point").over(order).isNull().alias("last"))
    pieces = pieces.select("u", "v").union(pieces.where("last").select(F.col("v").alias("u"), F.col("b").alias("v")))
    # Boundary pieces, by point numbers.
    data = materialize(edge_data(segments, kept_points(segments, hits, poi)), "capture-edges")
    number = placed.select("seg_id", F.col("pos").cast("bigint").alias("key"), F.col("point").cast("bigint").alias("point"))
    for end in ("u", "v"):
        named = data.select("*", F.col(f"{end}.kind").alias("kind"), F.col(f"{end}.seg_id").alias("seg_id"), F.col(f"{end}.key").alias("key"))
        crossing = named.where("kind = 1").join(number, ["seg_id", "key"]).withColumn(f"{end}_id", F.col("point")).drop("point")
        of_interest = named.where("kind = 0").withColumn(f"{end}_id", F.lit(base) + 2 * F.col("key"))
        data = crossing.unionByName(of_interest).drop("kind", "seg_id", "key")
    chain = materialize(data.select(F.col("u_id").alias("u"), F.col("v_id").alias("v")).where("u <> v").distinct(), "capture-chain")
    used = chain.select(F.explode(F.array("u", "v")).alias("id")).distinct()
    poi_points = points.select((F.lit(base) + 2 * F.col("id")).alias("id"), "x", "y").join(used, "id")
    all_points = corners.unionByName(placed.where("corner is null").select(F.col("point").alias("id"), "x", "y")).unionByName(poi_points)
    all_points = materialize(all_points, "capture-points")
    edges = materialize(whole.union(pieces).union(chain.select("u", "v")).distinct(), "capture-drawing")
    x1, y1 = (all_points.where(F.col("id") == base - 1).select("x", "y").head())
    # A face lies in one cell of the grid: that to the left of its darts.
    middle = lambda a, k: (F.col(f"u{a}") + F.col(f"v{a}")) / (2 * cell[k]) - origin[k] / cell[k]
    column = F.floor(middle("x", 0) - 1e-6 * F.signum(F.col("vy") - F.col("uy")))
    row = F.floor(middle("y", 1) + 1e-6 * F.signum(F.col("vx") - F.col("ux")))
    outside = outside_of_box(float(origin[0]), float(origin[1]), float(x1), float(y1))
    mesh, sides = mesh_of_edges(all_points, edges, outside, "captured", (column + nx * row).cast("bigint"))
    left = sides.join(chain, ["u", "v"]).select("d", F.lit(LEFT).alias("side"))
    right = sides.join(chain.select(F.col("u").alias("v"), F.col("v").alias("u")), ["u", "v"]).select("d", F.lit(RIGHT).alias("side"))
    boundary = materialize(left.unionByName(right).dropDuplicates(["d"]), "capture-boundary")
    names = mesh.vertices.select("vid")
    nodes = sides.where((F.col("u") >= base) & ((F.col("u") - base) % 2 == 0)).groupBy("u").agg(F.min("d").alias("vid")).join(names, "vid").select("vid", ((F.col("u") - base) / 2).cast("bigint").alias("id"))
    return Captured(mesh, sides, boundary, materialize(nodes, "capture-nodes"))


def clip_side(captured: Captured, side: str) -> Captured:
    """Delete what lies on one side of the boundary: faces reached from its darts of that side without crossing it.

    A region that has darts of both sides is an error: the boundary is open or
    its loops are oriented against each other.
    """
    if side not in (LEFT, RIGHT):
        raise MeshError("side must be Left or Right")
    mesh, table = captured.mesh, cells(captured.mesh)
    marked = materialize(captured.boundary.join(table.select("d", "eid", "fid"), "d"), "clip-marked")
    walls = marked.select("eid").distinct()
    regions = materialize(flood(table.select("fid").distinct(), shared_edges(mesh, table), walls), "clip-sides")
    if not marked.join(regions, "fid").groupBy("region").agg(F.countDistinct("side").alias("n")).where("n > 1").isEmpty():
        raise MeshError("inconsistent orientation between boundaries")
    out = clip(mesh, table, marked.where(F.col("side") == side).select("fid").distinct(), walls, regions)
    left = out.darts.where("not unused").select("d")
    sides = materialize(captured.sides.join(left, "d"), "clip-left")
    # Faces are left whole, and vertices were named by the least dart that is left at each point; unused darts are alone.
    alone = out.darts.where("unused").select("d", F.col("d").alias("id"))
    out = out.with_(ids={"face": table.select("d", "fid").join(left, "d").union(alone), "vertex": least_at(sides, "u", "vid").union(alone)})
    moved = sides.groupBy("u").agg(F.min("d").alias("now"))
    nodes = captured.sides.join(captured.nodes.select(F.col("vid").alias("d"), "id"), "d").select("u", "id").join(moved, "u").select(F.col("now").alias("vid"), "id")
    # No dart of the boundary has both its sides left, so the regions that are left are still apart.
    gone = marked.where(F.col("side") == side).join(regions, "fid").select("region").distinct()
    kept = materialize(regions.join(gone, "region", "left_anti").select("fid", "region"), "clip-kept")
    return Captured(out, sides, captured.boundary.join(left, "d"), materialize(nodes, "clip-nodes"), kept)


def grisubal(points: DataFrame, segments: DataFrame, poi: DataFrame, cell: tuple[float, float], side: str | None = None, keep_all_poi: bool = False) -> Captured:
    """Capture a boundary in a grid of ``cell`` lengths; ``side`` (Left or Right) is clipped if it is given.

    Points that several segments start or end at are an error.  Points of interest
    on grid lines are left out unless ``keep_all_poi``.
    """
    if not orientation_issues(segments).isEmpty():
        raise MeshError("inconsistent orientation in the boundary")
    n_cells, origin = overlapping_grid(points, cell, clearance=CLEARANCE if side else 0.0)
    poi = poi if keep_all_poi else redundant_poi(points, poi, cell, origin)
    captured = insert_boundary(points, segments, materialize(poi, "capture-poi"), n_cells, cell, origin)
    return clip_side(captured, side) if side else captured


def capture_geometry(points: DataFrame, segments: DataFrame, poi: DataFrame, cell: tuple[float, float], side: str | None = None) -> Captured:
    """:func:`grisubal` with all points of interest, which become anchored nodes."""
    return grisubal(points, segments, poi, cell, side, keep_all_poi=True)


def classify(mesh: Mesh, nodes: DataFrame, table: DataFrame | None = None, regions: DataFrame | None = None) -> dict[str, DataFrame]:
    """Anchors of a captured mesh: vertex (vid, dim, id), edge (eid, dim, id) and face (fid, dim, id).

    Nodes have dimension 0, boundary curves between nodes 1, and surfaces, the
    faces within them, 2; what lies on a curve takes it, all else its surface.
    """
    table = cells(mesh) if table is None else table
    used = mesh.darts.where("not unused").select("d")
    table = materialize(table.join(used, "d", "left_semi"), "classify-cells")
    curves = materialize(boundary_curves(mesh, table, nodes).join(table.select("d", "vid", "eid"), "d"), "classify-curves")
    surfaces = materialize(classify_surfaces(mesh, table, curves.select("eid"), regions), "classify-surfaces")
    faces = surfaces.select("fid", F.lit(2).alias("dim"), F.col("surface").alias("id"))
    of_face = table.join(surfaces, "fid")
    anchor = lambda dim, value: F.struct(F.lit(dim).alias("dim"), F.col(value).cast("bigint").alias("id"))
    edges = of_face.select("eid", anchor(2, "surface").alias("a")).union(curves.select("eid", anchor(1, "curve").alias("a"))).groupBy("eid").agg(F.min("a").alias("a"))
    ends = curves.join(mesh.darts.select("d", "b1"), "d").join(table.select(F.col("d").alias("b1"), F.col("vid").alias("w")), "b1")
    on_curve = curves.select("vid", "curve").union(ends.select("w", "curve"))
    vertices = of_face.select("vid", anchor(2, "surface").alias("a")).union(on_curve.select("vid", anchor(1, "curve").alias("a"))).union(nodes.select("vid", anchor(0, "id").alias("a")))
    vertices = vertices.groupBy("vid").agg(F.min("a").alias("a"))
    return {"vertex": vertices.select("vid", "a.dim", "a.id"), "edge": edges.select("eid", "a.dim", "a.id"), "face": faces}


def first_mesh(points: DataFrame, segments: DataFrame, poi: DataFrame, cell: tuple[float, float], side: str | None = None) -> tuple[Mesh, dict[str, DataFrame]]:
    """Capture, classify and cut into triangles: a triangle mesh and its anchors.

    Edges and vertices of the captured mesh keep their anchors; new edges and the
    triangles take the anchor of the face that they lie in.
    """
    captured = capture_geometry(points, segments, poi, cell, side)
    mesh = captured.mesh
    table = cells(mesh)
    anchors = classify(mesh, captured.nodes, table, captured.regions)
    found = materialize(triangulate(mesh, table, "earclip").where("tri > 0"), "first-triangles")
    loops = found.select(F.struct("fid", "tri").alias("f"), F.posexplode(F.array("v0", "v1", "v2")).alias("k", "u"))
    out, sides = mesh_of_loops(loops, mesh.vertices.withColumnRenamed("vid", "id"), "first-mesh")
    out = out.with_(ids={"face": least_at(sides, "f", "fid"), "vertex": least_at(sides, "u", "vid")})
    new = materialize(sides.join(cells(out), "d"), "first-cells")
    ends = mesh.darts.where("not unused").join(table.select("d", "vid", "eid"), "d").join(table.select(F.col("d").alias("b1"), F.col("vid").alias("w")), "b1")
    old_edge = ends.join(anchors["edge"], "eid").select(F.col("vid").alias("u"), F.col("w").alias("v"), F.struct("dim", "id").alias("old"))
    of_face = new.select("eid", "u", "v", F.col("f.fid").alias("of")).join(anchors["face"].withColumnRenamed("fid", "of"), "of")
    edge = of_face.join(old_edge, ["u", "v"], "left").groupBy("eid").agg(F.min(F.coalesce("old", F.struct("dim", "id"))).alias("a")).select("eid", "a.dim", "a.id")
    face = new.select("fid", F.col("f.fid").alias("of")).distinct().join(anchors["face"].withColumnRenamed("fid", "of"), "of").select("fid", "dim", "id")
    vertex = new.select("vid", "u").distinct().join(anchors["vertex"].withColumnRenamed("vid", "u"), "u").select("vid", "dim", "id")
    return out, {"vertex": vertex, "edge": edge, "face": face}
