"""Golden meshes, invariants and brute force for the mesh operators."""

import math
import random

import pytest
from pyspark.sql import functions as F

from weftmesh.mesh import Attribute, Mesh, MeshError, from_n_darts, validate
from weftmesh.operators import capture, delaunay, edits, measure, overlay, polygons
from weftmesh.operators.cells import cell_counts, cells, orbit
from weftmesh.plans.components import connected_components
from weftmesh.sources import files, grids

# The 2 x 2 quad grid, dart -> (b0, b1, b2).
QUADS = {
    1: (4, 2, 0), 2: (1, 3, 8), 3: (2, 4, 9), 4: (3, 1, 0), 5: (8, 6, 0), 6: (5, 7, 0), 7: (6, 8, 13), 8: (7, 5, 2),
    9: (12, 10, 3), 10: (9, 11, 16), 11: (10, 12, 0), 12: (11, 9, 0), 13: (16, 14, 7), 14: (13, 15, 0), 15: (14, 16, 0), 16: (15, 13, 10),
}


def counts(mesh):
    return {r.kind: r.n for r in cell_counts(mesh).collect()}


def test_quad_grid_images(spark):
    mesh = grids.unit_grid(spark, 2)
    assert {r.d: (r.b0, r.b1, r.b2) for r in mesh.darts.collect()} == QUADS
    assert counts(mesh) == {"vertex": 9, "edge": 12, "face": 4}


@pytest.mark.parametrize(
    ("dim", "n", "split", "expected"),
    [
        (2, [2, 2], True, {"vertex": 9, "edge": 16, "face": 8}),
        (2, [3, 4], True, {"vertex": 20, "edge": 43, "face": 24}),
        (3, [2, 2, 2], False, {"vertex": 27, "edge": 54, "face": 36, "volume": 8}),
        (3, [2, 2, 2], True, {"vertex": 27, "edge": 90, "face": 104, "volume": 40}),
    ],
)
def test_grid_counts(spark, dim, n, split, expected):
    mesh = grids.grid(spark, dim, n, [1.0] * dim, split_cells=split).written()
    assert counts(mesh) == expected
    assert not validate(mesh).where("violations > 0").count()


def test_grid_parameters():
    assert grids.resolve([2, 3], [1.0, 2.0], None, 2) == ([2, 3], [1.0, 2.0])
    assert grids.resolve(None, [2.0, 2.0], [5.0, 4.0], 2) == ([3, 2], [2.0, 2.0])
    assert grids.resolve([2, 4], None, [1.0, 1.0], 2) == ([2, 4], [0.5, 0.25])
    for bad in (([0, 1], [1.0, 1.0], None), ([1, 1], None, None)):
        with pytest.raises(MeshError):
            grids.resolve(*bad, 2)


def test_face_orbit_order(spark):
    mesh = grids.unit_grid(spark, 2).written()
    found = orbit(mesh, "face", mesh.darts.where("d = 1").select("d")).orderBy("pos").collect()
    assert [r.d for r in found] == [1, 2, 4, 3]


def _two_triangles(spark):
    rows = [(1, 3, 2, 0), (2, 1, 3, 0), (3, 2, 1, 0), (4, 6, 5, 0), (5, 4, 6, 0), (6, 5, 4, 0)]
    darts = spark.createDataFrame([(*r, False) for r in rows], "d bigint, b0 bigint, b1 bigint, b2 bigint, unused boolean")
    points = spark.createDataFrame([(1, 0.0, 0.0), (2, 1.0, 0.0), (3, 0.0, 1.0), (4, 0.0, 2.0), (5, 2.0, 0.0), (6, 1.0, 1.0)], "vid bigint, x double, y double")
    return Mesh(2, darts, points)


def test_sew_merges_vertices(spark):
    ops = spark.createDataFrame([(1, 2, 4)], "op_id bigint, l bigint, r bigint")
    mesh, result = edits.sew(_two_triangles(spark), ops, 2)
    assert [tuple(r) for r in result.collect()] == [(1, True, None)]
    assert {r.eid for r in cells(mesh).collect()} == {1, 2, 3, 5, 6}
    where = {r.vid: (r.x, r.y) for r in mesh.vertices.collect()}
    assert where[2] == (1.5, 0.0) and where[3] == (0.0, 1.5)


def test_link_errors_and_conflicts(spark):
    mesh = from_n_darts(spark, 6)
    ops = spark.createDataFrame([(1, 1, 2), (2, 1, 3), (3, 4, 5), (4, 9, 1)], "op_id bigint, l bigint, r bigint")
    mesh, result = edits.link(mesh, ops, 1)
    assert {r.op_id: r.err for r in result.collect()} == {1: None, 2: "Conflict", 3: None, 4: "UnknownDart"}
    again = spark.createDataFrame([(1, 1, 3), (2, 3, 2)], "op_id bigint, l bigint, r bigint")
    _, result = edits.link(mesh.written(), again, 1)
    assert {r.op_id: r.err for r in result.collect()} == {1: "NonFreeBase", 2: "NonFreeImage"}
    _, result = edits.unlink(mesh.written(), spark.createDataFrame([(1, 1), (2, 2)], "op_id bigint, l bigint"), 1)
    assert {r.op_id: (r.err, r.r) for r in result.collect()} == {1: (None, 2), 2: ("AlreadyFree", 0)}


def test_three_link_pairs_faces(spark):
    triangle = lambda a: [(a, a + 2, a + 1, 0, 0), (a + 1, a, a + 2, 0, 0), (a + 2, a + 1, a, 0, 0)]
    square = [(7 + k, 7 + (k - 1) % 4, 7 + (k + 1) % 4, 0, 0) for k in range(4)]
    darts = spark.createDataFrame([(*r, False) for r in triangle(1) + triangle(4) + square], "d bigint, b0 bigint, b1 bigint, b2 bigint, b3 bigint, unused boolean")
    mesh = Mesh(3, darts, spark.createDataFrame([], "vid bigint, x double, y double, z double"))
    linked, result = edits.link(mesh, spark.createDataFrame([(1, 1, 4)], "op_id bigint, l bigint, r bigint"), 3)
    assert result.head().ok and {r.d: r.b3 for r in linked.darts.where("d < 7").collect()} == {1: 4, 2: 6, 3: 5, 4: 1, 5: 3, 6: 2}
    _, result = edits.link(mesh, spark.createDataFrame([(1, 1, 7)], "op_id bigint, l bigint, r bigint"), 3)
    assert result.head().err == "AsymmetricalFaces"


def test_attribute_laws(spark):
    table = spark.createDataFrame([(1, 5), (2, 6)], "cell_id bigint, value bigint")
    weight = Attribute("vertex", table, lambda a, b: a + b, split=lambda v: (F.floor(v / 2) + v % 2, F.floor(v / 2)))
    merged, errors = edits.merge_values(weight, spark.createDataFrame([(1, 1, 1, 2)], "op_id bigint, out bigint, l bigint, r bigint"))
    assert [tuple(r) for r in merged.collect()] == [(1, 11)] and not errors.count()
    _, errors = edits.merge_values(weight, spark.createDataFrame([(1, 1, 1, 7)], "op_id bigint, out bigint, l bigint, r bigint"))
    assert errors.head().err == "InsufficientData"
    split, _ = edits.split_values(weight, spark.createDataFrame([(1, 1, 3, 1)], "op_id bigint, l bigint, r bigint, inp bigint"))
    assert {tuple(r) for r in split.collect()} == {(1, 3), (3, 2), (2, 6)}


def test_reserve_and_release(spark):
    mesh = from_n_darts(spark, 5, unused=True)
    mesh, taken = edits.reserve(mesh, 2, start=4)
    assert [r.d for r in taken.orderBy("pos").collect()] == [4, 5]
    with pytest.raises(MeshError):
        edits.reserve(mesh.written(), 4)
    mesh, state = edits.release(mesh.written(), taken.select("d"))
    assert mesh.n_unused_darts() == 5 and all(r.ok for r in state.collect())


def test_skewness_of_regular_faces(spark):
    for mesh, expected in ((grids.unit_grid(spark, 2), 0.0), (grids.unit_triangles(spark, 2), 0.25)):
        mesh = mesh.written()
        assert all(r.skewness == pytest.approx(expected, abs=1e-9) for r in measure.skewness(mesh, cells(mesh)).collect())


def test_smoothing_keeps_a_regular_grid(spark):
    mesh = grids.unit_grid(spark, 3).written()
    before = {r.vid: (r.x, r.y) for r in mesh.vertices.collect()}
    after = {r.vid: (r.x, r.y) for r in measure.taubin(mesh, cells(mesh), 2, 0.5, 0.1).vertices.collect()}
    assert all(after[v] == pytest.approx(before[v]) for v in before)


def test_edge_split_golden(spark):
    rows = [(1, 0, 2, 6), (2, 1, 3, 5), (3, 2, 0, 4), (4, 0, 5, 3), (5, 4, 6, 2), (6, 5, 0, 1)]
    darts = spark.createDataFrame([(*r, False) for r in rows], "d bigint, b0 bigint, b1 bigint, b2 bigint, unused boolean")
    points = spark.createDataFrame([(1, 0.0, 0.0), (2, 1.0, 0.0), (3, 2.0, 0.0), (4, 3.0, 0.0)], "vid bigint, x double, y double")
    mesh = Mesh(2, darts, points)
    table = cells(mesh)
    done, errors = polygons.insert_vertices(mesh, table, spark.createDataFrame([(2, 0.5)], "eid bigint, t double"))
    b = {r.d: (r.b1, r.b2) for r in done.darts.collect()}
    assert not errors.count()
    assert (b[1][0], b[2][0], b[7][0]) == (2, 7, 3) and (b[4][0], b[5][0], b[8][0]) == (5, 8, 6)
    assert b[2][1] == 8 and b[8][1] == 2 and b[5][1] == 7 and b[7][1] == 5
    assert {r.vid: r.x for r in done.vertices.collect()}[7] == 1.5
    _, errors = polygons.insert_vertices(mesh, table, spark.createDataFrame([(2, 1.5)], "eid bigint, t double"))
    assert errors.head().err == "VertexBound"


def test_inserted_vertices_keep_invariants(spark):
    mesh = grids.unit_grid(spark, 2).written()
    table = cells(mesh)
    at = table.select("eid").distinct().select("eid", F.explode(F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("t"))
    done, _ = polygons.insert_vertices(mesh, table, at)
    assert not validate(done).where("violations > 0").count()
    assert counts(done) == {"vertex": 9 + 36, "edge": 48, "face": 4}
    new = cells(done)
    assert {r.vid for r in done.vertices.collect()} == {r.vid for r in new.select("vid").distinct().collect()}


def _polygon(spark, points):
    n = len(points)
    darts = spark.createDataFrame([(k + 1, (k - 1) % n + 1, (k + 1) % n + 1, 0, False) for k in range(n)], "d bigint, b0 bigint, b1 bigint, b2 bigint, unused boolean")
    return Mesh(2, darts, spark.createDataFrame([(k + 1, *map(float, p)) for k, p in enumerate(points)], "vid bigint, x double, y double"))


def test_triangulation(spark):
    comb = [(0, 0), (4, 0), (4, 3), (3, 1), (2, 3), (1, 1), (0, 3)]
    mesh = _polygon(spark, comb)
    table = cells(mesh)
    assert polygons.triangulate(mesh, table, "fan").head().err == "NonFannable"
    tris = polygons.triangulate(mesh, table, "earclip").collect()
    area = lambda a, b, c: ((b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])) / 2
    areas = [area(*(comb[v - 1] for v in (t.v0, t.v1, t.v2))) for t in tris]
    whole = sum(x[0] * y[1] - x[1] * y[0] for x, y in zip(comb, comb[1:] + comb[:1], strict=True)) / 2
    assert len(tris) == 5 and all(a > 0 for a in areas) and sum(areas) == pytest.approx(whole)
    square = _polygon(spark, [(0, 0), (1, 0), (1, 1), (0, 1)])
    assert polygons.triangulate(square, cells(square), "fan").count() == 2
    three = _polygon(spark, [(0, 0), (1, 0), (1, 1)])
    assert polygons.triangulate(three, cells(three)).head().err == "AlreadyTriangulated"


def test_cut_swap_collapse(spark):
    mesh = grids.unit_triangles(spark, 4).written()
    cut = polygons.cut_long_edges(mesh, 0.8)
    table = cells(cut)
    assert measure.edge_lengths(cut, table).agg(F.max("length")).head()[0] <= 0.8
    assert measure.face_areas(cut, table).agg(F.sum("area")).head()[0] == pytest.approx(16)
    table = cells(mesh)
    swapped, done = polygons.swap_edges(mesh, polygons.swappable(mesh, table).select("eid"))
    assert done.count() and measure.face_areas(swapped, cells(swapped)).where("area <= 0").count() == 0
    assert not validate(swapped).where("violations > 0").count()
    smaller, done = polygons.collapse_edges(mesh, table.where("d = eid").select("eid"))
    k = done.count()
    new = cells(smaller)
    assert k and counts(smaller)["face"] == 32 - 2 * k and counts(smaller)["vertex"] == 25 - k
    areas = measure.face_areas(smaller, new)
    assert areas.where("area <= 0").count() == 0 and areas.agg(F.sum("area")).head()[0] == pytest.approx(16)


def test_delaunay_circles_are_empty(spark):
    rng = random.Random(6)
    pts = {k + 1: (rng.random(), rng.random()) for k in range(40)}
    found = delaunay.triangulate_points(spark.createDataFrame([(k, *p) for k, p in pts.items()], "pid bigint, x double, y double")).collect()
    assert {v for t in found for v in t} == set(pts)
    for t in found:
        (ax, ay), (bx, by), (cx, cy) = (pts[v] for v in t)
        assert (bx - ax) * (cy - ay) - (by - ay) * (cx - ax) > 0
        for k, (px, py) in pts.items():
            if k not in tuple(t):
                rows = [(x - px, y - py, (x - px) ** 2 + (y - py) ** 2) for x, y in ((ax, ay), (bx, by), (cx, cy))]
                (a, b, c), (d, e, f), (g, h, i) = rows
                assert a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g) <= 1e-12


def test_quadtree_balance(spark):
    rng = random.Random(3)
    pts = spark.createDataFrame([(rng.random() ** 3, rng.random() ** 3) for _ in range(200)] + [(1.0, 1.0), (0.0, 0.0)], "x double, y double")
    box = grids.bounding_box(pts)
    leaf = overlay.leaves(overlay.balance(overlay.refine(pts, box, 6, most=2)))
    rows = {(r.level, r.ix, r.iy) for r in leaf.collect()}
    assert sum(0.25**level for level, _, _ in rows) == pytest.approx(1)
    at = {}
    for level, ix, iy in rows:
        for x in range(ix << (6 - level), (ix + 1) << (6 - level)):
            for y in range(iy << (6 - level), (iy + 1) << (6 - level)):
                at[x, y] = level
    assert all(abs(at[x, y] - at[x + 1, y]) <= 1 for x in range(63) for y in range(64))
    assert all(abs(at[x, y] - at[x, y + 1]) <= 1 for x in range(64) for y in range(63))


def test_capture_square(spark):
    pts = spark.createDataFrame([(0, 0.5, 0.5), (1, 1.5, 0.5), (2, 1.5, 1.5), (3, 0.5, 1.5)], "id bigint, x double, y double")
    segments = spark.createDataFrame([(k, k, (k + 1) % 4) for k in range(4)], "seg_id bigint, v0 bigint, v1 bigint")
    hits = capture.grid_intersections(segments, pts, (1.0, 1.0), (0.0, 0.0))
    assert {(r.x, r.y) for r in hits.collect()} == {(1.0, 0.5), (1.5, 1.0), (1.0, 1.5), (0.5, 1.0)}
    placed = capture.intersections_per_edge(hits, (2, 2), (1.0, 1.0), (0.0, 0.0)).orderBy("eid").collect()
    assert [(r.eid, r.t) for r in placed] == [(2, 0.5), (3, 0.5), (7, 0.5), (10, 0.5)]
    assert [r.first_dart for r in placed] == [17, 19, 21, 23]
    assert not capture.orientation_issues(segments).count()
    (nx, ny), _ = capture.overlapping_grid(pts, (1.0, 1.0))
    assert nx >= 2 and ny >= 2


TEXT = "[META]\n0.11.0 2 4\n\n[BETAS]\n0 4 1 2 3\n0 2 3 4 1\n0 0 0 0 0\n\n[UNUSED]\n\n\n[VERTICES]\n1 0 0\n2 1 0\n3 1 1\n4 0 1\n"


def test_text_format(spark):
    mesh = files.parse_cmap(spark, TEXT)
    assert files.format_cmap(files.parse_cmap(spark, files.format_cmap(mesh))) == files.format_cmap(mesh)
    assert counts(mesh) == {"vertex": 4, "edge": 4, "face": 1}
    for bad in ("", "[META]\n1 2\n[BETAS]", TEXT.replace("0.11.0 2 4", "0.11.0 2 x"), TEXT.replace("0 4 1 2 3", "0 4 1 2"), TEXT + "[META]\n", TEXT.replace("[UNUSED]", "[OTHER]"), TEXT.replace("0.11.0 2 4", "0.11.0 5 4")):
        with pytest.raises(MeshError):
            files.parse_cmap(spark, bad)


def test_vtk_round_trip(spark, tmp_path):
    mesh = grids.unit_grid(spark, 2).written()
    assert files.parse_vtk(files.format_vtk(mesh)) == files.parse_vtk(files.format_vtk(mesh, binary=True))
    files.write_vtk(mesh, str(tmp_path / "out"))
    again = files.read_vtk(spark, str(tmp_path / "out" / "*.txt"))
    assert counts(again) == {"vertex": 9, "edge": 12, "face": 4}
    points, found = files.parse_vtk(files.format_vtk(mesh))
    assert len(points) == 9 and sum(t == files.VTK_LINE for t, _ in found) == 8
    files.write_mesh(mesh, str(tmp_path / "mesh"))
    assert counts(files.load_mesh(spark, str(tmp_path / "mesh"))) == counts(mesh)


def test_stream_of_links(spark, tmp_path):
    from weftmesh.streaming.edits import MeshStream, read_ops

    base = str(tmp_path / "stream")
    files.write_mesh(from_n_darts(spark, 6), f"{base}/0")
    (tmp_path / "ops").mkdir()
    (tmp_path / "ops" / "a.json").write_text('{"op_id": 1, "kind": "link", "dim": 1, "l": 1, "r": 2}\n{"op_id": 2, "kind": "link", "dim": 1, "l": 2, "r": 3}\n{"op_id": 3, "kind": "link", "dim": 2, "l": 4, "r": 5}\n')
    MeshStream(spark, base).start(read_ops(spark, str(tmp_path / "ops")), str(tmp_path / "checkpoint")).awaitTermination()
    rows = {r.d: (r.b1, r.b2) for r in files.read_mesh(spark, f"{base}/1").darts.collect()}
    assert rows[1] == (2, 0) and rows[2] == (3, 0) and rows[4] == (0, 5) and rows[5] == (0, 4)


def test_components_match_union_find(spark):
    rng = random.Random(11)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(k, 1000) for k in range(1001, 1100)] + [(2000 + k, 2001 + k) for k in range(60)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    found = {r.node: r.component for r in connected_components(spark.createDataFrame([*edges, (None, 3)], "a bigint, b bigint")).collect()}
    assert found == {x: find(x) for x in parent}
    assert not connected_components(spark.createDataFrame([], "a bigint, b bigint")).count()


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
    assert math.isfinite(polygons.ideal_angle(3))
