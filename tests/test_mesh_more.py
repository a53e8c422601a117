"""Capture, overlay, Delaunay, attribute laws, edits in rounds, and numbering, against plain geometry and brute force."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftmesh.mesh import Attribute, Mesh, MeshError, validate
from weftmesh.operators import capture, delaunay, edits, measure, overlay, polygons, viewer
from weftmesh.operators.cells import cell_counts, cells, orbit_errors, vertex_graph
from weftmesh.plans.numbering import numbered, running_sum
from weftmesh.sources import files, grids


def counts(mesh):
    return {r.kind: r.n for r in cell_counts(mesh).collect()}


def sound(mesh):
    return validate(mesh).where("violations > 0").isEmpty()


def test_numbering(spark):
    rng = random.Random(1)
    rows = [(rng.randint(0, 50), k, rng.randint(0, 9)) for k in range(500)]
    table = spark.createDataFrame(rows, "a int, b int, n int").repartition(9)
    order = sorted(rows)
    assert {(r.a, r.b): r.i for r in numbered(table, ["a", "b"], "i", 7).collect()} == {r[:2]: 7 + k for k, r in enumerate(order)}
    before = dict(zip([r[:2] for r in order], itertools.accumulate([3, *[r[2] for r in order]]), strict=False))
    assert {(r.a, r.b): r.s for r in running_sum(table, ["a", "b"], "n", "s", 3).collect()} == before
    assert numbered(table.where("a > 99"), ["a", "b"], "i").count() == 0


def _star(spark, n=7):
    at = [(k, 3 + 2.2 * math.cos(2 * math.pi * k / n) * (1 + 0.3 * (k % 2)), 3 + 2.2 * math.sin(2 * math.pi * k / n) * (1 + 0.3 * (k % 2))) for k in range(n)]
    area = sum(a[1] * b[2] - b[1] * a[2] for a, b in zip(at, at[1:] + at[:1], strict=True)) / 2
    points = spark.createDataFrame(at, "id bigint, x double, y double")
    segments = spark.createDataFrame([(k, k, (k + 1) % n) for k in range(n)], "seg_id bigint, v0 bigint, v1 bigint")
    return points, segments, area


def test_capture_of_a_star(spark):
    points, segments, area = _star(spark)
    whole = capture.grisubal(points, segments, points.select("id"), (1.0, 1.0), None, True)
    assert sound(whole.mesh) and counts(whole.mesh)["vertex"] - counts(whole.mesh)["edge"] + counts(whole.mesh)["face"] == 1
    for side, inside in ((capture.RIGHT, True), (capture.LEFT, False)):
        kept = capture.clip_side(whole, side)
        table = cells(kept.mesh).join(kept.mesh.darts.where("not unused").select("d"), "d", "left_semi")
        total = measure.face_areas(kept.mesh, table).agg(F.sum("area")).head()[0]
        everything = measure.face_areas(whole.mesh, cells(whole.mesh)).agg(F.sum("area")).head()[0]
        assert total == pytest.approx(area if inside else everything - area) and sound(kept.mesh)
        assert kept.nodes.count() == 7
    with pytest.raises(MeshError):
        capture.grisubal(points, segments.unionByName(spark.createDataFrame([(9, 0, 3)], segments.schema)), points.select("id"), (1.0, 1.0))
    with pytest.raises(MeshError):
        capture.clip_side(whole, "Up")


def test_two_loops_against_each_other_are_inconsistent(spark):
    square = lambda x, ids: [(ids[0], x, 0.4), (ids[1], x + 2.2, 0.4), (ids[2], x + 2.2, 2.6), (ids[3], x, 2.6)]
    points = spark.createDataFrame(square(0.3, (0, 1, 2, 3)) + square(5.3, (7, 6, 5, 4)), "id bigint, x double, y double")
    loops = [(k, k, (k + 1) % 4) for k in range(4)] + [(4 + k, 4 + k, 4 + (k + 1) % 4) for k in range(4)]
    segments = spark.createDataFrame(loops, "seg_id bigint, v0 bigint, v1 bigint")
    with pytest.raises(MeshError):
        capture.grisubal(points, segments, points.select("id"), (1.0, 1.0), capture.RIGHT)


def test_segments_without_crossings_are_skipped(spark):
    """A fine circle: most segments stay in one cell, and without points of interest only crossings are kept."""
    n = 90
    points = spark.createDataFrame([(k, 3 + 1.7 * math.cos(2 * math.pi * k / n + 0.01), 3 + 1.7 * math.sin(2 * math.pi * k / n + 0.01)) for k in range(n)] + [(500 + k, 3.02 + 0.1 * k % 0.3, 3.01 + 0.05 * (k == 1)) for k in range(3)], "id bigint, x double, y double")
    segments = spark.createDataFrame([(k, k, (k + 1) % n) for k in range(n)] + [(500 + k, 500 + k, 500 + (k + 1) % 3) for k in range(3)], "seg_id bigint, v0 bigint, v1 bigint")
    got = capture.grisubal(points, segments, points.select("id").limit(0), (1.0, 1.0), capture.RIGHT)
    kept = cells(got.mesh).join(got.mesh.darts.where("not unused").select("d"), "d", "left_semi")
    total = measure.face_areas(got.mesh, kept).agg(F.sum("area")).head()[0]
    assert sound(got.mesh) and 0.85 * math.pi * 1.7**2 < total < math.pi * 1.7**2 and got.nodes.count() == 0


def test_overlay_mesh_and_dual(spark):
    rng = random.Random(3)
    pts = spark.createDataFrame([(rng.random() ** 3, rng.random() ** 3) for _ in range(80)], "x double, y double")
    box = {"min_x": 0.0, "max_x": 1.0, "min_y": 0.0, "max_y": 1.0}
    leaf = overlay.materialize(overlay.leaves(overlay.balance(overlay.refine(pts, box, 4, 2))), "leaves")
    plain, regular = overlay.refined_mesh(leaf, box, 4), overlay.regularize(leaf, box, 4)
    for mesh in (plain, regular):
        assert sound(mesh) and measure.face_areas(mesh, cells(mesh)).agg(F.sum("area")).head()[0] == pytest.approx(1)
    assert counts(plain)["face"] == leaf.count()
    assert {r.n for r in vertex_graph(regular, cells(regular)).groupBy("vid").agg(F.count("*").alias("n")).select("n").distinct().collect()} == {4}
    dual = overlay.dualize(regular)
    area = measure.face_areas(dual, cells(dual))
    assert sound(dual) and {r.n for r in area.select("n").distinct().collect()} == {4} and area.where("area <= 0").isEmpty()
    moved = regular.with_(vertices=regular.vertices.unionByName(spark.createDataFrame([(10**9, 0.0, 0.0)], "vid bigint, x double, y double")))
    assert overlay.remove_dangling_darts(moved).vertices.count() == counts(regular)["vertex"]


def _brute(places, dim):
    ids = sorted(places)
    at = np.array([places[i] for i in ids])
    some = np.array(list(itertools.combinations(range(len(ids)), dim + 1)))
    center, square = delaunay._spheres(at, some)
    inside = ((at[None] - center[:, None]) ** 2).sum(axis=2) < square[:, None] * (1 - 1e-12)
    np.put_along_axis(inside, some, False, axis=1)
    return {tuple(ids[x] for x in c) for c in some[~inside.any(axis=1)]}


@pytest.mark.parametrize(("dim", "n", "block"), [(2, 50, 8), (2, 3, 300), (3, 26, 6), (3, 26, 300)])
def test_delaunay_matches_brute_force(spark, dim, n, block):
    rng = random.Random(dim * n)
    places = {k + 1: tuple(rng.random() ** 2 for _ in range(dim)) for k in range(n)}
    table = spark.createDataFrame([(k, *p) for k, p in places.items()], "pid bigint, " + ", ".join(f"{a} double" for a in "xyz"[:dim]))
    found = delaunay.simplices(table, dim, block)
    rows = [tuple(r) for r in found.collect()]
    assert {tuple(sorted(r)) for r in rows} == _brute(places, dim) and len(rows) == len(set(rows))
    assert delaunay.wrong_orientations(numbered(found, found.columns, "t"), table, dim).isEmpty()


def test_delaunay_insertion(spark):
    rng = random.Random(4)
    schema = "pid bigint, x double, y double, z double"
    frame = [(100 + k, *p) for k, p in enumerate([(-4.1, -4.3, -4.2), (5.4, -3.9, -4.1), (-4.0, 5.3, -3.8), (-3.7, -4.4, 5.2), (4.9, 5.1, 5.6)])]
    inner = [(k, rng.random(), rng.random(), rng.random()) for k in range(24)]
    old, new = spark.createDataFrame(frame + inner[:16], schema), spark.createDataFrame(inner[16:], schema)
    tets = delaunay.materialize(numbered(delaunay.tetrahedralize(old), ["a", "b", "c", "d"], "t"), "tets")
    held = delaunay.cavities(tets, old, new)
    assert held.join(delaunay.locate(tets, old, new), ["pid", "t"]).count() == 8  # each cavity has the tetrahedron that holds the point
    out = delaunay.insert_points(tets, old, new)
    assert {tuple(sorted((r.a, r.b, r.c, r.d))) for r in out.collect()} == _brute({r[0]: r[1:] for r in frame + inner}, 3)
    with pytest.raises(MeshError):
        delaunay.insert_points(tets, old, spark.createDataFrame([(999, 50.0, 0.0, 0.0)], schema))
    assert delaunay.derive_seed(0) == 16294208416658607535


def test_box_of_tetrahedra(spark):
    where, tets = delaunay.delaunay_box(spark, (2.0, 1.0, 1.0), 60, 3)
    mesh = delaunay.mesh_of_tetrahedra(tets, where)
    n = counts(mesh)
    assert sound(mesh) and n["vertex"] == 68 and n["vertex"] - n["edge"] + n["face"] - n["volume"] == 1
    assert delaunay.volumes(numbered(tets, ["a", "b", "c", "d"], "t"), where).agg(F.sum("volume")).head()[0] == pytest.approx(2)


def _apart(spark):
    rows = [(1, 3, 2, 0), (2, 1, 3, 0), (3, 2, 1, 0), (4, 6, 5, 0), (5, 4, 6, 0), (6, 5, 4, 0)]
    darts = spark.createDataFrame([(*r, False) for r in rows], "d bigint, b0 bigint, b1 bigint, b2 bigint, unused boolean")
    points = spark.createDataFrame([(1, 0.0, 0.0), (2, 1.0, 0.0), (3, 0.0, 1.0), (4, 0.0, 2.0), (5, 2.0, 0.0), (6, 1.0, 1.0)], "vid bigint, x double, y double")
    return Mesh(2, darts, points)


def test_sews_ask_the_laws(spark):
    mesh, ops = _apart(spark), spark.createDataFrame([(1, 2, 4)], "op_id bigint, l bigint, r bigint")
    anchor = lambda rows: edits.anchor_attribute("vertex", spark.createDataFrame([(c, (d, i)) for c, d, i in rows], "cell_id bigint, value struct<dim:int,id:int>"))
    failing = mesh.add_attribute("anchor", anchor([(2, 1, 5), (5, 1, 6), (3, 0, 1), (4, 2, 2)]))
    out, result = edits.sew(failing, ops, 2)
    assert [tuple(r) for r in result.collect()] == [(1, False, "FailedMerge")] and out.darts.where("b2 > 0").isEmpty() and out.vertices.count() == 6
    assert out.n_attributes("anchor") == 4
    fine = mesh.add_attribute("anchor", anchor([(2, 1, 5), (5, 0, 6), (3, 0, 1), (4, 2, 2)]))
    out, result = edits.sew(fine, ops, 2)
    assert result.head().ok and {r.cell_id: tuple(r.value) for r in out.attrs["anchor"].table.collect()} == {2: (0, 6), 3: (0, 1)}
    weight = Attribute("vertex", spark.createDataFrame([(2, 1.0)], "cell_id bigint, value double"), lambda a, b: a + b)
    _, result = edits.sew(mesh.add_attribute("weight", weight), ops, 2)
    assert result.head().err == "InsufficientData"
    kept = Attribute(**{**weight.__dict__, "merge_one": lambda v: v, "merge_none": lambda: F.lit(-1.0)})
    out, result = edits.sew(mesh.add_attribute("weight", kept), ops, 2)
    assert result.head().ok and {r.cell_id: r.value for r in out.attrs["weight"].table.collect()} == {2: 1.0, 3: -1.0}


def test_unsews_split_into_many_parts(spark):
    mesh = grids.unit_grid(spark, 2).written()
    middle = cells(mesh).groupBy("vid").agg(F.count("*").alias("n")).where("n = 4").head().vid
    load = Attribute("vertex", mesh.vertices.select(F.col("vid").alias("cell_id"), F.lit(8.0).alias("value")), lambda a, b: a + b, split=lambda v: (v / 2, v / 2))
    ops = mesh.darts.where("b2 > d").select(F.col("d").alias("op_id"), F.col("d").alias("l"))
    out, result = edits.unsew(mesh.add_attribute("load", load), ops, 2)
    values = {r.cell_id: r.value for r in out.attrs["load"].table.collect()}
    parts = sorted(r.d for r in cells(mesh).where(F.col("vid") == middle).collect())
    assert [values[d] for d in parts] == [4.0, 2.0, 1.0, 1.0] and sum(values.values()) == pytest.approx(8.0 * 9)
    assert all(r.ok for r in result.collect()) and len(values) == 16
    stuck = Attribute(**{**load.__dict__, "split": None})
    _, result = edits.unsew(mesh.add_attribute("load", stuck), ops, 2)
    assert {r.err for r in result.collect()} == {"FailedSplit"}


def test_collapses_with_anchors(spark):
    mesh = grids.unit_triangles(spark, 4).written()
    table = cells(mesh)
    at = table.select("d", "vid").join(mesh.vertices, "vid")
    corner = at.where("x = 2 and y = 2").head().vid
    inner = (F.col("x") > 0) & (F.col("x") < 4) & (F.col("y") > 0) & (F.col("y") < 4)
    vertex = mesh.vertices.select("vid", F.when(F.col("vid") == corner, 0).when(inner, 2).otherwise(1).alias("dim"), F.lit(0).alias("id"))
    edge = table.select("eid").distinct().select("eid", F.lit(2).alias("dim"), F.lit(0).alias("id"))
    out, done, anchors = polygons.collapse_anchored(mesh, table.select("eid").distinct(), vertex, edge)
    assert done.count() and sound(out) and measure.face_areas(out, cells(out)).agg(F.sum("area"), F.min("area")).head()[0] == pytest.approx(16)
    assert [tuple(r) for r in out.vertices.join(anchors.where("dim = 0"), "vid").select("x", "y").collect()] == [(2.0, 2.0)]
    stuck = vertex.withColumn("id", F.col("vid")).withColumn("dim", F.lit(2))
    assert polygons.collapse_anchored(mesh, table.select("eid").distinct(), stuck, edge)[1].isEmpty()


def test_stream_keeps_order_and_attributes(spark, tmp_path):
    from weftmesh.streaming.edits import MeshStream, read_ops

    base, mesh = str(tmp_path / "stream"), grids.unit_grid(spark, 2)
    load = Attribute("face", spark.createDataFrame([(1, 5)], "cell_id bigint, value int"), lambda a, b: a + b)
    files.write_mesh(mesh.add_attribute("load", load), f"{base}/0")
    (tmp_path / "ops").mkdir()
    ops = ['{"op_id": 1, "kind": "unlink", "dim": 2, "l": 2}', '{"op_id": 2, "kind": "link", "dim": 2, "l": 8, "r": 1}', '{"op_id": 3, "kind": "unlink", "dim": 2, "l": 1}', '{"op_id": 4, "kind": "link", "dim": 2, "l": 2, "r": 8}', '{"op_id": 5, "kind": "link", "dim": 2}']
    (tmp_path / "ops" / "a.json").write_text("\n".join(ops))
    stream = MeshStream(spark, base, {"load": load})
    stream.start(read_ops(spark, str(tmp_path / "ops")), str(tmp_path / "checkpoint")).awaitTermination()
    results = {r.op_id: r.ok for r in spark.read.parquet(f"{base}/results/0").collect()}
    assert results == {1: True, 2: True, 3: True, 4: True, 5: False}
    after = files.read_mesh(spark, f"{base}/1", {"load": load})
    assert {r.d: r.b2 for r in after.darts.collect()} == {r.d: r.b2 for r in mesh.darts.collect()}
    assert after.n_attributes("load") == 1
    stream.apply(spark.read.schema("op_id bigint, kind string, dim int, l bigint, r bigint").json(str(tmp_path / "ops")), 0)  # a replay writes the same version
    assert files.read_mesh(spark, f"{base}/1").darts.count() == 16


def test_viewer_tables(spark):
    found = viewer.extract(grids.unit_triangles(spark, 2).written())
    assert {k: v.count() for k, v in found.items()} == {"vertices": 9, "edges": 16, "faces": 8, "darts": 24, "normals": 24}
    assert all(len(r.corners) == 3 for r in found["faces"].collect())
    assert viewer.shrunk(found["vertices"], found["normals"], 0.1).count() == 24
    assert orbit_errors(grids.unit_grid(spark, 1), "face", spark.createDataFrame([(0,), (1,), (99,)], "d bigint")).count() == 2
