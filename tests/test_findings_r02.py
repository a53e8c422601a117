"""Cases of the findings of round 2."""

import time

import duckdb
import numpy as np

from weftmesh import queries
from weftmesh.operators import capture, delaunay, edits, measure, planar
from weftmesh.operators import cells as cell_module
from weftmesh.operators.cells import cells

# Quantities of polygons whose area ends in a half of its fourth decimal.
TIES = [
    [22, 39, 34, 50, 18, 34], [29, 22, 33, 43, 41, 19], [13, 44, 14, 33, 1, 24], [20, 12, 10, 39, 2, 18], [6, 26, 9, 19, 15, 45], [7, 27, 7, 39, 35, 34],
    [43, 42, 5, 6, 38, 13], [47, 10, 30, 13, 23, 6], [39, 30, 6, 22, 7, 37, 46, 48], [1, 30, 11, 27, 2, 40], [18, 24, 21, 34, 10, 14, 21, 27], [32, 15, 37, 49, 6, 17, 31, 35],
]


def test_areas_of_cut_polygons_agree_with_sql_at_ties(spark, tmp_path):
    rows = [(cell, 1, 1, k, float(q), 1.0) for cell, polygon in enumerate(TIES) for k, q in enumerate(polygon)]
    items = spark.createDataFrame(rows, "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double")
    items.coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    found = sorted(tuple(r) for r in queries.ear_clipping(spark, str(tmp_path)).collect())
    with duckdb.connect() as db:
        db.sql(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet/*.parquet'")
        assert found == sorted(db.sql(queries.SQL["ear_clipping"]).fetchall())


def test_triangulation_of_a_block_is_not_quadratic():
    at = np.random.default_rng(3).random((8000, 2))
    start = time.process_time()
    found = delaunay.triangulated(at)
    seconds = time.process_time() - start
    turns = np.linalg.det(at[found[:, 1:]] - at[found[:, :1]])
    assert (turns > 0).all() and seconds < 1.2


def rows_in_blocks(monkeypatch):
    """Rows of the tables that blocks get, by round."""
    rows, write = [], delaunay.materialize

    def noted(table, name):
        out = write(table, name)
        if name == "delaunay-members":
            rows.append((out.count(), max(r[0] for r in out.groupBy("own").count().select("count").collect())))
        return out

    monkeypatch.setattr(delaunay, "materialize", noted)
    return rows


def test_blocks_at_the_hull_do_not_take_all_points(spark, monkeypatch):
    rows = rows_in_blocks(monkeypatch)
    at = np.random.default_rng(4).random((3000, 3))
    at[:8] = [[k & 1, k >> 1 & 1, k >> 2] for k in range(8)]
    table = spark.createDataFrame([(k, *map(float, p)) for k, p in enumerate(at)], "pid bigint, x double, y double, z double")
    found = np.array(delaunay.tetrahedralize(table, 60).collect())
    volume = np.linalg.det(at[found[:, 1:]] - at[found[:, :1]]) / 6
    assert abs(abs(volume.sum()) - 1) < 1e-6
    assert len(found) == len(delaunay.triangulated(at))
    assert rows and max(most for _, most in rows) < 1500  # a block gets its points, a halo and the points in its spheres


def test_points_within_a_wide_frame_are_spread_over_blocks(spark, monkeypatch):
    rows = rows_in_blocks(monkeypatch)
    at = np.random.default_rng(5).random((2000, 3))
    at[:5] = [[-9.1, -9.3, -9.2], [10.4, -8.9, -9.1], [-9.0, 10.3, -8.8], [-8.7, -9.4, 10.2], [9.9, 10.1, 10.6]]
    table = spark.createDataFrame([(k, *map(float, p)) for k, p in enumerate(at)], "pid bigint, x double, y double, z double")
    found = {tuple(sorted(r)) for r in delaunay.tetrahedralize(table, 60).collect()}
    assert found == {tuple(sorted(t)) for t in delaunay.triangulated(at).tolist()}
    assert rows and max(most for _, most in rows) < 1500


def test_capture_keeps_points_a_rounding_error_from_grid_lines_apart(spark):
    # Spikes whose tips end within a few roundings of a grid line, far from the origin.
    near = 240 + np.array([0.0, 4e-14, -4e-14, 1e-13])
    at = [(239.25, -1.0)]
    for k, x in enumerate(near.tolist()):
        at += [(x, -0.9 + 0.4 * k), (239.4, -0.7 + 0.4 * k)]
    at += [(239.3, 1.0), (238.75, 0.0)]
    points = spark.createDataFrame([(k, *p) for k, p in enumerate(at)], "id bigint, x double, y double")
    segments = spark.createDataFrame([(k, k, (k + 1) % len(at)) for k in range(len(at))], "seg_id bigint, v0 bigint, v1 bigint")
    _, origin = capture.overlapping_grid(points, (0.5, 0.5), clearance=capture.CLEARANCE)
    steps = (np.array(at) - origin) / 0.5
    assert np.abs(steps - np.round(steps)).min() >= capture.CLEARANCE
    mesh, _ = capture.first_mesh(points, segments, points.select("id"), (0.5, 0.5), capture.RIGHT)
    areas = [r.area for r in measure.face_areas(mesh, cells(mesh)).collect()]
    x, y = np.array(at).T
    assert min(areas) > 0 and abs(sum(areas) - (x * np.roll(y, -1) - np.roll(x, -1) * y).sum() / 2) < 1e-9


def test_areas_of_small_faces_far_from_the_origin(spark):
    at = [(239.875, 3.5), (239.875 + 2**-22, 3.5), (239.875, 3.5 + 2**-24)]
    points = spark.createDataFrame([(k, *p) for k, p in enumerate(at)], "id bigint, x double, y double")
    loops = spark.createDataFrame([(1, k, k) for k in range(3)], "f bigint, k int, u bigint")
    mesh, _ = planar.mesh_of_loops(loops, points)
    assert measure.face_areas(mesh, cells(mesh)).head().area == 2.0**-47


def test_three_sews_keep_the_corners_that_they_know(spark, monkeypatch):
    walks, doubled = [], cell_module._doubled
    monkeypatch.setattr(cell_module, "_doubled", lambda *a: walks.append(a[1:]) or doubled(*a))
    mesh, ops = queries._blocks(spark, "/root/testdata/sf0.001")
    sewn = edits.sew(mesh, ops, 3)[0]
    back = edits.unsew(sewn, ops.select("op_id", "l"), 3)[0]
    assert len(walks) == 1  # around the corners of each volume, which 3-links leave as they are
    assert sorted(tuple(r) for r in back.vertices.collect()) == sorted(tuple(r) for r in mesh.vertices.collect())
    for known in (sewn, back):
        assert known.ids["vertex"].exceptAll(cell_module.cell_ids(known.with_(darts=known.darts), "vertex")).isEmpty()
