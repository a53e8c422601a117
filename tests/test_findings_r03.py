"""Cases of the findings of round 3."""

import time

import numpy as np

from weftmesh.operators import capture, measure, polygons
from weftmesh.operators import cells as cell_module
from weftmesh.operators.cells import cells
from weftmesh.plans.components import connected_components


def star(n, x=0.3):
    angle = 2 * np.pi * np.arange(n) / n
    radius = 2 + np.random.default_rng(n).integers(0, 8, n) / 8
    return np.array([x + radius * np.cos(angle), 0.7 + radius * np.sin(angle)]).T


def test_ears_of_many_corners_do_not_cost_their_cube():
    at = star(1500)
    start = time.process_time()
    err, found = polygons._ears([tuple(p) for p in at.tolist()], True)
    assert time.process_time() - start < 10
    a, b, c = (at[list(k)] for k in zip(*found, strict=True))
    areas = ((b - a)[:, 0] * (c - a)[:, 1] - (b - a)[:, 1] * (c - a)[:, 0]) / 2
    x, y = at.T
    assert err is None and len(found) == 1498 and areas.min() > 0
    assert abs(areas.sum() - (x * np.roll(y, -1) - np.roll(x, -1) * y).sum() / 2) < 1e-9


def test_captured_mesh_knows_its_cells(spark, monkeypatch):
    monkeypatch.setattr(cell_module, "LOT_ROWS", 50)  # so that lots cut faces
    at = np.concatenate([star(120), star(90, 10.3)])
    points = spark.createDataFrame([(k, *p) for k, p in enumerate(at.tolist())], "id bigint, x double, y double")
    segments = spark.createDataFrame([(k, k, k + 1 if k not in (119, 209) else (0 if k == 119 else 120)) for k in range(210)], "seg_id bigint, v0 bigint, v1 bigint")
    kept = capture.capture_geometry(points, segments, points.select("id"), (0.5, 0.5))
    clipped = capture.clip_side(kept, capture.RIGHT)
    for mesh in (kept.mesh, clipped.mesh):
        plain = mesh.with_(darts=mesh.darts)
        for kind in ("vertex", "face"):
            known, walked = mesh.ids[kind], cell_module.cell_ids(plain, kind)
            assert known.exceptAll(walked).isEmpty() and walked.exceptAll(known).isEmpty()
    mesh, anchors = capture.first_mesh(points, segments, points.select("id"), (0.5, 0.5), capture.RIGHT)
    areas = measure.face_areas(mesh, cells(mesh)).join(anchors["face"], "fid").groupBy("id").agg({"area": "sum"}).orderBy("id").collect()
    for row, ring in zip(areas, (at[:120], at[120:]), strict=True):
        x, y = ring.T
        assert abs(row[1] - (x * np.roll(y, -1) - np.roll(x, -1) * y).sum() / 2) < 1e-9


def test_components_in_one_task_are_those_of_the_rounds(spark):
    ends = np.random.default_rng(6).integers(-50, 400, (250, 2)).tolist()
    edges = spark.createDataFrame([*ends, [None, 3], [7, 7]], "a bigint, b bigint")
    rounds, at_once = connected_components(edges), connected_components(edges, one_task_rows=1000)
    assert sorted(map(tuple, rounds.collect())) == sorted(map(tuple, at_once.collect()))
    assert connected_components(edges.limit(0), one_task_rows=10).isEmpty()
