"""Dart allocation, links, sews and attribute updates as batches.

A batch is a table of operations.  It is checked against the mesh as it is
(every operation that fails gets its error, and none of its writes), and must be
free of conflicts: operations that would write one image twice, or touch one
cell twice, fail with ``Conflict``; :func:`schedule` splits any batch into
conflict-free rounds.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..mesh import Attribute, Mesh, MeshError, is_free
from ..plans.numbering import numbered
from ..plans.storage import materialize
from .cells import cell_ids, corner_parts

# darts


def allocate(mesh: Mesh, n: int, unused: bool = False) -> tuple[Mesh, int]:
    """The mesh with n more slots, and the first new dart."""
    first = mesh.n_darts()
    zero = F.lit(0).cast("bigint")
    more = mesh.spark.range(first, first + n).select(F.col("id").alias("d"), *[zero.alias(b) for b in mesh.images], F.lit(unused).alias("unused"))
    return mesh.with_(darts=mesh.darts.unionByName(more)), first


def reserve(mesh: Mesh, n: int, start: int = 1) -> tuple[Mesh, DataFrame]:
    """Claim the first n unused darts from ``start`` on, going round; an error if there are fewer."""
    some = materialize(mesh.darts.where("unused").select("d", (F.col("d") < start).cast("int").alias("round")).orderBy("round", "d").limit(n), "reserved")
    taken = materialize(numbered(some, ["round", "d"], "pos", 1).select("d", "pos"), "reserved")
    if taken.count() < n:
        raise MeshError(f"could not reserve {n} darts")
    darts = mesh.darts.join(taken.select("d", F.lit(True).alias("_taken")), "d", "left")
    return mesh.with_(darts=darts.withColumn("unused", F.col("unused") & F.col("_taken").isNull()).drop("_taken")), taken


def claim(mesh: Mesh, which: DataFrame) -> tuple[Mesh, DataFrame]:
    """Mark the darts in ``which`` (d) as used: (mesh, (d, was_unused)); unknown darts have no row."""
    state = materialize(which.select("d").distinct().join(mesh.darts, "d").select("d", F.col("unused").alias("was_unused")), "claimed")
    darts = mesh.darts.join(state.select("d", F.lit(True).alias("_claimed")), "d", "left")
    return mesh.with_(darts=darts.withColumn("unused", F.col("unused") & F.col("_claimed").isNull()).drop("_claimed")), state


def release(mesh: Mesh, which: DataFrame) -> tuple[Mesh, DataFrame]:
    """Free slots of the darts in ``which`` (d): (mesh, (d, ok, was_unused)); darts with images stay."""
    state = which.select("d").distinct().join(mesh.darts, "d").select("d", is_free(mesh.dim).alias("ok"), F.col("unused").alias("was_unused"))
    state = materialize(state, "released")
    gone = state.where("ok").select("d", F.lit(True).alias("_gone"))
    darts = mesh.darts.join(gone, "d", "left").withColumn("unused", F.col("unused") | F.coalesce("_gone", F.lit(False))).drop("_gone")
    vertices = mesh.vertices.join(gone.select(F.col("d").alias("vid")), "vid", "left_anti")
    attrs = {k: Attribute(**{**a.__dict__, "table": a.table.join(gone.select(F.col("d").alias("cell_id")), "cell_id", "left_anti")}) for k, a in mesh.attrs.items()}
    return mesh.with_(darts=darts, vertices=vertices, attrs=attrs), state


def set_images(mesh: Mesh, writes: DataFrame) -> Mesh:
    """Raw writes (d, i, value); of several for one image the last by value counts.  Inverses are the caller's."""
    wide = writes.groupBy("d").agg(*[F.max(F.when(F.col("i") == i, F.col("value"))).alias(f"_b{i}") for i in range(mesh.dim + 1)])
    darts = mesh.darts.join(wide, "d", "left")
    return mesh.with_(darts=darts.select("d", *[F.coalesce(f"_b{i}", f"b{i}").cast("bigint").alias(f"b{i}") for i in range(mesh.dim + 1)], "unused"))


# links


def _writes(i: int) -> Column:
    """Both images that linking l and r by i writes."""
    back = 0 if i == 1 else i
    return F.inline(F.array(F.struct(F.col("l").alias("d"), F.lit(i).alias("i"), F.col("r").alias("value")), F.struct(F.col("r").alias("d"), F.lit(back).alias("i"), F.col("l").alias("value"))))


def _conflicts(ops: DataFrame, touched: DataFrame) -> DataFrame:
    """Operations that touch (op_id, key) something that an operation before them touches."""
    first = touched.groupBy("key").agg(F.min("op_id").alias("first"))
    return touched.join(first, "key").where("op_id > first").select("op_id").distinct()


def _with_state(mesh: Mesh, ops: DataFrame, i: int) -> DataFrame:
    back = 0 if i == 1 else i
    left = mesh.darts.select(F.col("d").alias("l"), F.col(f"b{i}").alias("l_image"), F.col("unused").alias("l_unused"))
    right = mesh.darts.select(F.col("d").alias("r"), F.col(f"b{back}").alias("r_image"))
    return ops.join(left, "l", "left").join(right, "r", "left")


def _paired(mesh: Mesh, ops: DataFrame) -> tuple[DataFrame, DataFrame]:
    """3-links pair two faces: (op_id, l, r) for all their darts, and the operations whose faces don't fit."""
    ahead = mesh.darts.select(F.col("d").alias("from"), "b0", "b1")
    state = ops.select("op_id", "l", "r", F.lit(0).cast("bigint").alias("step"), F.lit(1).alias("way"))
    pairs = frontier = materialize(state.select("op_id", "l", "r", "step"), "three-pairs")
    bad = None
    while True:
        # One step along b1 on the left and b0 on the right; the faces of a batch are walked together.
        # One join serves both ends: an operation that lacks one of them, or its dart, goes no further.
        ends = frontier.select("op_id", "step", F.inline(F.array(F.struct(F.col("l").alias("from"), F.lit(True).alias("left")), F.struct(F.col("r").alias("from"), F.lit(False).alias("left")))))
        ends = ends.join(ahead, "from").groupBy("op_id", "step").agg(F.max(F.when(F.col("left"), F.col("b1"))).alias("l"), F.max(F.when(~F.col("left"), F.col("b0"))).alias("r"))
        nxt = ends.where("l is not null and r is not null").select("op_id", "l", "r", (F.col("step") + 1).alias("step"))
        start = ops.select("op_id", F.col("l").alias("l0"), F.col("r").alias("r0"))
        nxt = materialize(nxt.join(start, "op_id"), "three-step")
        closed_l, closed_r = F.col("l").isin(0) | (F.col("l") == F.col("l0")), F.col("r").isin(0) | (F.col("r") == F.col("r0"))
        uneven = nxt.where(closed_l != closed_r).select("op_id")
        bad = uneven if bad is None else bad.union(uneven)
        frontier = materialize(nxt.where(~closed_l & ~closed_r).select("op_id", "l", "r", "step"), "three-frontier")
        if frontier.isEmpty():
            return pairs, bad.distinct()
        pairs = materialize(pairs.unionByName(frontier), "three-pairs")


def link(mesh: Mesh, ops: DataFrame, i: int) -> tuple[Mesh, DataFrame]:
    """ops (op_id, l, r): (mesh, (op_id, ok, err)).  In 3D a 1-link is mirrored on the other side and a 3-link pairs whole faces."""
    if not 1 <= i <= mesh.dim:
        raise MeshError(f"no {i}-links in {mesh.dim} dimensions")
    ops = materialize(ops.select("op_id", "l", "r"), "links")
    bad = None
    single = ops
    if i == 3:
        single, bad = _paired(mesh, ops)
        single = single.select("op_id", "l", "r")
    elif i == 1 and mesh.dim == 3:
        other = mesh.darts.select("d", "b3").where("b3 <> 0")
        mirrored = ops.join(other.select(F.col("d").alias("l"), F.col("b3").alias("l3")), "l").join(other.select(F.col("d").alias("r"), F.col("b3").alias("r3")), "r")
        single = ops.union(mirrored.select("op_id", F.col("r3").alias("l"), F.col("l3").alias("r")))
    checked = _with_state(mesh, single, i)
    err = F.when(F.col("l_image").isNull() | F.col("r_image").isNull(), "UnknownDart").when(F.col("l_image") != 0, "NonFreeBase").when(F.col("r_image") != 0, "NonFreeImage")
    errors = checked.select("op_id", err.alias("err")).where("err is not null").groupBy("op_id").agg(F.min("err").alias("err"))
    if bad is not None:
        errors = errors.unionByName(bad.select("op_id", F.lit("AsymmetricalFaces").alias("err"))).groupBy("op_id").agg(F.min("err").alias("err"))
    back = 0 if i == 1 else i
    touched = single.select("op_id", F.inline(F.array(F.struct(F.concat(F.col("l").cast("string"), F.lit(f":{i}")).alias("key")), F.struct(F.concat(F.col("r").cast("string"), F.lit(f":{back}")).alias("key")))))
    clash = _conflicts(ops, touched).select("op_id", F.lit("Conflict").alias("err"))
    errors = materialize(errors.unionByName(clash.join(errors, "op_id", "left_anti")), "link-errors")
    result = ops.join(errors, "op_id", "left").select("op_id", F.col("err").isNull().alias("ok"), "err")
    good = single.join(errors.select("op_id"), "op_id", "left_anti")
    return set_images(mesh, good.select(_writes(i))), result


def unlink(mesh: Mesh, ops: DataFrame, i: int) -> tuple[Mesh, DataFrame]:
    """ops (op_id, l): (mesh, (op_id, ok, err, r)); r is the dart that was linked."""
    if not 1 <= i <= mesh.dim:
        raise MeshError(f"no {i}-links in {mesh.dim} dimensions")
    ops = ops.select("op_id", "l")
    now = mesh.darts.select(F.col("d").alias("l"), F.col(f"b{i}").alias("r"))
    found = materialize(ops.join(now, "l", "left"), "unlinks")
    single = found.where("r <> 0").select("op_id", "l", "r")
    bad = None
    if i == 3:
        single, bad = _paired(mesh, single)
        image = mesh.darts.select(F.col("d").alias("l"), F.col("b3").alias("l_image"))
        apart = single.join(image, "l").where("l_image <> r").select("op_id")
        bad = bad.union(apart).distinct()
        single = single.select("op_id", "l", "r")
    elif i == 1 and mesh.dim == 3:
        other = mesh.darts.select("d", "b3").where("b3 <> 0")
        mirrored = single.join(other.select(F.col("d").alias("l"), F.col("b3").alias("l3")), "l").join(other.select(F.col("d").alias("r"), F.col("b3").alias("r3")), "r")
        mirrored = mirrored.join(mesh.darts.select(F.col("d").alias("r3"), F.col("b1").alias("expected")), "r3")
        bad = mirrored.where("expected <> l3").select("op_id").distinct()
        single = single.union(mirrored.select("op_id", F.col("r3").alias("l"), F.col("l3").alias("r")))
    err = F.when(F.col("r").isNull(), "UnknownDart").when(F.col("r") == 0, "AlreadyFree")
    errors = found.select("op_id", err.alias("err")).where("err is not null")
    if bad is not None:
        errors = errors.unionByName(bad.select("op_id", F.lit("AsymmetricalFaces").alias("err")))
    touched = single.select("op_id", F.explode(F.array("l", "r")).alias("key"))
    clash = _conflicts(ops, touched).select("op_id", F.lit("Conflict").alias("err"))
    errors = materialize(errors.unionByName(clash).groupBy("op_id").agg(F.min("err").alias("err")), "unlink-errors")
    result = found.join(errors, "op_id", "left").select("op_id", F.col("err").isNull().alias("ok"), "err", "r")
    good = single.join(errors.select("op_id"), "op_id", "left_anti")
    zero = F.lit(0).cast("bigint")
    cleared = good.select(_writes(i)).withColumn("value", zero)
    return set_images(mesh, cleared), result


# attributes


def merge_values(attribute: Attribute, ops: DataFrame) -> tuple[DataFrame, DataFrame]:
    """ops (op_id, out, l, r): (new table, (op_id, err)).  Inputs are cleared, then outputs written."""
    table = attribute.table
    left, right = (table.select(F.col("cell_id").alias(c), F.col("value").alias(f"{c}v")) for c in ("l", "r"))
    both = ops.join(left, "l", "left").join(right, "r", "left")
    lv, rv = F.col("lv"), F.col("rv")
    lone = attribute.merge_one(F.coalesce(lv, rv)) if attribute.merge_one else None
    failed = attribute.failed(lv, rv) if attribute.failed else F.lit(False)
    err = F.when(lv.isNotNull() & rv.isNotNull() & failed, "FailedMerge")
    if lone is None:
        err = err.when(lv.isNull() | rv.isNull(), "InsufficientData")
    else:
        err = err.when(lv.isNull() & rv.isNull(), "InsufficientData")
    value = F.when(lv.isNotNull() & rv.isNotNull(), attribute.merge(lv, rv))
    value = value.otherwise(lone) if lone is not None else value
    done = materialize(both.select("op_id", "out", "l", "r", value.alias("value"), err.alias("err")), "merged")
    good = done.where("err is null")
    cleared = good.select(F.explode(F.array("l", "r", "out")).alias("cell_id")).distinct()
    new = table.join(cleared, "cell_id", "left_anti").unionByName(good.select(F.col("out").alias("cell_id"), "value"))
    return new, done.where("err is not null").select("op_id", "err")


def split_values(attribute: Attribute, ops: DataFrame) -> tuple[DataFrame, DataFrame]:
    """ops (op_id, l, r, inp): (new table, (op_id, err))."""
    table = attribute.table
    read = ops.join(table.select(F.col("cell_id").alias("inp"), "value"), "inp", "left")
    left, right = attribute.split(F.col("value"))
    done = materialize(read.select("op_id", "l", "r", "inp", "value", left.alias("lv"), right.alias("rv")), "split")
    good = done.where("value is not null")
    cleared = good.select(F.explode(F.array("inp", "l", "r")).alias("cell_id")).distinct()
    out = good.select(F.inline(F.array(F.struct(F.col("l").alias("cell_id"), F.col("lv").alias("value")), F.struct(F.col("r").alias("cell_id"), F.col("rv").alias("value")))))
    new = table.join(cleared, "cell_id", "left_anti").unionByName(out)
    return new, done.where("value is null").select("op_id", F.lit("InsufficientData").alias("err"))


def write_values(table: DataFrame, key: str, new: DataFrame) -> DataFrame:
    """Upsert: rows of ``new`` replace those of their key."""
    return table.join(new.select(key), key, "left_anti").unionByName(new)


def remove_values(table: DataFrame, key: str, gone: DataFrame) -> DataFrame:
    return table.join(gone.select(key), key, "left_anti")


def replaced_values(table: DataFrame, key: str, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """:func:`write_values`, and for each key of ``new`` the row it had before, its other columns null if it had none."""
    return write_values(table, key, new), new.select(key).join(table, key, "left")


def taken_values(table: DataFrame, key: str, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """:func:`remove_values`, and for each key the row it had before, as :func:`replaced_values`."""
    return remove_values(table, key, gone), gone.select(key).join(table, key, "left")


def vertex_attribute(mesh: Mesh) -> Attribute:
    """Coordinates as an attribute: merged to the middle, duplicated on splits, kept alone."""
    value = F.struct(*[F.col(a) for a in mesh.axes])
    middle = lambda l, r: F.struct(*[((l[a] + r[a]) / 2).alias(a) for a in mesh.axes])  # noqa: E731, E741
    return Attribute("vertex", mesh.vertices.select(F.col("vid").alias("cell_id"), value.alias("value")), middle, merge_one=lambda v: v)


# Fixed law: the lower dimension wins; of equal dimensions equal ids keep, others fail.
def anchor_attribute(bind: str, table: DataFrame) -> Attribute:
    merge = lambda l, r: F.when(l["dim"] <= r["dim"], l).otherwise(r)  # noqa: E731, E741
    failed = lambda l, r: (l["dim"] == r["dim"]) & (l["id"] != r["id"])  # noqa: E731, E741
    return Attribute(bind, table, merge, merge_one=lambda v: v, failed=failed)


def edge_to_vertex(anchor: Column) -> Column:
    """An edge's anchor as that of a vertex: a curve, surface or body stays what it is."""
    return F.struct(anchor["dim"].alias("dim"), anchor["id"].alias("id"))


face_to_vertex = face_to_edge = edge_to_vertex


def anchor_dim(anchor: Column) -> Column:
    """0 node, 1 curve, 2 surface, 3 body."""
    return anchor["dim"]


# sews


def _type(table: DataFrame):
    return table.schema["value"].dataType


def _joined_values(moved: DataFrame, attribute: Attribute) -> DataFrame:
    """(new, value, err): values of cells that several old ones became, folded in the order of old ids, two at a time, by the attribute's laws."""
    valued = moved.join(attribute.table.withColumnRenamed("cell_id", "old"), "old", "left")
    rows = valued.groupBy("new").agg(F.array_sort(F.collect_list(F.struct("old", "value"))).alias("vs"))  # a cell's parts are bounded by its darts
    kind = _type(attribute.table)
    none = F.lit(None).cast(kind)

    def step(acc, part):
        left, right = acc["value"], part["value"]
        both, neither = left.isNotNull() & right.isNotNull(), left.isNull() & right.isNull()
        failed = F.coalesce(attribute.failed(left, right), F.lit(False)) if attribute.failed else F.lit(False)
        lone = attribute.merge_one(F.coalesce(left, right)) if attribute.merge_one else none
        nothing = attribute.merge_none() if attribute.merge_none else none
        value = F.when(both, attribute.merge(left, right)).when(neither, nothing).otherwise(lone).cast(kind)
        err = F.when(both & failed, "FailedMerge").when(neither, F.lit(None if attribute.merge_none else "InsufficientData")).when(~both, F.lit(None if attribute.merge_one else "InsufficientData"))
        return F.struct(value.alias("value"), F.coalesce(acc["err"], err).alias("err"))

    zero = F.struct(F.element_at("vs", 1)["value"].cast(kind).alias("value"), F.lit(None).cast("string").alias("err"))
    folded = F.aggregate(F.slice("vs", 2, F.size("vs")), zero, step)
    return rows.select("new", folded.alias("f")).select("new", "f.value", "f.err")


def _split_values_of(moved: DataFrame, attribute: Attribute) -> DataFrame:
    """(new, value, err) of cells that were parts of one old one: each part in order of its id splits off the left value, the last keeps what is left."""
    kind = _type(attribute.table)
    parts = moved.groupBy("old").agg(F.array_sort(F.collect_list("new")).alias("news"))
    rows = parts.join(attribute.table.withColumnRenamed("cell_id", "old"), "old", "left")
    none = F.lit(None).cast(kind)

    def halves(v):
        left, right = attribute.split(v) if attribute.split else (none, none)
        empty = attribute.split_none() if attribute.split_none else (none, none)
        return [F.when(v.isNotNull(), x).otherwise(y).cast(kind) for x, y in zip((left, right), empty, strict=True)]

    def step(acc, _):
        left, right = halves(acc["rest"])
        return F.struct(F.concat(acc["out"], F.array(left)).alias("out"), right.alias("rest"))

    zero = F.struct(F.array().cast(f"array<{kind.simpleString()}>").alias("out"), F.col("value").cast(kind).alias("rest"))
    walked = F.aggregate(F.slice("news", 2, F.size("news")), zero, step, lambda acc: F.concat(acc["out"], F.array(acc["rest"])))
    err = F.when(F.col("value").isNull(), F.lit(None if attribute.split_none else "InsufficientData")).otherwise(F.lit(None if attribute.split else "FailedSplit"))
    return rows.select(err.alias("err"), F.inline(F.arrays_zip(F.col("news").alias("new"), walked.alias("value")))).select("new", "value", "err")


def _carry(before: dict[str, DataFrame], after: dict[str, DataFrame], old: Mesh, new: Mesh, joined: bool) -> tuple[Mesh, DataFrame]:
    """Vertices and attributes of the touched kinds follow the cells of the new topology: (mesh, (kind, id, err) of cells whose law fails)."""
    names = {"vertex": "vid", "edge": "eid", "face": "fid"}
    moved = {}
    for k in before:
        pairs = before[k].select("d", F.col(names[k]).alias("old")).join(after[k].select("d", F.col(names[k]).alias("new")), "d").select("old", "new").distinct()
        moved[k] = materialize(pairs, "cells-moved")
    errors = []

    def table_of(k: str, attribute: Attribute) -> DataFrame:
        key = "new" if joined else "old"
        several = moved[k].groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(key)
        touched = materialize(moved[k].join(several, key), "cells-touched")
        found = materialize(_joined_values(touched, attribute) if joined else _split_values_of(touched, attribute), "cells-values")
        errors.append(found.where("err is not null").select(F.lit(k).alias("kind"), F.col("new").alias("id"), "err"))
        still = moved[k].join(touched.select("old").distinct(), "old", "left_anti")
        rest = attribute.table.withColumnRenamed("cell_id", "old").join(still, "old").select(F.col("new").alias("cell_id"), "value")
        return rest.unionByName(found.where("value is not null").select(F.col("new").alias("cell_id"), "value"))

    vertices = table_of("vertex", vertex_attribute(old))
    vertices = materialize(vertices.select(F.col("cell_id").alias("vid"), *[F.col("value")[a].alias(a) for a in new.axes]), "carried")
    attrs = {}
    for key, a in old.attrs.items():
        attrs[key] = Attribute(**{**a.__dict__, "table": materialize(table_of(a.bind, a), "carried")}) if a.bind in moved else a
    return new.with_(vertices=vertices, attrs=attrs), reduce(DataFrame.unionByName, errors)


_TOUCHED = {1: ["vertex"], 2: ["vertex", "edge"], 3: ["vertex", "edge", "face"]}


def _kinds(mesh: Mesh, i: int) -> list[str]:
    """Cells that can join or come apart; vertices always, other kinds if an attribute is bound to them."""
    bound = {a.bind for a in mesh.attrs.values()}
    return [k for k in _TOUCHED[i] if k == "vertex" or k in bound]


def _reached(mesh: Mesh, ops: DataFrame, i: int) -> DataFrame:
    """(op_id, d): darts whose cells an operation on l and r can change: both, their next ones, and for i = 3 those of whole faces."""
    pairs = _paired(mesh, ops)[0] if i == 3 else ops
    ends = pairs.select("op_id", F.explode(F.array("l", "r")).alias("d")).where("d <> 0")
    return ends.union(ends.join(mesh.darts.select("d", "b1"), "d").where("b1 <> 0").select("op_id", F.col("b1").alias("d"))).distinct()


def _known(mesh: Mesh, kinds: list[str]) -> Mesh:
    """The mesh with its cell ids of these kinds written, so that nothing computes them again."""
    if mesh.dim == 3 and "vertex" in kinds and not {"vertex", "corner"} <= mesh.ids.keys():
        mesh = mesh.with_(ids={**mesh.ids, "corner": mesh.ids.get("corner") or corner_parts(mesh.darts)})
    return mesh.with_(ids={**mesh.ids, **{k: materialize(cell_ids(mesh, k), "cell-ids") for k in kinds if k not in mesh.ids}})


def _applied(mesh: Mesh, ops: DataFrame, i: int, joined: bool, change) -> tuple[Mesh, DataFrame]:
    """Change the topology and carry values; operations at cells whose law fails are taken back, and the rest is done anew."""
    kinds, refused, tried = _kinds(mesh, i), None, ops
    mesh = _known(mesh, kinds)
    before = mesh.ids
    while True:
        changed, result = change(mesh, tried, i)
        # 3-links leave corners within a volume as they are.
        corner = {k: v for k, v in mesh.ids.items() if k == "corner" and i == 3}
        changed = _known(changed.with_(darts=materialize(changed.darts, "edited"), ids=corner), kinds)
        after = changed.ids
        out, errors = _carry({k: before[k] for k in kinds}, after, mesh, changed, joined)
        errors = materialize(errors, "law-errors")
        if errors.isEmpty():
            return out, result if refused is None else result.unionByName(refused, allowMissingColumns=True)
        done = materialize(result, "edit-results")
        pairs = tried.join(done.where("ok").select("op_id"), "op_id")
        if "r" not in pairs.columns:
            pairs = pairs.join(done.select("op_id", "r"), "op_id")
        reached = _reached(mesh, pairs.select("op_id", "l", "r"), i)
        hit = reduce(DataFrame.union, [reached.join(after[k], "d").select("op_id", F.lit(k).alias("kind"), F.col(after[k].columns[1]).alias("id")) for k in kinds])
        bad = hit.join(errors, ["kind", "id"]).groupBy("op_id").agg(F.min("err").alias("err"))
        bad = materialize(bad.select("op_id", F.lit(False).alias("ok"), "err"), "refused")
        if bad.isEmpty():
            raise MeshError("a law fails at a cell that no operation touches")
        refused = bad if refused is None else refused.unionByName(bad)
        tried = materialize(tried.join(bad, "op_id", "left_anti"), "edits-left")


def sew(mesh: Mesh, ops: DataFrame, i: int) -> tuple[Mesh, DataFrame]:
    """Link and merge the cells that become one: (mesh, (op_id, ok, err)).

    2- and 3-sews of edges that run the same way fail with BadGeometry.  Where an
    attribute's law fails (FailedMerge, InsufficientData), the operations at that
    cell are not done and all others are.
    """
    ops = materialize(ops.select("op_id", "l", "r"), "sews")
    result_bad = None
    if i >= 2:
        mesh = _known(mesh, _kinds(mesh, i))
        vid = mesh.ids["vertex"]
        points = mesh.vertices.select("vid", *[F.col(a).alias(f"p{a}") for a in mesh.axes])
        asked = ops.select(F.explode(F.array("l", "r")).alias("d")).distinct()
        asked = materialize(mesh.darts.select("d", "b1").join(asked, "d"), "sew-darts")
        at = asked.select(F.explode(F.array("d", "b1")).alias("d")).distinct().join(vid, "d").join(points, "vid", "left").select("d", *[f"p{a}" for a in mesh.axes])
        at = materialize(at, "sew-places")
        ends = asked.join(at, "d").join(at.select(F.col("d").alias("b1"), *[F.col(f"p{a}").alias(f"q{a}") for a in mesh.axes]), "b1", "left")
        direction = g.sub(g.vec("q", mesh.dim), g.vec("p", mesh.dim))
        ways = materialize(ends.select("d", *[v.alias(f"v{a}") for v, a in zip(direction, mesh.axes, strict=True)]), "ways")
        side = lambda k: ways.select(F.col("d").alias(k), *[F.col(f"v{a}").alias(f"{k}{a}") for a in mesh.axes])
        same = g.dot(g.vec("l", mesh.dim), g.vec("r", mesh.dim)) >= 0
        result_bad = materialize(ops.join(side("l"), "l").join(side("r"), "r").where(same).select("op_id"), "sew-bad")
        ops = materialize(ops.join(result_bad, "op_id", "left_anti"), "sews")
    out, result = _applied(mesh, ops, i, True, link)
    if result_bad is not None:
        result = result.unionByName(result_bad.select("op_id", F.lit(False).alias("ok"), F.lit("BadGeometry").alias("err")))
    return out, result


def unsew(mesh: Mesh, ops: DataFrame, i: int) -> tuple[Mesh, DataFrame]:
    """Unlink and split the values of cells that come apart: (mesh, (op_id, ok, err, r)).

    A cell of several parts is split two at a time, in the order of the parts' ids;
    a failing law (InsufficientData, FailedSplit) undoes the operations there.
    """
    return _applied(mesh, materialize(ops.select("op_id", "l"), "unsews"), i, False, unlink)


def ready(touched: DataFrame, in_order: bool = False) -> DataFrame:
    """(op_id, key) -> (op_id): operations that are the first at all their keys, by a hash or, ``in_order``, by op_id."""
    rank = F.struct("op_id") if in_order else F.struct(F.xxhash64("op_id"), F.col("op_id"))
    first = touched.groupBy("key").agg(F.min(rank).alias("first"))
    return touched.join(first, "key").groupBy("op_id").agg(F.min((F.col("first") == rank).cast("int")).alias("ok")).where("ok = 1").select("op_id")


def schedule(touched: DataFrame, max_rounds: int = 1000, in_order: bool = False) -> DataFrame:
    """(op_id, key) -> (op_id, round): in each round an operation runs if it is the first (see :func:`ready`) at all its keys."""
    left, out = materialize(touched.select("op_id", "key").distinct(), "schedule"), None
    for n in range(max_rounds):
        if left.isEmpty():
            return out if out is not None else touched.select("op_id", F.lit(0).alias("round")).limit(0)
        now = materialize(ready(left, in_order).select("op_id", F.lit(n).alias("round")), "schedule-round")
        out = now if out is None else out.unionByName(now)
        left = materialize(left.join(now, "op_id", "left_anti"), "schedule")
    raise MeshError("the batch needs too many rounds")


def union_all(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)
