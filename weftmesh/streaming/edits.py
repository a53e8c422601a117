"""A stream of links applied to a stored mesh, one batch of operations at a time."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..mesh import Attribute, Mesh
from ..operators.edits import link, ready, unlink
from ..plans.storage import materialize
from ..sources.files import read_mesh, write_mesh

OPS = "op_id bigint, kind string, dim int, l bigint, r bigint"


def read_ops(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of operations as a stream."""
    return spark.readStream.schema(OPS).json(path)


def _touched(mesh: Mesh, ops: DataFrame) -> DataFrame:
    """(op_id, key): an operation's darts, for an unlink also the dart that is linked now."""
    own = ops.select("op_id", F.explode(F.array("l", "r")).alias("key")).where("key is not null")
    images = mesh.darts.select(F.col("d").alias("l"), F.array(*mesh.images).alias("images"))
    linked = ops.where("kind = 'unlink'").join(images, "l").select("op_id", F.get("images", F.col("dim")).alias("key")).where("key <> 0")
    return own.union(linked).distinct()


class MeshStream:
    """The mesh after each batch is ``{base}/{version}``; results go to ``{base}/results``.

    Operations that touch one dart are done in the order of op_id, others
    together.  A batch that is replayed after a failure starts from the version
    before it and writes the same version again, so applying it twice changes
    nothing.  ``attrs`` names the mesh's attributes with their laws; their tables
    go on from version to version.
    """

    def __init__(self, spark: SparkSession, base: str, attrs: dict[str, Attribute] | None = None):
        self.spark, self.base, self.attrs = spark, base, attrs

    def apply(self, batch: DataFrame, batch_id: int) -> None:
        mesh = read_mesh(self.spark, f"{self.base}/{batch_id}", self.attrs)
        left, results = materialize(batch, "ops"), []
        while not left.isEmpty():
            now = materialize(left.join(ready(_touched(mesh, left), in_order=True), "op_id"), "ops-now")
            bare = left.where("l is null and r is null")  # operations without darts fail by themselves
            for kind, dim in sorted({(r.kind, r.dim) for r in now.select("kind", "dim").distinct().collect()}):
                own = now.where((now.kind == kind) & (now.dim == dim))
                mesh, done = link(mesh, own, dim) if kind == "link" else unlink(mesh, own, dim)
                mesh = mesh.with_(darts=materialize(mesh.darts, "stream"))
                results.append(done.select("op_id", "ok", "err"))
            results.append(bare.select("op_id", F.lit(False).alias("ok"), F.lit("UnknownDart").alias("err")))
            left = materialize(left.join(now.select("op_id"), "op_id", "left_anti").where("l is not null or r is not null"), "ops")
        write_mesh(mesh, f"{self.base}/{batch_id + 1}", overwrite=True)
        if results:
            reduce(DataFrame.unionByName, results).write.mode("overwrite").parquet(f"{self.base}/results/{batch_id}")

    def start(self, ops: DataFrame, checkpoint: str):
        return ops.writeStream.foreachBatch(self.apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
