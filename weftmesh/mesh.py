"""The mesh as relations.

``darts``     d, b0, b1, b2[, b3], unused   (0 is the null image, no row 0)
``vertices``  vid, x, y[, z]                (vid: least dart of the vertex orbit)
``attrs``     name -> Attribute with a table (cell_id, value)
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .plans.storage import materialize


class MeshError(ValueError):
    """A batch or a parameter that the mesh can't take."""


@dataclass(frozen=True)
class Attribute:
    """A value table by cell, with its merge and split laws as column expressions.

    ``bind`` is vertex, edge, face, volume or custom.  ``merge(l, r)`` joins two
    values, ``split(v)`` gives (left, right), ``merge_one(v)`` keeps or drops a lone
    value, ``merge_none()`` and ``split_none()`` give values where there was none; a
    law that is None is an error for the operation (InsufficientData; FailedSplit
    where there is a value to split).  ``failed(l, r)`` marks merges that must fail.
    """

    bind: str
    table: DataFrame
    merge: Callable[[Column, Column], Column]
    split: Callable[[Column], tuple[Column, Column]] | None = lambda v: (v, v)
    merge_one: Callable[[Column], Column] | None = None
    failed: Callable[[Column, Column], Column] | None = None
    merge_none: Callable[[], Column] | None = None
    split_none: Callable[[], tuple[Column, Column]] | None = None


@dataclass(frozen=True)
class Mesh:
    dim: int
    darts: DataFrame
    vertices: DataFrame
    attrs: dict[str, Attribute] = field(default_factory=dict)
    #: Written cell ids by kind, and "corner" (parts of vertices), that are known of these darts.
    ids: dict[str, DataFrame] = field(default_factory=dict, compare=False, repr=False)

    @property
    def spark(self) -> SparkSession:
        return self.darts.sparkSession

    @property
    def images(self) -> list[str]:
        return [f"b{i}" for i in range(self.dim + 1)]

    @property
    def axes(self) -> list[str]:
        return ["x", "y", "z"][: self.dim]

    def with_(self, **changes) -> Mesh:
        if "darts" in changes:
            changes = {"ids": {}, **changes}
        return replace(self, **changes)

    def written(self, name: str = "mesh") -> Mesh:
        """The same mesh with its tables written once."""
        return replace(self, darts=materialize(self.darts, f"{name}-darts"), vertices=materialize(self.vertices, f"{name}-vertices"))

    # attribute registry

    def add_attribute(self, name: str, attribute: Attribute) -> Mesh:
        return replace(self, attrs={**self.attrs, name: attribute})

    def remove_attribute(self, name: str) -> Mesh:
        return replace(self, attrs={k: v for k, v in self.attrs.items() if k != name})

    def contains_attribute(self, name: str) -> bool:
        return name in self.attrs

    def n_attributes(self, name: str) -> int:
        """Cells that have a value of an attribute."""
        return self.attrs[name].table.where("value is not null").count()

    # counts

    def n_darts(self) -> int:
        """Slots, the null dart included."""
        return (self.darts.agg(F.max("d")).head()[0] or 0) + 1

    def n_unused_darts(self) -> int:
        return self.darts.where("unused").count()

    def n_vertices(self) -> int:
        return self.vertices.count()


def beta(i: int) -> Column:
    """The image under the i-th function, for a row of darts."""
    return F.col(f"b{i}")


def is_i_free(i: int) -> Column:
    return beta(i) == 0


def is_free(dim: int) -> Column:
    free = is_i_free(0)
    for i in range(1, dim + 1):
        free = free & is_i_free(i)
    return free


def from_n_darts(spark: SparkSession, n: int, dim: int = 2, attrs: dict[str, Attribute] | None = None, unused: bool = False) -> Mesh:
    """n free darts without coordinates."""
    if n < 0 or dim not in (2, 3):
        raise MeshError("n must not be negative and dim must be 2 or 3")
    zero = F.lit(0).cast("bigint")
    darts = spark.range(1, n + 1).select(F.col("id").alias("d"), *[zero.alias(f"b{i}") for i in range(dim + 1)], F.lit(unused).alias("unused"))
    vertices = spark.createDataFrame([], "vid bigint, " + ", ".join(f"{a} double" for a in "xyz"[:dim]))
    return Mesh(dim, darts, vertices, attrs or {})


def validate(mesh: Mesh) -> DataFrame:
    """(rule, violations): images must be inverse to each other, without fixed points; unused darts must be free."""
    darts, checks = mesh.darts, []
    for i, back in [(0, 1), (1, 0), *[(k, k) for k in range(2, mesh.dim + 1)]]:
        image = darts.select(F.col("d").alias(f"b{i}"), F.col(f"b{back}").alias("again"))
        bad = darts.where(f"b{i} <> 0").join(image, f"b{i}", "left").where("again is null or again <> d")
        checks.append(bad.agg(F.count("*").alias("violations")).select(F.lit(f"b{back}(b{i}(d)) = d").alias("rule"), "violations"))
        if i >= 2:
            checks.append(darts.where(f"b{i} = d").agg(F.count("*").alias("violations")).select(F.lit(f"b{i}(d) <> d").alias("rule"), "violations"))
    checks.append(darts.where(F.col("unused") & ~is_free(mesh.dim)).agg(F.count("*").alias("violations")).select(F.lit("unused darts are free").alias("rule"), "violations"))
    out = checks[0]
    for c in checks[1:]:
        out = out.unionByName(c)
    return out
