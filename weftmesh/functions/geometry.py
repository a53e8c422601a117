"""Vectors, vertices and predicates as column expressions.

A vector is a tuple of columns, so everything stays inside generated code.
"""

from __future__ import annotations

from functools import reduce
from operator import add as _plus

from pyspark.sql import Column
from pyspark.sql import functions as F

Vec = tuple[Column, ...]


def vec(prefix: str, dim: int = 2) -> Vec:
    """Columns ``{prefix}x, {prefix}y[, {prefix}z]``."""
    return tuple(F.col(f"{prefix}{a}") for a in "xyz"[:dim])


def unit(axis: int, dim: int = 2) -> Vec:
    return tuple(F.lit(1.0 if k == axis else 0.0) for k in range(dim))


def add(a: Vec, b: Vec) -> Vec:
    return tuple(x + y for x, y in zip(a, b, strict=True))


def sub(a: Vec, b: Vec) -> Vec:
    return tuple(x - y for x, y in zip(a, b, strict=True))


def mul(a: Vec, s: Column | float) -> Vec:
    return tuple(x * s for x in a)


def div(a: Vec, s: Column | float) -> Vec:
    """Null where the divisor is 0."""
    s = s if isinstance(s, Column) else F.lit(float(s))
    return tuple(F.when(s != 0, x / s) for x in a)


def neg(a: Vec) -> Vec:
    return tuple(-x for x in a)


def average(a: Vec, b: Vec) -> Vec:
    return tuple((x + y) / 2 for x, y in zip(a, b, strict=True))


def dot(a: Vec, b: Vec) -> Column:
    return reduce(_plus, [x * y for x, y in zip(a, b, strict=True)])


def norm(a: Vec) -> Column:
    return F.hypot(*a) if len(a) == 2 else F.sqrt(dot(a, a))


def unit_dir(a: Vec) -> Vec:
    """Null for a null vector."""
    return div(a, norm(a))


def normal_dir(a: Vec) -> Vec:
    """The unit vector a quarter turn to the left; null for a null vector."""
    return unit_dir((-a[1], a[0]))


def cross(a: Vec, b: Vec) -> Vec:
    return (a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])


def turn(a: Vec, b: Vec, c: Vec) -> Column:
    """Positive if the way from a over b to c turns left."""
    return (b[0] - a[0]) * (c[1] - b[1]) - (b[1] - a[1]) * (c[0] - b[0])


def cast(a: Vec, kind: str) -> Vec:
    return tuple(x.cast(kind) for x in a)


def determinant(rows: list[Vec]) -> Column:
    """By expansion along the first row."""
    if len(rows) == 1:
        return rows[0][0]
    total = None
    for k, value in enumerate(rows[0]):
        minor = determinant([tuple(v for j, v in enumerate(r) if j != k) for r in rows[1:]])
        term = value * minor if k % 2 == 0 else -(value * minor)
        total = term if total is None else total + term
    return total


def tet_orientation(a: Vec, b: Vec, c: Vec, p: Vec) -> Column:
    return determinant([sub(a, p), sub(b, p), sub(c, p)])


def in_circle(a: Vec, b: Vec, c: Vec, p: Vec) -> Column:
    """Positive if p lies inside the circle through a, b, c (counter-clockwise)."""
    rows = [(*sub(v, p), dot(sub(v, p), sub(v, p))) for v in (a, b, c)]
    return determinant(rows)


def in_sphere(a: Vec, b: Vec, c: Vec, d: Vec, p: Vec) -> Column:
    """The 4 x 4 determinant of (v - p, |v - p| squared)."""
    return determinant([(*sub(v, p), dot(sub(v, p), sub(v, p))) for v in (a, b, c, d)])


def quadrant(p: Vec, middle: Vec) -> Column:
    """0 bottom left, 1 bottom right, 2 top right, 3 top left; the middle lines belong to the upper right."""
    right, top = p[0] >= middle[0], p[1] >= middle[1]
    return F.when(right & top, 2).when(top, 3).when(right, 1).otherwise(0)


def angle(u: Vec, v: Vec) -> Column:
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(u, v) / (norm(u) * norm(v)))))


def length_error(a: Vec, b: Vec, target: float) -> Column:
    """Relative difference of an edge's length to a target."""
    return (norm(sub(b, a)) - target) / target


def rounded(x: Column, digits: int) -> Column:
    """Half away from zero of the scaled double; F.round takes the half of its shortest decimal, which differs at ties."""
    scaled = F.abs(x) * 10.0**digits
    whole = F.floor(scaled)
    return F.signum(x) * (whole + (scaled - whole >= 0.5).cast("int")) / 10.0**digits
