"""Expressions on vectors (arrays of float or double); sums are taken in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(c: Column) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(total(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def cosine(a: Column, b: Column) -> Column:
    """Null if either vector is zero."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(total(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2)))))


def scaled(a: Column, by: Column) -> Column:
    return F.transform(a, lambda x: x.cast("double") * by)


def normalized(a: Column) -> Column:
    """Of length one; a zero vector stays as it is."""
    # Vector and norm are bound by outer lambdas: else they would be computed again for each element.
    by = lambda v, n: F.transform(v, lambda x: F.when(n == 0, x.cast("double")).otherwise(x.cast("double") / n))
    of = F.transform(F.array(a), lambda v: F.get(F.transform(F.array(norm(v)), lambda n: by(v, n)), F.lit(0)))
    return F.get(of, F.lit(0))


def rounded(x: Column | str, places: int) -> Column:
    """A double rounded half up; what rounds to zero keeps its sign, as in SQL engines that round in floating point."""
    x = F.col(x) if isinstance(x, str) else x
    near = F.round(x, places)
    return F.when(near == 0, x * F.lit(0.0)).otherwise(near)


def added(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.cast("double") + y.cast("double"))


def subtracted(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))


def shifted(a: Column, difference: Column) -> Column:
    """Moved by a difference vector, then of length one."""
    return normalized(added(a, difference))


def times_matrix(a: Column, columns: list[list[float]]) -> Column:
    """Row vector times a small matrix, given by its columns, then of length one."""
    return normalized(F.array(*[dot(a, F.array(*[F.lit(float(x)) for x in c])) for c in columns]))


def padded(a: Column, size: Column) -> Column:
    return F.concat(a, F.array_repeat(F.lit(0).cast("float"), F.greatest(size - F.size(a), F.lit(0))))


def to_spherical(a: Column) -> Column:
    """Radius, then one angle for each coordinate but the last: the angle between it and what follows it, the last angle in
    (-pi, pi]."""
    n = F.size(a)
    rest = lambda i: norm(F.slice(a, i + 2, n))
    at = lambda i: F.element_at(a, i + 1).cast("double")
    angle = lambda i: F.when(i < n - 2, F.atan2(rest(i), at(i))).otherwise(F.atan2(F.element_at(a, n).cast("double"), at(i)))
    return F.when(n < 2, F.transform(a, lambda x: x.cast("double"))).otherwise(
        F.concat(F.array(norm(a)), F.transform(F.sequence(F.lit(0), n - 2), angle))
    )


def from_spherical(s: Column) -> Column:
    """The inverse of to_spherical."""
    n = F.size(s)
    r = F.element_at(s, 1)
    sines = lambda k: F.aggregate(F.slice(s, F.lit(2), k), r, lambda a, x: a * F.sin(x))
    inner = F.transform(F.sequence(F.lit(0), n - 2), lambda i: sines(i) * F.cos(F.element_at(s, i + 2)))
    return F.when(n < 2, s).otherwise(F.concat(inner, F.array(sines(n - 1))))


def added_angles(a: Column, b: Column) -> Column:
    """Radii multiplied, angles added modulo a full turn."""
    turn = F.lit(2.0) * F.pi()
    return F.zip_with(a, b, lambda x, y: F.pmod(x + y, turn))
