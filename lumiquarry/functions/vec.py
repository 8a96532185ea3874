"""Vectors and boxes as array columns. Components are summed in double precision."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Sum of products; null if either is null. Vectors of different lengths give null."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column, *, add: float = 0.0, floor: float = 0.0) -> Column:
    """``a`` by its length: ``add`` is added to the length, or the length is ``floor`` at least; without either a zero vector stays."""
    if add or floor:
        size = F.greatest(norm(a) + F.lit(add), F.lit(floor))
    else:
        size = F.when(norm(a) > 0, norm(a)).otherwise(1.0)
    return once(size, lambda s: F.transform(a, lambda x: x.cast("double") / s))


def once(value: Column, of: Callable[[Column], Column]) -> Column:
    """``of(value)``, with ``value`` worked once a row: inside the function of an array it would be worked for each element."""
    return F.transform(F.array(value), of)[0]


def cosine(a: Column, b: Column, *, add: float = 1e-9) -> Column:
    return dot(a, b) / ((norm(a) + F.lit(add)) * (norm(b) + F.lit(add)))


def iou(ax: Column, ay: Column, aw: Column, ah: Column, bx: Column, by: Column, bw: Column, bh: Column) -> Column:
    """Intersection over union of two boxes given by corner and size; 0 where they do not meet."""
    w = F.greatest(F.lit(0.0), F.least(ax + aw, bx + bw) - F.greatest(ax, bx))
    h = F.greatest(F.lit(0.0), F.least(ay + ah, by + bh) - F.greatest(ay, by))
    both = w * h
    either = aw * ah + bw * bh - both
    return F.when(either > 0, both / either).otherwise(0.0)


def argmax(items: Column, key) -> Column:
    """The first item of an array with the greatest ``key``."""
    keys = F.transform(items, key)
    return F.try_element_at(items, F.array_position(keys, F.array_max(keys)).cast("int"))
