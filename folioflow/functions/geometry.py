"""Rectangles as four columns, x0, y0, x1 and y1, with y growing downwards."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SIDES = ("x0", "y0", "x1", "y1")
Box = tuple[Column, Column, Column, Column]


def box(prefix: str = "") -> Box:
    return tuple(F.col(prefix + side) for side in SIDES)


def width(b: Box) -> Column:
    return b[2] - b[0]


def height(b: Box) -> Column:
    return b[3] - b[1]


def area(b: Box) -> Column:
    return F.greatest(width(b), F.lit(0.0)) * F.greatest(height(b), F.lit(0.0))


def shared(a: Box, b: Box) -> Column:
    """The area that two rectangles have in common."""
    return area((F.greatest(a[0], b[0]), F.greatest(a[1], b[1]), F.least(a[2], b[2]), F.least(a[3], b[3])))


def within(inner: Box, outer: Box, share: float = 0.6) -> Column:
    """Whether so much of the inner rectangle lies in the outer one; empty rectangles lie in none."""
    return (area(inner) > 0) & (shared(inner, outer) >= share * area(inner))


def holds(b: Box, x: Column, y: Column) -> Column:
    return x.between(b[0], b[2]) & y.between(b[1], b[3])


def boxes_as(prefix: str, extra: tuple[str, ...] = ()) -> list[Column]:
    """The sides, and other columns, under names with a prefix: for joins of two tables of rectangles."""
    return [F.col(c).alias(prefix + c) for c in (*SIDES, *extra)]
