"""Axis-aligned boxes, as columns x, y, width, height."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Box(NamedTuple):
    x: Column
    y: Column
    width: Column
    height: Column


def area(b: Box) -> Column:
    return F.greatest(b.width, F.lit(0.0)) * F.greatest(b.height, F.lit(0.0))


def overlap(a: Box, b: Box) -> Column:
    w = F.least(a.x + a.width, b.x + b.width) - F.greatest(a.x, b.x)
    h = F.least(a.y + a.height, b.y + b.height) - F.greatest(a.y, b.y)
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))


def contains(outer: Box, inner: Box, slack: float = 8) -> Column:
    return (inner.x >= outer.x - slack) & (inner.y >= outer.y - slack) & (inner.x + inner.width <= outer.x + outer.width + slack) & (inner.y + inner.height <= outer.y + outer.height + slack)


def touches(a: Box, b: Box) -> Column:
    """Closed intervals meet in both directions."""
    return (a.x <= b.x + b.width) & (b.x <= a.x + a.width) & (a.y <= b.y + b.height) & (b.y <= a.y + a.height)


def union(a: Box, b: Box) -> Box:
    x, y = F.least(a.x, b.x), F.least(a.y, b.y)
    return Box(x, y, F.greatest(a.x + a.width, b.x + b.width) - x, F.greatest(a.y + a.height, b.y + b.height) - y)
