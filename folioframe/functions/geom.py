"""Expressions over boxes. A box is four columns with a common prefix: x, y, w, h."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, functions as F


class Box(NamedTuple):
    x: Column
    y: Column
    w: Column
    h: Column

    @property
    def right(self) -> Column:
        return self.x + self.w

    @property
    def bottom(self) -> Column:
        return self.y + self.h

    @property
    def area(self) -> Column:
        return self.w * self.h


def box(prefix: str = "") -> Box:
    return Box(*(F.col(f"{prefix}{c}") for c in "xywh"))


def meet(a: Box, b: Box) -> Column:
    """Area of the intersection."""
    zero = F.lit(0)
    wide = F.greatest(zero, F.least(a.right, b.right) - F.greatest(a.x, b.x))
    high = F.greatest(zero, F.least(a.bottom, b.bottom) - F.greatest(a.y, b.y))
    return wide * high


def iou_plus(a: Box, b: Box) -> Column:
    """Intersection over union, the union enlarged by 1e-6."""
    return meet(a, b) / (a.area + b.area - meet(a, b) + F.lit(1e-6))


def iou(a: Box, b: Box) -> Column:
    """Intersection over union, the union at least 1e-6."""
    return meet(a, b) / F.greatest(F.lit(1e-6), (a.area + b.area - meet(a, b)).cast("double"))


def iou_pixel(a: Box, b: Box) -> Column:
    """Intersection over union, the union at least one pixel."""
    return meet(a, b) / F.greatest(F.lit(1), a.area + b.area - meet(a, b))


def overlap_smaller(a: Box, b: Box) -> Column:
    """Intersection over the smaller area, areas at least one pixel."""
    return meet(a, b) / F.least(F.greatest(F.lit(1), a.area), F.greatest(F.lit(1), b.area))


def inside(a: Box, b: Box) -> Column:
    """Share of a that lies in b."""
    return meet(a, b) / F.greatest(F.lit(1), a.area)


def center_in(a: Box, b: Box) -> Column:
    """The center of a lies in b, edges included."""
    cx, cy = a.x + a.w / 2, a.y + a.h / 2
    return cx.between(b.x, b.right) & cy.between(b.y, b.bottom)


def interval_share(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Overlap of two intervals over the shorter one, at least one unit long."""
    return F.greatest(F.lit(0), F.least(a1, b1) - F.greatest(a0, b0)) / F.greatest(F.lit(1), F.least(a1 - a0, b1 - b0))


def ramp(v: Column, low: float, high: float) -> Column:
    """0 up to low, 1 from high, linear between."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), (v - low) / (high - low)))


def color_close(a: list[Column], b: list[Column], most: int = 90) -> Column:
    return sum((F.abs(x - y) for x, y in zip(a, b, strict=True)), F.lit(0)) < most
