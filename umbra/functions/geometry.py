"""Rectangles as four double columns, in points with the y axis upwards.

Spark orders NaN above all numbers and takes NaN for equal to itself, so every predicate asks first whether the
coordinates are usable; a rectangle that isn't has no area, meets nothing and covers nothing.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 2.220446049250313e-16
#: A4 in points, the smallest and the largest extent of a page that is taken at its word.
A4 = (0.0, 0.0, 595.276, 841.89)
MIN_EXTENT, MAX_EXTENT = 1.0, 200_000.0


class Rect(NamedTuple):
    llx: Column
    lly: Column
    urx: Column
    ury: Column

    def named(self, prefix: str = "") -> list[Column]:
        return [c.alias(f"{prefix}{name}") for name, c in zip(self._fields, self, strict=True)]


def rect(prefix: str = "") -> Rect:
    """The rectangle in the columns ``<prefix>llx`` and so on."""
    return Rect(*(F.col(f"{prefix}{x}") for x in Rect._fields))


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))


def from_corners(x0: Column, y0: Column, x1: Column, y1: Column) -> Rect:
    """The rectangle between two corners; an unusable coordinate stays one."""
    low = lambda a, b: F.when(F.isnan(a) | F.isnan(b), F.lit(float("nan"))).otherwise(F.least(a, b))
    return Rect(low(x0, x1), low(y0, y1), F.greatest(x0, x1), F.greatest(y0, y1))


def width(r: Rect) -> Column:
    return r.urx - r.llx


def height(r: Rect) -> Column:
    return r.ury - r.lly


def usable(r: Rect) -> Column:
    return finite(r.llx) & finite(r.lly) & finite(r.urx) & finite(r.ury)


def empty(r: Rect) -> Column:
    return ~usable(r) | (width(r) <= 0) | (height(r) <= 0)


def center(r: Rect) -> tuple[Column, Column]:
    return (r.llx + r.urx) / 2, (r.lly + r.ury) / 2


def _ignoring_nan(pick, a: Column, b: Column) -> Column:
    return F.when(F.isnan(a), b).when(F.isnan(b), a).otherwise(pick(a, b))


def union(a: Rect, b: Rect) -> Rect:
    """The hull of both; an unusable operand is passed over."""
    return Rect(
        _ignoring_nan(F.least, a.llx, b.llx), _ignoring_nan(F.least, a.lly, b.lly), _ignoring_nan(F.greatest, a.urx, b.urx), _ignoring_nan(F.greatest, a.ury, b.ury)
    )


def expanded(r: Rect, pad: Column | float) -> Rect:
    return Rect(r.llx - pad, r.lly - pad, r.urx + pad, r.ury + pad)


def contains(r: Rect, x: Column, y: Column) -> Column:
    """Whether a point lies inside or on the edge."""
    return usable(r) & finite(x) & finite(y) & (x >= r.llx) & (x <= r.urx) & (y >= r.lly) & (y <= r.ury)


def intersects(a: Rect, b: Rect) -> Column:
    """Whether the insides meet; touching is not enough."""
    return usable(a) & usable(b) & (a.llx < b.urx) & (b.llx < a.urx) & (a.lly < b.ury) & (b.lly < a.ury)


def touches(a: Rect, b: Rect) -> Column:
    """Whether insides or edges meet."""
    return usable(a) & usable(b) & (a.llx <= b.urx) & (b.llx <= a.urx) & (a.lly <= b.ury) & (b.lly <= a.ury)


def area(r: Rect) -> Column:
    return F.when(usable(r), F.greatest(width(r), F.lit(0.0)) * F.greatest(height(r), F.lit(0.0))).otherwise(0.0)


def intersection_area(a: Rect, b: Rect) -> Column:
    w = F.greatest(F.least(a.urx, b.urx) - F.greatest(a.llx, b.llx), F.lit(0.0))
    h = F.greatest(F.least(a.ury, b.ury) - F.greatest(a.lly, b.lly), F.lit(0.0))
    return F.when(usable(a) & usable(b), w * h).otherwise(0.0)


def covered_fraction(a: Rect, b: Rect) -> Column:
    """The part of ``a`` that ``b`` covers. Of a rectangle without area, whether its centre is covered."""
    whole = area(a)
    part = F.try_divide(intersection_area(a, b), whole)
    point = F.when(contains(b, *center(a)), 1.0).otherwise(0.0)
    return F.when(whole <= EPSILON, point).otherwise(F.when(finite(part), part).otherwise(0.0))


def covered_at_least(a: Rect, b: Rect, share: float) -> Column:
    """Whether ``b`` covers this part of ``a``, for rectangles that are known to be usable: short enough to be compiled in a join."""
    whole = F.greatest(width(a), F.lit(0.0)) * F.greatest(height(a), F.lit(0.0))
    w = F.least(a.urx, b.urx) - F.greatest(a.llx, b.llx)
    h = F.least(a.ury, b.ury) - F.greatest(a.lly, b.lly)
    x, y = center(a)
    part = w * h / whole
    inside = (w > 0) & (h > 0) & (part >= share) & (part < 2.0)  # products too large for a double cover nothing
    return F.when(whole <= EPSILON, (x >= b.llx) & (x <= b.urx) & (y >= b.lly) & (y <= b.ury)).otherwise(inside)


def sane_box(r: Rect) -> tuple[Rect, Column]:
    """(a page box, whether A4 had to take its place): an extent must be finite and between the two bounds."""
    good = usable(r) & width(r).between(MIN_EXTENT, MAX_EXTENT) & height(r).between(MIN_EXTENT, MAX_EXTENT)
    return Rect(*(F.when(good, c).otherwise(F.lit(d)) for c, d in zip(r, A4, strict=True))), ~good


def beside(r: Rect, sheet: Rect) -> Column:
    """Whether no part of positive area lies on the sheet."""
    return ~((F.least(r.urx, sheet.urx) > F.greatest(r.llx, sheet.llx)) & (F.least(r.ury, sheet.ury) > F.greatest(r.lly, sheet.lly)))


def clamped(r: Rect, sheet: Rect) -> Rect:
    """``r`` with every corner moved onto the sheet."""
    on = lambda v, low, high: F.greatest(low, F.least(v, high))
    return Rect(on(r.llx, sheet.llx, sheet.urx), on(r.lly, sheet.lly, sheet.ury), on(r.urx, sheet.llx, sheet.urx), on(r.ury, sheet.lly, sheet.ury))


def matrix_multiply(m: list[Column], n: list[Column]) -> list[Column]:
    """The affine map that applies ``m`` = (a, b, c, d, e, f) first and then ``n``."""
    a, b, c, d, e, f = m
    p, q, r, s, t, u = n
    return [a * p + b * r, a * q + b * s, c * p + d * r, c * q + d * s, e * p + f * r + t, e * q + f * s + u]


def matrix_apply(m: list[Column], x: Column, y: Column) -> tuple[Column, Column]:
    a, b, c, d, e, f = m
    return a * x + c * y + e, b * x + d * y + f


def matrix_invert(m: list[Column]) -> list[Column]:
    """The inverse map; null where there is none."""
    a, b, c, d, e, f = m
    det = a * d - b * c
    over = F.when(finite(det) & (det != 0), 1 / det)
    return [d * over, -b * over, -c * over, a * over, (c * f - d * e) * over, (b * e - a * f) * over]


def direction_bucket(dx: Column, dy: Column) -> Column:
    """The writing direction in whole degrees from 0 to 359."""
    return F.pmod(F.round(F.degrees(F.atan2(dy, dx))), F.lit(360)).cast("int")


def rotation(rotate: Column) -> Column:
    """A page's turn: modulo 360, and 0 unless a multiple of 90."""
    turned = F.pmod(rotate, F.lit(360))
    return F.when(turned % 90 == 0, turned).otherwise(0)


def quad_covers(xs: list[Column], ys: list[Column], r: Rect) -> Column:
    """Whether a convex quadrilateral (corners in order) holds all of a rectangle: every corner on one side of every edge."""
    corners = [(r.llx, r.lly), (r.urx, r.lly), (r.urx, r.ury), (r.llx, r.ury)]
    sides = []
    for k in range(4):
        x0, y0, x1, y1 = xs[k], ys[k], xs[(k + 1) % 4], ys[(k + 1) % 4]
        sides += [(x1 - x0) * (y - y0) - (y1 - y0) * (x - x0) for x, y in corners]
    left = right = F.lit(True)
    for side in sides:
        left, right = left & (side >= 0), right & (side <= 0)
    return usable(r) & (left | right)
