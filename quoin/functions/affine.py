"""Affine maps as arrays [a, b, c, d, e, f]: x' = a x + c y + e, y' = b x + d y + f."""

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from quoin.functions.numbers import places

# What counts as skewed or scaled, and as a right angle (degrees).
SKEW, RIGHT = 1e-3, 0.5


def compose(outer: Column, inner: Column) -> Column:
    """The map that applies inner, then outer. In the row-vector notation of page
    descriptions this is inner x outer."""
    p, q = (lambda k: outer[k]), (lambda k: inner[k])
    linear = [p(r) * q(2 * c) + p(2 + r) * q(2 * c + 1) for c in (0, 1) for r in (0, 1)]
    return F.array(*linear, *[p(r) * q(4) + p(2 + r) * q(5) + p(4 + r) for r in (0, 1)])


def apply(m: Column, x: Column, y: Column) -> list[Column]:
    return [m[0] * x + m[2] * y + m[4], m[1] * x + m[3] * y + m[5]]


def box_of(xs: list[Column], ys: list[Column]) -> Column:
    """The bounding box struct(x, y, w, h) of some points."""
    left, low = F.least(*xs), F.least(*ys)
    return F.struct(left.alias("x"), low.alias("y"), (F.greatest(*xs) - left).alias("w"), (F.greatest(*ys) - low).alias("h"))


def placed_box(m: Column) -> Column:
    """[x0, y0, x1, y1] of the unit square under m, in tenths of a point."""
    corners = [apply(m, F.lit(float(u)), F.lit(float(v))) for u in (0, 1) for v in (0, 1)]
    xs, ys = [c[0] for c in corners], [c[1] for c in corners]
    return F.array(*[places(f(*v)) for f, v in ((F.least, xs), (F.least, ys), (F.greatest, xs), (F.greatest, ys))])


def sides(m: Column) -> list[Column]:
    """Width and height of the unit square under m."""
    return [F.hypot(m[0], m[1]), F.hypot(m[2], m[3])]


def ppi(pixels: Column, points: Column) -> Column:
    """Effective resolution; null where nothing is drawn."""
    return F.when(points > 0, pixels / (points / 72))


def angle(m: Column) -> Column:
    return places(F.atan2(m[1], m[0]) * (180 / math.pi))


def flipped(m: Column) -> Column:
    return m[0] * m[3] - m[1] * m[2] < 0


def skewed(m: Column) -> Column:
    a, b = sides(m)
    return F.abs((m[0] * m[2] + m[1] * m[3]) / F.when(a * b == 0, F.lit(1.0)).otherwise(a * b)) > SKEW


def scaled(m: Column) -> Column:
    a, b = sides(m)
    return (F.abs(a - 1) > SKEW) | (F.abs(b - 1) > SKEW)


def rotation_bucket(degrees: Column) -> Column:
    """The right angle within half a degree, as text; -180 counts as 180."""
    out = F.lit("other")
    for t in (-180, -90, 180, 90, 0):
        out = F.when(F.abs(degrees - t) < RIGHT, F.lit("180" if t == -180 else str(t))).otherwise(out)
    return out
