"""On-screen approximations of print colours as column expressions."""

from itertools import product

from pyspark.sql import Column
from pyspark.sql import functions as F

from quoin.functions.numbers import clamp01, half_up, plain

# sRGB of the full process inks and their overprints (cyan, magenta, yellow
# on or off), and of black ink.
CORNERS = {
    (0, 0, 0): (255, 255, 255),
    (1, 0, 0): (0, 174, 239),
    (0, 1, 0): (236, 0, 140),
    (0, 0, 1): (255, 242, 0),
    (1, 1, 0): (46, 49, 146),
    (1, 0, 1): (0, 166, 81),
    (0, 1, 1): (237, 28, 36),
    (1, 1, 1): (58, 53, 54),
}
BLACK = 35


def cmyk_to_rgb(c: Column, m: Column, y: Column, k: Column) -> list[Column]:
    """Red, green, blue (0 to 255) of inks from 0 to 1: trilinear between the corners, darkened by black."""
    c, m, y, k = map(clamp01, (c, m, y, k))
    shade = 1 - k * (1 - BLACK / 255)
    out = []
    for channel in range(3):
        total = None
        for on in product((0, 1), repeat=3):
            part = F.lit(float(CORNERS[on][channel]))
            for ink, present in zip((c, m, y), on):
                part = part * (ink if present else 1 - ink)
            total = part if total is None else total + part
        out.append(half_up(total * shade).cast("int"))
    return out


def lab_to_rgb(lightness: Column, a: Column, b: Column) -> list[Column]:
    """Red, green, blue of a CIE Lab colour under D50."""
    fy = (lightness + 16) / 116
    knee = 6 / 29

    def back(t: Column) -> Column:
        return F.when(t > knee, t * t * t).otherwise((t - 4 / 29) * (3 * knee * knee))

    x, y, z = back(fy + a / 500) * 0.9642, back(fy), back(fy - b / 200) * 0.8249
    # XYZ (D50) to linear sRGB.
    rows = ((3.1338561, -1.6168667, -0.4906146), (-0.9787684, 1.9161415, 0.0334540), (0.0719453, -0.2289914, 1.4052427))
    out = []
    for p, q, r in rows:
        u = x * p + y * q + z * r
        lit = F.when(u <= 0.0031308, u * 12.92).otherwise(F.pow(F.greatest(u, F.lit(0.0)), F.lit(1 / 2.4)) * 1.055 - 0.055)
        out.append(half_up(clamp01(lit) * 255).cast("int"))
    return out


def hex_of(rgb: list[Column]) -> Column:
    return F.concat(F.lit("#"), *[F.lower(F.lpad(F.hex(F.greatest(F.lit(0), F.least(F.lit(255), v)).cast("long")), 2, "0")) for v in rgb])


def percent(x: Column) -> Column:
    """A share from 0 to 1 as percent in tenths."""
    return half_up(x * 1000) / 10.0


def total_ink(inks: list[Column]) -> Column:
    """Sum of inks given in percent, in tenths."""
    return half_up(sum(inks[1:], inks[0]) * 10) / 10.0


def cmyk_key(inks: list[Column]) -> Column:
    return F.concat(F.lit("cmyk:"), F.concat_ws(",", *map(plain, inks)))


def cmyk_label(inks: list[Column]) -> Column:
    return F.concat_ws(" ", *[F.concat(F.lit(n), plain(v)) for n, v in zip("CMYK", inks)])
