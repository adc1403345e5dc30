"""Column-level building blocks: they compose into whole-stage code."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(c: Column) -> Column:
    """Rounds halves towards positive infinity."""
    return F.floor(c + 0.5)


def clamp(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def cell(c: Column, size: float, origin: float = 0.0) -> Column:
    return F.floor((c - F.lit(origin)) / F.lit(size)).cast("long")


def polygon_contains(x: Column, y: Column, ring: list[tuple[float, float]]) -> Column:
    """Even-odd rule over a literal ring; fewer than three corners contain nothing."""
    if len(ring) < 3:
        return F.lit(False)
    crossings = F.lit(0)
    for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1], strict=True):
        spans = (F.lit(ay) > y) != (F.lit(by) > y)
        at = F.lit(bx - ax) * (y - F.lit(ay)) / F.lit((by - ay) or 1e-18) + F.lit(ax)
        crossings = crossings + (spans & (x < at)).cast("int")
    return crossings % 2 == 1


def ring_area(ring: list[tuple[float, float]]) -> float:
    return abs(sum(ax * by - bx * ay for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1], strict=True))) / 2 if len(ring) > 2 else 0.0


def bearing(dx: Column, dy: Column) -> Column:
    """Degrees clockwise from north; null where there is no direction."""
    return F.when((dx != 0) | (dy != 0), F.pmod(F.degrees(F.atan2(dx, dy)) + 360.0, F.lit(360.0)))


def angle_difference(a: Column, b: Column) -> Column:
    """Signed difference in degrees, in (-180, 180]."""
    d = F.pmod(a - b, F.lit(360.0))
    return F.when(d > 180.0, d - 360.0).otherwise(d)


def octant(x: Column, y: Column, z: Column, low: tuple[float, float, float], span: float, depth: int) -> Column:
    """Octree key: a digit for each level, x bit | y bit << 1 | z bit << 2."""
    top = (1 << depth) - 1
    at = [F.least(F.greatest(F.floor((c - F.lit(o)) / F.lit(span) * F.lit(float(1 << depth))), F.lit(0)), F.lit(top)).cast("int") for c, o in zip((x, y, z), low, strict=True)]
    digits = []
    for level in range(depth - 1, -1, -1):
        bits = [F.shiftright(a, level).bitwiseAND(F.lit(1)) for a in at]
        digits.append((bits[0] + bits[1] * 2 + bits[2] * 4).cast("string"))
    return F.concat(*digits) if digits else F.lit("")


def shade(slope: Column, aspect: Column, azimuth: float = 315.0, altitude: float = 45.0) -> Column:
    """Lambert shade 0 to 255; slope in radians, aspect in radians counter-clockwise from east."""
    zenith, az = math.radians(90 - altitude), math.radians((360.0 - azimuth + 90.0) % 360.0)
    light = F.lit(math.cos(zenith)) * F.cos(slope) + F.lit(math.sin(zenith)) * F.sin(slope) * F.cos(F.lit(az) - aspect)
    return clamp(half_up(light * 255.0).cast("double"), 0.0, 255.0)


def stationing(c: Column) -> Column:
    """k+mmm.mm"""
    whole = F.floor(c / 1000.0)
    return F.format_string("%d+%06.2f", whole.cast("long"), c - whole * 1000.0)


def wilson(k: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """Score interval of a share."""
    p, z2 = k / n, z * z
    mid, half = (p + z2 / (2 * n)) / (1 + z2 / n), z * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n)) / (1 + z2 / n)
    return F.when(n > 0, F.greatest(mid - half, F.lit(0.0))), F.when(n > 0, F.least(mid + half, F.lit(1.0)))
