"""Geometry of single vertices, boxes and rings, formats and names, as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .exprs import clamp, half_up

Vec = tuple[Column, Column, Column]


def _sub(a: Vec, b: Vec) -> Vec:
    return tuple(x - y for x, y in zip(a, b, strict=True))


def _dot(a: Vec, b: Vec) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def _length(a: Vec) -> Column:
    return F.sqrt(_dot(a, a))


def angle(a: Vec, at: Vec, c: Vec) -> Column:
    """Degrees between the directions from `at` to a and to c; 0 where one of them has no length."""
    p, q = _sub(a, at), _sub(c, at)
    size = _length(p) * _length(q)
    return F.when(size > 0, F.degrees(F.acos(clamp(_dot(p, q) / size, -1.0, 1.0)))).otherwise(0.0)


def slope(a: Vec, b: Vec) -> dict[str, Column]:
    """rise, run, grade in per cent (infinite without a run) and degrees from a to b, up being z."""
    d = _sub(b, a)
    rise, run = d[2], F.sqrt(d[0] * d[0] + d[1] * d[1])
    steep = F.when(rise > 0, float("inf")).when(rise < 0, float("-inf")).otherwise(0.0)
    return {"rise": rise, "run": run, "grade": F.when(run > 0, rise / run * 100).otherwise(steep), "degrees": F.degrees(F.atan2(rise, run))}


def profile(a: Vec, b: Vec) -> dict[str, Column]:
    """Length in space, horizontal length, drop and grade between two points."""
    s = slope(a, b)
    return {"length": _length(_sub(b, a)), "horizontal": s["run"], "drop": -s["rise"], "grade": s["grade"]}


def box(a: Vec, b: Vec) -> dict[str, Column]:
    """Ordered bounds of two corners, and their width, depth, height and volume."""
    low, high = ([f(x, y) for x, y in zip(a, b, strict=True)] for f in (F.least, F.greatest))
    out = {f"{n}_{c}": v for n, vs in (("min", low), ("max", high)) for c, v in zip("xyz", vs, strict=True)}
    w, d, h = (y - x for x, y in zip(low, high, strict=True))
    return out | {"width": w, "depth": d, "height": h, "volume": w * d * h}


def ring_normal(ring: Column) -> list[Column]:
    """Newell's normal of a ring, an array of (x, y, z); its length is twice the area of a plane ring."""
    n = F.size(ring)
    at = F.sequence(F.lit(0), n - 1)
    nxt = lambda i: F.get(ring, (i + 1) % n)

    def part(p: str, q: str) -> Column:
        return F.aggregate(at, F.lit(0.0), lambda t, i: t + (F.get(ring, i)[p] - nxt(i)[p]) * (F.get(ring, i)[q] + nxt(i)[q]))

    return [F.when(n > 2, part(p, q)).otherwise(0.0) for p, q in (("y", "z"), ("z", "x"), ("x", "y"))]


def ring_area(ring: Column) -> Column:
    return F.sqrt(sum((c * c for c in ring_normal(ring)), F.lit(0.0))) / 2


def ring_validity(ring: Column) -> Column:
    """too-few-vertices, non-finite-vertex, self-intersecting, zero-area, degenerate-bbox or ok, of an array of (x, y); the first that holds."""
    n = F.size(ring)
    finite = F.forall(ring, lambda v: ~F.isnan(v["x"]) & ~F.isnan(v["y"]) & (F.abs(v["x"]) != float("inf")) & (F.abs(v["y"]) != float("inf")))
    at = F.sequence(F.lit(0), n - 1)
    p = lambda i, k: F.get(ring, (i + k) % n)

    def crosses(i: Column, j: Column) -> Column:
        a, b, c, d = p(i, 0), p(i, 1), p(j, 0), p(j, 1)
        ux, uy, vx, vy = b["x"] - a["x"], b["y"] - a["y"], d["x"] - c["x"], d["y"] - c["y"]
        wx, wy, turn = c["x"] - a["x"], c["y"] - a["y"], ux * vy - uy * vx
        t, u = (wx * vy - wy * vx) / F.nullif(turn, F.lit(0.0)), (wx * uy - wy * ux) / F.nullif(turn, F.lit(0.0))
        inside = lambda x: (x > 1e-9) & (x < 1 - 1e-9)
        return F.coalesce((F.abs(turn) >= 1e-12) & inside(t) & inside(u), F.lit(False))

    crossing = F.exists(at, lambda i: F.exists(at, lambda j: (j > i + 1) & ~((i == 0) & (j == n - 1)) & crosses(i, j)))
    area = F.abs(F.aggregate(at, F.lit(0.0), lambda t, i: t + p(i, 0)["x"] * p(i, 1)["y"] - p(i, 1)["x"] * p(i, 0)["y"])) / 2
    side = lambda c: F.array_max(F.transform(ring, lambda v: v[c])) - F.array_min(F.transform(ring, lambda v: v[c]))
    flat = (side("x") <= 0) | (side("y") <= 0)
    return F.when(n < 3, "too-few-vertices").when(~finite, "non-finite-vertex").when((n > 3) & crossing, "self-intersecting").when(area < 1e-9, "zero-area").when(flat, "degenerate-bbox").otherwise("ok")


def ramp(t: Column, stops: list[tuple[float, int, int, int]]) -> list[Column]:
    """Red, green and blue at t, clamped to 0 to 1, between colour stops; a t that is not finite counts as 0."""
    t = F.when(F.isnan(t) | (F.abs(t) == float("inf")) | t.isNull(), 0.0).otherwise(clamp(t, 0.0, 1.0))
    out = []
    for c in (1, 2, 3):
        v = F.lit(float(stops[-1][c]))
        for lo, hi in reversed(list(zip(stops, stops[1:], strict=False))):
            v = F.when(t <= hi[0], lo[c] + (hi[c] - lo[c]) * (t - lo[0]) / (hi[0] - lo[0])).otherwise(v)
        out.append(half_up(v).cast("int"))
    return out


#: The colour stops of hypsometric tints and of the plain blue-to-red ramp.
TERRAIN = [(0.0, 56, 122, 75), (0.35, 173, 188, 110), (0.6, 201, 168, 110), (0.8, 153, 122, 96), (1.0, 240, 240, 240)]
CLASSIC = [(0.0, 0, 0, 255), (0.25, 0, 200, 200), (0.5, 0, 220, 0), (0.75, 255, 180, 0), (1.0, 255, 0, 0)]


def by_scalar(value: Column, low: Column, high: Column, stops: list) -> list[Column]:
    """The colour of a value in its range; without a range every value has the first stop's colour."""
    return ramp(F.when(high > low, (value - low) / (high - low)).otherwise(0.0), stops)


def float32_spacing(magnitude: Column) -> Column:
    """Distance from a single-precision number to the next larger one (the next smaller one at the top); null beyond the range."""
    m = F.abs(magnitude.cast("float").cast("double"))
    power = F.greatest(F.floor(F.log2(F.when(m > 0, m))), F.lit(-126))
    # log2 may round up to the next whole number just below a power of two
    power = F.when(F.pow(F.lit(2.0), power) > m, F.greatest(power - 1, F.lit(-126))).otherwise(power)
    return F.when(F.isnan(m) | (m == float("inf")), None).when(m == 0, 2.0**-149).otherwise(F.pow(F.lit(2.0), power - 23))


def key_id(depth: Column, x: Column, y: Column, z: Column) -> Column:
    return F.concat_ws("-", *[c.cast("string") for c in (depth, x, y, z)])


def key_parts(key: Column) -> Column:
    """depth, x, y, z of a key; null for what is no key of whole numbers inside its depth's cube."""
    v = F.transform(F.split(key, "-"), lambda p: F.when(p.rlike("^[0-9]+$"), p.try_cast("int")))
    inside = F.forall(F.slice(v, 2, 3), lambda c: c < F.pow(F.lit(2.0), F.get(v, F.lit(0))))
    good = (F.size(v) == 4) & F.forall(v, lambda c: c.isNotNull()) & inside
    return F.when(good, F.struct(*[F.get(v, F.lit(i)).alias(n) for i, n in enumerate(("depth", "x", "y", "z"))]))


def key_parent(depth: Column, x: Column, y: Column, z: Column) -> Column:
    return F.when(depth > 0, key_id(depth - 1, *[F.shiftright(c, 1) for c in (x, y, z)]))


def code_units(text: Column) -> Column:
    """Sorts as UTF-16 code units do."""
    return F.encode(text, "UTF-16BE")


def fnv1a_units(text: Column) -> Column:
    """32-bit FNV-1a over UTF-16 code units, eight hexadecimal digits."""
    h = F.hex(F.encode(text, "UTF-16BE"))
    units = F.transform(F.sequence(F.lit(1), F.length(h), F.lit(4)), lambda i: F.conv(F.substring(h, i, F.lit(4)), 16, 10).cast("long"))
    units = F.when(F.length(h) > 0, units).otherwise(F.array().cast("array<bigint>"))
    value = F.aggregate(units, F.lit(2166136261).cast("bigint"), lambda s, c: s.bitwiseXOR(c) * 16777619 % (1 << 32))
    return F.lower(F.lpad(F.hex(value), 8, "0"))


def file_name(raw: Column, fallback: str) -> Column:
    """A name without the suffix .pdf, reserved characters, blanks and loose ends; the fallback if nothing is left."""
    s = F.regexp_replace(F.trim(F.coalesce(raw, F.lit(""))), r"(?i)\.pdf$", "")
    s = F.regexp_replace(s, r'[\\/:*?"<>|\x00-\x1F]', "")
    s = F.regexp_replace(F.regexp_replace(F.regexp_replace(s, r"\s+", "-"), "-{2,}", "-"), r"\.{2,}", ".")
    s = F.regexp_replace(s, r"^[-.\s]+|[-.\s]+$", "")
    return F.when(s != "", s).otherwise(fallback)


def utm_zone_of(epsg: Column) -> Column:
    """Zone of a UTM code, negative in the south; null for another code.  Fixed values: the code ranges."""
    ranges = [(32601, 32660, 32600, 1), (32701, 32760, 32700, -1), (26901, 26923, 26900, 1), (26701, 26722, 26700, 1), (25828, 25838, 25800, 1), (28348, 28358, 28300, -1), (7846, 7859, 7800, -1)]
    out = F.lit(None).cast("int")
    for low, high, base, sign in ranges:
        out = F.when(epsg.between(low, high), (epsg - base) * sign).otherwise(out)
    return out.cast("int")


def is_geographic(epsg: Column) -> Column:
    """Codes of latitude and longitude.  Fixed values: the block 4001 to 4999 but for 4978, and two codes outside."""
    return (epsg.between(4001, 4999) & (epsg != 4978)) | epsg.isin(7844, 6668)


def datum_of(epsg: Column) -> Column:
    """Family of datums of a code.  Fixed values: the codes and ranges."""
    single = {"WGS84": (4326, 3857, 3395, 4978), "NAD83": (4269, 5070), "NAD27": (4267,), "ETRS89": (4258, 3035), "GDA94": (4283, 3577), "GDA2020": (7844,), "NZGD2000": (4167, 2193), "CGCS2000": (4490,), "OSGB36": (27700,), "RGF93": (2154,)}
    ranges = [("WGS84", 32601, 32660), ("WGS84", 32701, 32760), ("NAD83", 26901, 26923), ("NAD27", 26701, 26722), ("ETRS89", 25828, 25838), ("GDA94", 28348, 28358), ("GDA2020", 7846, 7859)]
    out = F.lit(None).cast("string")
    for name, codes in single.items():
        out = F.when(epsg.isin(*codes), name).otherwise(out)
    for name, low, high in ranges:
        out = F.when(epsg.between(low, high), name).otherwise(out)
    return out


#: Metres of a linear unit.
METRES = {"metre": 1.0, "foot": 0.3048, "us-survey-foot": 1200 / 3937}


def to_metres(value: Column, unit: Column) -> Column:
    """Null where the unit is not known."""
    out = F.lit(None).cast("double")
    for name, f in METRES.items():
        out = F.when(unit == name, value * f).otherwise(out)
    return out


def up_to_z(x: Column, y: Column, z: Column) -> Vec:
    """From y upwards to z upwards."""
    return x, -z, y


def z_to_up(x: Column, y: Column, z: Column) -> Vec:
    return x, z, -y


def sun(azimuth: float, altitude: float) -> tuple[float, float, float]:
    az, al = math.radians(azimuth), math.radians(altitude)
    return math.sin(az) * math.cos(al), math.cos(az) * math.cos(al), math.sin(al)
