"""Coordinate reference, colour and naming functions as columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# ASPRS class names by code.
ASPRS = (
    "Created, never classified", "Unclassified", "Ground", "Low vegetation", "Medium vegetation", "High vegetation", "Building", "Low point (noise)", "Reserved", "Water", "Rail", "Road surface",
    "Reserved", "Wire - guard", "Wire - conductor", "Transmission tower", "Wire-structure connector", "Bridge deck", "High noise", "Overhead structure", "Ignored ground", "Snow", "Temporal exclusion",
)


def class_name(code: Column) -> Column:
    return F.coalesce(F.get(F.array(*[F.lit(n) for n in ASPRS]), code.cast("int")), F.concat(F.lit("Class "), code.cast("string")))


def utm_zone(lat: Column, lon: Column) -> Column:
    """Zone number with the exceptions of south-west Norway and Svalbard; null outside -80 to 84 degrees."""
    plain = F.least(F.floor((lon + 180.0) / 6.0) + 1, F.lit(60)).cast("int")
    svalbard = F.when(lon < 9, 31).when(lon < 21, 33).when(lon < 33, 35).otherwise(37)
    zone = F.when((lat >= 56) & (lat < 64) & (lon >= 3) & (lon < 12), 32).when((lat >= 72) & (lon >= 0) & (lon < 42), svalbard).otherwise(plain)
    return F.when(lat.between(-80, 84) & lon.between(-180, 180), zone)


def utm_forward(lat: Column, lon: Column) -> tuple[Column, Column, Column]:
    """zone, easting, northing on WGS 84 by Krueger's series to the third order in n."""
    a, f = 6378137.0, 1 / 298.257223563
    n = f / (2 - f)
    big = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    e = 2 * math.sqrt(n) / (1 + n)
    zone = utm_zone(lat, lon)
    phi, lam = F.radians(lat), F.radians(lon - (zone * 6 - 183))
    t = F.sinh(F.atanh(F.sin(phi)) - e * F.atanh(e * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    east = eta + sum((c * F.cos(2 * (j + 1) * xi) * F.sinh(2 * (j + 1) * eta) for j, c in enumerate(alpha)), F.lit(0.0))
    north = xi + sum((c * F.sin(2 * (j + 1) * xi) * F.cosh(2 * (j + 1) * eta) for j, c in enumerate(alpha)), F.lit(0.0))
    return zone, 500000.0 + 0.9996 * big * east, 0.9996 * big * north + F.when(lat < 0, 10000000.0).otherwise(0.0)


def cell_metres(size: Column, geographic: Column, lat: Column, unit: float = 1.0) -> tuple[Column, Column]:
    """East-west and north-south metres of a cell; degrees shrink by the latitude's cosine, held within 89 degrees."""
    m = size * 111320.0
    phi = F.radians(F.least(F.greatest(F.coalesce(lat, F.lit(0.0)), F.lit(-89.0)), F.lit(89.0)))
    return F.when(geographic, m * F.cos(phi)).otherwise(size * unit), F.when(geographic, m).otherwise(size * unit)


def srgb_to_linear(byte: Column) -> Column:
    c = byte / 255.0
    return F.when(c <= 0.04045, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, F.lit(2.4)))


def linear_to_srgb(v: Column) -> Column:
    c = F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0))
    return F.floor(F.when(c <= 0.0031308, c * 12.92).otherwise(1.055 * F.pow(c, F.lit(1 / 2.4)) - 0.055) * 255.0 + 0.5).cast("int")


def fnv1a(text: Column) -> Column:
    """32-bit FNV-1a over the code points of a text, as eight hex digits."""
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("bigint"))
    h = F.aggregate(codes, F.lit(2166136261).cast("bigint"), lambda a, c: a.bitwiseXOR(c) * 16777619 % F.lit(1 << 32))
    return F.lower(F.lpad(F.hex(h), 8, "0"))


def hash_chain(entries: Column) -> Column:
    """Each entry's SHA-256 over the one before and its own text, folded over an array in order."""
    return F.aggregate(entries, F.lit(""), lambda h, e: F.sha2(F.concat_ws("|", h, e), 256))


def version_order(a: Column, b: Column) -> Column:
    """-1, 0 or 1 for dotted numbers; missing parts count as zero."""
    part = lambda v, i: F.coalesce(F.get(F.split(v, r"\."), i).try_cast("int"), F.lit(0))
    signs = F.transform(F.sequence(F.lit(0), F.greatest(F.size(F.split(a, r"\.")), F.size(F.split(b, r"\."))) - 1), lambda i: F.signum(part(a, i) - part(b, i)).cast("int"))
    return F.coalesce(F.get(F.filter(signs, lambda s: s != 0), F.lit(0)), F.lit(0))


def nice_step(low: float, high: float, target: int = 5) -> float:
    """1, 2, 5 or 10 times a power of ten, for about `target` ticks."""
    if not high > low:
        return 1.0
    raw = (high - low) / max(1, target)
    power = 10 ** math.floor(math.log10(raw))
    share = raw / power
    return power * (1 if share < 1.5 else 2 if share < 3 else 5 if share < 7 else 10)


def nice_ticks(low: float, high: float, target: int = 5) -> list[float]:
    step = nice_step(low, high, target)
    first = math.ceil(low / step)
    return [round((first + i) * step, 12) for i in range(int(math.floor(high / step + 1e-9)) - first + 1)]


def utm_inverse(zone: Column, east: Column, north: Column, south: Column) -> tuple[Column, Column]:
    """latitude and longitude in degrees of UTM places on WGS 84, the inverse of `utm_forward`."""
    a, f = 6378137.0, 1 / 298.257223563
    n = f / (2 - f)
    big = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    beta = (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480)
    delta = (2 * n - 2 * n**2 / 3 - 2 * n**3, 7 * n**2 / 3 - 8 * n**3 / 5, 56 * n**3 / 15)
    xi, eta = (north - F.when(south, 10000000.0).otherwise(0.0)) / (0.9996 * big), (east - 500000.0) / (0.9996 * big)
    x = xi - sum((c * F.sin(2 * (j + 1) * xi) * F.cosh(2 * (j + 1) * eta) for j, c in enumerate(beta)), F.lit(0.0))
    y = eta - sum((c * F.cos(2 * (j + 1) * xi) * F.sinh(2 * (j + 1) * eta) for j, c in enumerate(beta)), F.lit(0.0))
    chi = F.asin(F.sin(x) / F.cosh(y))
    phi = chi + sum((c * F.sin(2 * (j + 1) * chi) for j, c in enumerate(delta)), F.lit(0.0))
    return F.degrees(phi), F.degrees(F.atan2(F.sinh(y), F.cos(x))) + zone * 6 - 183
