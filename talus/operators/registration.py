"""Rigid registration, hulls and shape descriptors: moments on the cluster, 3 x 3 algebra on one row."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spatial import nearest, radius_pairs


def rigid_solve(pairs: DataFrame, least: int = 3, max_rmse: float | None = None) -> dict:
    """pairs(x, y, z, tx, ty, tz) -> rotation, translation, rmse, n by Kabsch from one row of moments.

    Refuses too few, non-finite or degenerate (collinear) pairs, and a fit worse than max_rmse.
    """
    s, t = ("x", "y", "z"), ("tx", "ty", "tz")
    aggs = [F.count("*").alias("n")] + [F.avg(c).alias(f"m{c}") for c in s + t] + [F.avg(F.col(a) * F.col(b)).alias(f"{a}_{b}") for a in s for b in s + t] + [F.avg(sum((F.col(c) ** 2 for c in t), F.lit(0.0))).alias("tt")]
    r = pairs.agg(*aggs).first()
    if r["n"] < least:
        raise ValueError(f"{least} pairs are needed, there are {r['n']}")
    ms, mt = np.array([r[f"m{c}"] for c in s]), np.array([r[f"m{c}"] for c in t])
    if not np.isfinite(np.r_[ms, mt]).all():
        raise ValueError("pairs hold non-finite coordinates")
    spread = np.array([[r[f"{a}_{b}"] for b in s] for a in s]) - np.outer(ms, ms)
    values = np.linalg.eigvalsh(spread)
    if values[1] <= 1e-12 * max(values[2], 1e-300):
        raise ValueError("the source points lie on a line")
    h = np.array([[r[f"{a}_{b}"] for b in t] for a in s]) - np.outer(ms, mt)
    u, d, vt = np.linalg.svd(h)
    turn = np.diag([1.0, 1.0, np.sign(np.linalg.det(vt.T @ u.T))])
    rotation = vt.T @ turn @ u.T
    residual = np.trace(spread) + (r["tt"] - mt @ mt) - 2 * float((d * np.diag(turn)).sum())
    rmse = math.sqrt(max(residual, 0.0))
    if max_rmse is not None and rmse > max_rmse:
        raise ValueError(f"the fit's error {rmse:.6g} exceeds {max_rmse:.6g}")
    return {"rotation": rotation, "translation": mt - rotation @ ms, "rmse": rmse, "n": r["n"]}


def moved(pts: DataFrame, rotation: np.ndarray, translation: np.ndarray) -> DataFrame:
    new = {c: sum((F.col(o) * float(rotation[i][j]) for j, o in enumerate("xyz")), F.lit(float(translation[i]))) for i, c in enumerate("xyz")}
    return pts.withColumns(new)


def icp(source: DataFrame, target: DataFrame, radius: float, rounds: int = 40, tolerance: float = 1e-6, trim: float = 0.9, inliers: float = 0.3) -> dict:
    """Iterated nearest points within a radius, the worst share trimmed; one join and one row of moments a round."""
    rotation, translation, last = np.eye(3), np.zeros(3), math.inf
    total = source.count()
    for i in range(1, rounds + 1):
        here = moved(source, rotation, translation)
        near = nearest(here, target, radius)
        cut = near.agg(F.percentile("distance", trim)).first()[0]
        kept = near.where(F.col("distance") <= cut) if cut is not None else near
        t = target.select(F.col("point_id").alias("t_id"), *[F.col(c).alias(f"t{c}") for c in "xyz"])
        s = source.select(F.col("point_id").alias("s_id"), "x", "y", "z")
        pairs = kept.join(s, F.col("point_id") == F.col("s_id")).join(t, F.col("nearest") == F.col("t_id"))
        fit = rigid_solve(pairs)
        if fit["n"] < inliers * total:
            raise ValueError("too few points have a partner")
        rotation, translation = fit["rotation"], fit["translation"]
        if abs(last - fit["rmse"]) < tolerance:
            break
        last = fit["rmse"]
    return {"rotation": rotation, "translation": translation, "rmse": fit["rmse"], "rounds": i}


def _hull(x: np.ndarray) -> np.ndarray:
    p = np.unique(x, axis=0)
    if len(p) < 3:
        return p

    def chain(points) -> list:
        out: list = []
        for q in points:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(q)
        return out[:-1]

    return np.array(chain(p) + chain(p[::-1]))


def convex_hull(pts: DataFrame) -> DataFrame:
    """i, x, y: corners of the hull counter-clockwise.  Each task keeps the hull of its own points; only these corners meet."""

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = np.zeros((0, 2))
        for b in batches:
            held = _hull(np.r_[held, b[["x", "y"]].to_numpy()])
        yield pd.DataFrame(held, columns=["x", "y"])

    def last(t: pd.DataFrame) -> pd.DataFrame:
        h = _hull(t[["x", "y"]].to_numpy())
        return pd.DataFrame({"i": np.arange(len(h)), "x": h[:, 0], "y": h[:, 1]})

    corners = pts.select("x", "y").mapInPandas(local, "x double, y double")
    return corners.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(last, "i long, x double, y double")


def eigenvalues(xx: Column, xy: Column, xz: Column, yy: Column, yz: Column, zz: Column) -> list[Column]:
    """Eigenvalues of a symmetric 3 x 3 matrix in descending order, in closed form."""
    q = (xx + yy + zz) / 3
    p2 = ((xx - q) ** 2 + (yy - q) ** 2 + (zz - q) ** 2 + 2 * (xy**2 + xz**2 + yz**2)) / 6
    p = F.sqrt(p2)
    a, b, c = xx - q, yy - q, zz - q
    det = a * (b * c - yz**2) - xy * (xy * c - yz * xz) + xz * (xy * yz - b * xz)
    r = F.when(p > 0, F.least(F.greatest(det / (2 * p**3), F.lit(-1.0)), F.lit(1.0))).otherwise(F.lit(0.0))
    phi = F.acos(r) / 3
    high, low = q + 2 * p * F.cos(phi), q + 2 * p * F.cos(phi + 2 * math.pi / 3)
    return [high, 3 * q - high - low, low]


def normal_z(xx: Column, xy: Column, xz: Column, yy: Column, yz: Column, zz: Column, least: Column) -> Column:
    """Size of the third component of the unit eigenvector to the least eigenvalue; 1 where all directions are equal.

    The vector is the longest cross product of two rows of the matrix less the eigenvalue.
    """
    rows = [(xx - least, xy, xz), (xy, yy - least, yz), (xz, yz, zz - least)]
    cross = [(a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]) for a, b in ((rows[0], rows[1]), (rows[0], rows[2]), (rows[1], rows[2]))]
    best = F.array_max(F.array(*[F.struct((v[0] ** 2 + v[1] ** 2 + v[2] ** 2).alias("q"), F.abs(v[2]).alias("z")) for v in cross]))
    return F.when(best["q"] > 0, F.least(best["z"] / F.sqrt(best["q"]), F.lit(1.0))).otherwise(F.lit(1.0))


def descriptors(pts: DataFrame, radius: float) -> DataFrame:
    """point_id, n, linearity, planarity, sphericity, variation, anisotropy, omnivariance, eigenentropy, verticality.

    From the covariance of each point's neighbourhood; absent below three points, null where all lie in one place.
    """
    at = pts.select(F.col("point_id").alias("q_id"), *[F.col(c).alias(f"q{c}") for c in "xyz"])
    near = radius_pairs(pts, pts, radius).join(at, F.col("b_id") == F.col("q_id"))
    cov = lambda a, b: F.avg(F.col(f"q{a}") * F.col(f"q{b}")) - F.avg(f"q{a}") * F.avg(f"q{b}")
    m = near.groupBy("a_id").agg(F.count("*").alias("n"), *[cov(a, b).alias(a + b) for a, b in ("xx", "xy", "xz", "yy", "yz", "zz")]).where("n >= 3")
    six = [F.col(c) for c in ("xx", "xy", "xz", "yy", "yz", "zz")]
    e = m.select("*", *[F.greatest(v, F.lit(0.0)).alias(f"e{i}") for i, v in enumerate(eigenvalues(*six))])
    total = F.col("e0") + F.col("e1") + F.col("e2")
    some = F.col("e0") > 0
    share = [F.col(f"e{i}") / total for i in range(3)]
    entropy = sum((F.when(s > 0, -s * F.log(s)).otherwise(0.0) for s in share), F.lit(0.0))
    e = e.select(
        F.col("a_id").alias("point_id"), "n", F.when(some, (F.col("e0") - F.col("e1")) / F.col("e0")).alias("linearity"), F.when(some, (F.col("e1") - F.col("e2")) / F.col("e0")).alias("planarity"),
        F.when(some, F.col("e2") / F.col("e0")).alias("sphericity"), F.when(some, F.col("e2") / total).alias("variation"), F.when(some, (F.col("e0") - F.col("e2")) / F.col("e0")).alias("anisotropy"),
        F.when(some, F.cbrt(share[0] * share[1] * share[2])).alias("omnivariance"), F.when(some, entropy).alias("eigenentropy"), F.when(some, 1 - normal_z(*six, F.col("e2"))).alias("verticality"),
    )
    return e


def structure(d: DataFrame, planar: float = 0.5, high: float = 0.7, low: float = 0.3, scatter: float = 0.25) -> DataFrame:
    """Descriptors with structure: planar-vertical, planar-horizontal, scatter or ambiguous; null without descriptors."""
    flat = F.when(F.col("verticality") >= high, "planar-vertical").when(F.col("verticality") <= low, "planar-horizontal").otherwise("ambiguous")
    kind = F.when(F.col("planarity") >= planar, flat).when(F.col("sphericity") >= scatter, "scatter").otherwise("ambiguous")
    return d.withColumn("structure", F.when(F.col("planarity").isNotNull(), kind))


def conductor(pts: DataFrame, min_linearity: float = 0.9) -> dict:
    """Span, sag and residual of a hanging wire: a parabola over the main horizontal direction; refuses what is no line."""
    r = pts.agg(F.count("*").alias("n"), *[F.avg(c).alias(f"m{c}") for c in "xyz"], *[F.avg(F.col(a) * F.col(b)).alias(a + b) for a, b in ("xx", "xy", "xz", "yy", "yz", "zz")]).first()
    if r["n"] < 5:
        raise ValueError("five points are needed")
    m = np.array([r["mx"], r["my"], r["mz"]])
    cov = np.array([[r["xx"], r["xy"], r["xz"]], [r["xy"], r["yy"], r["yz"]], [r["xz"], r["yz"], r["zz"]]]) - np.outer(m, m)
    values = np.linalg.eigvalsh(cov)[::-1]
    if values[0] <= 0 or (values[0] - values[1]) / values[0] < min_linearity:
        raise ValueError("the points are no line")
    w, v = np.linalg.eigh(cov[:2, :2])
    ux, uy = v[:, np.argmax(w)]
    s = (F.col("x") - float(m[0])) * float(ux) + (F.col("y") - float(m[1])) * float(uy)
    at = pts.select(s.alias("s"), (F.col("z") - float(m[2])).alias("h"))
    p = at.agg(*[F.sum(F.col("s") ** k).alias(f"s{k}") for k in range(5)], *[F.sum(F.col("h") * F.col("s") ** k).alias(f"h{k}") for k in range(3)], F.sum(F.col("h") ** 2).alias("hh"), F.min("s").alias("lo"), F.max("s").alias("hi")).first()
    normal = np.array([[p[f"s{i + j}"] for j in range(3)] for i in range(3)])
    right = np.array([p[f"h{i}"] for i in range(3)])
    c = np.linalg.solve(normal, right)
    z = lambda x: c[0] + c[1] * x + c[2] * x * x
    along = np.linspace(p["lo"], p["hi"], 65)
    chord = z(p["lo"]) + (along - p["lo"]) / (p["hi"] - p["lo"]) * (z(p["hi"]) - z(p["lo"]))
    return {"span": p["hi"] - p["lo"], "sag": float((chord - z(along)).max()), "rms": math.sqrt(max(p["hh"] - c @ right, 0.0) / r["n"]), "n": r["n"]}
