"""Picks, snaps, owners and page places: small questions put to whole tables, answered by one aggregation or key join."""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as E
from . import grid as G
from . import measure as M
from . import registration as T
from .spatial import radius_pairs

TOLERANCE = 0.07


def pick(pts: DataFrame, origin: tuple[float, float, float], direction: tuple[float, float, float], depth: str | None = None) -> DataFrame:
    """point_id, score, refining: the point nearest to a ray by its angle (below 0.07); of equals the least id; no row if none.

    Only points before the origin count.  With a depth column, refining says whether deeper nodes are there.
    """
    norm = math.sqrt(sum(d * d for d in direction))
    if not norm > 0:
        raise ValueError("a ray needs a direction")
    way = [d / norm for d in direction]
    v = [F.col(c) - o for c, o in zip("xyz", origin, strict=True)]
    along = v[0] * way[0] + v[1] * way[1] + v[2] * way[2]
    p = pts.withColumn("along", along).withColumn("off", F.sqrt(F.greatest(v[0] ** 2 + v[1] ** 2 + v[2] ** 2 - along**2, F.lit(0.0))))
    level = F.col(depth) if depth else F.lit(0)
    turn = F.col("off") / F.when(F.col("along") > 0, F.col("along"))
    hits = F.when(turn < TOLERANCE, F.struct(turn.alias("score"), F.col("point_id").alias("id"), level.alias("depth")))
    best = p.agg(F.min(hits).alias("m"), F.max(level).alias("deepest")).where("m IS NOT NULL")
    return best.select(F.col("m.id").alias("point_id"), F.col("m.score").alias("score"), (F.col("m.depth") < F.col("deepest")).alias("refining"))


def crossings(segments: DataFrame, cell: float) -> DataFrame:
    """a_id, b_id, x, y, z where two segments(id, x1, y1, z1, x2, y2, z2) cross in the plane; z is the mean of both.

    Segments meet in the cells that their boxes cover; a crossing counts in the cell that holds it.  Parallel ones have none.
    """
    run = lambda a, b: F.sequence(E.cell(F.least(a, b), cell), E.cell(F.greatest(a, b), cell))
    s = segments.select("*", F.explode(run("x1", "x2")).alias("kx")).select("*", F.explode(run("y1", "y2")).alias("ky"))
    a = s.select("kx", "ky", *[F.col(c).alias(f"a_{c}") for c in ("id", "x1", "y1", "z1", "x2", "y2", "z2")])
    b = s.select("kx", "ky", *[F.col(c).alias(f"b_{c}") for c in ("id", "x1", "y1", "z1", "x2", "y2", "z2")])
    j = a.join(b, ["kx", "ky"]).where("a_id < b_id")
    c = F.col
    r0, r1, s0, s1 = c("a_x2") - c("a_x1"), c("a_y2") - c("a_y1"), c("b_x2") - c("b_x1"), c("b_y2") - c("b_y1")
    dx, dy = c("b_x1") - c("a_x1"), c("b_y1") - c("a_y1")
    det = r0 * s1 - r1 * s0
    some = F.when(F.abs(det) >= 1e-12, det)
    j = j.withColumn("t", (dx * s1 - dy * s0) / some).withColumn("u", (dx * r1 - dy * r0) / some).where("t BETWEEN 0 AND 1 AND u BETWEEN 0 AND 1")
    j = j.withColumn("x", c("a_x1") + c("t") * r0).withColumn("y", c("a_y1") + c("t") * r1)
    z = (c("a_z1") + c("t") * (c("a_z2") - c("a_z1")) + c("b_z1") + c("u") * (c("b_z2") - c("b_z1"))) / 2
    # rounding may carry a crossing over a border that both boxes end at: there it counts in their last common cell
    last = lambda k, p, q, v: c(k) == F.least(F.greatest(E.cell(c(v), cell), E.cell(F.greatest(F.least(c(f"a_{p}"), c(f"a_{q}")), F.least(c(f"b_{p}"), c(f"b_{q}"))), cell)), E.cell(F.least(F.greatest(c(f"a_{p}"), c(f"a_{q}")), F.greatest(c(f"b_{p}"), c(f"b_{q}"))), cell))
    return j.where(last("kx", "x1", "x2", "x") & last("ky", "y1", "y2", "y")).select("a_id", "b_id", "x", "y", z.alias("z"))


def snapped(asked: DataFrame, pts: DataFrame, vertices: DataFrame, reach: float, cell: float | None = None) -> DataFrame:
    """point_id, kind, x, y, z, distance: what lies nearest to asked(point_id, x, y, z) within reach.

    Kinds are point, endpoint and midpoint and intersection of vertices(line, i, x, y, z).  A point wins ties of 1e-6; of
    the others the earlier kind.  Within a kind the least place wins.  An id has one row, or none if nothing is in reach.
    """
    w = Window.partitionBy("line").orderBy("i")
    seg = vertices.select("line", "i", *[F.col(c).alias(f"{c}1") for c in "xyz"], *[F.lead(c).over(w).alias(f"{c}2") for c in "xyz"]).where("x2 IS NOT NULL")
    seg = seg.withColumn("id", F.struct("line", "i"))
    kinds = [pts.select("x", "y", "z"), vertices.select("x", "y", "z"), seg.select(*[((F.col(f"{c}1") + F.col(f"{c}2")) / 2).alias(c) for c in "xyz"]), crossings(seg.drop("line", "i"), cell or reach).select("x", "y", "z")]
    places = [f.distinct().select(F.struct(F.lit(k).alias("k"), "x", "y", "z").alias("point_id"), "x", "y", "z") for k, f in enumerate(kinds)]
    at = functools.reduce(DataFrame.unionByName, places)
    # One join for all kinds.  The side that goes to 27 buckets is the one with fewer rows.
    if asked.count() > pts.count():
        near = radius_pairs(at, asked, reach).select(F.col("b_id").alias("point_id"), F.col("a_id").alias("at"), "d2")
    else:
        near = radius_pairs(asked, at, reach).select(F.col("a_id").alias("point_id"), F.col("b_id").alias("at"), "d2")
    found = F.struct(F.sqrt("d2").alias("distance"), "at")
    best = near.groupBy("point_id").agg(*[F.min(F.when(F.col("at.k") == k, found)).alias(f"m{k}") for k in range(len(kinds))])
    kept = F.col("m0")
    kind = F.when(F.col("m0").isNotNull(), F.lit("point"))
    for k, name in ((1, "endpoint"), (2, "midpoint"), (3, "intersection")):
        closer = F.col(f"m{k}").isNotNull() & (kept.isNull() | (F.col(f"m{k}")["distance"] < kept["distance"] - 1e-6))
        kind, kept = F.when(closer, name).otherwise(kind), F.when(closer, F.col(f"m{k}")).otherwise(kept)
    out = best.select("point_id", kind.alias("kind"), kept.alias("m")).where("m IS NOT NULL")
    return out.select("point_id", "kind", "m.at.x", "m.at.y", "m.at.z", "m.distance")


def owners(work: DataFrame, layers: DataFrame, facts: list[str]) -> DataFrame:
    """work with layer and reason: the one layer(layer, facts...) of the same facts; else filename-only, no-match or ambiguous."""
    known = F.coalesce(*[F.col(f"w.{c}").cast("string") for c in facts]).isNotNull()
    held = layers.groupBy(*facts).agg(F.min("layer").alias("layer"), F.count("*").alias("layers"))
    same = known
    for c in facts:
        same = same & F.col(f"w.{c}").eqNullSafe(F.col(f"l.{c}"))
    j = work.alias("w").join(held.alias("l"), same, "left")
    reason = F.when(~known, "filename-only").when(F.col("layers").isNull(), "no-match").when(F.col("layers") > 1, "ambiguous")
    return j.select("w.*", F.when(F.col("layers") == 1, F.col("l.layer")).alias("layer"), reason.alias("reason"))


def page_places(notes: DataFrame, box: tuple[float, float, float, float], shift: tuple[float, float], scale: float, up: str = "z") -> DataFrame:
    """notes(x, y, z, ...) with page_x, page_y and inside: their place on a page that shows the box (edges count as inside)."""
    x, y = F.col("x"), -F.col("z") if up == "y" else F.col("y")
    return notes.withColumns({"page_x": shift[0] + (x - box[0]) * scale, "page_y": shift[1] + (y - box[1]) * scale, "inside": x.between(box[0], box[2]) & y.between(box[1], box[3])})


def lasso_volume(selected: DataFrame, p: float = 0.05) -> DataFrame:
    """validity, base, n, fill, cut, net, footprint of selected points: over the p-quantile of their heights, by their hull.

    The hull's corners go to the driver: they are few, as a hull of integers within r has at most about r^(2/3).
    """
    n = selected.agg(F.count("*").alias("n"))
    ring = [(r.x, r.y) for r in T.convex_hull(selected).orderBy("i").collect()]
    area = abs(sum(ax * by - bx * ay for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1], strict=True))) / 2
    if len(ring) < 3 or not area > 0:
        word = "too-few-vertices" if len(ring) < 3 else "zero-area"
        return n.select(F.lit(word).alias("validity"), F.lit(None).cast("double").alias("base"), "n", *[F.lit(0.0).alias(c) for c in ("fill", "cut", "net", "footprint")])
    base = M.order_statistics(selected, {"base": ("z", p)})
    d = selected.join(F.broadcast(base)).withColumn("d", F.col("z") - F.col("base"))
    share = F.lit(area) / F.count("*")
    fill, cut = F.sum(F.greatest("d", F.lit(0.0))) * share, F.sum(F.greatest(-F.col("d"), F.lit(0.0))) * share
    return d.agg(F.lit("ok").alias("validity"), F.first("base").alias("base"), F.count("*").alias("n"), fill.alias("fill"), cut.alias("cut"), (fill - cut).alias("net"), F.lit(area).alias("footprint"))


def scan_report(pts: DataFrame, classes: list[int] | None = None, metres: float | None = 1.0) -> DataFrame:
    """One row of n, width, depth, height, footprint, density, spacing in metres; null sizes where the unit is unknown (None)."""
    p = pts if classes is None else pts.where(F.col("class").isin(classes))
    span = lambda c: ((F.max(c) - F.min(c)) * F.lit(metres)).cast("double")
    r = p.agg(F.count("*").alias("n"), span("x").alias("width"), span("y").alias("depth"), span("z").alias("height"))
    r = r.withColumn("footprint", F.col("width") * F.col("depth")).withColumn("density", F.when(F.col("footprint") > 0, F.col("n") / F.col("footprint")))
    return r.withColumn("spacing", F.when(F.col("density") > 0, 1 / F.sqrt("density")))


def probed(cells: DataFrame, at: DataFrame, size: float) -> DataFrame:
    """at(id, x, y) with row, col and the columns of the cell there; null where no cell is."""
    keyed = at.withColumn("row", E.cell(F.col("y"), size)).withColumn("col", E.cell(F.col("x"), size))
    return keyed.join(cells, ["row", "col"], "left")


def epoch_comparison(before: DataFrame, after: DataFrame, size: float, detect: float, facts: dict | None = None) -> DataFrame:
    """Change statistics of two grids by index, with notes and whether they lie on the same ground.

    facts may name shift (dx, dy between the origins), crs and datum (pairs) and unit (metres); a shift beyond half a cell,
    unequal or unknown systems and an unknown unit become notes.
    """
    f = facts or {}
    notes = ["offset"] * (max(map(abs, f.get("shift", (0.0, 0.0)))) > size / 2)
    for name in ("crs", "datum"):
        a, b = f.get(name, (None, None))
        notes += [f"{name}-unknown"] if a is None or b is None else [f"{name}-differs"] * (a != b)
    notes += ["unit-unknown"] * (f.get("unit") is None)
    s = G.change_stats(G.change(before, after, detect), size * size)
    return s.withColumn("notes", F.lit(",".join(notes))).withColumn("coregistered", F.lit(not notes))


def trusted_ground(pts: DataFrame, classes: list[int]) -> DataFrame:
    """pts with is_ground: finite points of the classes that the producer is trusted for."""
    finite = F.lit(True)
    for c in "xyz":
        finite = finite & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return pts.withColumn("is_ground", finite & F.coalesce(F.col("class").isin(classes), F.lit(False)))


def cells_by(pts: DataFrame, size: float, statistics: dict[str, Column]) -> DataFrame:
    """row, col and one column for each aggregate over the points of a cell: a grid of whatever can be aggregated."""
    return pts.groupBy(E.cell(F.col("y"), size).alias("row"), E.cell(F.col("x"), size).alias("col")).agg(*[c.alias(n) for n, c in statistics.items()])


def object_box(pts: DataFrame) -> DataFrame:
    """One row: n, length, width, height along the principal axes (longest first), box volume and area, completeness.

    Completeness is the share of 24 x 12 directions from the centroid that hold a point, in percent.  The axes come from
    one row of moments; below four finite points all sizes are 0.
    """
    import numpy as np

    good = trusted_ground(pts.withColumn("class", F.lit(0)), [0]).where("is_ground")
    six = ("xx", "xy", "xz", "yy", "yz", "zz")
    m = good.agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in "xyz"], *[F.covar_pop(a, b).alias(a + b) for a, b in six]).first()
    if m["n"] < 4:
        return good.agg(F.count("*").alias("n"), *[F.lit(0.0).alias(c) for c in ("length", "width", "height", "volume", "area", "completeness")])
    _, axes = np.linalg.eigh(np.array([[m["xx"], m["xy"], m["xz"]], [m["xy"], m["yy"], m["yz"]], [m["xz"], m["yz"], m["zz"]]]))
    d = [F.col(c) - m[c] for c in "xyz"]
    r = F.sqrt(d[0] ** 2 + d[1] ** 2 + d[2] ** 2)
    lon, lat = F.least(F.floor((F.atan2(d[1], d[0]) + math.pi) / (2 * math.pi) * 24), F.lit(23)), F.least(F.floor(F.acos(F.greatest(F.least(d[2] / F.when(r > 0, r), F.lit(1.0)), F.lit(-1.0))) / math.pi * 12), F.lit(11))
    along = good.select(*[(d[0] * float(a[0]) + d[1] * float(a[1]) + d[2] * float(a[2])).alias(f"p{i}") for i, a in enumerate(axes.T)], F.when(r >= 1e-9, lat * 24 + lon).alias("bin"))
    sides = F.sort_array(F.array(*[F.max(f"p{i}") - F.min(f"p{i}") for i in range(3)]), False)
    o = along.agg(F.count("*").alias("n"), sides.alias("s"), F.count_distinct("bin").alias("bins"))
    a, b, c = (F.col("s")[i] for i in range(3))
    return o.select("n", a.alias("length"), b.alias("width"), c.alias("height"), (a * b * c).alias("volume"), (2 * (a * b + a * c + b * c)).alias("area"), (100 * F.col("bins") / 288).alias("completeness"))
