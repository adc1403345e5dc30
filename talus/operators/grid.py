"""Operators over sparse grids: cells(row, col, z); an empty cell is an absent row."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as E
from ..shared import order_statistics


def rasterise(pts: DataFrame, size: float, how: str = "mean", p: float = 0.5) -> DataFrame:
    """row, col, z, n: mean, min, max, median, percentile (linear) or robust mean of each cell's heights."""
    keyed = pts.select(E.cell(F.col("y"), size).alias("row"), E.cell(F.col("x"), size).alias("col"), "z")
    if how == "robust":  # mean of the values within three scaled deviations of the median: one grouping, values in an array
        a = keyed.groupBy("row", "col").agg(F.sort_array(F.collect_list("z")).alias("a"))
        mid = lambda c: (F.element_at(c, F.floor((F.size(c) + 1) / 2).cast("int")) + F.element_at(c, F.floor(F.size(c) / 2).cast("int") + 1)) / 2
        a = a.withColumn("m", mid(F.col("a")))
        a = a.withColumn("d", mid(F.sort_array(F.transform("a", lambda v: F.abs(v - F.col("m"))))))
        kept = F.filter("a", lambda v: F.abs(v - F.col("m")) <= 3 * 1.4826 * F.col("d"))
        return a.select("row", "col", (F.aggregate(kept, F.lit(0.0), lambda t, v: t + v) / F.size(kept)).alias("z"), F.size("a").cast("long").alias("n"))
    z = {"mean": F.avg("z"), "min": F.min("z"), "max": F.max("z"), "median": F.median("z"), "percentile": F.percentile("z", p)}[how]
    return keyed.groupBy("row", "col").agg(z.alias("z"), F.count("*").alias("n"))


def surface_stats(cells: DataFrame) -> DataFrame:
    return cells.agg(F.count("z").alias("cells"), F.min("z").alias("min"), F.max("z").alias("max"), F.avg("z").alias("mean"))


def height_above(dsm: DataFrame, dtm: DataFrame) -> DataFrame:
    """row, col, h: surface over ground where both are covered, never below zero."""
    d = dtm.select("row", "col", F.col("z").alias("ground"))
    return dsm.join(d, ["row", "col"]).select("row", "col", F.greatest(F.col("z") - F.col("ground"), F.lit(0.0)).alias("h"))


def canopy_stats(h: DataFrame) -> DataFrame:
    return h.agg(F.max("h").alias("max"), F.avg("h").alias("mean")).join(F.broadcast(order_statistics(h, {"p95": ("h", 0.95)})), how="left")


def neighbours(cells: DataFrame) -> DataFrame:
    """row, col and n_{dr}_{dc}: the height of each of the nine cells around, null where there is none (named by `near`).

    Every cell sends itself to its neighbours by key; one aggregation, combined before its shuffle, gathers them.
    """
    steps = [(dr, dc) for dr in (-1, 0, 1) for dc in (-1, 0, 1)]
    sent = _sent(cells.select("row", "col", "z"), steps)
    got = sent.groupBy("row", "col").agg(*[F.max(F.when(F.col("k") == i, F.col("z"))).alias(near(*d)) for i, d in enumerate(steps)], F.count("*").alias("n_found"))
    return got.where(F.col(near(0, 0)).isNotNull())


def near(dr: int, dc: int) -> str:
    return f"n_{dr + 1}_{dc + 1}"


def _sent(cells: DataFrame, steps: list[tuple[int, int]]) -> DataFrame:
    """Each cell under the key of every cell (row - dr, col - dc) that sees it at step k."""
    to = F.array(*[F.struct(F.lit(dr).alias("dr"), F.lit(dc).alias("dc"), F.lit(i).alias("k")) for i, (dr, dc) in enumerate(steps)])
    others = [c for c in cells.columns if c not in ("row", "col")]
    sent = cells.select("row", "col", *others, F.explode(to).alias("to"))
    return sent.select((F.col("row") - F.col("to.dr")).alias("row"), (F.col("col") - F.col("to.dc")).alias("col"), F.col("to.k").alias("k"), *others)


def horn(cells: DataFrame, size: float) -> DataFrame:
    """row, col, z, slope (rise over run), aspect (radians downhill, counter-clockwise from east), complete.

    Horn's 3 x 3 weights, rows counted northwards.  Beyond the grid's edge a value is extrapolated across that edge
    (twice the edge less its inner neighbour) and clamped along it, rows before columns; a hole inside the grid takes
    the centre's height.  The grid is the box around the cells with data.
    """
    found = neighbours(cells)
    box = cells.agg(F.min("row").alias("r0"), F.max("row").alias("r1"), F.min("col").alias("c0"), F.max("col").alias("c1"))
    found = found.join(F.broadcast(box))
    n = lambda dr, dc: F.col(near(dr, dc))
    mid = n(0, 0)
    row_edge = (F.col("r1") > F.col("r0")) & F.col("row").isin(F.col("r0"), F.col("r1"))
    col_edge = ~row_edge & (F.col("c1") > F.col("c0")) & F.col("col").isin(F.col("c0"), F.col("c1"))
    v = {}
    for dr in (-1, 0, 1):
        for dc in (-1, 0, 1):
            off_r = ~(F.col("row") + dr).between(F.col("r0"), F.col("r1"))
            off_c = ~(F.col("col") + dc).between(F.col("c0"), F.col("c1"))
            over_r, over_c = row_edge & off_r, col_edge & off_c
            along_c, along_r = lambda r: F.when(off_c, n(r, 0)).otherwise(n(r, dc)), lambda c: F.when(off_r, n(0, c)).otherwise(n(dr, c))  # noqa: B023, E731
            edge = F.when(over_r, along_c(0)).when(over_c, along_r(0))
            inner = F.when(over_r, along_c(-dr)).when(over_c, along_r(-dc))
            plain = F.when(off_r & off_c, mid).when(off_r, n(0, dc)).when(off_c, n(dr, 0)).otherwise(n(dr, dc))
            v[dr, dc] = F.when(over_r | over_c, F.coalesce(2 * edge - inner, edge, mid)).otherwise(F.coalesce(plain, mid))
    dx = ((v[-1, 1] + 2 * v[0, 1] + v[1, 1]) - (v[-1, -1] + 2 * v[0, -1] + v[1, -1])) / (8 * size)
    dy = ((v[1, -1] + 2 * v[1, 0] + v[1, 1]) - (v[-1, -1] + 2 * v[-1, 0] + v[-1, 1])) / (8 * size)
    out = found.select("row", "col", mid.alias("z"), dx.alias("dx"), dy.alias("dy"), (F.col("n_found") == 9).alias("complete"))
    flat = (F.col("dx") == 0) & (F.col("dy") == 0)
    return out.select("row", "col", "z", F.sqrt(F.col("dx") ** 2 + F.col("dy") ** 2).alias("slope"), F.when(flat, 0.0).otherwise(F.atan2(-F.col("dy"), -F.col("dx"))).alias("aspect"), "complete")


def slope_stats(slopes: DataFrame) -> DataFrame:
    d = slopes.select(F.degrees(F.atan("slope")).alias("d"))
    bands = d.agg(F.avg("d").alias("mean"), F.max("d").alias("max"), F.count_if(F.col("d") < 5).alias("gentle"), F.count_if((F.col("d") >= 5) & (F.col("d") < 20)).alias("moderate"), F.count_if(F.col("d") >= 20).alias("steep"))
    return bands.join(F.broadcast(order_statistics(d, {"p95": ("d", 0.95)})), how="left")


def hillshade(slopes: DataFrame, azimuth: float = 315.0, altitude: float = 45.0) -> DataFrame:
    return slopes.select("row", "col", E.shade(F.atan("slope"), F.col("aspect"), azimuth, altitude).alias("shade"))


def multi_hillshade(slopes: DataFrame, altitude: float = 45.0) -> DataFrame:
    """Four lights, each weighted by how much the cell faces it."""
    zenith, a = math.radians(90 - altitude), F.atan("slope")
    total, weights = F.lit(0.0), F.lit(0.0)
    for azimuth in (225.0, 270.0, 315.0, 360.0):  # fixed values
        facing = F.cos(F.lit(math.radians((360.0 - azimuth + 90.0) % 360.0)) - F.col("aspect"))
        w = 0.5 + 0.5 * F.greatest(facing, F.lit(0.0))
        light = math.cos(zenith) * F.cos(a) + math.sin(zenith) * F.sin(a) * facing
        total, weights = total + w * F.greatest(light, F.lit(0.0)), weights + w
    return slopes.select("row", "col", E.clamp(E.half_up(total / weights * 255).cast("double"), 0.0, 255.0).alias("shade"))


#: Fixed value: the slope (rise over run) up to which a middle position counts as flat, 5 degrees.
FLAT = math.tan(math.radians(5))


def tpi(cells: DataFrame, radius: int, slopes: DataFrame) -> DataFrame:
    """row, col, tpi, class: height over the mean of a disc of neighbours, and its class by standard deviations.

    Six classes: 1 valley, 2 lower slope, 3 flat, 4 middle slope, 5 upper slope, 6 ridge.  slopes(row, col, slope) parts
    flat from middle; a cell without a slope counts as flat.  Cells without neighbours have no index.
    """
    steps = [(0, 0)] + [(dr, dc) for dr in range(-radius, radius + 1) for dc in range(-radius, radius + 1) if 0 < dr * dr + dc * dc <= radius * radius]
    own = F.col("k") == 0
    sums = _sent(cells.select("row", "col", "z"), steps).groupBy("row", "col").agg(F.max(F.when(own, F.col("z"))).alias("z"), F.avg(F.when(~own, F.col("z"))).alias("mean"))
    t = sums.select("row", "col", (F.col("z") - F.col("mean")).alias("tpi")).where("tpi IS NOT NULL")
    scale = t.agg(F.avg("tpi").alias("m"), F.stddev_pop("tpi").alias("s"))
    score = F.when(F.col("s") > 0, (F.col("tpi") - F.col("m")) / F.col("s")).otherwise(0.0)
    kind = F.when(score > 1, 6).when(score > 0.5, 5).when(score >= -0.5, F.when(F.col("slope") > FLAT, 4).otherwise(3)).when(score >= -1, 2).otherwise(1)
    return t.join(slopes.select("row", "col", "slope"), ["row", "col"], "left").join(F.broadcast(scale)).select("row", "col", "tpi", kind.alias("class"))


def vrm(slopes: DataFrame, radius: int = 1) -> DataFrame:
    """row, col, vrm: one less the length of the mean unit normal of the window."""
    side = F.sequence(F.lit(-radius), F.lit(radius))
    a = F.atan("slope")
    n = slopes.select("row", "col", (F.sin(a) * F.cos("aspect")).alias("nx"), (F.sin(a) * F.sin("aspect")).alias("ny"), F.cos(a).alias("nz"))
    sent = n.select("*", F.explode(side).alias("dr")).select("*", F.explode(side).alias("dc"))
    sums = sent.groupBy((F.col("row") + F.col("dr")).alias("row"), (F.col("col") + F.col("dc")).alias("col")).agg(
        *[F.sum(c).alias(c) for c in ("nx", "ny", "nz")], F.count("*").alias("n"), F.count_if((F.col("dr") == 0) & (F.col("dc") == 0)).alias("own")
    )
    return sums.where("own > 0").select("row", "col", (1 - F.sqrt(F.col("nx") ** 2 + F.col("ny") ** 2 + F.col("nz") ** 2) / F.col("n")).alias("vrm"))


def opened(cells: DataFrame, b: int) -> DataFrame:
    """Morphological opening by a square of radius b: separable minima, then maxima, over cells with data."""

    def along(df: DataFrame, f, by: str, over: str) -> DataFrame:
        return df.withColumn("z", f("z").over(Window.partitionBy(by).orderBy(over).rangeBetween(-b, b)))

    out = cells.select("row", "col", "z")
    for f in (F.min, F.max):
        out = along(along(out, f, "row", "col"), f, "col", "row")
    return out


def spikes(cells: DataFrame, k: float = 6.0, floor: float = 0.3) -> DataFrame:
    """Cells that stand off the median of their neighbours by more than k scaled deviations and `floor`."""
    others = F.array(*[F.col(near(dr, dc)) for dr in (-1, 0, 1) for dc in (-1, 0, 1) if (dr, dc) != (0, 0)])
    mid = lambda a: (F.element_at(F.sort_array(a), F.floor((F.size(a) + 1) / 2).cast("int")) + F.element_at(F.sort_array(a), F.floor(F.size(a) / 2).cast("int") + 1)) / 2
    rows = neighbours(cells).where("n_found >= 5").select("row", "col", F.col(near(0, 0)).alias("z"), F.array_compact(others).alias("o"))
    rows = rows.withColumn("m", mid(F.col("o")))
    rows = rows.withColumn("d", mid(F.transform("o", lambda v: F.abs(v - F.col("m")))))
    return rows.where(F.abs(F.col("z") - F.col("m")) > F.greatest(k * 1.4826 * F.col("d"), F.lit(floor))).select("row", "col", "z", F.col("m").alias("replacement"))


def cell_confidence(cells: DataFrame, target: int = 8) -> DataFrame:
    """row, col, confidence, grade of measured cells: from how many returns they hold."""
    n = F.col("n").cast("double")
    c = E.half_up(100 * F.least(n / target, F.lit(1.0)) * n / (n + 3)).cast("long")
    return cells.select("row", "col", c.alias("confidence"), F.when(c >= 66, "solid").when(c >= 33, "dashed").otherwise("gap").alias("grade"))


def edge_distance(cells: DataFrame, reach: int) -> DataFrame:
    """row, col, dist: Chebyshev distance of each absent cell within reach to the nearest present one."""
    side = F.sequence(F.lit(-reach), F.lit(reach))
    sent = cells.select("row", "col", F.explode(side).alias("dr")).select("row", "col", "dr", F.explode(side).alias("dc"))
    sent = sent.select((F.col("row") + F.col("dr")).alias("row"), (F.col("col") + F.col("dc")).alias("col"), F.greatest(F.abs("dr"), F.abs("dc")).alias("d"))
    return sent.groupBy("row", "col").agg(F.min("d").alias("dist")).where("dist > 0")


def contour_segments(cells: DataFrame, size: float, interval: float, max_levels: int = 200) -> DataFrame:
    """level, x1, y1, x2, y2 (and confidence, if cells have it): marching squares between four neighbouring cell centres.

    A corner is in when z >= level; of a saddle the height of the bilinear surface's saddle point decides (the mean of
    the corners where there is none); segments without length go.  Confidence is the least of the corners.  If there are
    more than `max_levels` levels, one in every k stays, the last one always.
    """
    graded = "confidence" in cells.columns
    z = cells.select("row", "col", "z", *["confidence"] * graded)
    corners = [("a", 0, 0), ("b", 0, 1), ("c", 1, 1), ("d", 1, 0)]
    sq = _sent(z, [(dr, dc) for _, dr, dc in corners]).groupBy("row", "col").agg(*[F.max(F.when(F.col("k") == i, F.col("z"))).alias(n) for i, (n, _, _) in enumerate(corners)], F.count("z").alias("found"), *[F.min("confidence").alias("confidence")] * graded)
    sq = sq.where("found = 4")
    step = F.lit(interval)
    span = z.agg(F.ceil(F.min("z") / step).cast("long").alias("i0"), F.floor(F.max("z") / step + 1e-9).cast("long").alias("i1"))
    every = F.greatest(F.ceil((F.col("i1") - F.col("i0") + 1) / max_levels), F.lit(1)).cast("long")
    span = span.withColumn("every", every).withColumn("last", F.ceil((F.col("i1") - F.col("i0") + 1) / F.col("every")) * F.col("every") - F.col("every"))
    low, high = F.least("a", "b", "c", "d"), F.greatest("a", "b", "c", "d")
    first, last = F.ceil(low / interval).cast("long"), F.floor(high / interval).cast("long")
    sq = sq.select("*", F.explode(F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))).alias("i")).withColumn("v", F.col("i") * F.lit(interval))
    place = F.col("i") - F.col("i0")
    sq = sq.join(F.broadcast(span)).where((F.pmod(place, F.col("every")) == 0) & (place < F.col("last")) | (F.col("i") == F.col("i1")))
    v = F.col("v")
    x, y = (F.col("col") + 0.5) * size, (F.col("row") + 0.5) * size
    cut = lambda p, q: (v - F.col(p)) / (F.col(q) - F.col(p)) * size
    point = {"s": (x + cut("a", "b"), y), "e": (x + size, y + cut("b", "c")), "n": (x + cut("d", "c"), y + size), "w": (x, y + cut("a", "d"))}
    code = sum(((F.col(c) >= v).cast("int") * w for c, w in (("a", 1), ("b", 2), ("c", 4), ("d", 8))), F.lit(0))
    twist = F.col("a") + F.col("c") - F.col("b") - F.col("d")
    saddle = F.when(F.abs(twist) > 1e-12, (F.col("a") * F.col("c") - F.col("b") * F.col("d")) / twist).otherwise((F.col("a") + F.col("b") + F.col("c") + F.col("d")) / 4)
    centre = saddle >= v
    # Edges crossed for each pattern of corners; the saddles 5 and 10 have two ways.
    lines = {1: ["ws"], 2: ["se"], 3: ["we"], 4: ["en"], 6: ["sn"], 7: ["wn"], 8: ["nw"], 9: ["ns"], 11: ["ne"], 12: ["ew"], 13: ["es"], 14: ["sw"]}
    seg = lambda e: F.struct(point[e[0]][0].alias("x1"), point[e[0]][1].alias("y1"), point[e[1]][0].alias("x2"), point[e[1]][1].alias("y2"))
    pick = F.when(code == 5, F.when(centre, F.array(seg("se"), seg("nw"))).otherwise(F.array(seg("ws"), seg("en"))))
    pick = pick.when(code == 10, F.when(centre, F.array(seg("ws"), seg("en"))).otherwise(F.array(seg("se"), seg("nw"))))
    for k, es in lines.items():
        pick = pick.when(code == k, F.array(*[seg(e) for e in es]))
    out = sq.select(v.alias("level"), *["confidence"] * graded, F.explode(pick).alias("p")).select("level", "p.*", *["confidence"] * graded)
    return out.where("x1 <> x2 OR y1 <> y2")


def change(before: DataFrame, after: DataFrame, detect: float) -> DataFrame:
    """row, col, diff, class: cells of both epochs; -1, 0, 1 by the level of detection."""
    b = before.select("row", "col", F.col("z").alias("za"))
    d = F.col("z") - F.col("za")
    return after.join(b, ["row", "col"]).select("row", "col", d.alias("diff"), F.when(d > detect, 1).when(d < -detect, -1).otherwise(0).alias("class"))


def change_stats(diff: DataFrame, cell_area: float) -> DataFrame:
    v = F.col("diff") * cell_area
    return diff.agg(F.count("*").alias("cells"), F.sum(F.when(F.col("class") == 1, v).otherwise(0.0)).alias("gain"), F.sum(F.when(F.col("class") == -1, -v).otherwise(0.0)).alias("loss"), F.sum(F.when(F.col("class") != 0, v).otherwise(0.0)).alias("net"), F.avg(F.abs("diff")).alias("mean_abs"), F.min("diff").alias("lowest"), F.max("diff").alias("highest"))


def agreement(a: DataFrame, b: DataFrame, tolerance: float) -> DataFrame:
    """How two rasters agree: coverage masks, signed and absolute errors, share within tolerance."""
    j = a.select("row", "col", F.col("z").alias("za")).join(b.select("row", "col", F.col("z").alias("zb")), ["row", "col"], "full")
    j = j.withColumn("d", F.col("za") - F.col("zb")).withColumn("e", F.abs("d"))
    errors = j.agg(
        F.count("d").alias("both"), F.count_if(F.col("zb").isNull()).alias("only_a"), F.count_if(F.col("za").isNull()).alias("only_b"),
        F.avg("d").alias("mean_error"), F.sqrt(F.avg(F.col("d") ** 2)).alias("rmse"), F.avg("e").alias("mae"), (F.count_if(F.col("e") <= tolerance) / F.count("d")).alias("within"),
    )
    return errors.join(F.broadcast(order_statistics(j, {"median_error": ("d", 0.5), "p95": ("e", 0.95)})), how="left")
