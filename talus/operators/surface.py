"""The finished terrain grid: support of filled cells, confidence, paths over the surface, and how large a grid may be."""

from __future__ import annotations

import heapq
import math
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as E
from ..shared import order_statistics
from . import grid as G
from . import ground as R

# The eight directions, 45 degrees apart, as steps of (row, col).
RAYS = ((0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1))

# Cell sizes and contour intervals on offer, metres.
CELL_SIZES = (0.25, 0.5, 1.0, 2.0, 5.0, 10.0, 20.0)
INTERVALS = (0.1, 0.2, 0.25, 0.5, 1.0, 2.0, 2.5, 5.0, 10.0, 20.0, 25.0, 50.0)

TILE = 64


def support(cells: DataFrame, radius: int = 8) -> DataFrame:
    """row, col, directions, one_sided of holes: in how many of eight directions a cell lies within `radius` steps.

    One-sided is a hole whose directions leave an arc of more than 180 degrees open.  Holes that no ray hits are absent.
    """
    rays = F.array(*[F.struct(F.lit(1 << k).alias("bit"), F.lit(dr).alias("dr"), F.lit(dc).alias("dc")) for k, (dr, dc) in enumerate(RAYS)])
    sent = cells.select("row", "col", F.explode(rays).alias("ray")).select("row", "col", "ray", F.explode(F.sequence(F.lit(1), F.lit(radius))).alias("t"))
    at = sent.select((F.col("row") - F.col("ray.dr") * F.col("t")).alias("row"), (F.col("col") - F.col("ray.dc") * F.col("t")).alias("col"), F.col("ray.bit").alias("bit"))
    seen = R._inside(at.groupBy("row", "col").agg(F.bit_or("bit").alias("bits")), cells)
    hit = F.filter(F.sequence(F.lit(0), F.lit(7)), lambda k: F.getbit("bits", k) == 1)
    seen = seen.select("row", "col", hit.alias("a"))
    turned = F.concat(F.slice("a", F.lit(2), F.size("a")), F.array(F.element_at("a", 1) + 8))
    widest = F.array_max(F.zip_with(turned, "a", lambda x, y: x - y))
    return seen.select("row", "col", F.size("a").alias("directions"), (widest > 4).alias("one_sided"))


def dtm_grid(cells: DataFrame, size: float, reach: int = 8, radius: int = 8, penalty: float = 0.5) -> DataFrame:
    """row, col, z, measured, confidence, grade of cells(row, col, z, n) and of the holes that inverse distances reach.

    Measured: 100 min(1, n / median n) n / (n + 3).  Filled: 100 / (1 + steps to data), less up to 80 % by slope, times
    `penalty` when the support is one-sided.
    """
    filled = R.idw_fill(cells, reach).select("row", "col", "z")
    whole = cells.select("row", "col", "z", "n").unionByName(filled.withColumn("n", F.lit(None).cast("long")))
    slopes = G.horn(whole.select("row", "col", "z"), size).select("row", "col", "slope")
    target = order_statistics(cells.select(F.col("n").cast("double").alias("n")), {"target": ("n", 0.5)})
    d = whole.join(slopes, ["row", "col"], "left").join(G.edge_distance(cells, reach), ["row", "col"], "left").join(support(cells, radius), ["row", "col"], "left").join(F.broadcast(target), how="left")
    n = F.col("n").cast("double")
    own = F.least(n / F.greatest("target", F.lit(1.0)), F.lit(1.0)) * n / (n + 3)
    taken = (1 / (1 + F.col("dist"))) * (1 - E.clamp(F.coalesce("slope", F.lit(0.0)), 0.0, 1.0) * 0.8) * F.when(F.col("one_sided"), penalty).otherwise(1.0)
    c = E.half_up(100 * F.when(F.col("n").isNotNull(), own).otherwise(taken)).cast("long")
    return d.select("row", "col", "z", F.col("n").isNotNull().alias("measured"), c.alias("confidence")).withColumn("grade", F.when(F.col("confidence") >= 66, "solid").when(F.col("confidence") >= 33, "dashed").otherwise("gap"))


def walk(z: np.ndarray, known: np.ndarray, size: float, reach: int, enough: int, power: float, rows: range, cols: range) -> list[tuple[int, int, float]]:
    """Heights of the holes in rows x cols by the shortest ways over the surface z (nan: no way) to known cells."""
    steps = [(dr, dc, size * math.hypot(dr, dc)) for dr, dc in RAYS]
    out = []
    for r0 in rows:
        for c0 in cols:
            if known[r0, c0] or not np.isfinite(z[r0, c0]):
                continue
            best, heap, done = {(r0, c0): 0.0}, [(0.0, r0, c0)], set()
            weight = total = 0.0
            found = 0
            while heap and found < enough:
                cost, r, c = heapq.heappop(heap)
                if (r, c) in done:
                    continue
                done.add((r, c))
                if known[r, c]:
                    w = cost**-power
                    weight, total, found = weight + w, total + w * z[r, c], found + 1
                    continue
                for dr, dc, flat in steps:
                    a, b = r + dr, c + dc
                    if abs(a - r0) > reach or abs(b - c0) > reach or not (0 <= a < z.shape[0] and 0 <= b < z.shape[1]) or not np.isfinite(z[a, b]):
                        continue
                    way = cost + math.hypot(flat, z[a, b] - z[r, c])
                    if way < best.get((a, b), math.inf):
                        best[a, b] = way
                        heapq.heappush(heap, (way, a, b))
            out.append((r0, c0, total / weight if weight else float(z[r0, c0])))
    return out


def geodesic_fill(cells: DataFrame, size: float, reach: int = 24, enough: int = 12, power: float = 2.0) -> DataFrame:
    """row, col, z of cells and holes: a hole takes the `enough` cells nearest by way over the ground, weighted 1 / way^power.

    The ground to walk on is the inverse-distance fill; ways keep within `reach` of the hole, pass no known cell, and of
    equal ways the south-western end comes first.  Holes beyond the fill stay absent.  A task holds one tile and its
    margin: (64 + 2 reach)^2 cells whatever the table's size.
    """
    surface = cells.select("row", "col", "z", F.lit(True).alias("known")).unionByName(R.idw_fill(cells, reach, enough).select("row", "col", "z", F.lit(False).alias("known")))
    tiles = lambda c: F.sequence(F.floor((F.col(c) - reach) / TILE), F.floor((F.col(c) + reach) / TILE))
    dealt = surface.select("*", F.explode(tiles("row")).alias("tr")).select("*", F.explode(tiles("col")).alias("tc"))
    side = TILE + 2 * reach

    def fill(key: tuple[Any, ...], t: pd.DataFrame) -> pd.DataFrame:
        r0, c0 = int(key[0]) * TILE - reach, int(key[1]) * TILE - reach
        z, known = np.full((side, side), np.nan), np.zeros((side, side), bool)
        r, c = t["row"].to_numpy() - r0, t["col"].to_numpy() - c0
        z[r, c], known[r, c] = t["z"], t["known"]
        inner = range(reach, reach + TILE)
        got = walk(z, known, size, reach, enough, power, inner, inner)
        return pd.DataFrame([(r + r0, c + c0, v) for r, c, v in got], columns=["row", "col", "z"])

    return cells.select("row", "col", "z").unionByName(dealt.groupBy("tr", "tc").applyInPandas(fill, "row long, col long, z double"))


def relief_summary(vrm: DataFrame, tpi: DataFrame) -> DataFrame:
    """One row: median ruggedness with its quartiles and band, the commonest slope position (ties: least) and its share."""
    bands = F.when(F.col("vrm_median") < 0.002, "low").when(F.col("vrm_median") < 0.02, "moderate").when(F.col("vrm_median") < 0.1, "high").otherwise("very-high")
    q = order_statistics(vrm, {"vrm_median": ("vrm", 0.5), "vrm_p25": ("vrm", 0.25), "vrm_p75": ("vrm", 0.75)}).withColumn("band", bands)
    counts = tpi.groupBy("class").agg(F.count("*").alias("n"))
    top = counts.agg(F.min_by("class", F.struct(-F.col("n"), F.col("class"))).alias("dominant"), (F.max("n") / F.sum("n")).alias("share"))
    return q.join(F.broadcast(top), how="full")


def grid_budget(sizes: DataFrame, bytes_per_cell: int = 20, soft_cells: int = 16_000_000, soft_bytes: int = 512 * 2**20, hard_cells: int = 268_435_456) -> DataFrame:
    """sizes(cols, rows, ...) with cells, bytes and verdict: blocked, coarsen or ready; what is no positive size is blocked."""
    good = F.coalesce((F.col("cols") > 0) & (F.col("rows") > 0), F.lit(False))
    cells = F.when(good, F.col("cols").cast("decimal(20,0)") * F.col("rows").cast("decimal(18,0)")).otherwise(0)
    wide = sizes.withColumn("cells", cells.cast("double")).withColumn("bytes", F.col("cells") * bytes_per_cell)
    over = (F.col("cells") > soft_cells) | (F.col("bytes") > soft_bytes)
    return wide.withColumn("verdict", F.when(~good | (F.col("cells") >= hard_cells), "blocked").when(over, "coarsen").otherwise("ready"))


def _snapped(raw: Column, ladder: tuple) -> Column:
    """The least member that is not below; the last one if there is none."""
    return F.coalesce(F.array_min(F.filter(F.array(*[F.lit(x) for x in ladder]), lambda x: x >= raw)), F.lit(ladder[-1]))


def grid_recommendation(extents: DataFrame, budget: int = 4_000_000) -> DataFrame:
    """extents(points, width, depth, relief, ...) with spacing, cell, interval and feasible.

    A cell is 2.5 spacings, the interval a fifteenth of the relief, both snapped up; cells grow until the grid fits.
    """
    area = F.greatest("width", F.lit(0.0)) * F.greatest("depth", F.lit(0.0))
    e = extents.withColumn("area", area).withColumn("spacing", F.when((F.col("points") > 0) & (F.col("area") > 0), F.sqrt(F.col("area") / F.col("points"))))
    fits = lambda x: (F.col("area") == 0) | ((F.col("width") / x) * (F.col("depth") / x) <= max(10_000, budget))
    first = F.array_min(F.filter(F.array(*[F.lit(x) for x in CELL_SIZES]), fits))
    wanted = F.coalesce(F.when(F.col("spacing").isNotNull(), _snapped(F.col("spacing") * 2.5, CELL_SIZES)), F.lit(CELL_SIZES[1]))
    e = e.withColumn("wanted", wanted).withColumn("first", first)
    cell = F.when(F.col("first").isNull(), CELL_SIZES[-1]).when(fits(F.col("wanted")), F.col("wanted")).otherwise(F.col("first"))
    interval = F.when(F.col("relief") > 0, _snapped(F.col("relief") / 15, INTERVALS)).otherwise(1.0)
    return e.withColumns({"cell": cell, "interval": interval, "feasible": F.col("first").isNotNull()}).drop("area", "wanted", "first")
