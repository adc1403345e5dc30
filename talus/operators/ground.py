"""Ground filtering and filling of holes, by windows and joins over sparse cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as E
from . import grid as G


def _inside(found: DataFrame, cells: DataFrame) -> DataFrame:
    """Rows of found(row, col, ...) inside the box around the cells that are none of them."""
    box = cells.agg(F.min("row").alias("r0"), F.max("row").alias("r1"), F.min("col").alias("c0"), F.max("col").alias("c1"))
    within = F.col("row").between(F.col("r0"), F.col("r1")) & F.col("col").between(F.col("c0"), F.col("c1"))
    absent = found.join(cells.select("row", "col"), ["row", "col"], "left_anti")
    return absent.join(F.broadcast(box)).where(within).drop("r0", "r1", "c0", "c1")


def _reached(cells: DataFrame, reach: int) -> DataFrame:
    """Each hole with each present cell within `reach` of it: row, col, dr, dc, z.

    Cells go to their neighbours by key, so that holes come from the cells next to them and the box is never laid out.
    """
    side = F.sequence(F.lit(-reach), F.lit(reach))
    sent = cells.select("row", "col", "z", F.explode(side).alias("dr")).select("*", F.explode(side).alias("dc"))
    sent = sent.select((F.col("row") - F.col("dr")).alias("row"), (F.col("col") - F.col("dc")).alias("col"), "dr", "dc", "z")
    return _inside(sent, cells)


def nearest_fill(cells: DataFrame, reach: int) -> DataFrame:
    """Cells and holes: a hole takes the height of the nearest cell (least steps, then south-west first) within reach."""
    d = F.struct(F.greatest(F.abs("dr"), F.abs("dc")).alias("d"), (F.col("dr") ** 2 + F.col("dc") ** 2).alias("q"), "dr", "dc")
    near = _reached(cells, reach).groupBy("row", "col").agg(F.min_by("z", d).alias("z"))
    return cells.select("row", "col", "z").unionByName(near)


def idw_fill(cells: DataFrame, reach: int = 8, enough: int = 12) -> DataFrame:
    """row, col, z, found of holes: weights 1/d2 over rings of neighbours until `enough` are found, and one ring more."""
    ring = F.greatest(F.abs("dr"), F.abs("dc"))
    near = _reached(cells, reach).select("row", "col", ring.alias("ring"), (F.col("dr") ** 2 + F.col("dc") ** 2).alias("d2"), "z")
    by_ring = near.groupBy("row", "col", "ring").agg(F.count("*").alias("n"), F.sum(1 / F.col("d2")).alias("w"), F.sum(F.col("z") / F.col("d2")).alias("s"))
    rings = by_ring.groupBy("row", "col").agg(F.sort_array(F.collect_list(F.struct("ring", "n", "w", "s"))).alias("a"))
    upto = lambda r: F.aggregate("a", F.lit(0).cast("bigint"), lambda t, x: t + F.when(x["ring"] <= r, x["n"]).otherwise(0))
    last = F.coalesce(F.array_min(F.transform(F.filter("a", lambda x: upto(x["ring"]) >= enough), lambda x: x["ring"])), F.lit(reach)) + 1
    rings = rings.withColumn("last", last)
    total = lambda f: F.aggregate("a", F.lit(0.0), lambda t, x: t + F.when(x["ring"] <= F.col("last"), x[f]).otherwise(0.0))
    return rings.select("row", "col", (total("s") / total("w")).alias("z"), F.aggregate("a", F.lit(0).cast("bigint"), lambda t, x: t + F.when(x["ring"] <= F.col("last"), x["n"]).otherwise(0)).alias("found"))


def steepness(cells: DataFrame, size: float) -> DataFrame:
    """row, col, slope: greatest step to one of four neighbours over the cell's size."""
    mid = F.col(G.near(0, 0))
    steps = [F.abs(F.col(G.near(*d)) - mid) for d in ((-1, 0), (1, 0), (0, -1), (0, 1))]
    return G.neighbours(cells).select("row", "col", (F.coalesce(F.greatest(*steps), F.lit(0.0)) / size).alias("slope"))


def ground(pts: DataFrame, size: float, max_window: int = 4, threshold: float = 0.5, tilt: float = 0.15, scale: float = 1.25, cap: float = 2.5) -> DataFrame:
    """pts with is_ground: progressive morphological filter over the grid of lowest heights.

    For windows of radius 1 to max_window the surface is opened; where it stands out by more than
    min(cap, threshold + tilt * radius * size) it is cut to the opened one.  A point is ground when it is not higher over
    what is left than min(cap, threshold + scale * slope).
    """
    surface = nearest_fill(G.rasterise(pts, size, "min"), max_window)
    for b in range(1, max_window + 1):
        low = G.opened(surface, b).withColumnRenamed("z", "low")
        limit = min(cap, threshold + tilt * b * size)
        surface = surface.join(low, ["row", "col"]).select("row", "col", F.when(F.col("z") - F.col("low") > limit, F.col("low")).otherwise(F.col("z")).alias("z"))
    floor = surface.join(steepness(surface, size), ["row", "col"]).select("row", "col", F.col("z").alias("floor"), "slope")
    keyed = pts.withColumn("row", E.cell(F.col("y"), size)).withColumn("col", E.cell(F.col("x"), size))
    near = keyed.join(floor, ["row", "col"], "left")
    is_ground = F.col("z") - F.col("floor") <= F.least(F.lit(cap), threshold + scale * F.col("slope"))
    return near.withColumn("is_ground", F.coalesce(is_ground, F.lit(False))).drop("row", "col", "floor", "slope")


def holdout(pts: DataFrame, size: float, fold: int = 5) -> DataFrame:
    """How well cell means of the other points predict every `fold`-th point: RMSE, bias and share covered."""
    test = F.col("point_id") % fold == 0
    dtm = G.rasterise(pts.where(~test), size).select("row", "col", F.col("z").alias("p"))
    at = pts.where(test).select(E.cell(F.col("y"), size).alias("row"), E.cell(F.col("x"), size).alias("col"), "z").join(dtm, ["row", "col"], "left")
    e = F.col("z") - F.col("p")
    return at.agg(F.count("*").alias("n"), F.count("p").alias("covered"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(e).alias("bias"))


def status(cells: DataFrame, confidence: DataFrame, edge: int = 3) -> DataFrame:
    """state, cells: measured cells, low-confidence ones (below 33) and holes by how far they lie from data."""
    low = confidence.select(F.when(F.col("confidence") < 33, "low").otherwise("measured").alias("state"))
    near = _inside(G.edge_distance(cells, edge), cells).select(F.when(F.col("dist") < edge, "interpolated").otherwise("edge").alias("state"))
    seen = low.unionByName(near).groupBy("state").agg(F.count("*").alias("cells"))
    box = cells.agg(((F.max("row") - F.min("row") + 1) * (F.max("col") - F.min("col") + 1)).alias("all"))
    rest = seen.agg(F.coalesce(F.sum("cells"), F.lit(0)).alias("cells")).join(F.broadcast(box)).select(F.lit("empty").alias("state"), (F.col("all") - F.col("cells")).alias("cells"))
    return seen.unionByName(rest.where("cells > 0"))
