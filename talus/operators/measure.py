"""Measurements: volumes over polygons, profiles along lines, stations, chains of measurements."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as E
from ..shared import order_statistics


def cut_fill(pts: DataFrame, ring: list, base: float) -> DataFrame:
    """n, fill, cut, net, footprint: heights of the points in the ring over a base, each standing for its share of the area."""
    area = E.ring_area(ring)
    d = F.col("z") - base
    share = F.lit(area) / F.nullif(F.count("*"), F.lit(0))
    inside = pts.where(E.polygon_contains(F.col("x"), F.col("y"), ring))
    fill, cut = F.sum(F.greatest(d, F.lit(0.0))) * share, F.sum(F.greatest(-d, F.lit(0.0))) * share
    return inside.agg(F.count("*").alias("n"), fill.alias("fill"), cut.alias("cut"), (fill - cut).alias("net"), F.lit(area).alias("footprint")).join(F.broadcast(order_statistics(inside.select(F.abs(d).alias("d")), {"median_abs": ("d", 0.5)})), how="left")


def stockpile(pts: DataFrame, ring: list, p: float = 0.05) -> DataFrame:
    """Volume over the p-quantile of the heights inside the ring, and its standard error from their spread."""
    area = E.ring_area(ring)
    inside = pts.where(E.polygon_contains(F.col("x"), F.col("y"), ring)).select("z")
    base = order_statistics(inside, {"base": ("z", p)})
    d = inside.join(F.broadcast(base)).withColumn("d", F.col("z") - F.col("base"))
    return d.agg(F.first("base").alias("base"), (F.sum("d") / F.count("*") * area).alias("volume"), (F.stddev_samp("d") / F.sqrt(F.count("*")) * area).alias("sigma"), F.count("*").alias("n"))


def profile(pts: DataFrame, a: tuple[float, float], b: tuple[float, float], band: float, samples: int, p: float = 0.25) -> DataFrame:
    """station, chainage, height, n: the p-quantile of the heights within `band` of the line, at evenly spaced stations.

    A band join whose line is a literal: every point is placed along the line where it is read.
    """
    dx, dy = b[0] - a[0], b[1] - a[1]
    length = math.hypot(dx, dy)
    ux, uy = dx / length, dy / length
    step = length / (samples - 1)
    along = (F.col("x") - a[0]) * ux + (F.col("y") - a[1]) * uy
    off = F.abs((F.col("y") - a[1]) * ux - (F.col("x") - a[0]) * uy)
    near = pts.select(along.alias("s"), off.alias("d"), "z").where(F.col("s").between(0.0, length) & (F.col("d") <= band))
    got = near.groupBy(E.half_up(F.col("s") / step).cast("long").alias("station")).agg(F.percentile("z", p).alias("height"), F.count("*").alias("n"))
    all_of = pts.sparkSession.range(samples).withColumnRenamed("id", "station")
    return all_of.join(got, "station", "left").select("station", (F.col("station") * step).alias("chainage"), "height", F.coalesce("n", F.lit(0)).alias("n"))


def _along(order: str):
    return Window.partitionBy("line").orderBy(order)


def grades(series: DataFrame) -> DataFrame:
    """series(line, s, h) -> rise over run in per cent and degrees to the next station of the same line; null without a run."""
    run, rise = F.lead("s").over(_along("s")) - F.col("s"), F.lead("h").over(_along("s")) - F.col("h")
    out = series.select("line", "s", "h", run.alias("run"), rise.alias("rise"))
    ok = F.col("run") > 0
    return out.select("line", "s", F.when(ok, F.col("rise") / F.col("run") * 100).alias("grade"), F.when(ok, F.degrees(F.atan2("rise", "run"))).alias("degrees"))


def profile_summary(series: DataFrame) -> DataFrame:
    """Per line: extremes with where they first occur, total gain and loss, steepest grade, mean grade from end to end."""
    step = series.select("line", "s", "h", (F.lead("h").over(_along("s")) - F.col("h")).alias("rise"), (F.lead("s").over(_along("s")) - F.col("s")).alias("run"))
    up = F.when(F.col("run") > 1e-9, F.col("rise"))
    return step.groupBy("line").agg(
        F.max("h").alias("highest"), F.min(F.struct((-F.col("h")).alias("k"), "s")).getField("s").alias("highest_at"),
        F.min("h").alias("lowest"), F.min(F.struct("h", "s")).getField("s").alias("lowest_at"),
        F.sum(F.greatest(up, F.lit(0.0))).alias("gain"), F.sum(F.greatest(-up, F.lit(0.0))).alias("loss"),
        F.max(F.abs(up / F.col("run") * 100)).alias("steepest"),
        ((F.max_by("h", "s") - F.min_by("h", "s")) / F.nullif(F.max("s") - F.min("s"), F.lit(0.0)) * 100).alias("mean_grade"),
    )


def cumulative_length(vertices: DataFrame) -> DataFrame:
    """vertices(line, i, x, y, z) -> length of each segment and from the line's start."""
    before = [F.lag(c).over(_along("i")) for c in "xyz"]
    d = vertices.select("line", "i", sum(((F.col(c) - b) ** 2 for c, b in zip("xyz", before, strict=True)), F.lit(0.0)).alias("d2"))
    d = d.select("line", "i", F.coalesce(F.sqrt("d2"), F.lit(0.0)).alias("segment"))
    return d.withColumn("length", F.sum("segment").over(_along("i").rowsBetween(Window.unboundedPreceding, 0)))


def stations(lines: DataFrame, interval: float) -> DataFrame:
    """lines(line, length) -> a station at every interval and at the end."""
    n = F.floor(F.col("length") / interval).cast("long")
    at = F.array_distinct(F.concat(F.transform(F.sequence(F.lit(0).cast("long"), n), lambda i: i * F.lit(interval)), F.array(F.col("length").cast("double"))))
    return lines.select("line", F.explode(at).alias("chainage")).withColumn("label", E.stationing(F.col("chainage")))


def chain(measurements: DataFrame) -> DataFrame:
    """measurements(kind, value) -> sum, mean, min, max, count of each kind."""
    return measurements.groupBy("kind").agg(F.sum("value").alias("sum"), F.avg("value").alias("mean"), F.min("value").alias("min"), F.max("value").alias("max"), F.count("value").alias("count"))


def bearings(vertices: DataFrame) -> DataFrame:
    """Bearing, horizontal distance, slope and 3-D distance from each vertex to the next of its line."""
    d = {c: F.lead(c).over(_along("i")) - F.col(c) for c in "xyz"}
    out = vertices.select("line", "i", *[v.alias(f"d{c}") for c, v in d.items()]).where("dx IS NOT NULL")
    run = F.sqrt(F.col("dx") ** 2 + F.col("dy") ** 2)
    return out.select("line", "i", E.bearing(F.col("dx"), F.col("dy")).alias("bearing"), run.alias("run"), F.sqrt(run**2 + F.col("dz") ** 2).alias("distance"), F.degrees(F.atan2(F.col("dz"), run)).alias("slope"))
