"""Operators over points: filters, histograms, reduction, density, health, class edits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as E
from ..shared import order_statistics, ranked


def range_filter(pts: DataFrame, col: str, low: float | None = None, high: float | None = None) -> DataFrame:
    """Inclusive, ends in any order; without a bound everything passes, else NaN and null fail."""
    if low is None and high is None:
        return pts
    if low is not None and high is not None and low > high:
        low, high = high, low
    keep = ~F.isnan(col)
    if low is not None:
        keep = keep & (F.col(col) >= low)
    if high is not None:
        keep = keep & (F.col(col) <= high)
    return pts.where(keep)


def clip_box(pts: DataFrame, low: tuple, high: tuple, keep_inside: bool = True) -> DataFrame:
    """Six inclusive faces; the comparisons reach the scan."""
    inside = F.lit(True)
    for c, a, b in zip("xyz", low, high, strict=True):
        inside = inside & F.col(c).between(min(a, b), max(a, b))
    return pts.where(inside if keep_inside else ~inside)


def class_mask(pts: DataFrame, visible: list[int]) -> DataFrame:
    return pts.where(F.col("class").isin(visible))


def class_histogram(pts: DataFrame) -> DataFrame:
    return pts.groupBy((F.col("class") % 256).alias("class")).agg(F.count("*").alias("n"))


def class_coverage(pts: DataFrame) -> DataFrame:
    """How many points a producer has classified: codes 0 and 1 and missing ones count as unclassified."""
    none = F.coalesce(F.col("class"), F.lit(0)).isin(0, 1)
    return pts.agg(F.count_if(none).alias("unclassified"), F.count_if(~none).alias("producer"))


def bounds(pts: DataFrame) -> DataFrame:
    return pts.agg(*[f(c).alias(f"{n}_{c}") for c in "xyz" for n, f in (("min", F.min), ("max", F.max))], F.count("*").alias("n"))


def recentred(pts: DataFrame) -> DataFrame:
    """Coordinates as floats from a whole-number origin below the least of each axis."""
    low = pts.agg(*[F.floor(F.min(c)).cast("double").alias(f"o{c}") for c in "xyz"])
    return pts.join(F.broadcast(low)).select("point_id", *[(F.col(c) - F.col(f"o{c}")).cast("float").alias(c) for c in "xyz"])


def equal_width_histogram(pts: DataFrame, col: str, bins: int) -> DataFrame:
    """bin, n for every bin; the greatest value closes the last; without a span all fall in bin 0."""
    span = pts.agg(F.min(col).alias("lo"), F.max(col).alias("hi"))
    place = F.least(F.floor((F.col(col) - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1))
    counted = pts.join(F.broadcast(span)).groupBy(F.when(F.col("hi") > F.col("lo"), place).otherwise(0).cast("long").alias("bin")).agg(F.count("*").alias("n"))
    return pts.sparkSession.range(bins).withColumnRenamed("id", "bin").join(counted, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def voxel_centroids(pts: DataFrame, size: float) -> DataFrame:
    """One point per occupied cube: mean position, rounded mean intensity, class of the member with the least id."""
    if size <= 0:
        raise ValueError("voxel size must be positive")
    keys = [E.cell(F.col(c), size).alias(f"k{c}") for c in "xyz"]
    return (
        pts.groupBy(*keys)
        .agg(*[F.avg(c).alias(c) for c in "xyz"], E.half_up(F.avg("intensity")).cast("long").alias("intensity"), F.min_by("class", "point_id").alias("class"), F.min("point_id").alias("point_id"), F.count("*").alias("n"))
    )


def voxel_size_for(pts: DataFrame, budget: int) -> DataFrame:
    """Edge of a voxel that leaves about `budget` points: the root of the largest face of the box over the budget."""
    d = [F.max(c) - F.min(c) for c in "xyz"]
    return pts.agg(F.sqrt(F.greatest(d[0] * d[1], d[1] * d[2], d[0] * d[2]) / budget).alias("size"))


def stride_sample(pts: DataFrame, step: int) -> DataFrame:
    """The point of least hash from each run of `step` ids: stratified, and the same however rows are dealt."""
    return pts.groupBy(F.floor(F.col("point_id") / step).alias("bucket")).agg(F.min_by(F.struct("point_id", "x", "y", "z"), F.struct(F.crc32(F.col("point_id").cast("string")), "point_id")).alias("p")).select("p.*")


def density(pts: DataFrame, size: float) -> DataFrame:
    """row, col, n, density: points of each cell over its area."""
    return pts.groupBy(E.cell(F.col("y"), size).alias("row"), E.cell(F.col("x"), size).alias("col")).agg(F.count("*").alias("n")).withColumn("density", F.col("n") / F.lit(size * size))


def density_stats(pts: DataFrame, size: float) -> DataFrame:
    """Mean, greatest and the floor-index 95th percentile of cell densities."""
    d = density(pts, size)
    at = F.floor(F.lit(0.95) * (F.col("n") - 1))
    p95 = ranked(d, ["density"]).where((F.col("place") <= at) & (at < F.col("place") + F.col("m"))).select(F.col("v").alias("p95"))
    return d.agg(F.count("*").alias("cells"), F.avg("density").alias("mean"), F.max("density").alias("max")).join(F.broadcast(p95), how="left")


def duplicates(pts: DataFrame) -> DataFrame:
    """Points whose exact position an earlier one has: counts combine before the shuffle."""
    return pts.groupBy("x", "y", "z").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"), F.sum("n").alias("points"))


def stray_outliers(pts: DataFrame, factor: float = 8.0) -> DataFrame:
    """Points farther than `factor` median absolute deviations from the median on any axis."""
    middle = order_statistics(pts, {f"m{c}": (c, 0.5) for c in "xyz"})
    with_m = pts.join(F.broadcast(middle))
    off = with_m.select(*[F.abs(F.col(c) - F.col(f"m{c}")).alias(c) for c in "xyz"])
    spread = order_statistics(off, {f"d{c}": (c, 0.5) for c in "xyz"})
    far = F.lit(False)
    for c in "xyz":
        far = far | (F.abs(F.col(c) - F.col(f"m{c}")) > F.lit(factor) * F.greatest(F.col(f"d{c}"), F.lit(1e-9)))
    return with_m.join(F.broadcast(spread)).where(far).select("point_id", "x", "y", "z")


def swap_class(pts: DataFrame, old: int, new: int) -> DataFrame:
    return pts.withColumn("changed", F.col("class") == old).withColumn("class", F.when(F.col("class") == old, new).otherwise(F.col("class")))


def reclassify_polygon(pts: DataFrame, ring: list, new: int) -> DataFrame:
    inside = E.polygon_contains(F.col("x"), F.col("y"), ring)
    return pts.withColumn("changed", inside & (F.col("class") != new)).withColumn("class", F.when(inside, new).otherwise(F.col("class")))


def reclassify_ids(pts: DataFrame, ids: DataFrame, new: int) -> DataFrame:
    """ids(point_id): listed points get the class; only real changes count."""
    hit = ids.select(F.col("point_id").alias("hit")).distinct()
    joined = pts.join(hit, F.col("point_id") == F.col("hit"), "left")
    return joined.withColumn("changed", F.col("hit").isNotNull() & (F.col("class") != new)).withColumn("class", F.when(F.col("hit").isNotNull(), new).otherwise(F.col("class"))).drop("hit")


def percentile_range(pts: DataFrame, col: str, low: float = 5.0, high: float = 95.0) -> DataFrame:
    """Values at floor(p/100 * n) of the sorted column (no interpolation); equal ends give the full range."""
    rows = ranked(pts, [col])
    place = lambda p: F.least(F.floor(F.lit(p / 100.0) * F.col("n")), F.col("n") - 1)
    at = lambda p: F.max(F.when((F.col("place") <= place(p)) & (place(p) < F.col("place") + F.col("m")), F.col("v")))
    r = rows.agg(at(low).alias("lo"), at(high).alias("hi"), F.min("v").alias("least"), F.max("v").alias("most"))
    same = F.col("lo") >= F.col("hi")
    return r.select(F.when(same, F.col("least")).otherwise(F.col("lo")).alias("lo"), F.when(same, F.col("most")).otherwise(F.col("hi")).alias("hi"))


def octree_nodes(pts: DataFrame, low: tuple, span: float, depth: int) -> DataFrame:
    """key, depth, point_count of every node down to `depth`, from the keys of the leaves."""
    leaf = pts.groupBy(E.octant(F.col("x"), F.col("y"), F.col("z"), low, span, depth).alias("leaf")).agg(F.count("*").alias("n"))
    up = leaf.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(depth)), lambda d: F.substring(F.col("leaf"), F.lit(1), d))).alias("key"), "n")
    return up.groupBy("key").agg(F.sum("n").alias("point_count")).withColumn("depth", F.length("key"))
