"""Several layers together, and notes on them: merging, compatibility, elevation ranges, issues, clusters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as E
from ..functions import vectors as V
from ..shared import running
from ..sources.points import finite

#: Kinds of notes in their order, and severities from low to high.
KINDS, SEVERITIES = ("note", "info", "warning", "issue"), ("low", "medium", "high", "critical")


def merge(layers: list[DataFrame]) -> DataFrame:
    """All points of the layers, each with its layer's number; a column that a layer lacks is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [d.withColumn("layer", F.lit(i)) for i, d in enumerate(layers)])


def snapshot(chunks: list[DataFrame], only_if_all: tuple = ("r", "g", "b", "source_id")) -> DataFrame:
    """The chunks together; colour and source stay only if every chunk has them, other columns always."""
    keep = [c for c in only_if_all if not all(c in d.columns for d in chunks)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [d.drop(*keep) for d in chunks])


def placed(pts: DataFrame, shift: tuple[float, float, float], scale: float = 1.0) -> DataFrame:
    """Finite points under a layer's placement: scaled, then moved."""
    return finite(pts).withColumns({c: F.col(c) * scale + s for c, s in zip("xyz", shift, strict=True)})


def combined_range(ranges: DataFrame) -> DataFrame:
    """ranges(unit, low, high) -> mixed, reason, low, high, unit: one range for all, or why there is none."""
    known = F.col("unit").isNotNull() & (F.col("unit") != "unknown")
    bad = F.col("low").isNull() | F.col("high").isNull() | F.isnan("low") | F.isnan("high") | (F.abs("low") == float("inf")) | (F.abs("high") == float("inf"))
    s = ranges.agg(F.count("*").alias("n"), F.count_if(~F.coalesce(known, F.lit(False))).alias("nameless"), F.min("unit").alias("unit"), F.max("unit").alias("other"), F.count_if(bad).alias("bad"), F.count_if(F.col("low") > F.col("high")).alias("turned"), F.min("low").alias("low"), F.max("high").alias("high"))
    reason = F.when(F.col("n") == 0, "no-layers").when(F.col("nameless") > 0, "unknown-unit").when(F.col("unit") != F.col("other"), "units-differ").when(F.col("bad") > 0, "non-finite").when(F.col("turned") > 0, "inverted")
    s = s.withColumn("reason", reason)
    only = lambda c: F.when(F.col("reason").isNull(), F.col(c)).alias(c)
    return s.select(F.col("reason").isNotNull().alias("mixed"), "reason", only("low"), only("high"), only("unit"))


def compatibility(layers: DataFrame) -> DataFrame:
    """layers(id, horizontal, vertical) -> id, status: verified, horizontal-only, incompatible or unknown.

    The horizontal reference is the one that most layers declare (of equals the first in code units); layers of that
    reference are verified if all of them declare one vertical reference.  A single layer is verified.
    """
    n = layers.agg(F.count("*").alias("n"))
    most = layers.where("horizontal IS NOT NULL").groupBy("horizontal").agg(F.count("*").alias("k"), F.count("vertical").alias("kv"), F.min("vertical").alias("v0"), F.max("vertical").alias("v1"))
    best = most.agg(F.min_by(F.struct("horizontal", ((F.col("k") == F.col("kv")) & (F.col("v0") == F.col("v1"))).alias("agree")), F.struct((-F.col("k")).alias("k"), V.code_units(F.col("horizontal")).alias("u"))).alias("ref"))
    j = layers.join(F.broadcast(n)).join(F.broadcast(best))
    own = F.col("horizontal")
    status = F.when(F.col("n") == 1, "verified").when(own.isNull(), "unknown").when(own != F.col("ref.horizontal"), "incompatible").when(F.coalesce(F.col("ref.agree"), F.lit(False)), "verified").otherwise("horizontal-only")
    return j.select("id", status.alias("status"))


def placement(layers: DataFrame) -> DataFrame:
    """layers(id, epsg, project_epsg, vertical, project_vertical) -> plan (identity, reproject, needs-registration) and whether heights compare."""
    plan = F.when(F.col("epsg").isNull() | F.col("project_epsg").isNull(), "needs-registration").when(F.col("epsg") == F.col("project_epsg"), "identity").otherwise("reproject")
    return layers.select("id", plan.alias("plan"), F.coalesce(F.col("vertical") == F.col("project_vertical"), F.lit(False)).alias("heights"))


def kinds(notes: DataFrame) -> DataFrame:
    """kind, place, n of the kinds that occur, in their fixed order."""
    place = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    return notes.groupBy("kind").agg(F.count("*").alias("n")).select("kind", place.cast("int").alias("place"), "n").where("place > 0")


def clusters(notes: DataFrame, size: float) -> DataFrame:
    """i, j, k, n, x, y, z, dominant: notes of each cube, their centroid and commonest kind (of equals the first kind)."""
    at = [E.cell(F.col(c), max(size, 1e-6)).alias(n) for c, n in zip("xyz", "ijk", strict=True)]
    n = [F.count_if(F.col("kind") == k).alias(k) for k in KINDS]
    got = notes.groupBy(*at).agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in "xyz"], *n)
    top = F.greatest(*[F.col(k) for k in KINDS])
    dominant = F.lit(KINDS[-1])
    for k in reversed(KINDS[:-1]):
        dominant = F.when(F.col(k) == top, k).otherwise(dominant)
    return got.select("i", "j", "k", "n", "x", "y", "z", dominant.alias("dominant"))


def severity(c):
    return F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), c)


def issue_summary(notes: DataFrame) -> DataFrame:
    """total, open, resolved, the open ones of each severity, and the highest open severity."""
    issues = notes.where(F.col("kind") == "issue")
    still = F.col("status") != "resolved"
    s = issues.agg(F.count("*").alias("total"), F.count_if(still).alias("open"), F.count_if(~still).alias("resolved"), *[F.count_if(still & (F.col("severity") == x)).alias(x) for x in SEVERITIES], F.max(F.when(still, severity(F.col("severity")))).alias("top"))
    return s.select("total", "open", "resolved", *SEVERITIES, F.get(F.array(*[F.lit(x) for x in SEVERITIES]), F.col("top").cast("int") - 1).alias("highest"))


def issue_order(notes: DataFrame) -> DataFrame:
    """Issues with their place: severest first, then earliest, then by id; places come from a range sort."""
    issues = notes.where(F.col("kind") == "issue").withColumn("rank", -severity(F.col("severity")))
    w = Window.partitionBy("rank").orderBy("seen", V.code_units(F.col("id").cast("string")))
    return issues.select("id", "severity", F.row_number().over(w).cast("long").alias("place"))


def point_shade(pts: DataFrame, size: float, exaggeration: float = 1.0, azimuth: float = 315.0, altitude: float = 45.0) -> DataFrame:
    """point_id, shade (0 to 1): every point has its cell's Lambert shade from central differences of mean heights."""
    from .grid import near, neighbours, rasterise

    sx, sy, sz = V.sun(azimuth, altitude)
    cells = neighbours(rasterise(pts, size))
    mid = F.col(near(0, 0))
    z = lambda dr, dc: F.coalesce(F.col(near(dr, dc)), mid)
    gx, gy = (z(0, 1) - z(0, -1)) * exaggeration / (2 * size), (z(1, 0) - z(-1, 0)) * exaggeration / (2 * size)
    shade = F.greatest((-gx * sx - gy * sy + sz) / F.sqrt(gx * gx + gy * gy + 1), F.lit(0.0))
    at = pts.select("point_id", E.cell(F.col("y"), size).alias("row"), E.cell(F.col("x"), size).alias("col"))
    return at.join(cells.select("row", "col", shade.alias("shade")), ["row", "col"]).select("point_id", "shade")


def point_sizes(pts: DataFrame, size: float, reference: float, low: float = 0.5, high: float = 2.0) -> DataFrame:
    """point_id, scale: the root of the reference over the cell's density, within bounds."""
    at = pts.select("point_id", E.cell(F.col("y"), size).alias("row"), E.cell(F.col("x"), size).alias("col"))
    n = at.groupBy("row", "col").agg(F.count("*").alias("n"))
    scale = E.clamp(F.sqrt(F.lit(max(reference, 1e-9)) / (F.col("n") / (size * size))), low, high)
    return at.join(n, ["row", "col"]).select("point_id", scale.alias("scale"))


def accepted(pts: DataFrame, classes: list[int] | None = None, z: tuple | None = None, intensity: tuple | None = None) -> DataFrame:
    """Class mask, elevation and intensity window together; unlike a single filter, values that are no number pass a window."""
    keep = F.col("class").isin(classes) if classes is not None else F.lit(True)
    for c, window in (("z", z), ("intensity", intensity)):
        if window:
            v = F.col(c).cast("double")
            keep = keep & F.coalesce(F.isnan(v) | v.between(min(window), max(window)), F.lit(True))
    return pts.where(keep)


def class_scope(pts: DataFrame, visible: list[int]) -> DataFrame:
    """kind, codes, present: full when every class present is visible, else the visible part of them."""
    s = pts.select("class").distinct().agg(F.count("class").alias("present"), F.sort_array(F.collect_set(F.when(F.col("class").isin(visible), F.col("class")))).alias("codes"))  # class codes are a byte
    full = F.size("codes") == F.col("present")
    return s.select(F.when(full, "full").otherwise("subset").alias("kind"), F.concat_ws(",", F.transform("codes", lambda c: c.cast("string"))).alias("codes"), "present")


def downsample_to_budget(pts: DataFrame, budget: int, passes: int = 12) -> DataFrame:
    """Voxel centroids, no more than `budget` of them and, if that can be had in so many passes, no fewer than 0.6 of it.

    The voxel grows or shrinks by the root of how far the count is off; only counts come to the driver.
    """
    from .points import voxel_centroids

    if not budget >= 1:
        raise ValueError("the budget is one point at least")
    if pts.count() <= budget:
        return pts
    span = pts.agg(*[F.greatest(F.max(c) - F.min(c), F.lit(1e-6)).alias(c) for c in "xyz"]).first()
    size = (max(span["x"] * span["y"], span["y"] * span["z"], span["x"] * span["z"]) / (budget * 0.9)) ** 0.5
    held = lambda s: pts.select(*[E.cell(F.col(c), s).alias(c) for c in "xyz"]).distinct().count()
    n, used = held(size), 1
    while n > budget and used < passes:
        size *= min(max((n / budget) ** 0.5, 1.05), 3.0)
        n, used = held(size), used + 1
    while n < 0.6 * budget and used < passes:
        smaller = size * min(max((n / budget) ** 0.5, 0.5), 0.95)
        if (more := held(smaller)) > budget:
            break
        size, n, used = smaller, more, used + 1
    return voxel_centroids(pts, size)


def lapsed(nodes: DataFrame, resident: float, budget: float, keep: float = 1.0) -> DataFrame:
    """Nodes in eviction order (rank, depth and distance descending, then key) until what is resident is at its limit."""
    limit = max(budget, 0.0) * max(keep, 0.0)
    order = [F.col("rank").desc(), F.col("depth").desc(), F.col("distance").desc(), F.col("key")]
    if resident <= limit:
        return nodes.limit(0).select("key")
    return running(nodes, order, "point_count").where(F.lit(resident) - F.col("before") > limit).select("key")


def named(files: DataFrame) -> DataFrame:
    """files(id, name) -> unique names: of equal ones, in order of id, the second becomes `stem (2).ext` and so on."""
    i = F.row_number().over(Window.partitionBy("name").orderBy("id"))
    stem, ext = F.regexp_extract("name", r"^(.+?)(\.[^.]*)?$", 1), F.regexp_extract("name", r"^.+?(\.[^.]*)$", 1)
    rows = files.withColumn("i", i)
    return rows.select("id", F.when(F.col("i") == 1, F.col("name")).otherwise(F.concat(stem, F.lit(" ("), F.col("i").cast("string"), F.lit(")"), ext)).alias("name"))


def verify_chain(entries: DataFrame, genesis: str = "") -> DataFrame:
    """entries(chain, i, payload, hash) -> i of each chain's first entry whose hash is not that of the one before and its payload, or -1."""
    before = F.coalesce(F.lag("hash").over(Window.partitionBy("chain").orderBy("i")), F.lit(genesis))
    bad = entries.select("chain", "i", (F.sha2(F.concat_ws("|", before, "payload"), 256) != F.col("hash")).alias("bad"))
    return bad.groupBy("chain").agg(F.coalesce(F.min(F.when(F.col("bad"), F.col("i"))), F.lit(-1)).cast("long").alias("first_bad"))


def provenance(bits: DataFrame, by: str) -> DataFrame:
    """Union of the provenance bits (1 measured, 2 interpolated) of each group."""
    return bits.groupBy(by).agg(F.bit_or("bits").bitwiseAND(F.lit(3)).cast("int").alias("bits"))


def share_state(df: DataFrame, cols: list[str]) -> DataFrame:
    """The columns as base64 of their JSON."""
    return df.withColumn("state", F.base64(F.encode(F.to_json(F.struct(*cols)), "UTF-8")))


def class_edits(before: DataFrame, after: DataFrame) -> DataFrame:
    """point_id, old, new of the points whose class changed: what undoes and redoes an edit."""
    b = before.select(F.col("point_id").alias("of"), F.col("class").alias("old"))
    j = after.join(b, F.col("point_id") == F.col("of"))
    return j.where(~F.col("class").eqNullSafe(F.col("old"))).select("point_id", "old", F.col("class").alias("new"))


def undone(pts: DataFrame, edits: DataFrame) -> DataFrame:
    """pts with the old class wherever an edit changed it."""
    e = edits.select(F.col("point_id").alias("of"), "old", F.lit(True).alias("hit"))
    return pts.join(e, F.col("point_id") == F.col("of"), "left").withColumn("class", F.when(F.col("hit"), F.col("old")).otherwise(F.col("class"))).drop("of", "old", "hit")
