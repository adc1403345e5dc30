"""The registered queries: each operator applied to whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo
from ..operators import contours as C
from ..operators import grid as G
from ..operators import ground as R
from ..operators import measure as M
from ..operators import points as P
from ..operators import registration as T
from ..operators import spatial as S
from ..operators import validate as V
from ..sources import points as src
from ..streaming import nodes as N

SIZE = 10.0
RING = [(20.0, 100.0), (120.0, 150.0), (130.0, 500.0), (60.0, 620.0), (10.0, 400.0)]
CUBE = ((0.0, 0.0, 0.0), 1024.0, 5)


def _rounded(c, digits: int):
    """Rounds as the SQL does: the product with a power of ten, halves away from zero (Spark's own rounds the shortest decimal text)."""
    scaled = c * F.lit(10.0**digits)
    return F.when(F.abs(scaled) < float("inf"), F.round(scaled) / F.lit(10.0**digits)).otherwise(c)


def _round(df, digits: int = 6):
    """Doubles rounded, so that the order of a sum does not show."""
    how = {"double": lambda c: _rounded(F.col(c), digits), "float": lambda c: F.round(c, digits)}
    return df.select(*[how.get(t, F.col)(c).alias(c) for c, t in df.dtypes])


def pts(spark, sf):
    return src.event_points(spark, sf)


def _dtm(spark, sf, how="mean", p=0.5):
    return G.rasterise(pts(spark, sf), SIZE, how, p)


def _horn(spark, sf):
    return G.horn(_dtm(spark, sf), SIZE)


def _months(spark, sf):
    """Profile series: total price by month along the line of each order status."""
    o = src.table(spark, sf, "orders")
    month = (F.year("o_orderdate") * 12 + F.month("o_orderdate")).cast("double")
    return o.groupBy(F.col("o_orderstatus").alias("line"), month.alias("s")).agg(_rounded(F.sum("o_totalprice"), 2).alias("h"))


def _track(spark, sf):
    """Polylines: each customer's orders in time order as vertices."""
    o = src.table(spark, sf, "orders")
    return o.select(F.col("o_custkey").alias("line"), F.col("o_orderkey").alias("i"), (F.col("o_orderkey") % 97).cast("double").alias("x"), (F.col("o_orderkey") % 89).cast("double").alias("y"), (F.col("o_totalprice") / 1000.0).alias("z"))


def _errors(spark, sf):
    """Check points: lineitem discount against tax, by return flag."""
    li = src.table(spark, sf, "lineitem")
    return li.select(F.col("l_returnflag").alias("stratum"), (F.col("l_discount") - F.col("l_tax")).alias("error"))


def _nodes(spark, sf):
    n = P.octree_nodes(pts(spark, sf), *CUBE)
    screen = F.col("point_count") / (F.col("point_count") + 50.0)
    return n.withColumn("screen", screen)


def _epochs(spark, sf):
    p = pts(spark, sf)
    return G.rasterise(p.where("point_id % 2 = 0"), SIZE), G.rasterise(p.where("point_id % 2 = 1"), SIZE)


def _samples(spark, sf):
    p = pts(spark, sf)
    return p.select(F.least(F.col("intensity").cast("double"), F.lit(100.0)).alias("confidence"), (F.col("z") > 20).alias("hit")).where("confidence IS NOT NULL")


def _segments(spark, sf):
    return G.contour_segments(_dtm(spark, sf), SIZE, 10.0)


def _sparse(spark, sf):
    return _dtm(spark, sf).where("n >= 10")


def _places(spark, sf):
    """Latitudes and longitudes that the points stand for."""
    lat, lon = F.col("x") - 70.0, F.col("y") / 2.0 - 180.0
    return pts(spark, sf).select("point_id", lat.alias("lat"), lon.alias("lon"))


def _utm(spark, sf):
    zone, east, north = geo.utm_forward(F.col("lat"), F.col("lon"))
    return _places(spark, sf).where("lat BETWEEN -80 AND 84").select("point_id", zone.alias("zone"), east.alias("east"), north.alias("north"))


def _cell_metres(spark, sf):
    ew, ns = geo.cell_metres(F.lit(0.001), F.col("point_id") % 2 == 0, F.col("lat"))
    return _places(spark, sf).select("point_id", ew.alias("ew"), ns.alias("ns"))


def _colours(spark, sf):
    byte = (F.col("point_id") % 256).cast("double")
    return pts(spark, sf).select("point_id", geo.srgb_to_linear(byte).alias("linear"), geo.linear_to_srgb(geo.srgb_to_linear(byte)).alias("back"))


def _chain(spark, sf):
    c = src.table(spark, sf, "conversations").select("conv_id", "turn", F.concat_ws(":", "role", "text").alias("t"))
    return c.groupBy("conv_id").agg(geo.hash_chain(F.transform(F.sort_array(F.collect_list(F.struct("turn", "t"))), lambda x: x["t"])).alias("hash"))


QUERIES = {
    # points
    "range_filter": lambda s, d: P.range_filter(pts(s, d), "z", 30.0, 10.0).select("point_id", "z"),
    "clip_inside": lambda s, d: P.clip_box(pts(s, d), (10, 24, 5), (60, 240, 25)).select("point_id"),
    "clip_outside": lambda s, d: P.clip_box(pts(s, d), (10, 24, 5), (60, 240, 25), False).select("point_id"),
    "class_mask": lambda s, d: P.class_mask(pts(s, d), [2, 6]).select("point_id", "class"),
    "class_hist": lambda s, d: P.class_histogram(pts(s, d)),
    "class_coverage": lambda s, d: P.class_coverage(pts(s, d)),
    "bounds": lambda s, d: _round(P.bounds(pts(s, d))),
    "recentre": lambda s, d: _round(P.recentred(pts(s, d)).select("point_id", *[F.col(c).cast("double").alias(c) for c in "xyz"]), 3),
    "hist": lambda s, d: P.equal_width_histogram(pts(s, d), "z", 32),
    "voxel_centroid": lambda s, d: _round(P.voxel_centroids(pts(s, d), 20.0)),
    "voxel_size": lambda s, d: _round(P.voxel_size_for(pts(s, d), 1000)),
    "stride_sample": lambda s, d: P.stride_sample(pts(s, d), 16).select("point_id"),
    "density": lambda s, d: _round(P.density(pts(s, d), SIZE)),
    "density_p95": lambda s, d: _round(P.density_stats(pts(s, d), SIZE)),
    "health_dups": lambda s, d: P.duplicates(pts(s, d).select("x", F.floor("y").alias("y"), F.floor("z").alias("z"))),
    "health_outliers": lambda s, d: P.stray_outliers(pts(s, d)).select("point_id"),
    "class_swap": lambda s, d: P.swap_class(pts(s, d), 3, 5).select("point_id", "class", "changed"),
    "class_polygon": lambda s, d: P.reclassify_polygon(pts(s, d), RING, 6).select("point_id", "class", "changed"),
    "class_ids": lambda s, d: P.reclassify_ids(pts(s, d), src.table(s, d, "labels").where("toxic = 1").select(F.col("doc_id").alias("point_id")), 6).select("point_id", "class", "changed"),
    "percentile_range": lambda s, d: P.percentile_range(pts(s, d), "z"),
    "octree_nodes": lambda s, d: P.octree_nodes(pts(s, d), *CUBE),
    # grids
    **{f"dtm_{how}": (lambda s, d, how=how: _round(_dtm(s, d, how, 0.95))) for how in ("mean", "min", "max", "median", "percentile", "robust")},
    "surface_stats": lambda s, d: _round(G.surface_stats(_dtm(s, d))),
    "ndsm": lambda s, d: _round(G.height_above(_dtm(s, d, "max"), _dtm(s, d, "min"))),
    "canopy_stats": lambda s, d: _round(G.canopy_stats(G.height_above(_dtm(s, d, "max"), _dtm(s, d, "min")))),
    "terrain_slope": lambda s, d: _round(_horn(s, d)),
    "slope_stats": lambda s, d: _round(G.slope_stats(_horn(s, d))),
    "hillshade": lambda s, d: G.hillshade(_horn(s, d)),
    "multi_hillshade": lambda s, d: G.multi_hillshade(_horn(s, d)),
    "tpi": lambda s, d: _round(G.tpi(_dtm(s, d), 2, _horn(s, d))),
    "vrm": lambda s, d: _round(G.vrm(_horn(s, d))),
    "morph_open": lambda s, d: _round(G.opened(_dtm(s, d, "min"), 2)),
    "despike": lambda s, d: _round(G.spikes(_dtm(s, d), 2.0)),
    "cell_confidence": lambda s, d: G.cell_confidence(_dtm(s, d)),
    "edge_distance": lambda s, d: G.edge_distance(_dtm(s, d).where("n >= 12"), 3),
    "contours": lambda s, d: _round(G.contour_segments(_dtm(s, d), SIZE, 10.0)),
    "change_cells": lambda s, d: _round(G.change(*_epochs(s, d), 1.0)),
    "change_stats": lambda s, d: _round(G.change_stats(G.change(*_epochs(s, d), 1.0), SIZE * SIZE)),
    "grid_agreement": lambda s, d: _round(G.agreement(*_epochs(s, d), 2.0)),
    "nearest_fill": lambda s, d: _round(R.nearest_fill(_sparse(s, d), 4)),
    "idw_fill": lambda s, d: _round(R.idw_fill(_sparse(s, d), 4)),
    "steepness": lambda s, d: _round(R.steepness(_dtm(s, d), SIZE)),
    "smrf_ground": lambda s, d: R.ground(pts(s, d), SIZE).select("point_id", "is_ground"),
    "holdout": lambda s, d: _round(R.holdout(pts(s, d), SIZE)),
    "cell_status": lambda s, d: R.status(_sparse(s, d), G.cell_confidence(_sparse(s, d))),
    "interval_gate": lambda s, d: C.interval_gate(_dtm(s, d), 0.4),
    "style_levels": lambda s, d: C.styled(_segments(s, d), 10.0),
    "grade_tally": lambda s, d: _round(C.grade_tally(C.graded(_segments(s, d), G.cell_confidence(_dtm(s, d)), SIZE)), 4),
    "polylines": lambda s, d: C.polylines(_segments(s, d)).select("level", "closed", F.size("xs").cast("long").alias("vertices")),
    "smooth_lines": lambda s, d: C.smoothed(C.polylines(_segments(s, d))).select("level", "closed", F.size("xs").cast("long").alias("vertices")),
    "label_places": lambda s, d: _round(C.label_places(C.polylines(_segments(s, d)), 40.0).select("level", "chainage")),
    # functions
    "class_names": lambda s, d: P.class_histogram(pts(s, d)).select("class", geo.class_name(F.col("class")).alias("name"), "n"),
    "utm_forward": lambda s, d: _round(_utm(s, d), 3),
    "cell_metres": lambda s, d: _round(_cell_metres(s, d)),
    "srgb": lambda s, d: _round(_colours(s, d)),
    "fnv1a": lambda s, d: src.table(s, d, "events").select("event_id", geo.fnv1a(F.col("props")).alias("hash")),
    "hash_chain": lambda s, d: _chain(s, d),
    "version_order": lambda s, d: src.table(s, d, "events").select("event_id", geo.version_order(F.concat_ws(".", (F.col("event_id") % 3).cast("string"), (F.col("event_id") % 11).cast("string")), F.concat_ws(".", (F.col("event_id") % 2).cast("string"), (F.col("user_id") % 12).cast("string"), F.lit("0"))).alias("sign")),
    # measurements
    "cut_fill": lambda s, d: _round(M.cut_fill(pts(s, d), RING, 15.0), 3),
    "stockpile": lambda s, d: _round(M.stockpile(pts(s, d), RING), 3),
    "profile": lambda s, d: _round(M.profile(pts(s, d), (0.0, 0.0), (149.0, 720.0), 8.0, 64)),
    "grades": lambda s, d: _round(M.grades(_months(s, d))),
    "profile_summary": lambda s, d: _round(M.profile_summary(_months(s, d)), 4),
    "polyline_length": lambda s, d: _round(M.cumulative_length(_track(s, d))),
    "stations": lambda s, d: _round(M.stations(_months(s, d).groupBy("line").agg((F.max("s") - F.min("s")).alias("length")), 7.0)),
    "bearings": lambda s, d: _round(M.bearings(_track(s, d))),
    "chains": lambda s, d: _round(M.chain(src.table(s, d, "lineitem").select(F.col("l_returnflag").alias("kind"), F.col("l_quantity").alias("value")))),
    # joins
    "radius_count": lambda s, d: S.radius_counts(src.vector_points(s, d), src.vector_points(s, d), 0.1),
    "nearest": lambda s, d: _round(S.nearest(pts(s, d).where("class = 2"), pts(s, d).where("class = 6"), 3.0)),
    "descriptors": lambda s, d: _round(T.descriptors(src.vector_points(s, d), 0.15), 4),
    "convex_hull": lambda s, d: _round(T.convex_hull(pts(s, d)).select("x", "y")),
    "footprints": lambda s, d: _round(S.footprints(pts(s, d), SIZE, 12, 150.0)),
    # validation
    "confusion": lambda s, d: _round(V.confusion(src.table(s, d, "labels").select(F.col("quality").alias("truth"), F.col("toxic").alias("predicted")))),
    "checkpoints": lambda s, d: _round(V.checkpoints(_errors(s, d))),
    "checkpoint_rollup": lambda s, d: _round(V.strata_rollup(_errors(s, d))),
    "wilson": lambda s, d: _round(V.within_tolerance(_errors(s, d), 0.03)),
    "reliability": lambda s, d: _round(V.reliability(_samples(s, d), 10)),
    "isotonic": lambda s, d: _round(V.isotonic(V.reliability(_samples(s, d), 10))),
    "jackknife": lambda s, d: _round(V.jackknife_error(src.table(s, d, "lineitem").select((F.col("l_suppkey") % 17).alias("site"), F.col("l_quantity").alias("value"))), 4),
    # node streams
    "node_scores": lambda s, d: N.node_scores(_nodes(s, d), 4).select("key", "score"),
    "budget_prefix": lambda s, d: N.within_budget(N.node_scores(_nodes(s, d), 4), 20000).select("key", "total"),
    "sampling_plan": lambda s, d: N.sampling_plan(_nodes(s, d), 15000).select("key", "total"),
    "eviction_plan": lambda s, d: N.eviction_plan(_nodes(s, d).select("key", (F.col("depth") % 3).alias("rank"), "depth", F.col("screen").alias("distance"), "point_count"), 20000, 0.9).select("key"),
    "frontier": lambda s, d: N.frontier(_nodes(s, d)).select("key", "point_count"),
    "tumbling": lambda s, d: _round(N.tumbling(src.table(s, d, "events"), "6 hours"), 4),
    "sliding": lambda s, d: _round(N.sliding(src.table(s, d, "events"), "6 hours", "2 hours")),
    "sessions": lambda s, d: _round(N.sessions(src.table(s, d, "events"), "3 hours"), 4),
}
