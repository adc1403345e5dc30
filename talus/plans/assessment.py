"""Queries over facts, layers, notes, vertices and names, each with the SQL that states it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import assess as A
from ..operators import grid as G
from ..operators import layers as L
from ..operators import points as P
from ..operators import validate as C
from ..sources import points as src
from ..sources import sinks as K
from .oracle import _EPOCHS, _DIFF, _NODES, _TRACK, KEYED, MEAN, PTS, _q
from .queries import SIZE, _dtm, _epochs, _nodes, _round, _track, pts

_STEPS = "d AS (SELECT *, lag(x) OVER w AS ax, lag(y) OVER w AS ay, lag(z) OVER w AS az, lead(x) OVER w AS cx, lead(y) OVER w AS cy, lead(z) OVER w AS cz FROM t WINDOW w AS (PARTITION BY line ORDER BY i))"


def _steps(s, d):
    from pyspark.sql import Window

    w = Window.partitionBy("line").orderBy("i")
    return _track(s, d).withColumns({f"a{c}": F.lag(c).over(w) for c in "xyz"} | {f"c{c}": F.lead(c).over(w) for c in "xyz"})


def _vec(prefix=""):
    return tuple(F.col(f"{prefix}{c}") for c in "xyz")


def _rings(s, d):
    return _track(s, d).groupBy("line").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x", "y", "z"))), lambda v: F.struct(v["x"].alias("x"), v["y"].alias("y"), v["z"].alias("z"))).alias("ring"))


def _lines(s, d):
    v = _track(s, d).groupBy(F.col("line").alias("level")).agg(F.sort_array(F.collect_list(F.struct("i", "x", "y"))).alias("v"))
    return v.select("level", F.lit(False).alias("closed"), F.col("v.x").alias("xs"), F.col("v.y").alias("ys"))


_RING = [_TRACK, "v AS (SELECT *, row_number() OVER (PARTITION BY line ORDER BY i) - 1 AS k, count(*) OVER (PARTITION BY line) AS n FROM t)", "e AS (SELECT a.line, a.k, a.n, a.x AS ax, a.y AS ay, a.z AS az, b.x AS bx, b.y AS by_, b.z AS bz FROM v a JOIN v b ON b.line = a.line AND b.k = (a.k + 1) % a.n)"]


def _facts(s, d):
    n = lambda cond: F.count_if(cond).alias
    z = F.col("z")
    f = pts(s, d).groupBy("class").agg(
        F.avg((z > 20).cast("double")).alias("measured"), F.avg(F.least(F.coalesce("intensity", F.lit(0)), F.lit(100))).alias("confidence"), F.stddev_pop("z").alias("sd"), (F.count("*") / 1000).alias("density"),
        F.avg((z < 5).cast("double")).alias("edge"), F.avg((z > 10).cast("double")).alias("above"), n(z > 20)("n_measured"), n((z > 10) & (z <= 20))("n_interpolated"), n((z >= 5) & (z <= 10))("n_low"), n((z >= 2) & (z < 5))("n_edge"), n(z < 2)("n_empty"),
    )
    k = F.col("class")
    return f.select("class", "measured", "confidence", F.when(k != 6, F.col("sd") / 100).alias("rmse"), "density", F.lit(1.0).alias("cell"), "edge", F.when(k % 2 == 0, F.col("above")).alias("ground"), *[f"n_{x}" for x in ("measured", "interpolated", "low", "edge", "empty")], F.when(k != 3, 1.0).alias("interval"), F.when(k > 2, "crs").alias("crs"), F.when(k > 4, "datum").alias("datum"))


_FACTS = [PTS, """f AS (SELECT class, avg((z > 20)::INT) AS measured, avg(least(coalesce(intensity, 0), 100)) AS confidence, CASE WHEN class <> 6 THEN stddev_pop(z) / 100 END AS rmse, count(*) / 1000.0::DOUBLE AS density, avg((z < 5)::INT) AS edge,
    CASE WHEN class % 2 = 0 THEN avg((z > 10)::INT) END AS ground, count(*) FILTER (z > 20) AS nm, count(*) FILTER (z > 10 AND z <= 20) AS ni, count(*) FILTER (z >= 5 AND z <= 10) AS nl, count(*) FILTER (z >= 2 AND z < 5) AS ne, count(*) FILTER (z < 2) AS nz, count(*) AS n FROM pts GROUP BY class)"""]


def _notes(s, d):
    kind = F.when(F.col("class") == 2, "note").when(F.col("class") == 4, "info").when(F.col("class") == 3, "warning").when(F.col("class").isin(5, 6), "issue")
    sev = F.when(F.col("z") < 10, "low").when(F.col("z") < 20, "medium").when(F.col("z") < 50, "high").otherwise("critical")
    return pts(s, d).select(F.col("point_id").alias("id"), "x", "y", "z", kind.alias("kind"), sev.alias("severity"), F.when(F.col("point_id") % 3 == 0, "resolved").otherwise("open").alias("status"), F.col("y").alias("seen"))


_NOTES = [PTS, "o AS (SELECT point_id AS id, x, y, z, CASE WHEN class = 2 THEN 'note' WHEN class = 4 THEN 'info' WHEN class = 3 THEN 'warning' WHEN class IN (5, 6) THEN 'issue' END AS kind, CASE WHEN z < 10 THEN 'low' WHEN z < 20 THEN 'medium' WHEN z < 50 THEN 'high' ELSE 'critical' END AS severity, CASE WHEN point_id % 3 = 0 THEN 'resolved' ELSE 'open' END AS status, y AS seen FROM pts)"]
_RANK = "CASE severity WHEN 'low' THEN 1 WHEN 'medium' THEN 2 WHEN 'high' THEN 3 ELSE 4 END"


def _pairs(s, d):
    guess = F.when(F.col("z") < 3, 1).when(F.col("z") < 15, 2).when(F.col("z") < 40, F.col("class")).otherwise(6)
    return pts(s, d).select((F.col("x").cast("long") % 5).alias("scene"), F.when(F.col("point_id") % 11 == 0, 7).otherwise(F.col("class")).alias("truth"), guess.alias("predicted"))


_PAIRS = [PTS, "p AS (SELECT CAST(x AS BIGINT) % 5 AS scene, CASE WHEN point_id % 11 = 0 THEN 7 ELSE class END AS truth, CASE WHEN z < 3 THEN 1 WHEN z < 15 THEN 2 WHEN z < 40 THEN class ELSE 6 END AS predicted FROM pts)"]
_SCORES = [*_PAIRS, "g AS (SELECT scene, code, count(*) FILTER (truth = code) AS support, count(*) FILTER (predicted = code) AS predicted, count(*) FILTER (truth = code AND predicted = code) AS tp FROM p, (SELECT unnest([2, 3, 4, 5, 6]) AS code) GROUP BY GROUPING SETS ((scene, code), (code)))", "r AS (SELECT *, predicted - tp AS fp, support - tp AS fn, CASE WHEN predicted > 0 THEN tp / predicted END AS precision, CASE WHEN support > 0 THEN tp / support END AS recall FROM g)", "s AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) WHEN precision + recall = 0 THEN 0 END AS f1 FROM r)"]


def _layers(s, d):
    n = src.table(s, d, "nation")
    return n.select(F.col("n_nationkey").alias("id"), F.when(F.col("n_nationkey") % 7 != 0, F.concat(F.lit("EPSG:"), (F.col("n_regionkey") % 3).cast("string"))).alias("horizontal"), F.when(F.col("n_nationkey") % 5 != 4, F.when(F.col("n_regionkey") % 3 == 1, "V1").otherwise("V2")).alias("vertical"))


_LAYERS = ["y AS (SELECT n_nationkey AS id, CASE WHEN n_nationkey % 7 <> 0 THEN 'EPSG:' || CAST(n_regionkey % 3 AS VARCHAR) END AS h, CASE WHEN n_nationkey % 5 <> 4 THEN CASE WHEN n_regionkey % 3 = 1 THEN 'V1' ELSE 'V2' END END AS v FROM nation)"]


def _epsg(s, d):
    base = F.element_at(F.array(*[F.lit(x) for x in (3990, 7840, 25820, 26690, 26895, 28340, 32595, 32695)]), (F.col("event_id") % 8).cast("int") + 1)
    return src.table(s, d, "events").select("event_id", (base + F.floor(F.col("event_id") / 8) % 80).cast("int").alias("epsg"))


def _edits(s, d):
    p = pts(s, d)
    return L.class_edits(p, P.swap_class(p, 3, 5))


def _entries(s, d):
    e = src.table(s, d, "conversations").select("conv_id", "turn", F.concat_ws(":", "role", "text").alias("payload"))
    rows = e.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "payload"))).alias("a"))
    hashes = F.aggregate("a", F.array(F.lit("")), lambda h, x: F.concat(h, F.array(F.sha2(F.concat_ws("|", F.element_at(h, -1), x["payload"]), 256))))
    rows = rows.withColumn("h", hashes).select(F.col("conv_id").alias("chain"), F.posexplode("a").alias("i", "x"), "h")
    broken = (F.col("chain") % 4 == 0) & (F.col("i") == F.col("chain") % 3)
    return rows.select("chain", "i", F.when(broken, F.lit("other")).otherwise(F.col("x.payload")).alias("payload"), F.get("h", F.col("i") + 1).alias("hash"))


def _names(s, d):
    return src.table(s, d, "events").select(F.col("event_id").alias("id"), F.concat(F.col("event_type"), F.lit("."), (F.col("user_id") % 3).cast("string")).alias("name"))


def _raw_names(s, d):
    e = src.table(s, d, "events")
    return e.select("event_id", V.file_name(F.concat(F.lit(" ."), F.col("event_type"), F.lit(": a  b--c?"), (F.col("user_id") % 7).cast("string"), F.lit("..x.PDF")), "map").alias("name"), V.file_name(F.lit(' ?*.pdf'), "map").alias("empty"))


_PAIR = {
    # vertices, boxes, rings, colours
    "angles": (lambda s, d: _round(_steps(s, d).where("ax IS NOT NULL AND cx IS NOT NULL").select("line", "i", V.angle(_vec("a"), _vec(), _vec("c")).alias("angle")), 4),
        _q([_TRACK, _STEPS, "u AS (SELECT line, i, ax - x AS px, ay - y AS py, az - z AS pz, cx - x AS qx, cy - y AS qy, cz - z AS qz FROM d WHERE ax IS NOT NULL AND cx IS NOT NULL)", "w AS (SELECT *, sqrt(px * px + py * py + pz * pz) * sqrt(qx * qx + qy * qy + qz * qz) AS size FROM u)"], "SELECT line, i, round(CASE WHEN size > 0 THEN degrees(acos(greatest(least((px * qx + py * qy + pz * qz) / size, 1), -1))) ELSE 0 END, 4) AS angle FROM w")),
    "slopes": (lambda s, d: _round(_steps(s, d).where("cx IS NOT NULL").select("line", "i", *[c.alias(n) for n, c in V.slope(_vec(), _vec("c")).items()])),
        _q([_TRACK, _STEPS, "u AS (SELECT line, i, cz - z AS rise, sqrt((cx - x) ** 2 + (cy - y) ** 2) AS run FROM d WHERE cx IS NOT NULL)"], "SELECT line, i, round(rise, 6) AS rise, round(run, 6) AS run, round(CASE WHEN run > 0 THEN rise / run * 100 WHEN rise > 0 THEN 'inf'::DOUBLE WHEN rise < 0 THEN '-inf'::DOUBLE ELSE 0 END, 6) AS grade, round(degrees(atan2(rise, run)), 6) AS degrees FROM u")),
    "profiles": (lambda s, d: _round(_steps(s, d).where("cx IS NOT NULL").select("line", "i", *[c.alias(n) for n, c in V.profile(_vec(), _vec("c")).items() if n != "grade"])),
        _q([_TRACK, _STEPS], "SELECT line, i, round(sqrt((cx - x) ** 2 + (cy - y) ** 2 + (cz - z) ** 2), 6) AS length, round(sqrt((cx - x) ** 2 + (cy - y) ** 2), 6) AS horizontal, round(z - cz, 6) AS drop FROM d WHERE cx IS NOT NULL")),
    "boxes": (lambda s, d: _round(_steps(s, d).where("cx IS NOT NULL").select("line", "i", *[c.alias(n) for n, c in V.box(_vec(), _vec("c")).items()])),
        _q([_TRACK, _STEPS], "SELECT line, i, " + ", ".join(f"round({f}({c}, c{c}), 6) AS {n}_{c}" for n, f in (("min", "least"), ("max", "greatest")) for c in "xyz") + ", round(abs(cx - x), 6) AS width, round(abs(cy - y), 6) AS depth, round(abs(cz - z), 6) AS height, round(abs(cx - x) * abs(cy - y) * abs(cz - z), 6) AS volume FROM d WHERE cx IS NOT NULL")),
    "box_count": (lambda s, d: P.clip_box(pts(s, d), (10, 24, 5), (60, 240, 25)).agg(F.count("*").alias("n")), _q([PTS], "SELECT count(*) AS n FROM pts WHERE x BETWEEN 10 AND 60 AND y BETWEEN 24 AND 240 AND z BETWEEN 5 AND 25")),
    "ring_areas": (lambda s, d: _round(_rings(s, d).select("line", V.ring_area(F.col("ring")).alias("area")), 3),
        _q([*_RING, "m AS (SELECT line, any_value(n) AS n, sum((ay - by_) * (az + bz)) AS nx, sum((az - bz) * (ax + bx)) AS ny, sum((ax - bx) * (ay + by_)) AS nz FROM e GROUP BY line)"], "SELECT line, round(CASE WHEN n > 2 THEN sqrt(nx * nx + ny * ny + nz * nz) / 2 ELSE 0 END, 3) AS area FROM m")),
    "ring_validity": (lambda s, d: _rings(s, d).select("line", V.ring_validity(F.col("ring")).alias("validity")),
        _q([*_RING, "c AS (SELECT DISTINCT a.line FROM (SELECT *, bx - ax AS ux, by_ - ay AS uy FROM e) a JOIN (SELECT *, bx - ax AS vx, by_ - ay AS vy FROM e) b ON b.line = a.line AND b.k > a.k + 1 AND NOT (a.k = 0 AND b.k = a.n - 1) WHERE a.n > 3 AND abs(ux * vy - uy * vx) >= 1e-12 AND ((b.ax - a.ax) * vy - (b.ay - a.ay) * vx) / (ux * vy - uy * vx) > 1e-9 AND ((b.ax - a.ax) * vy - (b.ay - a.ay) * vx) / (ux * vy - uy * vx) < 1 - 1e-9 AND ((b.ax - a.ax) * uy - (b.ay - a.ay) * ux) / (ux * vy - uy * vx) > 1e-9 AND ((b.ax - a.ax) * uy - (b.ay - a.ay) * ux) / (ux * vy - uy * vx) < 1 - 1e-9)", "m AS (SELECT line, any_value(n) AS n, abs(sum(ax * by_ - bx * ay)) / 2 AS area, max(ax) - min(ax) AS w, max(ay) - min(ay) AS h FROM e GROUP BY line)"],
            "SELECT m.line, CASE WHEN n < 3 THEN 'too-few-vertices' WHEN c.line IS NOT NULL THEN 'self-intersecting' WHEN area < 1e-9 THEN 'zero-area' WHEN w <= 0 OR h <= 0 THEN 'degenerate-bbox' ELSE 'ok' END AS validity FROM m LEFT JOIN c USING (line)")),
    **{name: ((lambda s, d, stops=stops: pts(s, d).select("point_id", *[c.alias(n) for n, c in zip("rgb", V.by_scalar(F.col("z"), F.lit(5.0), F.lit(45.0), stops), strict=True)])),
        _q([PTS, "t AS (SELECT point_id, greatest(least((z - 5) / 40, 1), 0) AS t FROM pts)"], "SELECT point_id, " + ", ".join("CAST(CASE " + " ".join(f"WHEN t <= {b[0]}::DOUBLE THEN floor({a[i]} + {b[i] - a[i]} * (t - {a[0]}::DOUBLE) / ({b[0]}::DOUBLE - {a[0]}::DOUBLE) + 0.5)" for a, b in zip(stops, stops[1:])) + f" END AS INTEGER) AS {n}" for i, n in ((1, "r"), (2, "g"), (3, "b"))) + " FROM t")) for name, stops in (("hypsometric", V.TERRAIN), ("colour_ramp", V.CLASSIC))},
    "float32_spacing": (lambda s, d: pts(s, d).select("point_id", (V.float32_spacing(F.col("z")) * 2.0**40).alias("spacing")), _q([PTS, "m AS (SELECT point_id, abs(CAST(CAST(z AS FLOAT) AS DOUBLE)) AS m FROM pts)"], "SELECT point_id, CASE WHEN m = 0 THEN 2.0::DOUBLE ** -109 ELSE 2.0::DOUBLE ** (greatest(floor(log2(m)), -126) + 17) END AS spacing FROM m")),
    "up_axis": (lambda s, d: _round(pts(s, d).select("point_id", *[c.alias(n) for n, c in zip("xyz", V.up_to_z(*_vec()), strict=True)])), _q([PTS], "SELECT point_id, round(x, 6) AS x, round(-z, 6) AS y, round(y, 6) AS z FROM pts")),
    "to_metres": (lambda s, d: _round(pts(s, d).select("point_id", V.to_metres(F.col("z"), F.when(F.col("class") == 2, "metre").when(F.col("class") == 3, "foot").when(F.col("class") == 4, "us-survey-foot")).alias("m"))), _q([PTS], "SELECT point_id, round(CASE class WHEN 2 THEN z WHEN 3 THEN z * 0.3048::DOUBLE WHEN 4 THEN z * (1200.0::DOUBLE / 3937) END, 6) AS m FROM pts")),
    "voxel_keys": (lambda s, d: pts(s, d).select("point_id", F.lit(5).alias("q"), *[F.floor(F.col(c) / 32).cast("int").alias(f"k{c}") for c in "xyz"]).select("point_id", V.key_id(F.col("q"), F.col("kx"), F.col("ky"), F.col("kz")).alias("key"), V.key_parent(F.col("q"), F.col("kx"), F.col("ky"), F.col("kz")).alias("parent")).select("*", V.key_parts(F.col("key"))["y"].alias("y")),
        _q([PTS, "k AS (SELECT point_id, CAST(floor(x / 32) AS INTEGER) AS kx, CAST(floor(y / 32) AS INTEGER) AS ky, CAST(floor(z / 32) AS INTEGER) AS kz FROM pts)"], "SELECT point_id, concat_ws('-', 5, kx, ky, kz) AS key, concat_ws('-', 4, kx >> 1, ky >> 1, kz >> 1) AS parent, CASE WHEN least(kx, ky, kz) >= 0 AND greatest(kx, ky, kz) < 32 THEN ky END AS y FROM k")),
    "code_units": (lambda s, d: src.table(s, d, "nation").select("n_name", F.hex(V.code_units(F.col("n_name"))).alias("units")), "SELECT n_name, regexp_replace(hex(n_name), '(..)', '00\\1', 'g') AS units FROM nation"),
    "fnv1a_units": (lambda s, d: src.table(s, d, "events").select("event_id", V.fnv1a_units(F.col("props")).alias("hash")), "SELECT event_id, lpad(lower(hex(list_reduce(list_prepend(CAST(2166136261 AS BIGINT), list_transform(string_split(props, ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda a, c: (xor(a, c) * 16777619) % 4294967296))), 8, '0') AS hash FROM events"),
    "file_names": (_raw_names, "SELECT event_id, event_type || '-a-b-c' || CAST(user_id % 7 AS VARCHAR) || '.x' AS name, 'map' AS empty FROM events"),
    "epsg_facts": (lambda s, d: _epsg(s, d).select("event_id", V.utm_zone_of(F.col("epsg")).alias("zone"), V.is_geographic(F.col("epsg")).alias("geographic"), V.datum_of(F.col("epsg")).alias("datum")),
        _q(["e AS (SELECT event_id, [3990, 7840, 25820, 26690, 26895, 28340, 32595, 32695][event_id % 8 + 1] + CAST(floor(event_id / 8) AS BIGINT) % 80 AS c FROM events)"], "SELECT event_id, CAST(CASE WHEN c BETWEEN 32601 AND 32660 THEN c - 32600 WHEN c BETWEEN 32701 AND 32760 THEN 32700 - c WHEN c BETWEEN 26901 AND 26923 THEN c - 26900 WHEN c BETWEEN 26701 AND 26722 THEN c - 26700 WHEN c BETWEEN 25828 AND 25838 THEN c - 25800 WHEN c BETWEEN 28348 AND 28358 THEN 28300 - c WHEN c BETWEEN 7846 AND 7859 THEN 7800 - c END AS INTEGER) AS zone, c IN (7844, 6668) OR (c BETWEEN 4001 AND 4999 AND c <> 4978) AS geographic, CASE WHEN c = 7844 OR c BETWEEN 7846 AND 7859 THEN 'GDA2020' WHEN c BETWEEN 32601 AND 32660 OR c BETWEEN 32701 AND 32760 THEN 'WGS84' WHEN c BETWEEN 26901 AND 26923 THEN 'NAD83' WHEN c BETWEEN 26701 AND 26722 THEN 'NAD27' WHEN c BETWEEN 25828 AND 25838 THEN 'ETRS89' WHEN c BETWEEN 28348 AND 28358 THEN 'GDA94' END AS datum FROM e")),
    # judgements
    "quality_score": (lambda s, d: A.quality_score(_facts(s, d)).select("class", "score", "band"),
        _q([*_FACTS, "q AS (SELECT class, CAST(floor(100 * (0.25 * measured + 0.25 * least(greatest(confidence / 100, 0), 1) + 0.2 * coalesce(0.15 / (0.15 + rmse), 0.5) + 0.15 * (density / (density + 3)) + 0.1 * (1 - edge) + 0.05 * coalesce(ground, 0.5)) + 0.5) AS INTEGER) AS score FROM f)"], "SELECT class, score, CASE WHEN score >= 80 THEN 'excellent' WHEN score >= 60 THEN 'good' WHEN score >= 40 THEN 'fair' ELSE 'poor' END AS band FROM q")),
    "quality_gate": (lambda s, d: A.quality_gate(_facts(s, d)).select("class", "readiness", "reasons", "export"),
        _q([*_FACTS, "g AS (SELECT *, nm + ni + nl + ne AS cov FROM f)", "h AS (SELECT *, CASE WHEN cov = 0 THEN 'no-surface' WHEN nm / cov < 0.15 THEN 'too-little-measured' WHEN class = 3 THEN 'no-interval' END AS stop, concat_ws(',', CASE WHEN nm / cov < 0.6 THEN 'interpolated' END, CASE WHEN nz / n > 0.4 THEN 'empty' END, CASE WHEN ne / n > 0.15 THEN 'edge' END, CASE WHEN rmse IS NULL THEN 'rmse' END, CASE WHEN confidence < 55 THEN 'confidence' END) AS why FROM g)"],
            "SELECT class, CASE WHEN stop IS NOT NULL THEN 'blocked' WHEN why <> '' THEN 'previewOnly' ELSE 'ready' END AS readiness, coalesce(stop, why) AS reasons, CASE WHEN stop IS NOT NULL THEN 'blocked' WHEN why = '' AND class > 4 THEN 'available' ELSE 'previewOnly' END AS export FROM h")),
    "accuracy_level": (lambda s, d: _round(A.accuracy_level(_facts(s, d).withColumn("rmse", F.col("rmse") / 4)).select("class", "nva", "level")),
        _q([*_FACTS, "q AS (SELECT class, rmse / 4 AS e, density AS d FROM f)"], "SELECT class, round(1.96::DOUBLE * e, 6) AS nva, CASE WHEN e IS NULL THEN 'unknown' WHEN d >= 8 AND e <= 0.05 THEN 'QL0' WHEN d >= 8 AND e <= 0.1 THEN 'QL1' WHEN d >= 2 AND e <= 0.1 THEN 'QL2' WHEN d >= 0.5 AND e <= 0.2 THEN 'QL3' ELSE 'below-QL3' END AS level FROM q")),
    "change_uncertainty": (lambda s, d: _round(A.change_uncertainty(G.change(*_epochs(s, d), 1.0), SIZE * SIZE, 0.51, 0.05), 4),
        _q([*_EPOCHS, _DIFF, "v AS (SELECT count(*) FILTER (class <> 0) AS n, coalesce(sum(diff * 100) FILTER (class <> 0), 0) AS net FROM diff)", "u AS (SELECT *, sqrt((100 * 0.51::DOUBLE * sqrt(n)) ** 2 + (n * 100 * 0.05::DOUBLE) ** 2) AS sigma FROM v)", "w AS (SELECT *, CASE WHEN net <> 0 THEN sigma / abs(net) ELSE 0 END AS rel, n >= 1 AND abs(net) > 1.96::DOUBLE * sigma AS detectable FROM u)"], "SELECT n, round(net, 4) AS net, round(sigma, 4) AS sigma, round(net - sigma, 4) AS low, round(net + sigma, 4) AS high, round(rel, 4) AS relative, TRUE AS quantified, detectable, CASE WHEN NOT detectable THEN 'low' WHEN rel <= 0.1 THEN 'high' WHEN rel <= 0.3 THEN 'medium' ELSE 'low' END AS confidence FROM w")),
    "density_grade": (lambda s, d: _round(A.density_grade(pts(s, d)).select("valid", "invalid", "estimated", "span", "areal", "occupancy", "bucket", "basis"), 5),
        _q([PTS, "b AS (SELECT count(*) AS n, min(x) AS x0, min(y) AS y0, max(x) - min(x) AS rx, max(y) - min(y) AS ry, max(z) - min(z) AS rz, CAST(least(greatest(floor(sqrt(count(*) / 4) + 0.5), 8), 96) AS INTEGER) AS side FROM pts)", "o AS (SELECT count(*) AS k FROM (SELECT DISTINCT least(floor((x - x0) / rx * side), side - 1), least(floor((y - y0) / ry * side), side - 1) FROM pts, b))", "c AS (SELECT *, k / (side * side) AS occ FROM b, o)", "q AS (SELECT *, n / (occ * rx * ry) AS areal, n / (rx * ry * rz) AS vol, rz > 0.5 * least(rx, ry) AS tall FROM c)"],
            "SELECT n AS valid, 0 AS invalid, n AS estimated, round(rz, 5) AS span, round(areal, 5) AS areal, round(occ, 5) AS occupancy, CASE WHEN tall THEN CASE WHEN vol < 4 THEN 'sparse' WHEN vol < 40 THEN 'moderate' WHEN vol < 400 THEN 'dense' ELSE 'very-dense' END ELSE CASE WHEN areal < 2 THEN 'sparse' WHEN areal < 8 THEN 'moderate' WHEN areal < 50 THEN 'dense' ELSE 'very-dense' END END AS bucket, CASE WHEN tall THEN 'volumetric' ELSE 'areal' END AS basis FROM q")),
    "health_checks": (lambda s, d: A.health(src.table(s, d, "events").select(F.col("value").alias("x"), F.col("value").alias("y"), F.col("user_id").cast("double").alias("z")), 7), "SELECT 'invalid' AS \"check\", CAST(sum(2 * (value IS NULL OR NOT isfinite(value))::INT + (user_id IS NULL)::INT) AS BIGINT) AS n, CASE WHEN sum(2 * (value IS NULL OR NOT isfinite(value))::INT + (user_id IS NULL)::INT) > 0 THEN 'fail' ELSE 'pass' END AS status FROM events UNION ALL SELECT 'empty', count(*), 'pass' FROM events UNION ALL SELECT 'declared', count(*), CASE WHEN count(*) = 7 THEN 'pass' ELSE 'warn' END FROM events"),
    "qa_verdicts": (lambda s, d: A.worst(pts(s, d).select("class", F.when(F.col("z") > 60 + 10 * F.col("class"), "block").when(F.col("z") > 30, "review").otherwise("pass").alias("status")), "class"), _q([PTS, "q AS (SELECT class, CASE WHEN z > 60 + 10 * class THEN 2 WHEN z > 30 THEN 1 ELSE 0 END AS r FROM pts)"], "SELECT class, ['pass', 'review', 'block'][max(r) + 1] AS verdict, count(*) FILTER (r = 0) AS pass, count(*) FILTER (r = 1) AS review, count(*) FILTER (r = 2) AS block FROM q GROUP BY class")),
    "trust_tally": (lambda s, d: A.trust_tally(pts(s, d).select(F.when(F.col("intensity") > 60, "green").when(F.col("intensity") > 20, "yellow").when(F.col("intensity").isNotNull(), "red").alias("trust"))), _q([PTS], "SELECT count(*) FILTER (intensity > 60) AS green, count(*) FILTER (intensity > 20 AND intensity <= 60) AS yellow, count(*) FILTER (intensity <= 20) AS red FROM pts")),
    "evidence": (lambda s, d: pts(s, d).select("point_id", A.meets(F.get(F.array(*[F.lit(x) for x in A.EVIDENCE]), (F.col("class") - 1).cast("int")), F.get(F.array(*[F.lit(x) for x in A.EVIDENCE]), (F.col("point_id") % 5).cast("int"))).alias("meets")), _q([PTS], "SELECT point_id, class <= 5 AND class - 1 >= point_id % 5 AS meets FROM pts")),
    "welford": (lambda s, d: _round(A.welford(pts(s, d), "z")), _q([PTS], "SELECT count(z) AS n, round(avg(z), 6) AS mean, round(var_pop(z), 6) AS population, round(var_samp(z), 6) AS sample FROM pts")),
    "exact_sum": (lambda s, d: _round(A.exact_sum(pts(s, d), "z")), _q([PTS], "SELECT round(CAST(sum(CAST(z AS DECIMAL(26, 12))) AS DOUBLE), 6) AS sum FROM pts")),
    "finite_range": (lambda s, d: A.finite_range(src.table(s, d, "events"), "value"), "SELECT coalesce(min(value), 0) AS min, coalesce(max(value), 0) AS max FROM events WHERE isfinite(value)"),
    # layers and notes
    "merged": (lambda s, d: L.merge([pts(s, d).select("point_id", "z"), pts(s, d).where("class = 2").select("point_id", "class")]).groupBy("layer").agg(F.count("*").alias("n"), F.count("z").alias("heights"), F.count("class").alias("classes")), _q([PTS], "SELECT 0 AS layer, count(*) AS n, count(*) AS heights, 0 AS classes FROM pts UNION ALL SELECT 1, count(*), 0, count(*) FROM pts WHERE class = 2")),
    "snapshot": (lambda s, d: L.snapshot([pts(s, d).where("class = 2").withColumn("r", F.lit(1)), pts(s, d).where("class = 3").drop("intensity")]).select("point_id", "class", "intensity"), _q([PTS], "SELECT point_id, class, CASE WHEN class = 2 THEN intensity END AS intensity FROM pts WHERE class IN (2, 3)")),
    "placed": (lambda s, d: _round(L.placed(pts(s, d), (100.0, -5.0, 2.5), 0.5).select("point_id", "x", "y", "z")), _q([PTS], "SELECT point_id, round(x * 0.5 + 100, 6) AS x, round(y * 0.5 - 5, 6) AS y, round(z * 0.5 + 2.5, 6) AS z FROM pts")),
    "combined_range": (lambda s, d: L.combined_range(pts(s, d).groupBy("class").agg(F.lit("metre").alias("unit"), F.min("z").alias("low"), F.max("z").alias("high"))), _q([PTS], "SELECT FALSE AS mixed, CAST(NULL AS VARCHAR) AS reason, min(z) AS low, max(z) AS high, 'metre' AS unit FROM pts")),
    "compatibility": (lambda s, d: L.compatibility(_layers(s, d)),
        _q([*_LAYERS, "m AS (SELECT h, count(*) AS k, count(v) AS kv, min(v) AS v0, max(v) AS v1 FROM y WHERE h IS NOT NULL GROUP BY h)", "r AS (SELECT * FROM m ORDER BY k DESC, h LIMIT 1)"], "SELECT id, CASE WHEN y.h IS NULL THEN 'unknown' WHEN y.h <> r.h THEN 'incompatible' WHEN r.k = r.kv AND r.v0 = r.v1 THEN 'verified' ELSE 'horizontal-only' END AS status FROM y, r")),
    "placement": (lambda s, d: L.placement(_layers(s, d).select("id", F.col("horizontal").alias("epsg"), F.lit("EPSG:1").alias("project_epsg"), "vertical", F.lit("V2").alias("project_vertical"))), _q(_LAYERS, "SELECT id, CASE WHEN h IS NULL THEN 'needs-registration' WHEN h = 'EPSG:1' THEN 'identity' ELSE 'reproject' END AS plan, coalesce(v = 'V2', FALSE) AS heights FROM y")),
    "note_kinds": (lambda s, d: L.kinds(_notes(s, d)), _q(_NOTES, "SELECT kind, CAST(list_position(['note', 'info', 'warning', 'issue'], kind) AS INTEGER) AS place, count(*) AS n FROM o WHERE kind IS NOT NULL GROUP BY kind")),
    "note_clusters": (lambda s, d: _round(L.clusters(_notes(s, d).where("kind IS NOT NULL"), 40.0)), _q([*_NOTES, "g AS (SELECT CAST(floor(x / 40) AS BIGINT) AS i, CAST(floor(y / 40) AS BIGINT) AS j, CAST(floor(z / 40) AS BIGINT) AS k, count(*) AS n, avg(x) AS x, avg(y) AS y, avg(z) AS z, [count(*) FILTER (kind = 'note'), count(*) FILTER (kind = 'info'), count(*) FILTER (kind = 'warning'), count(*) FILTER (kind = 'issue')] AS c FROM o WHERE kind IS NOT NULL GROUP BY 1, 2, 3)"], "SELECT i, j, k, n, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z, ['note', 'info', 'warning', 'issue'][list_position(c, list_max(c))] AS dominant FROM g")),
    "issue_summary": (lambda s, d: L.issue_summary(_notes(s, d)), _q(_NOTES, "SELECT count(*) AS total, count(*) FILTER (status = 'open') AS open, count(*) FILTER (status = 'resolved') AS resolved, " + ", ".join(f"count(*) FILTER (status = 'open' AND severity = '{v}') AS {v}" for v in L.SEVERITIES) + f", ['low', 'medium', 'high', 'critical'][max({_RANK}) FILTER (status = 'open')] AS highest FROM o WHERE kind = 'issue'")),
    "issue_order": (lambda s, d: L.issue_order(_notes(s, d)), _q(_NOTES, "SELECT id, severity, row_number() OVER (PARTITION BY severity ORDER BY seen, CAST(id AS VARCHAR)) AS place FROM o WHERE kind = 'issue'")),
    "point_shade": (lambda s, d: _round(L.point_shade(pts(s, d), SIZE)), _q([*MEAN, "g AS (SELECT d.r, d.c, (coalesce(e.z, d.z) - coalesce(w.z, d.z)) / 20.0::DOUBLE AS gx, (coalesce(n.z, d.z) - coalesce(s.z, d.z)) / 20.0::DOUBLE AS gy FROM dtm d LEFT JOIN dtm e ON e.r = d.r AND e.c = d.c + 1 LEFT JOIN dtm w ON w.r = d.r AND w.c = d.c - 1 LEFT JOIN dtm n ON n.r = d.r + 1 AND n.c = d.c LEFT JOIN dtm s ON s.r = d.r - 1 AND s.c = d.c)"], "SELECT point_id, round(greatest((-gx * sin(radians(315)) * cos(radians(45)) - gy * cos(radians(315)) * cos(radians(45)) + sin(radians(45))) / sqrt(gx * gx + gy * gy + 1), 0), 6) AS shade FROM keyed JOIN g USING (r, c)")),
    "point_sizes": (lambda s, d: _round(L.point_sizes(pts(s, d), SIZE, 0.1)), _q([PTS, KEYED, "n AS (SELECT r, c, count(*) AS n FROM keyed GROUP BY r, c)"], "SELECT point_id, round(least(greatest(sqrt(0.1::DOUBLE / (n / 100.0::DOUBLE)), 0.5), 2), 6) AS scale FROM keyed JOIN n USING (r, c)")),
    "accepted": (lambda s, d: L.accepted(pts(s, d), [2, 4], (30.0, 5.0), (10, 80)).select("point_id"), _q([PTS], "SELECT point_id FROM pts WHERE class IN (2, 4) AND z BETWEEN 5 AND 30 AND coalesce(intensity BETWEEN 10 AND 80, TRUE)")),
    "class_scope": (lambda s, d: L.class_scope(pts(s, d), [2, 3, 6, 9]), _q([PTS, "p AS (SELECT DISTINCT class FROM pts)", "a AS (SELECT count(*) AS present, list_sort(list(class) FILTER (class IN (2, 3, 6, 9))) AS codes FROM p)"], "SELECT CASE WHEN len(codes) = present THEN 'full' ELSE 'subset' END AS kind, list_aggregate(codes, 'string_agg', ',') AS codes, present FROM a")),
    "budget_voxels": (lambda s, d: L.downsample_to_budget(pts(s, d), 500).select("kx", "ky", "kz", "n"), None),
    "lapsed": (lambda s, d: L.lapsed(_nodes(s, d).select("key", (F.col("depth") % 3).alias("rank"), "depth", F.col("screen").alias("distance"), "point_count"), 60000, 40000, 0.5).select("key"), _q([*_NODES, "t AS (SELECT key, point_count, sum(point_count) OVER (ORDER BY depth % 3 DESC, depth DESC, point_count / (point_count + 50.0::DOUBLE) DESC, key ROWS UNBOUNDED PRECEDING) AS total FROM nodes)"], "SELECT key FROM t WHERE 60000 - (total - point_count) > 20000")),
    "unique_names": (lambda s, d: L.named(_names(s, d)), _q(["f AS (SELECT event_id AS id, event_type || '.' || CAST(user_id % 3 AS VARCHAR) AS name, event_type AS stem, '.' || CAST(user_id % 3 AS VARCHAR) AS ext FROM events)", "g AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY id) AS i FROM f)"], "SELECT id, CASE WHEN i = 1 THEN name ELSE stem || ' (' || i || ')' || ext END AS name FROM g")),
    "chain_verify": (lambda s, d: L.verify_chain(_entries(s, d)), _q(["e AS (SELECT conv_id AS chain, row_number() OVER (PARTITION BY conv_id ORDER BY turn, concat_ws(':', role, text)) - 1 AS i FROM conversations)"], "SELECT chain, coalesce(min(i) FILTER (chain % 4 = 0 AND i = chain % 3), -1) AS first_bad FROM e GROUP BY chain")),
    "provenance": (lambda s, d: L.provenance(pts(s, d).select("class", F.when(F.col("z") > 20, 1).when(F.col("z") > 2, 2).otherwise(4).alias("bits")), "class"), _q([PTS], "SELECT class, CAST(bit_or(CASE WHEN z > 20 THEN 1 WHEN z > 2 THEN 2 ELSE 4 END) & 3 AS INTEGER) AS bits FROM pts GROUP BY class")),
    "share_state": (lambda s, d: L.share_state(src.table(s, d, "nation").select("n_nationkey", "n_regionkey"), ["n_nationkey", "n_regionkey"]), "SELECT n_nationkey, n_regionkey, base64(encode('{\"n_nationkey\":' || n_nationkey || ',\"n_regionkey\":' || n_regionkey || '}')) AS state FROM nation"),
    "class_edits": (_edits, _q([PTS], "SELECT point_id, 3 AS old, 5 AS new FROM pts WHERE class = 3")),
    "class_undo": (lambda s, d: L.undone(P.swap_class(pts(s, d), 3, 5), _edits(s, d)).select("point_id", "class"), _q([PTS], "SELECT point_id, class FROM pts")),
    # scores against truth
    "class_scores": (lambda s, d: _round(C.class_scores(_pairs(s, d))), _q(_SCORES, "SELECT scene, code, support, predicted, tp, fp, fn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM s")),
    "scene_scores": (lambda s, d: _round(C.scene_scores(_pairs(s, d))), _q([*_SCORES, "m AS (SELECT scene, avg(coalesce(f1, 0)) FILTER (support > 0 OR predicted > 0) AS macro FROM s GROUP BY scene)", "t AS (SELECT scene, count(*) AS n, count(*) FILTER (predicted = 1) AS u, count(*) FILTER (truth <> 6 AND predicted = 6) AS fb, count(*) FILTER (truth <> 6) AS nb, count(*) FILTER (truth = 7) AS ln, count(*) FILTER (truth = 7 AND predicted = 2) AS lg FROM p GROUP BY ROLLUP (scene))"], "SELECT t.scene, n AS points, round(macro, 6) AS macro_f1, round(u / n, 6) AS unclassified, round(fb / nullif(nb, 0), 6) AS false_building, ln AS low_noise, lg AS low_noise_as_ground FROM t JOIN m ON m.scene IS NOT DISTINCT FROM t.scene")),
    "block_holdout": (lambda s, d: _round(C.block_holdout(pts(s, d), SIZE, 50.0)),
        _q([PTS, KEYED, "k AS (SELECT r, c, z, bx, by_, ((bx * 31 + by_ * 17) % 5 + 5) % 5 AS f FROM (SELECT *, CAST(floor(x / 50) AS BIGINT) AS bx, CAST(floor(y / 50) AS BIGINT) AS by_ FROM keyed))", "u AS (SELECT r, c, f, sum(z) AS s, count(*) AS n FROM k GROUP BY ALL)", "q AS (SELECT DISTINCT r, c, f FROM k)", "p AS (SELECT q.r, q.c, q.f, sum(u.s) / sum(u.n) AS p FROM q JOIN u ON abs(u.r - q.r) <= 1 AND abs(u.c - q.c) <= 1 AND u.f <> q.f GROUP BY ALL)", "e AS (SELECT k.*, z - p AS e FROM k LEFT JOIN p USING (r, c, f))", "b AS (SELECT bx, by_, avg(e) AS b FROM e GROUP BY 1, 2)"],
            "SELECT count(*) AS n, count(*) FILTER (e IS NULL) AS uncovered, round(sqrt(avg(e * e)), 6) AS rmse, round(avg(abs(e)), 6) AS mae, round(avg(e), 6) AS bias, (SELECT round(stddev_samp(b), 6) FROM b) AS block_sd, (SELECT count(*) FROM b) AS blocks FROM e")),
}
_PAIR |= {
    "lines_geojson": (lambda s, d: K.geojson_lines(_lines(s, d)), _q([_TRACK], """SELECT line AS level, '{"type":"Feature","properties":{"level":' || printf('%.3f', CAST(line AS DOUBLE)) || ',"closed":false},"geometry":{"type":"LineString","coordinates":[' || string_agg(printf('[%.3f,%.3f]', x, y), ',' ORDER BY i) || ']}}' AS value FROM t GROUP BY line""")),
    "lines_dxf": (lambda s, d: K.dxf_lines(_lines(s, d)), _q([_TRACK], "SELECT line AS level, '0' || chr(10) || 'LWPOLYLINE' || chr(10) || '8' || chr(10) || 'CONTOURS' || chr(10) || '38' || chr(10) || printf('%.3f', CAST(line AS DOUBLE)) || chr(10) || '90' || chr(10) || count(*) || chr(10) || '70' || chr(10) || '0' || chr(10) || string_agg('10' || chr(10) || printf('%.3f', x) || chr(10) || '20' || chr(10) || printf('%.3f', y), chr(10) ORDER BY i) AS value FROM t GROUP BY line")),
    "lines_svg": (lambda s, d: K.svg_lines(_lines(s, d), 100.0), _q([_TRACK], """SELECT line AS level, '<path d="M' || string_agg(printf('%.2f %.2f', x, 100 - y), ' L' ORDER BY i) || '"/>' AS value FROM t GROUP BY line""")),
    "lines_kml": (lambda s, d: K.kml_lines(_lines(s, d)), _q([_TRACK], "SELECT line AS level, '<Placemark><name>' || printf('%.2f', CAST(line AS DOUBLE)) || '</name><LineString><coordinates>' || string_agg(printf('%.7f,%.7f', x, y), ' ' ORDER BY i) || '</coordinates></LineString></Placemark>' AS value FROM t GROUP BY line")),
    "points_csv": (lambda s, d: K.csv_lines(pts(s, d).select("point_id", "x", "class", "intensity", F.concat(F.lit('a"'), F.col("class").cast("string"), F.lit(",b")).alias("note")), ["point_id", "x", "class", "intensity", "note"]), _q([PTS], """SELECT concat(point_id, ',', printf('%.3f', x), ',', class, ',', coalesce(CAST(intensity AS VARCHAR), ''), ',"a""', class, ',b"') AS value FROM pts""")),
}

QUERIES = {k: q for k, (q, _) in _PAIR.items()}
ORACLE_SQL = {k: sql for k, (_, sql) in _PAIR.items() if sql}
