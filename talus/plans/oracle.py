"""SQL that states the registered queries independently, for DuckDB over the same tables."""

from __future__ import annotations

import math

RING = [(20.0, 100.0), (120.0, 150.0), (130.0, 500.0), (60.0, 620.0), (10.0, 400.0)]

PTS = """pts AS (
    SELECT event_id AS point_id, CAST(user_id AS DOUBLE) AS x, (epoch_us(ts) - 1704067200000000) / CAST(3600000000 AS DOUBLE) AS y, value AS z,
           CASE event_type WHEN 'view' THEN 2 WHEN 'signup' THEN 3 WHEN 'click' THEN 4 WHEN 'error' THEN 5 WHEN 'purchase' THEN 6 ELSE 1 END AS class,
           TRY_CAST(nullif(regexp_extract(props, '"k": *([0-9]+)', 1), '') AS INTEGER) AS intensity
    FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL AND value IS NOT NULL AND isfinite(value)
)"""
KEYED = "keyed AS (SELECT *, CAST(floor(y / 10) AS BIGINT) AS r, CAST(floor(x / 10) AS BIGINT) AS c FROM pts)"


def _dtm(z: str, name: str = "dtm", where: str = "") -> str:
    return f"{name} AS (SELECT r, c, {z} AS z, count(*) AS n FROM keyed {where} GROUP BY r, c)"


def _contains(ring=RING) -> str:
    terms = []
    for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1], strict=True):
        terms.append(f"CASE WHEN ({ay}::DOUBLE > y) <> ({by}::DOUBLE > y) AND x < {bx - ax}::DOUBLE * (y - {ay}::DOUBLE) / {(by - ay) or 1e-18}::DOUBLE + {ax}::DOUBLE THEN 1 ELSE 0 END")
    return f"(({' + '.join(terms)}) % 2 = 1)"


AREA = abs(sum(ax * by - bx * ay for (ax, ay), (bx, by) in zip(RING, RING[1:] + RING[:1], strict=True))) / 2


def _horn() -> str:
    """h(r, c, z, slope, aspect, complete): the nine values of the window by explicit cases."""
    off = {(-1, "r"): "d.r = box.r0", (1, "r"): "d.r = box.r1", (-1, "c"): "d.c = box.c0", (1, "c"): "d.c = box.c1", (0, "r"): "FALSE", (0, "c"): "FALSE"}
    name = {-1: "m", 0: "o", 1: "p"}
    n = lambda r, c: f"n{name[r]}{name[c]}.z"
    joins = "\n".join(f"LEFT JOIN dtm n{name[r]}{name[c]} ON n{name[r]}{name[c]}.r = d.r + {r} AND n{name[r]}{name[c]}.c = d.c + {c}" for r in (-1, 0, 1) for c in (-1, 0, 1))
    cols = []
    for r in (-1, 0, 1):
        for c in (-1, 0, 1):
            o_r, o_c = off[r, "r"], off[c, "c"]
            row_case = f"CASE WHEN {o_c} THEN coalesce(2 * {n(0, 0)} - {n(-r, 0)}, {n(0, 0)}) ELSE coalesce(2 * {n(0, c)} - {n(-r, c)}, {n(0, c)}, d.z) END"
            col_case = f"CASE WHEN {o_r} THEN coalesce(2 * {n(0, 0)} - {n(0, -c)}, {n(0, 0)}) ELSE coalesce(2 * {n(r, 0)} - {n(r, -c)}, {n(r, 0)}, d.z) END"
            rest = f"CASE WHEN {o_r} AND {o_c} THEN d.z WHEN {o_r} THEN coalesce({n(0, c)}, d.z) WHEN {o_c} THEN coalesce({n(r, 0)}, d.z) ELSE coalesce({n(r, c)}, d.z) END"
            cols.append(f"CASE WHEN box.r1 > box.r0 AND {o_r} THEN {row_case} WHEN NOT (box.r1 > box.r0 AND (d.r = box.r0 OR d.r = box.r1)) AND box.c1 > box.c0 AND {o_c} THEN {col_case} ELSE {rest} END AS w{name[r]}{name[c]}")
    every = " AND ".join(f"{n(r, c)} IS NOT NULL" for r in (-1, 0, 1) for c in (-1, 0, 1))
    return f"""box AS (SELECT min(r) AS r0, max(r) AS r1, min(c) AS c0, max(c) AS c1 FROM dtm),
win AS (SELECT d.r, d.c, d.z, {', '.join(cols)}, {every} AS complete FROM dtm d CROSS JOIN box {joins}),
grad AS (SELECT *, ((wmp + 2 * wop + wpp) - (wmm + 2 * wom + wpm)) / 80.0::DOUBLE AS dx, ((wpm + 2 * wpo + wpp) - (wmm + 2 * wmo + wmp)) / 80.0::DOUBLE AS dy FROM win),
h AS (SELECT r, c, z, sqrt(dx * dx + dy * dy) AS slope, CASE WHEN dx = 0 AND dy = 0 THEN 0 ELSE atan2(-dy, -dx) END AS aspect, complete FROM grad)"""


def _q(ctes: list[str], body: str, recursive: bool = False) -> str:
    return "WITH " + "RECURSIVE " * recursive + ",\n".join(ctes) + "\n" + body


MEAN = [PTS, KEYED, _dtm("avg(z)")]
HORN = [*MEAN, _horn()]
ROW = "r AS \"row\", c AS col"
_COS, _SIN = math.cos(math.radians(45)), math.sin(math.radians(45))
_MONTHS = "m AS (SELECT o_orderstatus AS line, CAST(year(o_orderdate) * 12 + month(o_orderdate) AS DOUBLE) AS s, round(sum(o_totalprice), 2) AS h FROM orders GROUP BY 1, 2)"
_TRACK = "t AS (SELECT o_custkey AS line, o_orderkey AS i, CAST(o_orderkey % 97 AS DOUBLE) AS x, CAST(o_orderkey % 89 AS DOUBLE) AS y, o_totalprice / 1000.0::DOUBLE AS z FROM orders)"
_ERR = "e AS (SELECT l_returnflag AS stratum, l_discount - l_tax AS error FROM lineitem)"
_SAMPLES = "p AS (SELECT least(CAST(intensity AS DOUBLE), 100) AS confidence, z > 20 AS hit FROM pts WHERE intensity IS NOT NULL)"
_BANDS = "b AS (SELECT CAST(least(floor(confidence / 10.0::DOUBLE), 9) AS BIGINT) AS band, count(*) AS n, avg(CASE WHEN hit THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS rate, avg(confidence) AS confidence FROM p GROUP BY 1)"
_DIGIT = " || ".join(f"CAST(((ix >> {b}) & 1) + ((iy >> {b}) & 1) * 2 + ((iz >> {b}) & 1) * 4 AS VARCHAR)" for b in range(4, -1, -1))
_NODES = [
    PTS,
    f"""oct AS (SELECT {_DIGIT} AS leaf FROM (SELECT {', '.join(f'CAST(least(greatest(floor({a} / 1024.0::DOUBLE * 32), 0), 31) AS INTEGER) AS i{a}' for a in 'xyz')} FROM pts))""",
    "nodes AS (SELECT substr(leaf, 1, d) AS key, count(*) AS point_count, CAST(length(substr(leaf, 1, d)) AS INTEGER) AS depth FROM oct, (SELECT unnest(range(0, 6)) AS d) GROUP BY 1)",
    "scored AS (SELECT *, CAST((4 - depth + 1) * 1000 + least(floor(point_count / (point_count + 50.0::DOUBLE) * 1000 + 0.5), 999) AS BIGINT) AS score FROM nodes WHERE depth <= 4)",
]
_EPOCHS = [PTS, KEYED, _dtm("avg(z)", "a", "WHERE point_id % 2 = 0"), _dtm("avg(z)", "b", "WHERE point_id % 2 = 1")]
_DIFF = "diff AS (SELECT b.r, b.c, b.z - a.z AS diff, CASE WHEN b.z - a.z > 1 THEN 1 WHEN b.z - a.z < -1 THEN -1 ELSE 0 END AS class FROM b JOIN a USING (r, c))"
_LEN = math.hypot(149.0, 720.0)
_STEP = _LEN / 63


def _rates() -> str:
    return """CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, CAST(tn AS BIGINT) AS tn, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1, round(tp / nullif(tp + fp + fn, 0), 6) AS iou,
round((tp / nullif(tp + fn, 0) + tn / nullif(tn + fp, 0)) / 2, 6) AS balanced, round((tp * tn - fp * fn) / nullif(sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 0), 6) AS mcc"""


def _erosion(f: str, src: str, dst: str) -> str:
    """One separable pass over rows, then columns, by self-joins."""
    return f"""{dst}1 AS (SELECT x.r, x.c, {f}(y.z) AS z FROM {src} x JOIN {src} y ON y.r = x.r AND y.c BETWEEN x.c - 2 AND x.c + 2 GROUP BY 1, 2),
{dst} AS (SELECT x.r, x.c, {f}(y.z) AS z FROM {dst}1 x JOIN {dst}1 y ON y.c = x.c AND y.r BETWEEN x.r - 2 AND x.r + 2 GROUP BY 1, 2)"""


def _stats(by: str, src: str) -> str:
    return f"SELECT {by} AS stratum, count(*) AS n, round(avg(error), 6) AS me, round(sqrt(avg(error * error)), 6) AS rmse, round(avg(abs(error)), 6) AS mae, round(1.4826 * median(abs(error - m)), 6) AS nmad, round(quantile_cont(abs(error), 0.95), 6) AS p95 FROM {src}"


_DISC = [(r, c) for r in range(-2, 3) for c in range(-2, 3) if 0 < r * r + c * c <= 4]
_MARCH = {1: ["ws"], 2: ["se"], 3: ["we"], 4: ["en"], 6: ["sn"], 7: ["wn"], 8: ["nw"], 9: ["ns"], 11: ["ne"], 12: ["ew"], 13: ["es"], 14: ["sw"]}


def _march() -> str:
    at = {"s": ("px + (v - a) / (b - a) * 10", "py"), "e": ("px + 10", "py + (v - b) / (c - b) * 10"), "n": ("px + (v - d) / (c - d) * 10", "py + 10"), "w": ("px", "py + (v - a) / (d - a) * 10")}
    arms = [(f"code = {k}", e) for k, es in _MARCH.items() for e in es]
    arms += [("code = 5 AND mid", "se"), ("code = 5 AND mid", "nw"), ("code = 5 AND NOT mid", "ws"), ("code = 5 AND NOT mid", "en")]
    arms += [("code = 10 AND mid", "ws"), ("code = 10 AND mid", "en"), ("code = 10 AND NOT mid", "se"), ("code = 10 AND NOT mid", "nw")]
    union = " UNION ALL ".join(f"SELECT v AS level, {at[e[0]][0]} AS x1, {at[e[0]][1]} AS y1, {at[e[1]][0]} AS x2, {at[e[1]][1]} AS y2 FROM lv WHERE {cond}" for cond, e in arms)
    return f"""sq AS (SELECT p.r, p.c AS col, p.z AS a, q.z AS b, s.z AS c, t.z AS d FROM dtm p JOIN dtm q ON q.r = p.r AND q.c = p.c + 1 JOIN dtm s ON s.r = p.r + 1 AND s.c = p.c + 1 JOIN dtm t ON t.r = p.r + 1 AND t.c = p.c),
lv0 AS (SELECT *, unnest(range(CAST(ceil(least(a, b, c, d) / 10) AS BIGINT), CAST(floor(greatest(a, b, c, d) / 10) AS BIGINT) + 1)) * 10.0::DOUBLE AS v FROM sq),
lv AS (SELECT *, (col + 0.5::DOUBLE) * 10 AS px, (r + 0.5::DOUBLE) * 10 AS py, CASE WHEN abs(a + c - b - d) > 1e-12 THEN (a * c - b * d) / (a + c - b - d) ELSE (a + b + c + d) / 4 END >= v AS mid, (a >= v)::INT + 2 * (b >= v)::INT + 4 * (c >= v)::INT + 8 * (d >= v)::INT AS code FROM lv0),
seg AS ({union})"""


#: Groups of contour segments that share ends: comp(level, id, segments, nodes, length).
_LINES = [
    "en AS (SELECT level, sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2) AS len, " + ", ".join(f"concat_ws(':', round(level, 6), CAST(round(x{i} / 0.000001::DOUBLE) AS BIGINT), CAST(round(y{i} / 0.000001::DOUBLE) AS BIGINT)) AS {n}" for i, n in ((1, "a"), (2, "b"))) + " FROM seg WHERE x1 <> x2 OR y1 <> y2)",
    "adj AS (SELECT a, b FROM en UNION SELECT b, a FROM en)",
    "reach AS (SELECT a, a AS m FROM adj UNION SELECT reach.a, adj.b FROM reach JOIN adj ON adj.a = reach.m)",
    "of AS (SELECT a AS node, min(m) AS id FROM reach GROUP BY a)",
    "comp AS (SELECT level, id, count(*) AS segments, (SELECT count(*) FROM of o WHERE o.id = of.id) AS nodes, sum(len) AS length FROM en JOIN of ON of.node = en.a GROUP BY level, id)",
]
_F = 1 / 298.257223563
_N = _F / (2 - _F)
_E = 2 * math.sqrt(_N) / (1 + _N)
_UTM = [
    "l AS (SELECT point_id, x - 70 AS lat, y / 2 - 180 AS lon FROM pts WHERE x - 70 BETWEEN -80 AND 84)",
    "zn AS (SELECT *, CAST(CASE WHEN NOT (lon BETWEEN -180 AND 180) THEN NULL WHEN lat >= 56 AND lat < 64 AND lon >= 3 AND lon < 12 THEN 32 WHEN lat >= 72 AND lon >= 0 AND lon < 42 THEN CASE WHEN lon < 9 THEN 31 WHEN lon < 21 THEN 33 WHEN lon < 33 THEN 35 ELSE 37 END ELSE least(floor((lon + 180) / 6) + 1, 60) END AS INTEGER) AS zone FROM l)",
    f"tt AS (SELECT *, radians(lon - (zone * 6 - 183)) AS lam, sinh(atanh(sin(radians(lat))) - {_E!r}::DOUBLE * atanh({_E!r}::DOUBLE * sin(radians(lat)))) AS t FROM zn)",
    f"u AS (SELECT *, atan2(t, cos(lam)) AS xi, atanh(sin(lam) / sqrt(1 + t * t)) AS eta, {6378137.0 / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)!r}::DOUBLE AS big, {_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16!r}::DOUBLE AS a1, {13 * _N**2 / 48 - 3 * _N**3 / 5!r}::DOUBLE AS a2, {61 * _N**3 / 240!r}::DOUBLE AS a3 FROM tt)",
]

ORACLE_SQL = {
    "range_filter": _q([PTS], "SELECT point_id, z FROM pts WHERE z BETWEEN 10 AND 30"),
    "clip_inside": _q([PTS], "SELECT point_id FROM pts WHERE x BETWEEN 10 AND 60 AND y BETWEEN 24 AND 240 AND z BETWEEN 5 AND 25"),
    "clip_outside": _q([PTS], "SELECT point_id FROM pts WHERE NOT (x BETWEEN 10 AND 60 AND y BETWEEN 24 AND 240 AND z BETWEEN 5 AND 25)"),
    "class_mask": _q([PTS], "SELECT point_id, class FROM pts WHERE class IN (2, 6)"),
    "class_hist": _q([PTS], "SELECT class, count(*) AS n FROM pts GROUP BY class"),
    "class_coverage": _q([PTS], "SELECT count(*) FILTER (WHERE class IN (0, 1)) AS unclassified, count(*) FILTER (WHERE class NOT IN (0, 1)) AS producer FROM pts"),
    "bounds": _q([PTS], "SELECT " + ", ".join(f"round({f}({c}), 6) AS {f}_{c}" for c in "xyz" for f in ("min", "max")) + ", count(*) AS n FROM pts"),
    "recentre": _q([PTS, "o AS (SELECT floor(min(x)) AS ox, floor(min(y)) AS oy, floor(min(z)) AS oz FROM pts)"], "SELECT point_id, " + ", ".join(f"round(CAST(CAST({c} - o{c} AS FLOAT) AS DOUBLE), 3) AS {c}" for c in "xyz") + " FROM pts, o"),
    "hist": _q([PTS, "s AS (SELECT min(z) AS lo, max(z) AS hi FROM pts)", "b AS (SELECT CAST(least(floor((z - lo) / (hi - lo) * 32), 31) AS BIGINT) AS bin, count(*) AS n FROM pts, s GROUP BY 1)"], "SELECT i AS bin, coalesce(n, 0) AS n FROM (SELECT unnest(range(0, 32)) AS i) LEFT JOIN b ON bin = i"),
    "voxel_centroid": _q([PTS, "k AS (SELECT *, " + ", ".join(f"CAST(floor({c} / 20) AS BIGINT) AS k{c}" for c in "xyz") + " FROM pts)"], "SELECT kx, ky, kz, round(avg(x), 6) AS x, round(avg(y), 6) AS y, round(avg(z), 6) AS z, CAST(floor(avg(intensity) + 0.5) AS BIGINT) AS intensity, arg_min(class, point_id) AS class, min(point_id) AS point_id, count(*) AS n FROM k GROUP BY kx, ky, kz"),
    "voxel_size": _q([PTS, "b AS (SELECT max(x) - min(x) AS a, max(y) - min(y) AS b, max(z) - min(z) AS c FROM pts)"], "SELECT round(sqrt(greatest(a * b, b * c, a * c) / 1000), 6) AS size FROM b"),
    "density": _q([PTS, KEYED], f"SELECT {ROW}, count(*) AS n, round(count(*) / 100.0::DOUBLE, 6) AS density FROM keyed GROUP BY r, c"),
    "density_p95": _q([PTS, KEYED, "d AS (SELECT count(*) / 100.0::DOUBLE AS density FROM keyed GROUP BY r, c)", "l AS (SELECT list_sort(list(density)) AS a, avg(density) AS mean, max(density) AS top FROM d)"], "SELECT len(a) AS cells, round(mean, 6) AS mean, round(top, 6) AS max, round(a[CAST(floor(0.95::DOUBLE * (len(a) - 1)) AS BIGINT) + 1], 6) AS p95 FROM l"),
    "health_dups": _q([PTS, "g AS (SELECT count(*) AS n FROM pts GROUP BY x, floor(y), floor(z))"], "SELECT CAST(sum(n - 1) AS BIGINT) AS duplicates, CAST(sum(n) AS BIGINT) AS points FROM g"),
    "health_outliers": _q([PTS, "m AS (SELECT median(x) AS mx, median(y) AS my, median(z) AS mz FROM pts)", "d AS (SELECT median(abs(x - mx)) AS dx, median(abs(y - my)) AS dy, median(abs(z - mz)) AS dz FROM pts, m)"], "SELECT point_id FROM pts, m, d WHERE " + " OR ".join(f"abs({c} - m{c}) > 8 * greatest(d{c}, 1e-9)" for c in "xyz")),
    "class_swap": _q([PTS], "SELECT point_id, CASE WHEN class = 3 THEN 5 ELSE class END AS class, class = 3 AS changed FROM pts"),
    "class_polygon": _q([PTS, f"i AS (SELECT point_id, class, {_contains()} AS inside FROM pts)"], "SELECT point_id, CASE WHEN inside THEN 6 ELSE class END AS class, inside AND class <> 6 AS changed FROM i"),
    "class_ids": _q([PTS, "hit AS (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1)"], "SELECT point_id, CASE WHEN doc_id IS NOT NULL THEN 6 ELSE class END AS class, doc_id IS NOT NULL AND class <> 6 AS changed FROM pts LEFT JOIN hit ON point_id = doc_id"),
    "percentile_range": _q([PTS, "l AS (SELECT list_sort(list(z)) AS a FROM pts)", "r AS (SELECT a[least(CAST(floor(0.05::DOUBLE * len(a)) AS BIGINT), len(a) - 1) + 1] AS lo, a[least(CAST(floor(0.95::DOUBLE * len(a)) AS BIGINT), len(a) - 1) + 1] AS hi, a[1] AS least, a[len(a)] AS most FROM l)"], "SELECT CASE WHEN lo >= hi THEN least ELSE lo END AS lo, CASE WHEN lo >= hi THEN most ELSE hi END AS hi FROM r"),
    "octree_nodes": _q(_NODES, "SELECT key, point_count, depth FROM nodes"),
    **{f"dtm_{how}": _q([PTS, KEYED, _dtm(z)], f"SELECT {ROW}, round(z, 6) AS z, n FROM dtm") for how, z in (("mean", "avg(z)"), ("min", "min(z)"), ("max", "max(z)"), ("median", "median(z)"), ("percentile", "quantile_cont(z, 0.95)"))},
    "dtm_robust": _q([PTS, KEYED, "l AS (SELECT r, c, list(z) AS a, median(z) AS m FROM keyed GROUP BY r, c)", "d AS (SELECT *, list_median(list_transform(a, lambda v: abs(v - m))) AS d FROM l)"], f"SELECT {ROW}, round(list_avg(list_filter(a, lambda v: abs(v - m) <= 3 * 1.4826 * d)), 6) AS z, len(a) AS n FROM d"),
    "surface_stats": _q(MEAN, "SELECT count(z) AS cells, round(min(z), 6) AS min, round(max(z), 6) AS max, round(avg(z), 6) AS mean FROM dtm"),
    "ndsm": _q([PTS, KEYED, _dtm("max(z) - min(z)")], f"SELECT {ROW}, round(greatest(z, 0), 6) AS h FROM dtm"),
    "canopy_stats": _q([PTS, KEYED, _dtm("greatest(max(z) - min(z), 0)")], "SELECT round(max(z), 6) AS max, round(avg(z), 6) AS mean, round(quantile_cont(z, 0.95), 6) AS p95 FROM dtm"),
    "terrain_slope": _q(HORN, f"SELECT {ROW}, round(z, 6) AS z, round(slope, 6) AS slope, round(aspect, 6) AS aspect, complete FROM h"),
    "slope_stats": _q([*HORN, "g AS (SELECT degrees(atan(slope)) AS d FROM h)"], "SELECT round(avg(d), 6) AS mean, round(max(d), 6) AS max, round(quantile_cont(d, 0.95), 6) AS p95, count(*) FILTER (WHERE d < 5) AS gentle, count(*) FILTER (WHERE d >= 5 AND d < 20) AS moderate, count(*) FILTER (WHERE d >= 20) AS steep FROM g"),
    "hillshade": _q(HORN, f"SELECT {ROW}, least(greatest(floor(({_COS!r}::DOUBLE * cos(atan(slope)) + {_SIN!r}::DOUBLE * sin(atan(slope)) * cos({math.radians(135.0)!r}::DOUBLE - aspect)) * 255 + 0.5), 0), 255) AS shade FROM h"),
    "multi_hillshade": _q(
        [*HORN, "k AS (SELECT r, c, unnest([225.0, 270.0, 315.0, 360.0]) AS az, slope, aspect FROM h)", "f AS (SELECT r, c, atan(slope) AS a, cos(radians(CAST((360 - az + 90) % 360 AS DOUBLE)) - aspect) AS facing FROM k)"],
        f"SELECT {ROW}, least(greatest(floor(sum((0.5 + 0.5 * greatest(facing, 0)) * greatest({_COS!r}::DOUBLE * cos(a) + {_SIN!r}::DOUBLE * sin(a) * facing, 0)) / sum(0.5 + 0.5 * greatest(facing, 0)) * 255 + 0.5), 0), 255) AS shade FROM f GROUP BY r, c",
    ),
    "tpi": _q(
        [*HORN, "off(dr, dc) AS (VALUES " + ", ".join(map(str, _DISC)) + ")", "t AS (SELECT d.r, d.c, d.z - avg(o.z) AS tpi FROM dtm d, off JOIN dtm o ON o.r = d.r + dr AND o.c = d.c + dc GROUP BY d.r, d.c, d.z)", "s AS (SELECT avg(tpi) AS m, stddev_pop(tpi) AS s FROM t)"],
        f"SELECT t.r AS \"row\", t.c AS col, round(tpi, 6) AS tpi, CASE WHEN (tpi - m) / s > 1 THEN 6 WHEN (tpi - m) / s > 0.5 THEN 5 WHEN (tpi - m) / s >= -0.5 THEN CASE WHEN slope > {math.tan(math.radians(5))!r}::DOUBLE THEN 4 ELSE 3 END WHEN (tpi - m) / s >= -1 THEN 2 ELSE 1 END AS class FROM t JOIN s ON TRUE LEFT JOIN h ON h.r = t.r AND h.c = t.c",
    ),
    "vrm": _q([*HORN, "u AS (SELECT r, c, sin(atan(slope)) * cos(aspect) AS nx, sin(atan(slope)) * sin(aspect) AS ny, cos(atan(slope)) AS nz FROM h)"], "SELECT a.r AS \"row\", a.c AS col, round(1 - sqrt(sum(b.nx) ** 2 + sum(b.ny) ** 2 + sum(b.nz) ** 2) / count(*), 6) AS vrm FROM u a JOIN u b ON b.r BETWEEN a.r - 1 AND a.r + 1 AND b.c BETWEEN a.c - 1 AND a.c + 1 GROUP BY 1, 2"),
    "morph_open": _q([PTS, KEYED, _dtm("min(z)"), _erosion("min", "dtm", "er"), _erosion("max", "er", "di")], f"SELECT {ROW}, round(z, 6) AS z FROM di"),
    "despike": _q(
        [*MEAN, "o AS (SELECT d.r, d.c, d.z, list(k.z) AS a FROM dtm d JOIN dtm k ON k.r BETWEEN d.r - 1 AND d.r + 1 AND k.c BETWEEN d.c - 1 AND d.c + 1 AND NOT (k.r = d.r AND k.c = d.c) GROUP BY ALL HAVING count(*) >= 4)", "m AS (SELECT *, list_median(a) AS m FROM o)", "s AS (SELECT *, list_median(list_transform(a, lambda v: abs(v - m))) AS d FROM m)"],
        f"SELECT {ROW}, round(z, 6) AS z, round(m, 6) AS replacement FROM s WHERE abs(z - m) > greatest(2 * 1.4826 * d, 0.3)",
    ),
    "cell_confidence": _q([*MEAN, "q AS (SELECT r, c, CAST(floor(100 * least(n / 8.0::DOUBLE, 1) * n / (n + 3.0::DOUBLE) + 0.5) AS BIGINT) AS confidence FROM dtm)"], f"SELECT {ROW}, confidence, CASE WHEN confidence >= 66 THEN 'solid' WHEN confidence >= 33 THEN 'dashed' ELSE 'gap' END AS grade FROM q"),
    "edge_distance": _q(
        [*MEAN, "k AS (SELECT r, c FROM dtm WHERE n >= 12)", "s AS (SELECT unnest(range(-3, 4)) AS d)", "t AS (SELECT k.r + a.d AS r, k.c + b.d AS c, greatest(abs(a.d), abs(b.d)) AS dist FROM k, s a, s b)"],
        f"SELECT {ROW}, CAST(min(dist) AS INTEGER) AS dist FROM t GROUP BY r, c HAVING min(dist) > 0",
    ),
    "contours": _q([*MEAN, _march()], "SELECT round(level, 6) AS level, round(x1, 6) AS x1, round(y1, 6) AS y1, round(x2, 6) AS x2, round(y2, 6) AS y2 FROM seg WHERE x1 <> x2 OR y1 <> y2"),
    "change_cells": _q([*_EPOCHS, _DIFF], f"SELECT {ROW}, round(diff, 6) AS diff, class FROM diff"),
    "change_stats": _q([*_EPOCHS, _DIFF], "SELECT count(*) AS cells, round(sum(CASE WHEN class = 1 THEN diff * 100 ELSE 0 END), 6) AS gain, round(sum(CASE WHEN class = -1 THEN -diff * 100 ELSE 0 END), 6) AS loss, round(sum(CASE WHEN class <> 0 THEN diff * 100 ELSE 0 END), 6) AS net, round(avg(abs(diff)), 6) AS mean_abs, round(min(diff), 6) AS lowest, round(max(diff), 6) AS highest FROM diff"),
    "grid_agreement": _q(
        [*_EPOCHS, "j AS (SELECT a.z AS za, b.z AS zb, a.z - b.z AS d FROM a FULL JOIN b USING (r, c))"],
        "SELECT count(d) AS both, count(*) FILTER (WHERE zb IS NULL) AS only_a, count(*) FILTER (WHERE za IS NULL) AS only_b, round(avg(d), 6) AS mean_error, round(median(d), 6) AS median_error, round(sqrt(avg(d * d)), 6) AS rmse, round(avg(abs(d)), 6) AS mae, round(quantile_cont(abs(d), 0.95), 6) AS p95, round(count(*) FILTER (WHERE abs(d) <= 2) / count(d), 6) AS within FROM j",
    ),
    "cut_fill": _q([PTS, f"i AS (SELECT z - 15 AS d FROM pts WHERE {_contains()})"], f"SELECT count(*) AS n, round(sum(greatest(d, 0)) * ({AREA}::DOUBLE / count(*)), 3) AS fill, round(sum(greatest(-d, 0)) * ({AREA}::DOUBLE / count(*)), 3) AS cut, round(sum(greatest(d, 0)) * ({AREA}::DOUBLE / count(*)) - sum(greatest(-d, 0)) * ({AREA}::DOUBLE / count(*)), 3) AS net, {AREA}::DOUBLE AS footprint, round(median(abs(d)), 3) AS median_abs FROM i"),
    "stockpile": _q([PTS, f"i AS (SELECT z FROM pts WHERE {_contains()})", "b AS (SELECT quantile_cont(z, 0.05) AS base FROM i)"], f"SELECT round(any_value(base), 3) AS base, round(sum(z - base) / count(*) * {AREA}::DOUBLE, 3) AS volume, round(stddev_samp(z - base) / sqrt(count(*)) * {AREA}::DOUBLE, 3) AS sigma, count(*) AS n FROM i, b"),
    "profile": _q(
        [PTS, f"k AS (SELECT x * {149.0 / _LEN!r}::DOUBLE + y * {720.0 / _LEN!r}::DOUBLE AS s, abs(y * {149.0 / _LEN!r}::DOUBLE - x * {720.0 / _LEN!r}::DOUBLE) AS d, z FROM pts)", f"g AS (SELECT CAST(floor(s / {_STEP!r}::DOUBLE + 0.5) AS BIGINT) AS station, quantile_cont(z, 0.25) AS height, count(*) AS n FROM k WHERE s BETWEEN 0 AND {_LEN!r}::DOUBLE AND d <= 8 GROUP BY 1)"],
        f"SELECT i AS station, round(i * {_STEP!r}::DOUBLE, 6) AS chainage, round(height, 6) AS height, coalesce(n, 0) AS n FROM (SELECT unnest(range(0, 64)) AS i) LEFT JOIN g ON station = i",
    ),
    "grades": _q([_MONTHS, "d AS (SELECT line, s, lead(s) OVER w - s AS run, lead(h) OVER w - h AS rise FROM m WINDOW w AS (PARTITION BY line ORDER BY s))"], "SELECT line, s, round(CASE WHEN run > 0 THEN rise / run * 100 END, 6) AS grade, round(CASE WHEN run > 0 THEN degrees(atan2(rise, run)) END, 6) AS degrees FROM d"),
    "profile_summary": _q(
        [_MONTHS, "d AS (SELECT *, lead(s) OVER w - s AS run, lead(h) OVER w - h AS rise FROM m WINDOW w AS (PARTITION BY line ORDER BY s))"],
        "SELECT line, round(max(h), 4) AS highest, round(arg_min(s, [-h, s]), 4) AS highest_at, round(min(h), 4) AS lowest, round(arg_min(s, [h, s]), 4) AS lowest_at, round(sum(greatest(CASE WHEN run > 1e-9 THEN rise END, 0)) FILTER (WHERE run > 1e-9), 4) AS gain, round(sum(greatest(-rise, 0)) FILTER (WHERE run > 1e-9), 4) AS loss, round(max(abs(rise / run * 100)) FILTER (WHERE run > 1e-9), 4) AS steepest, round((arg_max(h, s) - arg_min(h, s)) / nullif(max(s) - min(s), 0) * 100, 4) AS mean_grade FROM d GROUP BY line",
    ),
    "polyline_length": _q([_TRACK, "d AS (SELECT line, i, coalesce(sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2 + (z - lag(z) OVER w) ** 2), 0) AS segment FROM t WINDOW w AS (PARTITION BY line ORDER BY i))"], "SELECT line, i, round(segment, 6) AS segment, round(sum(segment) OVER (PARTITION BY line ORDER BY i ROWS UNBOUNDED PRECEDING), 6) AS length FROM d"),
    "bearings": _q(
        [_TRACK, "d AS (SELECT line, i, lead(x) OVER w - x AS dx, lead(y) OVER w - y AS dy, lead(z) OVER w - z AS dz FROM t WINDOW w AS (PARTITION BY line ORDER BY i))"],
        "SELECT line, i, round(CASE WHEN dx <> 0 OR dy <> 0 THEN CASE WHEN degrees(atan2(dx, dy)) + 360 >= 360 THEN degrees(atan2(dx, dy)) + 360 - 360 ELSE degrees(atan2(dx, dy)) + 360 END END, 6) AS bearing, round(sqrt(dx * dx + dy * dy), 6) AS run, round(sqrt(dx * dx + dy * dy + dz * dz), 6) AS distance, round(degrees(atan2(dz, sqrt(dx * dx + dy * dy))), 6) AS slope FROM d WHERE dx IS NOT NULL",
    ),
    "chains": "SELECT l_returnflag AS kind, round(sum(l_quantity), 6) AS sum, round(avg(l_quantity), 6) AS mean, round(min(l_quantity), 6) AS min, round(max(l_quantity), 6) AS max, count(l_quantity) AS count FROM lineitem GROUP BY 1",
    "radius_count": _q(["v AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z FROM embeddings)"], "SELECT a.vec_id AS point_id, count(b.vec_id) AS n FROM v a LEFT JOIN v b ON (a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2 <= 0.1::DOUBLE * 0.1::DOUBLE GROUP BY 1"),
    "nearest": _q(
        [PTS, "p AS (SELECT a.point_id, b.point_id AS o, (a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2 AS d2 FROM pts a JOIN pts b ON b.x BETWEEN a.x - 3 AND a.x + 3 AND b.y BETWEEN a.y - 3 AND a.y + 3 WHERE a.class = 2 AND b.class = 6)"],
        "SELECT point_id, arg_min(o, [d2, o]) AS nearest, round(sqrt(min(d2)), 6) AS distance FROM p WHERE d2 <= 9 GROUP BY point_id",
    ),
    "confusion": "SELECT " + _rates() + " FROM (SELECT " + ", ".join(f"CAST(count(*) FILTER (WHERE quality = {t} AND toxic = {p}) AS DOUBLE) AS {n}" for n, t, p in (("tp", 1, 1), ("fp", 0, 1), ("fn", 1, 0), ("tn", 0, 0))) + " FROM labels)",
    "checkpoints": _q([_ERR, "s AS (SELECT *, median(error) OVER (PARTITION BY stratum) AS m FROM e)", "q AS (SELECT e.*, (SELECT median(error) FROM e) AS m FROM e)"], _stats("stratum", "s GROUP BY stratum") + " UNION ALL " + _stats("NULL", "q")),
    "checkpoint_rollup": _q([_ERR], "SELECT stratum, CAST(grouping(stratum) AS INTEGER) AS pooled, count(*) AS n, round(avg(error), 6) AS me, round(sqrt(avg(error * error)), 6) AS rmse FROM e GROUP BY ROLLUP (stratum)"),
    "wilson": _q(
        [_ERR, "k AS (SELECT stratum, count(*) FILTER (WHERE abs(error) <= 0.03::DOUBLE) AS k, count(*) AS n FROM e GROUP BY 1)", "w AS (SELECT *, k / n AS p, 3.841458820694124::DOUBLE AS z2 FROM k)"],
        "SELECT stratum, k, n, round(p, 6) AS share, round(greatest((p + z2 / (2 * n)) / (1 + z2 / n) - sqrt(z2) * sqrt(p * (1 - p) / n + z2 / (4 * n * n)) / (1 + z2 / n), 0), 6) AS low, round(least((p + z2 / (2 * n)) / (1 + z2 / n) + sqrt(z2) * sqrt(p * (1 - p) / n + z2 / (4 * n * n)) / (1 + z2 / n), 1), 6) AS high FROM w",
    ),
    "reliability": _q([PTS, _SAMPLES, _BANDS], "SELECT band, n, round(rate, 6) AS rate, round(confidence, 6) AS confidence FROM b"),
    "isotonic": _q([PTS, _SAMPLES, _BANDS, "sp AS (SELECT l.band AS lo, h.band AS hi, sum(w.n * w.rate) / sum(w.n) AS m FROM b l JOIN b h ON l.band <= h.band JOIN b w ON w.band BETWEEN l.band AND h.band GROUP BY 1, 2)", "f AS (SELECT band, lo, min(m) AS m FROM b JOIN sp ON band BETWEEN lo AND hi GROUP BY 1, 2)"], "SELECT band, round(max(m), 6) AS fitted FROM f GROUP BY band"),
    "jackknife": _q(["b AS (SELECT l_suppkey % 17 AS site, sum(l_quantity) AS s, count(*) AS n FROM lineitem GROUP BY 1)", "j AS (SELECT (t.s - b.s) / (t.n - b.n) AS v FROM b, (SELECT sum(s) AS s, sum(n) AS n FROM b) t)"], "SELECT round(sqrt((count(*) - 1) * var_pop(v)), 4) AS se, round((count(*) - 1) * (avg(v) - (SELECT avg(l_quantity) FROM lineitem)), 4) AS bias FROM j"),
    "node_scores": _q(_NODES, "SELECT key, score FROM scored"),
    "budget_prefix": _q([*_NODES, "t AS (SELECT key, point_count, CAST(sum(point_count) OVER (ORDER BY score DESC, key ROWS UNBOUNDED PRECEDING) AS BIGINT) AS total FROM scored WHERE score > 0)"], "SELECT key, total FROM t WHERE total <= 20000 OR total = point_count"),
    "sampling_plan": _q([*_NODES, "t AS (SELECT key, point_count, CAST(sum(point_count) OVER (ORDER BY depth, point_count DESC, key ROWS UNBOUNDED PRECEDING) AS BIGINT) AS total FROM nodes)"], "SELECT key, total FROM t WHERE total - point_count < 15000"),
    "eviction_plan": _q([*_NODES, "t AS (SELECT key, point_count, sum(point_count) OVER (ORDER BY depth % 3 DESC, depth DESC, point_count / (point_count + 50.0::DOUBLE) DESC, key ROWS UNBOUNDED PRECEDING) AS total, sum(point_count) OVER () AS resident FROM nodes)"], "SELECT key FROM t WHERE resident > 20000 AND resident - (total - point_count) > 18000"),
    "frontier": _q(_NODES, "SELECT n.key, n.point_count FROM nodes n WHERE NOT EXISTS (SELECT 1 FROM nodes o WHERE o.depth = n.depth + 1 AND starts_with(o.key, n.key))"),
    "tumbling": "SELECT time_bucket(INTERVAL 6 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "sliding": "SELECT start, count(*) AS n, round(max(value), 6) AS top FROM (SELECT time_bucket(INTERVAL 2 HOUR, ts) - k * INTERVAL 2 HOUR AS start, value FROM events, (SELECT unnest(range(0, 3)) AS k)) GROUP BY 1",
    "sessions": _q(["g AS (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 3 HOUR THEN 0 ELSE 1 END AS new FROM events)", "s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)"], "SELECT user_id, min(ts) AS start, count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY user_id, k"),
    "nearest_fill": _q(
        [*MEAN, *(_SPARSE := ["k AS (SELECT r, c, z FROM dtm WHERE n >= 10)", "box AS (SELECT min(r) AS r0, max(r) AS r1, min(c) AS c0, max(c) AS c1 FROM k)", "f AS (SELECT r, unnest(range(c0, c1 + 1)) AS c FROM (SELECT unnest(range(r0, r1 + 1)) AS r, c0, c1 FROM box))", "hole AS (SELECT r, c FROM f EXCEPT SELECT r, c FROM k)", "near AS (SELECT h.r, h.c, k.z, k.r - h.r AS dr, k.c - h.c AS dc FROM hole h JOIN k ON k.r BETWEEN h.r - 4 AND h.r + 4 AND k.c BETWEEN h.c - 4 AND h.c + 4)"])],
        f"SELECT {ROW}, round(z, 6) AS z FROM k UNION ALL SELECT {ROW}, round(arg_min(z, [greatest(abs(dr), abs(dc)), dr * dr + dc * dc, dr, dc]), 6) FROM near GROUP BY r, c",
    ),
    "idw_fill": _q(
        [*MEAN, *_SPARSE, "g AS (SELECT r, c, greatest(abs(dr), abs(dc)) AS ring, count(*) AS n, sum(1.0::DOUBLE / (dr * dr + dc * dc)) AS w, sum(z / (dr * dr + dc * dc)) AS s FROM near GROUP BY 1, 2, 3)", "t AS (SELECT *, sum(n) OVER (PARTITION BY r, c ORDER BY ring) AS upto FROM g)", "l AS (SELECT r, c, coalesce(min(ring) FILTER (WHERE upto >= 12), 4) + 1 AS last FROM t GROUP BY r, c)"],
        f"SELECT r AS \"row\", c AS col, round(sum(s) / sum(w), 6) AS z, CAST(sum(n) AS BIGINT) AS found FROM t JOIN l USING (r, c) WHERE ring <= last GROUP BY r, c",
    ),
    "cell_status": _q(
        [*MEAN, *_SPARSE, "w AS (SELECT n FROM dtm WHERE n >= 10)", "m AS (SELECT CASE WHEN 100 * least(n / 8.0::DOUBLE, 1) * n / (n + 3.0::DOUBLE) + 0.5 < 33 THEN 'low' ELSE 'measured' END AS state FROM w)", "t AS (SELECT r, c, min(greatest(abs(dr), abs(dc))) AS d FROM near GROUP BY r, c)", "h AS (SELECT CASE WHEN d < 3 THEN 'interpolated' WHEN d = 3 THEN 'edge' ELSE 'empty' END AS state FROM hole LEFT JOIN t USING (r, c))"],
        "SELECT state, count(*) AS cells FROM (SELECT state FROM m UNION ALL SELECT state FROM h) GROUP BY state",
    ),
    "stations": _q([_MONTHS, "l AS (SELECT line, max(s) - min(s) AS length FROM m GROUP BY line)", "p AS (SELECT line, CAST(unnest(range(0, CAST(floor(length / 7) AS BIGINT) + 1)) * 7 AS DOUBLE) AS chainage FROM l UNION SELECT line, length FROM l)"], "SELECT line, chainage, printf('%d+%06.2f', CAST(floor(chainage / 1000) AS BIGINT), chainage - floor(chainage / 1000) * 1000) AS label FROM p"),
    "footprints": _q(
        [PTS, KEYED, "k AS (SELECT r, c, r * 4294967296 + c AS id FROM keyed GROUP BY r, c HAVING count(*) >= 12)", "adj AS (SELECT a.id AS a, b.id AS b FROM k a JOIN k b ON abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1)", "reach AS (SELECT id AS a, id AS m FROM k UNION SELECT reach.a, adj.b FROM reach JOIN adj ON adj.a = reach.m)", "comp AS (SELECT a AS id, min(m) AS component FROM reach GROUP BY a)"],
        "SELECT component, count(*) AS cells, count(*) * 100.0::DOUBLE AS area, round((avg(c) + 0.5) * 10, 6) AS cx, round((avg(r) + 0.5) * 10, 6) AS cy, min(c) * 10.0::DOUBLE AS west, (max(c) + 1) * 10.0::DOUBLE AS east, min(r) * 10.0::DOUBLE AS south, (max(r) + 1) * 10.0::DOUBLE AS north FROM comp JOIN k USING (id) GROUP BY component HAVING count(*) * 100 >= 150",
        True,
    ),
    "steepness": _q(MEAN, "SELECT a.r AS \"row\", a.c AS col, round(coalesce(max(abs(a.z - b.z)), 0) / 10, 6) AS slope FROM dtm a LEFT JOIN dtm b ON abs(a.r - b.r) + abs(a.c - b.c) = 1 GROUP BY 1, 2"),
    "holdout": _q([PTS, KEYED, _dtm("avg(z)", "tr", "WHERE point_id % 5 <> 0"), "e AS (SELECT k.z - tr.z AS e FROM keyed k LEFT JOIN tr USING (r, c) WHERE point_id % 5 = 0)"], "SELECT count(*) AS n, count(e) AS covered, round(sqrt(avg(e * e)), 6) AS rmse, round(avg(e), 6) AS bias FROM e"),
    "interval_gate": _q([*MEAN, "s AS (SELECT min(z) AS lo, max(z) AS hi FROM dtm)", "i AS (SELECT CAST(unnest([0.5, 1, 2, 5, 10]) AS DOUBLE) AS interval)", "l AS (SELECT interval, CAST(greatest(floor(hi / interval) - ceil(lo / interval) + 1, 0) AS BIGINT) AS levels FROM i, s)", "g AS (SELECT *, interval >= 0.8 AND levels >= 1 AS supported FROM l)"], "SELECT interval, levels, supported, coalesce(interval = (SELECT min(interval) FROM g WHERE supported AND levels BETWEEN 4 AND 40), FALSE) AS recommended FROM g"),
    "style_levels": _q([*MEAN, _march()], "SELECT DISTINCT level, CAST(round(level / 10) AS BIGINT) % 5 = 0 AS is_index FROM seg WHERE x1 <> x2 OR y1 <> y2"),
    "grade_tally": _q(
        [*MEAN, _march(), "q AS (SELECT r, c, CAST(floor(100 * least(n / 8.0::DOUBLE, 1) * n / (n + 3.0::DOUBLE) + 0.5) AS BIGINT) AS k FROM dtm)", "m AS (SELECT *, CAST(floor((y1 + y2) / 2 / 10) AS BIGINT) AS r, CAST(floor((x1 + x2) / 2 / 10) AS BIGINT) AS c FROM seg WHERE x1 <> x2 OR y1 <> y2)", "w AS (SELECT CASE WHEN k >= 66 THEN 'solid' WHEN k >= 33 THEN 'dashed' ELSE 'gap' END AS grade, sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2) AS len FROM m LEFT JOIN q USING (r, c))"],
        "SELECT grade, count(*) AS n, round(sum(len), 4) AS length FROM w GROUP BY grade",
    ),
    "polylines": _q([*MEAN, _march(), *_LINES], "SELECT level, segments = nodes AS closed, segments + 1 AS vertices FROM comp", True),
    "smooth_lines": _q([*MEAN, _march(), *_LINES], "SELECT level, segments = nodes AS closed, CASE WHEN segments < 2 THEN segments + 1 WHEN segments = nodes THEN 4 * segments + 1 ELSE 4 * (segments + 1) END AS vertices FROM comp", True),
    "label_places": _q([*MEAN, _march(), *_LINES], "SELECT level, round(20 + 40.0::DOUBLE * unnest(range(0, CAST(floor((length - 20) / 40) AS BIGINT) + 1)), 6) AS chainage FROM comp WHERE length >= 20", True),
    "class_names": _q([PTS], "SELECT class, CASE class WHEN 1 THEN 'Unclassified' WHEN 2 THEN 'Ground' WHEN 3 THEN 'Low vegetation' WHEN 4 THEN 'Medium vegetation' WHEN 5 THEN 'High vegetation' WHEN 6 THEN 'Building' END AS name, count(*) AS n FROM pts GROUP BY class"),
    "utm_forward": _q([PTS, *_UTM], "SELECT point_id, zone, round(500000 + 0.9996::DOUBLE * big * (eta + a1 * cos(2 * xi) * sinh(2 * eta) + a2 * cos(4 * xi) * sinh(4 * eta) + a3 * cos(6 * xi) * sinh(6 * eta)), 3) AS east, round(0.9996::DOUBLE * big * (xi + a1 * sin(2 * xi) * cosh(2 * eta) + a2 * sin(4 * xi) * cosh(4 * eta) + a3 * sin(6 * xi) * cosh(6 * eta)) + CASE WHEN lat < 0 THEN 10000000 ELSE 0 END, 3) AS north FROM u"),
    "cell_metres": _q([PTS, "l AS (SELECT point_id, x - 70 AS lat FROM pts)"], "SELECT point_id, round(CASE WHEN point_id % 2 = 0 THEN 0.001::DOUBLE * 111320 * cos(radians(least(greatest(lat, -89), 89))) ELSE 0.001::DOUBLE END, 6) AS ew, round(CASE WHEN point_id % 2 = 0 THEN 0.001::DOUBLE * 111320 ELSE 0.001::DOUBLE END, 6) AS ns FROM l"),
    "srgb": _q([PTS, "b AS (SELECT point_id, CAST(point_id % 256 AS INTEGER) AS back, CAST(point_id % 256 AS DOUBLE) / 255 AS c FROM pts)"], "SELECT point_id, round(CASE WHEN c <= 0.04045 THEN c / 12.92::DOUBLE ELSE ((c + 0.055::DOUBLE) / 1.055::DOUBLE) ** 2.4::DOUBLE END, 6) AS linear, back FROM b"),
    "fnv1a": "SELECT event_id, lpad(lower(hex(list_reduce(list_prepend(CAST(2166136261 AS BIGINT), list_transform(string_split(props, ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda a, c: (xor(a, c) * 16777619) % 4294967296))), 8, '0') AS hash FROM events",
    "hash_chain": "SELECT conv_id, list_reduce(list_prepend('', list(concat_ws(':', role, text) ORDER BY turn, concat_ws(':', role, text))), lambda h, e: sha256(h || '|' || e)) AS hash FROM conversations GROUP BY conv_id",
    "version_order": "SELECT event_id, CAST(CASE WHEN event_id % 3 <> event_id % 2 THEN sign(event_id % 3 - event_id % 2) ELSE sign(event_id % 11 - user_id % 12) END AS INTEGER) AS sign FROM events",
}
