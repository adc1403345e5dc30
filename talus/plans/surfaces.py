"""Queries over finished grids, point structure and stream facts, each with the SQL that states it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo
from ..operators import grid as G
from ..operators import picks as Q
from ..operators import registration as T
from ..operators import surface as U
from ..operators import validate as C
from ..sources import points as src
from ..sources import rasters as K
from ..sources import sinks as W
from ..streaming import pipeline as N
from .oracle import _DIFF, _EPOCHS, _SPARSE, _UTM, KEYED, MEAN, ORACLE_SQL, PTS, _dtm, _horn, _q
from .queries import SIZE, _horn as _slopes, _round, _rounded, _dtm as _cells, _epochs, _places, _sparse, pts

PLANES = [(1.0, 0.0, 0.0, -100.0), (-1.0, 0.5, 0.0, 300.0), (0.0, -1.0, 0.25, 400.0), (0.0, 0.0, 1.0, -8.0)]

_RAYS = "ray AS (SELECT * FROM (VALUES (0, 0, 1), (1, 1, 1), (2, 1, 0), (3, 1, -1), (4, 0, -1), (5, -1, -1), (6, -1, 0), (7, -1, 1)) v(i, dr, dc))"
_HITS = [
    _RAYS,
    "hit AS (SELECT DISTINCT h.r, h.c, ray.i FROM hole h, ray, (SELECT unnest(range(1, 9)) AS t) s, k WHERE k.r = h.r + ray.dr * s.t AND k.c = h.c + ray.dc * s.t)",
    "gap AS (SELECT r, c, i, coalesce(lead(i) OVER w, first_value(i) OVER w + 8) - i AS arc FROM hit WINDOW w AS (PARTITION BY r, c ORDER BY i))",
    "side AS (SELECT r, c, count(*) AS directions, max(arc) > 4 AS one_sided FROM gap GROUP BY r, c)",
]
_OPEN = [x.replace("box", "box0").replace("SELECT r, c, z FROM dtm", "SELECT r, c, z, n FROM d0") for x in _SPARSE]
_IDW = [
    "g AS (SELECT r, c, greatest(abs(dr), abs(dc)) AS ring, count(*) AS n, sum(1.0::DOUBLE / (dr * dr + dc * dc)) AS w, sum(z / (dr * dr + dc * dc)) AS s FROM near GROUP BY 1, 2, 3)",
    "t AS (SELECT *, sum(n) OVER (PARTITION BY r, c ORDER BY ring) AS upto FROM g)",
    "l AS (SELECT r, c, coalesce(min(ring) FILTER (WHERE upto >= 12), 4) + 1 AS last FROM t GROUP BY r, c)",
    "filled AS (SELECT r, c, sum(s) / sum(w) AS z, min(ring) AS dist FROM t JOIN l USING (r, c) WHERE ring <= last GROUP BY r, c)",
]


def _sizes(s, d):
    return src.table(s, d, "orders").select("o_orderkey", (F.col("o_orderkey") - 5).alias("cols"), (F.col("o_custkey") * F.when(F.col("o_orderkey") % 7 == 0, 1000).otherwise(10)).alias("rows"))


def _extents(s, d):
    p = pts(s, d).groupBy("class").agg(F.count("*").alias("points"), *[(F.max(c) - F.min(c)).alias(n) for c, n in (("x", "width"), ("y", "depth"), ("z", "relief"))])
    return p.select("class", "points", *[(F.col(n) * F.when(F.col("class") == 4, 1000.0).when((F.col("class") == 5) & F.lit(n != "relief"), 0.01).otherwise(1.0)).alias(n) for n in ("width", "depth", "relief")])


def _boxes(s, d):
    return pts(s, d).select("point_id", *[F.col(c).alias(f"{c}0") for c in "xyz"], *[(F.col(c) + 10).alias(f"{c}1") for c in "xyz"])


def _ticks(s, d):
    k = F.col("event_id")
    mb = 1024 * 1024
    return src.table(s, d, "events").select("event_id", (k % 8).alias("fetches"), (k % 5).alias("decodes"), (k % 20 * mb).alias("queued"), (k % 60 * mb).alias("pending"), (k % 300).alias("rtt"), (k % 13 / 100).alias("failures"), (k % 3).alias("waiting"), (k % 11 / 10).alias("busy"))


_TICKS = "k AS (SELECT event_id, event_id % 8 AS f, event_id % 5 AS d, event_id % 20 AS q, event_id % 60 AS p, event_id % 300 AS rtt, event_id % 13 AS fail, event_id % 3 AS w, event_id % 11 AS busy FROM events)"


def _facts(s, d):
    k = F.col("event_id")
    names = ("wanted", "resident", "in_flight", "queued", "decoded", "failed")
    return src.table(s, d, "events").select("event_id", *[c.alias(n) for n, c in zip(names, (k % 40, k % 41, k % 3, k % 2, k % 5 - 1, F.when(k % 17 > 0, k % 4)), strict=True)])


def _chunks(s, d):
    e = src.table(s, d, "events").where("user_id IS NOT NULL AND event_type IS NOT NULL")
    return e.select(F.col("event_type").alias("key"), (F.col("user_id") % 3).alias("chunk"), F.col("event_id").alias("i"), F.col("user_id").cast("double").alias("x"), F.lit(1.0).alias("y"), F.col("value").alias("z"), F.when(F.col("event_id") % 2 == 0, 2).alias("class"))


def _tiers(s, d):
    k = F.col("event_id")
    return src.table(s, d, "events").select("event_id", F.when(k % 4 == 0, "low").when(k % 4 == 1, "high").when(k % 4 == 2, "mid").alias("tier"), F.when(k % 3 == 0, "mobile").otherwise("desktop").alias("device"))


def _plans(s, d):
    k = F.col("l_orderkey")
    return src.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", (k % 50 - 1).alias("sampled"), (k % 70).alias("total"), (k % 3 == 0).alias("exhaustive"), (k % 2 == 0).alias("complete"))


def _value_blocks(s, d):
    return pts(s, d).select(F.floor(F.col("x") / 5).cast("long").alias("block"), F.col("z").alias("value"))


def _structured(s, d):
    return T.structure(T.descriptors(src.vector_points(s, d), 0.15))


def _polylines(s, d):
    """Prices by month as lines: one for each order priority, another of the same line turned by each status."""
    o = src.table(s, d, "orders")
    month = F.year("o_orderdate") * 12 + F.month("o_orderdate") - 23900
    return o.groupBy(F.col("o_orderpriority").alias("line"), month.cast("long").alias("i")).agg(F.avg("o_totalprice").alias("p")).select("line", "i", F.col("i").cast("double").alias("x"), _rounded(F.col("p") / 10000, 3).alias("y"), (F.col("i") % 5).cast("double").alias("z"))


def _asked(s, d):
    return src.table(s, d, "customer").select(F.col("c_custkey").alias("point_id"), (F.col("c_custkey") % 83).cast("double").alias("x"), (F.col("c_acctbal") / 500).alias("y"), F.lit(2.0).alias("z"))


def _marks(s, d):
    return src.table(s, d, "supplier").select((F.col("s_suppkey") % 83 + 0.25).alias("x"), (F.col("s_acctbal") / 500).alias("y"), F.lit(2.0).alias("z"))


def _bare(s, d):
    z, e, n = geo.utm_forward(F.col("lat"), F.col("lon"))
    p = _places(s, d).where("lat BETWEEN -80 AND 84").select("point_id", "lat", "lon", z.alias("zone"), e.alias("east"), n.alias("north"))
    lat, lon = geo.utm_inverse(F.col("zone"), F.col("east"), F.col("north"), F.col("lat") < 0)
    return p.select("point_id", lat.alias("lat"), lon.alias("lon"))


_LINES = [
    "v AS (SELECT o_orderpriority AS line, year(o_orderdate) * 12 + month(o_orderdate) - 23900 AS i, round(avg(o_totalprice) / 10000, 3) AS y FROM orders GROUP BY 1, 2)",
    "w AS (SELECT line, i, CAST(i AS DOUBLE) AS x, y, CAST(i % 5 AS DOUBLE) AS z FROM v)",
    "s AS (SELECT *, lead(i) OVER p AS i2, lead(x) OVER p AS x2, lead(y) OVER p AS y2, lead(z) OVER p AS z2 FROM w WINDOW p AS (PARTITION BY line ORDER BY i))",
    "det AS (SELECT a.line AS l1, a.i AS i1, b.line AS l2, b.i AS j1, a.x AS ax, a.y AS ay, a.z AS az, b.z AS bz, a.x2 - a.x AS r0, a.y2 - a.y AS r1, a.z2 - a.z AS r2, b.x2 - b.x AS s0, b.y2 - b.y AS s1, b.z2 - b.z AS s2, b.x - a.x AS dx, b.y - a.y AS dy FROM s a JOIN s b ON (a.line, a.i) < (b.line, b.i) AND a.x2 IS NOT NULL AND b.x2 IS NOT NULL AND a.x <= b.x2 AND b.x <= a.x2)",
    "tu AS (SELECT *, (dx * s1 - dy * s0) / (r0 * s1 - r1 * s0) AS t, (dx * r1 - dy * r0) / (r0 * s1 - r1 * s0) AS u FROM det WHERE abs(r0 * s1 - r1 * s0) >= 1e-12)",
    "x AS (SELECT l1, i1, l2, j1, ax + t * r0 AS x, ay + t * r1 AS y, (az + t * r2 + bz + u * s2) / 2 AS z FROM tu WHERE t BETWEEN 0 AND 1 AND u BETWEEN 0 AND 1)",
]


def _segments(s, d):
    from pyspark.sql import Window

    w = Window.partitionBy("line").orderBy("i")
    v = _polylines(s, d)
    v = v.select(F.struct("line", "i").alias("id"), *[F.col(c).alias(f"{c}1") for c in "xyz"], *[F.lead(c).over(w).alias(f"{c}2") for c in "xyz"])
    return v.where("x2 IS NOT NULL")


def _crossed(s, d):
    c = Q.crossings(_segments(s, d), 1.0)
    return _round(c.select(F.col("a_id.line").alias("l1"), F.col("a_id.i").alias("i1"), F.col("b_id.line").alias("l2"), F.col("b_id.i").alias("j1"), "x", "y", "z"), 5)


def _work(s, d):
    e = src.table(s, d, "nation")
    return e.select("n_nationkey", F.when(F.col("n_nationkey") % 6 > 0, F.col("n_nationkey") % 6).alias("points"), F.when(F.col("n_nationkey") % 2 == 0, F.lit(1)).alias("span"))


def _layers(s, d):
    return src.table(s, d, "supplier").select(F.col("s_suppkey").alias("layer"), F.when(F.col("s_suppkey") < 4, F.col("s_suppkey")).otherwise(5).alias("points"), F.when(F.col("s_suppkey") % 2 == 0, F.lit(1)).alias("span"))


_PLANE = " AND ".join(f"{' + '.join(f'{w}::DOUBLE * ({n} + {10 if w >= 0 else 0})' for n, w in zip('xyz', p))} + {p[3]}::DOUBLE >= 0" for p in PLANES)
_STEPS = ", ".join(f"{x}::DOUBLE" for x in U.CELL_SIZES)
_LADDER = ", ".join(f"{x}::DOUBLE" for x in U.INTERVALS)
_DRAWS = 200

ALL = {
    # finished grids
    "directional_support": (lambda s, d: U.support(_sparse(s, d)).select("row", "col", F.col("directions").cast("long").alias("directions"), "one_sided"), _q([*MEAN, *_SPARSE, *_HITS], 'SELECT r AS "row", c AS col, directions, one_sided FROM side')),
    "dtm_grid": (lambda s, d: _round(U.dtm_grid(_cells(s, d).where("n >= 10"), SIZE, 4), 5),
        _q([PTS, KEYED, _dtm("avg(z)", "d0"), *_OPEN, *_HITS, *_IDW, "dtm AS (SELECT r, c, z FROM k UNION ALL SELECT r, c, z FROM filled)", _horn(), "goal AS (SELECT greatest(quantile_cont(n, 0.5), 1) AS goal FROM k)",
            "own AS (SELECT r, c, k.z, TRUE AS measured, floor(100 * least(n / goal, 1) * n / (n + 3.0::DOUBLE) + 0.5) AS q FROM k, goal)",
            "guess AS (SELECT f.r, f.c, f.z, FALSE AS measured, floor(100 * ((1.0::DOUBLE / (1 + dist)) * (1 - least(greatest(slope, 0), 1) * 0.8::DOUBLE) * CASE WHEN one_sided THEN 0.5::DOUBLE ELSE 1 END) + 0.5) AS q FROM filled f JOIN h USING (r, c) LEFT JOIN side USING (r, c))"],
            "SELECT r AS \"row\", c AS col, round(z, 5) AS z, measured, CAST(q AS BIGINT) AS confidence, CASE WHEN q >= 66 THEN 'solid' WHEN q >= 33 THEN 'dashed' ELSE 'gap' END AS grade FROM (SELECT * FROM own UNION ALL SELECT * FROM guess)")),
    "geodesic_fill": (lambda s, d: _round(U.geodesic_fill(_sparse(s, d), SIZE, 4)), None),
    "geotiff": (lambda s, d: _round(K.tile_cells(K.geotiff_tiles(_cells(s, d), SIZE, 32633)), 2), _q(MEAN, 'SELECT r AS "row", c AS col, round(CAST(CAST(z AS FLOAT) AS DOUBLE), 2) AS z FROM dtm')),
    "relief_summary": (lambda s, d: _round(U.relief_summary(_round(G.vrm(_slopes(s, d))), _round(G.tpi(_cells(s, d), 2, _slopes(s, d))))),
        _q([f"v AS ({ORACLE_SQL['vrm']})", f"t AS ({ORACLE_SQL['tpi']})", "q AS (SELECT quantile_cont(vrm, 0.5) AS m, quantile_cont(vrm, 0.25) AS a, quantile_cont(vrm, 0.75) AS b FROM v)", "n AS (SELECT class, count(*) AS n FROM t GROUP BY class)"],
            "SELECT round(m, 6) AS vrm_median, round(a, 6) AS vrm_p25, round(b, 6) AS vrm_p75, CASE WHEN m < 0.002 THEN 'low' WHEN m < 0.02 THEN 'moderate' WHEN m < 0.1 THEN 'high' ELSE 'very-high' END AS band, (SELECT class FROM n ORDER BY n DESC, class LIMIT 1) AS dominant, (SELECT round(max(n) / sum(n), 6) FROM n) AS share FROM q")),
    "grid_budget": (lambda s, d: U.grid_budget(_sizes(s, d)).select("o_orderkey", "cells", "bytes", "verdict"),
        _q(["z AS (SELECT o_orderkey, o_orderkey - 5 AS cols, o_custkey * CASE WHEN o_orderkey % 7 = 0 THEN 1000 ELSE 10 END AS rows FROM orders)", "n AS (SELECT o_orderkey, cols > 0 AND rows > 0 AS good, CASE WHEN cols > 0 AND rows > 0 THEN CAST(cols AS DOUBLE) * rows ELSE 0 END AS cells FROM z)"],
            "SELECT o_orderkey, cells, cells * 20 AS bytes, CASE WHEN NOT good OR cells >= 268435456 THEN 'blocked' WHEN cells > 16000000 OR cells * 20 > 536870912 THEN 'coarsen' ELSE 'ready' END AS verdict FROM n")),
    "grid_recommendation": (lambda s, d: _round(U.grid_recommendation(_extents(s, d)).select("class", "spacing", "cell", "interval", "feasible")),
        _q([PTS, "e AS (SELECT class, count(*) AS n, (max(x) - min(x)) * CASE class WHEN 4 THEN 1000 WHEN 5 THEN 0.01 ELSE 1 END AS w, (max(y) - min(y)) * CASE class WHEN 4 THEN 1000 WHEN 5 THEN 0.01 ELSE 1 END AS h, (max(z) - min(z)) * CASE class WHEN 4 THEN 1000 ELSE 1 END AS relief FROM pts GROUP BY class)",
            f"f AS (SELECT *, sqrt(w * h / n) AS sp, list_filter([{_STEPS}], lambda x: (w / x) * (h / x) <= 4000000) AS ok FROM e)", f"g AS (SELECT *, coalesce(list_min(list_filter([{_STEPS}], lambda x: x >= sp * 2.5)), 20) AS want FROM f)"],
            f"SELECT class, round(sp, 6) AS spacing, CASE WHEN len(ok) = 0 THEN 20 WHEN (w / want) * (h / want) <= 4000000 THEN want ELSE list_min(ok) END AS cell, CASE WHEN relief > 0 THEN coalesce(list_min(list_filter([{_LADDER}], lambda x: x >= relief / 15)), 50) ELSE 1 END AS interval, len(ok) > 0 AS feasible FROM g")),
    # structure of points, resampling
    "structure": (lambda s, d: _structured(s, d).groupBy("structure").agg(F.count("*").alias("n")), None),
    "block_bootstrap": (lambda s, d: _round(C.block_bootstrap(_value_blocks(s, d), _DRAWS)),
        _q([PTS, "b AS (SELECT row_number() OVER (ORDER BY CAST(floor(x / 5) AS BIGINT)) - 1 AS place, sum(z) AS s, count(*) AS n FROM pts GROUP BY CAST(floor(x / 5) AS BIGINT))", "k AS (SELECT count(*) AS k, sum(s) / sum(n) AS e, CAST(sum(n) AS BIGINT) AS n FROM b)",
            f"d AS (SELECT i, CAST(('0x' || substr(md5('1:' || i || ':' || j), 1, 12)) AS BIGINT) % k AS place FROM (SELECT i, k, unnest(range(k)) AS j FROM k, (SELECT unnest(range({_DRAWS})) AS i)))", "m AS (SELECT i, sum(s) / sum(n) AS m FROM d JOIN b USING (place) GROUP BY i)"],
            "SELECT 'estimated' AS status, any_value(k.n) AS n, any_value(k) AS blocks, round(any_value(e), 6) AS estimate, round(quantile_cont(m, 0.05), 6) AS lower, round(quantile_cont(m, 0.95), 6) AS upper, round(stddev_samp(m), 6) AS error FROM m, (SELECT k, e, n FROM k) k")),
    # facts of a stream
    "in_frustum": (lambda s, d: N.in_frustum(_boxes(s, d), PLANES).select("point_id"), _q([PTS], f"SELECT point_id FROM pts WHERE {_PLANE}")),
    "stream_budgets": (lambda s, d: N.budgets(_tiers(s, d)).drop("tier", "device"),
        _q(["t AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'low' WHEN 1 THEN 'high' ELSE 'balanced' END AS quality, event_id % 3 = 0 AS small FROM events)"],
            "SELECT event_id, quality, CASE WHEN small THEN CASE quality WHEN 'low' THEN 600000 WHEN 'high' THEN 2000000 ELSE 1200000 END ELSE CASE quality WHEN 'low' THEN 1500000 WHEN 'high' THEN 8000000 ELSE 2500000 END END AS points, CASE WHEN small THEN 2 ELSE 4 END AS decodes, CASE WHEN small THEN 16777216 ELSE 50331648 END AS cache, quality <> 'low' AS shading, quality <> 'low' AND NOT small AS fade FROM t")),
    "admission": (lambda s, d: N.admission(_ticks(s, d)).select("event_id", "may_fetch", "may_decode", "lagging", "next_fetches", "next_decodes"),
        _q([_TICKS, "l AS (SELECT *, busy >= 9 OR p >= 36 AS lag FROM k)"],
            "SELECT event_id, f < 6 AND q < 16 AS may_fetch, d < 3 AND p < 48 AS may_decode, lag AS lagging, CASE WHEN lag OR fail >= 10 THEN greatest(f - 1, 1) WHEN rtt <= 150 AND fail <= 2 AND w > 0 AND f < 6 THEN f + 1 ELSE f END AS next_fetches, CASE WHEN p >= 48 THEN greatest(d - 1, 1) WHEN NOT lag AND w > 0 AND d < 3 THEN d + 1 ELSE d END AS next_decodes FROM l")),
    "readiness": (lambda s, d: _round(N.readiness(_facts(s, d)).select("event_id", "phase", "fraction", "churn")),
        _q(["f AS (SELECT event_id, event_id % 40 AS w, event_id % 41 AS r, event_id % 3 AS i, event_id % 2 AS q, event_id % 5 - 1 AS d, CASE WHEN event_id % 17 > 0 THEN event_id % 4 END AS e FROM events)", "g AS (SELECT *, d >= 0 AND e IS NOT NULL AS good FROM f)"],
            "SELECT event_id, CASE WHEN NOT good THEN NULL WHEN w = 0 THEN 'unknown' WHEN i + q + d = 0 AND r >= w AND e = 0 THEN 'settled' WHEN i + q + d > 0 AND least(r / w, 1) >= 0.95 THEN 'settling' ELSE 'loading' END AS phase, CASE WHEN good AND w > 0 THEN round(least(r / w, 1), 6) END AS fraction, CASE WHEN good AND w > 0 THEN round((i + q) / w, 6) END AS churn FROM g")),
    "grade_coverage": (lambda s, d: _round(N.coverage(_plans(s, d)).select("l_orderkey", "l_linenumber", "scope", "percent", "scale")),
        _q(["p AS (SELECT l_orderkey, l_linenumber, greatest(l_orderkey % 50 - 1, 0) AS s, l_orderkey % 70 AS t, l_orderkey % 6 = 0 AS exact FROM lineitem)"],
            "SELECT l_orderkey, l_linenumber, CASE WHEN exact THEN 'exhaustive' ELSE 'sampled' END AS scope, CASE WHEN t > 0 THEN CAST(floor(least(s / t, 1) * 100 + 0.5) AS INTEGER) ELSE 0 END AS percent, CASE WHEN exact OR s <= 0 THEN 1.0 ELSE round(greatest(t / s, 1), 6) END AS scale FROM p")),
    "terrain_sample": (lambda s, d: N.terrain_sample(_chunks(s, d), 200),
        _q(["c AS (SELECT event_type AS key, user_id % 3 AS chunk, event_id AS i, CAST(user_id AS DOUBLE) AS x, value AS z FROM events WHERE user_id IS NOT NULL AND event_type IS NOT NULL)", "f AS (SELECT * FROM c JOIN (SELECT key, min(chunk) AS chunk FROM c GROUP BY key) USING (key, chunk))", "g AS (SELECT *, row_number() OVER (ORDER BY key, i) - 1 AS place, greatest(ceil(count(*) OVER () / 200), 1) AS stride FROM f)"],
            "SELECT key, i, x, 1.0::DOUBLE AS y, z, CASE WHEN i % 2 = 0 THEN 2 ELSE 255 END AS class FROM g WHERE place % CAST(stride AS BIGINT) = 0 AND z IS NOT NULL AND isfinite(z)")),
    "load_plan": (lambda s, d: N.load_plan(src.table(s, d, "orders").select("o_orderkey", (F.col("o_custkey") * 100_000).alias("count"))).select("o_orderkey", "mode", "stride", "target"),
        _q(["c AS (SELECT o_orderkey, o_custkey * 100000 AS n FROM orders)"], "SELECT o_orderkey, CASE WHEN n <= 4000000 THEN 'all' WHEN n <= 12000000 THEN 'voxel' ELSE 'stride' END AS mode, CASE WHEN n <= 12000000 THEN 1 ELSE (n + 11999999) // 12000000 END AS stride, least(n, 4000000) AS target FROM c")),
    "clamped_range": (lambda s, d: N.clamped_range(src.table(s, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 50 - 2).alias("offset"), (F.col("o_custkey") % 30 - 1).alias("length"), F.lit(40).alias("size"))).select("o_orderkey", "bytes"),
        "SELECT o_orderkey, CASE WHEN o_orderkey % 50 >= 2 AND o_custkey % 30 >= 1 AND o_orderkey % 50 - 2 <= 40 THEN least(o_custkey % 30 - 1, 42 - o_orderkey % 50) END AS bytes FROM orders"),
    # picks, snaps, owners, reports
    "pick": (lambda s, d: _round(Q.pick(pts(s, d), (-50.0, -20.0, 10.0), (1.0, 2.0, 0.1), "class")),
        _q([PTS, "v AS (SELECT point_id, class, x + 50 AS a, y + 20 AS b, z - 10 AS c, ((x + 50) + (y + 20) * 2 + (z - 10) * 0.1::DOUBLE) / sqrt(5.01::DOUBLE) AS along FROM pts)", "h AS (SELECT *, sqrt(greatest(a * a + b * b + c * c - along * along, 0)) / along AS score FROM v WHERE along > 0)"],
            "SELECT point_id, round(score, 6) AS score, class < (SELECT max(class) FROM pts) AS refining FROM h WHERE score < 0.07 ORDER BY score, point_id LIMIT 1")),
    "crossings": (_crossed, _q(_LINES, "SELECT l1, i1, l2, j1, round(x, 5) AS x, round(y, 5) AS y, round(z, 5) AS z FROM x")),
    "snaps": (lambda s, d: _round(Q.snapped(_asked(s, d), _marks(s, d), _polylines(s, d), 1.5).select("point_id", "kind", "distance"), 5),
        _q([*_LINES, "q AS (SELECT c_custkey AS id, CAST(c_custkey % 83 AS DOUBLE) AS x, c_acctbal / 500.0::DOUBLE AS y, 2.0::DOUBLE AS z FROM customer)",
            "c AS (SELECT 0 AS k, s_suppkey % 83 + 0.25::DOUBLE AS x, s_acctbal / 500.0::DOUBLE AS y, 2.0::DOUBLE AS z FROM supplier UNION ALL SELECT 1, x, y, z FROM w UNION ALL SELECT 2, (x + x2) / 2, (y + y2) / 2, (z + z2) / 2 FROM s WHERE x2 IS NOT NULL UNION ALL SELECT 3, x, y, z FROM x)",
            "d AS (SELECT id, k, min(sqrt((q.x - c.x) ** 2 + (q.y - c.y) ** 2 + (q.z - c.z) ** 2)) AS d FROM q JOIN c ON c.x BETWEEN q.x - 1.5 AND q.x + 1.5 AND c.y BETWEEN q.y - 1.5 AND q.y + 1.5 GROUP BY id, k)"],
            "SELECT id AS point_id, ['point', 'endpoint', 'midpoint', 'intersection'][CAST(arg_min(k, [d + k * 1e-6, k]) AS INTEGER) + 1] AS kind, round(arg_min(d, [d + k * 1e-6, k]), 5) AS distance FROM d WHERE d <= 1.5 GROUP BY id")),
    "owners": (lambda s, d: Q.owners(_work(s, d), _layers(s, d), ["points", "span"]).select("n_nationkey", "layer", "reason"),
        _q(["w AS (SELECT n_nationkey, nullif(n_nationkey % 6, 0) AS p, CASE WHEN n_nationkey % 2 = 0 THEN 1 END AS q FROM nation)", "l AS (SELECT CASE WHEN s_suppkey < 4 THEN s_suppkey ELSE 5 END AS p, CASE WHEN s_suppkey % 2 = 0 THEN 1 END AS q, s_suppkey AS layer FROM supplier)", "j AS (SELECT n_nationkey, w.p, w.q, count(layer) AS n, min(layer) AS layer FROM w LEFT JOIN l ON l.p IS NOT DISTINCT FROM w.p AND l.q IS NOT DISTINCT FROM w.q GROUP BY ALL)"],
            "SELECT n_nationkey, CASE WHEN n = 1 AND (p IS NOT NULL OR q IS NOT NULL) THEN layer END AS layer, CASE WHEN p IS NULL AND q IS NULL THEN 'filename-only' WHEN n = 0 THEN 'no-match' WHEN n > 1 THEN 'ambiguous' END AS reason FROM j")),
    "page_places": (lambda s, d: _round(Q.page_places(pts(s, d), (20.0, 5.0, 120.0, 45.0), (36.0, 48.0), 2.5, "y").select("point_id", "page_x", "page_y", "inside")),
        _q([PTS], "SELECT point_id, round(36 + (x - 20) * 2.5, 6) AS page_x, round(48 + (-z - 5) * 2.5, 6) AS page_y, x BETWEEN 20 AND 120 AND -z BETWEEN 5 AND 45 AS inside FROM pts")),
    "lasso_volume": (lambda s, d: _round(Q.lasso_volume(pts(s, d).where("class = 6")), 2), None),
    "scan_report": (lambda s, d: _round(Q.scan_report(pts(s, d), [2, 6], 0.3048), 5),
        _q([PTS, "r AS (SELECT count(*) AS n, (max(x) - min(x)) * 0.3048::DOUBLE AS w, (max(y) - min(y)) * 0.3048::DOUBLE AS d, (max(z) - min(z)) * 0.3048::DOUBLE AS h FROM pts WHERE class IN (2, 6))"],
            "SELECT n, round(w, 5) AS width, round(d, 5) AS depth, round(h, 5) AS height, round(w * d, 5) AS footprint, round(n / (w * d), 5) AS density, round(sqrt(w * d / n), 5) AS spacing FROM r")),
    "probes": (lambda s, d: _round(Q.probed(_cells(s, d), src.table(s, d, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 700).cast("double").alias("x"), (F.col("c_custkey") % 611).cast("double").alias("y")), SIZE).select("id", "z", "n")),
        _q([*MEAN, "a AS (SELECT c_custkey AS id, CAST(floor((c_custkey % 700) / 10.0::DOUBLE) AS BIGINT) AS c, CAST(floor((c_custkey % 611) / 10.0::DOUBLE) AS BIGINT) AS r FROM customer)"], "SELECT id, round(z, 6) AS z, n FROM a LEFT JOIN dtm USING (r, c)")),
    "epoch_comparison": (lambda s, d: _round(Q.epoch_comparison(*_epochs(s, d), SIZE, 1.0, {"shift": (6.0, 0.0), "crs": ("A", "B"), "unit": 1.0}), 4),
        _q([*_EPOCHS, _DIFF], "SELECT count(*) AS cells, round(sum(CASE WHEN diff > 1 THEN diff * 100 ELSE 0 END), 4) AS gain, round(sum(CASE WHEN diff < -1 THEN -diff * 100 ELSE 0 END), 4) AS loss, round(sum(CASE WHEN abs(diff) > 1 THEN diff * 100 ELSE 0 END), 4) AS net, round(avg(abs(diff)), 4) AS mean_abs, round(min(diff), 4) AS lowest, round(max(diff), 4) AS highest, 'offset,crs-differs,datum-unknown' AS notes, FALSE AS coregistered FROM diff")),
    "trusted_ground": (lambda s, d: Q.trusted_ground(src.table(s, d, "events").select("event_id", F.col("value").alias("x"), F.lit(0.0).alias("y"), F.col("user_id").cast("double").alias("z"), (F.col("event_id") % 3).alias("class")), [1, 2]).select("event_id", "is_ground"),
        "SELECT event_id, value IS NOT NULL AND isfinite(value) AND user_id IS NOT NULL AND event_id % 3 IN (1, 2) AS is_ground FROM events"),
    "cells_by": (lambda s, d: _round(Q.cells_by(pts(s, d), SIZE, {"spread": F.stddev_pop("z"), "classes": F.count_distinct("class"), "brightest": F.max("intensity")}), 5), _q([PTS, KEYED], 'SELECT r AS "row", c AS col, round(stddev_pop(z), 5) AS spread, count(DISTINCT class) AS classes, max(intensity) AS brightest FROM keyed GROUP BY r, c')),
    "object_box": (lambda s, d: _round(Q.object_box(pts(s, d)), 2), None),
    "utm_inverse": (lambda s, d: _round(_bare(s, d), 6), _q([PTS, *_UTM], "SELECT point_id, round(lat, 6) AS lat, round(lon, 6) AS lon FROM u")),
    "late_guard": (lambda s, d: N.guarded(src.table(s, d, "events").select("event_id", F.col("value").alias("scale"), (F.col("event_id") % 2).cast("double").alias("shift"), F.col("user_id").cast("double").alias("origin"))).select("event_id"), "SELECT event_id FROM events WHERE value IS NOT NULL AND isfinite(value) AND value <> 0 AND user_id IS NOT NULL"),
    "frame_times": (lambda s, d: _round(N.frame_times(pts(s, d), "class", "z")), _q([PTS], "SELECT class, count(*) AS n, round(avg(z), 6) AS mean, round(quantile_cont(z, 0.5), 6) AS median, round(quantile_cont(z, 0.95), 6) AS p95, round(max(z), 6) AS longest FROM pts GROUP BY class")),
    "points_ply": (lambda s, d: W.ply_lines(pts(s, d).select("point_id", F.col("x"), F.col("class").cast("double").alias("y"), F.lit(0.5).alias("z"))),
        _q([PTS], "SELECT point_id AS ord, printf('%.3f %.3f 0.500', x, CAST(class AS DOUBLE)) AS value FROM pts UNION ALL SELECT CAST(unnest(range(-7, 0)) AS BIGINT), unnest(['ply', 'format ascii 1.0', 'element vertex ' || (SELECT count(*) FROM pts), 'property double x', 'property double y', 'property double z', 'end_header'])")),
}

QUERIES = {k: q for k, (q, _) in ALL.items()}
ORACLE_SQL = {k: sql for k, (_, sql) in ALL.items() if sql}
