"""Picks, snaps, hull volumes and boxes against small brute force."""

import numpy as np
import pytest

from talus.operators import picks as Q


def test_pick_refuses_and_misses(spark):
    df = spark.createDataFrame([(1, 10.0, 0.0, 0.0, 2), (2, 10.0, 0.1, 0.0, 3), (3, -5.0, 0.0, 0.0, 5), (4, 0.0, 0.0, 0.0, 1)], "point_id long, x double, y double, z double, depth int")
    assert [tuple(r) for r in Q.pick(df, (0, 0, 0), (2, 0, 0), "depth").collect()] == [(1, 0.0, True)]
    assert Q.pick(df, (0, 0, 0), (0, 0, 1)).count() == 0 and Q.pick(df.where("false"), (0, 0, 0), (1, 0, 0)).count() == 0
    with pytest.raises(ValueError, match="direction"):
        Q.pick(df, (0, 0, 0), (0, 0, 0))


def test_crossings_do_not_depend_on_the_cells(spark):
    rng = np.random.default_rng(5)
    rows = [(i, *map(float, rng.integers(0, 12, 6))) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, x1 double, y1 double, z1 double, x2 double, y2 double, z2 double")
    got = [sorted((r.a_id, r.b_id, round(r.x, 6), round(r.y, 6), round(r.z, 6)) for r in Q.crossings(df, c).collect()) for c in (1.0, 3.0, 100.0)]
    assert got[0] == got[1] == got[2] and len(got[0]) == len({t[:2] for t in got[0]}) > 100


def test_snaps_prefer_points(spark):
    asked = spark.createDataFrame([(1, 0.0, 0.0, 0.0), (2, 5.0, 0.0, 0.0), (3, 5.0, 0.1, 0.0), (4, 90.0, 0.0, 0.0), (5, 2.5, 0.1, 0.0)], "point_id long, x double, y double, z double")
    pts = spark.createDataFrame([(0.0, 0.0, 0.5)], "x double, y double, z double")
    lines = spark.createDataFrame([(1, 0, 0.0, 0.5, 0.0), (1, 1, 10.0, 0.5, 0.0), (2, 0, 2.5, -5.0, 2.0), (2, 1, 2.5, 5.0, 2.0)], "line int, i int, x double, y double, z double")
    got = {r.point_id: (r.kind, r.x, r.y, r.z) for r in Q.snapped(asked, pts, lines, 1.2).collect()}
    assert got == {1: ("point", 0.0, 0.0, 0.5), 2: ("midpoint", 5.0, 0.5, 0.0), 3: ("midpoint", 5.0, 0.5, 0.0), 5: ("intersection", 2.5, 0.5, 1.0)}


def test_snaps_do_not_broadcast_exploded_rows(spark, tmp_path):
    """The files are far under the broadcast limit, but 27 rows went to the driver for each of theirs."""
    spark.range(20000).selectExpr("id AS point_id", "cast(id % 83 AS double) AS x", "id / 1000 AS y", "2.0D AS z").write.parquet(f"{tmp_path}/asked")
    spark.range(900).selectExpr("id % 83 + 0.25D AS x", "id / 50 AS y", "2.0D AS z").write.parquet(f"{tmp_path}/pts")
    asked, pts = spark.read.parquet(f"{tmp_path}/asked"), spark.read.parquet(f"{tmp_path}/pts")
    lines = spark.createDataFrame([(1, i, float(i), 5.0 + i % 7, 2.0) for i in range(80)], "line int, i int, x double, y double, z double")
    few, many = Q.snapped(asked, pts, lines, 1.5), Q.snapped(asked.where("point_id < 500"), pts, lines, 1.5)
    for df in (few, many):
        plan = df._jdf.queryExecution().executedPlan().toString()
        joins = [line for line in plan.split("\n") if "Join" in line and "kz" in line]
        assert joins and all("SortMergeJoin" in line for line in joins)
    some = {r.point_id: tuple(r) for r in few.where("point_id < 500").collect()}
    assert {r.point_id: tuple(r) for r in many.collect()} == some and len(some) > 100


def test_lasso_volume(spark):
    rows = [(i, float(i % 11), float(i // 11), 5.0 if i % 11 < 5 else 7.0) for i in range(121)]
    df = spark.createDataFrame(rows, "point_id long, x double, y double, z double")
    r = Q.lasso_volume(df, 0.0).first()
    assert (r.validity, r.base, r.n, r.footprint) == ("ok", 5.0, 121, 100.0) and r.fill == pytest.approx(2 * 66 / 121 * 100) and r.cut == 0
    assert Q.lasso_volume(df.where("y = 0")).first().validity == "too-few-vertices"
    assert Q.lasso_volume(df.where("false")).first().n == 0


def test_object_box(spark):
    rng = np.random.default_rng(8)
    turn, _ = np.linalg.qr(rng.normal(size=(3, 3)))
    p = rng.uniform(-1, 1, (3000, 3)) * [10, 4, 1] @ turn.T
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(p)], "point_id long, x double, y double, z double")
    r = Q.object_box(df).first()
    _, axes = np.linalg.eigh(np.cov(p.T, bias=True))
    sides = np.sort(np.ptp((p - p.mean(0)) @ axes, axis=0))[::-1]
    assert (r.length, r.width, r.height) == pytest.approx(tuple(sides)) and r.volume == pytest.approx(sides.prod())
    assert 20 < r.completeness <= 100
    assert Q.object_box(df.limit(3)).first().length == 0.0 and Q.object_box(df.where("false")).first().n == 0
