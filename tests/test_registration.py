import math

import numpy as np
import pytest

from talus.operators import registration as R

KIND = "point_id long, x double, y double, z double"


def turn(angle, axis):
    c, s = math.cos(angle), math.sin(angle)
    return np.array({"z": [[c, -s, 0], [s, c, 0], [0, 0, 1]], "x": [[1, 0, 0], [0, c, -s], [0, s, c]]}[axis])


def cloud(spark, x):
    return spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(x)], KIND)


def test_tie_points_are_solved_exactly(spark):
    x = np.random.default_rng(1).uniform(-5, 5, (30, 3))
    r, t = turn(0.7, "z") @ turn(0.3, "x"), np.array([1.0, -2.0, 3.0])
    pairs = spark.createDataFrame([tuple(map(float, np.r_[a, b])) for a, b in zip(x, x @ r.T + t)], "x double, y double, z double, tx double, ty double, tz double")
    got = R.rigid_solve(pairs)
    assert np.allclose(got["rotation"], r) and np.allclose(got["translation"], t) and got["rmse"] < 1e-6
    with pytest.raises(ValueError, match="needed"):
        R.rigid_solve(pairs.limit(2))
    line = spark.createDataFrame([tuple(float(i * k) for k in (1, 2, 3, 1, 2, 3)) for i in range(9)], "x double, y double, z double, tx double, ty double, tz double")
    with pytest.raises(ValueError, match="line"):
        R.rigid_solve(line)


def test_icp_finds_a_small_motion(spark):
    g = np.array([(i, j, math.sin(i) + math.cos(0.7 * j)) for i in range(12) for j in range(12)], float)
    r, t = turn(0.02, "z"), np.array([0.1, -0.05, 0.08])
    got = R.icp(cloud(spark, g), cloud(spark, g @ r.T + t), 1.0, rounds=6, trim=1.0)
    assert np.allclose(got["rotation"], r, atol=1e-4) and np.allclose(got["translation"], t, atol=1e-3)


def test_hull_of_a_square_with_points_inside(spark):
    x = [(0, 0, 0), (4, 0, 0), (4, 4, 0), (0, 4, 0), (2, 0, 0)] + [(1 + i % 3, 1 + i % 2, 0) for i in range(20)]
    got = [(r.x, r.y) for r in sorted(R.convex_hull(cloud(spark, x).repartition(4)).collect(), key=lambda r: r.i)]
    assert got == [(0, 0), (4, 0), (4, 4), (0, 4)]


def test_shapes_of_neighbourhoods(spark):
    wire = [(0.1 * i, 0, 0) for i in range(11)]
    plane = [(50 + 0.1 * i, 0.1 * j, 0) for i in range(11) for j in range(11)]
    got = {r.point_id: r for r in R.descriptors(cloud(spark, wire + plane), 0.35).collect()}
    assert got[5].linearity == pytest.approx(1) and got[5].planarity == pytest.approx(0, abs=1e-6)
    assert got[11 + 60].planarity == pytest.approx(1) and got[11 + 60].sphericity == pytest.approx(0, abs=1e-6)


def test_sagging_wire(spark):
    x = [(s, 2 * s, 10 + 0.01 * (s - 20) ** 2) for s in np.linspace(0, 40, 81)]
    got = R.conductor(cloud(spark, x))
    assert got["span"] == pytest.approx(40 * math.sqrt(5)) and got["sag"] == pytest.approx(4.0) and got["rms"] < 1e-5
    with pytest.raises(ValueError, match="no line"):
        R.conductor(cloud(spark, [(i % 5, i // 5, 0) for i in range(25)]))
