"""Filled grids, structure and resampling against brute force; rasters and scan files by round trips."""

import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from talus.operators import ground as R
from talus.operators import registration as T
from talus.operators import surface as U
from talus.operators import validate as C
from talus.sources import binary as B
from talus.sources import rasters as K


@pytest.fixture(scope="module")
def cells(spark):
    rng = np.random.default_rng(4)
    rows = [(int(r), int(c), float(rng.normal(0, 3)), 1 + int(rng.integers(9))) for r in range(50, 80) for c in range(-10, 15) if rng.random() < 0.25]
    return spark.createDataFrame(rows, "row long, col long, z double, n long")


def shortest(z, known, at, size, reach):
    """Costs of ways from one hole by relaxing all steps until nothing changes."""
    cost = {at: 0.0}
    changed = True
    while changed:
        changed = False
        for (r, c), w in list(cost.items()):
            if known.get((r, c)):
                continue
            for dr in (-1, 0, 1):
                for dc in (-1, 0, 1):
                    to = (r + dr, c + dc)
                    if to == (r, c) or to not in z or max(abs(to[0] - at[0]), abs(to[1] - at[1])) > reach:
                        continue
                    way = w + math.sqrt((size * math.hypot(dr, dc)) ** 2 + (z[to] - z[r, c]) ** 2)
                    if way < cost.get(to, math.inf) - 1e-12:
                        cost[to], changed = way, True
    return cost


def test_geodesic_fill_is_that_of_all_ways(spark, cells):
    reach, size = 3, 2.0
    ground = {(r.row, r.col): r.z for r in cells.collect()}
    known = dict.fromkeys(ground, True)
    z = ground | {(r.row, r.col): r.z for r in R.idw_fill(cells, reach, 5).collect()}
    got = {(r.row, r.col): r.z for r in U.geodesic_fill(cells, size, reach, 5).collect()}
    assert got.keys() == z.keys()
    for at in z:
        if at in ground:
            assert got[at] == ground[at]
            continue
        near = sorted((w, *k) for k, w in shortest(z, known, at, size, reach).items() if known.get(k))[:5]
        want = sum(ground[r, c] / w**2 for w, r, c in near) / sum(1 / w**2 for w, _, _ in near)
        assert got[at] == pytest.approx(want, abs=1e-9)


def test_fill_of_nothing_and_of_one_cell(spark, cells):
    assert U.geodesic_fill(cells.where("false"), 1.0, 2).count() == 0
    assert U.dtm_grid(cells.where("false"), 1.0).count() == 0
    assert U.support(cells.where("false")).count() == 0
    one = spark.createDataFrame([(0, 0, 1.0, 3)], "row long, col long, z double, n long")
    assert [tuple(r) for r in U.dtm_grid(one, 1.0).collect()] == [(0, 0, 1.0, True, 50, "dashed")]


def test_support_names_open_sides(spark):
    df = spark.createDataFrame([(0, 0, 1.0), (0, 4, 1.0), (4, 0, 1.0), (4, 4, 1.0)], "row long, col long, z double")
    got = {(r.row, r.col): (r.directions, r.one_sided) for r in U.support(df, 4).collect()}
    assert got[2, 2] == (4, False) and got[0, 2] == (2, False) and got[1, 1] == (2, False)
    corner = U.support(df.where("row = 0 OR col = 0"), 4).collect()
    assert {(r.row, r.col): r.one_sided for r in corner}[2, 2] is False
    alone = U.support(spark.createDataFrame([(0, 0, 1.0), (0, 1, 1.0), (2, 0, 1.0)], "row long, col long, z double"), 4)
    assert {(r.row, r.col): (r.directions, r.one_sided) for r in alone.collect()}[2, 1] == (2, True)


def test_descriptors_and_structure(spark):
    rng = np.random.default_rng(2)
    wall = np.column_stack([rng.uniform(0, 1, 60), np.zeros(60), rng.uniform(0, 1, 60)])
    floor = np.column_stack([rng.uniform(0, 1, (60, 2)) + 50, rng.normal(0, 1e-4, 60)])
    bush = rng.normal(0, 0.3, (60, 3)) + 100
    p = np.concatenate([wall, floor, bush])
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(p)], "point_id long, x double, y double, z double")
    got = {r.point_id: r for r in T.structure(T.descriptors(df, 3.0)).collect()}
    assert {got[i].structure for i in range(60)} == {"planar-vertical"} and {got[i].structure for i in range(60, 120)} == {"planar-horizontal"}
    assert {got[i].structure for i in range(120, 180)} == {"scatter"}
    values, vectors = np.linalg.eigh(np.cov(wall.T, bias=True))
    e = values[::-1].clip(0) / values.sum()
    assert got[0].planarity == pytest.approx((e[1] - e[2]) / e[0], abs=1e-6) and got[0].verticality == pytest.approx(1 - abs(vectors[2, 0]), abs=1e-6)
    near = p[120:][np.linalg.norm(p[120:] - p[120], axis=1) <= 3]
    values, vectors = np.linalg.eigh(np.cov(near.T, bias=True))
    e = values[::-1] / values.sum()
    r = got[120]
    assert (r.omnivariance, r.eigenentropy, r.anisotropy, r.verticality) == pytest.approx((np.cbrt(e.prod()), -(e * np.log(e)).sum(), (e[0] - e[2]) / e[0], 1 - abs(vectors[2, 0])), abs=1e-6)


def test_bootstrap_refuses(spark):
    df = spark.createDataFrame([(b, float(v)) for b in range(20) for v in range(b, b + 5)], "block long, value double")
    r = C.block_bootstrap(df, 400).first()
    assert r.status == "estimated" and r.lower < r.estimate < r.upper and 0.8 < r.error / (np.std(range(20)) / np.sqrt(20)) < 1.2
    assert C.block_bootstrap(df.where("block = 1"), 200).first().status == "too-few-blocks"
    assert C.block_bootstrap(df.where("false"), 200).first().status == "no-samples"
    assert C.block_bootstrap(df.withColumn("value", F.when(F.col("block") > 0, F.col("value"))), 200).first().status == "non-finite-value"
    with pytest.raises(ValueError, match="200"):
        C.block_bootstrap(df, 100)


def test_geotiff_round_trip(spark, tmp_path):
    z = np.array([[1.5, np.nan, 3.0], [4.0, 5.25, -6.0]])
    data = K.encode_geotiff(z, 2.0, 100.0, 200.0, 32633, vertical=5773)
    back, at = K.decode_geotiff(data)
    assert np.array_equal(back, z, equal_nan=True) and at == {"size": 2.0, "west": 100.0, "south": 200.0, "epsg": 32633}
    with pytest.raises(ValueError, match="TIFF"):
        K.decode_geotiff(b"nothing")
    rows = [(r, c, float(r * 100 + c)) for r in range(-3, 9) for c in range(-5, 7) if (r + c) % 3]
    df = spark.createDataFrame(rows, "row long, col long, z double")
    for r in K.geotiff_tiles(df, 0.5, tile=4).collect():
        (tmp_path / f"{r.tile_row}_{r.tile_col}.tif").write_bytes(bytes(r.content))
    assert sorted(map(tuple, K.read_geotiff(spark, str(tmp_path)).collect())) == rows


def test_las14_round_trip(spark, tmp_path):
    rows = [(i, i * 1.5, 900 - i * 0.25, i * 0.125, i * 10, 100 + i, 5 * i, 0, 255) for i in range(50)]
    df = spark.createDataFrame(rows, "point_id long, x double, y double, z double, intensity int, class int, r int, g int, b int")
    for r in B.las_files(df, 30, "1.4", 'PROJCS["x"]').collect():
        (tmp_path / f"{r.part}.las").write_bytes(bytes(r.content))
    got = sorted((r.x, r.y, r.z, r.intensity, r["class"], r.r, r.g, r.b) for r in B.read_scans(spark, str(tmp_path)).collect())
    assert got == [pytest.approx(r[1:]) for r in rows]
    plain = B.encode_las14({c: np.array([1.0, 2.0]) for c in "xyz"})
    assert B.las_header(plain)["count"] == 2


def test_ptx(spark, tmp_path):
    unity = "1 0 0 0\n0 1 0 0\n0 0 1 0\n"
    pose = "0 0 0\n1 0 0\n0 1 0\n0 0 1\n"
    first = "2\n2\n" + pose + unity + "10 20 30 1\n" + "1 2 3 0.5 255 0 7\n0 0 0 0.5 0 0 0\nbroken\n4 5 6 1 1 2 3\n"
    second = "\n1\n2\n" + pose + "0 1 0 0\n-1 0 0 0\n0 0 1 0\n0 0 0 1\n" + "1 0 2 0.25 9 9 9\n"
    (tmp_path / "a.ptx").write_text(first + second)
    got = [(r.source_id, r.x, r.y, r.z, r.intensity, r.r, r.g, r.b) for r in B.read_scans(spark, str(tmp_path)).orderBy("point_id").collect()]
    assert got == [(1, 11.0, 22.0, 33.0, 32768, 255, 0, 7), (1, 14.0, 25.0, 36.0, 65535, 1, 2, 3), (2, 0.0, 1.0, 2.0, 16384, 9, 9, 9)]
    broken = B.decode_ptx(("1\n1\n" + pose + "1 0 0\n" + unity + "3 3 3 200\n").encode())
    assert broken["x"].tolist() == [3.0] and broken["intensity"].tolist() == [200.0] and "r" not in broken
    assert len(B.decode_ptx(b"")["x"]) == 0


def test_packed_pcd():
    raw = np.array([1.0, 2.0, 1.0, 2.0], "<f4").tobytes() + np.full(4, 7.0, "<f4").tobytes() + np.arange(4, dtype="<f4").tobytes()
    literal = b"".join(bytes([len(raw[i : i + 32]) - 1]) + raw[i : i + 32] for i in range(0, len(raw), 32))
    back = bytes([7]) + raw[:8] + bytes([6 << 5, 7]) + bytes([3]) + raw[16:20] + bytes([7 << 5, 3, 3]) + bytes([15]) + raw[32:]
    head = b"FIELDS x y z\nSIZE 4 4 4\nTYPE F F F\nCOUNT 1 1 1\nWIDTH 4\nHEIGHT 1\nPOINTS 4\nDATA binary_compressed\n"
    for packed in (literal, back):
        assert B.lzf_unpack(packed, len(raw)) == raw
        got = B.decode_pcd(head + struct.pack("<II", len(packed), len(raw)) + packed)
        assert [got[c].tolist() for c in "xyz"] == [[1, 2, 1, 2], [7] * 4, [0, 1, 2, 3]]
    with pytest.raises(ValueError, match="declare"):
        B.lzf_unpack(literal, 5)
