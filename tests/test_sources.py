import struct

import numpy as np
import pytest

from talus.operators import contours as C
from talus.operators import grid as G
from talus.operators import ground as R
from talus.sources import binary as B


def test_las_round_trip(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = [(i, float(x), float(y), float(z), int(k % 200), 2 + int(k % 4), int(k % 256), 0, 255) for i, (x, y, z, k) in enumerate(zip(*rng.uniform(0, 900, (3, 50)), rng.integers(0, 999, 50)))]
    df = spark.createDataFrame(rows, "point_id long, x double, y double, z double, intensity int, class int, r int, g int, b int")
    for r in B.las_files(df, 20).collect():
        (tmp_path / f"{r.part}.las").write_bytes(bytes(r.content))
    got = B.read_scans(spark, str(tmp_path)).collect()
    got_rows = sorted((r.x, r.y, r.z, r.intensity, r["class"], r.r, r.b) for r in got)
    for g, w in zip(got_rows, sorted(t[1:4] + (t[4], t[5], t[6], t[8]) for t in rows), strict=True):
        assert g[:3] == pytest.approx(w[:3], abs=6e-4) and g[3:] == w[3:]
    assert len({r.path for r in got}) == 3 and {r.return_count for r in got} == {1}


def test_las_refuses_what_it_cannot_hold():
    data = B.encode_las({c: np.array([1.0, 2.0]) for c in "xyz"})
    assert B.sniff(data) == "las" and B.las_header(data)["count"] == 2
    with pytest.raises(ValueError, match="declares"):
        B.las_header(data[:-1])
    with pytest.raises(ValueError, match="not a LAS"):
        B.las_header(b"nothing")
    packed = bytearray(data)
    packed[104] |= 0x80
    assert B.sniff(bytes(packed)) == "laz"
    with pytest.raises(ValueError, match="compressed"):
        B.las_header(bytes(packed))


def test_ply_and_pcd(spark, tmp_path):
    head = "ply\nformat {}\nelement vertex 2\nproperty float x\nproperty float y\nproperty float z\nproperty uchar red\nproperty uchar green\nproperty uchar blue\nend_header\n"
    (tmp_path / "a.ply").write_bytes(head.format("ascii 1.0").encode() + b"1 2 3 10 20 30\n4 5 nan 1 2 3\n")
    (tmp_path / "b.ply").write_bytes(head.format("binary_little_endian 1.0").encode() + struct.pack("<3f3B3f3B", 1, 2, 3, 10, 20, 30, 4, 5, 6, 1, 2, 3))
    pcd = "# .PCD v0.7\nVERSION 0.7\nFIELDS x y z intensity\nSIZE 4 4 4 4\nTYPE F F F F\nCOUNT 1 1 1 1\nWIDTH 2\nHEIGHT 1\nPOINTS 2\nDATA {}\n"
    (tmp_path / "c.pcd").write_bytes(pcd.format("ascii").encode() + b"1 2 3 9\n4 5 6 8\n")
    (tmp_path / "d.pcd").write_bytes(pcd.format("binary").encode() + struct.pack("<8f", 1, 2, 3, 9, 4, 5, 6, 8))
    got = {}
    for r in B.read_scans(spark, str(tmp_path)).collect():
        got.setdefault(r.path[-5:], []).append((r.x, r.y, r.z, r.r, r.intensity))
    assert got["a.ply"] == [(1, 2, 3, 10, None)]
    assert got["b.ply"] == [(1, 2, 3, 10, None), (4, 5, 6, 1, None)]
    assert got["c.pcd"] == got["d.pcd"] == [(1, 2, 3, None, 9), (4, 5, 6, None, 8)]


def test_sniffing_and_hierarchies(spark, tmp_path):
    assert [B.sniff(b"ASTM-E57"), B.sniff(b"glTF"), B.sniff(b"1 2 3", "a.csv"), B.sniff(b"?", "a.bin")] == ["e57", "glb", "xyz", "unknown"]
    assert B.copc_nodes(struct.pack("<4iQii", 1, 0, 1, 0, 99, 7, -1)) == [(1, 0, 1, 0, 99, 7, -1)]
    (tmp_path / "h.json").write_text('{"0-0-0-0": 50, "1-0-1-0": -1}')
    assert sorted((r.key, r.depth, r.point_count) for r in B.ept_nodes(spark, f"{tmp_path}/h.json").collect()) == [("0-0-0-0", 0, 50), ("1-0-1-0", 1, -1)]


def test_ground_under_a_building(spark):
    pts = [(i * 40 + j, i + 0.5, j + 0.5, 0.02 * i + (8.0 if 15 <= i < 20 and 15 <= j < 20 else 0.0)) for i in range(40) for j in range(40)]
    got = R.ground(spark.createDataFrame(pts, "point_id long, x double, y double, z double"), 1.0).collect()
    assert all(r.is_ground == (r.z < 5) for r in got) and len(got) == 1600


def test_holes_are_filled_from_their_rings(spark):
    cells = spark.createDataFrame([(r, c, 5.0, 3) for r in range(7) for c in range(7) if (r, c) != (3, 3)], "row long, col long, z double, n long")
    assert [(r.row, r.col, r.z, r.found) for r in R.idw_fill(cells).collect()] == [(3, 3, pytest.approx(5.0), 48)]
    assert R.nearest_fill(cells, 2).count() == 49
    assert R.idw_fill(cells.limit(0)).count() == 0


def test_a_hill_has_closed_lines(spark):
    from pyspark.sql import functions as F

    cells = spark.range(400).select((F.col("id") / 20).cast("long").alias("row"), (F.col("id") % 20).alias("col"))
    cells = cells.withColumn("z", 8 * F.exp(-((F.col("row") - 9.6) ** 2 + (F.col("col") - 9.4) ** 2) / 30)).withColumn("n", F.lit(9))
    lines = C.polylines(G.contour_segments(cells, 1.0, 2.0)).collect()
    assert {r.level for r in lines} == {2.0, 4.0, 6.0} and all(r.closed for r in lines) and len(lines) == 3
    assert all(len(r.xs) > 8 and r.xs[0] == pytest.approx(r.xs[-1]) for r in lines)
    smooth = C.smoothed(spark.createDataFrame(lines), 1).collect()
    assert all(r.closed and len(r.xs) == 2 * (len(o.xs) - 1) + 1 for r, o in zip(sorted(smooth, key=lambda r: r.level), sorted(lines, key=lambda r: r.level)))
