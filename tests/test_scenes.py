"""Operators on scenes whose results are known in closed form."""

import math

import pytest
from pyspark.sql import functions as F

from talus.operators import grid as G
from talus.operators import measure as M
from talus.operators import points as P
from talus.operators import spatial as S
from talus.sources import points as src
from talus.sources import sinks
from talus.streaming import nodes as N

SIDE = 12


def scene(spark, z, side=SIDE):
    df = spark.range(side * side).select((F.col("id") / side).cast("long").alias("row"), (F.col("id") % side).alias("col"))
    return df.withColumn("z", z(F.col("col").cast("double"), F.col("row").cast("double"))).withColumn("n", F.lit(5))


def test_flat_plane(spark):
    h = G.horn(scene(spark, lambda x, y: F.lit(7.0)), 1.0).collect()
    assert all(r.slope == 0 and r.aspect == 0 for r in h)
    assert G.contour_segments(scene(spark, lambda x, y: F.lit(7.3)), 1.0, 1.0).count() == 0


def test_plane_tilted_east_is_half_at_corners(spark):
    for r in G.horn(scene(spark, lambda x, y: 0.5 * x), 1.0).collect():
        corner = r.row in (0, SIDE - 1) and r.col in (0, SIDE - 1)
        assert r.slope == pytest.approx(0.25 if corner else 0.5)
        assert r.aspect == pytest.approx(math.pi, abs=1e-9)


def test_plane_tilted_north_is_whole_everywhere(spark):
    assert all(r.slope == pytest.approx(0.5) and r.aspect == pytest.approx(-math.pi / 2) for r in G.horn(scene(spark, lambda x, y: 0.5 * y), 1.0).collect())


def test_paraboloid_slope_is_exact_inside(spark):
    for r in G.horn(scene(spark, lambda x, y: 0.1 * ((x - 5) ** 2 + (y - 5) ** 2)), 1.0).where("complete").collect():
        assert r.slope == pytest.approx(0.2 * math.hypot(r.col - 5, r.row - 5))


def test_hole_takes_the_centre(spark):
    cells = scene(spark, lambda x, y: 3.0 + 0.0 * x).where("NOT (row = 5 AND col = 5)")
    assert all(r.slope == 0 for r in G.horn(cells, 1.0).collect())


def test_spike_is_found_and_opening_removes_it(spark):
    cells = scene(spark, lambda x, y: 0.01 * x).withColumn("z", F.when((F.col("row") == 6) & (F.col("col") == 6), 50.0).otherwise(F.col("z")))
    assert [(r.row, r.col) for r in G.spikes(cells).collect()] == [(6, 6)]
    assert G.opened(cells, 1).agg(F.max("z")).first()[0] < 1


def test_contours_of_a_slope_are_straight(spark):
    seg = G.contour_segments(scene(spark, lambda x, y: x), 1.0, 2.5).collect()
    assert {r.level for r in seg} == {2.5, 5.0, 7.5, 10.0}
    assert all(r.x1 == pytest.approx(r.level + 0.5) and r.x2 == pytest.approx(r.level + 0.5) for r in seg)


def test_hillshade_of_a_plane(spark):
    assert {r.shade for r in G.hillshade(G.horn(scene(spark, lambda x, y: F.lit(1.0)), 1.0)).collect()} == {180.0}


def test_change_of_a_raised_block(spark):
    a = scene(spark, lambda x, y: F.lit(1.0))
    b = scene(spark, lambda x, y: F.when((x < 3) & (y < 4), 3.0).otherwise(1.0))
    r = G.change_stats(G.change(a, b, 0.1), 4.0).first()
    assert (r.gain, r.loss, r.net, r.cells) == (96.0, 0.0, 96.0, SIDE * SIDE)


def test_volume_of_a_box(spark):
    pts = scene(spark, lambda x, y: F.lit(2.0)).select(F.monotonically_increasing_id().alias("point_id"), (F.col("col") + 0.5).alias("x"), (F.col("row") + 0.5).alias("y"), "z")
    r = M.cut_fill(pts, [(0, 0), (12, 0), (12, 12), (0, 12)], 0.5).first()
    assert (r.n, r.fill, r.cut, r.footprint) == (144, pytest.approx(216.0), 0.0, 144.0)
    assert M.cut_fill(pts, [(0, 0), (1, 1)], 0.5).first().n == 0


def test_components_follow_diagonals(spark):
    cells = spark.createDataFrame([(0, 0), (1, 1), (2, 2), (5, 5), (5, 6), (9, 0)], "row long, col long")
    got = {(r.row, r.col): r.component for r in S.cell_labels(cells).collect()}
    assert got[0, 0] == got[1, 1] == got[2, 2] != got[5, 5] == got[5, 6] != got[9, 0]


def test_unplaceable_points_go_and_empty_inputs_work(spark):
    kind = "point_id long, x double, y double, z double, class int, intensity int"
    df = spark.createDataFrame([(1, 0.0, 0.0, float("nan"), 2, 1), (2, None, 0.0, 1.0, 2, 1), (3, 1.0, 1.0, float("inf"), 2, 1), (4, 1.0, 1.0, 1.0, 2, 1)], kind)
    assert [r.point_id for r in src.finite(df).collect()] == [4]
    none = df.limit(0)
    assert G.rasterise(none, 1.0).count() == G.horn(G.rasterise(none, 1.0), 1.0).count() == P.voxel_centroids(none, 1.0).count() == 0
    assert P.equal_width_histogram(none, "z", 4).count() == 4


def test_results_do_not_depend_on_partitions(spark):
    cells = scene(spark, lambda x, y: F.sin(x) * F.cos(y))
    key = lambda df: sorted((r.row, r.col, round(r.slope, 9)) for r in df.collect())
    assert key(G.horn(cells.repartition(1), 1.0)) == key(G.horn(cells.repartition(9, "col"), 1.0))


def test_text_round_trips(spark, tmp_path):
    pts = spark.createDataFrame([(1, 1.5, 2.0, -3.25), (2, 0.0, 1.0, 9.0)], "point_id long, x double, y double, z double")
    sinks.xyz_lines(pts).orderBy("ord").select("value").coalesce(1).write.text(f"{tmp_path}/xyz")
    assert sorted((r.x, r.y, r.z) for r in src.read_xyz(spark, f"{tmp_path}/xyz").collect()) == [(0.0, 1.0, 9.0), (1.5, 2.0, -3.25)]
    sinks.obj_lines(pts).select("value").write.text(f"{tmp_path}/obj")
    assert src.read_obj(spark, f"{tmp_path}/obj").count() == 2
    cells = spark.createDataFrame([(0, 0, 1.25), (2, 1, 7.5)], "row long, col int, z double")
    sinks.ascii_grid_lines(cells, 3, 4, 1.0).orderBy("ord").select("value").coalesce(1).write.text(f"{tmp_path}/asc")
    back, head = src.read_ascii_grid(spark, f"{tmp_path}/asc")
    assert sorted((r.row, r.col, r.z) for r in back.collect()) == [(0, 0, 1.25), (2, 1, 7.5)] and head["ncols"] == 3
    (tmp_path / "c.xyz").write_text("# note\nx y z r g b\n1 2 3 0.5 1 0\n4,5,6,0,0,1\nbad 1 2\n7 8 nan\n")
    assert sorted((r.x, r.r, r.g, r.b) for r in src.read_xyz(spark, f"{tmp_path}/c.xyz").collect()) == [(1.0, 128, 255, 0), (4.0, 0, 0, 255)]
    (tmp_path / "c.pts").write_text("2\n1 2 3 99 10 20 30\n4 5 6 98 11 21 31\n")
    assert sorted((r.intensity, r.r) for r in src.read_pts(spark, f"{tmp_path}/c.pts").collect()) == [(98.0, 11), (99.0, 10)]
    assert sinks.geojson_points(pts).count() == 2


def test_windows_of_a_stream_are_those_of_the_table(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = N.tumbling(N.read_stream(spark, f"{tmp_path}/in", events.schema), "6 hours", "60 days")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("tumbled").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/ck").start()
    q.awaitTermination(120)
    key = lambda df: sorted((str(r.start), r.event_type, r.n) for r in df.collect())
    assert key(spark.table("tumbled")) == key(N.tumbling(events, "6 hours"))
