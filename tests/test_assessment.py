"""Cases that the registered queries do not reach."""

from pyspark.sql import functions as F

from talus.functions import vectors as V
from talus.operators import assess as A
from talus.operators import layers as L
from talus.shared import order_statistics, running


def test_ring_validity_in_order(spark):
    inf = float("inf")
    cases = {"too-few-vertices": [(0.0, 0.0), (1.0, 1.0)], "non-finite-vertex": [(0.0, 0.0), (1.0, inf), (1.0, 1.0), (0.0, 1.0)], "self-intersecting": [(0.0, 0.0), (2.0, 2.0), (2.0, 0.0), (0.0, 3.0)], "zero-area": [(0.0, 0.0), (1.0, 1.0), (2.0, 2.0)], "ok": [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)]}
    df = spark.createDataFrame([(k, [{"x": x, "y": y} for x, y in r]) for k, r in cases.items()], "want string, ring array<struct<x: double, y: double>>")
    assert all(r.want == r.got for r in df.select("want", V.ring_validity(F.col("ring")).alias("got")).collect())


def test_gate_is_ready_and_waits_for_a_datum(spark):
    kind = "n_measured long, n_interpolated long, n_low long, n_edge long, n_empty long, confidence double, rmse double, interval double, crs string, datum string"
    rows = [(90, 5, 3, 2, 10, 80.0, 0.1, 1.0, "c", "d"), (90, 5, 3, 2, 10, 80.0, 0.1, 1.0, "c", None), (0, 0, 0, 0, 0, 0.0, None, None, None, None), (30, 70, 0, 0, 0, 80.0, float("nan"), 1.0, "c", "d")]
    got = [(r.readiness, r.reasons, r.export) for r in A.quality_gate(spark.createDataFrame(rows, kind).coalesce(1)).collect()]
    assert got == [("ready", "", "available"), ("ready", "", "previewOnly"), ("blocked", "no-surface", "blocked"), ("previewOnly", "interpolated,rmse", "previewOnly")]


def test_ranges_are_refused_for_a_reason(spark):
    kind = "unit string, low double, high double"
    for want, rows in {"no-layers": [], "unknown-unit": [("metre", 0.0, 1.0), (None, 0.0, 1.0)], "units-differ": [("metre", 0.0, 1.0), ("foot", 0.0, 1.0)], "non-finite": [("metre", 0.0, float("inf"))], "inverted": [("metre", 2.0, 1.0)]}.items():
        assert L.combined_range(spark.createDataFrame(rows, kind)).first()["reason"] == want


def test_single_layer_is_verified_and_undeclared_ones_are_unknown(spark):
    kind = "id long, horizontal string, vertical string"
    assert L.compatibility(spark.createDataFrame([(1, None, None)], kind)).first().status == "verified"
    assert {r.status for r in L.compatibility(spark.createDataFrame([(1, None, "v"), (2, None, "v")], kind)).collect()} == {"unknown"}


def test_downsampling_keeps_to_its_budget(spark):
    pts = spark.range(20000).selectExpr("id AS point_id", "cast(id % 200 AS double) AS x", "cast(floor(id / 200) AS double) AS y", "cast(id % 7 AS double) AS z", "cast(id % 5 AS int) AS class", "cast(id % 9 AS int) AS intensity")
    got = L.downsample_to_budget(pts, 800)
    assert 300 <= got.count() <= 800 and got.agg(F.sum("n")).first()[0] == 20000
    assert L.downsample_to_budget(pts, 20000).count() == 20000


def test_order_statistics_and_running_sums(spark):
    df = spark.range(1000).selectExpr("id % 3 AS g", "cast(id * 7919 % 1000 AS double) AS v", "if(id % 2 = 0, 5.0, cast(id AS double)) AS w")
    got = order_statistics(df, {"m": ("v", 0.5), "p": ("w", 0.9)}).first()
    want = df.agg(F.median("v").alias("m"), F.percentile("w", 0.9).alias("p")).first()
    assert (got.m, got.p) == (want.m, want.p)
    by = {r.g: r.m for r in order_statistics(df, {"m": ("v", 0.25)}, "g").collect()}
    assert by == {r.g: r.m for r in df.groupBy("g").agg(F.percentile("v", 0.25).alias("m")).collect()}
    assert order_statistics(df.limit(0), {"m": ("v", 0.5)}).collect() == []
    total = {r.v: r.total for r in running(df, [F.col("v")], "v").collect()}
    assert total == {float(i): i * (i + 1) / 2 for i in range(1000)}


def test_closed_lines_are_written_once_round(spark):
    from talus.sources import sinks as K

    line = spark.createDataFrame([(5.0, True, [0.0, 1.0, 1.0, 0.0], [0.0, 0.0, 1.0, 0.0])], "level double, closed boolean, xs array<double>, ys array<double>")
    dxf = K.dxf_document([r.value for r in K.dxf_lines(line).collect()]).split("\n")
    assert dxf[dxf.index("90") + 1] == "3" and dxf[dxf.index("70") + 1] == "1" and dxf.count("10") == 3 and dxf[-2] == "EOF"
    assert K.svg_lines(line, 1.0).first().value == '<path d="M0.00 1.00 L1.00 1.00 L1.00 0.00Z"/>'
    assert K.geojson_lines(line).first().value.endswith('"closed":true},"geometry":{"type":"LineString","coordinates":[[0.000,0.000],[1.000,0.000],[1.000,1.000],[0.000,0.000]]}}')
