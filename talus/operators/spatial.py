"""Spatial joins and groups by bucket keys: equi-joins that Spark can shuffle, never cross joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as E
from ..shared import components


def radius_pairs(a: DataFrame, b: DataFrame, radius: float) -> DataFrame:
    """Pairs (a_id, b_id, d2) within the radius: b goes to its bucket, a to its bucket and the 26 around it.

    Both sides are shuffled: Spark takes the rows after `explode` for no more than those before, and would send 27 times
    what it allows to be broadcast through the driver.
    """
    key = [E.cell(F.col(c), radius).alias(f"k{c}") for c in "xyz"]
    right = b.select(F.col("point_id").alias("b_id"), *[F.col(c).alias(f"b{c}") for c in "xyz"], *key)
    near = F.array(*[F.lit(i) for i in (-1, 0, 1)])
    left = a.select(F.col("point_id").alias("a_id"), "x", "y", "z", *key)
    for c in "xyz":
        left = left.withColumn("o", F.explode(near)).withColumn(f"k{c}", F.col(f"k{c}") + F.col("o")).drop("o")
    d2 = sum(((F.col(c) - F.col(f"b{c}")) ** 2 for c in "xyz"), F.lit(0.0))
    return left.hint("merge").join(right, ["kx", "ky", "kz"]).select("a_id", "b_id", d2.alias("d2")).where(F.col("d2") <= radius * radius)


def radius_counts(a: DataFrame, b: DataFrame, radius: float) -> DataFrame:
    got = radius_pairs(a, b, radius).groupBy("a_id").agg(F.count("*").alias("n"))
    return a.select("point_id").join(got, F.col("point_id") == F.col("a_id"), "left").select("point_id", F.coalesce("n", F.lit(0)).alias("n"))


def nearest(a: DataFrame, b: DataFrame, most: float) -> DataFrame:
    """Nearest point of b within `most`; of equals the least id."""
    got = radius_pairs(a, b, most).groupBy("a_id").agg(F.min(F.struct("d2", "b_id")).alias("m"))
    return got.select(F.col("a_id").alias("point_id"), F.col("m.b_id").alias("nearest"), F.sqrt("m.d2").alias("distance"))


def cell_labels(cells: DataFrame) -> DataFrame:
    """row, col, component: 8-connected groups of cells, named by the least cell of each.

    Every cell sends itself to four of its eight neighbours (the other four send themselves to it), so edges come from
    one join by key; groups then come from `components`, whose rounds do not depend on how far a group reaches.
    """
    code = F.col("row") * F.lit(1 << 32) + F.col("col")
    own = cells.select("row", "col", code.alias("id"))
    steps = F.array(*[F.struct(F.lit(r).alias("dr"), F.lit(c).alias("dc")) for r, c in ((0, 1), (1, -1), (1, 0), (1, 1))])
    sent = own.select("id", "row", "col", F.explode(steps).alias("d")).select(F.col("id").alias("a"), (F.col("row") + F.col("d.dr")).alias("row"), (F.col("col") + F.col("d.dc")).alias("col"))
    edges = sent.join(own.select("row", "col", F.col("id").alias("b")), ["row", "col"]).select("a", "b")
    got = components(edges)
    return own.join(got, F.col("id") == F.col("node"), "left").select("row", "col", F.coalesce("component", "id").alias("component"))


def footprints(pts: DataFrame, size: float, least: int, min_area: float) -> DataFrame:
    """component, cells, area, centre and box of groups of cells that hold `least` points or more."""
    cells = pts.groupBy(E.cell(F.col("y"), size).alias("row"), E.cell(F.col("x"), size).alias("col")).agg(F.count("*").alias("n")).where(F.col("n") >= least)
    out = cell_labels(cells).groupBy("component").agg(
        F.count("*").alias("cells"), (F.count("*") * F.lit(size * size)).alias("area"),
        ((F.avg("col") + 0.5) * size).alias("cx"), ((F.avg("row") + 0.5) * size).alias("cy"),
        (F.min("col") * F.lit(size)).alias("west"), ((F.max("col") + 1) * F.lit(size)).alias("east"),
        (F.min("row") * F.lit(size)).alias("south"), ((F.max("row") + 1) * F.lit(size)).alias("north"),
    )
    return out.where(F.col("area") >= min_area)


def connected(edges: DataFrame) -> DataFrame:
    """edges(a, b) of long nodes -> node, component (least node of each group); a node linked only to itself is its own group."""
    got = components(edges)
    nodes = edges.select(F.col("a").alias("n")).unionByName(edges.select(F.col("b").alias("n"))).distinct()
    return nodes.join(got, F.col("n") == F.col("node"), "left").select(F.col("n").alias("node"), F.coalesce("component", "n").alias("component"))
