"""Point sources: the event table as a point cloud, and plain-text scan formats read with Spark's own text reader."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Class codes that event types stand for (ASPRS 2 ground, 3-5 vegetation, 6 building).
EVENT_CLASS = {"view": 2, "signup": 3, "click": 4, "error": 5, "purchase": 6}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """point_id, x, y, z, class, intensity: x from the user, y in hours since 2024-01-01, z from the value.

    Rows with a null or non-finite coordinate cannot be placed and are dropped.
    """
    e = table(spark, sf_dir, "events")
    code = F.coalesce(*[F.when(F.col("event_type") == k, v) for k, v in EVENT_CLASS.items()], F.lit(1))
    micros = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ))")
    pts = e.select(
        F.col("event_id").alias("point_id"),
        F.col("user_id").cast("double").alias("x"),
        (micros / F.lit(3.6e9)).alias("y"),
        F.col("value").alias("z"),
        code.alias("class"),
        F.regexp_extract("props", r'"k": *(\d+)', 1).try_cast("int").alias("intensity"),
    )
    return finite(pts)


def finite(pts: DataFrame, *cols: str) -> DataFrame:
    """Drops rows with a null, NaN or infinite coordinate."""
    keep = F.lit(True)
    for c in cols or ("x", "y", "z"):
        keep = keep & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    return pts.where(keep)


def vector_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """point_id, x, y, z: the first three components of each vector."""
    v = table(spark, sf_dir, "embeddings")
    return finite(v.select(F.col("vec_id").alias("point_id"), *[F.get("embedding", F.lit(i)).cast("double").alias(c) for i, c in enumerate("xyz")], "label"))


def _numbers(lines: DataFrame) -> DataFrame:
    tokens = F.filter(F.split(F.trim("value"), r"[\s,;]+"), lambda t: t != "")
    numbers = F.transform(tokens, lambda t: t.try_cast("double"))
    good = F.forall(F.slice(numbers, 1, 3), lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return lines.where(~F.trim("value").startswith("#")).select(numbers.alias("n")).where((F.size("n") >= 3) & good)


def _coloured(rows: DataFrame, first: int) -> DataFrame:
    """rgb from three numbers; a file whose largest colour is 1 or less holds shares of 255."""
    rgb = [F.get("n", F.lit(first + i)).alias(c) for i, c in enumerate(("r", "g", "b"))]
    cols = [F.get("n", F.lit(i)).alias(c) for i, c in enumerate("xyz")]
    rows = rows.select(*cols, "n", *rgb)
    top = rows.agg(F.max(F.greatest("r", "g", "b"))).first()[0]
    scale = 255.0 if top is not None and top <= 1 else 1.0
    return rows.select("x", "y", "z", "n", *[F.floor(F.least(F.greatest(F.col(c) * scale, F.lit(0.0)), F.lit(255.0)) + 0.5).cast("short").alias(c) for c in ("r", "g", "b")])


def read_xyz(spark: SparkSession, path: str) -> DataFrame:
    """x y z [r g b] separated by white space, commas or semicolons; comments, headers and broken lines are skipped."""
    return _coloured(_numbers(spark.read.text(path)), 3).drop("n")


def read_pts(spark: SparkSession, path: str) -> DataFrame:
    """Optional count line, then x y z [intensity] [r g b]: intensity with 4 or with 7 and more columns."""
    rows = _numbers(spark.read.text(path))
    wide = rows.agg(F.max(F.size("n"))).first()[0] or 3
    has = wide == 4 or wide >= 7
    rows = _coloured(rows, 4 if has else 3)
    return rows.select("x", "y", "z", (F.get("n", F.lit(3)) if has else F.lit(None).cast("double")).alias("intensity"), "r", "g", "b")


def read_obj(spark: SparkSession, path: str) -> DataFrame:
    """Vertices (`v` lines) of a mesh as points."""
    lines = spark.read.text(path).where(F.col("value").rlike(r"^\s*v\s"))
    return _numbers(lines.select(F.regexp_replace("value", r"^\s*v\s+", "").alias("value"))).select(*[F.get("n", F.lit(i)).alias(c) for i, c in enumerate("xyz")])


def read_ascii_grid(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """Sparse cells (row from the south, col, z) of an ESRI ASCII grid, and its header."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("i", "line")).where(F.trim("line") != "")
    named = lines.where(F.col("line").rlike("^[a-zA-Z]"))
    head = {r["k"].lower(): float(r["v"]) for r in named.select(F.regexp_extract("line", r"^(\w+)\s+(\S+)", 1).alias("k"), F.regexp_extract("line", r"^(\w+)\s+(\S+)", 2).alias("v")).collect()}
    body = lines.where(~F.col("line").rlike("^[a-zA-Z]"))
    first = body.agg(F.min("i")).first()[0] or 0
    cells = body.select((F.lit(int(head["nrows"]) - 1 + first) - F.col("i")).alias("row"), F.posexplode(F.split(F.trim("line"), r"\s+")).alias("col", "z"))
    cells = cells.select("row", "col", F.col("z").cast("double").alias("z")).where(F.col("z") != head.get("nodata_value", -9999.0))
    return cells, head
