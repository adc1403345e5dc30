"""Judgements over facts: quality scores and gates, accuracy classes, uncertainty of change, density grades, health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import clamp, half_up


def _finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))


def quality_score(facts: DataFrame) -> DataFrame:
    """facts(measured, confidence, rmse, density, cell, edge, ground) -> the facts with score (0 to 100) and band.

    measured, edge and ground are shares, confidence is 0 to 100, density returns a square metre and cell the cell's
    side; an unknown rmse or ground share counts as half.
    """
    share = lambda c: clamp(F.col(c).cast("double"), 0.0, 1.0)
    returns = F.greatest(F.col("density"), F.lit(0.0)) * F.greatest(F.col("cell"), F.lit(1e-9)) ** 2
    # Weights, and what halves the parts for error (0.15 m) and density (3 returns a cell).
    parts = [
        (0.25, share("measured")), (0.25, clamp(F.col("confidence") / 100, 0.0, 1.0)), (0.2, F.when(_finite(F.col("rmse")), 0.15 / (0.15 + F.greatest(F.col("rmse"), F.lit(0.0)))).otherwise(0.5)),
        (0.15, returns / (returns + 3)), (0.1, clamp(1 - F.col("edge"), 0.0, 1.0)), (0.05, F.when(_finite(F.col("ground")), share("ground")).otherwise(0.5)),
    ]
    score = half_up(100 * clamp(sum((w * s for w, s in parts), F.lit(0.0)), 0.0, 1.0)).cast("int")
    return facts.withColumn("score", score).withColumn("band", F.when(F.col("score") >= 80, "excellent").when(F.col("score") >= 60, "good").when(F.col("score") >= 40, "fair").otherwise("poor"))


def quality_gate(facts: DataFrame) -> DataFrame:
    """facts(n_measured, n_interpolated, n_low, n_edge, n_empty, confidence, rmse, interval, crs, datum) -> with readiness, reasons, export.

    readiness is blocked, previewOnly or ready; reasons are codes of what fails; export waits for CRS and datum as well.
    """
    n = {k: F.col(f"n_{k}").cast("double") for k in ("measured", "interpolated", "low", "edge", "empty")}
    total = F.greatest(sum(n.values(), F.lit(0.0)), F.lit(1.0))
    covered = n["measured"] + n["interpolated"] + n["low"] + n["edge"]
    measured = F.when(covered > 0, n["measured"] / covered).otherwise(0.0)
    # The thresholds of the gate.
    stop = F.when(covered == 0, "no-surface").when(measured < 0.15, "too-little-measured").when(F.col("interval").isNull(), "no-interval")
    checks = {"interpolated": measured >= 0.6, "empty": n["empty"] / total <= 0.4, "edge": n["edge"] / total <= 0.15, "rmse": _finite(F.col("rmse")), "confidence": F.col("confidence") >= 55}
    failed = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), k) for k, ok in checks.items()]))
    readiness = F.when(stop.isNotNull(), "blocked").when(F.size(failed) > 0, "previewOnly").otherwise("ready")
    out = facts.withColumn("readiness", readiness).withColumn("reasons", F.when(stop.isNotNull(), stop).otherwise(F.concat_ws(",", failed)))
    known = F.col("crs").isNotNull() & F.col("datum").isNotNull()
    return out.withColumn("export", F.when(F.col("readiness") == "blocked", "blocked").when((F.col("readiness") == "ready") & known, "available").otherwise("previewOnly"))


#: Least density and greatest error of each level, and the multiplier of the 95 % figure.
LEVELS, NVA = [("QL0", 8.0, 0.05), ("QL1", 8.0, 0.1), ("QL2", 2.0, 0.1), ("QL3", 0.5, 0.2)], 1.96


def accuracy_level(facts: DataFrame) -> DataFrame:
    """facts(rmse, density) -> with nva (95 % figure) and level."""
    known = _finite(F.col("rmse")) & (F.col("rmse") >= 0)
    density = F.when(_finite(F.col("density")) & (F.col("density") > 0), F.col("density")).otherwise(0.0)
    level = F.lit("below-QL3")
    for name, least, most in reversed(LEVELS):
        level = F.when((density >= least) & (F.col("rmse") <= most), name).otherwise(level)
    return facts.withColumn("nva", F.when(known, NVA * F.col("rmse"))).withColumn("level", F.when(known & (density > 0), level).otherwise("unknown"))


def change_uncertainty(change: DataFrame, cell_area: float, cell_sigma: float, registration: float = 0.0) -> DataFrame:
    """change(diff, class) -> net, sigma, low, high, relative, quantified, detectable, confidence of the significant cells' volume."""
    area, sd, reg = max(cell_area, 0.0), max(cell_sigma, 0.0), max(registration, 0.0)
    some = F.col("class") != 0
    s = change.agg(F.count_if(some).alias("n"), F.coalesce(F.sum(F.when(some, F.col("diff") * area)), F.lit(0.0)).alias("net"))
    s = s.withColumn("sigma", F.sqrt((area * sd * F.sqrt("n")) ** 2 + (F.col("n") * area * reg) ** 2))
    relative = F.when(F.col("net") != 0, F.col("sigma") / F.abs("net")).otherwise(0.0)
    s = s.withColumns({"low": F.col("net") - F.col("sigma"), "high": F.col("net") + F.col("sigma"), "relative": relative, "quantified": F.lit(sd > 0 or reg > 0)})
    s = s.withColumn("detectable", F.col("quantified") & (F.col("n") >= 1) & (F.abs("net") > 1.96 * F.col("sigma")))
    return s.withColumn("confidence", F.when(~F.col("detectable"), "low").when(F.col("relative") <= 0.1, "high").when(F.col("relative") <= 0.3, "medium").otherwise("low"))


def _bands(d: Column, cuts: tuple) -> Column:
    names = ("sparse", "moderate", "dense")
    out = F.lit("very-dense")
    for name, cut in reversed(list(zip(names, cuts, strict=True))):
        out = F.when(d < cut, name).otherwise(out)
    return F.when(_finite(d) & (d > 0), out).otherwise("unknown")


def volumetric_density(d: Column) -> Column:
    return _bands(d, (4, 40, 400))


def areal_density(d: Column) -> Column:
    return _bands(d, (2, 8, 50))


def density_grade(pts: DataFrame, scale: float = 1.0, metres: float = 1.0, vertical: float | None = None) -> DataFrame:
    """One row: valid, invalid, estimated, volume, span, areal, volumetric, occupancy, bucket and basis of a sample's density.

    Areal density is over the occupied cells of a grid of 8 to 96 cells a side (from 256 points on); a scan taller than
    half its narrower side is judged by volume.
    """
    good = _finite(F.col("x")) & _finite(F.col("y")) & _finite(F.col("z"))
    span = lambda c, f: (F.max(F.when(good, F.col(c))) - F.min(F.when(good, F.col(c)))) * f
    side = F.least(F.greatest(half_up(F.sqrt(F.count_if(good) / 4)), F.lit(8)), F.lit(96)).cast("int")
    box = pts.agg(F.count_if(good).alias("valid"), F.count_if(~good).alias("invalid"), *[F.min(F.when(good, F.col(c))).alias(f"low_{c}") for c in "xy"], span("x", 1.0).alias("rx"), span("y", 1.0).alias("ry"), span("z", vertical or metres).alias("span"), side.alias("side"))
    at = lambda c: F.least(F.floor((F.col(c) - F.col(f"low_{c}")) / F.col(f"r{c}") * F.col("side")), F.col("side") - 1)
    wide = (F.col("valid") >= 256) & (F.col("rx") > 0) & (F.col("ry") > 0)
    cells = pts.where(good).join(F.broadcast(box.where(wide))).select(at("x").alias("i"), at("y").alias("j")).distinct().agg(F.count("*").alias("occupied"))
    b = box.join(F.broadcast(cells))
    total, volume = F.col("valid") * scale, F.col("rx") * F.col("ry") * metres * metres * F.col("span")
    b = b.withColumns({"estimated": half_up(total).cast("long"), "volume": volume, "volumetric": F.when(volume > 0, total / volume), "occupancy": F.when(F.col("occupied") > 0, F.col("occupied") / (F.col("side") * F.col("side")))})
    b = b.withColumn("areal", total / (F.col("occupancy") * F.col("rx") * F.col("ry") * metres * metres))
    narrow = F.least("rx", "ry") * metres
    tall, a, v = (narrow > 0) & (F.col("span") > 0.5 * narrow), areal_density(F.col("areal")), volumetric_density(F.col("volumetric"))
    basis = F.when(~tall & (a != "unknown"), "areal").when(v != "unknown", "volumetric").when(a != "unknown", "areal").otherwise("none")
    b = b.withColumn("basis", basis).withColumn("bucket", F.when(F.col("basis") == "areal", a).when(F.col("basis") == "volumetric", v).otherwise("unknown"))
    return b.select("valid", "invalid", "estimated", "volume", "span", "areal", "volumetric", "occupancy", "bucket", "basis")


def health(pts: DataFrame, declared: int | None = None, stride: int = 1) -> DataFrame:
    """check, n, status: values that are not finite, points at all, and declared against decoded points."""
    bad = sum(((~_finite(F.col(c))).cast("long") for c in "xyz"), F.lit(0))
    s = pts.agg(F.coalesce(F.sum(bad), F.lit(0)).alias("bad"), F.count("*").alias("n"))
    expected = -(-declared // max(stride, 1)) if declared is not None else None
    if declared is None:
        count = F.lit("info")
    else:
        count = F.when(F.col("n") == declared, "pass").when((F.lit(stride) > 1) & (F.col("n") >= expected), "info").otherwise("warn")
    rows = [("invalid", F.col("bad"), F.when(F.col("bad") > 0, "fail").otherwise("pass")), ("empty", F.col("n"), F.when(F.col("n") == 0, "fail").otherwise("pass")), ("declared", F.col("n"), count)]
    return s.select(F.explode(F.array(*[F.struct(F.lit(k).alias("check"), n.alias("n"), st.alias("status")) for k, n, st in rows])).alias("r")).select("r.*")


def worst(checks: DataFrame, by: str) -> DataFrame:
    """checks(by, status pass/review/block) -> the worst status of each group and how many checks have it."""
    rank = F.when(F.col("status") == "block", 2).when(F.col("status") == "review", 1).otherwise(0)
    got = checks.groupBy(by).agg(F.max(F.struct(rank.alias("r"), "status")).alias("w"), *[F.count_if(F.col("status") == s).alias(s) for s in ("pass", "review", "block")])
    return got.select(by, F.col("w.status").alias("verdict"), "pass", "review", "block")


def trust_tally(trusts: DataFrame) -> DataFrame:
    """green, yellow, red counts; rows without a verdict are passed over."""
    return trusts.agg(*[F.count_if(F.col("trust") == t).alias(t) for t in ("green", "yellow", "red")])


#: Evidence levels from the weakest to the strongest.
EVIDENCE = ("none", "assumed", "derived", "measured", "validated")


def evidence_rank(level: Column, ladder: tuple = EVIDENCE) -> Column:
    out = F.lit(None).cast("int")
    for i, name in enumerate(ladder):
        out = F.when(level == name, i).otherwise(out)
    return out


def meets(current: Column, required: Column, ladder: tuple = EVIDENCE) -> Column:
    """An unknown level meets nothing."""
    return F.coalesce(evidence_rank(current, ladder) >= evidence_rank(required, ladder), F.lit(False))


def welford(df: DataFrame, col: str) -> DataFrame:
    """n, mean, population and sample variance; 0 where there is nothing to spread."""
    zero = F.lit(0.0)
    return df.agg(F.count(col).alias("n"), F.coalesce(F.avg(col), zero).alias("mean"), F.coalesce(F.var_pop(col), zero).alias("population"), F.coalesce(F.when(F.count(col) > 1, F.var_samp(col)), zero).alias("sample"))


def exact_sum(df: DataFrame, col: str, scale: int = 12) -> DataFrame:
    """The sum of decimals of that scale: no order of additions shows in it."""
    return df.agg(F.coalesce(F.sum(F.col(col).cast(f"decimal(26,{scale})")), F.lit(0)).cast("double").alias("sum"))


def finite_range(df: DataFrame, col: str) -> DataFrame:
    """Least and greatest finite value; zeros if there is none."""
    v = F.when(_finite(F.col(col)), F.col(col))
    return df.agg(F.coalesce(F.min(v), F.lit(0.0)).alias("min"), F.coalesce(F.max(v), F.lit(0.0)).alias("max"))
