"""Validation: confusion, check points, intervals, calibration."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as E
from ..shared import order_statistics, running


def confusion(pairs: DataFrame) -> DataFrame:
    """pairs(truth, predicted) of 0 and 1 -> counts and the usual rates; null where a rate has no denominator."""
    c = pairs.agg(*[F.count_if((F.col("truth") == t) & (F.col("predicted") == p)).alias(n) for n, t, p in (("tp", 1, 1), ("fp", 0, 1), ("fn", 1, 0), ("tn", 0, 0))])
    d = lambda a, b: a / F.nullif(b, F.lit(0))
    tp, fp, fn, tn = (F.col(x).cast("double") for x in ("tp", "fp", "fn", "tn"))
    mcc = (tp * tn - fp * fn) / F.nullif(F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), F.lit(0.0))
    return c.select("tp", "fp", "fn", "tn", d(tp, tp + fp).alias("precision"), d(tp, tp + fn).alias("recall"), d(2 * tp, 2 * tp + fp + fn).alias("f1"), d(tp, tp + fp + fn).alias("iou"), ((d(tp, tp + fn) + d(tn, tn + fp)) / 2).alias("balanced"), mcc.alias("mcc"))


def checkpoints(points: DataFrame) -> DataFrame:
    """points(stratum, error) -> per stratum and pooled (null stratum): mean error, RMSE, MAE, NMAD, 95th percentile."""
    rows = points.select(F.col("stratum").cast("string").alias("stratum"), "error")
    rows = rows.unionByName(rows.withColumn("stratum", F.lit(None).cast("string")))
    same = lambda df, name: df.withColumnRenamed("stratum", name)
    middle = order_statistics(rows, {"m": ("error", 0.5)}, "stratum")
    off = rows.join(same(middle, "of"), F.col("stratum").eqNullSafe(F.col("of"))).select("stratum", F.abs("error").alias("size"), F.abs(F.col("error") - F.col("m")).alias("off"))
    ranks = order_statistics(off, {"nmad": ("off", 0.5), "p95": ("size", 0.95)}, "stratum").withColumn("nmad", 1.4826 * F.col("nmad"))
    e = F.col("error")
    sums = rows.groupBy("stratum").agg(F.count("*").alias("n"), F.avg(e).alias("me"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"))
    return sums.join(same(ranks, "of"), F.col("stratum").eqNullSafe(F.col("of"))).drop("of")


def strata_rollup(points: DataFrame) -> DataFrame:
    e = F.col("error")
    return points.rollup("stratum").agg(F.grouping("stratum").cast("int").alias("pooled"), F.count("*").alias("n"), F.avg(e).alias("me"), F.sqrt(F.avg(e * e)).alias("rmse"))


def within_tolerance(points: DataFrame, tolerance: float) -> DataFrame:
    """Share of errors within the tolerance in each stratum, with its Wilson interval."""
    c = points.groupBy("stratum").agg(F.count_if(F.abs("error") <= tolerance).alias("k"), F.count("*").alias("n"))
    low, high = E.wilson(F.col("k").cast("double"), F.col("n").cast("double"))
    return c.select("stratum", "k", "n", (F.col("k") / F.col("n")).alias("share"), low.alias("low"), high.alias("high"))


def reliability(samples: DataFrame, bins: int) -> DataFrame:
    """samples(confidence 0-100, hit) -> hits and mean confidence of each of `bins` equal bands."""
    band = F.least(F.floor(F.col("confidence") / (100.0 / bins)), F.lit(bins - 1)).cast("long")
    return samples.groupBy(band.alias("band")).agg(F.count("*").alias("n"), F.avg(F.col("hit").cast("double")).alias("rate"), F.avg("confidence").alias("confidence"))


def isotonic(bands: DataFrame) -> DataFrame:
    """bands(band, n, rate) -> the nearest non-decreasing rates: the greatest least weighted mean over intervals around each band."""
    a = bands.select(F.col("band").alias("lo"), F.lit(1).alias("one"))
    w = bands.select("band", F.col("n").cast("double").alias("n"), (F.col("n") * F.col("rate")).alias("s"))
    spans = a.join(a.select(F.col("lo").alias("hi"), "one"), "one").where("lo <= hi").drop("one")  # bands are few by construction
    mean = spans.join(w, F.col("band").between(F.col("lo"), F.col("hi"))).groupBy("lo", "hi").agg((F.sum("s") / F.sum("n")).alias("m"))
    at = bands.select("band").join(mean, F.col("band").between(F.col("lo"), F.col("hi")))
    return at.groupBy("band", "lo").agg(F.min("m").alias("m")).groupBy("band").agg(F.max("m").alias("fitted"))


def ordered(bands: DataFrame, slack: float = 0.15) -> DataFrame:
    """bands(band, rmse, n): whether the error does not grow from one band to the next by more than the slack."""
    before = F.lag("rmse").over(Window.orderBy("band"))
    return bands.where("n >= 5").select("band", "rmse", (F.col("rmse") <= before * (1 + slack)).alias("ordered"))


def jackknife(samples: DataFrame) -> DataFrame:
    """samples(site, value) -> the mean without each site, from totals: one pass, no copies of the data."""
    by = samples.groupBy("site").agg(F.sum("value").alias("s"), F.count("value").alias("n"))
    total = by.agg(F.sum("s").alias("ts"), F.sum("n").alias("tn"), F.count("*").alias("k"))
    return by.join(F.broadcast(total)).select("site", ((F.col("ts") - F.col("s")) / F.nullif(F.col("tn") - F.col("n"), F.lit(0))).alias("without"), "k")


def jackknife_error(samples: DataFrame) -> DataFrame:
    j = jackknife(samples)
    est = samples.agg(F.avg("value").alias("est"))
    s = j.agg(F.avg("without").alias("m"), F.var_pop("without").alias("v"), F.first("k").alias("k"))
    return s.join(F.broadcast(est)).select(F.sqrt((F.col("k") - 1) * F.col("v")).alias("se"), ((F.col("k") - 1) * (F.col("m") - F.col("est"))).alias("bias"))


#: Classes that are scored (ASPRS ground, low, medium and high vegetation, building), and codes of rates.
SCORED, UNCLASSIFIED, GROUND, BUILDING, LOW_NOISE = (2, 3, 4, 5, 6), 1, 2, 6, 7


def class_scores(pairs: DataFrame, codes: tuple = SCORED) -> DataFrame:
    """pairs(scene, truth, predicted) -> support, predicted, tp, fp, fn, precision, recall, f1 of each scene and class, and of all scenes (null)."""
    hits = pairs.rollup("scene").agg(*[f.alias(f"{n}{k}") for k in codes for n, f in (("s", F.count_if(F.col("truth") == k)), ("p", F.count_if(F.col("predicted") == k)), ("t", F.count_if((F.col("truth") == k) & (F.col("predicted") == k))))])
    rows = hits.select("scene", F.explode(F.array(*[F.struct(F.lit(k).alias("code"), *[F.col(f"{n}{k}").alias(n) for n in "spt"]) for k in codes])).alias("x")).select("scene", "x.*")
    rows = rows.select("scene", "code", F.col("s").alias("support"), F.col("p").alias("predicted"), F.col("t").alias("tp"), (F.col("p") - F.col("t")).alias("fp"), (F.col("s") - F.col("t")).alias("fn"))
    rows = rows.withColumns({"precision": F.when(F.col("predicted") > 0, F.col("tp") / F.col("predicted")), "recall": F.when(F.col("support") > 0, F.col("tp") / F.col("support"))})
    both = F.col("precision") + F.col("recall")
    return rows.withColumn("f1", F.when(both > 0, 2 * F.col("precision") * F.col("recall") / both).when(both == 0, 0.0))


def scene_scores(pairs: DataFrame, codes: tuple = SCORED) -> DataFrame:
    """scene (null: pooled), points, macro_f1 (classes without support and prediction aside), unclassified, false_building and low-noise counts."""
    seen = (F.col("support") > 0) | (F.col("predicted") > 0)
    macro = class_scores(pairs, codes).groupBy(F.col("scene").alias("of")).agg(F.avg(F.when(seen, F.coalesce("f1", F.lit(0.0)))).alias("macro_f1"))
    t, p = F.col("truth"), F.col("predicted")
    rates = pairs.rollup("scene").agg(
        F.count("*").alias("points"), (F.count_if(p == UNCLASSIFIED) / F.count("*")).alias("unclassified"),
        (F.count_if((t != BUILDING) & (p == BUILDING)) / F.nullif(F.count_if(t != BUILDING), F.lit(0))).alias("false_building"),
        F.count_if(t == LOW_NOISE).alias("low_noise"), F.count_if((t == LOW_NOISE) & (p == GROUND)).alias("low_noise_as_ground"),
    )
    return rates.join(macro, F.col("scene").eqNullSafe(F.col("of"))).drop("of")


def block_holdout(pts: DataFrame, size: float, block: float, folds: int = 5) -> DataFrame:
    """Spatial cross-validation: whole blocks are held out fold by fold and predicted from the other folds.

    A prediction is the mean of the other folds' points in the cell and its eight neighbours; a point without any is
    uncovered.  Blocks go to folds by their place.  One row: n, uncovered, rmse, mae, bias, the spread of the blocks' own
    errors and their number.  Means come from sums for each cell and fold, so that no point is copied.
    """
    from .grid import _sent

    at = lambda c, s: E.cell(F.col(c), s)
    rows = pts.select(at("y", size).alias("row"), at("x", size).alias("col"), at("x", block).alias("bx"), at("y", block).alias("by"), "z")
    rows = rows.withColumn("fold", F.pmod(F.col("bx") * 31 + F.col("by") * 17, F.lit(folds)).cast("int"))
    sums = rows.groupBy("row", "col", "fold").agg(F.sum("z").alias("s"), F.count("z").alias("n"))
    around = _sent(sums, [(dr, dc) for dr in (-1, 0, 1) for dc in (-1, 0, 1)]).groupBy("row", "col", "fold").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    whole = around.groupBy("row", "col").agg(F.sum("s").alias("ts"), F.sum("n").alias("tn"))
    others = around.join(whole, ["row", "col"]).select("row", "col", "fold", ((F.col("ts") - F.col("s")) / F.nullif(F.col("tn") - F.col("n"), F.lit(0))).alias("p"))
    e = rows.join(others, ["row", "col", "fold"]).withColumn("e", F.col("z") - F.col("p"))
    spread = e.groupBy("bx", "by").agg(F.avg("e").alias("b")).agg(F.stddev_samp("b").alias("block_sd"), F.count("*").alias("blocks"))
    total = e.agg(F.count("*").alias("n"), F.count_if(F.col("p").isNull()).alias("uncovered"), F.sqrt(F.avg(F.col("e") ** 2)).alias("rmse"), F.avg(F.abs("e")).alias("mae"), F.avg("e").alias("bias"))
    return total.join(F.broadcast(spread))


def block_bootstrap(samples: DataFrame, iterations: int = 1000, confidence: float = 0.9, seed: int = 1) -> DataFrame:
    """samples(block, value): status, n, blocks, estimate, lower, upper, error of the mean, whole blocks drawn with replacement.

    As many blocks are drawn as there are, by hashes of seed, iteration and draw.  Fewer than 200 iterations raise; no
    samples, values that are not finite and fewer than two blocks give a status and no interval.  Blocks meet as sums, so
    an iteration costs a row for each block, however many samples there are.
    """
    if iterations < 200 or not 0 < confidence < 1:
        raise ValueError("200 iterations or more and a confidence between 0 and 1 are needed")
    v = F.col("value").cast("double")
    odd = v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    sums = samples.groupBy("block").agg(F.sum(v).alias("s"), F.count("*").alias("n"), F.count_if(odd).alias("odd"))
    blocks = running(sums.withColumn("one", F.lit(1)), [F.col("block").asc_nulls_first()], "one").select(F.col("before").cast("long").alias("place"), "s", "n", "odd")
    whole = blocks.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("blocks"), F.coalesce(F.sum("odd"), F.lit(0)).alias("odd"), (F.sum("s") / F.sum("n")).alias("estimate"))
    rounds = samples.sparkSession.range(iterations).withColumnRenamed("id", "i").join(F.broadcast(whole.select(F.col("blocks").alias("k"))))
    draws = rounds.where("k > 0").select("i", "k", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("j"))
    hashed = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), "i", "j").cast("binary")), 1, 12), 16, 10).cast("long")
    drawn = draws.select("i", F.pmod(hashed, F.col("k")).alias("place")).groupBy("i", "place").agg(F.count("*").alias("times"))
    means = drawn.join(blocks, "place").groupBy("i").agg((F.sum(F.col("s") * F.col("times")) / F.sum(F.col("n") * F.col("times"))).alias("m"))
    tail = (1 - confidence) / 2
    spread = means.agg(F.percentile("m", tail).alias("lower"), F.percentile("m", 1 - tail).alias("upper"), F.stddev_samp("m").alias("error"))
    status = F.when(F.col("n") == 0, "no-samples").when(F.col("odd") > 0, "non-finite-value").when(F.col("blocks") < 2, "too-few-blocks").otherwise("estimated")
    out = whole.withColumn("status", status).join(F.broadcast(spread), how="left")
    return out.select("status", "n", "blocks", *[F.when(F.col("status") == "estimated", F.col(c)).alias(c) for c in ("estimate", "lower", "upper", "error")])
