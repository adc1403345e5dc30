"""What comes after contour segments: levels, intervals, evidence, polylines."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Intervals that are tried.
INTERVALS = (0.5, 1.0, 2.0, 5.0, 10.0)


def interval_gate(cells: DataFrame, rmse: float, candidates: tuple = INTERVALS) -> DataFrame:
    """interval, levels, supported, recommended: an interval holds twice the error and gives a level; the first with 4 to 40 is recommended."""
    span = cells.agg(F.min("z").alias("lo"), F.max("z").alias("hi"))
    rows = span.select(F.explode(F.array(*[F.lit(float(c)) for c in candidates])).alias("interval"), "lo", "hi")
    levels = F.greatest(F.floor(F.col("hi") / F.col("interval")) - F.ceil(F.col("lo") / F.col("interval")) + 1, F.lit(0)).cast("long")
    rows = rows.select("interval", levels.alias("levels")).withColumn("supported", (F.col("interval") >= 2 * rmse) & (F.col("levels") >= 1))
    fit = F.col("supported") & F.col("levels").between(4, 40)
    best = rows.agg(F.min(F.when(fit, F.col("interval"))).alias("best"))
    return rows.join(F.broadcast(best)).select("interval", "levels", "supported", F.coalesce(F.col("interval") == F.col("best"), F.lit(False)).alias("recommended"))


def styled(levels: DataFrame, interval: float, every: int = 5) -> DataFrame:
    """level, is_index: whether a level is a whole multiple of the interval that `every` divides."""
    k = F.col("level") / interval
    whole = F.abs(k - F.round(k)) < 1e-6
    return levels.select("level").distinct().select("level", (whole & (F.pmod(F.round(k).cast("long"), F.lit(every)) == 0)).alias("is_index"))


def grade_tally(segments: DataFrame) -> DataFrame:
    """segments(grade, x1, y1, x2, y2) -> number and length of each grade."""
    length = F.sqrt((F.col("x2") - F.col("x1")) ** 2 + (F.col("y2") - F.col("y1")) ** 2)
    return segments.groupBy("grade").agg(F.count("*").alias("n"), F.sum(length).alias("length"))


def graded(segments: DataFrame, confidence: DataFrame, size: float) -> DataFrame:
    """Each segment with the grade of the cell that holds its middle."""
    mid = lambda c: F.floor((F.col(f"{c}1") + F.col(f"{c}2")) / 2 / size).cast("long")
    return segments.withColumn("row", mid("y")).withColumn("col", mid("x")).join(confidence.select("row", "col", "grade"), ["row", "col"], "left").withColumn("grade", F.coalesce("grade", F.lit("gap"))).drop("row", "col")


def polylines(segments: DataFrame, quantum: float = 1e-6) -> DataFrame:
    """level, line, closed, xs, ys: segments of a level joined at shared ends, one group of connected segments at a time."""
    from .spatial import connected

    end = lambda i: F.concat_ws(":", F.round(F.col("level"), 6).cast("string"), *[F.round(F.col(f"{c}{i}") / quantum).cast("long").cast("string") for c in "xy"])
    s = segments.withColumn("a", F.xxhash64(end(1))).withColumn("b", F.xxhash64(end(2)))
    lines = connected(s.select("a", "b")).withColumnRenamed("component", "line")
    s = s.join(lines, F.col("a") == F.col("node")).select("level", "line", "a", "b", "x1", "y1", "x2", "y2")

    def walk(t: pd.DataFrame) -> pd.DataFrame:
        t = t.sort_values(["a", "b"], ignore_index=True)
        at: dict[int, list[int]] = {}
        for i, (a, b) in enumerate(zip(t["a"], t["b"], strict=True)):
            at.setdefault(a, []).append(i)
            at.setdefault(b, []).append(i)
        used, out = [False] * len(t), []
        starts = sorted(n for n, e in at.items() if len(e) % 2) + sorted(at)
        for n in starts:
            xs, ys, here, first = [], [], n, n
            while nxt := [i for i in at[here] if not used[i]]:
                i = nxt[0]
                used[i] = True
                forward = t["a"][i] == here
                p, q = ((t["x1"][i], t["y1"][i]), (t["x2"][i], t["y2"][i])) if forward else ((t["x2"][i], t["y2"][i]), (t["x1"][i], t["y1"][i]))
                if not xs:
                    xs.append(p[0])
                    ys.append(p[1])
                xs.append(q[0])
                ys.append(q[1])
                here = t["b"][i] if forward else t["a"][i]
            if xs:
                out.append((t["level"][0], t["line"][0], here == first, xs, ys))
        return pd.DataFrame(out, columns=["level", "line", "closed", "xs", "ys"])

    return s.groupBy("line").applyInPandas(walk, "level double, line long, closed boolean, xs array<double>, ys array<double>")


def smoothed(lines: DataFrame, passes: int = 2) -> DataFrame:
    """Chaikin's corner cutting on the vertices of each line; the ends of open lines stay."""
    def cut(c: str):
        mix = lambda i: F.array(0.75 * F.element_at(c, i) + 0.25 * F.element_at(c, i + 1), 0.25 * F.element_at(c, i) + 0.75 * F.element_at(c, i + 1))
        pairs = F.flatten(F.transform(F.sequence(F.lit(1), F.size(c) - 1), mix))
        ends = F.concat(F.slice(c, 1, 1), pairs, F.slice(c, -1, 1))
        return F.when(F.size(c) < 3, F.col(c)).when(F.col("closed"), F.concat(pairs, F.slice(pairs, 1, 1))).otherwise(ends)

    out = lines
    for _ in range(passes):
        out = out.withColumns({c: cut(c) for c in ("xs", "ys")})
    return out


def label_places(lines: DataFrame, spacing: float) -> DataFrame:
    """line, chainage: places every `spacing` along each line, the first at half of it."""
    step = F.transform(F.sequence(F.lit(2), F.size("xs")), lambda i: F.sqrt((F.element_at("xs", i) - F.element_at("xs", i - 1)) ** 2 + (F.element_at("ys", i) - F.element_at("ys", i - 1)) ** 2))
    length = F.aggregate(step, F.lit(0.0), lambda s, v: s + v)
    n = F.floor((F.col("length") - spacing / 2) / spacing).cast("long")
    with_l = lines.select("level", "line", length.alias("length")).where(F.col("length") >= spacing / 2)
    return with_l.select("level", "line", F.explode(F.transform(F.sequence(F.lit(0).cast("long"), n), lambda i: spacing / 2 + i * F.lit(spacing))).alias("chainage"))
