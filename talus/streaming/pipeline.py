"""Facts about a stream of octree nodes: what is seen, what may start, how far it is, and what a sample of it covers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import running

# Limits by device (fetches, queued bytes, decodes, pending bytes), point budgets by quality, chunk cache.
LIMITS = {"desktop": (6, 16 * 2**20, 3, 48 * 2**20), "mobile": (3, 6 * 2**20, 2, 16 * 2**20)}
POINTS = {"desktop": {"low": 1_500_000, "balanced": 2_500_000, "high": 8_000_000}, "mobile": {"low": 600_000, "balanced": 1_200_000, "high": 2_000_000}}
CACHE = {"desktop": 48 * 2**20, "mobile": 16 * 2**20}

# Thresholds of the adaptation, and the share from which a view is settling.
RTT_GOOD, FAILURE_LOW, FAILURE_HIGH, DECODE_HIGH, BACKLOG = 150, 0.02, 0.1, 0.9, 0.75
SETTLING = 0.95


def in_frustum(boxes: DataFrame, planes: list[tuple[float, float, float, float]]) -> DataFrame:
    """boxes(x0, y0, z0, x1, y1, z1, ...) that reach, with the corner farthest along its normal, into every half space."""
    seen = F.lit(True)
    for a, b, c, d in planes:
        far = [F.col(f"{n}{1 if w >= 0 else 0}") * w for n, w in zip("xyz", (a, b, c), strict=True)]
        seen = seen & (far[0] + far[1] + far[2] + d >= 0)
    return boxes.where(seen)


def budgets(requests: DataFrame) -> DataFrame:
    """requests(tier, device, ...) with quality, points, decodes, cache, shading and fade."""
    quality = F.when(F.col("tier").isin("low", "high"), F.col("tier")).otherwise("balanced")
    mobile = F.col("device") == "mobile"
    r = requests.withColumn("quality", quality)
    pick = lambda d: F.element_at(F.create_map(*[F.lit(x) for kv in POINTS[d].items() for x in kv]), F.col("quality"))
    points = F.when(mobile, pick("mobile")).otherwise(pick("desktop"))
    fine = F.coalesce(F.col("tier") != "low", F.lit(True))
    return r.withColumns({"points": points, "decodes": F.when(mobile, 2).otherwise(4), "cache": F.when(mobile, CACHE["mobile"]).otherwise(CACHE["desktop"]), "shading": fine, "fade": fine & ~mobile})


def admission(ticks: DataFrame, device: str = "desktop") -> DataFrame:
    """ticks(fetches, decodes, queued, pending, rtt, failures, waiting, busy, ...) with may_fetch, may_decode, lagging, next_fetches, next_decodes.

    One step up or down at most: fetches never grow while decoding or uploading lags or fetches fail.
    """
    most_fetches, most_queued, most_decodes, most_pending = LIMITS[device]
    c = F.col
    lagging = (c("busy") >= DECODE_HIGH) | (c("pending") >= most_pending * BACKLOG)
    wider = (c("rtt") <= RTT_GOOD) & (c("failures") <= FAILURE_LOW) & (c("waiting") > 0) & (c("fetches") < most_fetches)
    fetches = F.when(lagging | (c("failures") >= FAILURE_HIGH), F.greatest(c("fetches") - 1, F.lit(1))).when(wider, c("fetches") + 1).otherwise(c("fetches"))
    more = ~lagging & (c("waiting") > 0) & (c("decodes") < most_decodes)
    decodes = F.when(c("pending") >= most_pending, F.greatest(c("decodes") - 1, F.lit(1))).when(more, c("decodes") + 1).otherwise(c("decodes"))
    return ticks.withColumns({
        "may_fetch": (c("fetches") < most_fetches) & (c("queued") < most_queued), "may_decode": (c("decodes") < most_decodes) & (c("pending") < most_pending),
        "lagging": lagging, "next_fetches": fetches, "next_decodes": decodes,
    })


def readiness(facts: DataFrame) -> DataFrame:
    """facts(wanted, resident, in_flight, queued, decoded, failed, ...) with phase, fraction and churn; a negative or missing count is an error of that row: phase null."""
    c = F.col
    counts = ["wanted", "resident", "in_flight", "queued", "decoded", "failed"]
    good = F.coalesce(F.least(*counts) >= 0, F.lit(False))
    for n in counts:
        good = good & c(n).isNotNull()
    some = good & (c("wanted") > 0)
    outstanding = c("in_flight") + c("queued") + c("decoded")
    share = F.least(c("resident") / c("wanted"), F.lit(1.0))
    settled = (outstanding == 0) & (c("resident") >= c("wanted")) & (c("failed") == 0)
    phase = F.when(good & (c("wanted") == 0), "unknown").when(some & settled, "settled").when(some & (outstanding > 0) & (share >= SETTLING), "settling").when(some, "loading")
    return facts.withColumns({"phase": phase, "fraction": F.when(some, share), "churn": F.when(some, (c("in_flight") + c("queued")) / c("wanted"))})


def coverage(plans: DataFrame) -> DataFrame:
    """plans(sampled, total, exhaustive, complete, ...) with scope, percent and scale: a sample is exact only of a whole tree."""
    sampled, total = F.greatest("sampled", F.lit(0)), F.greatest("total", F.lit(0))
    exact = F.coalesce(F.col("exhaustive") & F.col("complete"), F.lit(False))
    percent = F.when(total > 0, F.floor(F.least(sampled / total, F.lit(1.0)) * 100 + 0.5)).otherwise(0).cast("int")
    scale = F.when(exact | (sampled <= 0), 1.0).otherwise(F.greatest(total / sampled, F.lit(1.0)))
    return plans.withColumns({"scope": F.when(exact, "exhaustive").otherwise("sampled"), "percent": percent, "scale": scale})


def terrain_sample(chunks: DataFrame, points: int) -> DataFrame:
    """chunks(key, chunk, i, x, y, z, class): every ceil(total / points)-th point in order of key and i, not finite ones out.

    Of chunks with equal keys the least `chunk` counts; a missing class is 255.
    """
    first = chunks.join(chunks.groupBy("key").agg(F.min("chunk").alias("chunk")), ["key", "chunk"], "left_semi")
    total = first.agg(F.greatest(F.ceil(F.count("*") / F.lit(points)), F.lit(1)).alias("stride"))
    placed = running(first.withColumn("one", F.lit(1)), [F.col("key"), F.col("i")], "one").join(F.broadcast(total))
    finite = F.lit(True)
    for c in "xyz":
        finite = finite & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return placed.where((F.pmod(F.col("total") - 1, F.col("stride")) == 0) & finite).select("key", "i", "x", "y", "z", F.coalesce(F.col("class"), F.lit(255)).alias("class"))


def load_plan(files: DataFrame, budget: int = 4_000_000, multiplier: float = 3.0, floor: int = 250_000) -> DataFrame:
    """files(count, ...) with mode, stride and target: all within the budget, voxels up to `multiplier` budgets, strides beyond."""
    budget = max(floor, budget)
    count = F.greatest("count", F.lit(0))
    mode = F.when(count <= budget, "all").when(count <= budget * multiplier, "voxel").otherwise("stride")
    stride = F.when(count > budget * multiplier, F.ceil(count / int(budget * multiplier))).otherwise(1).cast("long")
    return files.withColumns({"mode": mode, "stride": stride, "target": F.least(count, F.lit(budget)).cast("long")})


def clamped_range(ranges: DataFrame) -> DataFrame:
    """ranges(offset, length, size, ...) with bytes: what of a range lies within its file; null for what is no range."""
    o, n, s = F.col("offset"), F.col("length"), F.col("size")
    return ranges.withColumn("bytes", F.when((o >= 0) & (n >= 0) & (o <= s), F.least(n, s - o)))


def guarded(chunks: DataFrame) -> DataFrame:
    """chunks(scale, shift, origin, ...) that may still be placed: all three finite and the scale not 0."""
    good = F.col("scale") != 0
    for c in ("scale", "shift", "origin"):
        good = good & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return chunks.where(good)


def frame_times(frames: DataFrame, by: str, ms: str) -> DataFrame:
    """n, mean, median, p95 and longest of the times of each run."""
    return frames.where(F.col(ms).isNotNull() & ~F.isnan(ms)).groupBy(by).agg(F.count("*").alias("n"), F.avg(ms).alias("mean"), F.percentile(ms, 0.5).alias("median"), F.percentile(ms, 0.95).alias("p95"), F.max(ms).alias("longest"))
