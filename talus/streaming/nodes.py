"""Octree streaming as plans over node tables, and event-time windows over point streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import running


def node_scores(nodes: DataFrame, cap: int) -> DataFrame:
    """(cap - depth + 1) * 1000 + the size on screen in thousandths, at most 999; nodes below the cap go."""
    size = F.least(F.floor(F.col("screen") * 1000 + 0.5), F.lit(999))
    return nodes.where(F.col("depth") <= cap).withColumn("score", ((F.lit(cap) - F.col("depth") + 1) * 1000 + size).cast("long"))


def within_budget(nodes: DataFrame, budget: int) -> DataFrame:
    """nodes(key, score, point_count): best first while the total stays within the budget; the first always; score 0 never."""
    good = nodes.where("score > 0")
    t = running(good, [F.col("score").desc(), F.col("key")], "point_count")
    return t.where((F.col("total") <= budget) | (F.col("total") == F.col("point_count")))


def sampling_plan(nodes: DataFrame, points: int) -> DataFrame:
    """Shallow and large nodes first until the points are reached: the node that reaches them is the last."""
    t = running(nodes, [F.col("depth"), F.col("point_count").desc(), F.col("key")], "point_count")
    return t.where(F.col("total") - F.col("point_count") < points)


def eviction_plan(nodes: DataFrame, budget: int, release: float) -> DataFrame:
    """nodes(key, rank, depth, distance, point_count): worst first until what stays is within budget * release."""
    total = nodes.agg(F.sum("point_count").alias("resident"))
    t = running(nodes, [F.col("rank").desc(), F.col("depth").desc(), F.col("distance").desc(), F.col("key")], "point_count")
    t = t.join(F.broadcast(total))
    return t.where((F.col("resident") > budget) & (F.col("resident") - (F.col("total") - F.col("point_count")) > F.lit(budget * release))).drop("resident")


def frontier(nodes: DataFrame) -> DataFrame:
    """nodes(key): those that are no ancestor of another."""
    up = nodes.where(F.length("key") > 0).select(F.explode(F.transform(F.sequence(F.lit(0), F.length("key") - 1), lambda d: F.substring(F.col("key"), F.lit(1), d))).alias("a")).distinct()
    return nodes.join(up, F.col("key") == F.col("a"), "left_anti")


def tumbling(events: DataFrame, width: str, late: str | None = None) -> DataFrame:
    """Counts and sums of fixed windows of event time; with a watermark where events is a stream."""
    e = events.withWatermark("ts", late) if late and events.isStreaming else events
    w = e.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return w.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, width: str, slide: str) -> DataFrame:
    w = events.groupBy(F.window("ts", width, slide)).agg(F.count("*").alias("n"), F.max("value").alias("top"))
    return w.select(F.col("window.start").alias("start"), "n", "top")


def sessions(events: DataFrame, gap: str) -> DataFrame:
    w = events.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return w.select("user_id", F.col("session_window.start").alias("start"), "n", "total")


def read_stream(spark: SparkSession, path: str, schema, files: int = 1) -> DataFrame:
    """Files of a folder as a stream, `files` to a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)
