"""Tables in the folder that driver and executors share, connected components, joins on hot keys, order statistics."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Parts that the rows of one key are dealt to by `salt`.
SALTS = 64
#: Bits of an index into the words of 64 bits that `among` broadcasts: 2^18 rows at most.
WORD_BITS = 18

_scratch: list[tuple[object, str, str]] = []
_owner = [""]


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or else the checkpoint folder of the context.

    Only a local session, whose executors are its driver, may go without: it gets a temporary folder.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found and (at := spark.sparkContext._jsc.sc().getCheckpointDir()).isDefined():
        found = at.get()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="talus-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, name: str, scratch: bool = True) -> DataFrame:
    """Writes df as a table in the shared folder and reads it again: cuts lineage, survives lost executors.

    A scratch table is deleted by `drop_scratch`, or else when the JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/talus/{uuid.uuid4().hex}-{name}"
    if scratch:
        _scratch.append((spark.sparkContext, path, _owner[-1]))
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def scratch_of(owner: str) -> Iterator[None]:
    """Tables written inside belong to this owner, for `drop_scratch`."""
    _owner.append(owner)
    try:
        yield
    finally:
        _owner.pop()


def drop_scratch(spark: SparkSession, owner: str) -> None:
    """Deletes the tables that `written` made for this owner.  Call it only when every result built on them has been stored."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for i in range(len(_scratch) - 1, -1, -1):
        if _scratch[i][0] is spark.sparkContext and _scratch[i][2] == owner:
            path = jvm.org.apache.hadoop.fs.Path(_scratch[i][1])
            path.getFileSystem(conf).delete(path, True)
            del _scratch[i]


def among(rows: DataFrame, members: DataFrame, *cols: str) -> DataFrame:
    """Rows whose columns are those of a member, and few others: what a join with members would move in vain goes before.

    Members set bits by a hash.  Words of bits that hold any are broadcast, 2^WORD_BITS of them at most; with more members
    than bits nearly all rows stay.  No row that has a member is lost (nulls equal nulls), so a join must still follow.
    """
    here = lambda: F.xxhash64(*cols)
    word, bit = F.shiftrightunsigned(here(), 64 - WORD_BITS), here().bitwiseAND(F.lit(63)).cast("int")
    bits = members.select(word.alias("_w"), bit.alias("_b")).groupBy("_w").agg(F.expr("bit_or(shiftleft(1L, _b))").alias("_bits"))
    held = rows.join(F.broadcast(bits), word == F.col("_w")).where(F.getbit("_bits", bit) == 1)
    return held.drop("_w", "_bits")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components by alternating large-star and small-star steps.

    `edges` has two long columns; returns (node, component), component being the smallest node reached; nodes
    without an edge to another are absent.  Each step is one aggregation (combined before its shuffle) and one join whose
    large partitions adaptive execution can split; edges live in the shared folder between rounds, so that the cost of a
    round does not grow with the number of rounds, and never on the driver.
    """
    cur = written(edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a > b").distinct(), "edges")
    seen = None
    while True:
        both = cur.unionByName(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, F.col("a") == F.col("k")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b").distinct()
        large = written(large, "large")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least.withColumnRenamed("a", "k"), F.col("a") == F.col("k")).select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            least.select("a", F.col("m").alias("b"))
        )
        cur = written(small.where("a > b").distinct(), "small")
        now = cur.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == seen:
            break
        seen = tuple(now)
    labels = cur.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return labels.unionByName(labels.select(F.col("component").alias("node"), "component").distinct())


def salt(*cols: str | Column) -> Column:
    """0 to SALTS - 1: the part of its key that a row belongs to."""
    return F.pmod(F.xxhash64(*cols), F.lit(SALTS)).cast("int")


def salts_seen(name: str = "salt") -> Column:
    """Aggregate: the parts that a key has rows in, as bits."""
    return F.expr(f"bit_or(shiftleft(1L, {name}))")


def salts_of(bits: str) -> Column:
    """One row for each part in the bits of `salts_seen`: what is joined to a hot key meets its rows part by part."""
    return F.explode(F.expr(f"filter(sequence(0, {SALTS - 1}), i -> getbit({bits}, i) = 1)"))


def ranked(df: DataFrame, cols: list[str], by: str | None = None) -> DataFrame:
    """(by, col, v, place, n): every non-null value of the columns with its place from 0 in their order, per group and column.

    Values of one column and group may be all rows: they are sorted by range over many tasks, and places come from the
    sizes of the ranges before (a row for each range, column and group goes through a window).  No task holds a column.
    """
    group = F.col(by) if by else F.lit(None).cast("int")
    long = df.select(group.alias("by"), F.explode(F.array(*[F.struct(F.lit(c).alias("col"), F.col(c).cast("double").alias("v")) for c in cols])).alias("x")).select("by", "x.col", "x.v").where("v IS NOT NULL")
    # Equal values combine first: a value that most rows share costs one row.
    long = long.groupBy("by", "col", "v").agg(F.count("*").alias("m"))
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = written(long.repartitionByRange(n, "by", "col", "v").withColumn("part", F.spark_partition_id()), "ranked")
    sizes = cut.groupBy("by", "col", "part").agg(F.sum("m").alias("size"))
    whole = Window.partitionBy("by", "col")
    sizes = sizes.select(F.col("by").alias("g"), F.col("col").alias("c"), F.col("part").alias("p"), (F.sum("size").over(whole.orderBy("part")) - F.col("size")).alias("before"), F.sum("size").over(whole).alias("n"))
    inner = Window.partitionBy("by", "col", "part").orderBy("v")
    placed = cut.withColumn("inner", F.sum("m").over(inner) - F.col("m"))
    placed = placed.join(sizes, F.col("by").eqNullSafe(F.col("g")) & (F.col("col") == F.col("c")) & (F.col("part") == F.col("p")))
    return placed.select("by", "col", "v", "m", (F.col("before") + F.col("inner")).alias("place"), "n")


def order_statistics(df: DataFrame, wanted: dict[str, tuple[str, float | Column]], by: str | None = None) -> DataFrame:
    """One row (for each value of `by`): name -> the value of its column at quantile p with linear interpolation.

    `wanted` is name -> (column, p), p from 0 to 1.  Values come from `ranked`, so that a column of any length is sorted
    over many tasks.  A group without values is absent; without rows at all and without `by` the result has no rows.
    """
    rows = ranked(df, sorted({c for c, _ in wanted.values()}), by)
    out = []
    for name, (c, p) in wanted.items():
        at = (F.col("n") - 1) * F.lit(p)
        low, high = F.floor(at), F.ceil(at)
        here = lambda i: (F.col("col") == c) & (F.col("place") <= i) & (i < F.col("place") + F.col("m"))  # noqa: B023, E731
        a, b = F.max(F.when(here(low), F.col("v"))), F.max(F.when(here(high), F.col("v")))
        f = F.max(F.when(here(low), at - low))
        out.append((a + (b - a) * f).alias(name))
    got = rows.groupBy("by").agg(*out)
    return got.withColumnRenamed("by", by) if by else got.drop("by")


def running(df: DataFrame, by: list[Column], value: str) -> DataFrame:
    """df with `before` and `total`, the sums of `value` before and with each row in a total order.

    Ranges are sorted apart, and the sums of the ranges before are added: one row for each range goes through a window
    of its own, no row of df does.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = written(df.repartitionByRange(n, *by).withColumn("part", F.spark_partition_id()), "ranged")
    sums = ranged.groupBy("part").agg(F.sum(value).alias("t"))
    base = sums.select(F.col("part").alias("p"), F.coalesce(F.sum("t").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    inner = F.sum(value).over(Window.partitionBy("part").orderBy(*by).rowsBetween(Window.unboundedPreceding, 0))
    out = ranged.withColumn("inner", inner).join(F.broadcast(base), F.col("part") == F.col("p")).withColumn("total", F.col("inner") + F.col("base"))
    return out.withColumn("before", F.col("total") - F.col(value)).drop("part", "p", "inner", "base")
