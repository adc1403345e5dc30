"""Operator 3: exact dedup through an extendible-hash index on shared files.  DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._base import own, salt, salts_of, salts_seen, table, written

#: The directory has 2^MAX_DEPTH slots at most, so that broadcasting it is bounded whatever the input.
MAX_DEPTH = 18
#: Distinct hashes that a bucket holds before its half of the directory is doubled.
CAPACITY = 5_000


def normalised(text: Column) -> Column:
    """Null as empty; each run of [\\x20\\x09-\\x0D] as one space.  Single spaces already are one: they need no match."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x09-\\x0D][\\x20\\x09-\\x0D]*|\\x20[\\x20\\x09-\\x0D]+", " ")


def directory(slots: dict[int, int], capacity: int, max_depth: int = MAX_DEPTH) -> list[tuple[int, int, int]]:
    """Doubles the directory until no bucket is overfull: (first slot, slots, local depth) of each bucket.

    `slots` counts the keys of each of 2^max_depth slots.  Buckets still overfull at max_depth stay and chain.
    """
    ends = [0]
    for i in range(1 << max_depth):
        ends.append(ends[-1] + slots.get(i, 0))
    buckets, todo = [], [(0, 0)]
    while todo:
        depth, prefix = todo.pop()
        width = 1 << (max_depth - depth)
        if ends[(prefix + 1) * width] - ends[prefix * width] <= capacity or depth == max_depth:
            buckets.append((prefix * width, width, depth))
        else:
            todo += [(depth + 1, 2 * prefix), (depth + 1, 2 * prefix + 1)]
    return sorted(buckets)


def hashed(norm: Column) -> Column:
    """The hash whose leading bits name a text's slot in the directory."""
    return F.xxhash64(norm)


def build_index(texts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """texts(key, salt, norm, h) -> the index, in shared files by bucket: bucket, h, chain, sha, keep_id, group_size, salts.

    The directory doubles over the counts of distinct hashes, until no bucket is overfull.  Each bucket, a range of
    hashes, then belongs to one owner task.  The rows of its range move there once; there the bytes of all texts of one
    hash are compared, equal ones become one entry, and different ones of one hash chain.  A hash that so many rows
    share that it would fill a good part of a task (fewer than 4 for each owner can) is combined before it moves.
    """
    spark = texts.sparkSession
    hashes = written(texts.groupBy("h").agg(F.count("*").alias("n")), "hashes")
    slot = lambda depth: F.shiftrightunsigned("h", 64 - depth) if depth else F.lit(0).cast("long")
    counted = hashes.groupBy(slot(MAX_DEPTH).alias("slot")).agg(F.count("*").alias("n"), F.sum("n").alias("rows")).collect()  # 2^MAX_DEPTH rows at most
    buckets = directory({r["slot"]: r["n"] for r in counted}, capacity)
    depth = max(1, *(d for _, _, d in buckets))  # the directory has 2^depth slots
    owners = max(1, min(len(buckets), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    rows = [(s, i, i * owners // len(buckets)) for i, (first, width, _) in enumerate(buckets) for s in range(first >> (MAX_DEPTH - depth), (first + width) >> (MAX_DEPTH - depth))]
    slots = F.broadcast(spark.createDataFrame(rows, "slot long, bucket int, owner int"))
    hot = F.broadcast(hashes.where(F.col("n") > max(1_000, sum(r["rows"] for r in counted) // (4 * owners))).select(F.col("h").alias("hot")))
    placed = texts.withColumn("slot", slot(depth)).join(slots, "slot").drop("slot")
    entry = [F.min("key").alias("keep_id"), F.count("*").alias("group_size"), salts_seen().alias("salts")]
    compare = lambda df: df.groupBy("owner", "bucket", "h", "norm").agg(*entry)
    cold = compare(placed.join(hot, F.col("h") == F.col("hot"), "left_anti").repartitionById(owners, "owner"))
    entries = cold.unionByName(compare(placed.join(hot, F.col("h") == F.col("hot"), "left_semi")))
    entries = entries.select("owner", "bucket", "h", F.sha2("norm", 256).alias("sha"), "keep_id", "group_size", "salts")
    chain = Window.partitionBy("owner", "bucket", "h").orderBy("keep_id", "sha")
    chained = entries.repartitionById(owners, "owner").withColumn("chain", F.row_number().over(chain))
    return written(chained.sortWithinPartitions("bucket", "h", "chain"), "index")


def exact_dedup(df: DataFrame, text: str = "text", key: str = "doc_id", capacity: int = CAPACITY) -> DataFrame:
    """One row per input row: key, keep_id, group_size, kept, text_sha256.

    Null texts count as empty and so equal each other.  keep_id is the smallest key of the rows of equal text; null
    keys count only where a group has no other.  Rows that repeat a key with an equal text all carry the same answer.
    An empty table gives no rows; other columns are ignored.  Texts of any length are compared whole.
    """
    texts = own(df, key=key, text=text)
    texts = texts.select("key", normalised(F.col("text")).alias("norm")).withColumn("h", hashed(F.col("norm"))).withColumn("salt", salt("key"))
    index = build_index(texts, capacity).select(F.col("h").alias("ih"), F.col("sha").alias("isha"), "keep_id", "group_size", salts_of("salts").alias("isalt"))
    # Each row looks its entry up in the index; the rows of a large group meet it in parts.
    postings = texts.select("key", "h", "salt", F.sha2("norm", 256).alias("text_sha256"))
    found = postings.join(index, (F.col("h") == F.col("ih")) & (F.col("salt") == F.col("isalt")) & (F.col("text_sha256") == F.col("isha")))
    return found.select(F.col("key").alias(key), "keep_id", "group_size", F.col("key").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def op3_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


OP3_SQL = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = min(doc_id) OVER g AS kept, sha256(norm) AS text_sha256
FROM t WINDOW g AS (PARTITION BY norm)
"""
