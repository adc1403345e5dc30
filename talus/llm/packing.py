"""Operator 10: packing documents into fixed-length sequences along a Hilbert curve."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import words as W
from ._base import own, table, written
from .bpe import slices

DIMS, BITS, HASHED = 3, 16, 512

class WordEncoder:
    """Ids of words by a tokenizer file whose pre-tokenizer splits text by the given pattern."""

    def __init__(self, tokenizer_file: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text

    def encode(self, words: list[str]) -> list[pa.Array]:
        """Per word: its ids as little-endian unsigned 32-bit numbers."""
        out: list = [None] * len(words)
        plain = [i for i, w in enumerate(words) if w[:1] == " " and w[1:].isalpha()]  # joined, they split into the same words again
        for at in range(0, len(plain), 1000):
            group = plain[at : at + 1000]
            e = self.tokenizer.encode("".join(words[i] for i in group), add_special_tokens=False)
            ids, own_word = np.array(e.ids, "<u4"), np.array(e.word_ids)
            if own_word[-1] != len(group) - 1:  # more words: a letter here that is none to the tokenizer's pattern
                continue
            ends = np.searchsorted(own_word, np.arange(len(group) + 1))
            raw = ids.tobytes()
            for k, i in enumerate(group):
                out[i] = raw[4 * ends[k] : 4 * ends[k + 1]]
        rest = [i for i, b in enumerate(out) if b is None]
        for at in range(0, len(rest), 5000):
            group = rest[at : at + 5000]
            for i, e in zip(group, self.tokenizer.encode_batch([words[i] for i in group], add_special_tokens=False), strict=True):
                out[i] = np.array(e.ids, "<u4").tobytes()
        return [pa.array(out, pa.binary())]


def _encoder(tokenizer_file: str) -> W.Lexicon:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return W.active(("ids", tokenizer_file), lambda: W.Lexicon(WordEncoder(tokenizer_file).encode))


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Distance along the Hilbert curve of integer points (n, dims), each coordinate below 2^bits (Skilling 2004)."""
    x = points.astype(np.int64).T.copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(dims):
            flip = (x[i] & q) != 0
            swap = np.where(flip, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(flip, p, swap)
            x[i] ^= np.where(flip, 0, swap) if i else 0
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where((x[-1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = key << 1 | (x[i] >> b & 1)
    return key


def curve_keys(ids: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """Hilbert key of each document: counts of its ids hashed to HASHED buckets, unit length, projected to DIMS."""
    rng = np.random.default_rng(seed)
    bucket = rng.integers(0, HASHED, 1 << 16)
    plane = rng.standard_normal((HASHED, DIMS)) / np.sqrt(HASHED)
    out = np.zeros((len(ends) - 1, DIMS))
    for i in range(len(out)):
        c = np.bincount(bucket[ids[ends[i] : ends[i + 1]] & 0xFFFF], minlength=HASHED).astype(float)
        out[i] = c @ plane / max(np.sqrt(c @ c), 1.0) * np.sqrt(HASHED)
    cells = np.clip((out / 6 + 0.5) * (1 << BITS), 0, (1 << BITS) - 1)  # projections of unit vectors are nearly standard normal
    return hilbert(cells.astype(np.int64))


def tokenised(df: DataFrame, tokenizer_file: str, pattern: str, end_id: int, text: str, key: str) -> DataFrame:
    """row, key, n (ids with the end id), curve, ids (binary): written once to the shared folder."""
    source = own(df, key=key, text=text)
    rows = source.select(F.monotonically_increasing_id().alias("row"), "key", W.pretokens(F.col("text"), pattern).alias("words"))
    kind = dict(source.dtypes)["key"]
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = _encoder(tokenizer_file)
        for batch in slices(batches):
            lists = batch.column("words")
            (raw,), at = lexicon.rows(lists.flatten())
            ends = np.r_[0, np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))].astype(np.int32)
            joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends), pc.take(raw, at)), b"")
            docs = [x.as_py() + end for x in joined]
            size = np.array([len(x) // 4 for x in docs], np.int64)
            flat = np.frombuffer(b"".join(docs), "<u4")
            keys = curve_keys(flat, np.r_[0, np.cumsum(size)])
            if flat.max(initial=0) < 1 << 16:  # half the bytes for vocabularies that allow it
                small = flat.astype("<u2").tobytes()
                cut = np.r_[0, np.cumsum(size)] * 2
                docs = [small[cut[i] : cut[i + 1]] for i in range(len(size))]
            yield pa.RecordBatch.from_pydict({"row": batch.column("row"), "key": batch.column("key"), "n": pa.array(size), "curve": pa.array(keys), "ids": pa.array(docs, pa.binary())})

    W.small_batches(df.sparkSession)
    return written(rows.mapInArrow(W.lean(run), f"row long, key {kind}, n long, curve long, ids binary"), "tokens")


def starts(tokens: DataFrame) -> DataFrame:
    """row -> place of its first id in the one stream of all documents along the curve.

    Only the small columns are range-sorted; ties on the curve go by key and row, so a large group of equal documents
    spreads over partitions.  Of each partition one total goes to the driver, and back as an offset.
    """
    n = int(tokens.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    small = tokens.select("row", "key", "n", "curve").repartitionByRange(n, "curve", "key", "row").withColumn("part", F.spark_partition_id())
    small = written(small, "order")
    at, base = 0, []
    for r in small.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect():  # a row for each partition
        base.append((r["part"], at))
        at += r["n"]
    bases = tokens.sparkSession.createDataFrame(base or [(0, 0)], "part int, base long")
    before = Window.partitionBy("part").orderBy("curve", "key", "row").rowsBetween(Window.unboundedPreceding, -1)
    placed = small.withColumn("inner", F.coalesce(F.sum("n").over(before), F.lit(0)))
    return placed.join(F.broadcast(bases), "part").select(F.col("row").alias("at_row"), (F.col("base") + F.col("inner")).alias("start"))


def pack(df: DataFrame, tokenizer_file: str, pattern: str, length: int = 2048, end_id: int = 1, text: str = "text", key: str = "doc_id", with_ids: bool = True) -> DataFrame:
    """Packs all documents into sequences of `length` ids: a row for each piece of a document.

    Returns key, start, length, ids (little-endian unsigned 32-bit, if with_ids), ids_crc32, doc_tokens, sequence_id
    and offset.  Neighbours along the curve share sequences; documents are cut at sequence ends, so only the very last
    sequence is short.  A null or empty text is the end id alone; repeated keys are packed row by row; other columns
    are ignored; an empty table gives no rows.
    """
    tokens = tokenised(df, tokenizer_file, pattern, end_id, text, key)
    rows = tokens.join(starts(tokens), F.col("row") == F.col("at_row")).select("key", "n", "ids", F.col("start").alias("g"))
    kind = dict(rows.dtypes)["key"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for k, n, raw, g in zip(*(batch.column(c).to_pylist() for c in ("key", "n", "ids", "g")), strict=True):
                ids = np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4").astype("<u4")
                at = 0
                while at < n:
                    size = min(n - at, length - (g + at) % length)
                    piece = ids[at : at + size].tobytes()
                    for column, x in zip(out, (k, at, size, zlib.crc32(piece), n, (g + at) // length, (g + at) % length, piece), strict=False):
                        column.append(x)
                    at += size
            types = [batch.schema.field("key").type, *[pa.int64()] * 6, pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types, strict=False)], names=names)

    schema = f"key {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids binary" * with_ids
    return rows.mapInArrow(W.lean(run), schema).withColumnRenamed("key", key)


def op10_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    return pack(table(spark, sf_dir, "documents"), P.path("byte_bpe_50k.json"), P.PATTERN, with_ids=False)
