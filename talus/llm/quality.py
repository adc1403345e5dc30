"""Operator 7: a quality classifier by compression with zstandard dictionaries of good and of bad text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._base import own, table, written
from ._fit import held_out, labelled_sample, logistic, sigmoid

#: Labelled rows of each class that the model is fitted on, at most.
MAX_LABELLED = 3_000
#: Bytes of each dictionary at most, and characters of the passage that one document gives to it.
DICTIONARY, PASSAGE = 400_000, 1_500
LEVEL = 3


class Sizes:
    """Compressed sizes of a text alone and after each of the two dictionaries."""

    def __init__(self, good: bytes, bad: bytes):
        import zstandard as Z

        def compressor(content: bytes):
            if len(content) < 8:
                return Z.ZstdCompressor(level=LEVEL, write_content_size=False)
            d = Z.ZstdCompressionDict(content, dict_type=Z.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            return Z.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False)

        self.good, self.bad, self.alone = compressor(good), compressor(bad), compressor(b"")

    def features(self, texts) -> np.ndarray:
        """Normalised difference of the two sizes, own compression ratio, and their products, with the length."""
        out = np.empty((len(texts), 4))
        for i, t in enumerate(texts):
            b = (t or "").encode("utf-8", "replace")
            g, k, p = len(self.good.compress(b)), len(self.bad.compress(b)), len(self.alone.compress(b))
            out[i] = (k - g) / (k + g), p / (len(b) + 1), np.log(len(b) + 1), 0
        d, r, n = np.clip(out[:, 0] * 10, -3, 3), np.clip(out[:, 1], 0, 1.5), out[:, 2] / 10
        return np.c_[d, d * d, r, r * r, d * r, n, n * n, d * n, r * n]


def halves(sample: DataFrame) -> DataFrame:
    """The sample with `teaches`: of every two rows, dealt by a hash of the key, about one goes into a dictionary."""
    return sample.withColumn("teaches", F.pmod(F.xxhash64(F.col("key").cast("string"), F.lit(7)), F.lit(2)) == 0)


def passages(sample: DataFrame) -> list[tuple[int, str]]:
    """(label, passage) of the rows that teach, in order of their hashes: PASSAGE characters from a place that the hash names."""
    h = F.xxhash64(F.col("key").cast("string"), F.lit(11))
    at = F.pmod(h, F.greatest(F.length("text") - PASSAGE + 1, F.lit(1))).cast("int") + 1
    rows = sample.where("teaches").select("label", F.substring("text", at, F.lit(PASSAGE)).alias("passage"), h.alias("h"), "key")
    return [(r["label"], r["passage"]) for r in sorted(rows.collect(), key=lambda r: (r["h"], str(r["key"])))]


def fit(df: DataFrame, labels: DataFrame, label: str, text: str, key: str, most: int = MAX_LABELLED) -> tuple[bytes, bytes, np.ndarray]:
    """(good dictionary, bad dictionary, weights): half of the labelled rows make the dictionaries, half calibrate.

    What comes to the driver is bounded: a passage of each row that teaches, nine numbers of each that calibrates.
    """
    sample = written(halves(labelled_sample(df, labels, label, most, key, text)), "labelled")
    content: dict[int, list[bytes]] = {0: [], 1: []}
    for c, passage in passages(sample):
        if sum(map(len, content[c])) < DICTIONARY:
            content[c].append(passage.encode("utf-8", "replace"))
    good, bad = (b"".join(content[c])[:DICTIONARY] for c in (1, 0))

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sizes = Sizes(good, bad)
        for b in batches:
            x = sizes.features(b["text"].tolist())
            yield pd.DataFrame({"key": b["key"].astype(str), "label": b["label"], "x": list(x)})

    rest = sorted(sample.where("NOT teaches").mapInPandas(features, "key string, label int, x array<double>").collect(), key=lambda r: r["key"])
    y = np.array([r["label"] for r in rest], float)
    if not 0 < y.sum() < len(y):  # nothing to tell apart: the share of good rows is the score
        n, ones = sample.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
        share = (ones + 1) / (n + 2)
        return good, bad, np.r_[np.zeros(9), np.log(share / (1 - share))]
    return good, bad, logistic(np.array([r["x"] for r in rest]), y)


_models: dict[int, Sizes] = {}


def quality(df: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality", threshold: float = 0.3, most: int = MAX_LABELLED) -> DataFrame:
    """key, held_out, score, predicted for each row.

    The score is the calibrated chance of label 1, from compressed sizes of the whole text alone.  Null and empty texts
    are scored as empty.  Rows of null key are scored and count as held out; without usable labels of both classes each
    row gets the share of label 1 among them (0.5 without any); other columns are ignored.
    The fit reads `most` labelled rows of each class at most, a repeated key once: half of them give a passage of PASSAGE
    characters each to dictionaries of DICTIONARY bytes at most, the method's own parameters, and whole texts of the
    other half calibrate.  So what goes to the driver and the workers is bounded.
    """
    spark = df.sparkSession
    model = fit(df, labels, label, text, key, most)
    model_id = hash(model[:2])
    shared = spark.sparkContext.broadcast(model)
    rows = own(df, key=key, text=text)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        good, bad, w = shared.value
        if model_id not in _models:
            _models.clear()
            _models[model_id] = Sizes(good, bad)
        for b in batches:
            x = _models[model_id].features(b["text"].tolist())
            yield pd.DataFrame({"key": b["key"], "held_out": b["held_out"], "score": sigmoid(x @ w[:-1] + w[-1])})

    scored = rows.select("key", held_out(F.col("key")).alias("held_out"), "text").mapInPandas(run, f"key {dict(rows.dtypes)['key']}, held_out boolean, score double")
    return scored.select(F.col("key").alias(key), "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op7_quality(spark, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
