"""Small fits on the driver over bounded samples of labelled rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(key: Column) -> Column:
    """crc32 of the key as text, modulo 5, is 0: such rows teach nothing.  A null key counts as held out."""
    return F.coalesce(F.crc32(key.cast("string")) % 5 == 0, F.lit(True))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: int, key: str = "doc_id", text: str = "text", each: bool = True) -> DataFrame:
    """(key, label, text) of labelled rows that are not held out: the `most` of each class (or of all) whose keys hash lowest.

    A key with labels of both classes has the smaller one; of rows that repeat a key, the text of the least hash counts.
    So there are `most` rows at most (of each class), whatever repeats.  Only keys and labels are broadcast.
    """
    rows = labels.select(labels[f"`{key}`"].alias("lkey"), labels[f"`{label}`"].alias("label")).where("label IN (0, 1) AND lkey IS NOT NULL").where(~held_out(F.col("lkey")))
    rows = rows.groupBy("lkey").agg(F.min("label").alias("label"))
    order = [F.xxhash64("lkey"), F.col("lkey")]
    parts = [rows.where(F.col("label") == c).orderBy(*order).limit(most) for c in (0, 1)] if each else [rows.orderBy(*order).limit(most)]
    few = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    source = docs.select(docs[f"`{key}`"].alias("key"), F.coalesce(docs[f"`{text}`"], F.lit("")).alias("text"))
    found = source.join(F.broadcast(few), F.col("key") == F.col("lkey")).select("key", F.col("label").cast("int").alias("label"), "text")
    return found.groupBy("key", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text"))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 60) -> np.ndarray:
    """Weights of a logistic regression, the last one the intercept; both classes may be missing."""
    a = np.c_[x, np.ones(len(x))]
    w = np.zeros(a.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -35, 35)))
        h = (a.T * (p * (1 - p) + 1e-9)) @ a + ridge * np.eye(len(w))
        step = np.linalg.solve(h, a.T @ (y - p) - ridge * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max(initial=0) < 1e-8:
            break
    return w


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))
