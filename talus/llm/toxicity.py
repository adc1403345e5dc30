"""Operator 8: toxic passages as maximal scoring segments of token log-odds, calibrated by extreme values."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words as W
from ._base import own, table, written
from ._fit import held_out, labelled_sample, logistic, sigmoid

#: Labelled rows that the model is fitted on, at most (the rows whose keys hash lowest).
MAX_LABELLED = 30_000
#: Of these, rows whose texts go to the driver to calibrate segment scores.
MAX_CALIBRATED = 3_000
#: Strength of the Dirichlet prior, in words; least z and least log-odds of a lexicon word; its share inside a toxic passage.
PRIOR, LEAST_Z, LEAST_ODDS, DENSITY = 1_000.0, 4.5, 1.5, 0.05

_WORD = re.compile(r"[^\W\d_]+")


def tokens(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def log_odds(toxic: Column, clean: Column, prior: Column, t_all: float, c_all: float, a_all: float) -> tuple[Column, Column]:
    """Log-odds of a word under a Dirichlet prior shaped like both classes together, and the signed root of its likelihood ratio.

    The prior gives each word half a count at least, so that a word unseen in one class stays finite.
    """
    t, c, both, share = t_all + a_all, c_all + a_all, toxic + clean, t_all / (t_all + c_all)
    odds = F.log((toxic + prior) / (t - toxic - prior)) - F.log((clean + prior) / (c - clean - prior))
    part = lambda n, e: F.when(n > 0, n * F.log(n / e)).otherwise(0.0)
    ratio = 2 * (part(toxic, both * share) + part(clean, both * (1 - share)))
    return odds, F.signum(toxic - both * share) * F.sqrt(F.greatest(ratio, F.lit(0.0)))


def segments(scores: list[tuple[int, float]], drift: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first token, last token, score) in linear time (Ruzzo and Tompa 1999).

    `scores` lists the tokens of positive score in order; every other token scores -drift.
    """
    found: list[list[float]] = []  # first, last, total before, total after
    total, before = 0.0, -1
    for at, s in scores:
        total -= drift * (at - before - 1)
        new = [at, at, total, total + s]
        total += s
        before = at
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= new[2]:
                j -= 1
            if j < 0 or found[j][3] >= new[3]:
                found.append(new)
                break
            new = [found[j][0], new[1], found[j][2], new[3]]
            del found[j:]
    return [(int(a), int(b), r - l) for a, b, l, r in found]


class Model:
    """Lexicon of scores, drift, and the parameters lambda and K of the extreme-value law of clean text."""

    def __init__(self, lexicon: dict[str, float], drift: float, lam: float, k: float, weights: np.ndarray):
        self.lexicon, self.drift, self.lam, self.k, self.weights = lexicon, drift, lam, k, weights

    def passages(self, text: str | None) -> tuple[list[str], list[tuple[int, int, float]]]:
        words = tokens(text)
        get = self.lexicon
        return words, segments([(i, get[w]) for i, w in enumerate(words) if w in get], self.drift)

    def evidence(self, n: int, found: list[tuple[int, int, float]]) -> tuple[float, float]:
        """-ln of the expected number of segments as good in clean text of that length: the best, and the significant ones' sum."""
        e = [self.lam * s - math.log(self.k * (n + 1)) for _, _, s in found]
        return max(e, default=-math.log(self.k * (n + 1))), sum(x for x in e if x > 0)

    def features(self, n: int, found: list) -> list[float]:
        best, total = self.evidence(n, found)
        return [max(-10.0, min(best, 30.0)) / 10, math.log1p(total), float(bool(found))]

    def score(self, text: str | None) -> tuple[float, list, list[str]]:
        words, found = self.passages(text)
        f = np.array(self.features(len(words), found))
        return float(sigmoid(f @ self.weights[:-1] + self.weights[-1])), found, words


def karlin_lambda(p: np.ndarray, s: np.ndarray) -> float:
    """The positive root of sum p exp(lambda s) = 1, for scores of negative mean."""
    if not (s > 0).any() or p @ s >= 0:
        return 1.0
    low, high = 0.0, 1.0
    while p @ np.exp(high * s) < 1 and high < 64:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if p @ np.exp(mid * s) < 1 else (low, mid)
    return max(high, 1e-6)


def fit(df: DataFrame, labels: DataFrame, label: str, text: str, key: str, most: int = MAX_LABELLED, calibrated: int = MAX_CALIBRATED) -> Model:
    sample = labelled_sample(df, labels, label, most, key, text, each=False)
    sample = sample.dropDuplicates(["label", "text"])  # copies are one witness

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            seen = (Counter(), Counter())
            for c, t in zip(b["label"], b["text"], strict=True):
                seen[c].update(set(tokens(t)))  # a document counts once: words burst
            words = list(seen[0].keys() | seen[1].keys())
            yield pd.DataFrame({"word": words, "toxic": [seen[1][w] for w in words], "clean": [seen[0][w] for w in words]}).astype({"word": str})

    counts = written(sample.mapInPandas(count, "word string, toxic long, clean long").groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")), "words")
    t_all, c_all = (int(x or 0) for x in counts.agg(F.sum("toxic"), F.sum("clean")).first())
    # Words seen more often in clean rows cannot be toxic: they count as one.  Scores are computed where the counts are,
    # and only the words of the lexicon, each seen often enough in a bounded sample, come to the driver.
    likely = counts.where(f"toxic >= 3 AND toxic * {max(c_all, 1)}D > 2 * clean * {max(t_all, 1)}D")
    own_prior = F.greatest(PRIOR * (F.col("toxic") + F.col("clean")) / max(t_all + c_all, 1), F.lit(0.5))
    t_own, c_own, a_own = (float(x or 0) for x in likely.agg(F.sum("toxic"), F.sum("clean"), F.sum(own_prior)).first())
    a_all = a_own + max(PRIOR * (t_all + c_all - t_own - c_own) / max(t_all + c_all, 1), 0.5)
    lexicon, in_clean = {}, {}
    if t_all and c_all:
        odds, z = log_odds(F.col("toxic"), F.col("clean"), own_prior, t_all, c_all, a_all)
        for r in likely.select("word", "clean", odds.alias("odds"), z.alias("z")).where((F.col("z") >= LEAST_Z) & (F.col("odds") >= LEAST_ODDS)).orderBy("word").collect():
            lexicon[r["word"]], in_clean[r["word"]] = r["odds"], r["clean"]
    drift = -math.log(1 - DENSITY)
    p = np.array([in_clean[w] + 0.5 for w in lexicon] + [max(c_all - sum(in_clean.values()), 1.0)])
    lam = karlin_lambda(p / p.sum(), np.array([*lexicon.values(), -drift]))
    model = Model(lexicon, drift, lam, 1.0, np.array([1.0, 0, 0, 0]))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [model.passages(t) for t in b["text"]]
            yield pd.DataFrame({"key": b["key"].astype(str), "label": b["label"], "n": [len(w) for w, _ in found], "scores": [[s for _, _, s in f] for _, f in found]})

    # Of each calibrating text, its length and the scores of its segments come to the driver.
    rows = labelled_sample(df, labels, label, calibrated, key, text).mapInPandas(search, "key string, label int, n long, scores array<double>").collect()
    rows = sorted(rows, key=lambda r: r["key"])
    y = np.array([r["label"] for r in rows], float)
    seen = [(r["n"], [(0, 0, s) for s in r["scores"]]) for r in rows]
    # K by maximum likelihood for a Gumbel law of the best segment of clean rows.
    clean_rows = [(n, max((s for _, _, s in f), default=0.0)) for (n, f), c in zip(seen, y, strict=True) if c == 0]
    if clean_rows:
        model.k = min(max(len(clean_rows) / max(sum((n + 1) * math.exp(-lam * s) for n, s in clean_rows), 1e-9), 1e-9), 10.0)
    share = len(y) and y.mean()
    if 0 < share < 1:
        true_share = t_rows / n_rows if (n_rows := (tot := labels.where(~held_out(F.col(f"`{key}`"))).agg(F.count(f"`{label}`").alias("n"), F.sum(f"`{label}`").alias("t")).first())["n"]) and (t_rows := tot["t"]) else share
        model.weights = logistic(np.array([model.features(n, f) for n, f in seen]), y)
        if 0 < true_share < 1:  # the classes were sampled separately: back to their true shares
            model.weights[-1] += math.log(true_share / (1 - true_share)) - math.log(share / (1 - share))
    else:
        model.weights = np.array([0, 0, 0, math.log((y.sum() + 0.5) / (len(y) - y.sum() + 1))])  # below a half where nothing is labelled
    return model


def toxicity(df: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic", threshold: float = 0.5, most: int = MAX_LABELLED, with_passages: bool = True) -> DataFrame:
    """key, held_out, score, predicted and (if with_passages) passages: significant toxic segments of the whole text.

    passages is an array of (first, last, score, words), first and last being word numbers from 0.  Null and empty
    texts are scored as empty texts and have no passages.  Rows of null key count as held out.  Without usable labels
    of both classes every row gets one score, about the share of label 1 (a third without any label); other columns are ignored.  The fit reads `most` labelled rows
    at most; the lexicon is thereby bounded.
    """
    model = df.sparkSession.sparkContext.broadcast(fit(df, labels, label, text, key, most))
    rows = own(df, key=key, text=text)
    kind = "array<struct<first: long, last: long, score: double, words: string>>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = model.value
        for b in batches:
            scored = [m.score(t) for t in b["text"]]
            out = pd.DataFrame({"key": b["key"], "held_out": b["held_out"], "score": [s for s, _, _ in scored]})
            if with_passages:
                least = [math.log(m.k * (len(w) + 1)) / m.lam for _, _, w in scored]
                out["passages"] = [[{"first": i, "last": j, "score": s, "words": " ".join(w[i : j + 1])} for i, j, s in f if s > e] for (_, f, w), e in zip(scored, least, strict=True)]
            yield out

    out = rows.select("key", held_out(F.col("key")).alias("held_out"), "text").mapInPandas(run, f"key {dict(rows.dtypes)['key']}, held_out boolean, score double" + f", passages {kind}" * with_passages)
    return out.select(F.col("key").alias(key), "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"), *["passages"] * with_passages)


def without_toxic(df: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic", threshold: float = 0.5, most: int = MAX_LABELLED) -> DataFrame:
    """The rows of df, with all their columns, whose score is below the threshold.  Nothing shuffles."""
    model = df.sparkSession.sparkContext.broadcast(fit(df, labels, label, text, key, most))

    def run(batches):
        import pyarrow as pa

        m = model.value
        for b in batches:
            yield b.filter(pa.array([m.score(t)[0] < threshold for t in b.column(text).to_pylist()], pa.bool_()))

    W.small_batches(df.sparkSession)
    return df.mapInArrow(W.lean(run), df.schema)


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), with_passages=False)
