import random
import zlib

import numpy as np
import pytest

from talus.llm import quality, toxicity

from .common import clashing


def auc(score, y):
    order = np.argsort(np.argsort(score))
    y = np.array(y)
    return (order[y == 1].mean() - order[y == 0].mean()) / len(y) + 0.5


@pytest.fixture(scope="module")
def labels(spark):
    return {r.doc_id: r for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}


@pytest.mark.parametrize("f, label, threshold, least", [(quality.op7_quality, "quality", 0.3, 0.97), (toxicity.op8_toxicity, "toxic", 0.5, 0.85)])
def test_held_out_accuracy(spark, labels, f, label, threshold, least):
    got = {r.doc_id: r for r in f(spark, "/root/testdata/sf0.1").collect()}
    assert len(got) == spark.read.parquet("/root/testdata/sf0.1/documents.parquet").count()
    for d, r in got.items():
        assert r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= threshold)
    rows = [(got[d].score, getattr(x, label), got[d].predicted) for d, x in labels.items() if d in got and got[d].held_out]
    s, y, p = zip(*rows)
    print(label, auc(s, y), np.mean(np.array(y) == np.array(p)), sum(a and not b for a, b in zip(y, p)), sum(b and not a for a, b in zip(y, p)), sum(y), len(y))
    assert auc(s, y) >= least and np.mean(np.array(y) == np.array(p)) >= 0.95


@pytest.mark.parametrize("f, label", [(quality.quality, "quality"), (toxicity.toxicity, "toxic")])
def test_odd_rows(spark, f, label):
    df = clashing(spark, [(1, None), (2, ""), (3, "word " * 50000), (4, "x"), (4, "x"), (None, "y")])
    none = spark.createDataFrame([], f"doc_id long, {label} int")
    got = f(df, none, label=label).collect()
    assert len(got) == 6 and {round(r.score, 9) for r in got} == {0.5 if label == "quality" else round(1 / 3, 9)}
    one = spark.createDataFrame([(1, 1), (2, None), (None, 1)], f"doc_id long, {label} int")
    assert len(f(df, one, label=label).collect()) == 6
    assert f(df.limit(0), none, label=label).collect() == []


def test_a_repeated_key_counts_once(spark):
    from talus.llm import _fit

    docs = clashing(spark, [(1, f"text {i}") for i in range(3000)] + [(2, "two"), (2, None), (3, "three"), (None, "none")])
    labels = spark.createDataFrame([(k, c) for k in (1, 2, 3) for c in (1, 0, 1)] + [(3, None)], "doc_id long, quality int")
    got = _fit.labelled_sample(docs, labels, "quality", 50).collect()
    assert sorted((r["key"], r["label"]) for r in got) == [(k, 0) for k in (1, 2, 3) if zlib.crc32(str(k).encode()) % 5]
    assert len(quality.quality(docs, labels).collect()) == len(toxicity.toxicity(docs, labels, label="quality").collect()) == 3004


def test_segments_against_brute_force():
    rng = random.Random(3)
    for _ in range(200):
        n = rng.randrange(1, 40)
        scores = [(i, rng.choice([0.5, 1.0, 2.0, 3.0])) for i in range(n) if rng.random() < 0.3]
        full = [-0.4] * n
        for i, s in scores:
            full[i] = s

        def maximal(lo, hi):  # by definition: the best segment (leftmost, shortest), then either side of it
            best = None
            for i in range(lo, hi):
                for j in range(i + 1, hi + 1):
                    t = sum(full[i:j])
                    if t > 1e-12 and (best is None or t > best[0] + 1e-12 or abs(t - best[0]) <= 1e-12 and (j - i, i) < (best[2] - best[1], best[1])):
                        best = (t, i, j)
            if best is None:
                return []
            return maximal(lo, best[1]) + [(best[1], best[2] - 1, best[0])] + maximal(best[2], hi)

        got = toxicity.segments(scores, 0.4)
        want = maximal(0, n)
        assert [round(s, 9) for _, _, s in got] == [round(s, 9) for _, _, s in want]


def test_toxic_passage_is_found(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    got = toxicity.toxicity(df, spark.read.parquet("/root/testdata/sf0.1/labels.parquet")).where("predicted = 1").collect()
    assert len(got) > 500 and all(p.first <= p.last and p.score > 0 for r in got for p in r.passages)
    assert sum(bool(r.passages) for r in got) > 0.8 * len(got)
