import hashlib
import random

import numpy as np

from talus.llm import suffix_dedup as S

from .common import clashing, rows, same


def brute(data, length=50):
    raw = [(k, (t or "").encode()) for k, t in data]
    low = {}
    for k, x in raw:
        for p in range(len(x) - length + 1):
            s = x[p : p + length]
            low[s] = min(low.get(s, float("inf")), float("inf") if k is None else k)
    out = []
    for k, x in raw:
        gone = np.zeros(len(x) + 1, bool)
        for p in range(len(x) - length + 1):
            if low[x[p : p + length]] < (float("inf") if k is None else k):
                gone[p : p + length] = True
        spans = int((np.diff(np.r_[False, gone[: len(x)]].astype(int)) == 1).sum())
        kept = bytes(b for b, g in zip(x, gone) if not g)
        out.append((k, len(x), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows(df)), key=str)


def test_documents_against_sql(spark, sf):
    same(S.op5_suffix_dedup(spark, sf), S.OP5_SQL, sf)


def test_planted_repeats(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefé ") for _ in range(rng.randrange(1, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared = [text(30) for _ in range(6)]
    data = [(i, " ".join(rng.choice([text(rng.randrange(0, 40)), rng.choice(shared), rng.choice(shared)[13:90]]) for _ in range(4))) for i in range(120)]
    data += [(200 + i, data[3][1]) for i in range(20)] + [(300, "ab" * 400), (301, "ab" * 300), (302, "x" * 50), (303, "x" * 49), (304, "x" * 51)]
    rng.shuffle(data)
    assert got(S.repeats(spark.createDataFrame(data, "doc_id long, text string").repartition(7))) == brute(data)


def test_odd_rows(spark):
    long = "".join(chr(97 + i * i % 23) + str(i) for i in range(30000))
    data = [(1, None), (2, ""), (3, "short"), (4, "short"), (5, long), (6, "y" + long[1000:]), (7, "z" * 60), (7, "z" * 60), (7, "z" * 70), (None, "z" * 55), (None, "null " * 20), (8, "é" * 40), (9, "é" * 40)]
    assert got(S.repeats(clashing(spark, data))) == brute(data)
    assert rows(S.repeats(clashing(spark, data).limit(0))) == []


def test_names_of_equal_strings_are_equal():
    x = np.frombuffer(b"the quick brown fox jumps over the lazy dog and the quick brown fox jumps over the moon", np.uint8)
    for n in (3, 8, 16, 20, 33):
        name, h = S.doubled(x, n)
        assert h == n and len(name) == len(x) - n + 1
        want = {}
        for i in range(len(name)):
            want.setdefault(bytes(x[i : i + n]), set()).add(int(name[i]))
        assert all(len(v) == 1 for v in want.values()) and len({next(iter(v)) for v in want.values()}) == len(want)


def test_names_that_collide_do_not_mark(spark, monkeypatch):
    """Names of 12 bits: many strings share one, and only their bytes tell them apart."""
    pair = S._pair
    monkeypatch.setattr(S, "_pair", lambda a, b: pair(a, b) & np.uint64(0xFFF))
    rng = random.Random(7)
    data = np.frombuffer(bytes(rng.choice(b"abcd") for _ in range(3000)) * 2, np.uint8)
    at = np.arange(len(data) - 49)
    name, _ = S.doubled(data, 50)
    order = (at >= 3000).astype(np.int64)
    first = {}
    for i in at:
        first.setdefault(data[i : i + 50].tobytes(), order[i])
    want = [order[i] > first[data[i : i + 50].tobytes()] for i in at]
    assert S._not_first(name, order, data, at, 50).tolist() == want and 0 < sum(want) < len(want)


def test_documents_of_one_number_are_told_apart():
    order, fp = np.array([1, 1, 2, 2], np.int64), np.array([5, 6, 5, 5], np.int64)
    seed = S._local(order, fp)
    assert len(set(S._mixed(order, fp, seed).tolist())) == 3
