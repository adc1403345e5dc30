import random

import numpy as np

from talus.llm import ngram_join as J

from .common import clashing, rows, same


def brute(data, similarity=0.8):
    def grams(t):
        w = (t or "").lower().split()
        return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])

    sets = [grams(t) for _, t in data]
    near = [[j for j in range(len(data)) if j != i and sets[i] and sets[j] and len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j])] for i in range(len(data))]
    root = list(range(len(data)))
    for _ in data:
        for i, js in enumerate(near):
            root[i] = min([root[i], *(root[j] for j in js)], key=lambda r: data[r][0])
    return sorted((data[i][0], len(near[i]), data[root[i]][0]) for i in range(len(data)))


def got(df):
    return sorted((r["doc_id"], r["n_links"], r["class_id"]) for r in rows(df))


def family(rng, n, words, edits):
    base = [f"w{rng.randrange(5000)}" for _ in range(words)]
    out = []
    for _ in range(n):
        t = list(base)
        for _ in range(edits):
            t[rng.randrange(words)] = f"e{rng.randrange(10**6)}"
        out.append(" ".join(t))
    return out


def test_documents_against_sql(spark):
    sf = "/root/testdata/sf0.01"
    same(J.op2_ngram_join(spark, sf), J.OP2_SQL, sf)


def test_families_against_brute_force(spark):
    rng = random.Random(5)
    texts = [t for k in range(12) for t in family(rng, 7, 60 + 40 * k, 1 + k // 2)] + family(rng, 150, 120, 2)
    data = list(enumerate(texts))
    rng.shuffle(data)
    want = brute(data)
    assert sum(n for _, n, _ in want) > 500
    df = spark.createDataFrame(data, "doc_id long, text string")
    assert got(J.ngram_join(df)) == want
    assert got(J.ngram_join(df, leaf=20, depth=2)) == want  # buckets split, then go in blocks


def test_odd_rows(spark):
    long = " ".join(f"t{i}" for i in range(30000))
    data = [(1, None), (2, ""), (3, "a b c d e f"), (4, "A  b\tc d e f"), (5, "a b"), (6, "a b"), (7, long), (8, long + " more"), (9, " \n")]
    df = clashing(spark, data)
    assert got(J.ngram_join(df)) == brute(data)
    again = got(J.ngram_join(clashing(spark, [(3, "a b c d e f"), (3, "a b c d e f"), (3, "x y"), (4, "x y")])))
    assert again == [(3, 1, 3), (3, 1, 3), (3, 1, 3), (4, 1, 3)]
    assert len(rows(J.ngram_join(clashing(spark, [(None, "a b c d e f g"), (1, "a b c d e f g"), (None, None)])))) == 3
    assert rows(J.ngram_join(df.limit(0))) == []


def test_rows_without_a_key_keep_their_links(spark):
    base = [f"w{i}" for i in range(200)]
    data = [(None, " ".join(base)), (1, " ".join(base + ["one"])), (2, " ".join(base + ["one", "two"])), (None, " ".join(base[3:])), (None, " ".join(base[3:])), (None, "alone " * 9), (7, "x y z")]
    got = sorted(((r["doc_id"], r["n_links"], r["class_id"], r["kept"]) for r in rows(J.ngram_join(clashing(spark, data)))), key=str)
    assert got == sorted([(None, 4, 1, False), (1, 4, 1, True), (2, 4, 1, False), (None, 4, 1, False), (None, 4, 1, False), (None, 0, None, True), (7, 0, 7, True)], key=str)


def test_large_group_in_blocks(spark, monkeypatch):
    """Every document lacks its own word of a common text: all of them link with all others."""
    monkeypatch.setattr(J, "GROUP_BLOCK", 150)
    base = [f"w{i}" for i in range(400)]
    data = [(i, " ".join(base[:k] + [f"own{i}"] + base[k + 1 :])) for i in range(1200) for k in [(i * 37) % 400]]
    got = rows(J.ngram_join(spark.createDataFrame(data, "doc_id long, text string")))
    assert len(got) == 1200 and all(r["n_links"] == 1199 and r["class_id"] == 0 for r in got)


def test_forest_connects_what_links_connect():
    rng = np.random.default_rng(4)
    for n in (1, 2, 9, 60):
        link = np.triu(rng.random((n, n)) < 1.2 / n, 1)
        link |= link.T
        root = list(range(n))
        for x, y in zip(*np.nonzero(link)):
            a, b = root[x], root[y]
            root = [min(a, b) if r in (a, b) else r for r in root]
        made = list(range(n))
        for x, y in J.forest(link):
            a, b = made[x], made[y]
            made = [min(a, b) if r in (a, b) else r for r in made]
        assert made == root


def test_deep_paths_keep_the_recall(spark):
    """Pairs that share 51 of 64 values, each of them in buckets far over the leaf size, so that paths go four deep and more."""
    rng = np.random.default_rng(9)
    sig = np.repeat(rng.integers(0, 10, (1000, 64)), 2, 0)
    for row in sig[1::2]:
        at = rng.choice(64, 13, replace=False)
        row[at] = (row[at] + rng.integers(1, 10, 13)) % 10
    classes = spark.createDataFrame([(i, bytearray(x.astype("<u4").tobytes())) for i, x in enumerate(sig)], "c long, sig binary")
    edges = J.candidates(classes, 0.8, 0.9, leaf=1).where("abs(a - b) = 1 AND floor(a / 2) = floor(b / 2)")
    found = edges.selectExpr("floor(a / 2) AS pair").distinct().count()
    assert found >= 900


def test_texts_that_link_with_nothing_stay_where_they_are(spark):
    """Only the texts of classes that may link go through a shuffle, and each set goes once to each block pair."""
    rng = random.Random(8)
    texts = [" ".join(f"{rng.getrandbits(60):x}" for _ in range(600)) for _ in range(600)]
    data = [*enumerate(texts), (600, texts[0] + " more"), (None, texts[1] + " more"), (601, texts[2]), (601, texts[2])]
    df = spark.createDataFrame(data, "doc_id long, text string")
    moved = lambda: spark._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = moved()
        linked = sorted(((r["doc_id"], r["n_links"], r["class_id"]) for r in rows(J.ngram_join(df)) if r["n_links"]), key=str)
        assert linked == [(0, 1, 0), (1, 1, 1), (2, 2, 2), (600, 1, 0), (601, 2, 2), (601, 2, 2), (None, 1, 1)]
        assert moved() - before < sum(len(t) for _, t in data) / 2
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_among_keeps_all_members(spark):
    from pyspark.sql import functions as F

    from talus.shared import among

    rows_ = spark.range(100_000).selectExpr("if(id % 10 = 0, null, id) AS a", "id % 7 AS b").repartition(4)
    members = rows_.where("b = 3 AND (a % 5 = 1 OR a IS NULL)").distinct()
    kept = among(rows_, members, "a", "b")
    assert kept.columns == ["a", "b"] and kept.where("b = 3 AND (a % 5 = 1 OR a IS NULL)").count() == rows_.where("b = 3 AND (a % 5 = 1 OR a IS NULL)").count()
    assert kept.count() < 10_000
    assert among(rows_, members.where(F.lit(False)), "a", "b").count() == 0
