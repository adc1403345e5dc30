import math
import random

import numpy as np

from talus.llm import vector_dedup as V

from .common import clashing, rows, same


def brute(data, threshold=0.95):
    def usable(v):
        return v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)

    ok = [i for i, (_, v) in enumerate(data) if usable(v)]
    near = {i: [] for i in range(len(data))}
    for i in ok:
        for j in ok:
            a, b = data[i][1], data[j][1]
            if i != j and len(a) == len(b):
                a, b = np.array(a, float), np.array(b, float)
                if a @ b / math.sqrt(a @ a) / math.sqrt(b @ b) >= threshold:
                    near[i].append(j)
    root = list(range(len(data)))
    for _ in data:
        for i, js in near.items():
            root[i] = min([root[i], *(root[j] for j in js)], key=lambda r: data[r][0])
    return sorted((data[i][0], len(near[i]), data[root[i]][0]) for i in range(len(data)))


def got(df):
    return sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in rows(df))


def test_embeddings_against_sql(spark, sf):
    same(V.op9_vector_dedup(spark, sf), V.OP9_SQL, sf)


def test_recall_against_brute_force(spark):
    """Random directions without clusters, partners close to the threshold: the hardest case."""
    rng = np.random.default_rng(3)
    base = rng.standard_normal((700, 32))
    data = list(base)
    for i in range(500):
        noise = rng.standard_normal(32)
        noise *= np.linalg.norm(base[i]) / np.linalg.norm(noise) * rng.uniform(0.05, 0.33)
        data.append(base[i] + noise)
    data = [(i, [float(x) for x in v]) for i, v in enumerate(data)]
    want = brute(data)
    mine = got(V.link(spark.createDataFrame(data, "vec_id long, embedding array<double>")))
    links = sum(n for _, n, _ in want)
    assert links > 800 and sum(n for _, n, _ in mine) >= 0.95 * links
    assert all(a[1] <= b[1] for a, b in zip(mine, want))


def test_large_groups_go_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(V, "ENTRIES", 20)
    monkeypatch.setattr(V, "QUERIES", 30)
    rng = np.random.default_rng(4)
    base = rng.standard_normal((5, 16))
    data = [(i, [float(x) for x in base[i % 5] + 0.1 * rng.standard_normal(16)]) for i in range(200)]
    assert got(V.link(spark.createDataFrame(data, "vec_id long, embedding array<double>"))) == brute(data)


def test_no_link_is_lost_in_a_dense_cluster(spark, monkeypatch):
    """A third of the rows in one cluster that spreads over hundreds of the 1,024 lists."""
    init = V.Index.__init__
    monkeypatch.setattr(V.Index, "__init__", lambda self, x, rows, threshold: init(self, x, 1 << 20, threshold))
    rng = np.random.default_rng(5)
    x = rng.standard_normal((6000, 64))
    x[:2000] = x[0] + 0.24 * rng.standard_normal((2000, 64))
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    want = (unit @ unit.T >= 0.95).sum(1) - 1
    assert want.sum() > 100_000
    mine = got(V.link(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")))
    found = [n for _, n, _ in mine]
    assert sum(found) == want.sum() and found == want.tolist()


def test_odd_rows(spark):
    a, b = [1.0, 0.0, 2.0], [1.0, 0.01, 2.0]
    data = [(5, a), (3, b), (9, a), (1, None), (2, []), (4, [0.0, 0.0, 0.0]), (6, [1.0, None, 2.0]), (7, [1.0, float("nan"), 2.0]), (8, [float("inf"), 0.0, 2.0])]
    data += [(10, [1.0, 0.0]), (11, [2.0, 0.0]), (12, [-1.0, 0.0, -2.0]), (13, [1e-30, 0.0, 2e-30]), (14, [-0.0, 1.0]), (15, [0.0, 1.0])]
    random.Random(1).shuffle(data)
    df = clashing(spark, data, "vec_id long, embedding array<double>")
    assert got(V.link(df)) == brute(data)
    assert got(V.link(df.limit(0))) == []
    odd = got(V.link(clashing(spark, [(3, a), (3, a), (3, [0.0, 0.0, 0.0]), (4, b)], "vec_id long, embedding array<double>")))
    assert odd == [(3, 0, 3), (3, 2, 3), (3, 2, 3), (4, 2, 3)]
    assert len(rows(V.link(clashing(spark, [(None, a), (1, a)], "vec_id long, embedding array<double>")))) == 2
