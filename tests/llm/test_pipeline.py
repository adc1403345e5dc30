import random

import corpus_pipeline as C

from . import test_ngram_join as N
from . import test_suffix_dedup as S
from .common import rows

KIND = "doc_id long, text string, lang string, source string, n_chars long"


def planted():
    rng = random.Random(11)
    say = lambda n: " ".join(f"w{rng.randrange(4000)}" for _ in range(n))
    data, labels = [], []
    for i in range(300):
        t = say(120)
        if i % 10 == 0:
            t = t[:200] + " stupid idiot moron " + t[200:] + " idiot loser"
        data.append((i, t + f"\nAll rights reserved by everyone\n{say(30)}", f"s{i % 9}"))
        labels.append((i, int(i % 10 == 0)))
    passage = say(60)
    base = say(200).split()
    for i in range(300, 340):
        near = list(base)
        near[rng.randrange(200)] = f"x{i}"
        data.append((i, " ".join(near), f"s{i % 9}"))
    for i in range(340, 360):
        data.append((i, say(50) + " " + passage + " " + say(50), f"s{i % 9}"))
    data += [(360, data[342][1], "s1"), (361, "", "s"), (362, None, None), (363, "short", "s2")]
    return [(i, t, "en", s, len(t or "")) for i, t, s in data], labels


def test_stages_against_brute_force(spark, tmp_path):
    data, labels = planted()
    spark.createDataFrame(data, KIND).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, held = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for k, (_, stage) in enumerate(C.STAGES):
        before = [(r["doc_id"], r["text"]) for r in rows(docs)] if k else None
        out = stage(spark, docs, str(tmp_path))
        if k < 4:
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/out{k}")
        docs = spark.read.parquet(f"{tmp_path}/out{k}")
        held.append((before, rows(docs)))
    ids = [{r["doc_id"] for r in after} for _, after in held]
    assert set(range(364)) - ids[0] == set(range(0, 300, 10))
    lines = {r["doc_id"]: r["text"] for r in held[1][1]}
    assert ids[1] == ids[0] and sum("All rights" in (t or "") for t in lines.values()) == 1
    keep = {k for k, _, c in N.brute(held[2][0]) if k == c}
    assert ids[2] == keep and not keep & set(range(301, 340)) and 360 not in keep and 300 in keep
    want = {k: n for k, _, n, _, _ in S.brute(held[3][0])}
    text = dict(held[3][0])
    got = {r["doc_id"]: len((r["text"] or "").encode()) for r in held[3][1]}
    assert got == {k: len((text[k] or "").encode()) - n for k, n in want.items() if n < len((text[k] or "").encode()) or not n}
    assert ids[4] == ids[3]
    assert all(r["n_chars"] == len(r["text"] or "") for r in held[3][1])


def test_run_gives_the_last_stage(spark, sf):
    got = rows(C.run(spark, sf))
    assert got and {"doc_id", "sequence_id", "offset", "length"} <= set(got[0])


def test_rows_with_nulls_and_repeats(spark, tmp_path):
    data = [(None, None, None, None, None), (1, "a b c d e f g", None, None, None), (1, "a b c d e f g", None, None, None), (None, "x y z", "en", "s", 5), (2, "", "", "", 0)]
    docs = spark.createDataFrame(data, KIND)
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for empty in (docs, docs.limit(0)):
        cur = empty
        for k, (_, stage) in enumerate(C.STAGES):
            out = stage(spark, cur, str(tmp_path))
            out.write.mode("overwrite").parquet(f"{tmp_path}/o{k}")
            cur = spark.read.parquet(f"{tmp_path}/o{k}")
        assert cur.count() == (5 if empty is docs else 0)
