from talus.llm import exact_dedup as X

from .common import clashing, rows, same


def test_documents_against_sql(spark, sf):
    same(X.op3_exact_dedup(spark, sf), X.OP3_SQL, sf)


def test_odd_texts(spark):
    data = [(5, None), (2, ""), (9, "a  b\t\nc"), (7, "a b c"), (8, "a b c "), (1, " "), (3, "\t"), (4, "a\xa0b"), (7, "a b c"), (None, "a b c"), (None, "lone")]
    got = {(r["doc_id"], r["text_sha256"]): r for r in rows(X.exact_dedup(clashing(spark, data)))}
    assert sorted((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in got.values() if r["doc_id"]) == [
        (1, 1, 2, True), (2, 2, 2, True), (3, 1, 2, False), (4, 4, 1, True), (5, 2, 2, False), (7, 7, 4, True), (8, 8, 1, True), (9, 7, 4, False)
    ]
    assert X.exact_dedup(clashing(spark, data)).count() == len(data)
    assert X.exact_dedup(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_directory_doubles_until_no_bucket_is_overfull():
    slots = {i: 1 for i in range(64)} | {5: 500}
    buckets = X.directory(slots, 10, 6)
    assert sum(w for _, w, _ in buckets) == 64 and buckets[0][0] == 0
    for first, width, depth in buckets:
        held = sum(slots.get(i, 0) for i in range(first, first + width))
        assert held <= 10 or depth == 6
    assert X.directory({}, 10, 6) == [(0, 64, 0)]


def test_small_buckets_give_the_same_answer(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    assert rows(X.exact_dedup(df, capacity=3)) == rows(X.exact_dedup(df))


def test_colliding_hashes_chain(spark, sf, monkeypatch):
    """Three hashes for all texts: every bucket chains, and only bytes tell texts apart."""
    from pyspark.sql import functions as F

    df = spark.read.parquet(f"{sf}/documents.parquet")
    want = rows(X.exact_dedup(df))
    monkeypatch.setattr(X, "hashed", lambda norm: F.shiftleft((F.length(norm) % 3).cast("long"), 61))
    assert rows(X.exact_dedup(df, capacity=1)) == want


def test_hot_group_and_very_long_texts(spark):
    long = "word " * 400_000
    data = [(i, "hot  text") for i in range(5000)] + [(9000 + i, f"text {i}") for i in range(3000)] + [(20000, long), (20001, long.replace(" ", "\n")), (20002, long + "x")]
    got = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in rows(X.exact_dedup(spark.createDataFrame(data, "doc_id long, text string")))}
    assert len(got) == len(data) and all(got[i] == (0, 5000) for i in range(5000)) and all(got[9000 + i] == (9000 + i, 1) for i in range(3000))
    assert got[20001] == (20000, 2) and got[20002] == (20002, 1)
