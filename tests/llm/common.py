import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def oracle(sql, sf):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    cur = db.execute(sql)
    names = [d[0] for d in cur.description]
    return sorted((dict(zip(names, r)) for r in cur.fetchall()), key=str)


def rows(df):
    return sorted((r.asDict() for r in df.collect()), key=str)


def same(df, sql, sf):
    want = oracle(sql, sf)
    order = lambda rs: sorted([tuple(sorted(r.items())) for r in rs], key=str)
    got = order(rows(df))
    assert len(got) == len(want)
    assert got == order(want)


def clashing(spark, data, kind="doc_id long, text string"):
    """The rows, with extra columns whose names operators use inside."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(data, kind)
    for c in ("key", "h", "norm", "words", "n", "row", "kept", "start", "a", "b", "bucket", "part", "site", "line"):
        df = df.withColumn(c, F.lit(c))
    return df
