"""Every registered query against its SQL, and against itself with its input dealt differently."""

import math

import duckdb
import pytest

from talus.registry import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def value(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5) + 0.0
    return v


def rows(records):
    return sorted((tuple(value(r[c]) for c in sorted(r)) for r in records), key=str)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_as_sql(spark, sf, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    cur = db.execute(ORACLE_SQL[name])
    names = [d[0] for d in cur.description]
    df = QUERIES[name](spark, sf)
    assert sorted(names) == sorted(df.columns)
    assert rows(r.asDict() for r in df.collect()) == rows(dict(zip(names, r)) for r in cur.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_query_without_sql_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLE_SQL) <= set(QUERIES)


def test_rounding_is_that_of_the_sql(spark):
    """Products with 10^6 just under a half: the shortest decimal text of the first two ends in 5."""
    from talus.plans.queries import _round

    odd = [163.91405 / 16 * 100, -105.44859 / 80 * 100, 510.0546875, 0.5e-6, 1e305, math.inf, -math.inf, None]
    got = [r.v for r in _round(spark.createDataFrame([(v,) for v in odd], "v double")).collect()]
    assert got == [duckdb.execute("SELECT round(?::DOUBLE, 6)", [v]).fetchall()[0][0] for v in odd]
    assert got[0] == 1024.462812 and math.isnan(_round(spark.createDataFrame([(math.nan,)], "v double")).first().v)
