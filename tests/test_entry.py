"""The registered queries against their SQL on the smallest tables."""

import os

import duckdb
import pytest

from linkloom import queries as Q

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(df):
    # Columns with nulls come as floats on one side; whole numbers are compared as such.
    number = lambda v: isinstance(v, (int, float)) and not isinstance(v, bool) or hasattr(v, "dtype") and v.dtype.kind in "if"
    norm = lambda v: None if v is None or v != v else round(float(v), 5) if number(v) else v
    df = df[sorted(df.columns)].astype(object)
    return sorted(repr([norm(None if str(v) in ("<NA>", "nan") else v) for v in r]) for r in df.values.tolist())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_query_matches_sql(spark, name):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = Q.QUERIES[name](spark, SF).toPandas(), c.sql(Q.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


def test_every_sql_has_its_query():
    assert set(Q.ORACLES) <= set(Q.QUERIES)
